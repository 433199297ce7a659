"""Vector codes and source divergence against plain Python, and against their SQL."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from driftline.llm import divergence as dv
from driftline.llm import queries, vector_codes


def by_hand(rows, parts=8, entries=16, rounds=6):
    """vec_id, codes, error by row and the codebooks; plain loops over Python integers."""
    kept = [(i, lab, [math.floor(4096 * float(x)) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    width = -(-max(len(v) for *_, v in kept) // parts) * parts
    step = width // parts
    kept = sorted(((i, lab, v + [0] * (width - len(v))) for i, lab, v in kept), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(v, p) for *_, v in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda v: [min(range(len(b)), key=lambda k: (far(cut(v, p), b[k]), k)) for p, b in enumerate(books)]
    for _ in range(rounds):
        codes = [pick(v) for *_, v in kept]
        for p, b in enumerate(books):
            for k in range(len(b)):
                mine = [cut(v, p) for (*_, v), c in zip(kept, codes, strict=True) if c[p] == k]
                if mine:
                    b[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for i, lab, v in kept:
        c = pick(v)
        out.append((i, lab, c, sum(far(cut(v, p), books[p][k]) for p, k in enumerate(c))))
    return out, books


def check_codes(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    want, books = by_hand(rows)
    codes = vector_codes.trained(df)
    assert [[[int(x) for x in e] for e in b] for b in codes.books] == books
    got = vector_codes.with_label_error(vector_codes.encoded(codes)).collect()
    total = Counter()
    for _, lab, _, e in want:
        total[lab] += e
    assert Counter((r.vec_id, r.label, tuple(r.codes), r.error, r.label_error) for r in got) == Counter((i, lab, tuple(c), e, total[lab]) for i, lab, c, e in want)
    assert codes.sha256() == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_codes_of_random_vectors_with_ties_nulls_and_odd_lengths(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(draw.normal(size=16) * 4) / 4096], int(draw.integers(3)) if i % 7 else None) for i in range(150)]
    rows += [(150, None, 1), (151, [None] * 16, 1), (152, [float("nan")] * 16, 2), (153, [float("inf")] + [0.0] * 15, 2), (0, rows[0][1], 2), (None, rows[1][1], None)]
    check_codes(spark, rows)
    check_codes(spark, [(i, v[:13] if v and i and i % 5 == 0 else v, x) for i, v, x in rows])


def test_codes_of_few_vectors_large_components_and_none(spark):
    check_codes(spark, [(3, [0.5] * 8, None), (1, [-0.5] * 8, None)])
    big = [(i, [float(x) for x in np.random.default_rng(i).normal(size=16) * 1e4], 0) for i in range(40)]
    check_codes(spark, big)
    vast = [(0, [1e30] * 8, 0), (1, [1e30] * 8, 0), (2, [-1e30] * 8, 0)]
    assert [[int(x) for x in b[2]] for b in vector_codes.trained(spark.createDataFrame(vast, "vec_id long, embedding array<double>, label int"), rounds=1).books] == [[int(-1e30 * 4096)]] * 8
    empty = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.with_label_error(vector_codes.encoded(vector_codes.trained(empty))).collect() == []


@pytest.mark.parametrize("leaf", [1, 4])
def test_trees_find_the_lowest_of_the_nearest(leaf):
    draw = np.random.default_rng(leaf)
    for n in (1, 2, 16, 100):
        e, x = draw.integers(-3, 4, (n, 3)), draw.integers(-4, 5, (500, 3))
        d = ((x[:, None, :] - e[None, :, :]) ** 2).sum(axis=2)
        got, far = vector_codes.nearest(vector_codes.tree(e, leaf), x)
        assert (got == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


def audit_by_hand(rows, least=10):
    """rows: text, lang, source."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, count = defaultdict(Counter), defaultdict(Counter)
    for t, lang, source in rows:
        words = [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {k[0] for k in count}:
        kept = [w for w, n in docs[lang].items() if n >= least]
        groups = {s: {w: c[w] for w in kept} for (k, s), c in count.items() if k == lang}
        whole = {w: sum(g[w] for g in groups.values()) for w in kept}
        prob = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}  # noqa: E731, B023
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        p, q = {s: prob(c) for s, c in groups.items()}, prob(whole)
        for s in groups:
            pair = [(sum(apart(p[s][w], p[o][w]) for w in kept), o) for o in groups if o != s]
            term = [(apart(p[s][w], q[w]), w) for w in kept if groups[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= 10]
    return Counter(out)


@pytest.mark.parametrize("how", [{}, {"heavy_share": 2.0}, {"heavy_share": 0.0}, {"block_groups": 2, "tile_rows": 20}, {"heavy_share": 0.5, "block_groups": 3, "tile_rows": 50}])
def test_divergence(spark, how):
    draw = np.random.default_rng(11)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Über", "über", "漢字", "A1b"]
    rows = []
    for i in range(400):
        weight = draw.dirichlet(np.full(len(words), 0.2))
        text = " ".join(draw.choice(words, int(draw.integers(0, 40)), p=weight))
        rows.append((text if i % 40 else None, ["de", "en", None, ""][int(draw.integers(4))], [*(f"s{k}" for k in range(7)), None, ""][int(draw.integers(9))]))
    rows += [("one two", "xx", "a"), ("", "xx", "b"), ("only here", "yy", "a"), (rows[1][0],) * 3] + [("the the same", "zz", "a")] * 12
    got = dv.divergence(spark.createDataFrame(rows, "text string, lang string, source string").repartition(3), **how).collect()
    assert Counter(tuple(r) for r in got) == audit_by_hand(rows)


def test_divergence_of_no_rows(spark):
    none = spark.createDataFrame([], "text string, lang string, source string")
    assert dv.divergence(none).collect() == []


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_divergence"])
def test_queries_match_their_sql(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert Counter(map(tuple, got.select(*cols).collect())) == Counter(want.select(*cols).fetchall())
