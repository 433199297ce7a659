"""Suffix arrays and repeated passages against plain Python."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from driftline.llm import queries, suffix_dedup
from driftline.llm.suffix_array import permuted_prefixes, suffix_array


def test_suffix_arrays():
    draw = np.random.default_rng(1)
    for _ in range(300):
        raw = draw.integers(0, int(draw.integers(1, 5)), int(draw.integers(0, 60)))
        s, n = np.r_[raw + 1, 0], len(raw)
        sa = suffix_array(s)
        assert sa.tolist() == sorted(range(n + 1), key=lambda i: tuple(s[i:]))
        left, r = np.r_[n - np.arange(n), 0], np.r_[raw, 255].astype(np.uint8)
        p = permuted_prefixes(r, sa, left)
        for a, b in zip(sa[1:], sa[:-1], strict=True):
            m = 0
            while m < min(left[a], left[b]) and r[a + m] == r[b + m]:
                m += 1
            assert p[a] == m


def by_hand(rows, window=100):
    """rows: doc_id, text; a string is new where no earlier place has it."""
    seen, out, whole = set(), Counter(), set()
    keyed = sorted(((d is None, d or 0, suffix_order(t), d, (t or "").encode()) for d, t in rows), key=lambda r: r[:3])
    for *_, d, raw in keyed:
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            if w in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
        whole.add(raw)
    return out


def suffix_order(t):
    return 0  # no two texts of one id in these rows, unless they are equal


def got(df, **how):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.deduplicated(df, **how).collect())


def mixed_rows(draw):
    words = [f"w{i}" for i in range(300)] + ["ünï", "漢字", " ", "\n"]
    text = lambda n: " ".join(draw.choice(words, n))
    passages = [text(40) for _ in range(6)] + ["ab" * 90, "z" * 400]
    rows = []
    for i in range(120):
        t = text(int(draw.integers(0, 60)))
        for _ in range(int(draw.integers(0, 3))):
            p = passages[int(draw.integers(len(passages)))]
            a = int(draw.integers(0, 30))
            t += " " + p[a : a + int(draw.integers(60, 300))] + " " + text(5)
        rows.append((i * 3, t))
    rows += [(1000 + i, rows[i % 7][1]) for i in range(30)] + [(2000, None), (2001, ""), (2002, "short"), (2003, passages[0] * 3)]
    rows += [(2003, passages[0] * 3)] * 3 + [(2002, "short")] * 2 + [(None, rows[3][1] + " end")]
    rows += [(3000 + i, rows[5][1] + f" {i}") for i in range(40)]
    return rows


@pytest.mark.parametrize("how", [{}, {"most": 3, "shard_bytes": 600}, {"gram": 8, "broadcast_rows": 0}])
def test_repeated_passages(spark, how):
    rows = mixed_rows(np.random.default_rng(7))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, **how) == by_hand(rows)


def test_long_texts_cross_pieces(spark, monkeypatch):
    draw = np.random.default_rng(9)
    base = "".join(map(chr, draw.integers(97, 123, 5000)))
    rows = [(1, base), (2, "x" * 333 + base[1000:4500]), (3, base[200:350] + "y" + base[2000:2099])]
    raws = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
    whole = [suffix_dedup.anchors(r, np.array([0, len(r)]), 100, 24) for r in raws]
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    for r, w in zip(raws, whole, strict=True):
        cut = suffix_dedup.anchors(r, np.array([0, len(r)]), 100, 24)
        # every start is in one run, with the same anchor
        each = lambda x: {int(s) + k: int(a) for _, s, n, a, _ in zip(*x, strict=True) for k in range(n)}
        assert each(cut) == each(w) and len(each(w)) == len(r) - 99 and sum(w[2]) == len(r) - 99
    monkeypatch.undo()
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == by_hand(rows)


def test_odd_rows_and_none(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    have = got(odd)
    assert have == by_hand(rows)
    assert suffix_dedup.deduplicated(odd.limit(0)).collect() == []


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op12_suffix_dedup(spark, sf).collect()
    found = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    assert found == by_hand([tuple(d) for d in docs])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    sql = con.sql(queries.ORACLE_SQL["op12_suffix_dedup"]).select("doc_id, n_bytes, n_removed, n_spans, kept_sha256")
    assert found == Counter(sql.fetchall())
