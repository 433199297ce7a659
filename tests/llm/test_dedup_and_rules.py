"""Measures, fingerprints, duplicates and rules against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from driftline.llm import exact_dedup, quality_rules, simhash, url_filters
from driftline.llm._bytes import xxh64
from driftline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE_RUN = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return t.encode().lower().decode()


def test_xxh64_is_the_library_s():
    raw = np.random.default_rng(0).integers(0, 256, 500).astype(np.uint8)
    stops = np.arange(300)
    starts = np.maximum(stops - 130, 0)
    assert [int(x) for x in xxh64(raw, starts, stops)] == [xxhash.xxh64_intdigest(raw[a:b].tobytes(), 42) for a, b in zip(starts, stops, strict=True)]


def measures(t):
    w = words(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) for k in range(3) if windows[tuple(w[i : i + 3])] > 1}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside)


def rules(rows, min_texts, max_share):
    """The verdict of each row, by hand."""
    def flat(x):
        return " ".join(words(lower(x)))

    texts = defaultdict(set)
    for _, t, s in rows:
        texts[s].add(t)
    n = {s: Counter(x for t in ts for x in {flat(y) for y in (t or "").split("\n")} if x) for s, ts in texts.items()}
    out = []
    for d, t, s in rows:
        m = measures(t)
        gone = sum(len(words(x)) for x in (t or "").split("\n") if flat(x) and n[s][flat(x)] > max(min_texts, len(texts[s]) * max_share))
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        out.append((d, *m, failed, gone, not failed and gone <= 0.8 * m[0]))
    return out


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_quality_rules(which, request):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    got = quality_rules.quality_rules(df, min_texts=2, max_share=0.1)
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.n_removed_words, r.kept) for r in got.collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(rules(rows, 2, 0.1), key=key)


def test_texts_that_differ_in_white_space_or_case_count_once(spark):
    """Twelve copies of one text, spelled apart, do not make its lines frequent."""
    own = " ".join(f"w{k}" for k in range(60))
    rows = [(i, own.replace(" ", " " * (i + 1)) + "\nEnd here", "h") for i in range(6)] + [(6 + i, own.upper() + "\n" * (i + 1) + "end here", "h") for i in range(6)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_texts=2).collect()
    assert [(r.n_removed_words, r.kept) for r in got] == [(0, True)] * 12


def test_a_line_above_the_absolute_limit_goes_whatever_its_share(spark):
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(60))
    rows = [(i, own(i) + ("\nfooter line" if i < 8 else ""), "h") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for most, lost in ((7, 2), (8, 0)):
        got = {r.doc_id: r.n_removed_words for r in quality_rules.quality_rules(df, min_texts=2, max_share=0.5, max_texts=most).collect()}
        assert got == {i: lost if i < 8 else 0 for i in range(40)}


def test_cleaned_removes_frequent_lines_and_depleted_documents(spark):
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(60))
    rows = [(i, f"{own(i)}\nFooter  line HERE\n", "h", 0) for i in range(20)]
    rows += [(100, "footer line here\n" * 30, "h", 0), (101, f"{own(3)} z\nfooter line here", "other", 0)]
    rows += [(200 + i, own(99), "h", 0) for i in range(30)]  # copies of a clean text
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = {r.doc_id: r for r in quality_rules.cleaned(df, quality_rules.quality_rules(df)).collect()}
    assert 100 not in out and {200 + i for i in range(30)} <= set(out)
    assert out[5].text == own(5) + "\n" and out[5].n_chars == len(out[5].text)
    assert out[101].text.endswith("footer line here")  # another host


def fingerprint(t):
    w = words(lower(t or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(fps, ids):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [least.get(top(i)) for i in range(len(fps))]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_near_duplicates(which, request):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    fps = [fingerprint(r.text) for r in rows]
    want = Counter(zip([r.doc_id for r in rows], [f"{f:016x}" for f in fps], brute(fps, [r.doc_id for r in rows]), strict=True))
    got = simhash.near_duplicates(df)
    assert Counter(map(tuple, got.select("doc_id", simhash.hexadecimal("fp"), "component_id").collect())) == want


@pytest.mark.parametrize("most", [2, 20, 4096])
def test_close_pairs_connect_dense_groups(spark, most):
    """Dense clusters, cut again at several levels, keep every link's component."""
    draw = np.random.default_rng(1)
    fps = set()
    for _ in range(6):
        centre = int(draw.integers(0, 1 << 63)) * 2 + 1
        for _ in range(60):
            x = centre
            for b in draw.choice(64, int(draw.integers(0, 5)), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.close_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), most=most)
    root = {r.node: r.component for r in components(edges).collect()}
    got = [root.get(x, x) for x in signed]
    want = brute(fps, list(range(len(fps))))
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(301), 0) | dict.fromkeys(range(1000, 1400), 1000)
    assert not components(spark.createDataFrame([], "a long, b long")).collect()


def test_golomb_round_trip():
    draw = np.random.default_rng(2)
    for n, top, rice in ((1, 1 << 40, 30), (500, 1 << 44, 34), (300, 1000, 1), (5, 6, 0)):
        v = np.sort(draw.choice(top, n, replace=False)).astype(np.uint64) if top < 10**6 else np.unique(draw.integers(0, top, n).astype(np.uint64))
        code = exact_dedup.golomb(v, rice)
        assert exact_dedup.ungolomb(code, len(v), rice).tolist() == v.tolist()


@pytest.mark.parametrize("which", ["docs", "odd"])
@pytest.mark.parametrize("how", [{}, {"fp_bits": 24, "rows_per_owner": 20, "rows_per_sender": 7, "broadcast_rows": 0}])
def test_exact_duplicates(which, how, request):
    df = request.getfixturevalue(which)
    flat = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = [(r.doc_id, flat(r.text)) for r in df.collect()]
    groups = defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    least = {t: min(ds, key=lambda d: (d is None, d or 0)) for t, ds in groups.items()}
    want = Counter((d, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)
    got = exact_dedup.exact_duplicates(df, **how).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exact_dedup.deduplicated(df, **{k: v for k, v in how.items() if k != "broadcast_rows"})
    assert Counter(flat(r.text) for r in left.collect()) == Counter(groups.keys()) and left.columns == df.columns


def verdict(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
    fit = [(len(h + p), len(h), v, h + p) for v, h, p in listed if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


def test_url_filters(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    more = [None, "", "no scheme/es/", "http://EXAMPLE.org/es/x", "http://notexample.org/es/", "http://example.org", "http://example.org/es", "http://a.b.example.org/en/15?q", "x://y://com/de/", "http://com/de/", "http://org?/x", "http://x.com/fr/\nde/", "://", "http://ÄÖ.Org/漢/", "http://h.org/" + "p" * 5000]
    extra = spark.createDataFrame([(10**6 + i, u) for i, u in enumerate(more + more[:4])], pages.schema)
    rows = pages.union(extra)
    rules = spark.createDataFrame(url_filters.RULES, "verdict string, host string, path string")
    want = Counter((r.page_id, *verdict(r.url, url_filters.RULES)) for r in rows.collect())
    for limit in (0, 1000):
        got = url_filters.url_filters(rows, rules, broadcast_rows=limit)
        assert Counter(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect())) == want
    assert {r.verdict for r in url_filters.url_filters(rows, rules.limit(0)).collect()} == {"allow"}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert not quality_rules.quality_rules(none).collect()
    assert not simhash.near_duplicates(none).collect()
    assert not exact_dedup.exact_duplicates(none).collect()
    assert not exact_dedup.deduplicated(none).collect() and not simhash.deduplicated(none).collect()
