"""Shingle similarity against all pairs in plain Python."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from test_dedup_and_rules import brute, fingerprint, lower, words

import corpus_pipeline


def shingles(t):
    w = words(lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similar(a, b):
    return bool(a | b) and len(a & b) >= 0.8 * len(a | b) - 1e-9


def test_near_stage_links_light_edits_and_keeps_clean_texts(spark):
    draw = np.random.default_rng(5)
    rows = []
    for i in range(60):
        w = [f"g{i}w{k}" for k in draw.integers(0, 500, 150)]
        rows.append((10 * i, " ".join(w)))
        for j, edits in enumerate((1, 2, 3, 12), 1):
            v = list(w)
            for at in draw.choice(150, edits, replace=False):
                v[at] = f"new{i}x{j}x{at}"
            rows.append((10 * i + j, " ".join(v)))
    rows += [(9000 + i, f"short text {i}") for i in range(5)] + [(9100, ""), (9101, None), (None, rows[0][1] + " tail")]
    rows += chains(draw, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs, "").filter("text <> ''").collect()}
    members = defaultdict(list)
    for r, c in zip(rows, linked([t for _, t in rows]), strict=True):
        if r[1]:
            members[c].append(r)
    want = {min(m, key=lambda r: (r[0] is None, r[0] or 0)) for m in members.values()}
    assert kept == want and len(want) < len([r for r in rows if r[1]]) - 200


def chains(draw, n):
    """Three texts each: the first is similar to the second, the second to the third, the first and the third are not."""
    out = []
    for i in range(n):
        w = [f"c{i}w{k}" for k in range(220)]
        b, c = list(w), list(w)
        b[:20] = [f"b{i}x{k}" for k in range(20)]
        c[:40] = [*b[:20], *(f"c{i}x{k}" for k in range(20))]
        out += [(20_000 + 10 * i + k, " ".join(x)) for k, x in enumerate((w, b, c))]
    return out


def linked(texts):
    """Components of all links, by brute force: three bits of fingerprints, or 0.8 of shingles."""
    place = list(brute([fingerprint(t) for t in texts], list(range(len(texts)))))
    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if place[i] != place[j] and similar(sets[i], sets[j]):
                old, new = place[i], place[j]
                place = [new if x == old else x for x in place]
    return place


def test_recall_over_real_documents(spark):
    """No two texts that stay share 0.8 of their shingles, found by an exact join on all shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.near(spark, docs, "").collect()
    sets = {r.doc_id: shingles(r.text) for r in kept}
    having = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            having[x].append(d)
    both = Counter(p for ds in having.values() if len(ds) < 200 for p in combinations(sorted(ds), 2))
    assert [p for p in both if similar(sets[p[0]], sets[p[1]])] == []
    assert len(kept) < docs.count()
