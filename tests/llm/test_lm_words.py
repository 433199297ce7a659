"""The word softmax and whole scores against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from driftline.llm import lm_scoring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BITS = (1 << 64) - 1


def mixed(x):
    for a, b in ((33, 14029467366897019727), (29, 1609587929392839161)):
        x = ((x ^ (x >> a)) * b) & BITS
    return x ^ (x >> 32)


def tokens(t):
    """Hash and shape of each token, the end included."""
    out = []
    for w in [*WORD.findall((t or "").encode().lower().decode()), ""]:
        raw = w.encode()
        solid = lambda c: chr(c).isascii() and chr(c).isalnum() or c > 127
        mark = len(raw) > 1 and not solid(raw[-1])
        last = raw[: len(raw) - mark]
        shape = mixed(last[-1] | (last[-2] if len(last) > 1 else 0) << 8 | mark << 16) % 47 if raw else 0
        out.append((xxhash.xxh64_intdigest(raw, 42), shape))
    return out


def by_hand(spark, docs, share, least_pairs, word_rounds, ridge, rounds):
    """base and score of each text, with every normaliser summed over the whole class."""
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    texts = [(r.doc_id, tokens(r.text)) for r in docs.select("doc_id", "text").collect()]
    count, shape = Counter(), {}
    for d, ts in texts:
        shape |= dict(ts)
        if not held(d):
            count.update(h for h, _ in ts)
    order = sorted(count, key=lambda h: (-count[h], h))
    rank = {h: k for k, h in enumerate(order)}
    cls = lambda h, s: rank[h] if rank.get(h, 16) < 16 else 16 + s
    symbol = lambda h, s: rank[h] if rank.get(h, 448) < 448 else 448 + s
    members = defaultdict(list)
    for h in count:
        members[cls(h, shape[h])].append(h)

    def steps(ts):
        for i, (h, s) in enumerate(ts):
            one, two = (ts[i - 1] if i else None), (ts[i - 2] if i > 1 else None)
            context = (symbol(*one) if one else 511) * 64 + (cls(*two) if two else 63)
            q = next((m for m in (mixed((x[0] if x else 1) + k & BITS) for k, x in ((1, one), (2, two))) if share >= 1 or m < int(share * 2.0**64)), None)
            k = cls(h, s)
            yield h, s, k, context, None if q is None or k < 16 else (q, k)

    seen = defaultdict(Counter)
    for d, ts in texts:
        if not held(d):
            for h, _, _, _, q in steps(ts):
                if q:
                    seen[q][h] += 1
    weight = {}
    for q, f in seen.items():
        total, whole = sum(f.values()), sum(count[h] + 1 for h in members[q[1]]) + 1
        few = {h: n for h, n in f.items() if n >= least_pairs}
        b = {h: math.log((n + ridge) / (total * (count[h] + 1) / whole + ridge)) for h, n in few.items()}
        norm = lambda b, q=q: 1 + sum((count[h] + 1) * math.exp(b.get(h, 0.0)) for h in members[q[1]])
        for _ in range(word_rounds):
            z, old = norm(b), b
            hope = {h: total * (count[h] + 1) * math.exp(old[h]) / z for h in few}
            b = {h: old[h] + 0.7 * max(-1, min(1, (few[h] - hope[h] - ridge * old[h]) / (hope[h] + ridge))) for h in few}
        weight[q] = (b, norm(b))
    given = docs.select("doc_id", "text")
    learn = given.filter(lm_scoring.fold("doc_id") != 2)
    h = np.array(order, np.uint64)
    shared = spark.sparkContext.broadcast(lm_scoring.Vocabulary(h, np.array([count[x] for x in order], np.int64)))
    classes = lm_scoring.trained(lm_scoring.events(learn, shared), rounds=rounds)
    out = []
    for d, ts in texts:
        total = 0.0
        for h, s, k, context, q in steps(ts):
            p = lm_scoring.class_scores(classes, np.array([context]))[0]
            assert abs(np.exp(p).sum() - 1) < 1e-6
            b, z = weight.get(q) or ({}, sum(count[x] + 1 for x in members[k]) + 1)
            if q in weight:  # the words of the class and the place of those never seen make one
                assert abs((1 + sum((count[x] + 1) * math.exp(b.get(x, 0.0)) for x in members[k])) / z - 1) < 1e-9
            inside = 0.0 if k < 16 else math.log((count.get(h, 0) + 1) * math.exp(b.get(h, 0.0)) / z)
            total += (p[k] + inside) / math.log(10)
        out.append((d, round(total, 2)))
    return Counter(out)


@pytest.mark.parametrize("share", [0.125, 1.0])
@pytest.mark.parametrize("top_words", [600, 1 << 19])
def test_scores_are_those_of_plain_python(spark, docs, odd, share, top_words):
    """Whether words, features and histories are looked up or joined."""
    few = docs.orderBy("doc_id").limit(40).select("doc_id", "text")
    few = few.union(few).union(odd.select("doc_id", "text").filter("length(text) < 9000 OR text IS NULL")).filter("text IS NULL OR length(text) < 4000").cache()
    how = {"least_pairs": 2, "word_rounds": 3, "ridge": 0.5, "rounds": 3}
    want = by_hand(spark, few, share, **how)
    got = Counter((r.doc_id, round(r.score, 2)) for r in lm_scoring.lm_scores(few, history_share=share, top_words=top_words, **how).collect())
    off = sum((want - got).values())
    assert sum(got.values()) == sum(want.values())
    # a hundredth may be rounded the other way
    pairs = zip(sorted(want.elements(), key=str), sorted(got.elements(), key=str), strict=True)
    assert off <= 3 or all(abs(a[1] - b[1]) < 0.02 for a, b in pairs)


def test_tokens_are_those_of_plain_python(docs, odd):
    for df in (docs, odd):
        texts = [r.text for r in df.select("text").collect()]
        h, shape, first = lm_scoring.tokens_of(pa.array(texts))
        want = [tokens(t) for t in texts]
        assert np.diff(first).tolist() == [len(x) for x in want]
        assert list(zip(h.tolist(), shape.tolist(), strict=True)) == [x for t in want for x in t]


def test_a_text_seen_twice_scores_above_one_seen_once(spark):
    draw = np.random.default_rng(0)
    text = lambda: " ".join(f"w{k}" for k in draw.integers(0, 3000, 200))
    rows = [(i, text()) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 300, 10)]
    got = {r.doc_id: r.score / r.n_tokens for r in lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = lambda d: zlib.crc32(str(d).encode()) % 7 != 2
    twice = [got[i] for i in range(0, 300, 10) if train(i) and train(1000 + i)]
    once = [got[i] for i in range(300) if i % 10 and train(i)]
    assert np.mean(np.array(twice) > max(once)) > 0.9


def test_better_than_the_base_on_texts_held_out(docs):
    out = [r for r in lm_scoring.lm_scores(docs).collect() if r.held_out]
    base = lm_scoring.lm_scores(docs, least_pairs=1 << 40).collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert sum(r.score for r in out) > sum(r.score for r in base if r.held_out)


def test_every_word_has_its_history_unless_asked_otherwise(spark, docs):
    """A pair counts whatever the hash of its history, in one shard or several, as a frequent history or not."""
    few = docs.orderBy("doc_id").limit(40).select("doc_id", "text")
    few = few.union(few).union(spark.createDataFrame([(900, None), (None, "one two three one two"), (901, "")], few.schema)).cache()
    how = {"least_pairs": 2, "word_rounds": 3, "ridge": 0.5, "rounds": 3}
    want = sorted(by_hand(spark, few, 1.0, **how).elements(), key=str)
    for more in ({}, {"shard": 500}, {"frequent": 30}, {"frequent": 30, "shard": 500, "top_words": 1000}, {"shard": 500, "top_words": 1000}):  # 448 words are symbols
        got = sorted(((r.doc_id, r.score) for r in lm_scoring.lm_scores(few, **how, **more).collect()), key=str)
        assert [d for d, _ in got] == [d for d, _ in want] and all(abs(a[1] - b[1]) < 0.02 for a, b in zip(want, got, strict=True)), more
