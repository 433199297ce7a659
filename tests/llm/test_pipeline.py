"""The pipeline's stages on a small table, each against plain Python on its own input."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from test_dedup_and_rules import SPACE_RUN, brute, fingerprint, lower, rules, words
from test_mixing_and_packing import target_by_hand
from test_shingles import shingles, similar
from tokenizers import Tokenizer

import corpus_pipeline
from driftline.llm import simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size int"


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """Documents with repeated and null ids, copies, a footer, depleted and empty texts, and an odd column."""
    real = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 0) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    own = lambda i, n=70: " ".join(f"v{i}x{k}" for k in range(n))
    made = [(5000 + i, f"{own(i)}\nShared  FOOTER here", "en", "made", 0, i) for i in range(30)]
    made += [(5100, "shared footer here\n" * 40, "en", "made", 0, 1), (5101, own(101), None, None, None, 2), (5102, own(101) + " ", None, None, None, 3)]
    made += [(5103, own(103, 400), "en", "made", 0, 4), (5104, own(103, 400) + " tail", "en", "made", 0, 5)]
    # one id, two texts: one of them is a near copy of an earlier document
    made += [(5105, own(105), "en", "made", 0, 6), (5105, own(103, 400) + " end", "en", "made", 0, 7)]
    made += [(None, own(106, 300), "en", "made", 0, 8), (None, own(107, 300), "en", "made", 0, 9), (None, own(106, 300) + " more", "en", "made", 0, 10)]
    made += [(5108, None, None, "made", None, 11), (5109, "", "en", "made", 0, 12), (5110, own(110, 6000), "en", "made", 0, 13)]
    to = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(real + made, COLUMNS).repartition(3).write.parquet(str(to / "documents.parquet"))
    return str(to)


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    """Each stage's input and output."""
    out, docs, to = [], spark.read.parquet(f"{folder}/documents.parquet"), tmp_path_factory.mktemp("steps")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(to / name))
        after = spark.read.parquet(str(to / name))
        out.append((docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return out


def ids(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_columns_stay(steps):
    assert all(set(before) == set(after) for _, _, before, after in steps[:-1])


def test_quality(steps):
    before, after, _, _ = steps[0]
    flat = lambda x: " ".join(words(lower(x)))
    texts = defaultdict(set)
    for r in before:
        texts[r.source].add(r.text)
    often = {s: Counter(x for t in ts for x in {flat(y) for y in (t or "").split("\n")} if x) for s, ts in texts.items()}
    verdicts = rules([(r.doc_id, r.text, r.source) for r in before], 10, 0.02)
    want = Counter()
    for r, (*_, lost, kept) in zip(before, verdicts, strict=True):
        if kept:
            limit = max(10, len(texts[r.source]) * 0.02)
            left = "\n".join(x for x in r.text.split("\n") if not flat(x) or often[r.source][flat(x)] <= limit)
            assert (left != r.text) == (lost > 0)
            want[r.doc_id, left] += 1
    assert ids(after) == want
    assert (5000, " ".join(f"v0x{k}" for k in range(70))) in want and 5100 not in {d for d, _ in want}


def test_exact(steps):
    before, after, _, _ = steps[1]
    first = {}
    for r in before:
        t = SPACE_RUN.sub(" ", r.text or "")
        first[t] = min(first.get(t, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    got = Counter((SPACE_RUN.sub(" ", r.text or ""), (r.doc_id is None, r.doc_id or 0)) for r in after)
    assert got == Counter(first.items())


def groups(rows, shingled=False):
    """Rows by component, links between all fingerprints tried, and between all texts that share 0.8 of their shingles."""
    n = list(range(len(rows)))
    place = list(brute([fingerprint(r.text) for r in rows], n))
    if shingled:
        sets = [shingles(r.text) for r in rows]
        for i in n:
            for j in range(i):
                if place[i] != place[j] and similar(sets[i], sets[j]):
                    old, new = place[i], place[j]
                    place = [new if x == old else x for x in place]
    out = defaultdict(list)
    for r, c in zip(rows, place, strict=True):
        out[c].append(r)
    return list(out.values())


def check_one_of_each(before, after, shingled=False):
    kept = ids(after)
    for members in groups(before, shingled):
        stay = {(r.doc_id, r.text) for r in members if kept[r.doc_id, r.text]}
        assert len(stay) == 1
        assert next(iter(stay))[0] == min((r.doc_id for r in members), key=lambda d: (d is None, d or 0))
    assert set(kept) <= set(ids(before))


def test_near(steps):
    before, after, _, _ = steps[2]
    check_one_of_each(before, after, shingled=True)
    assert len(after) < len(before)


def test_near_dedup_of_repeated_and_null_ids(odd):
    """Ids do not tell rows apart, whether what goes is broadcast or shuffled."""
    rows = odd.collect()
    for limit in (0, 1000):
        check_one_of_each(rows, simhash.deduplicated(odd, broadcast_rows=limit).collect())


def test_mix(steps):
    before, after, _, _ = steps[3]
    assert set(ids(after)) <= set(ids(before))
    _, goal = target_by_hand([(r.doc_id, r.text, r.source) for r in before])
    for s in {r.source for r in before}:
        sizes = [len(words(r.text)) for r in before if r.source == s]
        got = sum(len(words(r.text)) for r in after if r.source == s)
        assert abs(got - goal[s]) <= max(sizes)
        counts = [ids(after)[r.doc_id, r.text] for r in before if r.source == s and words(r.text)]
        assert max(counts) - min(counts) <= 1 and max(counts) <= 3


def check_packed(docs, pieces):
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = False
    want = Counter()
    for r in docs:
        t = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        at, k = 0, 0
        while at < len(t):
            to = at + ((len(t) % 2048 or 2048) if at == 0 else 2048)
            want[r.doc_id, k, at, to - at, zlib.crc32(np.array(t[at:to], "<u4").tobytes())] += 1
            at, k = to, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    held = defaultdict(list)
    for r in pieces:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert [a for a, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()]
        assert sum(n for _, n in places) <= 2048
    return len(held), sum(n for *_, n, _ in want.elements())


def test_pack(steps):
    before, after, _, _ = steps[4]
    used, tokens = check_packed(before, after)
    assert used <= -(-tokens // 2048) * 1.05 + 1


def test_run(spark, folder, steps):
    """run() gives the stages' rows; where sequences go may differ."""
    of = lambda rows: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert of(corpus_pipeline.run(spark, folder).collect()) == of(steps[-1][1])
