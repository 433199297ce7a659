"""Clashing names, null keys, repeated nodes, stable slots and long spans."""

import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from driftline.llm import _common, chat, exact_dedup, lm_scoring, mixing, packing, quality_rules, sharding, shingles, simhash, token_counts, url_filters
from driftline.llm._bytes import xxh64

CLASHES = [
    "gone_id", "gone_content", "g_id", "g_fp", "g_one", "g_rows", "own_fp", "a_host", "a_content", "a_kept", "a_lines", "t_key", "t_source", "t_times",
    "_gone", "_fp", "_one", "_d", "_s", "_n", "_t", "_kept", "_host", "_best", "_hash", "n_", "bucket_", "base_", "host", "rule", "key", "row", "salt", "take", "s", "sha", "first", "rank",
]


@pytest.fixture(scope="module")
def clashing(odd):
    """The odd rows, with every name in use that an operator has of its own."""
    return odd.drop("host", "row").select("*", F.lit(0).cast("long").alias("n_chars"), *(F.lit(f"own {c}").alias(c) for c in CLASHES))


@pytest.mark.parametrize("act", [
    exact_dedup.deduplicated,
    simhash.deduplicated,
    shingles.deduplicated,
    mixing.mixed,
    lambda d: quality_rules.cleaned(d, quality_rules.quality_rules(d)),
])
def test_columns_with_names_of_our_own_come_through(act, clashing):
    out = act(clashing)
    assert out.columns == clashing.columns
    for r in out.collect():
        assert all(r[c] == f"own {c}" for c in CLASHES)


def test_urls_and_items_with_names_of_our_own_come_through(spark, clashing):
    rules = spark.createDataFrame(url_filters.RULES, "verdict string, host string, path string")
    pages = clashing.withColumn("url", F.concat(F.lit("http://a.org/es/"), "doc_id")).withColumn("short_0", F.lit("x")).withColumn("_url", F.lit("y"))
    for shapes in (0, 16):
        got = url_filters.url_filters(pages, rules, most_shapes=shapes)
        assert set(got.columns) == set(pages.columns) | {"path", "verdict"}
        assert Counter((r.rule, r.host, r["_best"], r.short_0) for r in got.collect()) == Counter((None, "", "own _best", "x") if r.url is None else ("org/", "a.org", "own _best", "x") for r in pages.collect())
    items = clashing.withColumn("length", F.lit(700).cast("long")).withColumn("offset", F.lit(1))
    got = packing.pack(items).collect()
    assert Counter(r.sequence_id for r in got).most_common(1)[0][1] == 2 and all(r.bucket_ == "own bucket_" for r in got)


@pytest.mark.parametrize("shapes", [0, 16])
def test_rules_of_one_place(spark, shapes):
    pages = spark.createDataFrame([(1, "http://x.a.b/p/q"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame([("allow", "A.b", "/p"), ("block", "a.b", "/p"), ("allow", "b", "/")], "verdict string, host string, path string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.url_filters(pages, rules, most_shapes=shapes).collect()}
    assert got == {1: ("a.b/p", "block"), 2: (None, "allow")}
    assert not url_filters.url_filters(pages.limit(0), rules, most_shapes=shapes).collect()


def test_few_shapes_shuffle_no_page(spark, sf):
    rules = spark.createDataFrame(url_filters.RULES, "verdict string, host string, path string")
    got = url_filters.url_filters(spark.read.parquet(f"{sf}/pages.parquet"), rules)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(url" not in plan


def test_null_conversations_and_odd_rows(spark, odd):
    rows = odd.select(F.when(F.col("doc_id") > 2, F.col("doc_id")).alias("conv_id"), F.col("fp").alias("turn"), F.when(F.col("fp") % 2 == 0, "assistant").alias("role"), "text")
    got = {r.conv: r for r in chat.read_back(chat.formatted(chat.chain(rows))).collect()}
    want = defaultdict(list)
    for r in sorted(rows.collect(), key=lambda r: r.turn):
        want[r.conv_id].append((r.role or "", r.text or ""))
    assert {c: [(t.role, t.text) for t in r.turns] for c, r in got.items()} == dict(want) and None in got
    assert all(r.loss_text == "".join(t for role, t in want[c] if role == "assistant") for c, r in got.items())


def test_repeated_and_null_nodes(spark):
    rows = [(0, 1, None, "user", "m1", 0.0), (0, 2, 1, "user", "m2", 1.0), (0, 3, 2, "assistant", "m3", 1.0)]
    rows += [(0, 2, 1, "user", "m2", 1.0), (0, 2, 1, "user", "a longer one", 9.0), (0, 1, None, "user", "m1", 0.0), (0, None, 1, "user", "n", 0.5)]
    rows += [(None, 1, None, "user", "x", None), (None, 2, 1, None, None, None)]
    df = spark.createDataFrame(rows, "conv long, node long, parent long, role string, text string, score double")
    got = {(r.conv, r.leaf): [t.text for t in r.turns] for r in chat.read_back(chat.formatted(df, best=5)).collect()}
    assert got == {(0, 3): ["m1", "a longer one", "m3"], (0, None): ["m1", "n"], (None, 2): ["x", ""]}


def jump(key, shards):
    """Jump consistent hash, one key at a time."""
    at, nxt = -1, 0
    while nxt < shards:
        at = nxt
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        nxt = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return at


@pytest.mark.parametrize("bytes_", [20_000, 300])
def test_slots_follow_from_the_records(odd, docs, bytes_):
    """Other partitions give the same slots; a bucket's order is the seeded shuffle; repeats spread."""
    many = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(odd.select("doc_id", "text").filter("doc_id = 1").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(60)))).drop("n"))
    rows = lambda d: Counter((r.doc_id, r.text, r.shard, r.slot, r.grown_shard) for r in sharding.external_shuffle(d, bucket_bytes=bytes_).collect())
    got = rows(many)
    assert got == rows(many.repartition(5)) and sum(got.values()) == many.count()
    keys = many.select("doc_id", "text", F.xxhash64(F.lit(42), "doc_id").alias("k"), F.xxhash64(F.lit(42), "doc_id", F.xxhash64("text")).alias("o")).distinct().collect()
    key, order = {r.doc_id: r.k for r in keys}, {(r.doc_id, r.text): r.o for r in keys}
    assert all((s, g) == (jump(key[d] % (1 << 64), 24), jump(key[d] % (1 << 64), 25)) for d, _, s, _, g in got)
    if bytes_ == 20_000:  # nothing repeats enough to be numbered: buckets follow from the hash alone
        size = Counter()
        for (d, t, s, _, _), n in got.items():
            size[s] += n * (len((t or "").encode()) + 8)
        held = defaultdict(list)
        places = many.sparkSession.createDataFrame([(o,) for o in set(order.values())], "o long").select("o", F.xxhash64("o", F.lit(0).cast("long")).alias("b")).collect()
        of = {r.o: r.b for r in places}
        for (d, t, s, _, _), n in got.items():
            held[s, of[order[d, t]] % -(-size[s] // bytes_)] += [(order[d, t], d, t)] * n
        want, at = Counter(), Counter()
        for (s, b) in sorted(held):
            inside = sorted(held[s, b], key=lambda x: x[0])
            turn = np.arange(len(inside))
            np.random.default_rng([42, s, b]).shuffle(turn)
            for k, i in enumerate(turn):
                want[(*inside[i][1:], s, at[s] + k)] += 1
            at[s] += len(inside)
        assert want == Counter({(d, t, s, p): n for (d, t, s, p, _), n in got.items()})


def test_crc_of_the_query(spark, sf):
    from driftline.llm.queries import op5_sharding

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in op5_sharding(spark, sf).collect())


def test_a_long_line_is_no_slower():
    raw = np.frombuffer(b"x" * 20_000_000, np.uint8)
    began = time.perf_counter()
    got = xxh64(raw, np.array([0, 5]), np.array([len(raw), 700]))
    assert time.perf_counter() - began < 1 and got.tolist() == [xxhash.xxh64_intdigest(b"x" * 20_000_000, 42), xxhash.xxh64_intdigest(b"x" * 695, 42)]
    for text in ("y" * 20_000_000, "ab cd " * 2_000_000):
        began = time.perf_counter()
        column = pa.array([text, "a b c d"])
        simhash.fingerprints_of(column)
        lm_scoring.tokens_of(column)
        list(quality_rules._measured(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), pa.array([0, 0]), column], ["doc_id", "host", "content", "text"])])))
        assert time.perf_counter() - began < 20


def test_sequences_hold_the_ids(docs, odd):
    for df in (docs, odd):
        cut = packing.pieces(df).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "ids")
        packed = _common.stored(packing.pack(cut))
        want = defaultdict(list)
        for r in packed.collect():
            want[r.sequence_id].append((r.offset, bytes(r.ids)))
        got = {r.sequence_id: (r.n_tokens, bytes(r.ids)) for r in packing.sequences(packed).collect()}
        assert got == {s: (sum(len(i) for _, i in v) // 4, b"".join(i for _, i in sorted(v))) for s, v in want.items()}
        assert max(n for n, _ in got.values()) <= 2048


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    class Remote:
        master = "spark://host:7077"
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: type("K", (), {"get": staticmethod(lambda *a: None)}))})  # noqa: N815

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        _common.shared_folder(Remote)


def test_only_suspects_are_joined(spark, docs):
    """With broadcasts off, what follows the exchange of bitmaps shuffles suspects alone."""
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = exact_dedup.exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    union = plan[plan.index("Union") :]
    # of the union's two sides one is a scan without a shuffle; the other filters suspects before its own
    assert union.count("SortMergeJoin") == 1 and "NOT suspect" in union


def test_token_counts_of_broken_sections(spark):
    """Overlapping or reversed sections mark their document, null bounds are left out, and the others count as ever."""
    rows = [(1, "one two three", [(0, 5), (3, 8)]), (2, "one two three", [(8, 2)]), (3, "one two three", [(0, 3), None, (None, 9), (3, 13)]), (4, "one two three", None), (5, None, [(0, 0)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s array<struct<start:long,stop:long>>")
    got = token_counts.token_counts(docs, sections="s", broken="mark").collect()
    total = {r.doc_id: r.n_doc_tokens for r in got}
    assert {d: sum(r.n_tokens for r in got if r.doc_id == d) for d in total} == total
    assert {(r.doc_id, r.section) for r in got} == {(1, -2), (2, -2), (3, 0), (3, 1), (4, -1), (5, 0)}
    assert [(r.start, r.stop) for r in got if r.section == -2] == [(0, 13)] * 2
    with pytest.raises(ValueError):
        token_counts.token_counts(docs, sections="s", broken="drop")


def test_each_document_s_taken_words_by_hand(docs, odd):
    """The slots of van der Corput's points, written as fractions, name each source's blocks; each word of a block counts once."""
    block = 64
    for df in (docs, odd):
        documents, mix = mixing.schedule(df, block=block, rows_per_bucket=7)
        got = mixing.taken(df, block=block, rows_per_bucket=7).collect()
        slots = {(r.slot, r.source): r.n for r in mix.groupBy("slot", "source").agg(F.sum("length").alias("n")).collect()}
        rows = defaultdict(list)
        for r in got:
            rows[r.source].append(r)
        names = sorted(rows, key=lambda s: (s is None, s or ""))
        take = [int(rows[s][0].target) for s in names]
        need = [-(-t // block) for t in take]
        edge = [Fraction(sum(need[:k]), max(1, sum(need))) for k in range(len(need) + 1)]
        words, nth = defaultdict(Counter), Counter()
        flat = {s: [at for at, r in enumerate(sorted(rows[s], key=lambda r: (r.key, r.doc_id is not None, r.doc_id or 0))) for _ in range(r["size"])] for s in names}
        want = {}
        bits = max(1, sum(need) - 1).bit_length()
        for slot in range(1 << bits):
            v = Fraction(int(format(slot, f"0{bits}b")[::-1], 2), 1 << bits)
            k = max(i for i, e in enumerate(edge[:-1]) if e <= v and edge[i + 1] > e)
            r = nth[k]
            nth[k] += 1
            if r < need[k]:
                part = [flat[names[k]][at % len(flat[names[k]])] for at in range(r * block, min((r + 1) * block, take[k]))]
                words[names[k]].update(part)
                want[slot, names[k]] = len(part)
        assert slots == want
        for s in names:
            order = sorted(rows[s], key=lambda r: (r.key, r.doc_id is not None, r.doc_id or 0))
            # rows that repeat a document trade places
            assert Counter((r.key, r.taken) for r in order) == Counter((r.key, words[s][at]) for at, r in enumerate(order))
