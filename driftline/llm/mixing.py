"""Mixing sources to target weights by a low-discrepancy schedule.

The schedule is a row of slots. Slot i has the base-2 van der Corput point
v(i), which is mapped through the sources' cumulative shares of blocks to a
source. Its rank among the source's slots has a closed form (how many of the
first i points lie in an interval), so that no slot waits for another. Each
source's documents stand in a seeded random order, cut into blocks of equally many words;
slot number r of a source takes its block r, from the first one again after
the last. A source's slots end with its target.

Defined cases: a null text has size 0 and is never taken; a null source is a
source of its own, the last; a source without words has target 0; repeated rows
are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh, stored, words

BITS = 62
WEIGHTS = (5, 2, 1)


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of all sizes by weight; what is above ``most`` times a size is shared again by weight."""
    out, left, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * unit > most * sizes[i]}
        for i in over or free:
            out[i] = most * sizes[i] if over else weights[i] * unit
        if not over:
            break
        left -= sum(out[i] for i in over)
        free -= over
    return out


def points(i: np.ndarray) -> np.ndarray:
    """The first ``BITS`` bits of van der Corput's point of each index, as integers."""
    out, i = np.zeros(len(i), np.int64), i.astype(np.int64)
    for k in range(BITS):
        out |= ((i >> k) & 1) << (BITS - 1 - k)
    return out


def below(i: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many of the points 0 .. i-1 lie below ``limit``.

    i splits by its bits into aligned runs of 2^k points; such a run holds one
    point in each cell of width 2^-k, all at the same place in their cells.
    """
    out, start = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    i, limit = i.astype(np.int64), limit.astype(np.int64)
    for k in range(int(i.max(initial=0)).bit_length() - 1, -1, -1):
        on = np.flatnonzero((i >> k) & 1)
        if len(on):
            wide = BITS - k
            place = points(start[on])
            out[on] += np.clip((limit[on] - place + (1 << wide) - 1) >> wide, 0, 1 << k)
            start[on] |= 1 << k
    return out


def record_key(doc_id: Column, text: Column, seed: int) -> Column:
    """What tells rows apart and orders them: a seeded hash of id and text."""
    return F.xxhash64(F.lit(seed), doc_id, F.xxhash64(text))


def schedule(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = 3.0, block: int = 256, rows_per_bucket: int = 2000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(documents, mix).

    documents: row, doc_id, source, size, source_size, target, key (a hash of doc_id and text). mix: slot,
    source, row, doc_id, start, length: which words of which document a slot
    takes, a row for each part of a block. ``weights`` go round the sources in
    code point order, a null last. One row for each source is on the driver:
    sources are named in a recipe, so they are few.
    """
    spark = docs.sparkSession
    # rows in random order within their source; equal rows can trade places
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"), record_key(F.col(doc_id), F.col(text), seed).alias("key")))
    stats = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    stats.sort(key=lambda r: (r.source is None, [ord(c) for c in str(r.source or "")]))
    sizes = [int(r["size"]) for r in stats]
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(stats))], most)
    take = [int(g) for g in goal]
    need = [ceil(t / block) for t in take]
    total = max(1, sum(need))
    n_slots = 1 << (total - 1).bit_length()
    edge = np.array([(sum(need[:k]) << BITS) // total for k in range(len(need) + 1)] or [0], np.int64)
    needed = np.array(need or [0], np.int64)
    buckets = [max(1, int(r.n) // rows_per_bucket) for r in stats]
    names = spark.createDataFrame(
        [(r.source, k, sizes[k], goal[k], take[k], buckets[k]) for k, r in enumerate(stats)],
        f"source {dict(docs.dtypes)[source]}, s int, source_size long, target double, take long, buckets int",
    )

    # where each document begins in its source's order: a sum within its bucket, after those of the buckets before
    known = rows.join(F.broadcast(names), rows["source"].eqNullSafe(names["source"])).select("doc_id", rows["source"], "size", "key", "s", "source_size", "target", "take", F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * F.col("buckets")).cast("int").alias("bucket"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = known.groupBy("s", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n")).select("s", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("nth"))
    inside = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "size")
    placed = known.join(base, ["s", "bucket"]).select(
        "doc_id", "source", "size", "s", "source_size", "target", "take", "key",
        (F.col("base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("begin"),
        (F.col("nth") + F.row_number().over(inside) - 1).alias("nth"),
    )
    documents = stored(placed.withColumn("row", F.struct("s", "nth")))

    def slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            i = f["id"].to_numpy()
            s = np.searchsorted(edge, points(i), side="right") - 1
            r = below(i, edge[s + 1]) - below(i, edge[s])
            go = r < needed[s]
            yield pd.DataFrame({"slot": i[go], "s": s[go].astype(np.int32), "nth_slot": r[go]})

    tasks = max(1, min(200_000, n_slots // 200_000))
    chosen = spark.range(0, n_slots, 1, tasks).mapInPandas(slots, "slot long, s int, nth_slot long").join(F.broadcast(names.select("s", "source_size", "take")), "s")
    # the words of a slot in its source's endless row; at the end of a round it goes on from the start
    pieces = (
        chosen.selectExpr("slot", "s", "source_size", f"nth_slot * {block} AS lo", f"least((nth_slot + 1) * {block}, take) AS hi")
        .selectExpr("slot", "s", "source_size", "lo", "hi", "explode(sequence(lo div source_size, (hi - 1) div source_size)) AS round")
        .selectExpr("slot", "s", "greatest(lo - round * source_size, 0) AS from", "least(hi - round * source_size, source_size) AS to")
        .selectExpr("slot", "s", "from", "to", f"explode(sequence(from div {block}, (to - 1) div {block})) AS block")
    )
    parts = documents.filter("size > 0").selectExpr("row", "doc_id", "source", "s", "begin", "size", f"explode(sequence(begin div {block}, (begin + size - 1) div {block})) AS block")
    start, stop = F.greatest("begin", "from", F.col("block") * block), F.least(F.col("begin") + F.col("size"), "to", (F.col("block") + 1) * block)
    mix = parts.join(pieces, ["s", "block"]).select("slot", "source", "row", "doc_id", (start - F.col("begin")).alias("start"), (stop - start).alias("length")).filter("length > 0")
    return documents, mix


def taken(docs: DataFrame, **how: int) -> DataFrame:
    """Every document with how many of its words the mix takes, repeats counted."""
    documents, mix = schedule(docs, **how)
    got = mix.groupBy("row").agg(F.sum("length").alias("taken"))
    return documents.join(got, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "key")


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42, broadcast_rows: int = 1_000_000, **how: int) -> DataFrame:
    """The documents that the mix takes, each as often as it takes most of its words.

    A document comes round(taken / size) times; one that is taken at all comes
    once at least: documents are this function's unit, and the schedule's blocks that of
    :func:`schedule`. Rows that repeat a doc_id, source and text share the most
    of their counts. Other columns may have any names. The counts (16 bytes and a
    source each) are broadcast up to ``broadcast_rows``.
    """
    t_key, t_source, t_times = fresh(docs.columns, "t_key", "t_source", "t_times")
    got = taken(docs, doc_id=doc_id, text=text, source=source, seed=seed, **how)
    times = stored(got.filter("taken > 0").groupBy(F.col("key").alias(t_key), F.col("source").alias(t_source)).agg(F.max(F.greatest(F.lit(1), F.round(F.col("taken") / F.col("size")))).cast("int").alias(t_times)))
    side = F.broadcast(times) if times.count() <= broadcast_rows else times
    left = docs.join(side, (record_key(docs[doc_id], docs[text], seed) == F.col(t_key)) & docs[source].eqNullSafe(F.col(t_source)))
    return left.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(t_times))).alias(t_times)).drop(t_times)
