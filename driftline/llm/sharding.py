"""Sharding by a two-pass external shuffle.

Slots depend on the records and the seed alone, not on files or partitions.

Pass one scatters every record by seeded hashes: the doc_id alone decides the
shard (a jump consistent hash, so that one more shard takes records only into
itself), and a second hash decides the bucket, one of as many as the shard
needs for buckets that fit in memory. Pass two sorts each bucket by its
records' hashes, so that the order in which a shuffle delivers does not matter,
gives it a seeded Fisher-Yates shuffle and writes it. A record's slot is its
place in the bucket after the buckets before.

Defined cases: a null text counts as no bytes; a null doc_id is hashed as such;
rows that repeat a doc_id share its shard and spread over its buckets by their
text; rows that repeat both stay together in one bucket while they are few, and
are numbered and spread by that number beyond; an empty table gives an empty
result; added columns whose names are taken get a trailing underscore.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh, stored


def jump_hash(key: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's jump consistent hash of unsigned 64-bit keys."""
    k = key.astype(np.uint64)
    b, j = np.full(len(k), -1, np.int64), np.zeros(len(k), np.int64)
    live = np.arange(len(k))
    with np.errstate(over="ignore"):
        while len(live):
            b[live] = j[live]
            k[live] = k[live] * np.uint64(2862933555777941757) + np.uint64(1)
            j[live] = ((b[live] + 1) * (float(1 << 31) / ((k[live] >> np.uint64(33)) + np.uint64(1)).astype(float))).astype(np.int64)
            live = live[j[live] < shards]
    return b


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def run(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy().view(np.uint64), shards).astype(np.int32))

    return run(key)


def external_shuffle(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = 24, bucket_bytes: int = 8 << 20, seed: int = 42) -> DataFrame:
    """``docs`` with size, shard, slot and grown_shard (with one shard more).

    The shuffled buckets are written to the shared folder and read back. One
    row for each shard comes to the driver; the offsets of the buckets (three numbers
    each) are broadcast for up to a million buckets, else joined by a shuffle.
    """
    size, shard, slot, grown, bucket, place, order, salt, offset, part = fresh(docs.columns, "size", "shard", "slot", "grown_shard", "a_bucket", "a_place", "an_order", "a_salt", "an_offset", "a_part")
    key = F.xxhash64(F.lit(seed), F.col(doc_id))
    # the id's hash alone would put the rows that repeat an id into one bucket
    sized = (
        docs.withColumn(size, F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8)
        .withColumn(shard, shard_of(key, shards)).withColumn(grown, shard_of(key, shards + 1))
        .withColumn(order, F.xxhash64(F.lit(seed), F.col(doc_id), F.xxhash64(text)))
    )
    narrow = stored(sized.select(shard, size, order))
    loads = {r[0]: r[1] for r in narrow.groupBy(shard).agg(F.sum(size)).collect()}
    n = [max(1, -(-loads.get(s, 0) // bucket_bytes)) for s in range(shards)]
    # records that repeat until they would fill a good part of a bucket
    copies = stored(narrow.groupBy(order).agg(F.count("*").alias(salt), F.sum(size).alias(size)).filter((F.col(salt) > 1) & (F.col(size) > bucket_bytes // 8)).select(order))
    if copies.limit(1).count():
        # numbered within their input partition, after those of the partitions before
        many = stored(sized.join(F.broadcast(copies) if copies.count() <= 1_000_000 else copies, order, "left_semi").withColumn(part, F.spark_partition_id()))
        held = many.groupBy(order, part).agg(F.count("*").alias(offset))
        held = held.withColumn(offset, F.coalesce(F.sum(offset).over(Window.partitionBy(order).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        own = F.row_number().over(Window.partitionBy(order, part).orderBy(size))
        salted = many.withColumn(salt, own.cast("long")).join(held, [order, part]).withColumn(salt, F.col(salt) + F.col(offset)).drop(offset, part)
        sized = sized.join(F.broadcast(copies) if copies.count() <= 1_000_000 else copies, order, "left_anti").withColumn(salt, F.lit(0).cast("long")).unionByName(salted)
    else:
        sized = sized.withColumn(salt, F.lit(0).cast("long"))
    dealt = sized.withColumn(bucket, F.pmod(F.xxhash64(order, salt), F.element_at(F.array(*map(F.lit, n)), F.col(shard) + 1)).cast("int"))
    # tasks of a few buckets, however large the table
    dealt = dealt.select(*docs.columns, size, shard, grown, order, salt, bucket).repartition(max(1, -(-sum(loads.values()) // (8 * bucket_bytes))), shard, bucket)

    def fisher_yates(t: pa.Table) -> pa.Table:
        t = t.sort_by([(order, "ascending"), (salt, "ascending")])
        where = np.arange(t.num_rows)
        # numpy's shuffle is the Fisher-Yates shuffle
        np.random.default_rng([seed, t[shard][0].as_py(), t[bucket][0].as_py()]).shuffle(where)
        t = t.take(pa.array(where)).drop_columns([order, salt])
        return t.append_column(place, pa.array(np.arange(t.num_rows)))

    kept = [c for c in dealt.columns if c not in (order, salt)]
    schema = dealt.select(*kept, F.lit(0).cast("long").alias(place)).schema
    written = stored(dealt.groupBy(shard, bucket).applyInArrow(fisher_yates, schema))
    counts = written.groupBy(shard, bucket).agg(F.count("*").alias(offset))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(offset, F.coalesce(F.sum(offset).over(before), F.lit(0)))
    out = written.join(F.broadcast(offsets) if sum(n) <= 1_000_000 else offsets, [shard, bucket])
    return out.withColumn(slot, F.col(offset) + F.col(place)).select(*docs.columns, size, shard, slot, grown)


def write_shards(shuffled: DataFrame, path: str, *, shard: str = "shard", slot: str = "slot", size: str = "size", file_bytes: int = 256 << 20) -> None:
    """A folder of Parquet files for each shard, rows in the order of their slots.

    A task writes about ``file_bytes``, a run of slots, so a large shard has many files.
    """
    total = shuffled.agg(F.sum(size)).first()[0] or 0
    shuffled.repartitionByRange(max(1, -(-total // file_bytes)), shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
