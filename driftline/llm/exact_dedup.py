"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every sender (a run of rows of one input partition) sorts the short
   fingerprints of its normalised texts, cuts them by owner (the leading
   bits), and codes each cut's gaps in Golomb-Rice form. Only these codes are shuffled.
2. The owner decodes what all senders sent, finds the fingerprints that occur
   more than once, and answers each sender with a bitmap.
3. Rows that a bitmap marks are suspects; the others stand as they are. Only texts
   with a suspect fingerprint are shuffled, grouped by their bytes, so that the
   comparison is exact, and only suspects are joined with what comes of it.

The bitmaps go back to the senders' rows before these are taken apart: broadcast
while all have at most ``broadcast_bytes``, else by a join on (sender, owner), one row
for each pair.

A sender sends a fingerprint once however often it has it, and the grouping by
bytes is combined before its shuffle, so a text that a third of all rows share
costs no task more than a row from each.

Defined cases: a null text counts as empty; rows that repeat a doc_id are rows
of their own, and of equal texts with the same smallest doc_id one row is kept;
a null doc_id is larger than any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, fresh, stored


def normalised(text: Column | str) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.coalesce(F.regexp_replace(text, SPACE, " "), F.lit(""))


def golomb(values: np.ndarray, rice: int) -> bytes:
    """Golomb-Rice code of a sorted array of distinct uint64: the gaps' quotients in unary, then their ``rice``-bit rests."""
    gaps = np.diff(values, prepend=np.uint64(0))
    ends = np.cumsum((gaps >> np.uint64(rice)).astype(np.int64) + 1)
    n = int(ends[-1]) if len(ends) else 0
    bits = np.ones(n + rice * len(gaps), np.uint8)
    # each quotient in ones and a zero; after all of them each rest from its highest bit
    bits[ends - 1] = 0
    rests = bits[n:].reshape(len(gaps), rice)
    for k in range(rice):
        rests[:, k] = (gaps >> np.uint64(rice - 1 - k)).astype(np.uint8) & 1
    return np.packbits(bits).tobytes()


def ungolomb(code: bytes, n: int, rice: int) -> np.ndarray:
    """The ``n`` values that :func:`golomb` coded."""
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(rice)
    at = int(ends[-1]) + 1 if n else 0
    rests = bits[at : at + rice * n].reshape(n, rice)
    for k in range(rice):
        gaps |= rests[:, k].astype(np.uint64) << np.uint64(rice - 1 - k)
    return np.cumsum(gaps, dtype=np.uint64)


def _senders(owner_bits: int, fp_bits: int, rows: int):  # noqa: ANN202
    """Per sender and owner: the code of its distinct fingerprints, and the rows in their order."""

    def send(parts: list[pa.RecordBatch], sender: int) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        fp = t["fp"].to_numpy().view(np.uint64) >> np.uint64(64 - fp_bits)
        order = np.argsort(fp, kind="stable")
        fp = fp[order]
        t = t.take(pa.array(order)).combine_chunks()
        owner = (fp >> np.uint64(fp_bits - owner_bits)).astype(np.int64) if owner_bits else np.zeros(len(fp), np.int64)
        cuts = np.r_[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), len(owner)]
        low = np.uint64((1 << (fp_bits - owner_bits)) - 1)
        out: dict[str, list] = {k: [] for k in ("owner", "n", "rice", "code", "twice")}
        rank = np.empty(len(fp), np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            u, inverse, count = np.unique(fp[a:b] & low, return_inverse=True, return_counts=True)
            rank[a:b] = inverse
            rice = max(0, int(np.log2(max(1.0, (int(low) + 1) / len(u)) * 0.69)))
            for k, v in zip(out, (int(owner[a]), len(u), rice, golomb(u, rice), np.packbits(count > 1).tobytes()), strict=True):
                out[k].append(v)
        off = pa.array(cuts.astype(np.int32))
        members = pa.ListArray.from_arrays(off, pa.StructArray.from_arrays([t["doc_id"].combine_chunks(), t["fp"].combine_chunks(), t["sha"].combine_chunks(), pa.array(rank)], ["doc_id", "fp", "sha", "rank"]))
        size = len(cuts) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, sender)), pa.array(out["owner"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["rice"], pa.int32()), pa.array(out["code"], pa.binary()), pa.array(out["twice"], pa.binary()), members],
            ["sender", "owner", "n", "rice", "code", "twice", "members"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, held, parts = TaskContext.get().partitionId() << 24, 0, []
        for b in batches:
            if b.num_rows:
                parts.append(b)
                held += b.num_rows
            if held >= rows:
                yield from send(parts, sender)
                sender, held, parts = sender + 1, 0, []
        if parts:
            yield from send(parts, sender)

    return run


def _answer(pdf):  # noqa: ANN001, ANN202
    """For the codes that one owner got: per sender a bitmap of the fingerprints that occur twice in all."""
    decoded = [ungolomb(c, n, r) for c, n, r in zip(pdf["code"], pdf["n"], pdf["rice"], strict=True)]
    own = [np.unpackbits(np.frombuffer(t, np.uint8))[:n].astype(bool) for t, n in zip(pdf["twice"], pdf["n"], strict=True)]
    seen, which, count = np.unique(np.concatenate(decoded), return_inverse=True, return_counts=True)
    twice = count > 1
    twice[which[np.concatenate(own)]] = True
    ends = np.cumsum(pdf["n"].to_numpy())
    marks = np.split(twice[which], ends[:-1])
    return pdf[["sender", "owner"]].assign(bitmap=[np.packbits(m).tobytes() for m in marks])


def exact_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fp_bits: int = 52, rows_per_owner: int = 500_000, rows_per_sender: int = 200_000, broadcast_rows: int = 2_000_000, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, fp and row (a row's own number) of every row of ``docs``.

    The table of suspect fingerprints (one long for each class of copies) is
    broadcast if it has at most ``broadcast_rows`` rows; beyond, Spark
    shuffles the join.
    """
    spark = docs.sparkSession
    key = dict(docs.dtypes)[doc_id]
    flat = docs.select(F.col(doc_id).alias("doc_id"), normalised(text).alias("flat"))
    flat = flat.select("doc_id", F.xxhash64("flat").alias("fp"), "flat")
    owner_bits = max(0, min(20, (docs.count() // rows_per_owner).bit_length()))
    sent = stored(
        flat.select("doc_id", "fp", F.unhex(F.sha2("flat", 256)).alias("sha")).mapInArrow(
            _senders(owner_bits, fp_bits, rows_per_sender),
            f"sender long, owner long, n long, rice int, code binary, twice binary, members array<struct<doc_id:{key},fp:long,sha:binary,rank:long>>",
        )
    )
    bitmaps = stored(sent.select("sender", "owner", "n", "rice", "code", "twice").groupBy("owner").applyInPandas(_answer, "sender long, owner long, bitmap binary"))
    weight = bitmaps.agg(F.sum(F.octet_length("bitmap") + 16)).first()[0] or 0
    # bit r of a bitmap, from its highest
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("rank") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = stored(
        sent.select("sender", "owner", "members").join(F.broadcast(bitmaps) if weight <= broadcast_bytes else bitmaps, ["sender", "owner"])
        .select("sender", "owner", "bitmap", F.posexplode("members").alias("pos", "m")).select("sender", "owner", "bitmap", "pos", "m.*")
        .select("doc_id", "fp", "sha", F.struct("sender", "owner", "pos").alias("row"), (F.getbit(byte, (F.lit(7) - F.col("rank") % 8).cast("int")) == 1).alias("suspect"))
    )
    suspects = rows.filter("suspect")
    fps = stored(suspects.select("fp").distinct())
    side = F.broadcast(fps) if fps.count() <= broadcast_rows else fps
    # bytes decide: one group for each text, combined before the shuffle
    same = flat.join(side, "fp", "left_semi").groupBy("flat").agg(F.count("*").alias("group_size")).filter("group_size > 1").select(F.unhex(F.sha2("flat", 256)).alias("sha"), "group_size")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("first")
    # written first, so that the last join stands alone in its stage and Spark can split a hot class's rows
    heads = stored(suspects.groupBy("sha").agg(first).join(same, "sha"))
    digest = F.lower(F.hex("sha")).alias("text_sha256")
    alone = rows.filter("NOT suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), digest, "fp", "row")
    return alone.union(
        suspects.join(heads, "sha", "left").select(
            "doc_id",
            F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("first").isNull() | (F.col("first.row") == F.col("row"))).alias("kept"),
            digest,
            "fp",
            "row",
        )
    )


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000, **how: int) -> DataFrame:
    """``docs`` without the rows that :func:`exact_duplicates` drops.

    What goes is a list of (doc_id, hash, whether a copy stays), broadcast if it has
    at most ``broadcast_rows`` rows (about 24 bytes each), else shuffled.
    """
    found = exact_duplicates(docs, doc_id=doc_id, text=text, **how)
    g_id, g_fp, g_one, g_rows, own_fp = fresh(docs.columns, "g_id", "g_fp", "g_one", "g_rows", "own_fp")
    gone = found.filter("group_size > 1").groupBy(F.col("doc_id").alias(g_id), F.col("fp").alias(g_fp)).agg(F.max("kept").alias(g_one), F.count("*").alias(g_rows))
    gone = stored(gone.filter(~F.col(g_one) | (F.col(g_rows) > 1)))
    side = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    marked = docs.withColumn(own_fp, F.xxhash64(normalised(text)))
    left = marked.join(side, F.col(doc_id).eqNullSafe(F.col(g_id)) & (F.col(own_fp) == F.col(g_fp)), "left")
    plain = left.filter(F.col(g_one).isNull()).select(*docs.columns)
    if not gone.filter(F.col(g_one)).limit(1).count():
        return plain
    # rows that repeat doc_id and text: one of them stays
    return plain.union(left.filter(F.col(g_one)).dropDuplicates([doc_id, own_fp]).select(*docs.columns))
