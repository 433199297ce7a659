"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, components.

A fingerprint is cut into ``n_blocks`` blocks. Two fingerprints that differ in
at most ``distance`` bits agree in at least ``n_blocks - distance`` of them, so
each choice of that many blocks is one join key and every close pair shares
one. Rows that share a key are compared by bits inside their task and joined
into a forest there; a key leaves at most its members less one edges, never all
pairs. A key with more than ``most`` distinct fingerprints is cut again on its
other bits (the same pigeonhole argument), until a piece is small or so few
bits are free that it cannot be large. No candidate is dropped.

Texts with one fingerprint are one class; only classes are compared.

Defined cases: a null text counts as empty; a text without words has the
fingerprint zero, which links like any other; repeated rows are all returned;
an empty table gives an empty result. A null doc_id is returned and never names a component,
unless no member has another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import joined, xxh64
from ._common import blocks, fresh, stored, text_batches
from .components import components

SHINGLES = 1 << 17  #: whose bits are unpacked at once


def fingerprints_of(column: pa.Array, width: int = 3) -> np.ndarray:
    """The 64-bit SimHash of each text of a string column."""
    flat, starts, stops, first = joined(column)
    n_words = np.diff(first)
    # a text of one word or two is one shingle
    n_shingles = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    at = np.r_[0, np.cumsum(n_shingles)]
    w0 = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], n_shingles)
    w1 = w0 + np.repeat(np.minimum(n_words, width), n_shingles) - 1
    h = xxh64(flat, starts[w0], stops[w1])
    out = np.zeros(len(n_words), np.uint64)
    some = np.flatnonzero(n_shingles)
    if len(some):
        # bits are unpacked for a bounded number of shingles at once, and summed by text
        ones, of = np.zeros((len(some), 64), np.int64), np.repeat(np.arange(len(some)), n_shingles[some])
        for a in range(0, len(h), SHINGLES):
            bits = np.unpackbits(h[a : a + SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            here = of[a : a + SHINGLES]
            begin = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
            ones[here[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
        packed = np.packbits(ones * 2 > n_shingles[some, None], axis=1, bitorder="little")
        out[some] = packed.copy().view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id, content (a hash of the text) and fp (the fingerprint's 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fingerprints_of(b.column(2), width).view(np.int64))], ["doc_id", "content", "fp"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    return text_batches(given).mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, content long, fp long")


def _masks(free: int, n_blocks: int, distance: int) -> list[int]:
    """For each choice of blocks of the bits in ``free``: the mask of its bits."""
    bits = [i for i in range(64) if free >> i & 1]
    cut = [sum(1 << i for i in x.tolist()) for x in np.array_split(np.array(bits), n_blocks)]
    return [sum(c) for c in combinations(cut, n_blocks - distance)]


def _forest(fp: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the ``fp`` that differ in at most ``distance`` bits.

    A search that compares each member once with those not reached yet.
    """
    rest, reached = fp, []
    while len(rest) or reached:
        if not reached:
            reached, rest = [rest[:1]], rest[1:]
        at = reached.pop()
        for x in at:
            if not len(rest):
                break
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                got = rest[near]
                yield np.full(len(got), x), got
                reached.append(got)
                rest = rest[~near]


def close_pairs(classes: DataFrame, *, distance: int = 3, n_blocks: int = 6, most: int = 4096, levels: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``: per join key a spanning forest of its close pairs.

    A task streams its keys in sorted order and holds ``most`` members of one
    key at once. A key with more sends its members on to the next level, where
    more bits make the key; after ``levels`` levels at most 2^14 members can
    share a key (with 64 bits and the default blocks).
    """
    full = (1 << 64) - 1

    def signed(m: int) -> int:
        return m - (1 << 64) if m >> 63 else m

    def matcher(bound: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mask = bits = np.zeros(0, np.int64)
            fp = np.zeros(0, np.uint64)
            large = None  # the key whose members go on to the next level

            def close(last: bool) -> pa.RecordBatch:
                nonlocal mask, bits, fp, large
                new = np.r_[True, (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])] if len(fp) else np.zeros(0, bool)
                at = np.r_[np.flatnonzero(new), len(fp)]
                a, b, on = [], [], []
                done = len(fp)
                for i in np.flatnonzero(np.diff(at) > 1) if large is None else range(len(at) - 1):
                    x, y = at[i], at[i + 1]
                    key = (int(mask[x]), int(bits[x]))
                    ends = last or y < len(fp)
                    if key == large or y - x > bound:
                        a.append(fp[x:y])
                        b.append(np.full(y - x, mask[x]).view(np.uint64))
                        on.append(np.ones(y - x, bool))
                        large = None if ends else key
                    elif not ends:
                        done = x
                    elif y - x == 2:
                        if (int(fp[x]) ^ int(fp[x + 1])).bit_count() <= distance:
                            a.append(fp[x : x + 1])
                            b.append(fp[x + 1 : y])
                            on.append(np.zeros(1, bool))
                    else:
                        for p, q in _forest(fp[x:y], distance):
                            a.append(p)
                            b.append(q)
                            on.append(np.zeros(len(p), bool))
                if not last and len(at) > 1 and at[-1] - at[-2] == 1 and large is None:
                    done = min(done, int(at[-2]))  # a key of one row so far may go on
                mask, bits, fp = mask[done:], bits[done:], fp[done:]
                none = np.zeros(0, np.uint64)
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a]).view(np.int64)), pa.array(np.concatenate([none, *b]).view(np.int64)), pa.array(np.concatenate([np.zeros(0, bool), *on]))], ["a", "b", "more"])

            for x in batches:
                mask = np.r_[mask, x.column(0).to_numpy()]
                bits = np.r_[bits, x.column(1).to_numpy()]
                fp = np.r_[fp, x.column(2).to_numpy().view(np.uint64)]
                yield close(False)
            yield close(True)

        return run

    spark = classes.sparkSession
    table, base, rest, edges = [(0, i, m) for i, m in enumerate(_masks(full, n_blocks, distance))], 0, classes.select("fp", F.lit(0).alias("mask")), []
    for level in range(levels):
        deep = level == levels - 1
        step = {k: [(j, m) for i, j, m in table if i == k] for k in {i for i, _, _ in table}}
        if len(step) == 1:
            of = [F.struct(F.lit(j).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("bits")) for j, m in next(iter(step.values()))]
            keyed = rest.select("fp", F.inline(F.array(*of)))
        else:
            masks = spark.createDataFrame([(i, j, signed(m)) for i, j, m in table], "mask int, finer int, m long")
            keyed = rest.join(F.broadcast(masks), "mask").select("fp", F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("m")).alias("bits"))
        keyed = keyed.select(F.col("mask").cast("long"), "bits", "fp").repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp")
        found = stored(keyed.mapInArrow(matcher(1 << 62 if deep else most), "a long, b long, more boolean"))
        edges.append(found.filter("NOT more").select("a", "b"))
        if deep or not found.filter("more").limit(1).count():
            break
        # cut the large keys again: close pairs agree in one more block of the free bits
        rest = found.filter("more").select(F.col("a").alias("fp"), F.col("b").cast("int").alias("mask"))
        base += len(table)
        cut = [(j, m | x) for _, j, m in table for x in _masks(full & ~m, distance + 1, distance)]
        table = [(j, base + n, m) for n, (j, m) in enumerate(cut)]
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out.distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 3, n_blocks: int = 6, most: int = 4096) -> DataFrame:
    """doc_id, content, fp, component (a fingerprint) and component_id (the smallest doc_id that links reach) of every row."""
    marked = stored(fingerprints(docs, doc_id=doc_id, text=text, width=width))
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = components(close_pairs(classes.select("fp"), distance=distance, n_blocks=n_blocks, most=most))
    # the least doc_id of each class, over the classes of its component
    linked = classes.join(links, classes.fp == links.node).select("fp", "component", "least")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    by_component = linked.join(least, "component").select("fp", "component", "component_id")
    # written first, so that the last join stands alone in its stage and Spark can split a hot fingerprint's rows
    named = stored(classes.join(by_component, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "least").alias("component_id")))
    return marked.join(named, "fp", "left").select("doc_id", "content", "fp", "component", "component_id")


def fingerprint_links(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """a, b: hashes of different texts that close fingerprints join; each is linked with the smallest hash of its component."""
    near = stored(near_duplicates(docs, doc_id=doc_id, text=text, **how).select("content", "component"))
    first = stored(near.groupBy("component").agg(F.min("content").alias("a"), F.max("content").alias("z")).filter("a <> z").select("component", "a"))
    return stored(near.join(first, "component").filter("content <> a").select("a", F.col("content").alias("b"))).distinct()


def hexadecimal(fp) -> T.StringType:
    """The 16 lower-case hexadecimal digits of a fingerprint column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000, **how: int) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id.

    A null doc_id is larger than any other, and of rows with that doc_id and
    different texts the one with the smallest hash stays. Rows that repeat
    both doc_id and text are one document: all stay or all go. What goes is a
    list of doc_ids and hashes, broadcast if it has at most ``broadcast_rows``
    rows (16 bytes each), else shuffled. Other columns may have any names.
    """
    gone_id, gone_content = fresh(docs.columns, "gone_id", "gone_content")
    near = stored(near_duplicates(docs, doc_id=doc_id, text=text, **how).select("doc_id", "content", "component"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")
    # written first, so that the join stands alone in its stage and Spark can split a hot component's rows
    heads = stored(near.groupBy("component").agg(F.min(own).alias("first"), F.max(own).alias("last")).filter("first <> last").select("component", "first"))
    gone = stored(near.join(heads, "component").filter(own != F.col("first")).select(F.col("doc_id").alias(gone_id), F.col("content").alias(gone_content)).distinct())
    side = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    return docs.join(side, docs[doc_id].eqNullSafe(F.col(gone_id)) & (F.xxhash64(docs[text]) == F.col(gone_content)), "left_anti").select(*docs.columns)
