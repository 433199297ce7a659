"""Near duplicates by word shingles: candidates from MinHash bands, checked by exact similarity.

A text is the set of its ``width``-word shingles (ASCII lower case, white space
collapsed); a text with fewer words is one shingle. Two texts are similar if
the shared shingles are at least ``least`` of all that either has. ``n_bands``
bands of ``n_rows`` minima are the join keys: a pair at 0.8 shares none of the
default 24 bands of 5 with a probability of 0.0001, and at 0.9 of 10^-9.

:func:`similar_links` gives links that join similar texts into components, not all pairs. The members of a key are
compared with one of them, drawn by a hash of text and key, which links most; so a group of n copies costs n comparisons for a key,
and a pair that is similar to each other but not to the drawn one is drawn itself under other keys. Where members of a key
are still in different components, one of each is compared with one of each other. A key with more than ``most`` of these is cut
into keys that share another band too; what then goes unseen is pairs that share no second band (0.0007 at a similarity of 0.8).

Components are what :func:`deduplicated` reduces to one text: in a chain of texts each similar to the next, one stays.

Defined cases: a text without words (or null) is similar to none but its equals; of equal texts
one stays, rows that repeat doc_id and text are one document; a null doc_id is larger than any other, and on one doc_id
the smaller hash of the text comes first. Equality of shingles and of texts is
equality of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import joined, mixed, xxh64
from ._common import blocks, fresh, stored, text_batches
from .components import components


def shingles_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's shingles, and where each text's begin (n + 1)."""
    flat, starts, stops, first = joined(column)
    n_words = np.diff(first)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    at = np.r_[0, np.cumsum(n)]
    w0 = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], n)
    w1 = w0 + np.repeat(np.minimum(n_words, width), n) - 1
    return xxh64(flat, starts[w0], stops[w1]), at


def band_keys(column: pa.Array, width: int, n_bands: int, n_rows: int) -> pa.ListArray:
    """A key for each band of each text; a text without words has none."""
    h, at = shingles_of(column, width)
    some = np.flatnonzero(np.diff(at))
    odd = mixed(np.arange(1, n_bands * n_rows + 1, dtype=np.uint64)) | np.uint64(1)
    keys = np.zeros((len(some), n_bands), np.uint64)
    if len(some):
        with np.errstate(over="ignore"):
            for i, m in enumerate(odd):
                least = np.minimum.reduceat(h * m, at[some])
                keys[:, i // n_rows] = mixed(keys[:, i // n_rows] + mixed(least) + np.uint64(i + 1))
    ends = np.zeros(len(at), np.int32)
    ends[some + 1] = n_bands
    return pa.ListArray.from_arrays(np.cumsum(ends).astype(np.int32), pa.array(keys.ravel().view(np.int64)))


def similar_links(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, n_bands: int = 24, n_rows: int = 5, most: int = 512, broadcast_rows: int = 1_000_000) -> DataFrame:
    """a, b: hashes of different texts that are similar. Texts that links reach from one another are those that similarity reaches."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), band_keys(b.column(1), width, n_bands, n_rows)], ["content", "keys"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            h, at = shingles_of(b.column(1), width)
            sets = [np.unique(h[i:j]).view(np.int64) for i, j in zip(at[:-1], at[1:], strict=True)]
            ends = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))], ["content", "shingles"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between the members of each key, rows ordered by key; at most ``most`` of a key but for what no band cuts.

        A member that is linked to one of a cluster is not compared with the others of it.
        """
        key, members = None, []
        for b in batches:
            keys, contents, found = b.column(0).to_numpy(), b.column(1).to_numpy(), []
            values, ends = b.column(2).values.to_numpy(), b.column(2).offsets.to_numpy()
            for k, c, i, j in zip(keys, contents, ends[:-1], ends[1:], strict=True):
                if k != key:
                    key, members = k, []
                s, own = values[i:j], []
                # members: clusters of (content, shingles), the latest first
                for group in members:
                    for other, x in group:
                        if min(len(x), len(s)) < least * max(len(x), len(s)) - 1e-9:
                            continue
                        both = len(np.intersect1d(x, s, assume_unique=True))
                        if both >= least * (len(x) + len(s) - both) - 1e-9:
                            found.append((other, c))
                            own.append(group)
                            break
                merged = [(c, s.copy()), *(m for g in own for m in g)]
                members = [merged, *(g for g in members if not any(g is o for o in own))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

    given = docs.select(F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    marked = stored(text_batches(given).mapInArrow(banded, "content long, keys array<long>").groupBy("content").agg(F.first("keys").alias("keys")))
    places = marked.select("content", F.explode("keys").alias("key"))
    shared = stored(places.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    # each step is written first, so that the join after it stands alone in its stage and Spark can split a hot key's rows
    crowd = stored(places.join(shared, "key"))
    heads = stored(crowd.groupBy("key").agg(F.min_by("content", F.xxhash64("content", "key")).alias("head")))
    pairs = stored(crowd.join(heads, "key").filter("content <> head").select("head", "content").distinct())
    named = stored(crowd.select("content").distinct())
    side = F.broadcast(named) if named.count() <= broadcast_rows else named
    few = stored(given.join(side, "content", "left_semi").dropDuplicates(["content"]))
    sets = stored(text_batches(few).mapInArrow(gathered, "content long, shingles array<long>"))
    theirs = sets.select(F.col("content").alias("head"), F.col("shingles").alias("theirs"))
    with_own = stored(pairs.join(sets, "content"))
    both = F.size(F.array_intersect("shingles", "theirs"))
    near = with_own.join(theirs, "head").filter(both >= least * (F.size("shingles") + F.size("theirs") - both) - 1e-9)
    links = stored(near.select(F.col("head").alias("a"), F.col("content").alias("b")))
    # one member of each component of each key that still has several
    joined = components(links)
    parts = stored(crowd.join(joined, F.col("content") == F.col("node"), "left").select("key", "content", F.coalesce("component", "content").alias("component")))
    rest = stored(parts.groupBy("key", "component").agg(F.min_by("content", F.xxhash64("content", "key")).alias("content")).select("key", "content"))
    for level in range(3):
        sizes = stored(rest.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
        large = sizes.filter(F.col("n") > most).select("key")
        small = sizes if level == 2 else sizes.filter(F.col("n") <= most)
        held = stored(rest.join(small.select("key"), "key")).join(sets, "content").repartition("key").sortWithinPartitions("key", "content")
        links = links.union(stored(text_batches(held.select("key", "content", "shingles")).mapInArrow(scanned, "a long, b long").distinct()))
        if level == 2 or not large.limit(1).count():
            break
        again = stored(rest.join(large, "key")).join(marked, "content")
        rest = stored(again.select(F.col("key").alias("was"), "content", F.explode("keys").alias("other")).filter("was <> other").select(F.xxhash64("was", "other").alias("key"), "content"))
    return links.distinct()


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", links: DataFrame | None = None, broadcast_rows: int = 1_000_000, **how: float) -> DataFrame:
    """``docs`` with one text of each component: the one with the smallest doc_id.

    ``links`` (a, b) join texts by other evidence too; nodes are xxhash64 of the text. What goes is a list of
    doc_ids and hashes, broadcast if it has at most ``broadcast_rows`` rows, else shuffled.
    """
    gone_id, gone_content = fresh(docs.columns, "gone_id", "gone_content")
    found = similar_links(docs, doc_id=doc_id, text=text, broadcast_rows=broadcast_rows, **how)
    joined = components(found if links is None else found.union(links.select("a", "b")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("content"))
    near = stored(rows.join(joined, F.col("content") == F.col("node"), "left").select("doc_id", "content", F.coalesce("component", "content").alias("component")))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")
    firsts = stored(near.groupBy("component").agg(F.min(own).alias("first"), F.max(own).alias("last")).filter("first <> last").select("component", "first"))
    gone = stored(near.join(firsts, "component").filter(own != F.col("first")).select(F.col("doc_id").alias(gone_id), F.col("content").alias(gone_content)).distinct())
    side = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    return docs.join(side, docs[doc_id].eqNullSafe(F.col(gone_id)) & (F.xxhash64(docs[text]) == F.col(gone_content)), "left_anti").select(*docs.columns)
