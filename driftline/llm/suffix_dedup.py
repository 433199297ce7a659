"""Repeated passages: every byte that a string of ``window`` bytes covers which also starts earlier.

Two equal strings of ``window`` bytes hold the same short grams, hence the same least gram hash, at the
same place. So each start of a string belongs to one anchor (the place of the least hash in it), and
equal strings belong to anchors of one hash. That cuts a corpus into shards that need not know of each other:

1. a numpy pass over the texts finds the anchors, one for about 40 bytes, each with the run of
   starts that it stands for and a hash of the snippet which these starts cover;
2. anchors whose hash occurs once are done. Of equal snippets of an anchor the first one decides,
   the starts of the others are marked; this is an aggregate that Spark combines before its shuffle, so a
   passage that a third of all documents share is one row from each task;
3. the different snippets of an anchor meet in a shard. Those that share the bytes on neither side of their gram with another
   are done. Of the rest a suffix array is built by induced sorting (suffixes
   classified, leftmost smaller substrings sorted by recursion, the rest induced in two linear scans), its permuted
   common prefixes show which neighbours share ``window`` bytes, and of each such run all starts but the earliest are marked;
4. an anchor with more than ``most`` different snippets (a passage whose edges differ in every document) is dealt to several shards.
   Each then names what is first in it (a hash of each string), and a second aggregate decides among these;
5. a text is cut by its marks.

Equality of grams, of whole snippets of one anchor and of strings across the shards of a split anchor is equality of 64, 128 and 128
bits of hashes; inside a shard it is equality of bytes.

Defined cases: a null text is empty; texts shorter than ``window`` bytes stay whole; a null id is larger than any other; of two
texts with one id the one with the smaller hash comes first; of rows that repeat id and text one stays and the others repeat it;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import mixed, utf8, xxh64
from ._common import blocks, stored, text_batches
from .suffix_array import permuted_prefixes, suffix_array

PLACE = np.uint64((1 << 28) - 1)  #: the bits of an anchor's place; the rest are its hash
PIECE = 1 << 20  #: starts that are looked at together
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
TABLE = mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def anchors(raw: np.ndarray, off: np.ndarray, window: int, gram: int, places: bool = False) -> tuple[np.ndarray, ...]:
    """Text, first start, number of starts, anchor hash and snippet hash of each anchor, in order; and its place, if wanted."""
    none = np.zeros(0, np.int64)
    out = [(none, none, none, none.view(np.uint64), none.view(np.uint64), none)]
    for at in range(0, max(1, len(raw) - window + 1), PIECE):
        part = raw[at : at + PIECE + window - 1]
        n = len(part) - window + 1
        if n > 0:
            out.append(_piece(part, np.clip(off - at, 0, len(part)), n, window, gram, off[:-1] - at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))[: 6 if places else 5]


def _piece(raw: np.ndarray, off: np.ndarray, n: int, window: int, gram: int, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    with np.errstate(over="ignore"):
        back = _powers(BACK, len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(TABLE[raw] * _powers(BASE, len(raw)), out=sums[1:])
        hashed = lambda a, b: mixed((sums[b] - sums[a]) * back[a])
        grams = len(raw) - gram + 1
        key = mixed((sums[gram:] - sums[:grams]) * back[:grams]) & ~PLACE | np.arange(grams, dtype=np.uint64)
        # the least of each ``w`` grams in a row, by least values from both ends of blocks
        w = window - gram + 1
        blocked = np.full(-(-grams // w) * w + w, np.iinfo(np.uint64).max, np.uint64)
        blocked[:grams] = key
        blocked = blocked.reshape(-1, w)
        ahead = np.minimum.accumulate(blocked, axis=1).ravel()
        behind = np.minimum.accumulate(blocked[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & PLACE).astype(np.int64)
        # starts whose string ends inside its text
        edge = np.zeros(n + 1, np.int64)
        last = np.minimum(off[1:] - window + 1, n)
        some = last > off[:-1]
        np.add.at(edge, off[:-1][some], 1)
        np.add.at(edge, last[some], -1)
        start = np.flatnonzero(np.cumsum(edge[:n]) > 0)
        fresh = np.r_[True, (np.diff(start) > 1) | (np.diff(place[start]) != 0)] if len(start) else np.zeros(0, bool)
        head = np.flatnonzero(fresh)
        count = np.diff(np.r_[head, len(start)])
        first = start[head]
        anchor = hashed(place[first], place[first] + gram)
        snip = mixed(hashed(first, first + count - 1 + window) + count.astype(np.uint64))
    doc = np.searchsorted(off, first, side="right") - 1
    return doc, first - begins[doc], count, anchor, snip, place[first] - begins[doc]


def _found(window: int, gram: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            doc, start, count, anchor, snip = anchors(*utf8(b.column(2)), window, gram)
            ends = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32))
            rows = pa.StructArray.from_arrays([pa.array(anchor.view(np.int64)), pa.array(snip.view(np.int64)), pa.array(start), pa.array(count)], ["anchor", "snip", "start", "count"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, rows)], ["doc_id", "h", "anchors"])

    return run


def _run(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First start and number of starts of runs that travel as one number."""
    return packed >> 16, packed & 65535


def _gathered(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many slices in a row, and their n + 1 offsets."""
    ends = np.r_[0, np.cumsum(size)]
    return raw[np.arange(ends[-1]) + np.repeat(at - ends[:-1], size)], ends


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column in a row, and their n + 1 offsets."""
    col = column.combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _snippets(window: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            raw, off = utf8(b.column(2))
            want = b.column(3)
            doc = np.repeat(np.arange(b.num_rows), np.diff(want.offsets.to_numpy()))
            anchor, salt, run = (f.to_numpy() for f in want.flatten().flatten())
            start, count = _run(run)
            for at in range(0, len(doc), 1 << 14):
                own = slice(at, at + (1 << 14))
                flat, ends = _gathered(raw, off[doc[own]] + start[own], count[own] + window - 1)
                bytes_ = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
                rows = pa.array(doc[own])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[own]), pa.array(salt[own]), b.column(0).take(rows), b.column(1).take(rows), pa.array(start[own]), pa.array(count[own]), bytes_], ["anchor", "salt", "doc_id", "h", "start", "count", "bytes"])

    return run


def _likely(raw: np.ndarray, ends: np.ndarray, anchor: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Which snippets can share a string with another of their anchor.

    A string has at least ``half`` bytes on one side of its gram, so what shares it has the same bytes there.
    """
    n, half = len(ends) - 1, -(-(window - gram) // 2)
    doc, start, count, _, _, place = anchors(raw, ends, window, gram, places=True)
    # pieces of a snippet that was cut have the same place
    _, at = np.unique(doc, return_index=True)
    place = ends[:-1] + place[at]
    out = np.zeros(n, bool)
    for a, b in ((place - half, place + gram), (place, place + gram + half)):
        inside = np.flatnonzero((a >= ends[:-1]) & (b <= ends[1:]))
        key = np.stack([anchor[inside].view(np.uint64), xxh64(raw, a[inside], b[inside])])
        _, which, times = np.unique(key, axis=1, return_inverse=True, return_counts=True)
        out[inside[times[which.ravel()] > 1]] = True
    return out


def _shards(window: int, gram: int, size: int):  # noqa: ANN202
    """Marks of the snippets that a task gets, ordered by anchor and salt; ``size`` bytes to a suffix array, whole anchors each."""

    def shard(t: pa.Table) -> Iterator[pa.RecordBatch]:
        flat, ends = _flat(t["bytes"])
        likely = _likely(flat, ends, t["anchor"].to_numpy(), window, gram) | t["split"].to_numpy()
        if likely.any():
            yield from sorted_shard(t.filter(pa.array(likely)))

    def sorted_shard(t: pa.Table) -> Iterator[pa.RecordBatch]:
        n = t.num_rows
        flat, ends = _flat(t["bytes"])
        width = np.diff(ends)
        # each snippet, then a separator that is less than any byte; at last the end that is less than that
        at = np.r_[0, np.cumsum(width + 1)]
        raw, symbols = np.zeros(at[-1] + 1, np.uint8), np.ones(at[-1] + 1, np.int64)
        symbols[-1] = 0
        own = np.arange(len(flat)) + np.repeat(np.arange(n), width)
        raw[own], symbols[own] = flat, flat.astype(np.int64) + 2
        left = np.zeros(len(raw), np.int64)
        left[own] = np.repeat(at[:-1] + width, width) - own
        sa = suffix_array(symbols)
        shared = permuted_prefixes(raw, sa, left)[sa]
        # runs of suffixes that share a string
        run = np.cumsum(shared < window)
        snippet = np.searchsorted(at, sa, side="right") - 1
        rank = np.empty(n, np.int64)
        rank[pc.sort_indices(t.select(["doc_id", "h", "start"]), sort_keys=[("doc_id", "ascending"), ("h", "ascending"), ("start", "ascending")], null_placement="at_end").to_numpy()] = np.arange(n)
        begins = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        keep = np.minimum(snippet, n - 1)
        order = rank[keep] * (2 * window) + sa - at[keep]
        least = np.repeat(np.minimum.reduceat(order, begins), np.diff(np.r_[begins, len(sa)]))
        marked = np.zeros(len(raw), bool)
        marked[sa[order > least]] = True
        # marks as runs of starts
        edge = np.flatnonzero(np.diff(np.r_[False, marked, False].view(np.int8)))
        a, b = edge[::2], edge[1::2]
        who = np.searchsorted(at, a, side="right") - 1
        yield given(t, who, a - at[who], b - a, None, None)
        split = t["split"].to_numpy()
        if split.any():
            count = t["count"].to_numpy()
            starts, _ = _gathered(np.arange(len(raw)), at[:-1][split], count[split])
            starts = starts[~marked[starts]]
            who = np.searchsorted(at, starts, side="right") - 1
            yield given(t, who, starts - at[who], np.ones(len(who), np.int64), *(xxh64(raw, starts, starts + window, seed).view(np.int64) for seed in (42, 43)))

    def given(t: pa.Table, who: np.ndarray, start: np.ndarray, count: np.ndarray, w1: np.ndarray | None, w2: np.ndarray | None) -> pa.RecordBatch:
        rows = pa.array(who)
        null = pa.nulls(len(who), pa.int64())
        at = start + t["start"].to_numpy()[who]
        own = [t[c].take(rows).combine_chunks() for c in ("doc_id", "h")]
        own = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c for c in own]
        return pa.RecordBatch.from_arrays([*own, pa.array(at), pa.array(count), null if w1 is None else pa.array(w1), null if w2 is None else pa.array(w2)], ["doc_id", "h", "start", "count", "w1", "w2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.column(6).get_total_buffer_size() for x in held) < size:
                continue
            t = pa.Table.from_batches(held)
            key = np.stack([t["anchor"].to_numpy(), t["salt"].to_numpy()])
            cuts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            ends = np.r_[0, np.cumsum(pc.binary_length(t["bytes"]).to_numpy())]
            # whole anchors of about ``size`` bytes; the last may go on in the next batch
            at = 0
            while at < cuts[-1]:
                to = int(cuts[min(max(np.searchsorted(ends[cuts], ends[at] + size), np.searchsorted(cuts, at) + 1), len(cuts) - 1)])
                yield from shard(t.slice(at, to - at))
                at = to
            held = t.slice(at).combine_chunks().to_batches()
        if held:
            yield from shard(pa.Table.from_batches(held))

    return run


def _cut(window: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            raw, off = utf8(b.column(2))
            marks = b.column(3)
            doc = np.repeat(np.arange(b.num_rows), np.diff(marks.offsets.to_numpy()))
            start, count = _run(marks.flatten().to_numpy())
            edge = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edge, off[doc] + start, 1)
            np.add.at(edge, off[doc] + start + count - 1 + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            total = np.r_[0, np.cumsum(gone)]
            begins = gone & ~np.r_[False, gone[:-1]]
            at = off[:-1][np.diff(off) > 0]
            begins[at] = gone[at]
            spans = np.r_[0, np.cumsum(begins)]
            removed = np.diff(total[off])
            kept = off - total[off]
            rest = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(raw[~gone])])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(off)), pa.array(removed), pa.array(np.diff(spans[off])), rest], ["doc_id", "h", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["k_id"]) & (a["h"] == b["k_h"])


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, broadcast if it has at most ``rows`` rows (of a few numbers each)."""
    return F.broadcast(df) if df.count() <= rows else df


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 100, gram: int = 24, most: int = 2_000, shard_bytes: int = 1 << 18, broadcast_rows: int = 100_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that are left) of every row of ``docs``."""
    key = dict(docs.dtypes)[doc_id]
    given = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.coalesce(text, F.lit("")).alias("text"))
    given = text_batches(given)
    found = stored(given.mapInArrow(_found(window, gram), f"doc_id {key}, h long, anchors array<struct<anchor:long,snip:long,start:long,count:long>>"))
    often = stored(found.select(F.explode("anchors.anchor").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    # a run of starts travels as one number
    rows = found.select("doc_id", "h", F.explode("anchors").alias("a")).select("doc_id", "h", "a.anchor", "a.snip", (F.shiftleft("a.start", 16) + F.col("a.count")).alias("run"))
    # each step is written first, so that the join after it stands alone in its stage and Spark can split a hot key's rows
    seen = stored(rows.join(_small(often, broadcast_rows), "anchor"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "run")
    firsts = stored(seen.groupBy("anchor", "snip").agg(F.min(place).alias("at"), F.count("*").alias("n")))
    again = firsts.filter("n > 1").select("anchor", "snip", "at")
    marks = seen.join(again, ["anchor", "snip"]).filter(place != F.col("at")).select("doc_id", "h", "run")
    marks = marks.union(_different(given, found, firsts, key, window, gram, most, shard_bytes, broadcast_rows))
    twice = _repeated(found)
    repeats = bool(twice.limit(1).count())
    # only rows that repeat id and text are marked more than once
    marks = marks.distinct() if repeats else marks
    held = stored(marks.groupBy(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h")).agg(F.collect_list("run").alias("marks")))
    few = held.agg(F.sum(F.size("marks"))).first()[0] or 0
    with_marks = given.join(F.broadcast(held) if few <= broadcast_rows else held, _same(given, held), "left")
    none = F.array().cast("array<long>")
    out = with_marks.select("doc_id", "h", "text", F.coalesce("marks", none).alias("marks")).mapInArrow(_cut(window), f"doc_id {key}, h long, n_bytes long, n_removed long, n_spans long, kept binary")
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    if not repeats:
        return out.select(*columns)
    # of rows that repeat id and text the others repeat all of it
    out = stored(out)
    alone = out.join(_small(twice, broadcast_rows), _same(out, twice), "left_anti").select(*columns)
    first = out.join(_small(twice, broadcast_rows), _same(out, twice)).dropDuplicates(["doc_id", "h"])
    long = F.col("n_bytes") >= window
    others = first.select("*", F.explode(F.sequence(F.lit(2).cast("long"), "n")).alias("copy"))
    others = others.select("doc_id", "n_bytes", *(F.when(long, a).otherwise(F.col(c)).alias(c) for c, a in (("n_removed", F.col("n_bytes")), ("n_spans", F.lit(1).cast("long")), ("kept", F.lit("").cast("binary")))))
    return alone.union(first.select(*columns)).union(others)


def _repeated(found: DataFrame) -> DataFrame:
    """k_id, k_h and n of the rows that repeat id and text."""
    return stored(found.groupBy(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h")).agg(F.count("*").alias("n")).filter("n > 1"))


def _different(given: DataFrame, found: DataFrame, firsts: DataFrame, key: str, window: int, gram: int, most: int, shard_bytes: int, broadcast_rows: int) -> DataFrame:
    """doc_id, h and run of starts that another snippet of their anchor has earlier."""
    several = stored(firsts.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1"))
    fresh = firsts.select("anchor", "snip", "at.*").join(_small(several, broadcast_rows), "anchor")
    salt = F.pmod(F.col("snip"), F.ceil(F.col("k") / most)).alias("salt")
    # a salt below 0 tells that the anchor is split
    fresh = stored(fresh.select("anchor", salt, (F.col("k") > most).alias("split"), "doc_id", "h", "run"))
    want = fresh.groupBy(F.col("doc_id").alias("k_id"), F.col("h").alias("k_h")).agg(F.collect_list(F.struct("anchor", F.when(F.col("split"), -1 - F.col("salt")).otherwise(F.col("salt")).alias("salt"), "run")).alias("want"))
    want = stored(want)
    few = want.agg(F.sum(F.size("want"))).first()[0] or 0
    texts = given.distinct() if _repeated(found).limit(1).count() else given
    texts = texts.join(F.broadcast(want) if few <= broadcast_rows else want, _same(texts, want)).select("doc_id", "h", "text", "want")
    cut = texts.mapInArrow(_snippets(window), f"anchor long, salt long, doc_id {key}, h long, start long, count long, bytes binary")
    cut = cut.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    shape = f"doc_id {key}, h long, start long, count long, w1 long, w2 long"
    out = stored(cut.select("anchor", "salt", "doc_id", "h", "start", "count", "bytes", (F.col("salt") < 0).alias("split")).mapInArrow(_shards(window, gram, shard_bytes), shape))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "start")
    strings = out.filter("w1 IS NOT NULL")
    earliest = strings.groupBy("w1", "w2").agg(F.min(place).alias("at"), F.count("*").alias("n")).filter("n > 1")
    later = strings.join(earliest, ["w1", "w2"]).filter(place != F.col("at")).select("doc_id", "h", "start", "count")
    return out.filter("w1 IS NULL").select("doc_id", "h", "start", "count").union(later).select("doc_id", "h", (F.shiftleft("start", 16) + F.col("count")).alias("run"))
