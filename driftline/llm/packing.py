"""Best-fit packing by linear grouping.

The plan is made on the histogram of lengths, which has at most as many rows as a
sequence has tokens, however large the corpus:

1. Large lengths, sorted, are cut into groups of equal cardinality, and each
   counts as the largest of its group.
2. Over these few sizes a linear programme is solved by column generation: how
   often to use each configuration (a multiset of sizes that fits).
3. Each configuration, used the whole part of its times, gets actual lengths in the
   groups' order in place of the rounded ones.
4. What is left over and the small lengths go, longest first, to the fullest
   sequence that has room (best fit), counted by runs of like sequences.

A run of the plan says: the items of this length from this rank on go to
consecutive sequences at this offset. Spark ranks the items of each length (in
buckets, so that a length that a third of them have is spread) and looks each up.

Defined cases: a null or empty text is the end token alone; a document longer than
a sequence is cut, the shorter piece first; rows that repeat a doc_id are
documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import blocks, fresh, stored, text_batches
from .encoding import encoder


def pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end: int = 0, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian uint32) of each document's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(tokenizer), np.uint32(end).tobytes()
        for b in blocks(batches, "text"):
            row, piece, start, length, ids = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                data = enc.ids(t) + tail
                n = len(data) // 4
                at, k = 0, 0
                while at < n:
                    to = at + ((n % capacity or capacity) if at == 0 else capacity)
                    row.append(i), piece.append(k), start.append(at), length.append(to - at), ids.append(data[4 * at : 4 * to])
                    at, k = to, k + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return text_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, piece int, start long, length long, ids binary")


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 4000, gap: float = 1e-3) -> list[tuple[float, np.ndarray]]:
    """(times, how many of each size): a basic solution of the covering programme, by column generation.

    It ends within ``gap`` of the optimum, by Farley's bound: the worth of the
    best configuration at the present prices scales the cost down to a bound.
    """
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    cost = np.ones(n)
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ counts

    def best(y: np.ndarray) -> tuple[float, np.ndarray]:
        """The configuration worth most: one more item at a time, for every free length at once."""
        value, choices = np.zeros(capacity + 1), []
        for _ in range(int(capacity // sizes.min())):
            top, pick = value.copy(), np.full(capacity + 1, -1, np.int16)
            for g in range(n):
                offer = value[: capacity + 1 - sizes[g]] + y[g]
                more = offer > top[sizes[g] :] + 1e-12
                np.copyto(top[sizes[g] :], offer, where=more)
                pick[sizes[g] :][more] = g
            if (pick < 0).all():
                break
            choices.append(pick)
            value = top
        a, c = np.zeros(n), capacity
        for pick in reversed(choices):
            if pick[c] >= 0:
                a[pick[c]] += 1
                c -= int(sizes[pick[c]])
        return float(a @ y), a

    for _ in range(rounds):
        y = cost @ inverse
        if y.min() < -1e-9:
            enter, price = -np.eye(n)[y.argmin()], 0.0
        else:
            worth, enter = best(np.maximum(y, 0))
            price = 1.0
            if worth <= 1 + gap:
                break
        w = inverse @ enter
        grows = w > 1e-9
        if not grows.any():
            break
        ratio = np.full(n, np.inf)
        ratio[grows] = np.maximum(x[grows], 0) / w[grows]
        out = int(ratio.argmin())
        x = x - ratio[out] * w
        x[out] = ratio[out]
        inverse[out] /= w[out]
        rest = np.arange(n) != out
        inverse[rest] -= np.outer(w[rest], inverse[out])
        basis[:, out], cost[out] = enter, price
    return [(float(t), basis[:, i].astype(int)) for i, t in enumerate(x) if cost[i] and t > 1e-9]


class _Plan:
    """Runs of sequences with their free room, and the runs of items placed in them."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.n = capacity, 0
        self.placed: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset
        self.room: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs (first sequence, count)
        self.rooms: list[int] = []

    def free(self, room: int, first: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in self.room:
                insort(self.rooms, room)
                self.room[room] = []
            self.room[room].append((first, count))

    def put(self, length: int, rank: int, count: int) -> None:
        """Best fit of ``count`` items of one length, one after the other."""
        while count:
            i = bisect_left(self.rooms, length)
            if i < len(self.rooms):
                room = self.rooms[i]
                first, m = self.room[room].pop()
                if not self.room[room]:
                    del self.room[room]
                    self.rooms.pop(i)
            else:
                room, first, m = self.capacity, self.n, -(-count // (self.capacity // length))
                self.n += m
            use = min(m, count)
            self.placed.append((length, rank, use, first, self.capacity - room))
            self.free(room - length, first, use)
            self.free(room, first + use, m - use)
            rank, count = rank + use, count - use


def plan(histogram: dict[int, int], capacity: int, *, groups: int = 128, small: float = 1 / 8) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, count, first sequence, offset) that place all items; the number of sequences."""
    out = _Plan(capacity)
    lengths = sorted((n for n in histogram if histogram[n]), reverse=True)
    large = [n for n in lengths if capacity * small < n < capacity]
    if capacity in histogram:
        out.put(capacity, 0, histogram[capacity])
    done = dict.fromkeys(lengths, 0)
    total = sum(histogram[n] for n in large)
    if total:
        # groups of equal cardinality, each a list of runs (length, first rank, count)
        per = max(1, -(-total // groups))
        cut: list[list[tuple[int, int, int]]] = [[]]
        room = per
        for n in large:
            at = 0
            while at < histogram[n]:
                use = min(room, histogram[n] - at)
                cut[-1].append((n, at, use))
                at, room = at + use, room - use
                if not room:
                    cut.append([])
                    room = per
        cut = [g for g in cut if g]
        # groups that are rounded to one size are one size
        sizes = np.array(sorted({g[0][0] for g in cut}, reverse=True))
        runs: list[list[tuple[int, int, int]]] = [[r for g in cut if g[0][0] == s for r in g] for s in sizes]
        counts = np.array([float(sum(r[2] for r in g)) for g in runs])
        at = [[0, 0] for _ in runs]  # the run and how many of it are taken
        for times, config in sorted(configurations(sizes, counts, capacity), key=lambda c: -c[0]):
            m = int(times + 1e-9)
            slots = []
            for g in np.repeat(np.arange(len(sizes)), config):
                segments, left = [], m
                while left and at[g][0] < len(runs[g]):
                    n, rank, count = runs[g][at[g][0]]
                    use = min(left, count - at[g][1])
                    segments.append((m - left, n, rank + at[g][1], use))
                    left, at[g][1] = left - use, at[g][1] + use
                    if at[g][1] == count:
                        at[g] = [at[g][0] + 1, 0]
                slots.append(segments)
            edges = sorted({0, m, *(e for s in slots for b, _, _, c in s for e in (b, b + c))})
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                used = 0
                for s in slots:
                    for b, n, rank, c in s:
                        if b <= lo < b + c:
                            out.placed.append((n, rank + lo - b, hi - lo, out.n + lo, used))
                            used += n
                out.free(capacity - used, out.n + lo, hi - lo)
            out.n += m
        left_over = [(n, rank + (a[1] if i == a[0] else 0), c - (a[1] if i == a[0] else 0)) for g, a in zip(runs, at, strict=True) for i, (n, rank, c) in enumerate(g) if i >= a[0]]
        for n, rank, c in sorted(left_over, reverse=True):
            out.put(n, rank, c)
        for n in large:
            done[n] = histogram[n]
    for n in lengths:
        if n < capacity and not done[n]:
            out.put(n, 0, histogram[n])
    return np.array(sorted(out.placed), np.int64).reshape(-1, 5), out.n


def pack(items: DataFrame, *, length: str = "length", carried: tuple[str, ...] = ("ids",), capacity: int = 2048, per_bucket: int = 2000, groups: int = 128) -> DataFrame:
    """``items`` with sequence_id and offset: no sequence holds more than ``capacity`` tokens.

    Items of one length are told apart by their columns but the ``carried`` ones,
    which other columns name or sum up.
    Columns sequence_id and offset of the input give way to those of the result; others may have any names.
    """
    items = items.drop("sequence_id", "offset")
    own = [c for c in items.columns if c not in carried] or [length]
    names = items.columns
    n_, buckets, bucket, base_, rank_, at_, salt = fresh(names, "n_", "buckets", "bucket_", "base_", "rank_", "at_", "salt_")
    spark = items.sparkSession
    # written once: what a bucket follows from is written with it, so that reading it again gives the same
    items = stored(items.withColumn(salt, F.floor(F.rand(42) * 1024).cast("short")))
    histogram = {int(r[0]): int(r[1]) for r in items.groupBy(length).count().collect()}
    runs, _ = plan(histogram, capacity, groups=groups)
    keys = (runs[:, 0] << 44) | runs[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (n.to_numpy() << 44) | rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": runs[at, 3] + rank.to_numpy() - runs[at, 1], "offset": runs[at, 4]})

    sizes = spark.createDataFrame([(n, max(1, -(-c // per_bucket))) for n, c in histogram.items()], f"{n_} long, {buckets} int")
    spread = items.join(F.broadcast(sizes), items[length] == F.col(n_)).withColumn(bucket, F.pmod(F.xxhash64(*own, salt), buckets).cast("int")).drop(buckets, salt)
    before = Window.partitionBy(n_).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = spread.groupBy(n_, bucket).agg(F.count("*").alias(base_)).withColumn(base_, F.coalesce(F.sum(base_).over(before), F.lit(0)))
    inside = Window.partitionBy(n_, bucket).orderBy(*own)
    ranked = spread.join(base, [n_, bucket]).withColumn(rank_, F.col(base_) + F.row_number().over(inside) - 1)
    return ranked.withColumn(at_, place(n_, rank_)).select(*names, F.col(at_)["sequence_id"].alias("sequence_id"), F.col(at_)["offset"].alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids (little-endian uint32) of each sequence of packed pieces with their ids.

    A sequence has ``capacity`` tokens at most, so a group is bounded.
    """
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    join = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return rows.select("sequence_id", "n_tokens", join.alias("ids"))
