"""Compression of vectors into codes: a codebook for each part, trained over all rows.

Components become integers, so that every sum, mean and distance is exact and a
rerun agrees to the last digit whatever the partitions. A vector is cut into
``parts`` equal parts. Each round

1. broadcasts one kd-tree for each part's codebook (its entries are few: entries x
   components integers, whatever the table),
2. finds each part's nearest entry by branch and bound. A node is left out only
   if its box is farther than the best so far; one that is as far is visited, so
   that of equally near entries the lowest index is found,
3. adds up the parts of each entry, in its task first and then by Spark, as integers in
   limbs of 32 bits (no sum can overflow), and replaces the entry by the floor of the mean.

What reaches the driver is one number for each entry, component and limb.

Defined cases: a null vector, or one with a component that is null or not finite (once
scaled), is dropped; vectors shorter than the longest, or all, if its length is no multiple of
``parts``, count as padded with zeros; with fewer vectors than entries each is
an entry; without vectors the result is empty. A null id is larger than any other,
rows that repeat an id are rows of their own and start codebooks in order of their
components. An error that no long can hold is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored

#: Below this all squared distances of up to 8,192 components fit 63 bits.
SAFE = 1 << 24
LIMB = 32


@dataclass
class Tree:
    """A kd-tree over a codebook; node k holds entries ``order[lo[k]:hi[k]]`` and their box."""

    entries: np.ndarray
    order: np.ndarray
    lo: list[int]
    hi: list[int]
    axis: list[int]
    cut: list[int]
    left: list[int]
    right: list[int]
    box: list[tuple[np.ndarray, np.ndarray]]


def tree(entries: np.ndarray, leaf: int = 4) -> Tree:
    """The kd-tree of a codebook: each node is halved along its widest component."""
    t = Tree(entries, np.arange(len(entries)), [], [], [], [], [], [], [])

    def node(lo: int, hi: int) -> int:
        own = entries[t.order[lo:hi]]
        k, box = len(t.lo), (own.min(axis=0), own.max(axis=0))
        for x, v in ((t.lo, lo), (t.hi, hi), (t.axis, -1), (t.cut, 0), (t.left, -1), (t.right, -1), (t.box, box)):
            x.append(v)
        wide = box[1] - box[0]
        if hi - lo > leaf and wide.size and wide.max() > 0:
            axis = int(wide.argmax())
            t.order[lo:hi] = t.order[lo:hi][np.argsort(own[:, axis], kind="stable")]
            mid = (lo + hi) // 2
            t.axis[k], t.cut[k] = axis, entries[t.order[mid], axis]
            t.left[k], t.right[k] = node(lo, mid), node(mid, hi)
        return k

    node(0, len(entries))
    return t


def nearest(t: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry; ties to the lower index."""
    best = np.full(len(x), -1, np.int64)
    far = np.zeros(len(x), object if object in (x.dtype, t.entries.dtype) else np.int64)

    def visit(k: int, rows: np.ndarray) -> None:
        low, high = t.box[k]
        p = x[rows]
        bound = (np.maximum(np.maximum(low - p, p - high), 0) ** 2).sum(axis=1)
        rows = rows[(best[rows] < 0) | (bound <= far[rows])]
        if not len(rows):
            return
        if t.axis[k] < 0:
            for e in t.order[t.lo[k] : t.hi[k]]:
                d = ((x[rows] - t.entries[e]) ** 2).sum(axis=1)
                better = (best[rows] < 0) | (d < far[rows]) | ((d == far[rows]) & (e < best[rows]))
                best[rows[better]], far[rows[better]] = e, d[better]
            return
        near_left = x[rows, t.axis[k]] < t.cut[k]
        for first, second, own in ((t.left[k], t.right[k], rows[near_left]), (t.right[k], t.left[k], rows[~near_left])):
            if len(own):
                visit(first, own)
                visit(second, own)

    if len(x):
        visit(0, np.arange(len(x)))
    return best, far


def scaled(vector: Column | str, scale: int = 4096) -> Column:
    """The floors of a vector's components times ``scale``, as doubles that hold integers."""
    return F.transform(vector, lambda c: _floor(c.cast("double") * scale))


def _floor(c: Column) -> Column:
    # beyond 2^52 every double is an integer, and floor() would leave the range of longs
    return F.when(F.abs(c) >= float(1 << 52), c).otherwise(F.floor(c).cast("double"))


def _ints(column: pa.Array, width: int) -> np.ndarray:
    """A batch's vectors as rows of integers, padded with zeros; Python integers where longs could overflow."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((n, width), np.float64)
    out[np.arange(width) < size[:, None]] = flat
    if not out.size or np.abs(out).max() < SAFE:
        return out.astype(np.int64)
    return np.array([[int(v) for v in row] for row in out], object)


def _limbs(total: int) -> list[tuple[int, int]]:
    """An integer in signed limbs: number and value of those that are not 0."""
    sign, total, out, k = (-1 if total < 0 else 1), abs(total), [], 0
    while total:
        if total & ((1 << LIMB) - 1):
            out.append((k, sign * (total & ((1 << LIMB) - 1))))
        total, k = total >> LIMB, k + 1
    return out


@dataclass
class Codes:
    """What :func:`trained` returns: integer vectors, their width, and a codebook for each part."""

    table: DataFrame
    width: int
    books: list[np.ndarray]

    def sha256(self) -> str:
        """Digest of all entries' components by part, entry and position."""
        return hashlib.sha256(",".join(str(v) for b in self.books for e in b for v in e).encode()).hexdigest()


def _books(values: list[list[list[int]]]) -> list[np.ndarray]:
    """Codebooks as arrays, of Python integers where longs could overflow."""
    top = max((abs(v) for b in values for e in b for v in e), default=0)
    return [np.array(b, object if top >= SAFE else np.int64).reshape(len(b), -1) for b in values]


def trained(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codes:
    """Codebooks of all vectors; :func:`encoded` applies them."""
    spark = vectors.sparkSession
    whole = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double") * scale) == float("inf"))
    table = stored(whole.filter(F.col("v").isNotNull() & ~F.exists("v", bad)).select("vec_id", "label", scaled("v", scale).alias("v")))
    width = table.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return Codes(table, 0, [])
    width = -(-width // parts) * parts
    step = width // parts
    heads = table.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    first = [[int(x) for x in r.v] + [0] * (width - len(r.v)) for r in heads]
    values = [[e[p * step : (p + 1) * step] for e in first] for p in range(parts)]
    for _ in range(rounds):
        values = _round(spark, table, width, values)
    return Codes(table, width, _books(values))


def _round(spark, table: DataFrame, width: int, values: list[list[list[int]]]) -> list[list[list[int]]]:  # noqa: ANN001
    parts, step = len(values), width // len(values)
    trees = spark.sparkContext.broadcast([tree(b) for b in _books(values)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[[0] * (step + 1) for _ in b] for b in values]
        for batch in batches:
            x = _ints(batch.column(0), width)
            for p, t in enumerate(trees.value):
                own = x[:, p * step : (p + 1) * step]
                e, _ = nearest(t, own)
                for k in np.unique(e):
                    mine = own[e == k]
                    row = held[p][k]
                    row[0] += len(mine)
                    for i, s in enumerate(mine.sum(axis=0)):
                        row[i + 1] += int(s)
        rows = [(p, k, i, limb, v) for p, b in enumerate(held) for k, r in enumerate(b) for i, total in enumerate(r) for limb, v in _limbs(total)]
        yield pa.RecordBatch.from_pydict({c: [r[i] for r in rows] for i, c in enumerate(("part", "entry", "at", "limb", "value"))}, schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]))

    found = table.select("v").mapInArrow(sums, "part int, entry int, at int, limb int, value long").groupBy("part", "entry", "at", "limb").agg(F.sum("value").alias("value")).collect()
    total: dict[tuple[int, int, int], int] = {}
    for r in found:
        total[r.part, r.entry, r["at"]] = total.get((r.part, r.entry, r["at"]), 0) + (r.value << (LIMB * r.limb))
    trees.destroy()
    count = lambda p, k: total.get((p, k, 0), 0)
    return [[[total.get((p, k, i + 1), 0) // count(p, k) for i in range(step)] if count(p, k) else e for k, e in enumerate(b)] for p, b in enumerate(values)]


def encoded(codes: Codes) -> DataFrame:
    """vec_id, label, codes (an index for each part) and error of each vector kept."""
    types = dict(codes.table.dtypes)
    schema = f"vec_id {types['vec_id']}, label {types['label']}, codes array<int>, error long"
    spark, width, parts = codes.table.sparkSession, codes.width, len(codes.books)
    if not parts:
        return spark.createDataFrame([], schema)
    step = width // parts
    trees = spark.sparkContext.broadcast([tree(b) for b in codes.books])

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _ints(batch.column(2), width)
            found = [nearest(t, x[:, p * step : (p + 1) * step]) for p, t in enumerate(trees.value)]
            code = np.stack([e for e, _ in found], axis=1).astype(np.int32)
            error = sum(d.astype(object) for _, d in found)
            rows = pa.array(np.arange(0, code.size + 1, parts, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(rows, pa.array(code.ravel())), pa.array([v if v < 1 << 63 else None for v in error], pa.int64())], ["vec_id", "label", "codes", "error"])

    return codes.table.select("vec_id", "label", "v").mapInArrow(assigned, schema)


def with_label_error(coded: DataFrame, *, broadcast_rows: int = 100_000) -> DataFrame:
    """``coded`` with the error summed over the rows of its label, nulls together.

    One row for each label is broadcast if these are at most ``broadcast_rows``; beyond, Spark shuffles the join.
    """
    coded = stored(coded)
    by = stored(coded.groupBy(F.col("label").alias("its")).agg(F.sum("error").alias("label_error")))
    side = F.broadcast(by) if by.count() <= broadcast_rows else by
    return coded.join(side, F.col("label").eqNullSafe(F.col("its"))).drop("its")
