"""Clock offsets, mounting angles, integrals over intervals, pairing and per-epoch solves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.operators import temporal, windows
from driftline.operators.sequential import Step, last_nulls, stepped


def integral_means(signal: DataFrame, intervals: DataFrame, keys: list[str], t: str, y: str, start: str, end: str, scale: float = 1.0) -> DataFrame:
    """The mean of a signal over each interval, from its running integral interpolated at both ends."""
    w = Window.partitionBy(*keys).orderBy(t)
    run = signal.withColumn("_area", windows.trapezoid(y, t, w, scale)).withColumn("_cum", F.sum("_area").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(*keys, t, "_cum")
    at = temporal.interp_join(intervals.withColumn(t, F.col(start)), run, keys, t, ["_cum"], prefix="_a").drop(t)
    both = temporal.interp_join(at.withColumn(t, F.col(end)), run, keys, t, ["_cum"], prefix="_b").drop(t)
    return both.withColumn("mean", (F.col("_b_cum") - F.col("_a_cum")) / ((F.col(end) - F.col(start)) / F.lit(scale))).drop("_a_cum", "_b_cum")


def offset_scan(left: DataFrame, right: DataFrame, keys: list[str], t: str, x: str, y: str, offsets: list[int], *, max_gap: int | None = None) -> DataFrame:
    """offset, n, mean and median absolute difference of the left signal against the right one interpolated at the shifted times.

    The offsets are a literal list that is expanded on the left rows; each
    (session, offset) pair is a key of the interpolation.
    """
    o = F.explode(F.array(*[F.lit(v).cast("long") for v in offsets]))
    a = left.withColumn("offset", o).withColumn("_t", F.col(t)).withColumn(t, F.col(t) + F.col("offset"))
    b = right.withColumn("offset", o)
    joined = temporal.interp_join(a, b.select(*keys, "offset", t, y), [*keys, "offset"], t, [y], max_gap=max_gap).filter(f"i_{y} IS NOT NULL")
    d = F.abs(F.col(x) - F.col(f"i_{y}"))
    return joined.groupBy("offset").agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.percentile(d, 0.5).alias("median"))


def affine_clock(pairs: DataFrame, keys: list[str], own: str, other: str) -> DataFrame:
    """other = scale * own + shift for each key, from the ends of both clocks."""
    e = pairs.groupBy(*keys).agg(F.min(own).alias("a0"), F.max(own).alias("a1"), F.min(other).alias("b0"), F.max(other).alias("b1"))
    scale = (F.col("b1") - F.col("b0")) / F.nullif(F.col("a1") - F.col("a0"), F.lit(0))
    return e.select(*keys, scale.alias("scale"), (F.col("b0") - scale * F.col("a0")).alias("shift"))


def best_windows(rows: DataFrame, keys: list[str], t: str, strength: str, parts: int = 3) -> DataFrame:
    """Of each part of a session's span the strongest row, the earliest on a tie."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(t).over(w), F.max(t).over(w)
    part = F.least(F.lit(parts - 1), F.floor((F.col(t) - lo) * parts / F.greatest(hi - lo, F.lit(1)))).cast("long")
    marked = rows.withColumn("part", part)
    k = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(F.desc(strength), t))
    return marked.withColumn("_k", k).filter("_k = 1").drop("_k")


def greedy_pairs(rows: DataFrame, session: str, *, most: int) -> DataFrame:
    """Samples of two sensors (t, sensor a or b, id) paired as they come: the newest of each, if at most ``most`` apart.

    Of two that are too far apart the older one goes; what is paired is used up.
    """

    columns = ["t", "sensor", "id"]

    def start() -> Step:
        held: dict[str, tuple[int, int]] = {}

        def step(pdf: pd.DataFrame) -> tuple[np.ndarray, dict]:
            at, out = [], []
            for k, (t, sensor, i) in enumerate(pdf[columns].itertuples(index=False)):
                held[sensor] = (t, i)
                if len(held) == 2:
                    (ta, a), (tb, b) = held["a"], held["b"]
                    if abs(ta - tb) <= most:
                        at.append(k), out.append((max(ta, tb), a, b))
                        held.clear()
                    else:
                        held.pop("a" if ta < tb else "b")
            pairs = np.array(out, np.int64).reshape(-1, 3)
            return np.array(at, np.int64), {"t": pairs[:, 0], "id_a": pairs[:, 1], "id_b": pairs[:, 2]}

        return step

    return stepped(rows, session, last_nulls(*columns), columns, start, "t long, id_a long, id_b long")


def mount_yaw(rows: DataFrame, keys: list[str], ax: str, ay: str, forward: str, left: str, *, least: int) -> DataFrame:
    """The rotation from device to vehicle in the plane: atan2 of cross and dot sums, with the fit's correlation.

    Keys with fewer than ``least`` rows get null.
    """
    x, y, f, s = (F.col(c) for c in (ax, ay, forward, left))
    m = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.atan2(F.sum(x * s - y * f), F.sum(x * f + y * s)).alias("_yaw"), F.sum(x * x + y * y).alias("_p"), F.sum(f * f + s * s).alias("_q"), F.sum(x * f + y * s).alias("_d"), F.sum(x * s - y * f).alias("_c"))
    quality = F.sqrt(F.col("_d") * F.col("_d") + F.col("_c") * F.col("_c")) / F.nullif(F.sqrt(F.col("_p") * F.col("_q")), F.lit(0.0))
    ok = F.col("n") >= least
    return m.select(*keys, "n", F.when(ok, F.col("_yaw")).alias("yaw"), F.when(ok, quality).alias("quality"))


def first_valid(candidates: DataFrame, keys: list[str], order: str, valid: Column) -> DataFrame:
    """Of each key the first candidate, in order, that is valid; keys without one keep a row of nulls."""
    cols = [c for c in candidates.columns if c not in keys]
    pick = F.min_by(F.when(valid, F.struct(*cols)), F.when(valid, F.col(order)))
    return candidates.groupBy(*keys).agg(pick.alias("_p")).select(*keys, *[F.col(f"_p.{c}").alias(c) for c in cols])


def _solved(u: np.ndarray, y: np.ndarray, weight: np.ndarray, gate: float, condition: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For epochs of one size, stacked: the four values of each, whether there are any, and the rows used."""
    n, m = y.shape
    a, w = np.concatenate([-u, np.ones((n, m, 1))], axis=2), np.sqrt(weight)
    use, x, ok = np.ones((n, m), bool), np.zeros((n, 4)), np.full(n, m >= 4)

    def median(values: np.ndarray) -> np.ndarray:
        v = np.sort(np.where(use, values, np.inf), axis=1)
        k, at = use.sum(axis=1), np.arange(n)
        return (v[at, np.maximum(k - 1, 0) // 2] + v[at, np.minimum(k // 2, m - 1)]) / 2

    for _ in range(2 if m >= 4 else 0):
        ok &= use.sum(axis=1) >= 4
        left, s, right = np.linalg.svd(a * (w * use)[:, :, None], full_matrices=False)
        ok &= s[:, 0] <= condition * s[:, 3]
        inverse = np.divide(1, s, out=np.zeros_like(s), where=ok[:, None] & (s > 0))
        x = np.einsum("nkj,nk->nj", right, inverse * np.einsum("nmk,nm->nk", left, y * w * use))
        res = y - np.einsum("nmj,nj->nm", a, x)
        mid = median(res)[:, None]
        mad = median(np.abs(res - mid))[:, None]
        # an epoch without a solution keeps the rows it failed with
        use = np.where(ok[:, None], np.abs(res - mid) <= gate * np.maximum(1.4826 * mad, 1e-6), use)
    return x, ok, use.sum(axis=1)


def doppler_velocity(rows: DataFrame, epoch: list[str], *, gate: float = 3.0, condition: float = 1e4) -> DataFrame:
    """Velocity and clock drift of each epoch from (ux, uy, uz, rate, weight) of its satellites.

    Weighted least squares, once more without rows over ``gate`` median absolute
    deviations. An epoch has as many rows as there are satellites in view. Epochs
    come sorted, and those of one size in a batch are solved together.
    """
    kinds = dict(rows.dtypes)
    values = ["ux", "uy", "uz", "rate", "weight"]

    def solve(held: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        """The epochs that begin at ``at`` (its last element is the end)."""
        data = np.stack([held[c].to_numpy() for c in values], axis=1)
        size, first = np.diff(at), at[:-1]
        x, ok, used = np.zeros((len(first), 4)), np.zeros(len(first), bool), np.zeros(len(first), np.int64)
        for m in np.unique(size):
            of = np.flatnonzero(size == m)
            d = data[first[of][:, None] + np.arange(m)]
            x[of], ok[of], used[of] = _solved(d[:, :, :3], d[:, :, 3], d[:, :, 4], gate, condition)
        keys = [held[c].take(pa.array(first)).combine_chunks() for c in epoch]
        return pa.RecordBatch.from_arrays([*keys, *(pa.array(x[:, k], mask=~ok) for k in range(4)), pa.array(used)], [*epoch, "vx", "vy", "vz", "drift", "n_used"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            n = held["_epoch"].to_numpy()
            at = np.r_[0, np.flatnonzero(n[1:] != n[:-1]) + 1]
            if len(at) > 1:  # the last epoch may go on in the next batch
                yield solve(held, at)
                held = held.slice(at[-1])
        if held is not None:
            yield solve(held, np.array([0, held.num_rows]))

    # nulls are told apart from what follows them, since the hash passes over them
    group = F.xxhash64(*epoch, *[F.col(c).isNull() for c in epoch])
    given = rows.select(*epoch, *[F.col(c).cast("double").alias(c) for c in values], group.alias("_epoch"))
    dealt = given.repartition(*epoch).sortWithinPartitions(*epoch)
    return dealt.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in epoch) + ", vx double, vy double, vz double, drift double, n_used long")


def nearest_rotation(rows: DataFrame, key: str, m: str) -> DataFrame:
    """The proper rotation nearest to each 3 x 3 matrix (array of rows), by singular values."""

    def run(frames):  # noqa: ANN001, ANN202
        for pdf in frames:
            a = np.array([np.stack(x) for x in pdf[m]], float).reshape(-1, 3, 3)
            u, _, v = np.linalg.svd(a)
            u[:, :, 2] *= np.sign(np.linalg.det(u @ v))[:, None]
            yield pd.DataFrame({key: pdf[key], "rotation": (u @ v).tolist()})

    return rows.select(key, m).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, rotation array<array<double>>")
