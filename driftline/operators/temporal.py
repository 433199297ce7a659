"""As-of, interpolating, nearest and interval joins on keys and integer times.

All of them are unions and windows or equi-joins on time bins: one shuffle by
key, no loop, no cross join. A window holds one key's rows (a session's) in
time order, spilling to disk as needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _both(left: DataFrame, right: DataFrame, keys: list[str], t: str, payload: list[str], right_first: bool) -> DataFrame:
    """Left and right rows in one frame: the right ones carry a payload struct, the left ones their row."""
    own = left.select(*keys, F.col(t).alias("_t"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(*payload)).schema[0].dataType).alias("_right"), F.lit(1 if right_first else 0).alias("_side"))
    other = right.select(*keys, F.col(t).alias("_t"), F.lit(None).cast(own.schema["_left"].dataType).alias("_left"), F.struct(*payload).alias("_right"), F.lit(0 if right_first else 1).alias("_side"))
    return own.unionByName(other)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, *, prefix: str = "r_", forward: bool = False) -> DataFrame:
    """Each left row with the last right row at or before its time (or the first at or after it).

    Right columns other than the keys come with ``prefix``; a left row without
    a match has nulls there. Of right rows with one time the one with the
    largest (backward) or smallest (forward) other columns counts.
    """
    payload = [c for c in right.columns if c not in keys]
    rows = _both(left, right, keys, t, payload, right_first=not forward)
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_right")
    if forward:
        hit = F.first("_right", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    else:
        hit = F.last("_right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("_hit", hit).filter("_left IS NOT NULL")
    return found.select("_left.*", *[F.col(f"_hit.{c}").alias(prefix + c) for c in payload])


def interp_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, values: list[str], *, max_gap: int | None = None, prefix: str = "i_") -> DataFrame:
    """Left rows with the right side's values, linearly interpolated at their time.

    Right rows with one time are averaged first. Outside the right side's span,
    and between rows that are more than ``max_gap`` apart, the result is null.
    """
    points = right.groupBy(*keys, t).agg(*[F.avg(v).alias(v) for v in values])
    rows = _both(left, points, keys, t, [t, *values], right_first=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side")
    back = F.last("_right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # the first point after, or at, the row: points stand before rows of their own time
    ahead = F.first("_right", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = rows.withColumn("_a", back).withColumn("_b", ahead).filter("_left IS NOT NULL")
    a, b, at = F.col("_a")[t], F.col("_b")[t], F.col("_t")
    inside = (a == at) | (b - a <= max_gap if max_gap is not None else b.isNotNull())

    def value(v: str) -> Column:
        x, y = F.col("_a")[v], F.col("_b")[v]
        return F.when(inside, F.when(a == at, x).otherwise(x + (y - x) * ((at - a) / (b - a)))).alias(prefix + v)

    return found.select("_left.*", *map(value, values))


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, *, prefix: str = "r_", within: int | None = None) -> DataFrame:
    """Each left row with the right row of the nearest time; the earlier one on a tie."""
    payload = [c for c in right.columns if c not in keys]
    rows = _both(left, right, keys, t, payload, right_first=True)
    # one sort: what is at or before a row is behind it, what is after it ahead
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_right")
    back = F.last("_right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_right", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = rows.select("_t", "_left", back.alias("_b"), ahead.alias("_f")).filter("_left IS NOT NULL")
    before, after = F.col("_t") - F.col(f"_b.{t}"), F.col(f"_f.{t}") - F.col("_t")
    first = F.coalesce(before <= after, before.isNotNull())
    near = F.when(first, before).otherwise(after)
    ok = near <= within if within is not None else F.lit(True)
    hit = F.when(ok, F.when(first, F.col("_b")).otherwise(F.col("_f")))
    return both.select("_left.*", *[hit[c].alias(prefix + c) for c in payload])


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], t: str, start: str, end: str, *, width: int, how: str = "inner", prefix: str = "iv_") -> DataFrame:
    """Points with the half-open intervals [start, end) that hold them.

    Intervals are listed under every time bin of ``width`` that they touch, and
    the join is an equi-join on key and bin: choose a width near the usual
    length of an interval. ``how`` may be inner, left_semi or left_anti.
    """
    iv = intervals.filter(F.col(end) > F.col(start))
    names = [c for c in iv.columns if c not in keys]
    iv = iv.select(*[F.col(k).alias("_k" + k) for k in keys], *[F.col(c).alias(prefix + c) for c in names])
    iv = iv.withColumn("_bin", F.explode(F.sequence(F.expr(f"floor({prefix}{start} / {width})"), F.expr(f"floor(({prefix}{end} - 1) / {width})"))))
    at = points.withColumn("_bin0", F.floor(F.col(t) / width))
    on = (F.col("_bin0") == F.col("_bin")) & (F.col(t) >= F.col(prefix + start)) & (F.col(t) < F.col(prefix + end))
    for k in keys:
        on = on & (at[k] == F.col("_k" + k))
    out = at.join(iv, on, how)
    extra = [] if how in ("left_semi", "left_anti") else [prefix + c for c in names]
    return out.select(*points.columns, *extra)


def merged(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The union of each key's intervals: touching and overlapping ones become one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col(start) > reach)).cast("int")
    return intervals.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def masked(points: DataFrame, masks: DataFrame, keys: list[str], t: str, start: str, end: str, *, width: int) -> DataFrame:
    """Points that no mask holds."""
    return range_join(points, masks, keys, t, start, end, width=width, how="left_anti")


def strictly_increasing(rows: DataFrame, keys: list[str], arrival: str, t: str) -> DataFrame:
    """Rows, in the order of arrival, whose time is after that of every row before."""
    before = F.max(t).over(Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col(t) > F.col("_before"))).drop("_before")


def changed(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Rows whose values differ from those of the row before (nulls equal); the first row counts."""
    w = Window.partitionBy(*keys).orderBy(order)
    now = F.struct(*values)
    return rows.withColumn("_was", F.lag(now).over(w)).filter(F.col("_was").isNull() | ~now.eqNullSafe(F.col("_was"))).drop("_was")
