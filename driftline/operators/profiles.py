"""Summaries, agreement, clocks, ranks, bounds and confidence intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.scalars import half_even as r


def summary(x: Column, digits: int = 6) -> list[Column]:
    """Count, mean, spread and linear percentiles of the finite values; nulls for none."""
    p = lambda q: r(F.percentile(x, q), digits)
    return [
        F.count(x).alias("n"), r(F.avg(x), digits).alias("mean"), p(0.5).alias("median"), r(F.min(x), digits).alias("low"), r(F.max(x), digits).alias("high"),
        p(0.01).alias("p01"), p(0.95).alias("p95"), p(0.99).alias("p99"), r(F.stddev_pop(x), digits).alias("std"),
    ]


def nearest_rank(x: str, *fractions: float) -> list[Column]:
    """The ceil(f n)-th values in order."""
    return [F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY {x})").alias(f"p{round(f * 100):02d}") for f in fractions]


def agreement(a: str, b: str) -> list[Column]:
    """Errors and the straight line of a on b; no correlation for under three pairs or a constant side."""
    e = F.col(a) - F.col(b)
    ok = (F.count("*") >= 3) & (F.stddev_pop(a) > 1e-10) & (F.stddev_pop(b) > 1e-10)
    return [
        F.count("*").alias("n"), r(F.avg(F.abs(e))).alias("mae"), r(F.sqrt(F.avg(e * e))).alias("rmse"), r(F.when(ok, F.corr(a, b))).alias("corr"),
        r(F.when(ok, F.regr_slope(F.col(a), F.col(b)))).alias("slope"), r(F.when(ok, F.regr_intercept(F.col(a), F.col(b)))).alias("intercept"),
    ]


def clock_stats(rows: DataFrame, keys: list[str], order: str, t: str, *, floor: float, factor: float, scale: float = 1e6) -> DataFrame:
    """Rate, repeats, steps back, gaps and missing slots of each key's clock.

    A gap is longer than ``floor`` seconds and ``factor`` times the median step; it misses as many slots as
    median steps fit into it, less one.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    steps = rows.withColumn("dt", (F.col(t) - F.lag(t).over(w)) / F.lit(scale)).filter("dt IS NOT NULL")
    median = steps.groupBy(*keys).agg(F.percentile(F.when(F.col("dt") > 0, F.col("dt")), 0.5).alias("median_dt"))
    bound = F.greatest(F.lit(floor), F.col("median_dt") * factor)
    gap = F.col("dt") > bound
    return (
        steps.join(median, keys).groupBy(*keys)
        .agg(
            F.count("*").alias("n_intervals"), r(F.first("median_dt"), 4).alias("median_dt"), r(1 / F.first("median_dt"), 9).alias("rate_hz"),
            F.count_if(F.col("dt") == 0).alias("n_repeated"), F.count_if(F.col("dt") < 0).alias("n_back"), F.count_if(gap).alias("n_gaps"),
            r(F.max("dt")).alias("longest"), F.coalesce(F.sum(F.when(gap, F.floor(F.col("dt") / F.col("median_dt") + 0.5) - 1)), F.lit(0)).cast("long").alias("missing"),
        )
    )


def bounds_grid(rows: DataFrame, keys: list[str], x: str, bounds: list[float], digits: int = 4) -> DataFrame:
    """For each key and bound: how many values are above it, their share and their maximum.

    One pass of conditional aggregates, a few for each bound; the rows for the bounds are made after the shuffle.
    """
    own = [c for k, b in enumerate(bounds) for c in (F.count_if(F.col(x) > b).alias(f"_n{k}"), F.max(F.when(F.col(x) > b, F.col(x))).alias(f"_m{k}"))]
    sums = rows.groupBy(*keys).agg(F.count(x).alias("n"), *own)
    each = [F.struct(F.lit(b).alias("bound"), F.col(f"_n{k}").alias("n_over"), F.col(f"_m{k}").alias("max_over")) for k, b in enumerate(bounds)]
    return sums.select(*keys, "n", F.inline(F.array(*each))).select(*keys, "bound", "n", "n_over", r(F.col("n_over") / F.col("n"), digits).alias("share_over"), r(F.col("max_over")).alias("max_over"))


def top_repeats(rows: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """The k commonest values of each key, the smaller first on a tie."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    return n.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def spearman(rows: DataFrame, keys: list[str], a: str, b: str, tie: str) -> DataFrame:
    """Correlation of row-number ranks (ties by ``tie``)."""
    rank = lambda x: F.row_number().over(Window.partitionBy(*keys).orderBy(x, tie)).cast("double")
    return rows.withColumn("_a", rank(a)).withColumn("_b", rank(b)).groupBy(*keys).agg(F.count("*").alias("n"), r(F.corr("_a", "_b")).alias("rho"))


def top_share_recall(rows: DataFrame, keys: list[str], truth: str, score: str, tie: str, share: float) -> DataFrame:
    """How much of the worst ``share`` by truth the worst by score holds."""
    w = Window.partitionBy(*keys)
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * share))
    rank = lambda x: F.row_number().over(w.orderBy(F.desc(x), tie))
    marked = rows.withColumn("_k", k).withColumn("_t", rank(truth)).withColumn("_s", rank(score))
    hit = (F.col("_t") <= F.col("_k")) & (F.col("_s") <= F.col("_k"))
    return marked.groupBy(*keys).agg(F.first("_k").cast("long").alias("k"), F.count_if(hit).alias("n_hit"), r(F.count_if(hit) / F.first("_k")).alias("recall"))


def allan(rows: DataFrame, keys: list[str], order: str, x: str, sizes: list[int]) -> DataFrame:
    """Allan deviation for clusters of m samples: from the running sum, m and 2 m rows back."""
    w = Window.partitionBy(*keys).orderBy(order)
    cum = rows.withColumn("cum", F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda k: F.when(F.row_number().over(w) == k, F.lit(0.0)).otherwise(F.lag("cum", k).over(w))
    cols = []
    for m in sizes:
        d = (F.col("cum") - 2 * at(m) + at(2 * m)) / m
        cols.append(d.alias(f"d{m}"))
    wide = cum.select(*keys, *cols)
    long = wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.col(f"d{m}").alias("d")) for m in sizes])))
    return long.groupBy(*keys, "m").agg(F.count("d").alias("n"), r(F.sqrt(0.5 * F.avg(F.col("d") * F.col("d"))), 5).alias("deviation"))


def circular_residual(rows: DataFrame, keys: list[str], deg: str) -> DataFrame:
    """Each angle less its key's circular mean, wrapped to half a turn each way."""
    mean = rows.groupBy(*keys).agg(F.degrees(F.atan2(F.avg(F.sin(F.radians(deg))), F.avg(F.cos(F.radians(deg))))).alias("mean_deg"))
    return rows.join(mean, keys).withColumn("residual", F.pmod(F.col(deg) - F.col("mean_deg") + 180.0, F.lit(360.0)) - 180.0)


def bootstrap_mean(pairs: DataFrame, value: str, cluster: str, *, resamples: int = 1000, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean under resampling of whole clusters.

    Each cluster enters a resample with a Poisson (1) weight drawn from a hash
    of (seed, cluster, resample). So the resamples are sums over clusters that are combined before the
    shuffle, and no task ever holds a resample.
    """
    sums = pairs.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    u = (F.xxhash64(F.lit(seed), F.col(cluster), F.col("b")) / F.lit(2.0**64)) + 0.5
    steps, total, p = [], 0.0, 2.718281828459045**-1
    for k in range(12):
        total += p
        steps.append(total)
        p /= k + 1
    weight = sum((F.when(u > s, 1).otherwise(0) for s in steps), F.lit(0))
    draws = sums.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", weight).groupBy("b").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    return draws.agg(r(F.percentile("m", 0.025)).alias("low"), r(F.percentile("m", 0.5)).alias("mid"), r(F.percentile("m", 0.975)).alias("high"))
