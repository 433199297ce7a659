"""Distinct rotations within a tolerance: a cover of the rotation group by cells, an equi-join on cells, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions import rotations
from driftline.sources.storage import shared_path


def _stored(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession, "rotations")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def close_rotations(rows: DataFrame, key: str, q: str, tolerance: float) -> DataFrame:
    """a, b (a < b): distinct keys whose unit quaternions are at most ``tolerance`` apart (chord), q and -q being one rotation.

    Cells have twice the tolerance as side. A rotation stands in the cell of q and of -q; it looks for others in all cells that the box
    of its tolerance touches: sixteen at most, in four dimensions. A pair is met in one cell once for each sign, so repeats go.
    """
    side = 2 * tolerance
    place = lambda sign: F.struct(*[F.floor(sign * F.col("q")[i] / side).cast("long").alias(f"c{i}") for i in range(4)])
    stand = rows.select(F.col(key).alias("b"), F.col(q).alias("q")).select("b", F.col("q").alias("p"), F.explode(F.array(place(1), place(-1))).alias("cell"))
    low = [F.floor((F.col("q")[i] - tolerance) / side).cast("long") for i in range(4)]
    high = [F.floor((F.col("q")[i] + tolerance) / side).cast("long") for i in range(4)]
    look = rows.select(F.col(key).alias("a"), F.col(q).alias("q"))
    for i in range(4):
        look = look.withColumn(f"c{i}", F.explode(F.sequence(low[i], high[i])))
    look = look.select("a", "q", F.struct(*[f"c{i}" for i in range(4)]).alias("cell"))
    dot = F.abs(rotations.dot(F.col("q"), F.col("p"), 4))
    # the chord of unit quaternions a, b: |a - b|^2 = 2 - 2 a.b
    return look.join(stand, "cell").filter((F.col("a") < F.col("b")) & (2 - 2 * dot <= tolerance * tolerance)).select("a", "b").distinct()


def labelled(edges: DataFrame, *, rounds: int = 50) -> DataFrame:
    """node and first (the smallest node that edges reach) of every node with an edge: labels are handed on and jumped over until none changes."""
    both = _stored(edges.select("a", "b").union(edges.select("b", "a")))
    now = _stored(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("first")))
    for _ in range(rounds):
        heard = both.join(now, F.col("b") == F.col("node")).groupBy("a").agg(F.min("first").alias("heard"))
        step = now.join(heard, F.col("node") == F.col("a")).select("node", F.col("first").alias("was"), F.least("first", "heard").alias("first"))
        jump = now.select(F.col("node").alias("of"), F.col("first").alias("far"))
        after = _stored(step.join(jump, F.col("first") == F.col("of"), "left").select("node", "was", F.least("first", F.coalesce("far", "first")).alias("first")))
        if not after.filter("was <> first").limit(1).count():
            return after.select("node", "first")
        now = after.select("node", "first")
    raise RuntimeError("labels did not settle")


def distinct_rotations(rows: DataFrame, key: str, q: str, *, tolerance: float = 1e-6) -> DataFrame:
    """key and first: the smallest key of the rotations that steps of at most ``tolerance`` join to each row's; a rotation is distinct where they are equal.

    ``q`` is an array of four numbers of any length but 0. Rows of exactly one rotation are put together before any join, so repeats cost
    nothing there. Rows without a rotation (null, a zero or a null part) have a null ``first``.
    """
    numbers = rows.select(F.col(key).alias(key), F.transform(q, lambda c: c.cast("double")).alias("_q")).withColumn("_n", rotations.norm(F.col("_q"), 4))
    unit = numbers.withColumn("_q", F.when(F.col("_n") > 0, F.transform("_q", lambda c: c / F.col("_n"))))
    # one sign for each rotation, so that equal ones are equal rows
    lead = F.coalesce(*[F.when(F.col("_q")[i] != 0, F.signum(F.col("_q")[i])) for i in range(4)])
    unit = _stored(unit.withColumn("_q", F.transform("_q", lambda c: c * lead + 0.0)).drop("_n"))
    classes = _stored(unit.filter("_q IS NOT NULL").groupBy("_q").agg(F.min(key).alias("_least")))
    found = labelled(close_rotations(classes, "_least", "_q", tolerance))
    named = classes.join(found, F.col("_least") == F.col("node"), "left").select("_q", F.coalesce("first", "_least").alias("first"))
    return unit.join(named, "_q", "left").select(key, "first")
