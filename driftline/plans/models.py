"""A model of windows: trained over the table, written as a weight file, imported and applied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions.scalars import half_even as r
from driftline.operators import inference, sequential
from driftline.sources.storage import shared_path
from driftline.sources.tables import events

from . import query

SIZE, STRIDE = 20, 5
#: A bank of filters over (value, bearing): level, rise, bend of the values, rise of the bearing.
BANK = [
    {"kind": "conv", "weight": [[[0.2] * 5, [0.0] * 5], [[0.0, -0.5, 0.0, 0.5, 0.0], [0.0] * 5], [[0.0, 1.0, -2.0, 1.0, 0.0], [0.0] * 5], [[0.0] * 5, [0.0, -0.5, 0.0, 0.5, 0.0]]], "bias": [0.0] * 4, "stride": 1, "padding": 2},
    {"kind": "leaky", "slope": 0.1},
    {"kind": "pool"},
    {"kind": "join"},
]
N_FEATURES = 2 * 4 + 3


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fifth window of twenty rows of a session with its statistics, and the value that comes next."""
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    frame = w.rowsBetween(1 - SIZE, 0)
    ev = events(spark, sf_dir).select("user_id", "event_id", "t_us", (F.col("value") / 100).alias("v"), (F.col("bearing") / 360).alias("b"))
    stats = F.array(F.avg("v").over(frame), F.stddev_pop("v").over(frame), F.max("v").over(frame))
    rows = ev.select("event_id", F.row_number().over(w).alias("k"), F.collect_list(F.array("v", "b")).over(frame).alias("window"), stats.alias("stats"), F.lead("v").over(w).alias("y"))
    return rows.filter((F.col("k") >= SIZE) & ((F.col("k") - SIZE) % STRIDE == 0))


def head(features: DataFrame) -> list[dict]:
    """A linear head by least squares over all rows, from sums that Spark combines; a small ridge keeps it solvable."""
    x = [f"x{i}" for i in range(N_FEATURES + 1)]
    flat = features.select(F.lit(0).alias("one"), *[F.col("output")[i].alias(c) for i, c in enumerate(x[:-1])], F.lit(1.0).alias(x[-1]), "y")
    ridge = flat.sparkSession.createDataFrame([(0, *[0.1 * (i == j) for j in range(len(x))], 0.0) for i in range(len(x))], flat.schema)
    row = sequential.solved(flat.union(ridge), ["one"], x, "y", condition=1e15).first()
    beta = [float(row[f"b_{c}"]) for c in x]
    return [{"kind": "dense", "weight": [beta[:-1]], "bias": [beta[-1]]}]


@query()
def window_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a convolution, pooling and a head trained on all windows say of the next value; the weights pass through a file and its digest."""
    rows = windows(spark, sf_dir)
    known = rows.filter("y IS NOT NULL")
    features = inference.predicted(known, "event_id", "window", "stats", BANK).join(known.select("event_id", "y"), "event_id")
    path = shared_path(spark, "weights")
    inference.write_network(spark, path, [*BANK, *head(features)])
    out = inference.predicted(rows, "event_id", "window", "stats", inference.read_network(spark, path))
    return out.select("event_id", r(F.col("output")[0], 5).alias("next_value"))
