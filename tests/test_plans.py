"""Physical plans: no cross joins, filters and columns at the scan, no needless Python."""

import re

import pytest
from pyspark.sql import functions as F

from driftline import plans
from driftline.operators import temporal
from driftline.sources.tables import events

plans.load()
STREAMS = {n for n in plans.QUERIES if n.startswith("stream_")}
#: What runs numpy in tasks, and why it must: sequential state, small solves, trellises, networks.
NUMPY = {"hmm_match", "strapdown", "position_filter", "mount_slips", "least_squares", "sensor_pairs", "doppler_solve", "mlp_inference", "trellis_match", "greedy_match", "inertial_filter", "inertial_arms", "strapdown_navigation", "window_model", "in_motion_mount"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - STREAMS))
def test_no_cross_join_and_python_only_where_it_must(name, spark, sf):
    p = plan(plans.QUERIES[name](spark, sf))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", p)
    assert bool(re.search("Python|InPandas|InArrow|ArrowEval", p)) == (name in NUMPY)


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(plans.QUERIES["arm_summary"](spark, sf))
    assert "LessThanOrEqual(l_shipdate" in p and "l_comment" not in p
    p = plan(plans.QUERIES["asof_backward"](spark, sf))
    assert "EqualTo(event_type,click)" in p and "props" not in p


def test_asof_join_shuffles_once(spark, sf):
    ev = events(spark, sf).select("user_id", "t_us", "value")
    p = plan(temporal.asof_join(ev, ev.filter("value > 5"), ["user_id"], "t_us"))
    assert len(re.findall(r"\bExchange hashpartitioning", p)) == 1


def test_counts_are_combined_before_the_shuffle(spark, sf):
    p = plan(plans.QUERIES["repeat_values"](spark, sf))
    assert "partial_count" in p
    p = plan(plans.QUERIES["staleness_grid"](spark, sf).select(F.col("bound")))
    assert "CartesianProduct" not in p
