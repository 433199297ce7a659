"""Every query against its SQL on DuckDB, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from driftline import plans

plans.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(table):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return (0, "")
        return (1, f"{round(x, 9) + 0.0:.9f}") if isinstance(x, float) else (1, str(x))

    names = sorted(table.column_names)
    return sorted(tuple(cell(r[n]) for n in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(name, spark, sf, duck):
    ours = plans.QUERIES[name](spark, sf).toArrow()
    theirs = duck.sql(plans.ORACLE_SQL[name]).arrow()
    theirs = theirs.read_all() if hasattr(theirs, "read_all") else theirs
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    # at this scale a figure can stand on a rounding edge: one unit of its last place may differ
    a, b = rows_of(ours), rows_of(theirs)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for (_, p), (_, q) in zip(x, y, strict=True):
            assert p == q or abs(float(p) - float(q)) <= 1.1e-2 * max(1.0, abs(float(q)) * 1e-6)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(name, spark, sf):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_registered():
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    root = os.path.dirname(plans.__file__) + "/.."
    for folder, _, names in os.walk(root):
        if "/llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                with open(f"{folder}/{n}") as f:
                    assert "llm" not in f.read()


@pytest.mark.parametrize("name", ["point_to_segment", "top8_nearest"])
def test_equally_far_roads_come_as_in_sql(name, spark, sf, tmp_path):
    """Two fixes whose nearest corner two roads share: the last digit of the distance says which comes first."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT a AS event_id, TIMESTAMP '2024-01-01' AS ts, a // 9000 AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '' AS props FROM (SELECT unnest([126259, 306009]) AS a)")
    con.execute(f"CREATE TABLE nation AS SELECT * FROM '{sf}/nation.parquet'")
    for t in ("events", "nation"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    ours = plans.QUERIES[name](spark, str(tmp_path)).toArrow()
    theirs = con.sql(plans.ORACLE_SQL[name]).to_arrow_table()
    assert rows_of(ours) == rows_of(theirs) and ours.num_rows
