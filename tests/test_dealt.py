"""Tables are dealt over so many tasks as their rows ask for; before, a task grew with the table, and bands were made where the points lay."""

import duckdb
import pytest
from pyspark.sql import functions as F

from linework.functions import geometry
from linework.operators import marks, sequences, spatial
from linework.plans import bundling, pieces, registry, schematic
from linework.sources import adapters as A

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [A.legs, A.polylines])
def test_more_rows_more_tasks(spark, monkeypatch, rows):
    n = rows(spark, DIR).count()
    monkeypatch.setattr(A, "TASK_ROWS", n // 20)
    assert rows(spark, DIR).rdd.getNumPartitions() >= 20
    assert rows(spark, DIR).count() == n


def test_bands_are_dealt(spark, monkeypatch):
    points = spark.createDataFrame([(i * 5, i % 7) for i in range(-100, 100)] * 2, "x long, y long").coalesce(1)
    monkeypatch.setattr(spatial, "BAND_CELLS", 13 * 400 // 20)
    band = spatial.raster_band(points, 2)
    assert band.rdd.getNumPartitions() >= 20
    want = {(i * 5 + a, i % 7 + b) for i in range(-100, 100) for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4}
    assert sorted(map(tuple, band.collect())) == sorted(want)


def test_marks_of_many_stations_are_joined_without_the_driver(spark):
    point = "station_id string, line_id string, x double, y double, ux double, uy double"
    points = spark.createDataFrame([("a", "1", 0.0, 0.0, 1.0, 0.0), ("a", "2", 0.0, 0.0, 0.0, 1.0), ("b", "1", 9.0, 0.0, 1.0, 0.0)], point)
    cross = marks.station_marks(points, 4.0, spark.createDataFrame([("a", 0.0, None)], "station_id string, straighten double, keep string"))
    assert {r.station_id: len(r.lines) for r in cross.collect()} == {"a": 2, "b": 1}
    assert "Broadcast" not in cross._jdf.queryExecution().executedPlan().toString()


def test_curves_are_bundled_once(spark, monkeypatch):
    calls, real = [], bundling.B.curve_bundle
    monkeypatch.setattr(bundling.B, "curve_bundle", lambda *a: (calls.append(a), real(*a))[1])
    bundling.bundled_radii(spark, DIR)
    assert len(calls) == 1


def test_terms_stay_with_their_line(spark):
    """What is shuffled for residuals are a line's unknowns and their values; before, terms and right sides went to their equations' names."""
    terms = spark.createDataFrame([(1, "1:1:x", "x:5", 1.0, 2.0), (1, "1:1:x", "x:4", -1.0, 2.0), (2, "2:1:x", "x:5", 3.0, 0.0), (2, "2:2:x", "none", 1.0, 0.0)], "line_id long, eq string, var string, coef double, rhs double")
    left = schematic.residuals(terms.repartition(4, "line_id"), spark.createDataFrame([("x:5", 7.0), ("x:4", 4.0)], "var string, value double"), "line_id")
    assert {(r.line_id, r.eq): r.residual for r in left.collect()} == {(1, "1:1:x"): 1.0, (2, "2:1:x"): 21.0}
    plan = pieces.layout_residuals(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange hashpartitioning(eq" not in plan


def test_lines_are_resampled_in_one_pass(spark):
    """Before, lines of no length took a second pass over all events, and rounding went through decimal text."""
    plan = registry.resampled(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    points = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 0, 0), (1, 3, 6, 8), (2, 1, 5, 7), (3, 1, 4, 4), (3, 2, 4, 4)], "line_id long, pos long, x long, y long")
    got = sequences.resampled(points, 5.0)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 2, 6.0, 8.0), (2, 0, 5.0, 7.0), (3, 0, 4.0, 4.0)]
    assert sorted(map(tuple, sequences.resampled(points, parts=1).collect())) == [(1, 0, 0.0, 0.0), (1, 1, 6.0, 8.0), (2, 0, 5.0, 7.0), (3, 0, 4.0, 4.0)]


def test_resampled_equals_its_sql_on_users_of_few_events(spark, tmp_path):
    """Before, a user with one event had a row that the SQL leaves out."""
    con = duckdb.connect()
    con.execute(f"create table events as select * from '{DIR}/events.parquet' where user_id % 3 = 0")
    con.execute("delete from events where user_id = 0")
    con.execute(f"insert into events by name select * replace (0 as user_id, 7 as event_id) from '{DIR}/events.parquet' limit 1")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    assert sorted(map(tuple, registry.resampled(spark, str(tmp_path)).select("line_id", "i", "x", "y").collect())) == sorted(con.execute(registry.SQL["resampled"]).fetchall())


def test_decimals_are_those_of_sql(spark):
    """F.round takes 1.0005 for half way; its product with 1,000 lies below."""
    values = [1.0005, 2128897.9365, 0.0005, 2.5, -1.0005, -0.0004, 0.0, 1e15 + 0.5, 12345.6785, 36_000_000.0005, 0.49999999999999994]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(geometry.decimals(F.col("v"), 3)).collect()]
    assert got == [duckdb.execute("select round(?::double, 3)", [v]).fetchone()[0] for v in values]
