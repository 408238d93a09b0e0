"""Dots, rings and dots at hubs, worked out by hand."""

import pytest

from linework.operators import signs as S

CALLS = "map_id int, line_id string, pos int, station_id string, x double, y double, ux double, uy double"


@pytest.fixture(scope="module")
def tables(spark):
    stations = [(0, "h", "hub", False, 10.0, 0.0), (0, "a", "station", False, 0.0, 0.0), (0, "b", "station", True, 20.0, 0.0), (0, "u", "station", False, 5.0, 5.0), (0, "v", "station", None, 10.0, 9.0), (0, "k", "hub", False, 30.0, 30.0)]
    calls = [
        (0, "A", 0, "a", 0.0, 0.0, 1.0, 0.0), (0, "A", 1, "h", 11.0, 0.0, 1.0, 0.0),  # ends in the hub behind both lines that cross there
        (0, "B", 0, "v", 9.0, 9.0, 0.0, -1.0), (0, "B", 1, "h", 9.0, 0.0, 0.0, -1.0), (0, "B", 2, "b", 9.0, -9.0, 0.0, -1.0),
        (0, "C", 0, "v", 9.04, 9.04, 0.0, -1.0), (0, "C", 1, "h", 10.0, 0.0, 0.0, -1.0), (0, "C", 2, "b", 10.0, -9.0, 0.0, -1.0),
        (0, "D", 0, "k", 31.0, 32.0, 1.0, 0.0), (0, "D", 1, "a", 0.0, 1.0, 1.0, 0.0), (0, "R", 0, "a", 0.0, 0.0, 1.0, 0.0), (0, "R", 1, "v", 9.0, 20.0, 1.0, 0.0),
    ]
    lines = [(0, "A", False, None), (0, "B", False, "v"), (0, "C", None, None), (0, "D", False, None), (0, "R", True, None)]
    return (
        spark.createDataFrame(calls, CALLS),
        spark.createDataFrame(stations, "map_id int, station_id string, kind string, hidden boolean, x double, y double"),
        spark.createDataFrame(lines, "map_id int, line_id string, closed boolean, branch_join string"),
    )


def test_dots(tables):
    calls, stations, _ = tables
    got = {(r["station_id"], r["line_id"], r["x"], r["y"]) for r in S.dots(calls, stations).collect()}
    assert got == {("a", "A", 0.0, 0.0), ("a", "D", 0.0, 1.0), ("v", "B", 9.0, 9.0), ("v", "R", 9.0, 20.0), ("u", None, 5.0, 5.0)}  # R's at a is A's, C's at v is B's


def test_rings(tables):
    calls, stations, lines = tables
    got = {(r["station_id"], r["line_id"]) for r in S.rings(S.ends(calls, lines), stations).collect()}
    assert got == {("a", "A"), ("b", "B"), ("v", "C"), ("b", "C"), ("a", "D")}  # not where B runs into its main line, none of the ring


def test_hub_ends(spark, tables):
    calls, stations, lines = tables
    pills = spark.createDataFrame([(0, "h", 10.0, 0.0, 0.0, 1.0), (0, "k", 30.0, 30.0, 1.0, 0.0)], "map_id int, station_id string, x double, y double, nx double, ny double")
    got = {(r["station_id"], r["line_id"]): (r["x"], r["y"], r["met"]) for r in S.hub_ends(S.ends(calls, lines), calls, stations, pills).collect()}
    # A comes from the left and meets B first; D meets none and goes onto the pill's axis
    assert got == {("h", "A"): (9.0, 0.0, True), ("k", "D"): (31.0, 30.0, False)}
