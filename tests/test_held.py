"""Tasks of a layout hold less: legs are the steps that end them, and legs meet their lines' heads without being sorted for it."""

import pytest

from linework import schema
from linework.errors import GeometryError
from linework.operators import graph
from linework.plans import pieces, schematic
from tests.test_schematic import Turn, fix, flex, net


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_are_sorted_once_for_their_legs(spark):
    """Before, all steps were sorted again to be grouped, and the legs once more behind their lines."""
    _, lines, steps = net(spark, {"1": (0, ["a", Turn(45), "b", fix(2.0), "c"])})
    plan = plan_of(schematic.legs(lines, steps))
    assert "Aggregate" not in plan and plan.count("- Sort [") == 3  # steps, legs, lines


def test_legs_meet_their_heads_unsorted(spark):
    _, lines, steps = net(spark, {"1": (0, ["a", flex(3.0), Turn(45), "b"]), "2": (0, ["b", "c"])})
    legs = graph.kept(schematic.legs(lines, steps).drop("paths"))
    bearings = lines.select("net_id", "line_id", schematic.F.lit(0).alias("bearing"))
    solved = schematic.solve(lines, legs, bearings)
    plan = plan_of(solved)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert {r.station for r in solved.where("station is not null").collect()} == {"a", "b", "c"}


def test_legs_of_odd_steps(spark):
    """Steps that hold two things, two paths on a leg, steps before the first station, null keys: legs as they always were."""
    path = lambda length, group=None: (length, None, None, True, 1.0, group)
    steps = [
        ("n", "1", 0, "path", None, None, None, path(9.0)), ("n", "1", 1, "station", "a", 45, 0.7, path(2.0)), ("n", "1", 2, "path", None, None, None, path(3.0)), ("n", "1", 3, "path", None, None, None, path(4.0, "g")),
        ("n", "1", 4, "station", "b", None, None, None), ("n", "1", 5, "path", None, None, 2.0, None), ("n", "1", 6, "turn", None, -45, None, None), ("n", "1", 7, "station", "c", None, None, path(5.0)), ("n", "1", 8, "turn", None, 90, None, None),
        ("n", "2", None, "station", "a", None, None, None), ("n", "2", 3, "station", "b", None, None, None), ("n", "3", 1, "turn", None, 45, None, None),
        (None, "1", 1, "station", "a", None, None, None), (None, "1", 2, "station", "b", None, None, None), ("n", None, 1, "station", "a", None, None, None), ("n", None, 2, "station", "b", None, None, None),
    ]
    lines = [(n, i, k, "#000", None, None, 1.2, None, False, None, None) for k, (n, i) in enumerate([("n", "1"), ("n", "2"), ("n", "3"), (None, "1"), ("n", None)])]
    found = schematic.legs(spark.createDataFrame(lines, schema.LINE), spark.createDataFrame(steps, schema.STEP))
    got = found.select("line_id", "seg", "leg", "a", "b", "offset", "preferred", "minimum", "maximum", "group", "delta", "radius", "forced", "paths").collect()
    inf, room, stiff = float("inf"), 0.2899494936611665, 0.8284271247461901
    want = [
        ("1", 1, 0, "a", "b", 0, 2.0, room, inf, None, None, None, None, 1), ("1", 1, 1, "a", "b", 45, 4.0, room, inf, "g", 45, 0.7, True, 2),
        ("1", 2, 0, "b", "c", 45, stiff, stiff, stiff, None, None, None, None, 0), ("1", 2, 1, "b", "c", 0, stiff, stiff, stiff, None, -45, 2.0, True, 0),
        ("2", 1, 0, "a", "b", 0, 1.2, 0.2, 1.2, None, None, None, None, 0),
    ]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("stations", "wrong"), [(["a", "b", "c", "a"], None), (["a", "b", "c"], "doesn't end where it starts"), (["a", "b", "a", "c"], "doesn't end where it starts"), (["a", "b", "c", "b", "a"], "calls at a station twice")])
def test_closed_lines_end_where_they_start(spark, stations, wrong):
    rows = net(spark, {"1": (0, stations, {"closed": True})})
    if wrong is None:
        schematic.check_definitions(*rows)
    else:
        with pytest.raises(GeometryError, match=wrong):
            schematic.check_definitions(*rows)


def test_terms_are_not_dealt_again_for_their_values(spark):
    """Before, terms or values were dealt by line twice wherever the number of tasks wasn't that of the setting."""
    schema_ = "line_id long, eq string, var string, coef double, rhs double"
    rows = [(1, "e", "a", 1.0, 2.0), (1, "e", "b", -1.0, 2.0), (1, "e", "b", -1.0, 2.0), (1, "f", None, 1.0, 0.0), (2, "g", "a", 3.0, None), (2, "h", "z", 1.0, 0.0), (None, "i", "a", 1.0, 1.0)]
    terms, given = spark.createDataFrame(rows, schema_), spark.createDataFrame([("a", 7.0), ("b", 4.0), (None, 5.0)], "var string, value double")
    assert graph.dealt_over(terms, "line_id") is None
    for n in (2, 31):
        dealt = terms.repartition(n, "line_id")
        assert graph.dealt_over(dealt, "line_id") == n and graph.dealt_over(dealt, "line") is None
        left = schematic.residuals(dealt, given, "line_id")
        assert plan_of(left).count("hashpartitioning(line_id#") == 3  # terms, terms that ask, values
        assert {(r.line_id, r.eq): r.residual for r in left.collect()} == {(1, "e"): -3.0, (2, "g"): None}
    assert {(r.line_id, r.eq): r.residual for r in schematic.residuals(terms, given, "line_id").collect()} == {(1, "e"): -3.0, (2, "g"): None}
    spark.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism + 3)
    try:
        assert "Exchange hashpartitioning(line_id#" in (plan := plan_of(pieces.layout_residuals(spark, "/root/testdata/sf0.001"))) and plan.count("Exchange hashpartitioning(line_id#") == 1
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
