"""Lanes, marks and whole drawings of small networks whose geometry is known by hand."""

import pytest
from pyspark.sql import functions as F

from linework.functions import drawing as D
from linework.plans import schematic, whole
from tests.test_schematic import Turn, fix, net


def solved(spark, lines):
    stations, rows, steps = net(spark, lines)
    out = schematic.layout(stations, rows, steps)
    return whole.courses(out, rows), rows


def test_a_stretch_keeps_its_sides(spark):
    """The second line drives the middle edge first and the other way, so it is stored against its neighbours."""
    course, _ = solved(spark, {"M": (270, ["c", "b"]), "X": (90, ["a", "b", "c", "d"]), "Y": (90, ["a", "b", "c", "d"]), "N": (270, ["d", "c"])})
    course = course.where("line_id in ('X', 'Y') or line_id = 'M'")
    lanes = whole.edge_lanes(course.where("line_id <> 'M'"))
    assert {(r.u[2:], r.v[2:], r.line[2:]): r.lane for r in lanes.collect()} == {(*e, k): s for e in ("ab", "bc", "cd") for k, s in (("X", -0.5), ("Y", 0.5))}
    stored = course.withColumn("family", F.when(F.col("line_id") == "M", "X").otherwise(F.col("family")))
    lanes = whole.edge_lanes(stored)
    assert {r.u[2:] + r.v[2:] for r in lanes.collect()} == {"ab", "cb", "cd"}
    off = {(r.line_id[2:], r.pos): r.off for r in whole.lane_legs(stored, lanes).collect()}
    side = off["X", 1]
    assert abs(side) == 0.5 and all(off["X", p] == side and off["Y", p] == -side for p in (1, 2, 3)) and off["M", 1] == -side


def test_corridors_go_before(spark):
    course, _ = solved(spark, {"X": (90, ["a", "b", "c"]), "Y": (90, ["a", "b", Turn(45), fix(2.0), "d"])})
    corridors = spark.createDataFrame([("n", "k", 0, ["b", "a"], {"X": 1.0, "Y": 3.0})], "net_id string, name string, corridor_pos int, steps array<string>, offsets map<string,double>")
    lanes = whole.edge_lanes(course, corridors)
    assert {(r.u[2:] + r.v[2:], r.line[2:]): r.lane for r in lanes.collect()} == {("ab", "X"): -1.0, ("ab", "Y"): -3.0, ("bc", "X"): 0.0, ("bd", "Y"): 0.0}
    legs = whole.lane_legs(course, lanes)
    off = {(r.line_id[2:], r.pos): r.off for r in legs.collect()}
    assert off["X", 2] == -1.0  # straight on a lane goes on
    assert off["Y", 3] == 0.0  # in the turn it changes
    at = {(r.line_id[2:], r.station): (round(r.x, 6), round(r.y, 6)) for r in whole.stops(legs, 0.5).collect()}
    assert at["X", "a"] == (0, -0.5) and at["X", "c"][1] == -0.5 and at["Y", "b"][1] == -1.5


def test_rows_of_a_drawing(spark):
    stations, lines, steps = net(spark, {"X": (90, ["a", "b", "c"]), "Y": (90, ["a", "b"])})
    stations = stations.withColumn("hidden", F.col("id") == "c").withColumn("planned", F.col("id") == "b").withColumn("label", F.concat(F.lit("<"), "id"))
    over = spark.createDataFrame([("n", "X", "Y")], "net_id string, upper string, lower string")
    rows = whole.map_rows(stations, lines, steps, over=over).orderBy("level", "place").collect()
    assert [(r.level, r.id) for r in rows] == [(1, "Y"), (1, "X"), (2, "a"), (2, "b"), (3, "a"), (3, "b")]
    assert 'd="M 0.000 4.000 L 20.000 4.000 L 40.000 4.000"' in rows[1].text
    assert 'opacity="0.5"' in rows[3].text and 'opacity="0.5"' not in rows[2].text and ">&lt;a</text>" in rows[4].text


def test_course_path(spark):
    def text(*pts):
        col = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(r).cast("double").alias("r"), F.lit(c).alias("curve")) for x, y, r, c in pts])
        return spark.range(1).select(col.alias("p")).select(D.course_path("p").alias("d")).first().d

    assert text((0, 0, None, False), (4, 0, None, False)) == "M 0.000 0.000 L 4.000 0.000"
    assert text((0, 0, None, False), (10, 0, 2, False), (10, 10, None, False)) == "M 0.000 0.000 L 8.000 0.000 A 2.000 2.000 0 0 1 10.000 2.000 L 10.000 10.000"
    assert text((0, 0, None, False), (4, 0, None, False), (8, 2, None, True), (9, 2, None, False)) == "M 0.000 0.000 L 4.000 0.000 C 6.000 0.000 6.000 2.000 8.000 2.000 L 9.000 2.000"
    assert text((0, 0, None, False), (4, 0, None, True)) == "M 0.000 0.000 C 2.000 0.000 2.000 0.000 4.000 0.000"
    assert text((1, 1, None, False)) == "M 1.000 1.000"
