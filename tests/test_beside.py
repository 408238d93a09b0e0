"""Names and signs beside tracks, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from linework.errors import GeometryError
from linework.operators import beside as B

NAMES = "name_id int, line_id string, text string, ax double, ay double, bx double, by double, side string, shift double, start double"


@pytest.fixture(scope="module")
def tracks(spark):
    """A level track from 0 to 200, one above it that ends at 80 and one below it that starts at 150."""
    rows = [("L", 0, 0.0, 0.0), ("L", 1, 200.0, 0.0), ("M", 0, 0.0, -4.0), ("M", 1, 80.0, -4.0), ("N", 0, 150.0, 4.0), ("N", 1, 200.0, 4.0)]
    return B.track(spark.createDataFrame(rows, "line_id string, pos int, x double, y double"))


def placed(spark, tracks, *rows):
    names = spark.createDataFrame([(i, "L", *r) for i, r in enumerate(rows)], NAMES)
    pieces = B.pieces(tracks, B.middles(tracks, names))
    return names, pieces, B.sides(tracks, names, pieces)


def test_side_and_room(spark, tracks):
    # two lines at 40: the bundle reaches 4 to the upper side, which is left of the direction; back from b to a it is right
    names, _, sides = placed(spark, tracks, ("ii", 20.0, 1.0, 60.0, 1.0, None, None, None), ("ii", 60.0, 1.0, 20.0, 1.0, None, None, None), ("ii", 160.0, 0.0, 180.0, 0.0, "right", 0.0, None))
    got = {r["name_id"]: (r["x"], r["y"], round(r["left"], 6), round(r["right"], 6), r["side"], r["flip"]) for r in sides.collect()}
    # pieces of 7.8 have an odd number of places around the middle
    assert got[0] == (40.0, 0.0, 7.8, 3.8, 1, False)
    assert got[1] == (40.0, 0.0, 3.8, 7.8, 1, True)
    assert got[2] == (170.0, 0.0, 3.8, 7.8, -1, False)


def test_letters(spark, tracks):
    names, pieces, sides = placed(spark, tracks, ("i i", 100.0, 0.0, 120.0, 0.0, "left", None, None), ("ii\nii", 120.0, 0.0, 100.0, 0.0, "left", None, None), ("i", 100.0, 0.0, 140.0, 0.0, "left", 5.0, 10.0))
    got = {}
    for r in B.letters(names, pieces, sides).collect():
        got.setdefault((r["name_id"], r["row"]), []).append((r["k"], round(r["x"], 4), round(r["y"], 4), round(r["angle"], 4)))
    i, space = 0.2575 * 9, 0.2786 * 9
    assert sorted(got[0, 0]) == [(0, round(110 - (i + space) / 2, 4), -3.8, 0.0), (2, round(110 + (i + space) / 2, 4), -3.8, 0.0)]
    # towards the left the left side is below; letters still run from left to right, the last row next to the track
    assert [(k, x, y) for k, x, y, _ in sorted(got[1, 1])] == [(0, round(110 - i / 2, 4), round(3.8 + 6.48, 4)), (1, round(110 + i / 2, 4), round(3.8 + 6.48, 4))]
    assert [y for _, _, y, _ in got[1, 0]] == [round(3.8 + 6.48 + 9.9, 4)] * 2
    assert got[2, 0][0][0] == 0 and abs(got[2, 0][0][1] - (100 + 10 + i / 2 + 5)) < 1  # the piece's places are one apart


def test_blocks_move_out(spark, tracks):
    # a line at 4 below: the box grown by one must start below it, so it stands three further out than the room asks for without it
    names, _, sides = placed(spark, tracks, ("ii", 20.0, 0.0, 60.0, 0.0, "right", None, None), ("ii", 160.0, 0.0, 180.0, 0.0, "right", None, None))
    sides = sides.withColumn("right", F.lit(1.5))
    got = {r["name_id"]: (round(r["y"], 4), r["anchor"]) for r in B.blocks(names, sides, tracks).collect()}
    assert got == {0: (round(1.5 + 9.9 - 2.7, 4), "middle"), 1: (round(5.5 + 9.9 - 2.7, 4), "middle")}


def test_ring_badges(spark, tracks):
    names, _, sides = placed(spark, tracks, ("ii", 20.0, 0.0, 60.0, 0.0, None, None, None))
    rings = spark.createDataFrame([(0, 0, "M", False, None), (0, 1, "L", True, None)], "name_id int, ring_pos int, line_id string, against boolean, shift double")
    out = B.outside(tracks, rings, sides)
    assert [r["side"] for r in out.collect()] == [-1]  # the ring's line lies above, so the name stands below
    got = {r["line_id"]: r for r in B.ring_badges(tracks, rings, out, 8.0, 3.0, 12.0).collect()}
    # inside is above, beyond the bundle: 7.8 to the arrows' edge
    assert [(got[k]["ahead"], got[k]["x"], round(got[k]["y"], 4), round(got[k]["arrow"], 4), got[k]["angle"]) for k in "LM"] == [(False, -11.0, -27.3, -11.3, 0.0), (True, 1.0, -27.3, -11.3, 0.0)]


def test_pointing(spark, tracks):
    names, _, sides = placed(spark, tracks, ("ii\ni", 20.0, 0.0, 60.0, 0.0, None, None, None))
    rows, arrows = B.pointing(names.withColumn("dx", F.lit(30.0)).withColumn("dy", F.lit(20.0)), sides)
    assert sorted((r["row"], r["x"], round(r["y"], 4), r["anchor"]) for r in rows.collect()) == [(0, 70.0, round(20 + 9.9 - 2.7, 4), "start"), (1, 70 + 0.2575 * 9, round(20 + 19.8 - 2.7, 4), "middle")]
    a = arrows.collect()[0]
    assert (a["ax"], a["ay"], a["kx"], a["ky"], a["tx"], a["ty"]) == (68.0, 24.95, 40.0, 24.95, 40.0, 9.0)
    assert {tuple(round(v, 4) for v in a[c]) for c in "pq"} == {(38.4, 12.0), (41.6, 12.0)}


def test_served(spark):
    steps = spark.createDataFrame([("S2", 2, 0, "a"), ("S2", 2, 1, "b"), ("S1", 1, 0, "c"), ("S1", 1, 1, "b"), ("S1", 1, 2, "a")], "line_id string, line_pos int, pos int, station_id string")
    names = spark.createDataFrame([(0, "a", "b", None), (1, "a", "b", "S2"), (2, "b", "c", None)], "name_id int, a string, b string, line_id string")
    assert sorted((r["name_id"], r["line_id"]) for r in B.served(names, steps).collect()) == [(0, "S1"), (1, "S2"), (2, "S1")]
    with pytest.raises(GeometryError):
        B.served(names.limit(0).unionByName(spark.createDataFrame([(3, "a", "c", None)], names.schema)), steps)


def test_empty(spark, tracks):
    names, pieces, sides = placed(spark, tracks.limit(0), ("ii", 20.0, 0.0, 60.0, 0.0, None, None, None))
    assert B.letters(names, pieces, sides).count() == 0 == B.blocks(names, sides, tracks).count()
