"""Legends, worked out by hand."""

from linework.operators import legend as G


def made(spark, y, ink=()):
    badges = spark.createDataFrame([(0, 0, 0, "S41"), (0, 0, 1, "S42"), (0, 1, 0, "S1")], "legend_id int, block int, badge_pos int, line_id string")
    rows = [(0, 0, 0, "i", "ii", 4, 0, None, None), (0, 1, 0, "i", "ii", 4, 2, "x", 2), (0, 1, 1, "i", "ii", 1, None, "", None)]
    trains = spark.createDataFrame(rows, "legend_id int, block int, row int, kind string, route string, cars int, hollow int, note string, note_cars int")
    places = spark.createDataFrame([(0, 100.0, y)], "legend_id int, x double, y double")
    boxes = spark.createDataFrame([(0, *b) for b in ink], "legend_id int, x0 double, y0 double, x1 double, y1 double")
    blocks = G.blocks(badges, trains)
    box = G.boxes(places, G.widths(badges, trains), blocks, boxes)
    return box.collect()[0], G.elements(badges, trains, blocks, box).collect()


def test_table(spark):
    box, rows = made(spark, 50.0)
    # heading 18; two badges 36; two rows 18 + 14; one note 18
    assert (box["y0"], box["bottom"], box["y1"]) == (50.0, 50 + 18 + 36 + 32, 50 + 18 + 36 + 32 + 18)
    assert round(box["w0"], 6) == max(4 * 6 + 6, round(6.3, 6)) + 10 and box["x1"] > box["x0"] + 100
    at = {}
    for r in rows:
        at.setdefault(r["kind"], []).append((r["block"], r["place"], round(r["x"], 4), round(r["y"], 4), r["text"]))
    assert sorted(at["badge"]) == [(0, 0, 105.0, 70.0, "S 41"), (0, 1, 105.0, 87.0, "S 42"), (1, 0, 105.0, 112.5, "S 1")]
    # one row in the middle of two badges; two rows fourteen apart around the middle of their block
    assert [r[3] for r in sorted(at["train"])] == [68 + 18 + 3.5, 104 + 16 - 7 + 3.5, 104 + 16 + 7 + 3.5]
    assert [(b, p, t) for b, p, _, _, t in sorted(at["car"])] == [(0, k, "full") for k in range(4)] + [(1, 0, "full"), (1, 1, "full"), (1, 2, "hollow"), (1, 3, "hollow"), (1, 10, "full")]
    assert len(at["star"]) == 1 and at["note"][0][3:] == (136 + 12.96, "* x") and len(at["note car"]) == 2
    assert sorted((r[0], r[3]) for r in at["rule"]) == [(0, 68.0), (0, 104.0), (1, 136.0)] and len(at["column"]) == 3


def test_hangs_above_what_is_below(spark):
    height = 18 + 36 + 32 + 18
    box, _ = made(spark, None, [(0.0, 10.0, 100.0, 20.0), (110.0, 400.0, 120.0, 410.0), (90.0, 300.0, 101.0, 310.0)])
    assert box["y0"] == 300 - 36 - height  # the first ends where the legend begins
    assert made(spark, None)[0]["y0"] == 0.0
