"""Map layers, rail filters, marks and drawings on small inputs worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from linework.definitions import Place, ring_leg, trains
from linework.errors import GeometryError
from linework.functions import drawing as D
from linework.operators import marks, overlay, spatial
from linework.plans import maps
from linework.sources import osm


def ring(x, y, size):
    return [{"lon": x + a, "lat": y + b} for a, b in ((0, 0), (size, 0), (size, size), (0, size), (0, 0))]


ELEMENTS = [
    {"type": "way", "id": 1, "tags": {"railway": "light_rail"}, "geometry": [{"lon": 0, "lat": 0}, None, {"lon": 1, "lat": 0}]},
    {"type": "way", "id": 2, "tags": {"railway": "rail", "service": "yard"}, "geometry": [{"lon": 0, "lat": 1}, {"lon": 1, "lat": 1}]},
    {"type": "way", "id": 3, "tags": {"railway": "rail"}, "geometry": [{"lon": 0, "lat": 2}, {"lon": 1, "lat": 2}]},
    {"type": "way", "id": 4, "tags": {"highway": "primary"}, "geometry": [{"lon": 0, "lat": 3}, {"lon": 1, "lat": 3}]},
    {"type": "node", "id": 8, "lon": 0.5, "lat": 0.5, "tags": {"name": "Stop", "railway": "stop"}},
    {"type": "node", "id": 9, "lon": 0.7, "lat": 0.5, "tags": {"name": "Halt", "railway": "halt"}},
    {"type": "node", "id": 10, "lon": 0.7, "lat": 0.5, "tags": {"name": "Tree"}},
    {"type": "relation", "id": 20, "tags": {"route": "train", "ref": "S7"}, "members": [{"type": "way", "ref": 3, "role": ""}, {"type": "way", "ref": 4, "role": ""}, {"type": "node", "ref": 8, "role": "stop"}]},
    {"type": "relation", "id": 21, "tags": {"route": "bus", "ref": "S7"}, "members": [{"type": "way", "ref": 2, "role": ""}, {"type": "node", "ref": 10, "role": "stop"}]},
]


@pytest.fixture
def elements(spark, tmp_path):
    query = "q1"
    answers = spark.createDataFrame([(query, json.dumps({"elements": ELEMENTS})), ("other", json.dumps({"elements": []}))], "query string, document string")
    osm.store(answers, f"{tmp_path}/answers")
    return osm.stored(spark, f"{tmp_path}/answers", query)


def test_answers_are_found_by_their_query(elements):
    assert elements.count() == len(ELEMENTS)


def test_rails_and_relations(elements):
    assert {r.way_id: len(r.pts) for r in osm.rails(elements).collect()} == {1: 2, 3: 2}
    assert sorted(r.id for r in osm.line_tracks(elements).collect()) == [1, 3]
    assert sorted(r.id for r in osm.line_stops(elements).collect()) == [8, 9]


def test_layers_to_svg(spark):
    layer = "struct<name:string,kind:string,fill:string,stroke:string,width:double,dash:string,opacity:double,min_area:double>"
    layers = spark.createDataFrame([("m", 0, ("water", "area", "#00f", None, 1.0, None, 1.0, 9.0)), ("m", 1, ("road", "line", None, "#999", 2.5, "4 2", 0.5, 0.0)), ("m", 2, ("none", "line", None, "#111", 1.0, None, 1.0, 0.0))], f"map_id string, layer_pos int, layer {layer}")
    pts = "array<struct<x:double,y:double>>"
    lines = spark.createDataFrame([("m", 1, 0, [(0.0, 0.0), (5.0, 0.01), (10.0, 0.0)]), ("m", 1, 1, [(500.0, 0.0), (600.0, 0.0)])], f"map_id string, layer_pos int, shape_pos int, pts {pts}")
    square = lambda s, at=0.0: [(at, at), (at + s, at), (at + s, at + s), (at, at + s), (at, at)]
    areas = spark.createDataFrame([("m", 0, 0, 0, square(20.0)), ("m", 0, 0, 1, square(2.0, 5.0)), ("m", 0, 1, 0, square(2.0)), ("m", 0, 2, 0, square(9.0, 900.0))], f"map_id string, layer_pos int, shape_pos int, ring_pos int, pts {pts}")
    paths = maps.layer_paths(layers, lines, areas, 100.0, 80.0)
    got = {r.layer_pos: r.d for r in paths.collect()}
    assert got == {0: "M0 0l20 0 0 20 -20 0zM5 5l2 0 0 2 -2 0z", 1: "M0 0l10 0", 2: ""}
    overlay_ = spark.createDataFrame([("m", 1, "a", "<b/>"), ("m", 0, "z", "<a/>")], "map_id string, level int, id string, text string")
    svg = maps.basemap(paths, overlay_, 100.0, 80.0, attribution="© A & B").first().svg
    assert svg.split("\n") == [
        '<svg xmlns="http://www.w3.org/2000/svg" width="100" height="80" viewBox="0 0 100.0 80.0">',
        '<defs><clipPath id="window"><rect width="100.0" height="80.0"/></clipPath></defs>',
        '<rect width="100.0" height="80.0" fill="#ffffff"/>', '<g id="basemap" clip-path="url(#window)">',
        f'<path id="water" fill="#00f" fill-rule="evenodd" d="{got[0]}"/>',
        '<path id="road" fill="none" stroke="#999" stroke-width="2.5" stroke-linecap="round" stroke-linejoin="round" stroke-dasharray="4 2" opacity="0.5" d="M0 0l10 0"/>',
        '<path id="none" fill="none" stroke="#111" stroke-width="1" stroke-linecap="round" stroke-linejoin="round" d=""/>',
        "</g>", '<g clip-path="url(#window)">', "<a/>", "<b/>", "</g>",
        '<text x="92.0" y="72.0" text-anchor="end" font-family="sans-serif" font-size="11" fill="#777">© A &amp; B</text>', "</svg>",
    ]


def test_projection_of_shapes(spark):
    shapes = spark.createDataFrame([([(13.45455, 52.52542)],)], "pts array<struct<lon:double,lat:double>>")
    (p,) = maps.projected(shapes, 10.0, 8.0, 500.0).first().pts
    assert (round(p.x, 6), round(p.y, 6)) == (250.0, 200.0)


def test_rounded_points_follow_the_arc(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (20.0, 10.0)], [0.0, 4.0, 0.0, 0.0])], "pts array<struct<x:double,y:double>>, radii array<double>")
    row = df.select(D.rounded_points("pts", "radii", 8).alias("p"), D.rounded_path("pts", "radii").alias("d"), D.straight_path(F.col("pts")).alias("s")).first()
    assert row.d == "M 0.000 0.000 L 6.000 0.000 A 4.000 4.000 0 0 1 10.000 4.000 L 10.000 10.000 L 20.000 10.000"
    assert row.s.startswith("M 0.000 0.000 L 10.000 0.000 L ")
    assert len(row.p) == 1 + 9 + 2
    assert all(abs(math.hypot(p.x - 6, p.y - 4) - 4) < 1e-9 for p in row.p[1:10])
    arc = df.select(D.circle_arc(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(-1.0), F.lit(2.0)).alias("p")).first().p
    assert len(arc) == 5 and (round(arc[-1].x, 9), round(arc[-1].y, 9)) == (2.0, -2.0)


def test_drawn_text(spark):
    one = spark.range(1).select(
        D.car_svg(F.lit(1), F.lit(2), 10.0, 4.0, F.lit(False)).alias("car"), D.line_svg(F.lit("S<1"), F.lit("#abc"), F.lit("M0 0"), 3.0).alias("line"),
        D.shift_bezier(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(4.0), F.lit(1.0)).alias("c"),
    ).first()
    assert one.car == '<polygon points="4.6,2.0 11.0,2.0 11.0,6.0 1.0,6.0" fill="white" stroke="#111111" stroke-width="1.0"/>'
    assert one.line == '<path stroke="#ffffff" stroke-width="4.5" d="M0 0"/>\n<path id="line-S&lt;1" stroke="#abc" stroke-width="3" d="M0 0"/>'
    assert one.c == "C 2.000 0.000 2.000 1.000 4.000 1.000"


def test_marks(spark):
    points = spark.createDataFrame([("a", "1", 0.0, 0.0, 1.0, 0.0), ("a", "2", 0.0, 4.0, -1.0, 0.0), ("a", "3", 0.0, 8.0, 1.0, 0.1), ("a", "4", 0.0, 30.0, 1.0, 0.0), ("b", "1", 0.0, 2.0, 0.0, 1.0)], "station_id string, line_id string, x double, y double, ux double, uy double")
    got = {(r.station_id, tuple(r.lines)): (round(r.x, 6), round(r.y, 6), round(r.length, 6)) for r in marks.pills(points, 4.0).collect()}
    assert got == {("a", ("1", "2", "3")): (0.0, 4.0, 8.0), ("a", ("4",)): (0.0, 30.0, 0.0), ("b", ("1",)): (0.0, 2.0, 0.0)}
    ends = [("k", "1", 0.0, 2.0, 1.0, 0.0), ("k", "2", 0.0, -2.0, 1.0, 0.0), ("k", "3", 10.0, 0.0, 0.6, 0.8)]
    cross = marks.station_marks(points.union(spark.createDataFrame(ends, points.schema)), 4.0, spark.createDataFrame([("k", 1.0, "1"), ("b", 1.0, None)], "station_id string, straighten double, keep string"))
    k = cross.where("station_id = 'k'").collect()
    assert len(k) == 1 and k[0].lines == ["1", "2", "3"] and (round(k[0].x, 6), round(k[0].y, 6)) == (10.0, 0.0)
    assert {(round(p.x, 6), round(p.y, 6)) for p in k[0].corners} == {(10.0, 2.0), (10.0, -2.0)}  # the third line has no width, and its axis turned to the first one's direction
    assert cross.where("station_id = 'b'").first().corners is None and cross.count() == 4
    sizes = cross.where("station_id = 'a' and size(lines) = 3").select(marks.mark_reach(1.0).alias("r"), marks.mark_extent(F.lit(1.0), F.lit(0.0), 1.0).alias("e"), F.array(*marks.mark_box(1.0)).alias("b"), marks.mark_points(1.0).alias("p")).first()
    assert (sizes.r, sizes.e) == (5.0, 1.0) and sizes.b == [-1.0, -1.0, 1.0, 9.0] and len(sizes.p) == 18
    row = spark.range(1).select(
        F.array(*marks.pill_box(F.lit(5.0), F.lit(5.0), F.lit(0.0), F.lit(1.0), F.lit(8.0), 2.0)).alias("box"), F.struct(*[c.alias(n) for c, n in zip(marks.rotated(F.lit(1.0), F.lit(0.0), F.radians(F.lit(90.0))), "xy", strict=True)]).alias("v"),
        marks.under_station(F.lit(5.0), F.lit(0.5), F.lit("hub"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(0.0), 1.2, 3.0, 1.0).alias("hub"),
        marks.under_station(F.lit(2.5), F.lit(0.5), F.lit("end"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), 1.2, 3.0, 1.0).alias("end"),
        marks.under_station(F.lit(2.5), F.lit(0.5), F.lit("dot"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), 1.2, 3.0, 1.0).alias("dot"),
    ).first()
    assert row.box == [3.0, -1.0, 7.0, 11.0] and (round(row.v.x, 9), row.v.y) == (0.0, 1.0) and (row.hub, row.end, row.dot) == (True, True, False)


def test_parallel_run(spark):
    rows = [("p", i, float(i), 0.0) for i in range(30)]
    rows += [("q", i, float(i), 1.0 if i < 12 else 1.0 + (i - 12) * 1.5) for i in range(30)]
    rows += [("r", i, float(29 - i), 0.5) for i in range(30)]
    points = spark.createDataFrame(rows, "line_id string, pos int, x double, y double")
    pairs = spark.createDataFrame([("p", "q"), ("p", "r"), ("p", "p2")], "p string, q string")
    got = {r.q: r.run for r in spatial.parallel_run(points, pairs, 3.0).collect()}
    assert 7 <= got["q"] <= 13 and got["r"] == 0.0 and got["p2"] == 0.0


def test_versions(spark):
    rows = spark.createDataFrame([("k1", "a", 1), ("k2", "b", 2)], "given string, id string, v int")
    assert sorted(tuple(r) for r in overlay.listed(rows, given="given").collect()) == [("k1", 1), ("k2", 2)]
    assert overlay.listed(rows.drop("given")).count() == 2
    with pytest.raises(GeometryError):
        overlay.listed(rows.withColumn("id", F.lit("a")).drop("given"))
    with pytest.raises(KeyError):
        overlay.changed(rows, F.lit(True), nothing=F.lit(1))
    with pytest.raises(KeyError):
        overlay.derived({"a": rows}, {"b": rows}, {})
    assert [tuple(r) for r in overlay.families(spark.createDataFrame([("1", "S1"), ("2", None), ("3", "")], "line_id string, family string")).collect()] == [("1", "S1")]


def test_schematic_elements(spark):
    xy = spark.createDataFrame([("n", "A", 0.0, 0.0), ("n", "B", 2.0, 1.0), ("n", "H", 3.0, 0.0)], "net_id string, station string, x double, y double")
    stations = spark.createDataFrame([("n", "A", "Alt & Neu", None, "station", False, False), ("n", "B", "B", "Bee", "station", True, False), ("n", "H", "H", None, "hub", False, True)], "net_id string, id string, name string, label string, kind string, planned boolean, hidden boolean")
    lines = spark.createDataFrame([("n", "1", "#f00")], "net_id string, line_id string, color string")
    steps = spark.createDataFrame([("n", "1", 1, "station", "A"), ("n", "1", 2, "turn", None), ("n", "1", 3, "station", "B")], "net_id string, line_id string, pos int, step_kind string, station_id string")
    got = [(r.level, r.id, r.text) for r in maps.schematic_elements(xy, stations, lines, steps).orderBy("level", "id").collect()]
    assert got[0][2].endswith('<path id="line-1" stroke="#f00" stroke-width="4" d="M 0.000 0.000 L 40.000 -20.000"/>')
    assert [(a, b) for a, b, _ in got] == [(1, "1"), (2, "A"), (2, "B"), (3, "A"), (3, "B")]
    assert 'opacity="0.5"' in got[2][2] and got[3][2].endswith(">Alt &amp; Neu</text>") and got[4][2].endswith(">Bee</text>")


def test_definitions():
    assert ring_leg("g")["group"] == "g" and trains("peak", "A <> B")["cars"] == 2 and trains("day", "A <> B", 6)["cars"] == 6
    assert Place("corner", corner="top_right").direction == (1, -1)
    for bad in ({"mode": "x"}, {"mode": "toward"}, {"mode": "corner", "corner": "left"}):
        with pytest.raises(ValueError):
            Place(**bad)
