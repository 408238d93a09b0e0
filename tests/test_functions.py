"""Functions and operators on cases worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from linework.errors import GeometryError
from linework.functions import drawing as D
from linework.functions import geometry as G
from linework.functions import polyline as P
from linework.functions import strings as X
from linework.operators import graph, labels, overlay, sequences, spatial
from linework.sources import osm


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("S+U Berlin Hauptbahnhof", "hauptbahnhof"),
        ("Berlin Hbf (tief)", "hauptbahnhoftief"),
        ("Erkner (b Berlin)", "erkner"),
        ("Bornholmer Straße", "bornholmerstrasse"),
        ("S Südkreuz", "südkreuz"),
        ("Messe Süd (Eichkamp)", "messesüdeichkamp"),
    ],
)
def test_normalize_name(spark, name, want):
    assert one(spark, X.normalize_name(F.lit(name))) == want


def test_text(spark):
    assert one(spark, X.text_width(F.lit("AB"), 10.0)) == pytest.approx(13.9)
    assert one(spark, X.text_width(F.lit("AQ"), 10.0)) == pytest.approx(13.05)
    assert one(spark, X.text_width(F.lit(""), 10.0)) == 0
    assert [one(spark, X.badge_text(F.lit(t))) for t in ("S85", "X", "")] == ["S 85", "X", ""]
    assert one(spark, X.escape_xml(F.lit("a<b & c>"))) == "a&lt;b &amp; c&gt;"
    assert [one(spark, X.suffix_start(F.lit(t))) for t in ("A\n(b)\nc", "(a)\nb", "a")] == [1, None, None]
    wide, small = one(spark, X.label_width(F.lit("A\n(AAAA)"), 10.0)), one(spark, X.label_width(F.lit("A\n(AAAA)"), 10.0, 2.0))
    assert small == pytest.approx(wide * 0.8)
    assert one(spark, X.route_ends(F.lit("A <> B <> C"))).asDict() == {"first": "A", "last": "C"}
    assert [one(spark, X.tenths(F.lit(v).cast("long"))) for v in (123, -40, 5, -5, 0, 10, -123)] == ["12.3", "-4", ".5", "-.5", "0", "1", "-12.3"]


def points(*xy):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])


def test_paths(spark):
    assert one(spark, X.draw_path(points((0, 0), (0.04, 0), (1.25, 0)), False)) == "M0 0l1.2 0"
    assert one(spark, X.draw_path(points((0, 0), (1, 0), (1, 1), (0, 0)), True)) == "M0 0l1 0 0 1z"
    assert one(spark, X.draw_path(points((0, 0), (0.01, 0)), False)) == ""
    ring = spark.range(1).select(points((0, 0), (1, 0), (1, 1), (0, 1)).alias("p"))
    assert ring.select(G.ring_area("p").alias("a")).first().a == 1


def test_geometry(spark):
    radii = [one(spark, G.curve_radius(F.lit(d))) for d in (45, -90, 135, 315)]
    assert radii == [0.8, 1.2, 0.4, 0.8]
    hit = lambda box, margin=0.0: one(spark, G.segment_hits_box(*[F.lit(float(v)) for v in (0, 0, 4, 4, *box)], margin))
    assert hit((1, 2, 2, 3)) and not hit((3, 0, 4, 1)) and hit((3, 0, 4, 1), 1.0)
    assert one(spark, G.bearing(F.lit(1.0), F.lit(1.0))) == 45 and one(spark, G.bearing(F.lit(1.0), F.lit(0.5))) is None
    assert [one(spark, G.smoothstep(F.lit(t))) for t in (-1.0, 0.5, 2.0)] == [0, 0.5, 1]
    assert one(spark, G.corner_radius(F.lit(90), F.lit(1.2), F.lit(0.5), F.lit(0.2), F.lit(False))) == pytest.approx(0.3)
    assert one(spark, P.largest_radius(F.lit(0.0), 1.0, 400.0)) == 400


def test_splice_and_derive(spark):
    lines = spark.createDataFrame([("l", ["a", "T", "b", "T", "c"])], "line_id string, steps array<string>")
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    assert sequences.spliced(lines, arr("T", "b"), arr("F")).first().steps == ["a", "F", "T", "c"]
    with pytest.raises(Exception, match="aren't there"):
        sequences.spliced(lines, arr("x"), arr("F")).collect()
    assert sequences.inserted(lines, F.lit("T"), arr("n")).first().steps == ["a", "T", "n", "b", "T", "c"]
    assert sequences.between(lines, F.lit("T"), F.lit("c")).first().steps == ["T", "b", "T", "c"]
    parent = spark.createDataFrame([("x", 1), ("y", 2)], "key string, value int")
    delta = spark.createDataFrame([("y", 3, False), ("z", 4, False), ("x", None, True)], "key string, value int, tombstone boolean")
    assert {tuple(r) for r in overlay.merged(parent, delta, ["key"], check=True).collect()} == {("y", 3), ("z", 4)}
    with pytest.raises(GeometryError, match="removed"):
        overlay.merged(parent, spark.createDataFrame([("q", None, True)], delta.schema), ["key"], check=True)
    place = overlay.ordered(parent.withColumn("at", F.lit(1)), delta.withColumn("at", F.lit(1)), "key", "at").orderBy("place").collect()
    assert [r.key for r in place] == ["y", "z"]
    empty = parent.limit(0)
    assert overlay.merged(empty, delta.limit(0), ["key"]).count() == 0


def test_moving_average_cyclic(spark):
    pts = spark.createDataFrame([("a", k, float(k % 2), 0.0) for k in range(1, 9)], "line_id string, pos long, x double, y double")
    got = {r.pos: r.sx for r in sequences.moving_average(pts, 4, cyclic=True).collect()}
    assert set(got.values()) == {0.5} and len(got) == 8
    short = sequences.moving_average(pts.where("pos <= 3"), 5).orderBy("pos").collect()
    assert [r.sx for r in short] == [1.0, 0.0, 1.0]


def test_graph_errors(spark):
    ids = spark.createDataFrame([(k,) for k in "abc"], "id string")
    cycle = spark.createDataFrame([("a", "b"), ("b", "a")], "upper string, lower string")
    with pytest.raises(GeometryError, match="circle"):
        graph.draw_order(ids, cycle)
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 3.0), (8, 9, 1.0)], "a long, b long, w double")
    cost = {r.node: r.cost for r in graph.reached(edges, spark.createDataFrame([(0, 0.0)], "node long, cost double")).collect()}
    assert cost == {0: 0.0, 1: 1.0, 2: 2.0}
    assert {(r.node, r.component) for r in graph.components(edges).collect()} == {(0, 0), (1, 0), (2, 0), (8, 8), (9, 8)}


def test_nearest_beyond_the_radius(spark):
    probes = spark.createDataFrame([(1, 0.0, 0.0), (2, 500.0, 0.0)], "id long, x double, y double")
    nodes = spark.createDataFrame([(7, 3.0, 4.0), (8, 3.0, -4.0)], "node long, x double, y double")
    assert {r.id: (r.node, r.d) for r in spatial.nearest(probes, nodes, 1.0).collect()} == {1: (7, 5.0), 2: (7, pytest.approx((497**2 + 16) ** 0.5))}


def test_map_data(spark, tmp_path):
    way = lambda i, *pts: {"type": "way", "id": i, "geometry": [None if p is None else {"lon": p[0], "lat": p[1]} for p in pts]}
    member = lambda i, role, *pts: {"type": "way", "ref": i, "role": role, "geometry": way(i, *pts)["geometry"]}
    elements = [
        way(1, (0, 0), None, (1, 0)),
        way(2, (5, 5)),
        way(3, (0, 0), (1, 0), (1, 1), (0, 0)),
        {"type": "relation", "id": 9, "members": [member(1, "", (9, 9), (8, 8)), member(2, "outer", (7, 7), (6, 6)), member(4, "", (0, 0), (1, 0)), member(5, "outer", (1, 1), (1, 0)), member(6, "outer", (1, 1), (0, 0))]},
        {"type": "node", "id": 3, "lon": 1.5, "lat": 2.5, "tags": {"name": "Stop"}},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"elements": elements}))
    e = osm.read_elements(spark, f"{tmp_path}/a.json")
    assert {r.way_id: len(r.pts) for r in osm.ways(e).collect()} == {1: 2, 3: 4, 4: 2, 5: 2, 6: 2}
    rings = {(r.elem_pos, r.ring_pos): [(p.lon, p.lat) for p in r.pts] for r in osm.areas(e).collect()}
    assert rings[2, 0] == [(0, 0), (1, 0), (1, 1), (0, 0)]
    assert [(0, 0), (1, 0), (1, 1), (0, 0)] in [v for k, v in rings.items() if k[0] == 3]
    assert [tuple(r) for r in osm.stops(e).collect()] == [("Stop", 1.5, 2.5)]
    (tmp_path / "b.json").write_text(json.dumps({"elements": [], "remark": "runtime error"}))
    with pytest.raises(GeometryError, match="failed"):
        osm.read_elements(spark, f"{tmp_path}/b.json")
    assert osm.stitched([[(0, 0), (1, 0)], [(1, 1), (1, 0)], [(1, 1), (0, 0)]]) == [[(0, 0), (1, 0), (1, 1), (0, 0)]]
    assert len(osm.cache_key("q")) == 12


def test_labels_do_not_overlap(spark):
    rows = spark.createDataFrame([(1, k, k, 0.0, 0.0, 20, 10) for k in range(4)], "map_id long, id long, first long, x double, y double, w int, h int")
    none = rows.limit(0).select("map_id", "x", "y")
    assert len({r.side for r in labels.placed(rows, none).collect()}) == 4  # around one point there is room for four


def test_routes_with_entry_and_exit_costs(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 3.0), (2, 3, 5.0), (8, 9, 1.0)], "a long, b long, w double")
    src = spark.createDataFrame([("r", 0, 0.0), ("s", 0, 4.0), ("s", 1, 0.5), ("t", 0, 0.0)], "route string, node long, cost double")
    dst = spark.createDataFrame([("r", 2, 0.0), ("s", 3, 0.0), ("s", 2, 9.0), ("t", 9, 0.0)], "route string, node long, cost double")
    got = {r.route: (r.cost, r.path) for r in graph.routes(edges, src, dst).collect()}
    assert got == {"r": (2.0, [0, 1, 2]), "s": (6.5, [1, 2, 3])}


def test_hints_markers_and_areas(spark):
    from linework.operators import tracks

    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    holds = lambda along, apart, at: one(spark, tracks.hint_holds(arr("S1", "S2"), arr(*along), arr(*apart), arr("a", "b"), arr(*at)))
    assert holds((), (), ()) and holds(("S1",), (), ("b",)) and not holds(("S3",), (), ()) and not holds((), ("S2",), ()) and not holds((), (), ("c",))
    under = lambda x, y, angle: one(spark, G.under_marker(*[F.lit(float(v)) for v in (x, y, 0, 0, angle, 3, 1, 1)]))
    assert under(4, 0, 0) and not under(0, 4, 0) and under(0, 4, 90) and not under(3.9, 1.9, 0) and under(0, 0, 45)
    assert [one(spark, G.drawn_area(F.lit(1.0), F.lit(n), 2.0)) for n in (1, 2)] == [False, True]


def test_map_query_text():
    text = osm.build_query(['way["a"="b"]', "node"], (1.0, 2.0, 3.0, 4.123456), tags=False, maxsize=5)
    assert text == '[out:json][timeout:300][maxsize:5];\n(\n  way["a"="b"](1.00000,2.00000,3.00000,4.12346);\n  node(1.00000,2.00000,3.00000,4.12346);\n);\nout skel geom qt;'
    assert "[maxsize" not in osm.build_query(["node"], (1, 2, 3, 4), tags=True)


def test_drawings_are_written(spark, tmp_path):
    from linework.sources import drawings

    elements = spark.createDataFrame([(1, 2, 1, "<b/>"), (1, 1, 5, "<a/>"), (2, 1, 1, "<c/>")], "map_id long, level int, id long, text string")
    drawings.write_documents(labels.documents(elements, 10, 20), f"{tmp_path}/maps")
    read = spark.read.text(f"{tmp_path}/maps/map_id=1", wholetext=True).first().value
    assert read.index("<a/>") < read.index("<b/>") and read.startswith("<svg") and read.rstrip().endswith("</svg>")


def test_planned_and_empty_inputs(spark):
    s = spark.createDataFrame([("a", "A", None, False)], "id string, name string, label string, planned boolean")
    assert tuple(overlay.planned(s).first())[2:] == ("(A)", True)
    none = spark.createDataFrame([], "id long, x double, y double")
    nodes = none.select(F.col("id").alias("node"), "x", "y")
    assert spatial.near(none, nodes, 1.0).count() == 0 and spatial.nearest(none, nodes, 1.0).count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbers_as_sql_writes_them(spark):
    """Java rounds up what its shortest decimal puts half way; printf, as in SQL, goes by the exact value and to even from half way."""
    v = [0.0625, -0.0625, 0.1875, 1.0005, 1.0035, 9167024.6305, 3280387.0135, 0.0, -0.0, 12.5, 1e-9]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    for digits in (0, 1, 3, 6):
        assert [r.t for r in df.select(D.number(F.col("v"), digits).alias("t")).collect()] == [f"%.{digits}f" % x for x in v]
