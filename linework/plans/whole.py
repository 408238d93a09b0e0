"""From a solved network to a drawing: stretches, lanes, radii, path text, marks and names, as rows in drawing order.

Stations and lines are qualified by their network on the way, so any number of networks is drawn side by side, by the
same joins and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.functions import drawing as D
from linework.functions import geometry as G
from linework.functions import strings as X
from linework.operators import bundles, edges, graph, marks, sequences
from linework.plans import schematic

SEP = "\x1f"


def _in_net(c: str) -> Column:
    return F.concat_ws(SEP, "net_id", c)


def courses(solved: dict[str, DataFrame], lines: DataFrame) -> DataFrame:
    """One row for each leg that has a length: net_id, line (qualified), line_id, family, pos, seg, leg, a, b, ax, ay, bx, by, long, heading,
    and the corner before it (delta, radius, forced). lines: net_id, line_id, family."""
    own = solved["legs"].withColumn("var", F.concat_ws(":", F.lit("len"), "line_id", F.coalesce(F.concat(F.lit("group "), "group"), F.concat_ws(".", "seg", "leg"))))
    own = own.join(solved["solution"].select("net_id", "var", "value"), ["net_id", "var"], "left").join(solved["bearings"], ["net_id", "line_id"])
    own = own.join(solved["coordinates"].select("net_id", F.col("station").alias("a"), "x", "y"), ["net_id", "a"])
    own = own.withColumn("long", F.when(F.col("elastic"), F.col("value")).otherwise(F.col("preferred"))).withColumn("heading", F.pmod(F.col("bearing") + F.col("offset"), F.lit(360)))
    sofar = Window.partitionBy("net_id", "line_id", "seg").orderBy("leg").rowsBetween(Window.unboundedPreceding, 0)
    for axis, f in (("x", F.sin), ("y", F.cos)):
        step = F.col("long") * f(F.radians("heading"))
        own = own.withColumn(f"b{axis}", F.col(axis) + F.sum(step).over(sofar)).withColumn(f"a{axis}", F.col(f"b{axis}") - step)
    line = own.where("long > 1e-9").join(lines.select("net_id", "line_id", F.coalesce("family", "line_id").alias("family")), ["net_id", "line_id"])
    pos = F.row_number().over(Window.partitionBy("net_id", "line_id").orderBy("seg", "leg"))
    return line.select("net_id", _in_net("line_id").alias("line"), "line_id", "line_pos", "family", pos.alias("pos"), "seg", "leg", "a", "b", "ax", "ay", "bx", "by", "long", "heading", "delta", "radius", "forced")


def edge_lanes(course: DataFrame, corridors: DataFrame | None = None) -> DataFrame:
    """(u, v, line, lane) with qualified stations: each line's lane on each edge, in the direction in which the edge is stored.

    An edge is stored as the first line drives it. Families lie side by side in the order of their names, over a whole stretch: how its edges
    are stored to each other is an offset of 0 or 1 along the stretch. corridors (net_id, name, corridor_pos, steps, offsets) go before that.
    """
    one = Window.partitionBy("line", "seg")
    seg = course.withColumn("first", F.min_by("heading", "leg").over(one)).withColumn("last", F.max_by("heading", "leg").over(one))
    seg = seg.select("line", "line_id", "line_pos", "family", "seg", _in_net("a").alias("u"), _in_net("b").alias("v"), F.col("first").alias("leaves"), F.col("last").alias("arrives")).distinct()
    seg = graph.kept(seg.withColumn("edge", F.concat_ws(SEP, F.least("u", "v"), F.greatest("u", "v"))))
    edge = graph.kept(seg.groupBy("edge").agg(F.min_by(F.struct("u", "v", "leaves", "arrives"), F.struct("line_pos", "line_id", "seg")).alias("e"), F.array_sort(F.collect_set("family")).alias("families")).select("edge", "e.*", "families"))
    pairs = bundles.stretch_pairs(edge)
    end = lambda n: edge.select(F.col("edge").alias(f"e{n}"), F.col("u").alias(f"u{n}"), F.col("v").alias(f"v{n}"))
    meets = pairs.join(end(1), "e1").join(end(2), "e2")
    against = (F.col("u1") == F.col("u2")) | (F.col("v1") == F.col("v2"))
    turned = graph.potentials(meets.select(F.col("e1").alias("a"), F.col("e2").alias("b"), against.cast("int").alias("delta")), 2)
    placed = edges.slots(edge.select("u", "v", "edge", F.explode("families").alias("family"))).join(turned.select(F.col("node").alias("edge"), "offset"), "edge", "left")
    lane = F.col("slot") * F.when(F.col("offset") == 1, -1).otherwise(1)
    lanes = seg.select("edge", "line", "line_id", "family").distinct().join(placed.select("edge", "u", "v", "family", lane.alias("lane")), ["edge", "family"])
    if corridors is None:
        return lanes.select("u", "v", "line", "lane")
    given = corridors.select(_in_net("name").alias("name"), "corridor_pos", "offsets", F.transform("steps", lambda s: F.concat_ws(SEP, F.col("net_id"), s)).alias("steps"))
    fixed = bundles.corridor_slots(lanes.select("u", "v", "line_id", "family"), given, edge.select("u", "v"))
    return lanes.join(fixed, ["u", "v", "line_id"], "left").select("u", "v", "line", F.coalesce("slot", "lane").alias("lane"))


def lane_legs(course: DataFrame, lanes: DataFrame, at_once: DataFrame | None = None) -> DataFrame:
    """course with off, the lane to the left of the driven direction, and at. A line changes its lane where it turns, or on the edges of
    at_once (net_id, u, v, at: start, middle or end)."""
    both = lanes.select("u", "v", "line", "lane", F.lit(1).alias("way")).unionByName(lanes.select(F.col("v").alias("u"), F.col("u").alias("v"), "line", "lane", F.lit(-1).alias("way")))
    own = course.withColumn("u", _in_net("a")).withColumn("v", _in_net("b")).join(both, ["u", "v", "line"])
    own = own.withColumn("at", F.lit(None).cast("string"))
    if at_once is not None:
        named = at_once.select(_in_net("u").alias("_u"), _in_net("v").alias("_v"), F.col("at").alias("_at"))
        named = named.unionByName(named.select(F.col("_v").alias("_u"), F.col("_u").alias("_v"), "_at"))
        own = own.join(named, (F.col("u") == F.col("_u")) & (F.col("v") == F.col("_v")), "left").withColumn("at", F.col("_at")).drop("_u", "_v", "_at")
    own = own.withColumn("wanted", F.col("lane") * F.col("way")).drop("lane", "u", "v", "way", "line_id").withColumnRenamed("line", "line_id")
    turns = F.pmod(F.col("heading") - F.lag("heading").over(sequences.line()), F.lit(360)) != 0
    starts = F.col("at").isNotNull() & (F.row_number().over(Window.partitionBy("line_id", "seg").orderBy("pos")) == 1)
    own = own.withColumn("_may", turns | starts)
    return sequences.deferred(own, F.col("wanted"), F.col("_may")).withColumnRenamed("lane", "off").drop("wanted", "_may")


def lane_vertices(legs: DataFrame, spacing: float, span: float | None = None) -> DataFrame:
    """(net_id, line_id qualified, pos, part, x, y, r, curve): the vertices of each line's lane, with the radius of its arc there and whether
    a cubic curve leads to it. legs as lane_legs has them.

    The tangent of a corner may take what its legs leave: their length less the tangent of the corner at their other end.
    """
    w = sequences.line()
    here = F.coalesce(F.col("radius") * G.tangent_factor(F.col("delta")), F.lit(0.0))
    room = legs.withColumn("_t", here).withColumn("_before", F.lag("long").over(w) - F.coalesce(F.lag("_t").over(w), F.lit(0.0))).withColumn("_after", F.col("long") - F.coalesce(F.lead("_t").over(w), F.lit(0.0)))
    room = graph.kept(room.withColumn("k", F.col("pos")).withColumn("delta", F.coalesce("delta", F.lit(0))))
    bundle = bundles.curve_bundle(room, spacing, ("net_id",))
    turn = room.where("delta <> 0 and radius is not null").join(bundle.drop("x", "y"), ["line_id", "k"], "left")
    none = F.lit(None).cast("double")
    radius, offset, forced = bundles.corner_choice(none, none, none, F.col("radius"), F.coalesce("forced", F.lit(False)), F.col("sign"), F.col("shift"), F.col("innermost"), F.lit(False), F.col("beside"))
    turn = turn.select("line_id", "pos", G.corner_radius(F.col("delta"), radius, F.greatest(F.lit(0.0), F.least("_before", "_after")), F.coalesce(offset, F.lit(0.0)), forced).alias("arc"))
    path = bundles.lane_path(room.select("line_id", "pos", "ax", "ay", "bx", "by", "off", "at"), spacing, span)
    r = F.when(F.col("kind") == "curve", F.col("arc")).when(F.col("kind") == "change", F.col("radius"))
    return path.join(turn, ["line_id", "pos"], "left").select(F.split("line_id", SEP)[0].alias("net_id"), "line_id", "pos", "part", "x", "y", r.alias("r"), ((F.col("kind") == "bezier") & (F.col("part") == 1)).alias("curve"))


def stops(legs: DataFrame, spacing: float) -> DataFrame:
    """(net_id, station, line_id qualified, x, y, ux, uy): where each line's lane passes its stations, as it comes to them, and its direction."""
    rad = F.radians("heading")
    ux, uy = F.sin(rad), F.cos(rad)
    d = F.col("off") * spacing
    spot = lambda n, s: F.struct(F.col(s).alias("station"), (F.col(f"{n}x") - uy * d).alias("x"), (F.col(f"{n}y") + ux * d).alias("y"), ux.alias("ux"), uy.alias("uy"))
    last = F.row_number().over(Window.partitionBy("line_id", "seg").orderBy(F.desc("pos"))) == 1
    flat = legs.withColumn("s", F.when(last, spot("b", "b"))).withColumn("f", F.when(F.col("pos") == 1, spot("a", "a")))
    both = flat.select("net_id", "line_id", "pos", F.explode(F.filter(F.array("f", "s"), lambda p: p.isNotNull())).alias("p")).select("net_id", "line_id", "pos", "p.*")
    return both.groupBy("net_id", "station", "line_id").agg(F.min_by(F.struct("x", "y", "ux", "uy"), "pos").alias("p")).select("net_id", "station", "line_id", "p.*")


def map_rows(
    stations: DataFrame, lines: DataFrame, steps: DataFrame, corridors: DataFrame | None = None, at_once: DataFrame | None = None, over: DataFrame | None = None,
    scale: float = 20.0, spacing: float = 0.4, span: float | None = None, width: float = 4.0, label_font: float = 10.0,
) -> DataFrame:
    """map_id, level, place, id, text: all elements of networks' drawings in drawing order: lines (level 1), marks (2), names (3).

    over: (net_id, upper, lower): lines that are drawn above others; else they lie in definition order. Hidden stations have neither mark nor name, planned
    ones are pale. A mark is a pill across the lanes that pass side by side, or a dot.
    """
    solved = schematic.layout(stations, lines, steps)
    course = graph.kept(courses(solved, lines))
    legs = graph.kept(lane_legs(course, edge_lanes(course, corridors), at_once))
    px = lambda v: F.round(v * scale, 6) + 0.0
    vertex = F.struct("pos", "part", px(F.col("x")).alias("x"), px(-F.col("y")).alias("y"), (F.col("r") * scale).alias("r"), "curve")
    drawn = lane_vertices(legs, spacing, span).groupBy("net_id", "line_id").agg(F.transform(F.array_sort(F.collect_list(vertex)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["r"].alias("r"), p["curve"].alias("curve"))).alias("pts"))
    own = lines.select("net_id", F.col("line_id").alias("id"), "line_pos", "color", _in_net("line_id").alias("line_id"))
    if over is None:
        level = own.select("line_id", F.lit(0).alias("above"))
    else:
        level = graph.draw_order(own.select(F.col("line_id").alias("id")), over.select(_in_net("upper").alias("upper"), _in_net("lower").alias("lower"))).select(F.col("id").alias("line_id"), F.col("level").alias("above"))
    own = drawn.join(own.drop("net_id"), "line_id").join(level, "line_id")
    row = lambda df, n, place, key, text: df.select(F.col("net_id").alias("map_id"), F.lit(n).alias("level"), place.cast("long").alias("place"), F.col(key).alias("id"), text.alias("text"))
    order = F.row_number().over(Window.partitionBy("net_id").orderBy("above", "line_pos", "id"))
    tracks = row(own, 1, order, "id", D.line_svg(F.col("id"), F.col("color"), D.course_path("pts"), width))

    seen = stations.where("not coalesce(hidden, false)").select("net_id", "id", F.coalesce("label", "name", "id").alias("label"), F.coalesce("planned", F.lit(False)).alias("planned"))
    spots = stops(legs, spacing).select(F.concat_ws(SEP, "net_id", "station").alias("station_id"), "line_id", (F.col("x") * scale).alias("x"), (F.lit(0.0) - F.col("y") * scale).alias("y"), "ux", (-F.col("uy")).alias("uy"))
    pills = graph.kept(marks.pills(spots, spacing * scale)).withColumn("net_id", F.split("station_id", SEP)[0]).withColumn("id", F.split("station_id", SEP)[1]).join(seen, ["net_id", "id"])
    ex, ey = F.col("nx") * F.col("length") / 2, F.col("ny") * F.col("length") / 2
    number = lambda v: D.number(F.round(v, 6) + 0.0, 1)
    pale = F.when(F.col("planned"), ' opacity="0.5"').otherwise("")
    path = F.concat(F.lit('<path d="M '), number(F.col("x") - ex), F.lit(" "), number(F.col("y") - ey), F.lit(" L "), number(F.col("x") + ex), F.lit(" "), number(F.col("y") + ey))
    stroke = lambda color, w: F.lit(f'" stroke="{color}" stroke-width="{w:g}" stroke-linecap="round"')
    pill = F.concat(path, stroke("#111", 2 * width + 2), pale, F.lit("/>"), path, stroke("#fff", 2 * width - 1), pale, F.lit("/>"))
    dot = F.concat(F.lit('<circle cx="'), number(F.col("x")), F.lit('" cy="'), number(F.col("y")), F.lit(f'" r="{width * 0.75:g}" fill="#fff" stroke="#111"'), pale, F.lit("/>"))
    at = F.row_number().over(Window.partitionBy("net_id").orderBy("id", "mark"))
    signs = row(pills, 2, at, "id", F.when(F.col("length") > 1e-9, pill).otherwise(dot))

    box = F.max(F.abs("nx") * F.col("length") / 2 + F.col("x"))
    right = pills.groupBy("net_id", "id", "label").agg(box.alias("x"), F.min_by("y", "mark").alias("y"))
    name = F.concat(F.lit('<text x="'), number(F.col("x") + 2 * width), F.lit('" y="'), number(F.col("y") + label_font / 3), F.lit(f'" font-size="{label_font:g}">'), X.escape_xml(F.col("label")), F.lit("</text>"))
    names = row(right, 3, F.row_number().over(Window.partitionBy("net_id").orderBy("id")), "id", name)
    return tracks.unionByName(signs).unionByName(names)
