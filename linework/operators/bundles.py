"""Lines side by side: stretches of edges, lanes from corridors, and radii of corners that lines turn together.

Edges are (u, v) in the direction in which they are stored, from u. A lane counts to the right of that direction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.errors import require_empty
from linework.functions.geometry import intersection, unit
from linework.operators import graph
from linework.operators.sequences import line

NEAR = 1e-9


def stretch_pairs(edges: DataFrame) -> DataFrame:
    """(e1, e2), e1 < e2: edges with the same families that run straight into each other at a station.

    edges: (edge, u, v, families, leaves, arrives): the sorted families, the bearing at u and the bearing at v. An
    edge comes straight out of another where it leaves their station on the opposite of the other's own bearing there: an
    equality join on station, families and bearing.

    A pair that meets at both its stations is taken at the smaller one, so that pairs need no shuffle of their own.
    """
    flat = _stretch_ends(edges)
    other = flat.select("families", "station", F.col("out").alias("facing"), *[F.col(c).alias(f"o_{c}") for c in ("edge", "other", "other_out")])
    met = flat.join(other, ["families", "station", "facing"])
    again = (F.col("other") == F.col("o_other")) & (F.col("other_out") == F.pmod(F.col("o_other_out") + 180, F.lit(360)))
    later = F.struct(F.col("other").alias("s"), F.col("other_out").alias("o")) < F.struct(F.col("station").alias("s"), F.col("out").alias("o"))
    return met.where((F.col("edge") < F.col("o_edge")) & ~(again & later)).select(F.col("edge").alias("e1"), F.col("o_edge").alias("e2"))


def _stretch_ends(edges: DataFrame) -> DataFrame:
    """(edge, families, station, out, facing, other, other_out): both ends of each edge, once, with the bearing out of the station, that of
    an edge straight on, and the end on the other side."""
    start = F.struct(F.col("u").alias("station"), F.pmod("leaves", F.lit(360)).alias("out"))
    stop = F.struct(F.col("v").alias("station"), F.pmod(F.col("arrives") + 180, F.lit(360)).alias("out"))
    both = F.array_distinct(F.array(F.struct(start.alias("x"), stop.alias("y")), F.struct(stop.alias("x"), start.alias("y"))))
    flat = edges.select("edge", "families", F.explode(both).alias("e"))
    facing = F.pmod(F.col("e.x.out") + 180, F.lit(360))
    return flat.select("edge", "families", "e.x.station", "e.x.out", facing.alias("facing"), F.col("e.y.station").alias("other"), F.col("e.y.out").alias("other_out"))


def stretch_links(edges: DataFrame) -> DataFrame:
    """(a, b): links that join what stretch_pairs joins, at most two for each edge: where edges leave a station on both sides of one
    axis, all of them are one piece and are linked to the smallest."""
    flat = _stretch_ends(edges)
    axis, side = F.pmod("out", F.lit(180)).alias("axis"), F.floor(F.col("out") / 180).alias("side")
    ends = flat.select("edge", "families", "station", axis, side)
    low = ends.groupBy("families", "station", "axis").agg(F.min("edge").alias("low"), F.min("side").alias("s0"), F.max("side").alias("s1")).where("s0 <> s1")
    return ends.join(low, ["families", "station", "axis"]).where("edge <> low").select(F.col("edge").alias("a"), F.col("low").alias("b"))


def stretches(edges: DataFrame) -> DataFrame:
    """(edge, stretch): the smallest edge that each reaches over straight pairs."""
    edges = graph.kept(edges)
    found = graph.components(stretch_links(edges))
    own = edges.select("edge").distinct().join(found.withColumnRenamed("node", "edge"), "edge", "left")
    return own.select("edge", F.coalesce("component", "edge").alias("stretch"))


def corridor_edges(corridors: DataFrame) -> DataFrame:
    """(name, place, a, b, offsets): consecutive stations of corridors (name, corridor_pos, steps, offsets); place orders them all."""
    at = F.when(F.size("steps") > 1, F.sequence(F.lit(0), F.size("steps") - 2)).otherwise(F.array().cast("array<int>"))
    pair = F.transform(at, lambda i: F.struct(F.get("steps", i).alias("a"), F.get("steps", i + 1).alias("b")))
    flat = corridors.select("name", "corridor_pos", "offsets", F.posexplode(pair).alias("i", "p"))
    return flat.select("name", F.struct("corridor_pos", "i").alias("place"), "p.a", "p.b", "offsets")


def corridor_slots(edge_lines: DataFrame, corridors: DataFrame, edges: DataFrame, strict: bool = True) -> DataFrame:
    """(u, v, line_id, slot): lanes that corridors give to the lines (u, v, line_id, family) of their edges.

    edges: (u, v) of the whole network as stored. Of several passages of corridors over an edge the last counts. A line's own offset goes
    before its family's; strict: a line without either and a pair of stations that is no edge raise GeometryError, else
    the former has no row and the latter is left out. An edge that none of the lines uses is left out.
    """
    e = corridor_edges(corridors).withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    known = edges.select("u", "v", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
    if strict:
        require_empty(e.join(known, ["lo", "hi"], "left_anti").select("name", "a", "b"), "no edge of the network")
    last = e.join(known, ["lo", "hi"]).groupBy("u", "v").agg(F.max_by(F.struct("name", "a", "offsets"), "place").alias("c"))
    own = edge_lines.join(last, ["u", "v"])
    value = F.coalesce(F.try_element_at("c.offsets", F.col("line_id").cast("string")), F.try_element_at("c.offsets", F.col("family")))
    own = own.withColumn("value", value)
    if strict:
        require_empty(own.where("value is null").select("c.name", "u", "v", "line_id"), "no lane for a line")
    return own.where("value is not null").select("u", "v", "line_id", (F.col("value") * F.when(F.col("c.a") == F.col("u"), 1).otherwise(-1)).alias("slot"))


def _forward(ax: str, ay: str, bx: str, by: str) -> Column:
    return (F.col(ax) < F.col(bx)) | ((F.col(ax) == F.col(bx)) & (F.col(ay) < F.col(by)))


def _along(lane: Column, forward: Column) -> Column:
    """A lane between the driven direction and the lexicographic one; the change is its own reverse."""
    return F.when(forward, lane).otherwise(-lane)


def _middle(x: tuple[str, str], y: tuple[str, str]) -> tuple[Column, Column]:
    return F.round((F.col(x[0]) + F.col(x[1])) / 2, 6) + 0.0, F.round((F.col(y[0]) + F.col(y[1])) / 2, 6) + 0.0


def lane_map(legs: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, mx, my, family, lane): each family's lane at each leg's middle, in the lexicographic direction; of a family's lines the last.

    legs: (line_id, family, k, ax, ay, bx, by, off), off in the driven direction.
    """
    mx, my = _middle(("ax", "bx"), ("ay", "by"))
    lane = _along(F.col("off"), _forward("ax", "ay", "bx", "by"))
    return legs.select(*within, mx.alias("mx"), my.alias("my"), "family", "line_id", "k", lane.alias("lane")).groupBy(*within, "mx", "my", "family").agg(F.max_by("lane", F.struct("line_id", "k")).alias("lane"))


def corners(legs: DataFrame) -> DataFrame:
    """Each leg k that turns off the leg before it, with both: p_ columns are those of leg k - 1. legs as in lane_map, with delta.

    Both are rows of one window over the line, so that legs are made once and nothing is joined; where k repeats, each meets each.
    """
    ends = ("ax", "ay", "bx", "by", "off")
    before = Window.partitionBy("line_id").orderBy("k").rangeBetween(-1, -1)
    turning = legs.where("line_id is not null and k is not null").withColumn("_before", F.collect_list(F.struct(*ends)).over(before)).where("delta <> 0")
    return turning.withColumn("_p", F.explode("_before")).select(*legs.columns, *[F.col(f"_p.{c}").alias(f"p_{c}") for c in ends])


def curve_bundle(legs: DataFrame, spacing: float, within: tuple[str, ...] = ()) -> DataFrame:
    """(line_id, k, x, y, shift, innermost, beside): at each corner how far the line lies off the middle, the same of the
    innermost lane of its bundle counted towards the inside, and whether another family runs beside it all the way round.

    The bundle is the families whose gap to the line stays the same from one leg to the next. within: columns of legs whose values
    bundles don't reach across, such as networks on the same ground. Corners are written once: they are read by the search for lanes
    beside them and by what that finds.
    """
    lanes = graph.kept(lane_map(legs, within))
    c = corners(legs)
    own = (F.col("p_off") + F.col("off")) / 2 * spacing
    sign = F.when(F.col("delta") > 0, 1).otherwise(-1)
    pmx, pmy = _middle(("p_ax", "p_bx"), ("p_ay", "p_by"))
    mx, my = _middle(("ax", "bx"), ("ay", "by"))
    c = graph.kept(c.select(*within, "line_id", "family", "k", "ax", "ay", "off", "p_off", own.alias("shift"), sign.alias("sign"), pmx.alias("pmx"), pmy.alias("pmy"), mx.alias("mx"), my.alias("my"),
                 _forward("p_ax", "p_ay", "p_bx", "p_by").alias("p_fwd"), _forward("ax", "ay", "bx", "by").alias("fwd")))
    into = lanes.select(*within, F.col("mx").alias("pmx"), F.col("my").alias("pmy"), F.col("family").alias("other"), F.col("lane").alias("p_lane"))
    out = lanes.select(*within, "mx", "my", F.col("family").alias("other"), "lane")
    near = c.join(into, [*within, "pmx", "pmy"]).where("other <> family").join(out, [*within, "mx", "my", "other"])
    gap = _along(F.col("p_lane"), F.col("p_fwd")) - F.col("p_off")
    gap_after = _along(F.col("lane"), F.col("fwd")) - F.col("off")
    near = near.withColumn("gap", gap).where(F.abs(gap - gap_after) <= NEAR)
    best = near.groupBy("line_id", "k").agg(F.max(F.col("sign") * (F.col("shift") + F.col("gap") * spacing)).alias("most"), F.max((F.abs("gap") > NEAR).cast("int")).alias("any"))
    both = c.join(best, ["line_id", "k"], "left")
    return both.select("line_id", "k", (F.round("ax", 6) + 0.0).alias("x"), (F.round("ay", 6) + 0.0).alias("y"), "sign", "shift", F.greatest(F.col("sign") * F.col("shift"), "most").alias("innermost"), (F.coalesce("any", F.lit(0)) == 1).alias("beside"))


def radius_targets(bundle: DataFrame, wanted: DataFrame) -> DataFrame:
    """(x, y, radius, correction): corners where a reference line (line_id, x, y, radius, pos) gives the radius. Of several the
    one with the greatest pos counts. bundle: curve_bundle's rows."""
    own = bundle.join(wanted, ["line_id", "x", "y"])
    pick = F.max_by(F.struct("radius", (F.col("sign") * F.col("shift") - F.col("innermost")).alias("correction")), F.struct("pos", "line_id", "k"))
    return own.groupBy("x", "y").agg(pick.alias("t")).select("x", "y", "t.radius", "t.correction")


def corner_choice(own: Column, target: Column, correction: Column, default: Column, forced: Column, sign: Column, shift: Column, innermost: Column, central: Column, beside: Column) -> tuple[Column, Column, Column]:
    """(radius, offset, forced) of a corner as geometry.corner_radius takes them.

    The line's own radius is drawn as it is. Else the radius is the reference line's with its correction, or the default, and
    belongs to the innermost lane of the bundle; or, where the corridor says so (central), to its middle, if any lane is beside.
    """
    offset = F.when(central, F.when(beside, shift).otherwise(0.0)).otherwise(sign * (sign * shift - innermost))
    return F.coalesce(own, target + correction, default), F.when(own.isNotNull(), 0.0).otherwise(offset), forced | own.isNotNull()


def lane_path(legs: DataFrame, spacing: float, span: float | None = None) -> DataFrame:
    """line_id, pos, part, kind, x, y, turn, radius, tangent: the vertices of each line's lane, in the order of (pos, part).

    legs: (line_id, pos, ax, ay, bx, by, off, at), off the lane to the left of the leg's direction in y-up coordinates and at where on a
    straight leg its lane changes: 'start', 'end' or else the middle. Shifted legs meet where their lines do (curve), also if their
    lanes differ. Straight on, a lane goes on (along) or changes by two vertices: over 45 degrees with the arcs that fill
    the slope (change), or with a span by a curve of as many widths, at most the leg (bezier). Before a leg that turns straight back the
    lane's vertex is that leg's shifted start. Legs have a length.
    """
    dx, dy = unit(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    own = legs.withColumn("ux", dx).withColumn("uy", dy).withColumn("len", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    own = own.withColumn("d", F.col("off") * spacing).withColumn("ends", F.lead("pos").over(line()).isNull())
    for n, p in (("a", "start"), ("b", "stop")):
        own = own.withColumn(f"{p}_x", F.col(f"{n}x") - F.col("uy") * F.col("d")).withColumn(f"{p}_y", F.col(f"{n}y") + F.col("ux") * F.col("d"))
    before = lambda c: F.lag(c).over(line())
    for c in ("ux", "uy", "d", "start_x", "start_y", "stop_x", "stop_y"):
        own = own.withColumn(f"p_{c}", before(c))
    c = F.col
    turns = (F.abs(c("ux") - c("p_ux")) > 1e-9) | (F.abs(c("uy") - c("p_uy")) > 1e-9)
    delta = c("d") - c("p_d")
    kind = F.when(c("p_ux").isNull(), "end").when(turns, "curve").when(F.abs(delta) < 1e-12, "along").otherwise("change" if span is None else "bezier")
    mx, my = intersection(c("p_start_x"), c("p_start_y"), c("p_ux"), c("p_uy"), c("start_x"), c("start_y"), c("ux"), c("uy"))
    length = F.abs(delta) if span is None else F.least(F.abs(delta) * span, c("len"))
    free = F.greatest(c("len") - length, F.lit(0.0))
    ahead = F.when(c("at") == "start", 0.0).when(c("at") == "end", free).otherwise(free / 2)
    own = own.withColumn("kind", kind).withColumn("long", length).withColumn("delta", delta).withColumn("mx", F.coalesce(mx, c("start_x"))).withColumn("my", F.coalesce(my, c("start_y")))
    own = own.withColumn("fx", c("p_stop_x") + c("ux") * ahead).withColumn("fy", c("p_stop_y") + c("uy") * ahead)
    slope = c("kind") == "change"
    tangent = F.when(slope, c("long") * F.sqrt(F.lit(2.0)) / 2)
    lean = F.when(slope, F.when(c("delta") > 0, 45).otherwise(-45))

    def vertex(part: int, x: Column, y: Column, turn: Column, name: Column | None = None) -> Column:
        arc = F.lit(None).cast("double") if name is not None else tangent
        return F.struct(F.lit(part).alias("part"), (c("kind") if name is None else name).alias("kind"), x.alias("x"), y.alias("y"), turn.cast("int").alias("turn"), (arc / F.tan(F.radians(F.lit(22.5)))).alias("radius"), arc.alias("tangent"))

    two = F.array(vertex(0, c("fx"), c("fy"), lean), vertex(1, c("fx") + c("ux") * c("long") - c("uy") * c("delta"), c("fy") + c("uy") * c("long") + c("ux") * c("delta"), -lean))
    one = F.array(vertex(0, F.when(c("kind") == "curve", c("mx")).otherwise(c("start_x")), F.when(c("kind") == "curve", c("my")).otherwise(c("start_y")), lean))
    last = F.array(vertex(2, c("stop_x"), c("stop_y"), F.lit(None), F.lit("end")))
    here = F.when(c("kind").isin("change", "bezier"), two).otherwise(one)
    return own.withColumn("v", F.explode(F.when(c("ends"), F.concat(here, last)).otherwise(here))).select("line_id", "pos", "v.*")
