"""Operators on pieces of track that lines share, and on bundles of lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.errors import require_empty
from linework.functions.geometry import smoothstep
from linework.operators import graph, spatial
from linework.operators.sequences import islands, line, resampled, so_far


def through_pieces(sequences: DataFrame) -> DataFrame:
    """piece: all of whose lines come from and go on to the same two pieces. sequences: (line_id, pos, piece)."""
    near = sequences.withColumn("p", F.lag("piece").over(line())).withColumn("n", F.lead("piece").over(line()))
    pair = F.struct(F.least("p", "n").alias("a"), F.greatest("p", "n").alias("b"))
    ends = F.max((F.col("p").isNull() | F.col("n").isNull()).cast("int"))
    return near.withColumn("pair", pair).groupBy("piece").agg((F.min("pair") == F.max("pair")).alias("one"), ends.alias("ends")).where("one and ends = 0").select("piece")


def common_runs(sequences: DataFrame, value: Column, length: Column) -> DataFrame:
    """line_id, pos, run: the length of the run of equal values around each place."""
    runs = islands(sequences.withColumn("_length", length), ["line_id"], "pos", value)
    return runs.withColumn("run", F.sum("_length").over(Window.partitionBy("line_id", "island"))).drop("_length", "island")


def mean_track(points: DataFrame, bundle: Column, n: int) -> DataFrame:
    """bundle, i, x, y: n points along the mean of a bundle's lines (line_id, pos, x, y), each taken by its own length;
    lines of no length are left out."""
    owner = points.select("line_id", bundle.alias("bundle")).distinct()
    same = resampled(points, parts=n - 1)
    full = same.join(same.groupBy("line_id").agg(F.max("i").alias("last")).where(F.col("last") == n - 1).select("line_id"), "line_id", "left_semi")
    return full.join(owner, "line_id").groupBy("bundle", "i").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def lanes_at_points(legs: DataFrame) -> DataFrame:
    """mx, my, lanes: families and lanes of the legs (ax, ay, bx, by, family, lane) that lie over each other, by midpoint."""
    mid = lambda a, b: F.round((F.col(a) + F.col(b)) / 2, 6)
    by = legs.select(mid("ax", "bx").alias("mx"), mid("ay", "by").alias("my"), "family", "lane").distinct()
    return by.groupBy("mx", "my").agg(F.array_sort(F.collect_list(F.struct("family", "lane"))).alias("lanes"))


def first_lines(legs: DataFrame) -> DataFrame:
    """a, b, line_id: for each driven pair of stations the first line that has them one after the other."""
    nxt = legs.withColumn("b", F.lead("station_id").over(line())).where("b is not null")
    return nxt.groupBy(F.col("station_id").alias("a"), "b").agg(F.min("line_id").alias("line_id"))


def welded(ends: DataFrame) -> DataFrame:
    """joint, x, y: where the ends of pieces (joint, x, y) meet, their mean."""
    return ends.groupBy("joint").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def bundle_middle(lanes: DataFrame) -> DataFrame:
    """bundle, middle: half way between the outermost lanes."""
    return lanes.groupBy("bundle").agg(((F.min("lane") + F.max("lane")) / 2).alias("middle"))


def seams(rings: DataFrame) -> DataFrame:
    """line_id, pos: where a ring is best cut, at the joint whose shorter neighbour is longest; the first of equal ones.

    rings: (line_id, pos, value, length); joints where the value changes don't qualify.
    """
    joint = rings.withColumn("before", F.lag("length").over(line())).withColumn("same", F.lag("value").over(line()) == F.col("value")).where("same")
    best = Window.partitionBy("line_id").orderBy(F.desc(F.least("before", "length")), "pos")
    return joint.withColumn("r", F.row_number().over(best)).where("r = 1").select("line_id", "pos")


def crossed_families(crossings: DataFrame) -> DataFrame:
    """seg, n: how many foreign families each segment crosses. crossings: (a, b, fa, fb)."""
    both = crossings.select(F.col("a").alias("seg"), F.col("fb").alias("family")).unionByName(crossings.select(F.col("b").alias("seg"), F.col("fa").alias("family")))
    return both.groupBy("seg").agg(F.countDistinct("family").alias("n"))


def hint_holds(here: Column, along: Column, apart: Column, ends: Column, at: Column) -> Column:
    """Whether a lane hint counts on a piece: some of `along` run here, none of `apart`, and an end is one of `at`; an
    empty list asks for nothing."""
    asks = lambda wanted, given: (F.size(wanted) == 0) | F.arrays_overlap(wanted, given)
    return asks(along, here) & asks(at, ends) & ~F.arrays_overlap(apart, here)


def hub_extents(points: DataFrame, axes: DataFrame) -> DataFrame:
    """station_id, length, breadth: a hub's points (station_id, x, y) along and across its axis (station_id, axis)."""
    a = F.radians("axis")
    turned = points.join(axes, "station_id").select("station_id", (F.col("x") * F.sin(a) + F.col("y") * F.cos(a)).alias("u"), (F.col("x") * F.cos(a) - F.col("y") * F.sin(a)).alias("v"))
    return turned.groupBy("station_id").agg((F.max("u") - F.min("u")).alias("length"), (F.max("v") - F.min("v")).alias("breadth"))


def once_at_each_place(dots: DataFrame, step: float = 0.1) -> DataFrame:
    """Of dots (id, x, y) in one place, to `step`, the first id is drawn."""
    place = lambda c: F.rint(F.col(c) / step)
    return dots.groupBy(place("x").alias("_x"), place("y").alias("_y")).agg(F.min(F.struct("id", "x", "y")).alias("d")).select("d.*")


def casing_layers(crossings: DataFrame) -> DataFrame:
    """a, b, layer, kind: what is drawn at each crossing, from below: white of every upper line, then its colour.

    Families that lie above most often come first; rank orders the crossings (a above b, family fa).
    """
    often = crossings.groupBy("fa").agg(F.count("*").alias("n"))
    rank = F.rank().over(Window.orderBy(F.desc("n"), "fa"))
    ranked = crossings.join(often.withColumn("rank", rank), "fa")  # a row for each family
    layers = F.array(F.struct(F.lit(0).alias("layer"), F.lit("white").alias("kind")), F.struct(F.lit(1).alias("layer"), F.lit("colour").alias("kind")))
    return ranked.select("a", "b", "rank", F.explode(layers).alias("l")).select("a", "b", "rank", "l.layer", "l.kind")


def joints(ends: DataFrame, hops: DataFrame, join: float) -> DataFrame:
    """piece, end, jx, jy: ends of pieces (piece, end: 0 or 1, x, y) that a line passes one after the other (hops: p, p_end, q, q_end) and
    that are closer than `join` are one joint, and so on from hop to hop; a joint lies at the mean of its ends."""
    own = ends.withColumn("e", F.col("piece") * 2 + F.col("end"))
    at = lambda p: own.select(F.col("e").alias(p), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    both = hops.select((F.col("p") * 2 + F.col("p_end")).alias("a"), (F.col("q") * 2 + F.col("q_end")).alias("b")).distinct().join(at("a"), "a").join(at("b"), "b")
    found = graph.components(both.where(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) < join).select("a", "b"))
    met = own.join(found.withColumnRenamed("node", "e"), "e")
    middle = welded(met.withColumnRenamed("component", "joint"))
    return met.select("piece", "end", F.col("component").alias("joint")).join(middle, "joint").select("piece", "end", F.col("x").alias("jx"), F.col("y").alias("jy"))


def blended(points: DataFrame, targets: DataFrame, blend: float) -> DataFrame:
    """line_id, pos, x, y: pieces (line_id, pos, x, y) drawn to the joints (piece, end, jx, jy) of their ends, less and less over `blend`
    or half of the piece; first to the start's, then to the end's."""
    whole = Window.partitionBy("line_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(line()), F.col("y") - F.lag("y").over(line())), F.lit(0.0))
    own = points.withColumn("_d", step).withColumn("s", F.sum("_d").over(so_far())).withColumn("total", F.max("s").over(whole))
    for c in ("x", "y"):
        own = own.withColumn(f"first_{c}", F.first(c).over(whole)).withColumn(f"last_{c}", F.last(c).over(whole))
    goal = targets.groupBy(F.col("piece").alias("line_id")).agg(*[F.max(F.when(F.col("end") == e, F.col(j))).alias(f"{j}{e}") for e in (0, 1) for j in ("jx", "jy")])
    own = own.join(goal, "line_id", "left").withColumn("reach", F.least(F.lit(float(blend)), F.col("total") / 2))

    def weight(along: Column) -> Column:
        return F.when(F.col("reach") > 0, smoothstep(1 - along / F.when(F.col("reach") > 0, F.col("reach")))).otherwise((along == 0).cast("double"))

    def moved(c: str) -> Column:
        shift = F.coalesce(F.col(f"j{c}0") - F.col(f"first_{c}"), F.lit(0.0))
        last = F.col(f"last_{c}") + F.when(F.col("reach") > 0, 0.0).otherwise(shift)  # only a piece without length ends where it starts
        return F.col(c) + weight(F.col("s")) * shift + weight(F.col("total") - F.col("s")) * F.coalesce(F.col(f"j{c}1") - last, F.lit(0.0))

    return own.select("line_id", "pos", moved("x").alias("x"), moved("y").alias("y"))


def crossed_near(places: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """id, n: how many foreign families cross a place's line closer than `reach` to it. places: (id, line_id, family, x, y); segments:
    (line_id, family, ax, ay, bx, by), of which those count that have an end within twice the reach."""
    wide = 2 * reach
    ends = [F.least("ax", "bx") - wide, F.least("ay", "by") - wide, F.greatest("ax", "bx") + wide, F.greatest("ay", "by") + wide]
    here = places.select("id", F.col("line_id").alias("l"), F.col("family").alias("f"), F.col("x").alias("px"), F.col("y").alias("py"))
    both = spatial.in_cells(here, [F.col("px"), F.col("py")] * 2, wide).join(spatial.in_cells(segments, ends, wide), ["cx", "cy"])
    gap = lambda a, b: F.hypot(F.col(a) - F.col("px"), F.col(b) - F.col("py"))
    both = graph.kept(both.where(F.least(gap("ax", "ay"), gap("bx", "by")) < wide).select("id", "px", "py", "l", "f", "line_id", "family", "ax", "ay", "bx", "by"))
    other = both.where("family <> f").select("id", "family", *[F.col(c).alias(f"o{c}") for c in ("ax", "ay", "bx", "by")])
    mine = both.where("line_id = l").drop("family").join(other, "id")
    dx, dy, ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("obx") - F.col("oax"), F.col("oby") - F.col("oay")
    qx, qy = F.col("oax") - F.col("ax"), F.col("oay") - F.col("ay")
    det = (dx * ey - dy * ex).cast("double")
    det = F.when(F.abs(det) >= 1e-9, det)
    t, u = (qx * ey - qy * ex) / det, (qx * dy - qy * dx) / det
    met = F.hypot(F.col("ax") + t * dx - F.col("px"), F.col("ay") + t * dy - F.col("py")) < reach
    n = mine.where(t.between(0, 1) & u.between(0, 1) & met).groupBy("id").agg(F.countDistinct("family").alias("n"))
    return places.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rotated(rings: DataFrame, starts: DataFrame) -> DataFrame:
    """rings (line_id, pos from 1, ...) numbered from the places (line_id, pos) on; a ring without such a place stays."""
    n = F.count("*").over(Window.partitionBy("line_id"))
    at = rings.withColumn("_n", n).join(starts.select("line_id", F.col("pos").alias("_start")), "line_id", "left")
    return at.withColumn("pos", F.pmod(F.col("pos") - F.coalesce("_start", F.lit(1)), F.col("_n")) + 1).select(rings.columns)


def routed(pairs: DataFrame, stations: DataFrame, nodes: DataFrame, edges: DataFrame, radius: float, snap_weight: float = 3.0) -> DataFrame:
    """a, b, cost, path: the cheapest way over the tracks (nodes: node, x, y; edges: a, b, w) of each pair of stations.

    pairs: (place, a, b), of which each undirected pair is routed once, the way its first place has it. A way starts and ends at any
    node within the radius of its stations (station_id, x, y), at snap_weight times the distance. No way is an error.
    """
    once = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy("place", "a")
    first = pairs.withColumn("_r", F.row_number().over(once)).where("_r = 1")
    wanted = graph.kept(first.select(F.struct("a", "b").alias("route"), "a", "b"))
    asked = wanted.select(F.explode(F.array("a", "b")).alias("station_id")).distinct()
    snap = graph.kept(spatial.near(asked.join(stations, "station_id").select(F.col("station_id").alias("id"), "x", "y"), nodes, radius).select("id", "node", (F.col("d") * snap_weight).alias("cost")))
    side = lambda c: wanted.join(snap.withColumnRenamed("id", c), c).select("route", "node", "cost")
    ways = graph.kept(graph.routes(edges, side("a"), side("b")))
    require_empty(wanted.join(ways, "route", "left_anti").select("a", "b"), "no way over the tracks")
    return ways.select("route.a", "route.b", "cost", "path")
