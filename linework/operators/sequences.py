"""Operators on ordered steps, legs and vertices: windows over one line at a time.

All take rows of (line_id, pos, ...); a line's rows are one window partition, and nothing else is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from linework.functions import geometry as G
from linework.storage import Rounds


def line() -> WindowSpec:
    """A line's rows in order."""
    return Window.partitionBy("line_id").orderBy("pos")


def so_far() -> WindowSpec:
    return line().rowsBetween(Window.unboundedPreceding, 0)


def pairs(steps: DataFrame) -> DataFrame:
    """Consecutive stations (a, b) with the leg's columns."""
    return steps.withColumn("b", F.lead("station_id").over(line())).where("b is not null").withColumnRenamed("station_id", "a")


def segments(steps: DataFrame) -> DataFrame:
    """line_id, seg, a, b, modifiers, turn: steps with turns between stations, cut at the stations.

    steps: (line_id, pos, station_id or null, turn or null); a step is a station or a turn.
    """
    numbered = steps.withColumn("seg", F.count("station_id").over(so_far()))
    by = numbered.where("seg > 0").groupBy("line_id", "seg").agg(F.max("station_id").alias("a"), F.count("turn").alias("modifiers"), F.coalesce(F.sum("turn"), F.lit(0)).alias("turn"))
    after = Window.partitionBy("line_id").orderBy("seg")
    return by.withColumn("b", F.lead("a").over(after)).where("b is not null")


def running_bearing(legs: DataFrame, start: int) -> DataFrame:
    """bearing: the start and all turns so far, modulo 360."""
    return legs.withColumn("bearing", F.pmod(F.lit(start) + F.sum("turn").over(so_far()), F.lit(360)))


def curve_room(legs: DataFrame) -> DataFrame:
    """minimum: a leg is at least as long as the tangents of the curves at its two ends.

    The curve of `turn` lies at the end of its leg.
    """
    tangent = F.when(F.col("turn") == 0, 0.0).otherwise(G.curve_radius(F.col("turn")) * G.tangent_factor(F.col("turn")))
    with_tangent = legs.withColumn("tangent", tangent)
    before = F.coalesce(F.lag("tangent").over(line()), F.lit(0.0))
    return with_tangent.withColumn("minimum", F.greatest(F.col("len").cast("double"), before + F.col("tangent"))).drop("tangent")


def deferred(legs: DataFrame, value: Column, may_change: Column) -> DataFrame:
    """lane: the value changes only where may_change holds, and on the first leg."""
    first = F.row_number().over(line()) == 1
    return legs.withColumn("lane", F.last(F.when(first | may_change, value), ignorenulls=True).over(so_far()))


def walked(legs: DataFrame, start: int) -> DataFrame:
    """x, y: where each leg ends, walking from (0, 0); bearing 0 is north, clockwise, y upwards."""
    b = running_bearing(legs, start)
    rad = F.radians("bearing")
    return b.withColumn("x", F.sum(F.sin(rad) * F.col("len")).over(so_far())).withColumn("y", F.sum(F.cos(rad) * F.col("len")).over(so_far()))


def arc_length(points: DataFrame) -> DataFrame:
    """s: the length from the line's first vertex."""
    step = F.hypot(F.col("x") - F.lag("x").over(line()), F.col("y") - F.lag("y").over(line()))
    return points.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("s", F.sum("_step").over(so_far())).drop("_step")


def moving_average(points: DataFrame, window: int, cyclic: bool = False) -> DataFrame:
    """sx, sy: means over `window` vertices around each.

    Beyond an open line's ends its end vertices repeat, and they stay where they are; a closed line goes on at its
    other end. Lines of at most `window` vertices keep theirs.
    """
    back, front = window // 2, window - 1 - window // 2
    whole = Window.partitionBy("line_id")
    out = points.withColumn("_k", F.row_number().over(line())).withColumn("_n", F.count("*").over(whole))
    if cyclic:
        turns = F.array(F.lit(0), F.when(F.col("_k") > F.col("_n") - back, F.lit(-1)), F.when(F.col("_k") <= front, F.lit(1)))
        out = out.withColumn("_turn", F.explode(F.filter(turns, lambda t: t.isNotNull()))).withColumn("_k", F.col("_k") + F.col("_turn") * F.col("_n"))
    near = Window.partitionBy("line_id").orderBy("_k").rowsBetween(-back, front)
    before = F.greatest(F.lit(0), F.lit(back + 1) - F.col("_k")) if not cyclic else F.lit(0)
    after = F.greatest(F.lit(0), F.lit(front) - (F.col("_n") - F.col("_k"))) if not cyclic else F.lit(0)
    for axis in ("x", "y"):
        first, last = F.min_by(axis, "_k").over(whole), F.max_by(axis, "_k").over(whole)
        mean = (F.sum(axis).over(near) + before * first + after * last) / window
        fixed = F.col("_n") <= window if cyclic else (F.col("_n") <= window) | (F.col("_k") == 1) | (F.col("_k") == F.col("_n"))
        out = out.withColumn(f"s{axis}", F.when(fixed, F.col(axis).cast("double")).otherwise(mean) if window > 1 else F.col(axis).cast("double"))
    if cyclic:
        out = out.where("_turn = 0").drop("_turn")
    return out.drop("_k", "_n")


def resampled(points: DataFrame, step: float = 1.0, parts: int = 0, keep_still: bool = True) -> DataFrame:
    """line_id, i, x, y: equally spaced, in `parts` parts or else ceil(length / step), both ends kept.

    A line of no length keeps its first vertex, or is left out unless keep_still. All lines take one pass, and what is the same along a leg is
    computed once for it, not for each of its places.
    """
    whole = Window.partitionBy("line_id")
    n = (F.lit(parts) if parts else F.greatest(F.ceil(F.col("total") / step), F.lit(1))).cast("long")
    s = arc_length(points).withColumn("total", F.max("s").over(whole)).withColumn("n", n)
    ahead = s.select("*", *[F.lead(c).over(line()).alias(f"{c}1") for c in ("s", "x", "y")], (F.row_number().over(line()) == 1).alias("_first"))
    still = F.col("_first") & (F.col("total") == 0) if keep_still else F.lit(False)
    legs = ahead.where((F.col("s1") > F.col("s")) | still).withColumn("still", still).withColumn("gap", F.col("total") / F.col("n"))
    low, high = F.ceil(F.col("s") / F.col("gap") - 1e-9).cast("long"), F.ceil(F.col("s1") / F.col("gap") - 1e-9).cast("long") - 1
    upto = F.when(F.col("s1") >= F.col("total"), F.col("n")).otherwise(high)
    here = F.when(F.col("still"), F.array(F.lit(0).cast("long"))).when(upto >= low, F.sequence(low, upto)).otherwise(F.array().cast("array<bigint>"))
    t = (F.col("i") * F.col("gap") - F.col("s")) / (F.col("s1") - F.col("s"))
    at = lambda c: F.when(F.col("still"), F.col(c).cast("double")).otherwise(F.col(c) + t * (F.col(f"{c}1") - F.col(c))).alias(c)
    return legs.withColumn("i", F.explode(here)).select("line_id", "i", at("x"), at("y"))


def sliced(points: DataFrame, start: float, stop: float) -> DataFrame:
    """line_id, k, x, y: the part between two arc lengths, with its ends interpolated; k orders."""
    s = arc_length(points)
    ahead = s.select("line_id", "pos", "x", "y", "s", F.lead("s").over(line()).alias("s1"), F.lead("x").over(line()).alias("x1"), F.lead("y").over(line()).alias("y1"))
    inside = s.where(F.col("s").between(start, stop)).select("line_id", F.col("s").alias("k"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    for at in (start, stop):
        t = (F.lit(at) - F.col("s")) / (F.col("s1") - F.col("s"))
        cut = ahead.where((F.col("s") < at) & (F.col("s1") > at)).select("line_id", F.lit(float(at)).alias("k"), (F.col("x") + t * (F.col("x1") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y1") - F.col("y"))).alias("y"))
        inside = inside.unionByName(cut)
    return inside


def islands(rows: DataFrame, keys: list[str], order: str, value: Column, name: str = "island") -> DataFrame:
    """island: number of the run of equal values, from 1, within keys."""
    w = Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)
    out = rows.withColumn("_v", value)
    return out.withColumn("_new", F.when(F.col("_v").eqNullSafe(F.lag("_v").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_v", "_new")


def corners(points: DataFrame, reach: int, threshold: float) -> DataFrame:
    """line_id, pos, turn: the strongest vertex of each run whose heading turns by threshold degrees or more over
    2 * reach vertices."""
    back, front = F.lag("x", reach).over(line()), F.lead("x", reach).over(line())
    backy, fronty = F.lag("y", reach).over(line()), F.lead("y", reach).over(line())
    into, out = F.atan2(F.col("y") - backy, F.col("x") - back), F.atan2(fronty - F.col("y"), front - F.col("x"))
    turn = F.degrees(out - into)
    wrapped = F.pmod(turn + 180, F.lit(360.0)) - 180
    heads = points.withColumn("turn", wrapped).withColumn("_on", F.coalesce(F.abs("turn") >= threshold, F.lit(False)))
    runs = islands(heads, ["line_id"], "pos", F.col("_on")).where("_on")
    best = Window.partitionBy("line_id", "island").orderBy(F.desc(F.round(F.abs("turn"), 6)), "pos")
    return runs.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("line_id", "pos", "turn")


def turns(points: DataFrame, k: int, limit: float) -> DataFrame:
    """line_id, pos, turn: the sharpest place of each run that turns by more than `limit` radians over 2 * k steps; places at most k
    apart are one run, of equally sharp ones the first counts. Headings are unwrapped: each step's change is the smaller way round.
    Lines (line_id, pos without gaps, x, y) of fewer than 8 * k points have none."""
    heading = F.atan2((F.lead("y").over(line()) - F.col("y")).cast("double"), (F.lead("x").over(line()) - F.col("x")).cast("double"))
    change = F.lead("_h").over(line()) - F.col("_h")
    bend = F.pmod(change + F.lit(math.pi), F.lit(2 * math.pi)) - F.lit(math.pi)
    n = F.count("*").over(Window.partitionBy("line_id"))
    own = points.select("line_id", "pos", "x", "y").withColumn("_n", n).withColumn("_h", heading).withColumn("_bend", bend)
    ahead = line().rowsBetween(0, 2 * k - 1)
    own = own.withColumn("turn", F.round(F.abs(F.sum("_bend").over(ahead)), 9)).withColumn("_full", F.count("_bend").over(ahead))
    sharp = own.where((F.col("_n") >= 8 * k) & (F.col("_full") == 2 * k) & (F.col("turn") > limit))
    run = F.sum(F.coalesce(F.col("pos") - F.lag("pos").over(line()) > k, F.lit(True)).cast("int")).over(so_far())
    return sharp.withColumn("_run", run).groupBy("line_id", "_run").agg(F.max(F.struct("turn", (-F.col("pos")).alias("p"))).alias("b")).select("line_id", (k - F.col("b.p")).alias("pos"), "b.turn")


def directions(points: DataFrame, length: float, from_end: bool = False) -> DataFrame:
    """line_id, dx, dy: where the first (or last) `length` of each line leads, taken to (or from) the first vertex at or behind that
    place; lines without length are left out."""
    whole = Window.partitionBy("line_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = arc_length(points).withColumn("_i", F.row_number().over(line())).withColumn("_n", F.max("_i").over(whole)).withColumn("_total", F.max("s").over(whole))
    reached = F.min(F.when(F.col("s") >= (F.col("_total") - length if from_end else F.lit(length)), F.col("_i"))).over(whole)
    at = F.greatest(F.least(reached, F.col("_n") - 1), F.lit(1)) if from_end else F.least(F.greatest(F.coalesce(reached, F.col("_n")), F.lit(2)), F.col("_n"))
    place = lambda c: F.max(F.when(F.col("_i") == F.col("_at"), F.col(c)))
    end = lambda c: F.max(F.when(F.col("_i") == F.col("_n"), F.col(c))) - place(c) if from_end else place(c) - F.max(F.when(F.col("_i") == 1, F.col(c)))
    return own.where("_total > 0").withColumn("_at", at).groupBy("line_id").agg(end("x").alias("dx"), end("y").alias("dy"))


def steps_array(steps: DataFrame) -> DataFrame:
    """line_id, steps: a line's stations in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "station_id")))
    return steps.groupBy("line_id").agg(F.transform(ordered, lambda s: s["station_id"]).alias("steps"))


def find(steps: str, pattern: Column) -> Column:
    """1-based place of the first occurrence of pattern in the array column `steps`; 0 if absent."""
    return F.coalesce(F.try_element_at(F.filter(F.sequence(F.lit(1), F.size(steps)), lambda i: F.slice(steps, i, F.size(pattern)) == pattern), F.lit(1)), F.lit(0))


def spliced(lines: DataFrame, old: Column, new: Column, strict: bool = True) -> DataFrame:
    """The first occurrence of old becomes new; absent: an error, or unchanged if not strict."""
    at = F.when(F.size("steps") > 0, find("steps", old)).otherwise(0)
    done = F.concat(F.slice("steps", F.lit(1), at - 1), new, F.slice("steps", at + F.size(old), F.size("steps")))
    missing = F.raise_error(F.lit("the steps to replace aren't there")).cast(lines.schema["steps"].dataType) if strict else F.col("steps")
    return lines.withColumn("steps", F.when(at > 0, done).otherwise(missing))


def rewritten(lines: DataFrame, rules: list[tuple[Column, Column]]) -> DataFrame:
    """Rules (old, new) one after the other on every line, in the direction it is driven; lines with neither stay.

    Where old stands backwards, new is put in backwards too, so that lines of both directions keep the same edges.
    """
    for old, new in rules:
        there = F.when(F.size("steps") > 0, find("steps", old) > 0).otherwise(False)
        lines = spliced(lines.withColumn("_ahead", there), F.when(there, old).otherwise(F.reverse(old)), F.when(F.col("_ahead"), new).otherwise(F.reverse(new)), strict=False).drop("_ahead")
    return lines


def inserted(lines: DataFrame, anchor: Column, new: Column) -> DataFrame:
    """new follows the first anchor; a line without it stays."""
    at = F.array_position("steps", anchor).cast("int")
    return lines.withColumn("steps", F.when(at > 0, F.concat(F.slice("steps", F.lit(1), at), new, F.slice("steps", at + 1, F.size("steps")))).otherwise(F.col("steps")))


def between(lines: DataFrame, start: Column, stop: Column) -> DataFrame:
    """The steps from one station to another, both included, in driving direction; none if they aren't in this order."""
    a, b = F.array_position("steps", start).cast("int"), F.array_position("steps", stop).cast("int")
    return lines.withColumn("steps", F.when((a > 0) & (b >= a), F.slice("steps", a, b - a + 1)).otherwise(F.slice("steps", F.lit(1), F.lit(0))))


def reversed_legs(legs: DataFrame) -> DataFrame:
    """Legs driven the other way: order and turns' signs change."""
    return legs.withColumn("pos", F.count("*").over(Window.partitionBy("line_id")) + 1 - F.row_number().over(line())).withColumn("turn", -F.col("turn"))


def alternating(points: DataFrame) -> DataFrame:
    """side: top and bottom in turn along each row of equal y (6 decimals), by x, then id."""
    row = Window.partitionBy(F.round("y", 6)).orderBy("x", "id")
    return points.withColumn("side", F.when(F.row_number().over(row) % 2 == 1, "top").otherwise("bottom"))


def running_boxes(rows: DataFrame, keys: list[str], order: list[str], size: Column, gap: float = 0.0) -> DataFrame:
    """offset: where each box starts when boxes stand one behind the other with gaps."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(size + F.lit(gap)).over(w), F.lit(0.0)))


def extended(lines: DataFrame, front: Column, back: Column) -> DataFrame:
    """Steps before and behind a line's own."""
    return lines.withColumn("steps", F.concat(front, F.col("steps"), back))


def contains(steps: str, pattern: Column) -> Column:
    """Whether the pattern's steps stand one behind the other in the array column `steps`."""
    return F.when(F.size(steps) > 0, find(steps, pattern) > 0).otherwise(False)


def curve_runs(points: DataFrame, curvature: float, turn: float, gap: float) -> DataFrame:
    """line_id, run, start, stop, turn: stretches (arc length s) that bend one way, by `turn` degrees or more in all.

    points: (line_id, pos, s, bend, reach): the bend in degrees at each vertex over a length. Vertices that bend less than
    `curvature` degrees a unit don't count; stretches of one sense less than `gap` apart are one.
    """
    bent = points.where(F.abs("bend") >= curvature * F.col("reach")).withColumn("sense", F.signum(F.col("bend").cast("double")))
    new = (F.col("sense") != F.lag("sense").over(line())) | (F.col("s") - F.lag("s").over(line()) > gap)
    runs = bent.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("_new").over(so_far()))
    by = runs.groupBy("line_id", "run").agg(F.min("s").alias("start"), F.max("s").alias("stop"), F.sum("bend").alias("turn"))
    return by.where(F.abs("turn") >= turn)


def simplified(vertices: DataFrame, tolerance: float, key: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """The vertices that stay, unchanged, when a line may leave its own course by the tolerance.

    vertices: (*key, pos, x, y, ...). All open stretches of all lines are cut at once, each at its farthest vertex (the first of
    equals) if that lies farther than the tolerance from the chord between its ends, or from the first end where both ends are one place.
    A round is one window over what is left: a vertex carries the ends of its stretch, and what lies within the tolerance goes.
    Lines of two vertices or fewer stay, and so does everything at a tolerance of 0.
    """
    if tolerance <= 0:
        return vertices
    spark, keys = vertices.sparkSession, list(key)
    spot = F.struct("pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    all_ = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(spot).over(all_), F.last(spot).over(all_)
    rows = vertices.select(*keys, spot.alias("at"), first.alias("a"), last.alias("b"))
    done = Rounds(spark, "simplified")
    stays = lambda at: (F.col("at.pos") == F.col(f"{at}.pos"))
    open_, left = done.add(rows.withColumn("stays", stays("a") | stays("b")))
    cx, cy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    dx, dy = F.col("at.x") - F.col("a.x"), F.col("at.y") - F.col("a.y")
    chord = F.sqrt(cx * cx + cy * cy)
    off = F.when(chord == 0, F.sqrt(dx * dx + dy * dy)).otherwise(F.abs(dy * cx - dx * cy) / chord)
    while left:
        far = F.max(F.struct(F.col("off"), (-F.col("at.pos")).alias("back"), F.col("at"))).over(Window.partitionBy(*keys, "a.pos"))
        cut = open_.where("not stays").withColumn("off", off).withColumn("far", far).where(F.col("far.off") > tolerance)
        side = F.col("at.pos") < F.col("far.at.pos")
        cut = cut.select(*keys, "at", F.when(side, F.col("a")).otherwise(F.col("far.at")).alias("a"), F.when(side, F.col("far.at")).otherwise(F.col("b")).alias("b"), (F.col("at.pos") == F.col("far.at.pos")).alias("stays"))
        open_, left = done.add(cut)
    return vertices.join(done.all(spark).where("stays").select(*keys, F.col("at.pos").alias("pos")), [*keys, "pos"], "left_semi")
