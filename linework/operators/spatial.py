"""Spatial joins as equality joins on grid cells, so that only neighbours meet.

A pair that shares several cells is taken in one of them alone. Cells are as wide as the joins' reach; a side is only
copied to the cells that it overlaps. Cells are dealt over all tasks, and a search for one of many looks near by first.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linework.functions.geometry import boxes_overlap, segment_hits_box
from linework.operators.graph import kept


def cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long"))


def in_cells(rows: DataFrame, box: list[Column], cell: float) -> DataFrame:
    """One row for each cell (cx, cy) that the row's box overlaps."""
    return rows.withColumn("cx", F.explode(cells(box[0], box[2], cell))).withColumn("cy", F.explode(cells(box[1], box[3], cell)))


def tasks(spark: SparkSession) -> int:
    """How many tasks work is dealt over whose size rows don't show."""
    return max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(rows: DataFrame, *more: str, least: int = 0) -> DataFrame:
    """rows dealt over tasks (`least` or more) by their cells (cx, cy and more), in a number of tasks that stays as it is: points of a table of few
    megabytes can have billions of pairs, which sizes don't show, so that Spark would join them in one task or put cells together in a few."""
    return rows.repartition(max(tasks(rows.sparkSession), least), *more, "cx", "cy")


def met(a: DataFrame, b: DataFrame, on: Column | None = None, how: str = "inner", more: tuple[str, ...] = (), least: int = 0, way: str = "shuffle_hash") -> DataFrame:
    """Rows of a and b in the same cell (and of the same `more`), joined where they were dealt, in the given way."""
    a, b = dealt(a, *more, least=least).alias("_a"), dealt(b, *more, least=least).hint(way).alias("_b")
    keys = [*more, "cx", "cy"]
    if on is None:
        return a.join(b, keys, how)
    same = on
    for k in keys:
        same = same & (F.col(f"_a.{k}") == F.col(f"_b.{k}"))
    return a.join(b, same, how)


def spacing(rows: DataFrame, x: Column, y: Column) -> float:
    """The side of a square that holds one of the rows on average; 0 if they have no extent."""
    low = rows.agg(F.count(x).alias("n"), *[f(c).cast("double").alias(k) for k, f, c in (("x0", F.min, x), ("x1", F.max, x), ("y0", F.min, y), ("y1", F.max, y))]).first()
    if not low["n"]:
        return 0.0
    return ((low["x1"] - low["x0"]) * (low["y1"] - low["y0"]) / low["n"]) ** 0.5


def passed_cells(segments: DataFrame, cell: float, margin: float = 0.0) -> DataFrame:
    """One row for each cell that the segment itself passes, or comes as near to as the margin along each axis; not its whole box."""
    slack = margin + cell / 1000  # a place that is computed on the segment may lie beside it by a rounding
    box = [F.least("ax", "bx") - slack, F.least("ay", "by") - slack, F.greatest("ax", "bx") + slack, F.greatest("ay", "by") + slack]
    x0, y0 = F.col("cx") * cell, F.col("cy") * cell
    return in_cells(segments, box, cell).where(segment_hits_box(*[F.col(c) for c in ("ax", "ay", "bx", "by")], x0, y0, x0 + cell, y0 + cell, slack))


def near(probes: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """probe columns, node, d: points (node, x, y) within the radius of probes (id, x, y)."""
    at = in_cells(points.select("node", F.col("x").alias("nx"), F.col("y").alias("ny")), [F.col("nx"), F.col("ny")] * 2, radius)
    reach = [F.col("x") - radius, F.col("y") - radius, F.col("x") + radius, F.col("y") + radius]
    both = met(in_cells(probes, reach, radius), at)
    d2 = (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny"))
    return both.where(d2 <= radius * radius).select("id", "x", "y", "node", "nx", "ny", F.sqrt(d2.cast("double")).alias("d"))


#: How many cells of one level lie side by side in a cell of the level above.
FAN = 4


def pyramid(at: DataFrame) -> list[DataFrame]:
    """(cx, cy, x0, y0, x1, y1) for each level, finest first: the box around the points (cx, cy, x, y) of each cell that has any.

    Cells are numbered from 0, so that the last level is the one cell (0, 0).
    """
    box = [F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")]
    out = [kept(at.groupBy("cx", "cy").agg(*box))]
    up = [F.floor(F.col(c) / FAN).alias(c) for c in ("cx", "cy")]
    wider = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    while out[-1].limit(2).count() > 1:
        out.append(kept(out[-1].groupBy(*up).agg(*wider)))
    return out


def nearest(probes: DataFrame, points: DataFrame, radius: float, most: float | None = None) -> DataFrame:
    """id, node, d: the nearest point (node, x, y) of each probe (id, x, y), the smaller node of equal ones; with `most`, if it is that near.

    Points at one place are one, and where points are dense the radius shrinks to their spacing, so that a probe meets a few of them.

    Probes without a point in the radius go down a pyramid of cells: at each level a probe keeps the cells whose nearest corner may
    be as near as the farthest corner of another. So a far probe meets a few boxes for each level, and cells stay as small as the
    radius. Probes and points without coordinates take no part; without any point the result is empty.
    """
    here = F.col("x").isNotNull() & F.col("y").isNotNull()
    probes, points = probes.where(here).select("id", "x", "y"), points.where(here).groupBy("x", "y").agg(F.min("node").alias("node"))
    points = kept(points)
    best = F.min(F.struct("d", "node")).alias("b")
    apart = spacing(points, F.col("x"), F.col("y"))
    radius = min(radius, 2 * apart) if apart > 0 else radius
    within = F.lit(True) if most is None else F.col("d2") <= most * most
    all_found = kept(near(probes, points, radius).groupBy("id").agg(best).select("id", "b.node", "b.d"))
    found = all_found if most is None or radius <= most else all_found.where(F.col("d") <= most)
    left = kept(probes.join(all_found.select("id"), "id", "left_anti"))
    cell = [F.floor(F.col(c) / radius).cast("long") for c in ("x", "y")]
    low = points.agg(F.min(cell[0]), F.min(cell[1])).first()
    if low[0] is None or not left.limit(1).count():
        return found
    at = points.select("node", "x", "y", (cell[0] - low[0]).alias("cx"), (cell[1] - low[1]).alias("cy"))
    asked = left.select("id", "x", "y", F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))
    below = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1))
    least = lambda c: F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0))
    most = lambda c: F.greatest(F.col(f"{c}1") - F.col(c), F.col(c) - F.col(f"{c}0"))
    squares = lambda f: (f("x") * f("x") + f("y") * f("y")).cast("double")
    for boxes in reversed(pyramid(at)[:-1]):
        both = asked.withColumn("cx", below("cx")).withColumn("cy", below("cy")).join(boxes, ["cx", "cy"])
        bound = F.min(squares(most)).over(Window.partitionBy("id"))
        asked = kept(both.withColumn("bound", bound).where(squares(least) <= F.col("bound")).select("id", "x", "y", "cx", "cy"))
    far = asked.join(at.select("cx", "cy", "node", F.col("x").alias("nx"), F.col("y").alias("ny")), ["cx", "cy"])
    dx, dy = F.col("x") - F.col("nx"), F.col("y") - F.col("ny")
    far = far.withColumn("d2", (dx * dx + dy * dy).cast("double")).where(within).select("id", "node", F.sqrt("d2").alias("d")).groupBy("id").agg(best).select("id", "b.node", "b.d")
    return found.unionByName(kept(far))


def overlapping(boxes: DataFrame, cell: float) -> DataFrame:
    """a, b (a < b): ids of boxes (id, x0, y0, x1, y1) that share inner points."""
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    own = in_cells(boxes.select("id", *box), box, cell)
    other = own.select("cx", "cy", *[F.col(c).alias(f"o_{c}") for c in ("id", "x0", "y0", "x1", "y1")])
    o = [F.col(f"o_{c}") for c in ("x0", "y0", "x1", "y1")]
    first = (F.col("cx") == F.floor(F.greatest("x0", "o_x0") / cell)) & (F.col("cy") == F.floor(F.greatest("y0", "o_y0") / cell))
    return met(own, other).where((F.col("id") < F.col("o_id")) & boxes_overlap(box, o) & first).select(F.col("id").alias("a"), F.col("o_id").alias("b"))


#: Boxes that hits tests as one, if they are the same box, and boxes whose pairs one task of it makes.
TOGETHER, TASK_BOXES = 100, 25_000


def hits(segments: DataFrame, boxes: DataFrame, cell: float, margin: float = 0.0) -> DataFrame:
    """seg, box: segments (seg, ax, ay, bx, by) that touch boxes (box, x0, y0, x1, y1) grown by the margin.

    Boxes with the same corners are tested once, TOGETHER of them at most, and their pairs written out after that. A segment and a box of which neither's
    bounding box is apart touch unless all corners lie on one side of the segment; that takes no division, and whole numbers stay exact. They meet in
    cells of half of `cell`; tasks grow in number with the boxes.
    """
    cell = cell / 2
    corners = ["x0", "y0", "x1", "y1"]
    nth = F.row_number().over(Window.partitionBy(*corners).orderBy("box")) - 1
    same = boxes.select("box", *corners).where(" and ".join(f"{c} is not null" for c in corners)).withColumn("nth", nth).withColumn("part", F.floor(F.col("nth") / TOGETHER))
    same = same.withColumn("boxes", F.collect_list("box").over(Window.partitionBy(*corners, "part"))).where(F.col("nth") == F.col("part") * TOGETHER)
    b = same.select("boxes", *[(F.col(c) - margin).alias(c) for c in corners[:2]], *[(F.col(c) + margin).alias(c) for c in corners[2:]])
    s = segments.select("seg", "ax", "ay", *[(F.col(f"b{c}") - F.col(f"a{c}")).alias(f"d{c}") for c in "xy"], *[f(f"a{c}", f"b{c}").alias(f"{k}{c}") for k, f in (("l", F.least), ("h", F.greatest)) for c in "xy"])
    at_start = lambda cells_, low: F.col(cells_) == F.floor(F.col(low) / cell).cast("long")
    s = in_cells(s, [F.col(c) for c in ("lx", "ly", "hx", "hy")], cell).withColumn("s_left", at_start("cx", "lx")).withColumn("s_low", at_start("cy", "ly"))
    b = in_cells(b, [F.col(c) for c in corners], cell).withColumn("b_left", at_start("cx", "x0")).withColumn("b_low", at_start("cy", "y0"))
    first = (F.col("s_left") | F.col("b_left")) & (F.col("s_low") | F.col("b_low"))
    beside = (F.col("lx") <= F.col("x1")) & (F.col("x0") <= F.col("hx")) & (F.col("ly") <= F.col("y1")) & (F.col("y0") <= F.col("hy"))
    middle = F.abs(F.col("dx") * (F.col("y0") + F.col("y1") - 2 * F.col("ay")) - F.col("dy") * (F.col("x0") + F.col("x1") - 2 * F.col("ax")))
    both_sides = middle <= F.abs("dx") * (F.col("y1") - F.col("y0")) + F.abs("dy") * (F.col("x1") - F.col("x0"))
    # in coalesce, because Spark would take conditions on one side alone from it and compute all that they need once more
    touch = F.coalesce(first & beside & both_sides, F.lit(False))
    return met(s, b, least=boxes.count() // TASK_BOXES + 1, way="merge").where(touch).select("seg", F.explode("boxes").alias("box"))


def _cross() -> tuple[Column, Column, Column]:
    """Whether segments (ax, ay, bx, by) and (o_ax, ...) cross inside both, and where."""
    dx, dy, ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("o_bx") - F.col("o_ax"), F.col("o_by") - F.col("o_ay")
    qx, qy = F.col("o_ax") - F.col("ax"), F.col("o_ay") - F.col("ay")
    det, t, u = dx * ey - dy * ex, qx * ey - qy * ex, qx * dy - qy * dx
    # 0 < t / det < 1 without dividing, so that whole numbers stay exact
    sign = F.signum(det.cast("double"))
    inside = (det != 0) & (t * sign > 0) & (t * sign < F.abs(det)) & (u * sign > 0) & (u * sign < F.abs(det))
    share = t / det.cast("double")
    return inside, F.col("ax") + share * dx, F.col("ay") + share * dy


def _others(own: DataFrame) -> DataFrame:
    return own.select("cx", "cy", *[F.col(c).alias(f"o_{c}") for c in ("seg", "family", "ax", "ay", "bx", "by")])


def crossings(segments: DataFrame, cell: float) -> DataFrame:
    """a, b, x, y: segments (seg, family, ax, ay, bx, by) of different families that cross inside both; a < b. Segments meet in the cells
    that they pass, of a quarter of `cell`; a crossing is taken in the cell that it lies in."""
    cell = cell / 4
    own = passed_cells(segments.select("seg", "family", "ax", "ay", "bx", "by"), cell)
    inside, x, y = _cross()
    here = (F.floor(x / cell) == F.col("cx")) & (F.floor(y / cell) == F.col("cy"))
    pairs = met(own, _others(own)).where((F.col("seg") < F.col("o_seg")) & (F.col("family") != F.col("o_family")) & inside)
    return pairs.where(here).select(F.col("seg").alias("a"), F.col("o_seg").alias("b"), x.alias("x"), y.alias("y"))


def crossed(segments: DataFrame, cell: float) -> DataFrame:
    """seg, family: the other families that each segment (seg, family, ax, ay, bx, by) crosses inside both. A segment asks each family
    of a cell, of a quarter of `cell`, until one of its segments answers, so that its other crossings aren't looked at."""
    cell = cell / 4
    own = passed_cells(segments.select("seg", "family", "ax", "ay", "bx", "by"), cell)
    there = own.select("cx", "cy", F.col("family").alias("wanted")).distinct()
    asked = met(own, there).where("family <> wanted").select("cx", "cy", "wanted", "seg", "ax", "ay", "bx", "by")
    inside, _, _ = _cross()
    other = _others(own).withColumnRenamed("o_family", "wanted")
    return met(asked, other, inside, "left_semi", ("wanted",)).select("seg", F.col("wanted").alias("family")).distinct()


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """box, n: how many points (x, y) lie in each box, edges included; boxes without any are absent."""
    cell = cell / 3
    places = points.groupBy("x", "y").agg(F.count("*").alias("k"))  # points at one place are counted once for all boxes
    at = in_cells(places, [F.col("x"), F.col("y")] * 2, cell)
    box = in_cells(boxes.select("box", "x0", "y0", "x1", "y1"), [F.col(c) for c in ("x0", "y0", "x1", "y1")], cell)
    return met(box, at).where("x between x0 and x1 and y between y0 and y1").groupBy("box").agg(F.sum("k").alias("n"))


def nearest_segment(probes: DataFrame, segments: DataFrame, radius: float, apart: Column | None = None) -> DataFrame:
    """id, seg, t, d: the nearest segment within the radius of each probe (id, x, y) and where on it (0 to 1); of the pairs of id
    and seg that meet the condition `apart`, if given.

    Probes look as far as segments lie apart on average, then four times as far each time, those that found nothing.
    """
    segments, left = kept(segments), kept(probes)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n2 = (dx * dx + dy * dy).cast("double")
    t = F.when(n2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / n2))).otherwise(0.0)
    d = F.hypot(F.col("x") - (F.col("ax") + t * dx), F.col("y") - (F.col("ay") + t * dy))
    best = F.min(F.struct(d.alias("d"), F.col("seg"), t.alias("t")))
    parts = []
    for reach in reaches(spacing(segments, F.col("ax"), F.col("ay")), radius):
        cell = min(4 * reach, radius)
        both = met(in_cells(left, [F.col("x"), F.col("y")] * 2, cell), passed_cells(segments, cell, reach))
        both = both if apart is None else both.where(apart)
        parts.append(kept(both.where(d <= reach).groupBy("id").agg(best.alias("b")).select("id", "b.seg", "b.t", "b.d")))
        left = kept(left.join(parts[-1].select("id"), "id", "left_anti")) if reach < radius else left
    return functools.reduce(DataFrame.unionByName, parts)


def reaches(first: float, last: float) -> list[float]:
    """Distances from the first, four times as far each time, to the last."""
    out = [first if 0 < first < last else last]
    while out[-1] < last:
        out.append(min(4 * out[-1], last))
    return out


def located(names: DataFrame, stops: DataFrame, tracks: DataFrame, most: float, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed, missing) of names (id, key) among stops (key, x, y) near the track points (node, x, y). aliases: (id, alias), keys
    that some ids are looked up by instead.

    A station is the mean of its name's stops that lie within `most` of the tracks and of the best of them; it is
    missing without a stop of its name, or if none is that near.
    """
    if aliases is not None:
        names = names.join(aliases.select("id", "alias"), "id", "left").withColumn("key", F.coalesce("alias", "key")).drop("alias")
    numbered = kept(stops.withColumn("stop", F.monotonically_increasing_id()))
    wanted = numbered.join(names.select("key").distinct(), "key", "left_semi")
    on_track = nearest(wanted.select(F.col("stop").alias("id"), "x", "y"), tracks, most, most).select("id", "d")
    near_stops = wanted.join(on_track.withColumnRenamed("id", "stop"), "stop")
    both = names.join(near_stops, "key")
    best = Window.partitionBy("id").orderBy("d", "x", "y", "stop")
    first = both.withColumn("bx", F.first("x").over(best)).withColumn("by", F.first("y").over(best))
    placed = first.where(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")) <= most).groupBy("id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n_stops"))
    return placed, names.join(placed.select("id"), "id", "left_anti")


#: Cells that one task of raster_band makes.
BAND_CELLS = 500_000


def raster_band(points: DataFrame, radius: int) -> DataFrame:
    """cx, cy: distinct grid cells within the radius of the points (x, y), whole numbers.

    Each place makes tens of cells, so places are dealt before that, and cells before they are made distinct, over tasks that grow in number
    with the points: a task has about BAND_CELLS of them.
    """
    around = sum(dx * dx + dy * dy <= radius * radius for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1))
    n_tasks = max(points.count() * around // BAND_CELLS + 1, points.sparkSession.sparkContext.defaultParallelism)
    places = points.select("x", "y").repartition(n_tasks, "x", "y").distinct()
    offsets = F.sequence(F.lit(-radius), F.lit(radius))
    wide = places.select("x", "y", F.explode(offsets).alias("dx")).withColumn("dy", F.explode(offsets)).where(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= radius * radius)
    return wide.select((F.col("x") + F.col("dx")).alias("cx"), (F.col("y") + F.col("dy")).alias("cy")).repartition(n_tasks, "cx", "cy").distinct()


def first_on_rays(rays: DataFrame, segments: DataFrame, cell: float) -> DataFrame:
    """ray, seg, t: the first segment that each ray (ray, ax, ay, bx, by), as long as it is drawn, meets, and where on it.

    Rays are looked along as far as segments lie apart on average, `cell` at most, then four times as far each time, those that met nothing.
    """
    segments, rays = kept(segments.select("seg", *[F.col(c).alias(f"o{c}") for c in ("ax", "ay", "bx", "by")])), kept(rays)
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    longest = rays.agg(F.max(length)).first()[0] or 0.0
    other = segments.select("seg", *[F.col(f"o{c}").alias(c) for c in ("ax", "ay", "bx", "by")])
    dx, dy, ex, ey = F.col("rx") - F.col("ax"), F.col("ry") - F.col("ay"), F.col("obx") - F.col("oax"), F.col("oby") - F.col("oay")
    qx, qy = F.col("oax") - F.col("ax"), F.col("oay") - F.col("ay")
    det = (dx * ey - dy * ex).cast("double")
    t, u = (qx * ey - qy * ex) / F.when(det != 0, det), (qx * dy - qy * dx) / F.when(det != 0, det)
    best = F.min(F.struct(t.alias("t"), F.col("seg")))
    left, parts = rays, []
    for reach in reaches(min(spacing(segments, F.col("oax"), F.col("oay")), cell), max(longest, 1e-9)):
        wide = min(4 * reach, cell)
        part = left.withColumn("far", F.when(length > reach, reach / length).otherwise(1.0)).withColumn("rx", F.col("bx")).withColumn("ry", F.col("by"))
        part = part.withColumn("bx", F.col("ax") + F.col("far") * (F.col("rx") - F.col("ax"))).withColumn("by", F.col("ay") + F.col("far") * (F.col("ry") - F.col("ay")))
        there = passed_cells(other, wide).select("cx", "cy", "seg", *[F.col(c).alias(f"o{c}") for c in ("ax", "ay", "bx", "by")])
        both = met(passed_cells(part, wide), there).where((t > 0) & (t <= F.col("far")) & u.between(0, 1))
        parts.append(kept(both.groupBy("ray").agg(best.alias("b")).select("ray", "b.seg", "b.t")))
        left = kept(left.join(parts[-1].select("ray"), "ray", "left_anti")) if reach < longest else left
    return functools.reduce(DataFrame.unionByName, parts)


def pieces_in_circle(segments: DataFrame, circles: DataFrame) -> DataFrame:
    """circle, line_id, piece, ax, ay, bx, by: what lies of lines (line_id, pos, ax, ay, bx, by) inside circles (circle, line_id, x, y, r);
    parts that follow each other without leaving are one piece, numbered from 1."""
    both = segments.join(circles, "line_id")
    dx, dy = (F.col("bx") - F.col("ax")).cast("double"), (F.col("by") - F.col("ay")).cast("double")
    fx, fy = F.col("ax") - F.col("x"), F.col("ay") - F.col("y")
    a, b, c = dx * dx + dy * dy, 2 * (fx * dx + fy * dy), fx * fx + fy * fy - F.col("r") * F.col("r")
    root = F.sqrt(b * b - 4 * a * c)
    both = both.where((a > 1e-12) & (b * b - 4 * a * c > 0))
    t0, t1 = F.greatest(F.lit(0.0), (-b - root) / (2 * a)), F.least(F.lit(1.0), (-b + root) / (2 * a))
    cut = both.withColumn("t0", t0).withColumn("t1", t1).where("t0 < t1")
    line = Window.partitionBy("circle", "line_id").orderBy("pos")
    fresh = (F.col("t0") > 0) | (F.lag("t1").over(line) < 1) | (F.lag("pos").over(line) != F.col("pos") - 1) | (F.row_number().over(line) == 1)
    cut = cut.withColumn("_new", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("piece", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda t, p, d: F.col(p) + F.col(t) * d
    return cut.select("circle", "line_id", "piece", "pos", at("t0", "ax", dx).alias("ax"), at("t0", "ay", dy).alias("ay"), at("t1", "ax", dx).alias("bx"), at("t1", "ay", dy).alias("by"))


def window_radius(crossings: DataFrame, segments: DataFrame, width: float, casing: float) -> DataFrame:
    """crossing, radius: how wide a crossing (crossing, upper, lower, x, y) is drawn anew: to the farthest sample of the upper line, taken
    at steps of 1, that lies closer to the lower line than width and casing; the casing and 1 more, six widths at most.

    segments: (line_id, pos, ax, ay, bx, by).
    """
    near, most = width + casing, 6 * width
    c = lambda *names: [F.col(n) for n in names]

    def gap(px: Column, py: Column) -> Column:
        ax, ay, bx, by = c("ax", "ay", "bx", "by")
        n2 = ((bx - ax) * (bx - ax) + (by - ay) * (by - ay)).cast("double")
        t = F.when(n2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / n2))).otherwise(0.0)
        return F.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))

    over = crossings.join(segments.withColumnRenamed("line_id", "upper"), "upper")
    n = F.greatest(F.floor(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))), F.lit(1))
    samples = over.where(gap(F.col("x"), F.col("y")) <= most).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long"))))
    samples = samples.select("crossing", "lower", "x", "y", (F.col("ax") + F.col("k") / F.col("n") * (F.col("bx") - F.col("ax"))).alias("qx"), (F.col("ay") + F.col("k") / F.col("n") * (F.col("by") - F.col("ay"))).alias("qy"))
    samples = samples.withColumn("far", F.hypot(F.col("qx") - F.col("x"), F.col("qy") - F.col("y"))).where(F.col("far") <= most)
    under = crossings.select("crossing", F.col("lower").alias("line_id"), "x", "y").join(segments, "line_id").where(gap(F.col("x"), F.col("y")) < most + near).select("crossing", "ax", "ay", "bx", "by")
    hit = samples.select("crossing", "qx", "qy", "far").join(under, "crossing").where(gap(F.col("qx"), F.col("qy")) < near)
    found = hit.groupBy("crossing").agg(F.max("far").alias("far"))
    return crossings.select("crossing").join(found, "crossing", "left").select("crossing", F.least(F.coalesce("far", F.lit(0.0)) + casing + 1, F.lit(most)).alias("radius"))


def parallel_run(points: DataFrame, pairs: DataFrame, tolerance: float, reach: int = 4, least_cosine: float = 0.966) -> DataFrame:
    """p, q, run: how far each line p runs from its start beside q (pairs: p, q): nearer than the tolerance and in its direction.

    points: (line_id, pos, x, y) without gaps in pos. Directions are taken over `reach` places to both sides; of equally near points
    of q the first counts. q's points are looked for in cells of the tolerance.
    """
    line = Window.partitionBy("line_id").orderBy("pos")
    wide = line.rowsBetween(-reach, reach)
    first, last = F.first, F.last
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(line), F.col("y") - F.lag("y").over(line)), F.lit(0.0))
    own = points.withColumn("_d", step).withColumn("s", F.sum("_d").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("tx", (last("x").over(wide) - first("x").over(wide)).cast("double")).withColumn("ty", (last("y").over(wide) - first("y").over(wide)).cast("double"))
    n = F.greatest(F.hypot("tx", "ty"), F.lit(1e-9))
    own = kept(own.select("line_id", "pos", "x", "y", "s", (F.col("tx") / n).alias("tx"), (F.col("ty") / n).alias("ty")))
    left = own.select(F.col("line_id").alias("p"), "pos", "x", "y", "s", "tx", "ty").join(pairs, "p")
    box = [F.col("x") - tolerance, F.col("y") - tolerance, F.col("x") + tolerance, F.col("y") + tolerance]
    right = in_cells(own.select(F.col("line_id").alias("q"), F.col("pos").alias("qpos"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("tx").alias("qtx"), F.col("ty").alias("qty")), [F.col("qx"), F.col("qy")] * 2, tolerance)
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    met = in_cells(left, box, tolerance).join(right, ["q", "cx", "cy"]).where(d2 <= tolerance * tolerance)
    nearest_ = met.groupBy("p", "q", "pos").agg(F.min_by((F.col("tx") * F.col("qtx") + F.col("ty") * F.col("qty")) >= least_cosine, F.struct(d2.alias("d2"), "qpos")).alias("same"))
    marked = left.select("p", "q", "pos", "s").join(nearest_, ["p", "q", "pos"], "left").withColumn("ok", F.coalesce("same", F.lit(False)))
    stop = marked.groupBy("p", "q").agg(F.min(F.when(~F.col("ok"), F.col("pos"))).alias("stop"))
    inside = marked.join(stop, ["p", "q"]).where("stop is null or pos < stop")
    runs = inside.groupBy("p", "q").agg(F.max("s").alias("run"))
    return pairs.join(runs, ["p", "q"], "left").select("p", "q", F.coalesce("run", F.lit(0.0)).alias("run"))
