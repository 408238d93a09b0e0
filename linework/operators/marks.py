"""Station marks: what lies under them, boxes at them, pills across lines, and the area where two pills cross."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.functions.geometry import under_marker
from linework.operators import graph, spatial

# Fixed value: how far a direction leans before a box stands beside its point.
LEAN = 0.35


def rotated(x: Column, y: Column, radians: Column) -> tuple[Column, Column]:
    return x * F.cos(radians) - y * F.sin(radians), x * F.sin(radians) + y * F.cos(radians)


def box_at(px: Column, py: Column, ux: Column, uy: Column, w: Column, h: Column, gap: float | Column) -> list[Column]:
    """(x0, y0, x1, y1) of a box that touches the point from the direction (ux, uy), at a distance."""
    qx, qy = px + ux * gap, py + uy * gap
    low = lambda q, u, size: F.when(u > LEAN, q).when(u < -LEAN, q - size).otherwise(q - size / 2)
    x0, y0 = low(qx, ux, w), low(qy, uy, h)
    return [x0, y0, x0 + w, y0 + h]


def anchor(ux: Column, x0: Column, x1: Column, align: Column) -> tuple[Column, Column]:
    """(text-anchor, x) in a box: as `align` says, else by the direction."""
    name = F.coalesce(align, F.when(ux > LEAN, "start").when(ux < -LEAN, "end").otherwise("middle"))
    return name, F.when(name == "start", x0).when(name == "end", x1).otherwise((x0 + x1) / 2)


def pill_box(cx: Column, cy: Column, nx: Column, ny: Column, length: Column, radius: float) -> list[Column]:
    """The box around a pill: its axis (nx, ny) of a length, rounded by the radius."""
    ex, ey = F.abs(nx * length / 2) + radius, F.abs(ny * length / 2) + radius
    return [cx - ex, cy - ey, cx + ex, cy + ey]


def straightened(anx: Column, any_: Column, bnx: Column, bny: Column, straighten: Column, keeps: Column) -> tuple[Column, Column, Column, Column]:
    """The axes a and b of two pills turned towards a right angle: by none of what is missing at 0, all of it at 1.

    Both turn by half of it; if one of them is kept (keeps: 'a' or 'b'), the other turns by all of it.
    """
    angle = F.atan2(anx * bny - any_ * bnx, anx * bnx + any_ * bny)
    half = (F.signum(angle) * F.pi() / 2 - angle) * straighten / 2
    kept = F.coalesce(keeps, F.lit(""))
    return *rotated(anx, any_, F.when(kept == "a", 0.0).when(kept == "b", -2 * half).otherwise(-half)), *rotated(bnx, bny, F.when(kept == "b", 0.0).when(kept == "a", 2 * half).otherwise(half))


def crossing_area(acx: Column, acy: Column, anx: Column, any_: Column, al: Column, bcx: Column, bcy: Column, bnx: Column, bny: Column, bl: Column, axes: tuple[Column, Column, Column, Column] | None = None) -> Column:
    """(x, y, corners) of the parallelogram in which two pills' bundles cross; null where they are nearly parallel.

    The bundles run across the pills' axes n, so the middle is where the lines through the centres across n meet. axes:
    straightened ones, along which the sides then run around that middle.
    """
    det = anx * bny - any_ * bnx
    # along the first bundle, whose direction is (-ny, nx)
    s = ((bcx - acx) * bnx + (bcy - acy) * bny) / F.when(F.abs(det) >= 0.2, -any_ * bnx + anx * bny)
    x, y = acx - any_ * s, acy + anx * s
    crosses = F.abs(det) >= 0.2
    if axes is not None:
        anx, any_, bnx, bny = axes
        det = anx * bny - any_ * bnx
    corner = lambda p, q: F.struct((x + (p * bny - q * any_) / det).alias("x"), (y + (q * anx - p * bnx) / det).alias("y"))
    corners = F.array(*[corner(i * al / 2, j * bl / 2) for i, j in ((1, 1), (1, -1), (-1, -1), (-1, 1))])
    return F.when(crosses, F.struct(x.alias("x"), y.alias("y"), corners.alias("corners")))


def under_station(x: Column, y: Column, kind: Column, cx: Column, cy: Column, angle: Column, half_length: Column, half_width: Column, pill: float, ring: float, dot: float) -> Column:
    """Whether a point lies under a station's sign: a hub's pill, an end's ring or a dot, each with its stroke (radii incl. half of it)."""
    none = F.lit(0.0)
    disc = lambda r: under_marker(x, y, cx, cy, none, none, none, F.lit(r))
    return F.when(kind == "hub", under_marker(x, y, cx, cy, angle, half_length, half_width, F.lit(pill))).when(kind == "end", disc(ring)).otherwise(disc(dot))


def beside_ring(probes: DataFrame, ring: DataFrame, reach: float) -> DataFrame:
    """probes (id, x, y, ux, uy) that lie within reach of a segment (seg, ax, ay, bx, by) parallel to their direction."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n2 = (dx * dx + dy * dy).cast("double")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / n2))
    parallel = F.abs(F.col("ux") * dy - F.col("uy") * dx) / F.sqrt(n2) <= 1e-6
    on = (n2 > 1e-18) & parallel & (F.hypot(F.col("x") - F.col("ax") - t * dx, F.col("y") - F.col("ay") - t * dy) < reach)
    asked = spatial.in_cells(probes, [F.col("x"), F.col("y")] * 2, reach * 2)  # each until one segment is found
    return spatial.met(asked, spatial.passed_cells(ring, reach * 2, reach), on, "left_semi").select("id").distinct()


def line_points(stops: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """(station_id, line_id, x, y, ux, uy): where each line (segments: line_id, seg, ax, ay, bx, by) passes nearest to each of its
    stations (stops: station_id, line_id, x, y), and its direction there; of equally near segments the first."""
    stops, segments = graph.kept(stops), graph.kept(segments)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n2 = (dx * dx + dy * dy).cast("double")
    t = F.when(n2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / n2))).otherwise(0.0)
    qx, qy = F.col("ax") + t * dx, F.col("ay") + t * dy
    d = F.hypot(F.col("x") - qx, F.col("y") - qy)
    best = F.min(F.struct(F.round(d, 9).alias("d"), F.col("seg"), qx.alias("x"), qy.alias("y"), (dx / F.sqrt(n2)).alias("ux"), (dy / F.sqrt(n2)).alias("uy")))
    lines = segments.select("line_id").distinct().count()
    parts, left = [], stops
    for r in spatial.reaches(spatial.spacing(segments, F.col("ax"), F.col("ay")) * lines**0.5, reach):
        cell = min(4 * r, reach * 4)
        both = spatial.met(spatial.in_cells(left, [F.col("x"), F.col("y")] * 2, cell), spatial.passed_cells(segments, cell, r), more=("line_id",))
        found = both.where((n2 > 0) & (d <= r)).groupBy("station_id", "line_id").agg(best.alias("b"))
        # equally near up to rounding may be what lies just beyond the reach
        parts.append(graph.kept(found if r >= reach else found.where(F.col("b.d") < r - 1e-8)))
        left = graph.kept(left.join(parts[-1].select("station_id", "line_id"), ["station_id", "line_id"], "left_anti")) if r < reach else left
    return functools.reduce(DataFrame.unionByName, parts).select("station_id", "line_id", "b.x", "b.y", "b.ux", "b.uy")


def pills(points: DataFrame, spacing: float, most_angle: float = 15.0) -> DataFrame:
    """(station_id, mark, lines, x, y, nx, ny, length): marks of line_points: lines at a station closer than 1.6 lanes that run within
    15 degrees of each other share one pill across them; a lone line's has no length."""
    own = points.withColumn("id", F.concat_ws("\x1f", F.col("station_id").cast("string"), F.col("line_id").cast("string")))
    other = own.select("station_id", F.col("id").alias("o_id"), *[F.col(c).alias(f"o_{c}") for c in ("x", "y", "ux", "uy")])
    alike = F.abs(F.col("ux") * F.col("o_ux") + F.col("uy") * F.col("o_uy")) >= F.cos(F.radians(F.lit(most_angle))) - 1e-12
    pairs = own.join(other.hint("merge"), "station_id").where((F.col("id") < F.col("o_id")) & (F.hypot(F.col("x") - F.col("o_x"), F.col("y") - F.col("o_y")) <= 1.6 * spacing) & alike)
    found = graph.components(pairs.select(F.col("id").alias("a"), F.col("o_id").alias("b")))
    marked = own.join(found.withColumnRenamed("node", "id").hint("merge"), "id", "left").withColumn("mark", F.coalesce("component", "id"))
    lead = Window.partitionBy("station_id", "mark").orderBy("id")
    n = marked.withColumn("nx", -F.first("uy").over(lead)).withColumn("ny", F.first("ux").over(lead))
    along, across = F.col("x") * F.col("nx") + F.col("y") * F.col("ny"), F.col("y") * F.col("nx") - F.col("x") * F.col("ny")
    by = n.groupBy("station_id", "mark").agg(F.array_sort(F.collect_list("line_id")).alias("lines"), F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.min(along).alias("lo"), F.max(along).alias("hi"), F.avg(across).alias("v"))
    u = (F.col("lo") + F.col("hi")) / 2
    return by.select("station_id", "mark", "lines", (u * F.col("nx") - F.col("v") * F.col("ny")).alias("x"), (u * F.col("ny") + F.col("v") * F.col("nx")).alias("y"), "nx", "ny", (F.col("hi") - F.col("lo")).alias("length"))


def station_marks(points: DataFrame, spacing: float, crossings: DataFrame | None = None) -> DataFrame:
    """(station_id, mark, lines, x, y, nx, ny, length, corners): the marks of line_points: pills, and where a station of crossings
    (station_id, straighten, keep: a line whose bundle keeps its direction, or null) has two that cross, one over the whole crossing.

    A crossing's lines are those of both pills, the first one's first; its corners go around it, and it has no length.
    """
    own = pills(points, spacing).withColumn("corners", F.lit(None).cast("array<struct<x:double,y:double>>"))
    if crossings is None:
        return own
    own = graph.kept(own)
    pill = F.struct("mark", "lines", "x", "y", "nx", "ny", "length")
    # tables of numbers are small as files and large in memory, so these joins are merged: Spark would send a whole side through the driver
    two = own.join(crossings.hint("merge"), "station_id").groupBy("station_id").agg(F.array_sort(F.collect_list(pill)).alias("p"), F.first("straighten").alias("straighten"), F.first("keep").alias("keep")).where(F.size("p") == 2)
    a, b = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    keeps = F.when(F.array_contains(a["lines"], F.col("keep")), "a").when(F.array_contains(b["lines"], F.col("keep")), "b")
    axes = straightened(*[e[c] for e in (a, b) for c in ("nx", "ny")], F.coalesce("straighten", F.lit(0.0)), keeps)
    two = graph.kept(two.select("station_id", "p", *[v.alias(f"_{i}") for i, v in enumerate(axes)]))  # written: one expression of all would be too long to compile
    both = two.withColumn("area", crossing_area(*[e[c] for e in (a, b) for c in ("x", "y", "nx", "ny", "length")], tuple(F.col(f"_{i}") for i in range(4)))).where("area is not null")
    crossed = graph.kept(both.select("station_id", a["mark"].alias("mark"), F.concat(a["lines"], b["lines"]).alias("lines"), "area.x", "area.y", a["nx"].alias("nx"), a["ny"].alias("ny"), F.lit(0.0).alias("length"), "area.corners"))
    return own.join(crossed.select("station_id").hint("merge"), "station_id", "left_anti").unionByName(crossed)


def mark_reach(radius: float) -> Column:
    """How far a mark of station_marks reaches from its middle."""
    far = F.array_max(F.transform("corners", lambda p: F.hypot(p["x"] - F.col("x"), p["y"] - F.col("y"))))
    return F.coalesce(far, F.col("length") / 2) + radius


def mark_box(radius: float) -> list[Column]:
    """(x0, y0, x1, y1) around a mark of station_marks."""
    pill = pill_box(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"), F.col("length"), radius)
    side = lambda f, c, r: f(F.transform("corners", lambda p: p[c])) + r
    area = [side(F.array_min, "x", -radius), side(F.array_min, "y", -radius), side(F.array_max, "x", radius), side(F.array_max, "y", radius)]
    return [F.coalesce(a, p) for a, p in zip(area, pill, strict=True)]


def mark_extent(ux: Column, uy: Column, radius: float) -> Column:
    """How far a mark of station_marks reaches from its middle along the unit vector (ux, uy)."""
    far = F.array_max(F.transform("corners", lambda p: (p["x"] - F.col("x")) * ux + (p["y"] - F.col("y")) * uy))
    return F.coalesce(far, F.abs(F.col("nx") * ux + F.col("ny") * uy) * F.col("length") / 2) + radius


def mark_points(radius: float) -> Column:
    """Points on a mark of station_marks that names keep clear of: a pill's axis and both its sides, about 1.5 apart; a crossing's
    sides in seven steps each, the same half way in, and its middle."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    n = F.greatest(F.floor(F.col("length") / 1.5), F.lit(1)).cast("int")
    along = lambda i: (i / n - F.lit(0.5)) * F.col("length")
    pill = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.array(*[point(F.col("x") + F.col("nx") * along(i) - F.col("ny") * r, F.col("y") + F.col("ny") * along(i) + F.col("nx") * r) for r in (-radius, 0.0, radius)])))
    nxt = F.concat(F.slice("corners", 2, 3), F.slice("corners", 1, 1))
    side = F.flatten(F.transform(F.arrays_zip(F.col("corners").alias("p"), nxt.alias("q")), lambda z: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: point(z["p"]["x"] + (z["q"]["x"] - z["p"]["x"]) * i / 7, z["p"]["y"] + (z["q"]["y"] - z["p"]["y"]) * i / 7))))
    inner = F.transform(side, lambda p: point((p["x"] + F.col("x")) / 2, (p["y"] + F.col("y")) / 2))
    return F.when(F.col("corners").isNull(), pill).otherwise(F.concat(side, inner, F.array(point(F.col("x"), F.col("y")))))
