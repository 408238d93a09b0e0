"""From tables to drawings: layers of map data, and solved layouts, as rows of elements that become one SVG for each map.

Layers are rows (map_id, layer_pos, layer: struct of name, kind, fill, stroke, width, dash, opacity, min_area). Their
geometry comes from linework.sources.osm. Only a layer's path text is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linework.config import PROJECTION, Projection
from linework.functions import drawing as D
from linework.functions import geometry as G
from linework.functions import strings as X
from linework.operators import graph
from linework.operators.sequences import simplified

LAYER = "struct<name:string,kind:string,fill:string,stroke:string,width:double,dash:string,opacity:double,min_area:double>"


def projected(shapes: DataFrame, width_km: float, height_km: float, width_px: float, projection: Projection = PROJECTION) -> DataFrame:
    """pts: (lon, lat) of whole shapes as pixels (x, y) of the window around the projection's centre."""

    def one(p):
        east, north = G.transverse_mercator(p["lon"], p["lat"], projection)
        x, y = G.to_pixels(east, north, width_km, height_km, width_px)
        return D.point(x, y)

    return shapes.withColumn("pts", F.transform("pts", one))


def _box(points: str) -> list:
    axis = lambda c: F.transform(points, lambda p: p[c])
    return [F.array_min(axis("x")), F.array_min(axis("y")), F.array_max(axis("x")), F.array_max(axis("y"))]


def layer_shapes(layers: DataFrame, lines: DataFrame, areas: DataFrame, width: float, height: float, tolerance: float = 0.35) -> DataFrame:
    """map_id, layer_pos, shape_pos, ring_pos, d: the path text of each line and ring that is drawn, in this order within its layer.

    lines: (map_id, layer_pos, shape_pos, pts) and areas: (map_id, layer_pos, shape_pos, ring_pos, pts) in pixels. What lies
    outside the window with a margin of the stroke is left out, and areas of one ring below the layer's min_area; an area stays or goes whole.
    """
    pad = 4 * F.coalesce("layer.width", F.lit(1.0)) + 2
    seen = lambda box: (box[2] >= -pad) & (box[3] >= -pad) & (box[0] <= width + pad) & (box[1] <= height + pad)
    key = ["map_id", "layer_pos", "shape_pos", "ring_pos"]
    own = lines.withColumn("ring_pos", F.lit(0)).join(layers.where("layer.kind = 'line'"), ["map_id", "layer_pos"]).where(seen(_box("pts")))
    shape = Window.partitionBy("map_id", "layer_pos", "shape_pos")
    rings = areas.join(layers.where("layer.kind = 'area'"), ["map_id", "layer_pos"])
    x0, y0, x1, y1 = _box("pts")
    whole = [F.min(x0).over(shape), F.min(y0).over(shape), F.max(x1).over(shape), F.max(y1).over(shape)]
    outer = F.min_by(G.ring_area("pts"), "ring_pos").over(shape)
    rings = rings.withColumn("seen", seen(whole)).withColumn("area", outer).withColumn("rings", F.count("*").over(shape))
    kept = rings.where(F.col("seen") & ~((F.col("area") < F.coalesce("layer.min_area", F.lit(0.0))) & (F.col("rings") == 1)))
    drawn = own.select(*key, "pts", F.lit(False).alias("closed")).unionByName(kept.select(*key, "pts", F.lit(True).alias("closed")))
    vertices = drawn.select(*key, "closed", F.posexplode("pts").alias("pos", "p")).select(*key, "closed", "pos", "p.x", "p.y")
    left = simplified(graph.kept(vertices), tolerance, (*key, "closed"))
    pts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: D.point(p["x"], p["y"]))
    text = lambda closed: X.draw_path(F.col("pts"), closed)
    return left.groupBy(*key, "closed").agg(pts.alias("pts")).select(*key, F.when(F.col("closed"), text(True)).otherwise(text(False)).alias("d"))


def layer_paths(layers: DataFrame, lines: DataFrame, areas: DataFrame, width: float, height: float, tolerance: float = 0.35) -> DataFrame:
    """map_id, layer_pos, layer, d: each layer's path text as one string, for layers that fit in a row; `layer_shapes` has its parts as rows."""
    drawn = layer_shapes(layers, lines, areas, width, height, tolerance)
    parts = F.array_sort(F.collect_list(F.struct("shape_pos", "ring_pos", "d")))
    by = drawn.groupBy("map_id", "layer_pos").agg(F.array_join(F.transform(parts, lambda x: x["d"]), "").alias("d"))
    return layers.join(by, ["map_id", "layer_pos"], "left").select("map_id", "layer_pos", "layer", F.coalesce("d", F.lit("")).alias("d"))


def basemap(paths: DataFrame, overlays: DataFrame, width: float, height: float, background: str = "#ffffff", attribution: str | None = None, font: str = "sans-serif") -> DataFrame:
    """map_id, svg: layers from below, clipped to the window; overlays (map_id, level, id, text) above them; the source's name on top."""
    size = f'<rect width="{width:.1f}" height="{height:.1f}"'
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:.0f}" height="{height:.0f}" viewBox="0 0 {width:.1f} {height:.1f}">\n<defs><clipPath id="window">{size}/></clipPath></defs>\n{size} fill="{background}"/>\n<g id="basemap" clip-path="url(#window)">'
    below = paths.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("layer_pos", D.layer_svg("layer", F.col("d")).alias("text")))).alias("below"))
    above = overlays.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("level", "id", "text"))).alias("above"))
    texts = lambda c: F.array_join(F.transform(c, lambda e: e["text"]), "\n")
    over = F.when(F.col("above").isNotNull(), F.concat(F.lit('<g clip-path="url(#window)">\n'), texts("above"), F.lit("\n</g>")))
    source = None
    if attribution:
        source = F.concat(F.lit(f'<text x="{width - 8:.1f}" y="{height - 8:.1f}" text-anchor="end" font-family="{font}" font-size="11" fill="#777">'), X.escape_xml(F.lit(attribution)), F.lit("</text>"))
    parts = [F.lit(head), texts("below"), F.lit("</g>"), over, source if source is not None else F.lit(None).cast("string"), F.lit("</svg>")]
    return below.join(above, "map_id", "left").select("map_id", F.concat_ws("\n", *parts).alias("svg"))


def line_courses(coordinates: DataFrame, steps: DataFrame) -> DataFrame:
    """net_id, line_id, pts: each line's stations in order (steps: net_id, line_id, pos, station_id) with their coordinates (net_id,
    station, x, y). Grid coordinates grow upwards, drawings downwards."""
    on = steps.join(coordinates.withColumnRenamed("station", "station_id"), ["net_id", "station_id"])
    return on.groupBy("net_id", "line_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda s: D.point(s["x"], F.lit(0.0) - s["y"])).alias("pts"))


def schematic_elements(coordinates: DataFrame, stations: DataFrame, lines: DataFrame, steps: DataFrame, scale: float = 20.0, width: float = 4.0, dot: float = 3.0, label_font: float = 10.0) -> DataFrame:
    """map_id, level, id, text: a solved layout's lines (level 1), dots of stations (2) and their labels (3).

    Hidden stations have neither dot nor label, hubs no dot; a planned station's is pale.
    """
    px = lambda c, sign=1: F.lit(0.0) + F.col(c) * (scale * sign)
    stops = steps.where("step_kind = 'station'").select("net_id", "line_id", "pos", "station_id")
    course = line_courses(coordinates, stops).join(lines.select("net_id", "line_id", "color"), ["net_id", "line_id"])
    big = F.transform("pts", lambda p: D.point(p["x"] * scale, p["y"] * scale))
    drawn = course.select(F.col("net_id").alias("map_id"), F.lit(1).alias("level"), F.col("line_id").alias("id"), D.line_svg(F.col("line_id"), F.col("color"), D.straight_path(big), width).alias("text"))
    at = stations.where("not coalesce(hidden, false)").join(coordinates.withColumnRenamed("station", "id"), ["net_id", "id"])
    x, y = D.number(px("x"), 1), D.number(px("y", -1), 1)
    pale = F.when(F.coalesce("planned", F.lit(False)), ' opacity="0.5"').otherwise("")
    circle = F.concat(F.lit('<circle cx="'), x, F.lit('" cy="'), y, F.lit(f'" r="{dot:g}" fill="white"'), pale, F.lit("/>"))
    dots = at.where("kind <> 'hub'").select(F.col("net_id").alias("map_id"), F.lit(2).alias("level"), "id", circle.alias("text"))
    label = F.concat(F.lit('<text x="'), D.number(px("x") + dot * 2, 1), F.lit('" y="'), D.number(px("y", -1) + label_font / 3, 1), F.lit(f'" font-size="{label_font:g}">'), X.escape_xml(F.coalesce("label", "name", "id")), F.lit("</text>"))
    return drawn.unionByName(dots).unionByName(at.select(F.col("net_id").alias("map_id"), F.lit(3).alias("level"), "id", label.alias("text")))


def rebuilt(legs: DataFrame, bearings: DataFrame, solution: DataFrame, coordinates: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(net_id, line_id, seg, a, b, off): pairs of stations whose legs, walked from a with the solved lengths, end farther from b than the tolerance."""
    own = legs.withColumn("var", F.concat_ws(":", F.lit("len"), "line_id", F.coalesce(F.concat(F.lit("group "), "group"), F.concat_ws(".", "seg", "leg"))))
    solved = own.join(solution.select("net_id", "var", "value"), ["net_id", "var"], "left").join(bearings, ["net_id", "line_id"])
    size, r = F.when(F.col("elastic"), F.col("value")).otherwise(F.col("preferred")), F.radians(F.col("bearing") + F.col("offset"))
    ends = solved.groupBy("net_id", "line_id", "seg", "a", "b").agg(F.sum(size * F.sin(r)).alias("dx"), F.sum(size * F.cos(r)).alias("dy"))
    spot = lambda end: coordinates.select("net_id", F.col("station").alias(end), F.col("x").alias(f"{end}x"), F.col("y").alias(f"{end}y"))
    both = ends.join(spot("a"), ["net_id", "a"]).join(spot("b"), ["net_id", "b"])
    return both.withColumn("off", F.hypot(F.col("ax") + F.col("dx") - F.col("bx"), F.col("ay") + F.col("dy") - F.col("by"))).where(F.col("off") > tolerance).select("net_id", "line_id", "seg", "a", "b", "off")


def serving_lines(legs: DataFrame) -> DataFrame:
    """station_id, lines: the lines that call at each station."""
    return legs.select("station_id", "line_id").distinct().groupBy("station_id").agg(F.array_sort(F.collect_list("line_id")).alias("lines"))


def column_widths(cells: DataFrame, font: float, padding: float) -> DataFrame:
    """table_id, col, width, offset: each column as wide as its widest text with padding on both sides, and where it starts."""
    w = cells.groupBy("table_id", "col").agg((F.max(X.text_width(F.col("text"), font)) + 2 * padding).alias("width"))
    before = Window.partitionBy("table_id").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    return w.withColumn("offset", F.coalesce(F.sum("width").over(before), F.lit(0.0)))


__all__ = ["LAYER", "basemap", "column_widths", "layer_paths", "layer_shapes", "line_courses", "projected", "rebuilt", "schematic_elements", "serving_lines"]


def in_pixels(vertices: DataFrame, grid: float, margin: float) -> DataFrame:
    """vertices (map_id, x, y, radius) in pixels: grid units of a size, the smallest x and y of each map a margin from its sides; width and height are the map's."""
    box = vertices.groupBy("map_id").agg(*[f(c).alias(f"_{n}{c}") for n, f in (("low", F.min), ("high", F.max)) for c in "xy"])
    at = lambda c: ((F.col(c) - F.col(f"_low{c}")) * grid + margin).alias(c)
    size = lambda c: ((F.col(f"_high{c}") - F.col(f"_low{c}")) * grid + 2 * margin)
    rest = [c for c in vertices.columns if c not in ("map_id", "x", "y", "radius")]
    return vertices.join(box, "map_id").select("map_id", *rest, at("x"), at("y"), (F.col("radius") * grid).alias("radius"), size("x").alias("width"), size("y").alias("height"))
