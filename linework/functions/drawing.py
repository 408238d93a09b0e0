"""Column functions that turn geometry into SVG text and shapes. Points are arrays of (x, y) structs, y downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linework.functions.strings import badge_text, badge_width, escape_xml, text_width

NEAR = 1e-9
POINT = "struct<x:double,y:double>"


def number(v: Column, digits: int) -> Column:
    """v rounded as C's printf and SQL do it: by its exact value, and to even from half way.

    Java's format rounds up what its shortest decimal puts half way, as 1.0005, which lies below; such a number is made smaller by its last bit.
    """
    ten, five = 10.0**digits, 5**digits

    def cut(x: Column) -> Column:
        below = F.floor(F.abs(x) * ten)
        odd = (2 * below + 1).cast("double")
        # |x| less half way, times 2 * ten: the product is taken in two parts, so that its sign is exact
        scaled = F.abs(x) * 2.0 ** (digits + 1)
        high = scaled.cast("float").cast("double")
        over = (high * five - odd) + (scaled - high) * five
        down = (F.abs(x) == odd / (2 * ten)) & ((over < 0) | ((over == 0) & (below % 2 == 0)))
        return F.when(down, x * (1 - 2.0**-52)).otherwise(x)

    # in a lambda, so that what v is computed from stands in the plan once
    return F.format_string(f"%.{digits}f", F.get(F.transform(F.array(v.cast("double")), cut), F.lit(0)))


def short(v: Column) -> Column:
    """A number without trailing zeros, as %g writes it for the sizes of a drawing."""
    text = number(v, 6)
    return F.regexp_replace(F.regexp_replace(text, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")


def pair(x: Column, y: Column, digits: int = 3) -> Column:
    return F.concat_ws(" ", number(x, digits), number(y, digits))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def straight_path(points: Column) -> Column:
    return F.concat(F.lit("M "), F.array_join(F.transform(points, lambda p: pair(p["x"], p["y"])), " L "))


def _around(points: str, radii: str) -> Column:
    """Each vertex with the one before it, the one behind it, and its radius; the first and the last have none."""
    n = F.size(points)
    before = F.concat(F.array(F.lit(None).cast(POINT)), F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))))
    behind = F.concat(F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.lit(None).cast(POINT)))
    return F.arrays_zip(before.alias("a"), F.col(points).alias("p"), behind.alias("b"), F.col(radii).alias("r"))


def _rounded(z: Column) -> Column:
    """How a vertex is rounded: unit vectors in and out, the signed turn, and the tangent's length; null where it stays sharp.

    The tangent that the radius asks for is cut to what the shorter leg holds.
    """
    ix, iy, ox, oy = z["p"]["x"] - z["a"]["x"], z["p"]["y"] - z["a"]["y"], z["b"]["x"] - z["p"]["x"], z["b"]["y"] - z["p"]["y"]
    din, dout = F.hypot(ix, iy), F.hypot(ox, oy)
    delta = F.atan2(ix * oy - iy * ox, ix * ox + iy * oy)
    half = F.tan(F.abs(delta) / 2)
    t = F.least(z["r"] * half, din, dout)
    good = (z["r"] > 0) & (din >= NEAR) & (dout >= NEAR) & (F.abs(delta) >= NEAR) & (F.abs(F.abs(delta) - F.pi()) >= NEAR) & (t >= NEAR)
    return F.when(good, F.struct((ix / din).alias("ix"), (iy / din).alias("iy"), (ox / dout).alias("ox"), (oy / dout).alias("oy"), delta.alias("delta"), t.alias("t"), (t / half).alias("r")))


def rounded_path(points: str, radii: str) -> Column:
    """SVG path with circle arcs at the vertices that have a radius; radii is as long as points."""
    with_arcs = F.transform(F.filter(_around(points, radii), lambda z: z["a"].isNotNull()), lambda z: F.struct(z["p"].alias("p"), F.when(z["b"].isNotNull(), _rounded(z)).alias("c")))

    def part(s: Column) -> Column:
        p, c = s["p"], s["c"]
        into, out = pair(p["x"] - c["ix"] * c["t"], p["y"] - c["iy"] * c["t"]), pair(p["x"] + c["ox"] * c["t"], p["y"] + c["oy"] * c["t"])
        arc = F.concat_ws(" ", F.lit("L"), into, F.lit("A"), pair(c["r"], c["r"]), F.lit("0 0"), F.when(c["delta"] > 0, "1").otherwise("0"), out)
        return F.when(c.isNull(), F.concat(F.lit("L "), pair(p["x"], p["y"]))).otherwise(arc)

    head = F.concat(F.lit("M "), pair(F.get(points, F.lit(0))["x"], F.get(points, F.lit(0))["y"]))
    return F.when(F.size(points) > 0, F.concat_ws(" ", F.array(head), F.transform(with_arcs, part)))


def course_path(points: str) -> Column:
    """SVG path of a lane's course, an array of (x, y, r, curve): circle arcs at vertices with a radius r, and a cubic curve into each
    vertex that says so, along the direction in which the course came to the vertex before (or of the curve itself at the start)."""
    n = F.size(points)
    none = F.lit(None).cast("struct<x:double,y:double,r:double,curve:boolean>")
    shift = lambda k: F.concat(F.array_repeat(none, k), F.slice(points, F.lit(1), F.greatest(n - k, F.lit(0))))
    behind = F.concat(F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(none))
    zipped = F.arrays_zip(shift(2).alias("from"), shift(1).alias("a"), F.col(points).alias("p"), behind.alias("b"), F.transform(points, lambda p: p["r"]).alias("r"))

    def part(z: Column) -> Column:
        p, a = z["p"], z["a"]
        start = F.when(z["from"].isNull(), p).otherwise(a)
        back = F.coalesce(z["from"], a)
        size = F.hypot(start["x"] - back["x"], start["y"] - back["y"])
        curve = shift_bezier(a["x"], a["y"], (start["x"] - back["x"]) / size, (start["y"] - back["y"]) / size, p["x"], p["y"])
        c = F.when(z["b"].isNotNull() & ~F.coalesce(z["b"]["curve"], F.lit(False)), _rounded(z))
        into, out = pair(p["x"] - c["ix"] * c["t"], p["y"] - c["iy"] * c["t"]), pair(p["x"] + c["ox"] * c["t"], p["y"] + c["oy"] * c["t"])
        arc = F.concat_ws(" ", F.lit("L"), into, F.lit("A"), pair(c["r"], c["r"]), F.lit("0 0"), F.when(c["delta"] > 0, "1").otherwise("0"), out)
        return F.when(p["curve"], curve).when(c.isNull(), F.concat(F.lit("L "), pair(p["x"], p["y"]))).otherwise(arc)

    head = F.concat(F.lit("M "), pair(F.get(points, F.lit(0))["x"], F.get(points, F.lit(0))["y"]))
    return F.when(n > 0, F.concat_ws(" ", F.array(head), F.transform(F.filter(zipped, lambda z: z["a"].isNotNull()), part)))


def arc_points(px: Column, py: Column, ix: Column, iy: Column, delta: Column, radius: Column, steps: Column) -> Column:
    """steps + 1 points of a circle arc from p, driven along (ix, iy) first, that turns by delta (radians, to the right where positive)."""
    side = F.when(delta > 0, 1.0).otherwise(-1.0)
    mx, my = px - side * radius * iy, py + side * radius * ix
    start = F.atan2(py - my, px - mx)
    return F.transform(F.sequence(F.lit(0), steps.cast("int")), lambda k: point(mx + radius * F.cos(start + delta * k / steps), my + radius * F.sin(start + delta * k / steps)))


def circle_arc(px: Column, py: Column, ix: Column, iy: Column, ox: Column, oy: Column, radius: Column, step: float = 1.0) -> Column:
    """The arc from p between the directions (ix, iy) and (ox, oy), in chords of about `step`, two at least."""
    delta = F.atan2(ix * oy - iy * ox, ix * ox + iy * oy)
    return arc_points(px, py, ix, iy, delta, radius, F.greatest(F.ceil(F.abs(delta) * radius / step), F.lit(2)))


def rounded_points(points: str, radii: str, steps: int = 8) -> Column:
    """The drawn course as points: arcs in `steps` chords."""

    def part(z: Column) -> Column:
        c = _rounded(z)
        arc = arc_points(z["p"]["x"] - c["ix"] * c["t"], z["p"]["y"] - c["iy"] * c["t"], c["ix"], c["iy"], c["delta"], c["r"], F.lit(steps))
        return F.when(c.isNull() | z["a"].isNull() | z["b"].isNull(), F.array(point(z["p"]["x"], z["p"]["y"]))).otherwise(arc)

    return F.flatten(F.transform(_around(points, radii), part))


def shift_bezier(ax: Column, ay: Column, ux: Column, uy: Column, bx: Column, by: Column) -> Column:
    """Path text of a change of lane from a to b: a cubic curve whose ends lie along the unit vector (ux, uy)."""
    c = ((bx - ax) * ux + (by - ay) * uy) / 2
    return F.concat_ws(" ", F.lit("C"), pair(ax + ux * c, ay + uy * c), pair(bx - ux * c, by - uy * c), pair(bx, by))


def bracket_parts(text: Column) -> Column:
    """The text's parts in and outside brackets as (part, inside), none of them empty."""
    parts = F.regexp_extract_all(text, F.lit("(\\([^)]*\\)|[^(]+|\\()"), F.lit(1))
    return F.transform(parts, lambda t: F.struct(t.alias("part"), t.startswith("(").alias("inside")))


def name_width(text: Column, font: float, bracket_font: float) -> Column:
    return F.aggregate(F.transform(bracket_parts(text), lambda p: text_width(p["part"], F.when(p["inside"], bracket_font).otherwise(font))), F.lit(0.0), lambda s, w: s + w)


def name_svg(text: Column, bracket_font: float) -> Column:
    """A station's name; what stands in brackets is set smaller."""
    small = F.concat(F.lit(f'<tspan font-size="{bracket_font:g}">'), F.lit("{}"), F.lit("</tspan>"))
    return F.array_join(F.transform(bracket_parts(text), lambda p: F.when(p["inside"], F.replace(small, F.lit("{}"), escape_xml(p["part"]))).otherwise(escape_xml(p["part"]))), "")


def badge_svg(x: Column, y: Column, line_id: Column, color: Column, font: float, padding: float, height: float, number_font: float, hollow: Column, outline: float = 1.2, digits: int = 1) -> Column:
    """A line's badge with its upper left corner at (x, y): its colour, or white with a coloured outline."""
    w = badge_width(line_id, font, padding)
    box = lambda x_, y_, w_, h_, rx, d: F.concat(F.lit('<rect x="'), number(x_, d), F.lit('" y="'), number(y_, d), F.lit('" width="'), number(w_, d), F.lit('" height="'), number(h_, d), F.lit('" rx="'), number(rx, d), F.lit('" fill="'))
    inner = F.lit(height - outline)
    full = F.concat(box(x, y, w, F.lit(height), F.lit(height / 2), digits), color, F.lit('"/>'))
    empty = F.concat(box(x + outline / 2, y + outline / 2, w - outline, inner, inner / 2, 2), F.lit('#fff" stroke="'), color, F.lit(f'" stroke-width="{outline:g}"/>'))
    text = F.concat(F.lit('<text x="'), number(x + w / 2, digits), F.lit('" y="'), number(y + height / 2 + number_font * 0.35, digits), F.lit(f'" font-size="{number_font:g}" font-weight="600" fill="'), F.when(hollow, color).otherwise("#fff"), F.lit('" text-anchor="middle">'), escape_xml(badge_text(line_id)), F.lit("</text>"))
    return F.concat(F.when(hollow, empty).otherwise(full), text)


def car_svg(x: Column, y: Column, width: float, height: float, full: Column) -> Column:
    """A car as a bar with a slanting front, filled or outlined."""
    corners = ((x + height * 0.9, y), (x + width, y), (x + width, y + height), (x, y + height))
    d = F.concat_ws(" ", *[F.concat_ws(",", number(a, 1), number(b, 1)) for a, b in corners])
    return F.concat(F.lit('<polygon points="'), d, F.when(full, '" fill="#111111"/>').otherwise('" fill="white" stroke="#111111" stroke-width="1.0"/>'))


def arrow_path(cx: Column, cy: Column, tx: Column, ty: Column, width: float, tip_angle: float) -> Column:
    """A triangle on (cx, cy) that points along the unit vector (tx, ty): the middle between base and tip lies on the point."""
    half = F.radians(F.lit(tip_angle / 2))
    height = F.lit(width / 2) * F.cos(half) / F.sin(half)
    sx, sy, bx, by = cx + tx * height / 2, cy + ty * height / 2, cx - tx * height / 2, cy - ty * height / 2
    corner = lambda a, b: F.concat_ws(",", number(a, 2), number(b, 2))
    return F.concat(F.lit("M"), corner(sx, sy), F.lit(" L"), corner(bx - ty * width / 2, by + tx * width / 2), F.lit(" L"), corner(bx + ty * width / 2, by - tx * width / 2), F.lit(" Z"))


def line_svg(line_id: Column, color: Column, d: Column, width: float, casing: str | None = "#ffffff", casing_width: float = 1.5) -> Column:
    """A line over its own casing, so that it covers the lines below it where they cross."""
    own = F.concat(F.lit('<path id="line-'), escape_xml(line_id), F.lit('" stroke="'), color, F.lit(f'" stroke-width="{width:g}" d="'), d, F.lit('"/>'))
    below = F.concat(F.lit(f'<path stroke="{casing}" stroke-width="{width + casing_width:g}" d="'), d, F.lit('"/>\n'))
    return F.concat(below, own) if casing else own


def layer_svg(layer: str, d: Column) -> Column:
    """A layer's element with its attributes. layer: the name of a struct column (name, kind, fill, stroke, width, dash, opacity)."""
    c = lambda k: F.col(f"{layer}.{k}")
    area = F.concat(F.lit('fill="'), F.coalesce(c("fill"), F.lit("none")), F.lit('" fill-rule="evenodd"'))
    stroke = F.concat(F.lit('stroke="'), c("stroke"), F.lit('" stroke-width="'), short(c("width")), F.lit('" stroke-linecap="round" stroke-linejoin="round"'))
    dash = F.when(c("stroke").isNotNull(), F.concat(F.lit('stroke-dasharray="'), c("dash"), F.lit('"')))
    opacity = F.when(c("opacity") < 1, F.concat(F.lit('opacity="'), short(c("opacity")), F.lit('"')))
    attrs = F.concat_ws(" ", F.concat(F.lit('id="'), escape_xml(c("name")), F.lit('"')), F.when(c("kind") == "area", area).otherwise('fill="none"'), stroke, dash, opacity)
    return F.concat(F.lit("<path "), attrs, F.lit(' d="'), d, F.lit('"/>'))
