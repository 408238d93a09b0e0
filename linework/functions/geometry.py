"""Column functions of plane geometry and the map projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linework.config import LAYOUT, PROJECTION, Layout, Projection

#: Fixed unit vectors of the eight bearings, clockwise from north, y downwards on the canvas.
COMPASS = {0: (0.0, -1.0), 45: (0.5**0.5, -(0.5**0.5)), 90: (1.0, 0.0), 135: (0.5**0.5, 0.5**0.5), 180: (0.0, 1.0), 225: (-(0.5**0.5), 0.5**0.5), 270: (-1.0, 0.0), 315: (-(0.5**0.5), -(0.5**0.5))}


def folded(delta: Column) -> Column:
    """A turn as an angle from 0 to 180."""
    return F.abs(F.pmod(delta + 180, F.lit(360)) - 180)


def curve_radius(delta: Column, layout: Layout = LAYOUT) -> Column:
    angle = folded(delta)
    return F.when(angle == 45, layout.radius_45).when(angle == 135, layout.radius_135).otherwise(layout.radius_90)


def tangent_factor(delta: Column) -> Column:
    """tan(|delta| / 2): tangent length of a circle of radius 1."""
    return F.tan(F.radians(folded(delta)) / 2)


def corner_radius(delta: Column, radius: Column, max_tangent: Column, offset: Column, forced: Column) -> Column:
    """The drawn radius: capped by the room unless forced, less the signed offset, not negative."""
    room = F.when(forced | (F.pmod(delta, F.lit(360)) == 0), radius).otherwise(F.least(radius, max_tangent / tangent_factor(delta)))
    side = F.when(F.pmod(delta + 180, F.lit(360)) - 180 < 0, -1.0).otherwise(1.0)
    return F.greatest(F.lit(0.0), room - side * offset)


def decimals(v: Column, digits: int) -> Column:
    """v at so many decimals as SQL rounds: the nearest whole number of its product with 10^digits, half away from zero. F.round goes through
    decimal text instead, which took most of the time where rows are many, and rounds some ties of the product otherwise."""
    ten = 10.0**digits
    w = F.abs(v) * ten
    whole = F.floor(w) + F.when(w - F.floor(w) >= 0.5, 1).otherwise(0)
    return F.when(w < 2.0**53, F.signum(v) * whole / ten).otherwise(v)


def smoothstep(t: Column) -> Column:
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return u * u * (3 - 2 * u)


def turn_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees from vector a to vector b, positive where b lies counter-clockwise in a y-up plane."""
    return F.degrees(F.atan2(ax * by - ay * bx, ax * bx + ay * by))


def unit(dx: Column, dy: Column) -> tuple[Column, Column]:
    """(ux, uy) of length 1; (0, 0) for a vector without length."""
    n = F.hypot(dx, dy)
    part = lambda d: F.when(n < 1e-12, 0.0).otherwise(d / F.when(n > 0, n))
    return part(dx), part(dy)


def leg_direction(ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    return unit(bx - ax, by - ay)


def entry(items: Column, i: Column, ring: Column) -> Column:
    """Item i, counted from 0: on a ring around and around, else null beyond the ends."""
    n = F.size(items)
    return F.when((n > 0) & ring, F.get(items, F.pmod(i, n).cast("int"))).when((n > 0) & (i >= 0) & (i < n), F.get(items, i.cast("int")))


def oriented(points: Column, direction: Column) -> Column:
    """A piece's points as they are driven: backwards for a negative direction."""
    return F.when(direction < 0, F.reverse(points)).otherwise(points)


def bearing(dx: Column, dy: Column, tolerance: float = 1e-6) -> Column:
    """The bearing (y upwards) of a vector, if it is one of the eight within the tolerance; else null."""
    n = F.hypot(dx, dy)
    out = F.lit(None).cast("int")
    for angle, (x, y) in COMPASS.items():
        out = F.when((F.abs(dx / n - x) <= tolerance) & (F.abs(dy / n + y) <= tolerance), angle).otherwise(out)
    return F.when(n > tolerance, out)


def canonical_sign(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """1 if a comes before b by (x, y), else -1: the sign of a lane for the direction a to b."""
    return F.when((ax < bx) | ((ax == bx) & (ay <= by)), 1).otherwise(-1)


def segment_hits_box(ax: Column, ay: Column, bx: Column, by: Column, x0: Column, y0: Column, x1: Column, y1: Column, margin: float = 0.0) -> Column:
    """Whether a segment touches a box that grows by the margin: the parameters inside all four sides leave an interval."""
    lo, hi, out = F.lit(0.0), F.lit(1.0), F.lit(True)
    for a, b, low, high in ((ax, bx, x0 - margin, x1 + margin), (ay, by, y0 - margin, y1 + margin)):
        d = (b - a).cast("double")
        first, second = (low - a) / F.when(d != 0, d), (high - a) / F.when(d != 0, d)
        lo = F.greatest(lo, F.least(first, second))  # nulls of a segment along this axis are skipped
        hi = F.least(hi, F.greatest(first, second))
        out = out & ((d != 0) | ((a >= low) & (a <= high)))
    return out & (lo <= hi)


def boxes_overlap(a: list[Column], b: list[Column]) -> Column:
    """Whether two boxes (x0, y0, x1, y1) share inner points."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def in_viewport(box: list[Column], width: float, height: float, pad: float) -> Column:
    return (box[2] >= -pad) & (box[3] >= -pad) & (box[0] <= width + pad) & (box[1] <= height + pad)


def meridian_arc(phi: Column | float, p: Projection = PROJECTION) -> Column:
    """Length along the meridian from the equator; phi in radians. Snyder 3-21."""
    phi = F.lit(phi) if isinstance(phi, float) else phi
    e2, e4, e6 = p.e2, p.e2**2, p.e2**3
    series = ((0, 1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256), (2, -(3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024)), (4, 15 * e4 / 256 + 45 * e6 / 1024), (6, -35 * e6 / 3072))
    total = phi * series[0][1]
    for k, c in series[1:]:
        total = total + F.sin(phi * k) * c
    return total * p.a


def transverse_mercator(lon: Column, lat: Column, p: Projection = PROJECTION) -> tuple[Column, Column]:
    """Metres east and north of the centre. Snyder 8-9 and 8-10 with scale 1."""
    phi, lam = F.radians(lat), F.radians(lon - p.lon0)
    n = F.lit(p.a) / F.sqrt(1 - p.e2 * F.sin(phi) * F.sin(phi))
    t, c, a = F.tan(phi) * F.tan(phi), p.ep2 * F.cos(phi) * F.cos(phi), lam * F.cos(phi)
    a2 = a * a
    x = n * a * (1 + a2 * ((1 - t + c) / 6 + a2 * (5 - 18 * t + t * t + 72 * c - 58 * p.ep2) / 120))
    up = a2 * (0.5 + a2 * ((5 - t + 9 * c + 4 * c * c) / 24 + a2 * (61 - 58 * t + t * t + 600 * c - 330 * p.ep2) / 720))
    y = meridian_arc(phi, p) - meridian_arc(F.radians(F.lit(p.lat0)), p) + n * F.tan(phi) * up
    return x, y


def to_pixels(x: Column, y: Column, width_km: float, height_km: float, width_px: float) -> tuple[Column, Column]:
    scale = width_px / (width_km * 1000.0)
    return x * scale + width_px / 2, height_km * 1000.0 * scale / 2 - y * scale


def intersection(px: Column, py: Column, dx: Column, dy: Column, qx: Column, qy: Column, ex: Column, ey: Column) -> tuple[Column, Column]:
    """Where the lines p + t d and q + u e meet; null if parallel."""
    det = dx * ey - dy * ex
    t = ((qx - px) * ey - (qy - py) * ex) / F.when(F.abs(det) > 1e-12, det)
    return px + t * dx, py + t * dy


def ring_area(points: str) -> Column:
    """Area of an array of (x, y) structs, taken as a closed ring."""
    i = F.sequence(F.lit(0), F.size(points) - 1)
    term = lambda k: F.get(points, k)["x"] * F.get(points, F.pmod(k + 1, F.size(points)))["y"] - F.get(points, F.pmod(k + 1, F.size(points)))["x"] * F.get(points, k)["y"]
    total = F.aggregate(F.transform(i, lambda k: term(k).cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(points) > 0, F.abs(total) / 2).otherwise(0.0)


def under_marker(x: Column, y: Column, cx: Column, cy: Column, angle: Column, half_length: Column, half_width: Column, radius: Column) -> Column:
    """Whether a point lies under a marker: a rectangle turned by `angle` degrees with corners rounded by the radius; a disc
    has no length and no width. half_length and half_width are those of the rectangle inside the rounding."""
    dx, dy, a = x - cx, y - cy, F.radians(angle)
    u, v = dx * F.cos(a) + dy * F.sin(a), dy * F.cos(a) - dx * F.sin(a)
    over = lambda d, half: F.greatest(F.abs(d) - half, F.lit(0.0))
    return over(u, half_length) * over(u, half_length) + over(v, half_width) * over(v, half_width) <= radius * radius


def drawn_area(area: Column, rings: Column, least: float) -> Column:
    """Small areas are left out, but never one of several rings."""
    return ~((area < least) & (rings == 1))


def window_box(lon: Column, lat: Column, width_km: Column | float, height_km: Column | float, margin: float = 0.05) -> tuple[Column, Column, Column, Column]:
    """(south, west, north, east) in degrees of a window around a centre, wider by the margin on each side; degrees of longitude
    are as short as at the side farther from the equator."""
    width, height = (v if isinstance(v, Column) else F.lit(float(v)) for v in (width_km, height_km))
    up = height * (0.5 + margin) / 111.13
    aside = width * (0.5 + margin) / (F.cos(F.radians(F.abs(lat) + up)) * 111.32)
    return lat - up, lon - aside, lat + up, lon + aside
