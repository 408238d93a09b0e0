"""Queries of drawings, labels, marks and versions, with SQL; registered beside those of linework.plans.registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from linework.functions import drawing as D
from linework.operators import labels as L
from linework.operators import marks as M
from linework.operators import overlay, sequences, spatial
from linework.plans import maps
from linework.plans.registry import _ADVANCES, LEGS, SEGMENTS_SQL, STEPS_SQL, _segments, big, joined, query
from linework.sources import adapters as A

PAIR = "printf('%.3f %.3f', {}, {})"


def _line_points(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("pos", "x", "y")))
    lines = A.polylines(spark, sf_dir).groupBy("line_id").agg(rows.alias("rows"))
    return lines.select("line_id", F.transform("rows", lambda p: D.point(p["x"], p["y"])).alias("pts"))


@query(f"select line_id, 'M ' || string_agg({PAIR.format('x::double', 'y::double')}, ' L ' order by pos) as d from ({A.POLYLINES_SQL}) group by line_id")
def straight_paths(spark, sf_dir):
    return _line_points(spark, sf_dir).select("line_id", D.straight_path(F.col("pts")).alias("d"))


ROUNDED_SQL = f"""with p as ({A.POLYLINES_SQL}), v as (select line_id, pos, x::double as x, y::double as y, (pos % 40 + 5)::double as r, (x - lag(x) over w)::double as ix, (y - lag(y) over w)::double as iy, (lead(x) over w - x)::double as ox, (lead(y) over w - y)::double as oy from p window w as (partition by line_id order by pos)),
    g as (select *, sqrt(ix * ix + iy * iy) as din, sqrt(ox * ox + oy * oy) as dout, atan2(ix * oy - iy * ox, ix * ox + iy * oy) as delta from v),
    t as (select *, least(r * tan(abs(delta) / 2), din, dout) as t from g),
    c as (select *, coalesce(din >= 1e-9 and dout >= 1e-9 and abs(delta) >= 1e-9 and abs(abs(delta) - pi()) >= 1e-9 and t >= 1e-9, false) as arc from t)"""


#: Vertices of a piece: whole courses of users have thousands.
PIECE = 12


@query(f"""{ROUNDED_SQL.replace('partition by line_id order by pos', 'partition by line_id, (pos - 1) // 12 order by pos')}, k as (select line_id, pos, case when ix is null then 'M ' || {PAIR.format('x', 'y')} when not arc then 'L ' || {PAIR.format('x', 'y')}
        else 'L ' || {PAIR.format('x - ix / din * t', 'y - iy / din * t')} || ' A ' || {PAIR.format('t / tan(abs(delta) / 2)', 't / tan(abs(delta) / 2)')} || ' 0 0 ' || case when delta > 0 then '1 ' else '0 ' end || {PAIR.format('x + ox / dout * t', 'y + oy / dout * t')} end as part from c)
    select line_id, (pos - 1) // 12 as piece, string_agg(part, ' ' order by pos) as d from k group by line_id, (pos - 1) // 12""")
def rounded_paths(spark, sf_dir):
    """Courses in pieces of twelve vertices, each with arcs at its inner ones."""
    p = A.polylines(spark, sf_dir).withColumn("piece", F.floor((F.col("pos") - 1) / PIECE))
    own = p.groupBy("line_id", "piece").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("rows"))
    shaped = own.select("line_id", "piece", F.transform("rows", lambda r: D.point(r["x"], r["y"])).alias("pts"), F.transform("rows", lambda r: (r["pos"] % 40 + 5).cast("double")).alias("radii"))
    return shaped.select("line_id", "piece", D.rounded_path("pts", "radii").alias("d"))


@query(f"""with n as ({A.NAMES_SQL}), w as (select src, id, name, id % 90 + 0.25::double as x, id % 70 + 0.75::double as y, id % 3 = 0 as hollow, length(case when length(name) > 1 then name || ' ' else name end) * 8 * 0.5::double + 2 * 3::double as w, case when length(name) > 1 then substr(name, 1, 1) || ' ' || substr(name, 2) else name end as t from n)
    select src, id, case when hollow then printf('<rect x="%.2f" y="%.2f" width="%.2f" height="%.2f" rx="%.2f" fill="#fff" stroke="#123" stroke-width="1.2"/>', x + 0.6::double, y + 0.6::double, w - 1.2::double, 8.8::double, 4.4::double)
            else printf('<rect x="%.2f" y="%.2f" width="%.2f" height="%.2f" rx="%.2f" fill="#123"/>', x, y, w, 10::double, 5::double) end as box, t as text from w""")
def badge_shapes(spark, sf_dir):
    """Badges' boxes and texts."""
    n = A.names(spark, sf_dir).withColumn("x", F.col("id") % 90 + 0.25).withColumn("y", F.col("id") % 70 + 0.75).withColumn("hollow", F.col("id") % 3 == 0)
    svg = D.badge_svg(F.col("x"), F.col("y"), F.col("name"), F.lit("#123"), 8.0, 3.0, 10.0, 7.0, F.col("hollow"), 1.2, 2)
    rows = n.select("src", "id", svg.alias("svg"))
    return rows.select("src", "id", F.regexp_extract("svg", "^(<rect[^>]*>)", 1).alias("box"), F.regexp_extract("svg", ">([^<]*)</text>$", 1).alias("text"))


@query(f"""{SEGMENTS_SQL}, d as (select seg, ax::double as cx, ay::double as cy, (zx - ax)::double as dx, (zy - ay)::double as dy from s), u as (select *, dx / sqrt(dx * dx + dy * dy) as tx, dy / sqrt(dx * dx + dy * dy) as ty, 3::double / tan(radians(20::double)) as h from d where dx <> 0 or dy <> 0)
    select seg, printf('M%.2f,%.2f L%.2f,%.2f L%.2f,%.2f Z', cx + tx * h / 2, cy + ty * h / 2, cx - tx * h / 2 - ty * 3, cy - ty * h / 2 + tx * 3, cx - tx * h / 2 + ty * 3, cy - ty * h / 2 - tx * 3) as d from u""")
def arrows(spark, sf_dir):
    s = _segments(spark, sf_dir).where("ax <> bx or ay <> by")
    dx, dy = (F.col("bx") - F.col("ax")).cast("double"), (F.col("by") - F.col("ay")).cast("double")
    n = F.sqrt(dx * dx + dy * dy)
    return s.select("seg", D.arrow_path(F.col("ax"), F.col("ay"), dx / n, dy / n, 6.0, 40.0).alias("d"))


@query(f"""with n as ({A.NAMES_SQL}), l as (select src, id, name || ' (' || left(name, 3) || ')' as t, name || ' (' as head, '(' || left(name, 3) || ')' as tail from n), a(c, w) as (values {_ADVANCES}),
    s as (select src, id, 10 as font, unnest(string_split(name || ' ', '')) as c from n union all select src, id, 7, unnest(string_split(tail, '')) from l)
    select src, id, round(sum(coalesce(w, 0.62::double) * font), 4) as width, max(l.svg) as svg from s left join a using (c) join (select src, id, replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || ' <tspan font-size="7">' || replace(replace(replace('(' || left(name, 3) || ')', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</tspan>' as svg from n) l using (src, id) group by src, id""")
def bracket_names(spark, sf_dir):
    """Names with a part in brackets, which is set smaller."""
    text = F.concat("name", F.lit(" ("), F.substring("name", 1, 3), F.lit(")"))
    return A.names(spark, sf_dir).select("src", "id", F.round(D.name_width(text, 10.0, 7.0), 4).alias("width"), D.name_svg(text, 7.0).alias("svg"))


# ---- labels and marks


@query(f"""{SEGMENTS_SQL}, d as (select seg, ax, ay, (zx - ax)::double as dx, (zy - ay)::double as dy from s), u as (select seg, ax::double as px, ay::double as py, dx / sqrt(dx * dx + dy * dy) as ux, dy / sqrt(dx * dx + dy * dy) as uy, (seg % 30 + 20)::double as w from d where dx <> 0 or dy <> 0),
    b as (select *, px + ux * 6 as qx, py + uy * 6 as qy from u), x as (select *, case when ux > 0.35 then qx when ux < -0.35 then qx - w else qx - w / 2 end as x0, case when uy > 0.35 then qy when uy < -0.35 then qy - 10 else qy - 5 end as y0, case when seg % 9 = 0 then 'end' when ux > 0.35 then 'start' when ux < -0.35 then 'end' else 'middle' end as anchor from b)
    select seg, round(x0, 5) + 0 as x0, round(y0, 5) + 0 as y0, anchor, round(case anchor when 'start' then x0 when 'end' then x0 + w else x0 + w / 2 end, 5) + 0 as at from x""")
def mark_boxes(spark, sf_dir):
    s = _segments(spark, sf_dir).where("ax <> bx or ay <> by")
    dx, dy = (F.col("bx") - F.col("ax")).cast("double"), (F.col("by") - F.col("ay")).cast("double")
    n = F.sqrt(dx * dx + dy * dy)
    box = M.box_at(F.col("ax"), F.col("ay"), dx / n, dy / n, (F.col("seg") % 30 + 20).cast("double"), F.lit(10.0), 6.0)
    name, at = M.anchor(dx / n, box[0], box[2], F.when(F.col("seg") % 9 == 0, "end"))
    r = lambda c: F.round(c, 5) + 0
    return s.select("seg", r(box[0]).alias("x0"), r(box[1]).alias("y0"), name.alias("anchor"), r(at).alias("at"))


@query(f"""{SEGMENTS_SQL}, u as (select seg, ax::double as cx, ay::double as cy, (zx - ax) / sqrt((zx - ax) * (zx - ax) + (zy - ay) * (zy - ay)) as nx, (zy - ay) / sqrt((zx - ax) * (zx - ax) + (zy - ay) * (zy - ay)) as ny, (seg % 9 + 1)::double as len from s where zx <> ax or zy <> ay),
    q as (select a.seg, a.cx, a.cy, a.nx, a.ny, a.len, b.cx as dx, b.cy as dy, b.nx as mx, b.ny as my, b.len as len2, a.nx * b.ny - a.ny * b.nx as det from u a join u b on b.seg = a.seg + 1),
    c as (select *, ((dx - cx) * mx + (dy - cy) * my) / det as t from q where abs(det) >= 0.2)
    select seg, round(cx - ny * t, 4) + 0 as x, round(cy + nx * t, 4) + 0 as y, round(cx - ny * t + (len / 2 * my - len2 / 2 * ny) / det, 4) + 0 as x1, round(cy + nx * t + (len2 / 2 * nx - len / 2 * mx) / det, 4) + 0 as y1 from c""")
def crossing_areas(spark, sf_dir):
    """Where the bundles of two pills cross: the middle and the first corner."""
    s = _segments(spark, sf_dir).where("ax <> bx or ay <> by")
    dx, dy = (F.col("bx") - F.col("ax")).cast("double"), (F.col("by") - F.col("ay")).cast("double")
    n = F.sqrt(dx * dx + dy * dy)
    u = s.select("seg", F.col("ax").alias("cx"), F.col("ay").alias("cy"), (dx / n).alias("nx"), (dy / n).alias("ny"), (F.col("seg") % 9 + 1).cast("double").alias("len"))
    o = u.select((F.col("seg") - 1).alias("seg"), *[F.col(c).alias(f"o{c}") for c in ("cx", "cy", "nx", "ny", "len")])
    area = M.crossing_area(*[F.col(c) for c in ("cx", "cy", "nx", "ny", "len", "ocx", "ocy", "onx", "ony", "olen")])
    r = lambda c: F.round(c, 4) + 0
    first = F.get("a.corners", F.lit(0))
    return u.join(o, "seg").withColumn("a", area).where("a is not null").select("seg", r(F.col("a.x")).alias("x"), r(F.col("a.y")).alias("y"), r(first["x"]).alias("x1"), r(first["y"]).alias("y1"))


@query(f"""{SEGMENTS_SQL}, q as (select id, x + 3 + id % 11 as x, y - 2 as y, case id % 3 when 0 then 1 when 1 then 0 else 0.6::double end as ux, case id % 3 when 0 then 0 when 1 then 1 else 0.8::double end as uy from p), r as (select *, case seg % 3 when 0 then ax + 12 when 1 then ax else ax + 9 end as cx, case seg % 3 when 0 then ay when 1 then ay + 12 else ay + 12 end as cy from s),
    d as (select q.id, x, y, ax, ay, cx - ax as dx, cy - ay as dy, ux, uy from q join r on abs(x - ax) < 30 and abs(y - ay) < 30),
    t as (select *, greatest(0::double, least(1::double, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)::double)) as t from d where abs(ux * dy - uy * dx) / sqrt(dx * dx + dy * dy) <= 1e-6)
    select distinct id from t where sqrt(power(x - ax - t * dx, 2) + power(y - ay - t * dy, 2)) < 7.3""")
def ring_sides(spark, sf_dir):
    """Points that run beside a segment of their own direction."""
    p = A.points(spark, sf_dir)
    kind = F.col("id") % 3
    probes = p.select("id", (F.col("x") + 3 + F.col("id") % 11).alias("x"), (F.col("y") - 2).alias("y"), F.when(kind == 0, 1.0).when(kind == 1, 0.0).otherwise(0.6).alias("ux"), F.when(kind == 0, 0.0).when(kind == 1, 1.0).otherwise(0.8).alias("uy"))
    ring = p.select(F.col("id").alias("seg"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + F.when(kind == 0, 12).when(kind == 1, 0).otherwise(9)).alias("bx"), (F.col("y") + F.when(kind == 0, 0).otherwise(12)).alias("by"))
    return M.beside_ring(probes, ring, 7.3)


@query(f"""{SEGMENTS_SQL}, l as (select seg % 7 as line_id, seg, ax, ay, zx - ax as dx, zy - ay as dy from s where zx <> ax or zy <> ay), q as (select id as station_id, id % 7 as line_id, x + 3 as x, y - 2 as y from p),
    d as (select station_id, line_id, seg, x, y, ax, ay, dx, dy, greatest(0::double, least(1::double, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)::double)) as t from q join l using (line_id) where abs(x - ax) < 60 and abs(y - ay) < 60),
    e as (select *, round(sqrt(power(x - (ax + t * dx), 2) + power(y - (ay + t * dy), 2)), 9) as d from d)
    select station_id, line_id, round(ax + t * dx, 4) + 0 as x, round(ay + t * dy, 4) + 0 as y from e where d <= 12 qualify row_number() over (partition by station_id, line_id order by d, seg) = 1""")
def line_points(spark, sf_dir):
    """Where lines pass their stations."""
    stops = A.points(spark, sf_dir).select(F.col("id").alias("station_id"), (F.col("id") % 7).alias("line_id"), (F.col("x") + 3).alias("x"), (F.col("y") - 2).alias("y"))
    segs = _segments(spark, sf_dir).drop("family").withColumn("line_id", F.col("seg") % 7)
    return M.line_points(stops, segs, 12.0).select("station_id", "line_id", (F.round("x", 4) + 0).alias("x"), (F.round("y", 4) + 0).alias("y"))


@query(f"""with p as ({A.POINTS_SQL}), b as (select id, x::double as x, y::double as y, case id % 4 when 0 then 'left' when 1 then 'top' when 2 then 'bottom_right' else 'top_left' end as side, id % 3 + 1 as n, (id % 40 + 15)::double as w, case when id % 5 = 0 then 11.5::double else 0 end as extra from p),
    o as (select *, case side when 'left' then -9 when 'top' then 0 when 'bottom_right' then 9 * sqrt(0.5) else -9 * sqrt(0.5) end as dx, case side when 'left' then 3 when 'top' then -10 when 'bottom_right' then 9 * sqrt(0.5) + 7 else -9 * sqrt(0.5) - 1 end as dy, (n - 1) * 11.5::double as h from b),
    h as (select *, h + case when side = 'left' then extra else 0 end as g from o),
    k as (select *, x + dx + case side when 'bottom_right' then g / 2 when 'top_left' then -g / 2 else 0 end as lx, y + dy + case when side = 'top' then -g else -g / 2 end as ly from h)
    select id, round(case side when 'top' then lx - w / 2 when 'bottom_right' then lx else lx - w end, 5) + 0 as x0, round(ly - 7.5, 5) + 0 as y0, round(ly + h + 2.5, 5) + 0 as y1 from k""")
def label_boxes(spark, sf_dir):
    k = F.col("id") % 4
    side = F.when(k == 0, "left").when(k == 1, "top").when(k == 2, "bottom_right").otherwise("top_left")
    p = A.points(spark, sf_dir)
    box = L.label_box(F.col("x").cast("double"), F.col("y").cast("double"), side, F.col("id") % 3 + 1, (F.col("id") % 40 + 15).cast("double"), 10.0, 9.0, F.when(F.col("id") % 5 == 0, 11.5).otherwise(0.0))
    r = lambda c: F.round(c, 5) + 0
    return p.select("id", r(box[0]).alias("x0"), r(box[1]).alias("y0"), r(box[3]).alias("y1"))


@query(f"""{SEGMENTS_SQL}, q as (select id, x, y, y - 4 as y0, y + 6 as y1 from p where id % 3 = 0), d as (select q.id, q.x, y0, y1, ax, ay, zx, zy from q join s on least(sqrt((ax - q.x) * (ax - q.x) + (ay - q.y) * (ay - q.y)), sqrt((zx - q.x) * (zx - q.x) + (zy - q.y) * (zy - q.y))) <= 15),
    t as (select *, unnest([0::double, 1::double, case when zy <> ay then (y0 - ay) / (zy - ay)::double end, case when zy <> ay then (y1 - ay) / (zy - ay)::double end]) as t from d),
    e as (select id, x, ax + t * (zx - ax) as qx, ay + t * (zy - ay) as qy, y0, y1 from t where t between -1e-9 and 1 + 1e-9)
    select id, round(max(qx - x + 2), 5) + 0 as extent from e where qy between y0 - 2 and y1 + 2 group by id""")
def ink_extents(spark, sf_dir):
    """How far lines reach to the right of every third point within the band of its label."""
    probes = A.points(spark, sf_dir).where("id % 3 = 0").select("id", "x", "y", (F.col("y") - 4).alias("y0"), (F.col("y") + 6).alias("y1"))
    return L.ink_extent(probes, _segments(spark, sf_dir), 1.0, 2.0, 15.0).select("id", (F.round("extent", 5) + 0).alias("extent"))


@query(f"""with l as (select distinct station_id, cast(line_id as varchar) as line_id from ({LEGS})), h as (select *, length(line_id) % 2 = 0 as hollow, [cast(station_id * 3 as varchar), cast(station_id * 5 as varchar)] as wanted from l)
    select station_id, line_id, row_number() over (partition by station_id order by coalesce(nullif(list_position(wanted, line_id), 0), 1000000), hollow, length(line_id), line_id) as rank from h""")
def badge_rows_mixed(spark, sf_dir):
    l = A.legs(spark, sf_dir).select("station_id", F.col("line_id").cast("string").alias("line_id")).distinct()  # noqa: E741
    rows = l.withColumn("hollow", F.length("line_id") % 2 == 0).withColumn("wanted", F.array((F.col("station_id") * 3).cast("string"), (F.col("station_id") * 5).cast("string")))
    return L.badge_row(rows, "wanted").select("station_id", "line_id", *big("rank"))


@query(f"""with n as ({A.NAMES_SQL}), a(c, w) as (values {_ADVANCES}), s as (select src, id, id % 100 as table_id, id % 4 as col, unnest(string_split(name, '')) as c from n where name <> ''),
    w as (select src, id, table_id, col, sum(coalesce(w, 0.62::double)) * 10 as w from s left join a using (c) group by all), m as (select table_id, col, max(w) + 6 as width from w group by table_id, col)
    select table_id, col, round(width, 4) as width, round(coalesce(sum(width) over (partition by table_id order by col rows between unbounded preceding and 1 preceding), 0), 4) as "offset" from m""")
def column_widths(spark, sf_dir):
    cells = A.names(spark, sf_dir).select((F.col("id") % 100).alias("table_id"), (F.col("id") % 4).alias("col"), F.col("name").alias("text"))
    return maps.column_widths(cells, 10.0, 3.0).select("table_id", "col", F.round("width", 4).alias("width"), F.round("offset", 4).alias("offset"))


@query(f"with l as ({LEGS}) select station_id, string_agg(distinct line_id, ',' order by line_id) as lines from l group by station_id")
def serving_lines(spark, sf_dir):
    return maps.serving_lines(A.legs(spark, sf_dir)).select("station_id", joined("lines"))


# ---- windows of crossings, common runs


CIRCLE_SQL = f"""with p as ({A.POLYLINES_SQL}), s as (select line_id, pos, x::double as ax, y::double as ay, (lead(x) over w)::double as zx, (lead(y) over w)::double as zy from p window w as (partition by line_id order by pos)),
    c as (select line_id as circle, line_id, x::double as x, y::double as y, 4000::double as r from p where pos = 3),
    q as (select circle, line_id, pos, ax, ay, zx - ax as dx, zy - ay as dy, (zx - ax) * (zx - ax) + (zy - ay) * (zy - ay) as a, 2 * ((ax - x) * (zx - ax) + (ay - y) * (zy - ay)) as b, (ax - x) * (ax - x) + (ay - y) * (ay - y) - r * r as c from s join c using (line_id) where zx is not null),
    t as (select *, greatest(0, (-b - sqrt(b * b - 4 * a * c)) / (2 * a)) as t0, least(1, (-b + sqrt(b * b - 4 * a * c)) / (2 * a)) as t1 from q where a > 1e-12 and b * b - 4 * a * c > 0),
    n as (select *, case when t0 > 0 or lag(t1) over w < 1 or lag(pos) over w <> pos - 1 or row_number() over w = 1 then 1 else 0 end as new from t where t0 < t1 window w as (partition by circle order by pos))"""


@query(f"{CIRCLE_SQL} select circle, pos, cast(sum(new) over (partition by circle order by pos) as bigint) as piece, round(ax + t0 * dx, 3) + 0 as x0, round(ay + t1 * dy, 3) + 0 as y1 from n")
def circle_pieces(spark, sf_dir):
    """What lies of each user's course in a circle around its third vertex."""
    p = A.polylines(spark, sf_dir)
    line = sequences.line()
    segs = p.select("line_id", "pos", F.col("x").cast("double").alias("ax"), F.col("y").cast("double").alias("ay"), F.lead("x").over(line).cast("double").alias("bx"), F.lead("y").over(line).cast("double").alias("by")).where("bx is not null")
    circles = p.where("pos = 3").select(F.col("line_id").alias("circle"), "line_id", "x", "y", F.lit(4000.0).alias("r"))
    rows = spatial.pieces_in_circle(segs, circles)
    return rows.select("circle", "pos", *big("piece"), (F.round("ax", 3) + 0).alias("x0"), (F.round("by", 3) + 0).alias("y1"))


@query(f"""{SEGMENTS_SQL}, g as (select seg as line_id, ax, ay, zx, zy from s), c as (select a.seg as crossing, a.seg as upper, b.seg as lower, (a.ax + a.zx) / 2::double as x, (a.ay + a.zy) / 2::double as y from s a join s b on b.seg = a.seg + 1),
    u as (select crossing, lower, x, y, ax, ay, zx, zy, greatest(cast(floor(sqrt((zx - ax) * (zx - ax) + (zy - ay) * (zy - ay))) as bigint), 1) as n from c join g on g.line_id = upper),
    k as (select *, unnest(range(0, n + 1)) as k from u), m as (select crossing, lower, x, y, ax + k / n::double * (zx - ax) as qx, ay + k / n::double * (zy - ay) as qy from k),
    f as (select *, sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y)) as far from m), d as (select f.*, zx - ax as dx, zy - ay as dy, ax, ay from f join g on g.line_id = lower where far <= 60),
    t as (select *, case when dx = 0 and dy = 0 then 0 else greatest(0::double, least(1::double, ((qx - ax) * dx + (qy - ay) * dy) / (dx * dx + dy * dy)::double)) end as t from d),
    h as (select crossing, max(far) as far from t where sqrt(power(qx - ax - t * dx, 2) + power(qy - ay - t * dy, 2)) < 40 group by crossing)
    select c.crossing, round(least(coalesce(far, 0) + 31, 60), 5) as radius from c left join h using (crossing)""")
def window_radii(spark, sf_dir):
    """Windows around the middles of segments, with the next segment as the lower line, on a large scale."""
    s = _segments(spark, sf_dir)
    segs = s.select(F.col("seg").alias("line_id"), F.lit(0).alias("pos"), "ax", "ay", "bx", "by")
    after = s.select((F.col("seg") - 1).alias("seg"), F.col("seg").alias("lower"))
    crossings = s.join(after, "seg").select(F.col("seg").alias("crossing"), F.col("seg").alias("upper"), "lower", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    return spatial.window_radius(crossings, segs, 10.0, 30.0).select("crossing", F.round("radius", 5).alias("radius"))


# ---- versions


@query(f"""with p as ({A.PARENT_SQL}), d as ({A.DELTA_SQL}), g as ({A.GROUPS_SQL}), m as (select coalesce(d.key, p.key) as key, case when d.key is not null then d.value else p.value end as value from p full join d on p.key = d.key where not coalesce(d.tombstone, false))
    select 'stations' as part, key, round(value, 2) as value from m union all select 'lines', line_id, n from g where line_id % 6 <> 0
    union all select 'lines', line_id, case when line_id % 6 = 0 then n * 10 end from g where line_id % 6 = 0 union all select 'colors', line_id, line_id % 9 from g""")
def derive_tables(spark, sf_dir):
    """A version of three tables at once: two with changes, one without."""
    parent, delta = A.overlay(spark, sf_dir)
    g = A.groups(spark, sf_dir).select(F.col("line_id").alias("key"), F.col("n").cast("double").alias("value"))
    colors = g.select("key", (F.col("key") % 9).cast("double").alias("value"))
    changes = overlay.changed(g, F.col("key") % 6 == 0, value=F.col("value") * 10).where("key % 6 = 0").withColumn("tombstone", F.lit(False))
    out = overlay.derived({"stations": parent, "lines": g, "colors": colors}, {"stations": delta, "lines": changes}, {"stations": ["key"], "lines": ["key"]})
    rows = [t.select(F.lit(name).alias("part"), "key", F.round(F.col("value").cast("double"), 2).alias("value")) for name, t in out.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"""{STEPS_SQL}, f as (select *, list_position(list_transform(range(1, len(steps)), lambda i: steps[i] % 10 = 3 and steps[i + 1] % 2 = 0), true) as place from s),
    o as (select line_id, steps, case when place > 0 then steps[place:place + 1] else [-9, -8] end as old, line_id % 2 = 1 as turned from f),
    r as (select line_id, case when turned then list_reverse(steps) else steps end as steps, old, turned from o),
    w as (select line_id, turned, old, steps, list_position(list_transform(range(1, len(steps)), lambda i: steps[i] = old[1] and steps[i + 1] = old[2]), true) as ahead, list_position(list_transform(range(1, len(steps)), lambda i: steps[i] = old[2] and steps[i + 1] = old[1]), true) as back from r)
    select line_id, array_to_string(case when ahead > 0 then list_concat(list_concat(steps[1:ahead - 1], [-1, -2, -3]), steps[ahead + 2:]) when back > 0 then list_concat(list_concat(steps[1:back - 1], [-3, -2, -1]), steps[back + 2:]) else steps end, ',') as steps from w""")
def rewritten_lines(spark, sf_dir):
    """Each line's pair of a station that ends in 3 and an even one is replaced, in odd lines driven the other way."""
    lines = sequences.steps_array(A.legs(spark, sf_dir))
    here = F.filter(F.when(F.size("steps") > 1, F.sequence(F.lit(1), F.size("steps") - 1)).otherwise(F.array().cast("array<int>")), lambda i: (F.get("steps", i - 1) % 10 == 3) & (F.get("steps", i) % 2 == 0))
    old = F.when(F.size(here) > 0, F.slice("steps", F.get(here, 0), 2)).otherwise(F.array(F.lit(-9).cast("long"), F.lit(-8).cast("long")))
    rows = lines.withColumn("old", old).withColumn("steps", F.when(F.col("line_id") % 2 == 1, F.reverse("steps")).otherwise(F.col("steps")))
    new = F.array(*[F.lit(k).cast("long") for k in (-1, -2, -3)])
    return sequences.rewritten(rows, [(F.col("old"), new)]).select("line_id", joined("steps"))
