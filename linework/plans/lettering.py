"""Queries of names and signs beside tracks, with SQL; registered beside those of linework.plans.registry.

Suppliers are tracks of two straight parts on ground that grows with them, each with a name of its own between two stations beside it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from linework.operators import beside as B
from linework.plans.registry import _ADVANCES, query
from linework.sources import adapters as A

# The SQL of tracks, names, pieces of track (p), their middles (c) and what lies beside them (d).
TRACKS_SQL = f"""g as ({A.TRACKS_SQL}), w(kind, n1, n2, ux, uy, vx, vy) as (values (0, 130, 110, 1.0::double, 0.0::double, 0.0::double, 1.0::double), (1, 100, 120, 0.6, 0.8, 1, 0), (2, 130, 110, -1, 0, 0, 1), (3, 120, 110, 0, 1, -1, 0)),
    t0 as (select id, n1 + n2 as n, unnest(range(n1 + n2 + 1)) as i, x as gx, y as gy, n1, ux, uy, vx, vy from g join w on w.kind = id % 4),
    t as (select id, n, i, i::double as s, gx + least(i, n1) * ux + greatest(i - n1, 0) * vx as x, gy + least(i, n1) * uy + greatest(i - n1, 0) * vy as y from t0)"""
NAMES_SQL = f"""{TRACKS_SQL}, a(c, w) as (values {_ADVANCES}), nm as (select s_suppkey as id, replace(s_name, '#', case when s_suppkey % 5 = 0 then chr(10) else ' ' end) as text,
        case s_suppkey % 7 when 0 then 'left' when 1 then 'right' end as side, (s_suppkey % 4)::double - 1.5 as shift, case when s_suppkey % 6 = 0 then 10::double end as start, s_suppkey % 3 = 0 as back from supplier),
    z as (select id, unnest(string_split(text, chr(10))) as z, unnest(range(len(string_split(text, chr(10))))) as row, len(string_split(text, chr(10))) as rows from nm),
    zc as (select id, row, unnest(string_split(z, '')) as c, unnest(range(length(z))) as k from z), zw as (select id, row, k, zc.c, coalesce(w, 0.62::double) * 9 as w from zc left join a on a.c = zc.c),
    wd as (select id, max(w) as w from (select id, row, sum(w) as w from zw group by id, row) group by id),
    e as (select nm.id, unnest([case when back then 150 else 70 end, case when back then 70 else 150 end]) as spot, unnest(['a', 'b']) as e from nm),
    ep as (select e.id, e.e, spot, t.x + 1 as px, case when spot = 70 then t.y + 1 else t.y - 1 end as py from e join t on t.id = e.id and t.i = e.spot),
    en as (select id, e, arg_min(i, (d, i)) as i, arg_min(s, (d, i)) as s from (select t.id, e, i, s, round(power(x - px, 2) + power(y - py, 2), 6) as d from t join ep on ep.id = t.id) group by id, e),
    m as (select nm.id, case when b.i >= a.i then 1 else -1 end as sense, 0.8 * 1.05 * w as half, coalesce(a.s + case when b.i >= a.i then 1 else -1 end * (start + w / 2 + shift), (a.s + b.s) / 2 + case when b.i >= a.i then 1 else -1 end * shift) as middle
        from nm join wd on wd.id = nm.id join en a on a.id = nm.id and a.e = 'a' join en b on b.id = nm.id and b.e = 'b'),
    wi as (select t.id, i, s, x, y, half, middle, sense from t join m on m.id = t.id where round(abs(s - middle), 6) <= round(half + 20, 6)),
    wk as (select *, row_number() over u as k, count(*) over (partition by id) as n, first_value(x) over u as fx, first_value(y) over u as fy, last_value(x) over v as lx, last_value(y) over v as ly,
        sum(x) over q as tx, sum(y) over q as ty from wi window u as (partition by id order by i), v as (partition by id order by i rows between unbounded preceding and unbounded following), q as (partition by id order by i rows between 7 preceding and 7 following)),
    sm as (select id, i, s, half, middle, sense, case when n <= 15 or k in (1, n) then x else (tx + greatest(0, 8 - k) * fx + greatest(0, 7 - (n - k)) * lx) / 15 end as x, case when n <= 15 or k in (1, n) then y else (ty + greatest(0, 8 - k) * fy + greatest(0, 7 - (n - k)) * ly) / 15 end as y from wk),
    pi as (select id, x, y, row_number() over (partition by id order by i * sense) - 1 as k, count(*) over (partition by id) as n from sm where round(abs(s - middle), 6) <= round(half, 6)),
    pd as (select *, coalesce(lead(x) over o, x) - coalesce(lag(x) over o, x) as dx, coalesce(lead(y) over o, y) - coalesce(lag(y) over o, y) as dy from pi window o as (partition by id order by k)),
    p as (select id, k, n, x, y, dx / greatest(sqrt(dx * dx + dy * dy), 1e-9) as ex, dy / greatest(sqrt(dx * dx + dy * dy), 1e-9) as ey from pd where n >= 3),
    fl as (select id, round(arg_max(x, k) - arg_min(x, k), 6) < 0 as flip from p group by id), c as (select p.id, x, y, ex, ey, flip from p join fl on fl.id = p.id where k = n // 2),
    nr as (select c.id, (t.x - c.x) * ex + (t.y - c.y) * ey as u, (t.x - c.x) * ey - (t.y - c.y) * ex as v from c join t on t.x between c.x - 26 and c.x + 26 and t.y between c.y - 26 and c.y + 26 where round(sqrt(power(t.x - c.x, 2) + power(t.y - c.y, 2)), 6) < 25),
    ro as (select id, max(v) as l, min(v) as r from nr where round(abs(u), 6) < 3 group by id),
    cg as (select c.*, greatest(coalesce(l, 0), 0) + 3.8::double as l, greatest(coalesce(-r, 0), 0) + 3.8::double as r from c left join ro on ro.id = c.id),
    ba as (select id, 1 as sg, x + ey * (l + 4.5) as px, y - ex * (l + 4.5) as py from cg union all select id, -1, x - ey * (r + 4.5), y + ex * (r + 4.5) from cg),
    un as (select ba.id, sum(sg) as more from ba join t on t.x between px - 8 and px + 8 and t.y between py - 8 and py + 8 where round(sqrt(power(t.x - px, 2) + power(t.y - py, 2)), 6) < 7.2 group by ba.id),
    d0 as (select cg.*, case side when 'left' then 1 when 'right' then -1 else case when coalesce(more, 0) <= 0 then 1 else -1 end end as side from cg join nm on nm.id = cg.id left join un on un.id = cg.id),
    d as (select *, case when side = 1 then l else r end as gap, (side = 1) <> flip as up from d0)"""


def _named(spark, sf_dir):
    """The tracks in steps, the names, and their pieces and sides."""
    track = B.track(A.tracks(spark, sf_dir))
    i = F.col("s_suppkey")
    text = F.replace(F.col("s_name"), F.lit("#"), F.when(i % 5 == 0, "\n").otherwise(" "))
    own = A.table(spark, sf_dir, "supplier").select(i.cast("long").alias("name_id"), i.cast("long").alias("line_id"), text.alias("text"), F.when(i % 7 == 0, "left").when(i % 7 == 1, "right").alias("side"), ((i % 4).cast("double") - 1.5).alias("shift"), F.when(i % 6 == 0, 10.0).alias("start"))
    at = lambda k: F.when(F.col("line_id") % 3 == 0, k[1]).otherwise(k[0])
    spot = track.where("i in (70, 150)").groupBy("line_id").agg(*[F.max(F.when(F.col("i") == k, F.col(c))).alias(f"{c}{k}") for k in (70, 150) for c in "xy"])
    x70, y70, x150, y150 = F.col("x70") + 1, F.col("y70") + 1, F.col("x150") + 1, F.col("y150") - 1
    names = own.join(spot, "line_id").select("name_id", "line_id", "text", at((x70, x150)).alias("ax"), at((y70, y150)).alias("ay"), at((x150, x70)).alias("bx"), at((y150, y70)).alias("by"), "side", "shift", "start")
    pieces = B.pieces(track, B.middles(track, names))
    return track, names, pieces, B.sides(track, names, pieces)


def _r(c: str, digits: int = 4):
    return (F.round(c, digits) + 0).alias(c)


@query(f"""with {NAMES_SQL}, b as (select d.id, z.row, side * (gap + case when up then 0 else 9 * 0.72::double end + case when up then z.row else rows - 1 - z.row end * 9 * 1.1::double) as aside, flip from d join z on z.id = d.id),
    mv as (select b.id, row, case when flip then -k else k end as k, x + ey * aside as x, y - ex * aside as y from p join b on b.id = p.id),
    ms as (select *, coalesce(sqrt(power(x - lag(x) over o, 2) + power(y - lag(y) over o, 2)), 0) as step from mv window o as (partition by id, row order by k)),
    bs as (select id, row, k, x, y, sum(step) over (partition by id, row order by k) as s from ms), bl as (select *, lead(s) over o as s1, lead(x) over o as x1, lead(y) over o as y1 from bs window o as (partition by id, row order by k)),
    tl as (select id, row, max(s) as total from bs group by id, row), lm as (select id, row, k, c, sum(w) over (partition by id, row order by k) - w / 2 - sum(w) over (partition by id, row) / 2 as m from zw),
    pr as (select lm.id, lm.row, k, c, j, least(greatest(total / 2 + m + j, 0), total) as s from lm join tl on tl.id = lm.id and tl.row = lm.row cross join (select unnest([-1, 0, 1]) as j) where c <> ' '),
    ip as (select pr.id, pr.row, pr.k, c, j, case when s1 > bl.s then x + (pr.s - bl.s) / (s1 - bl.s) * (x1 - x) else x end as x, case when s1 > bl.s then y + (pr.s - bl.s) / (s1 - bl.s) * (y1 - y) else y end as y from pr asof join bl on bl.id = pr.id and bl.row = pr.row and bl.s <= pr.s)
    select id as name_id, row, k, c, round(max(case when j = 0 then x end), 4) + 0 as x, round(max(case when j = 0 then y end), 4) + 0 as y,
        round(degrees(atan2(max(case when j = 1 then y end) - max(case when j = -1 then y end), max(case when j = 1 then x end) - max(case when j = -1 then x end))), 3) + 0 as angle from ip group by id, row, k, c""")
def names_along_tracks(spark, sf_dir):
    """Every letter of the tracks' names with its place and turn."""
    _, names, pieces, sides = _named(spark, sf_dir)
    found = B.letters(names, pieces, sides)
    return found.select("name_id", F.col("row").cast("long").alias("row"), F.col("k").cast("long").alias("k"), "c", _r("x"), _r("y"), _r("angle", 3))


@query(f"""with {NAMES_SQL}, b as (select d.id, x, y, ey * side as ux, -ex * side as uy, w, (select max(rows) from z where z.id = d.id) * 9 * 1.1::double as h, gap, unnest(range(30)) as extra from d join wd on wd.id = d.id),
    q as (select *, x + ux * (gap + extra) as qx, y + uy * (gap + extra) as qy from b), bx as (select id, extra, ux, case when ux > 0.35 then qx when ux < -0.35 then qx - w else qx - w / 2 end as x0, case when uy > 0.35 then qy when uy < -0.35 then qy - h else qy - h / 2 end as y0, w, h from q),
    rt as (select round(x, 6) as x, round(y, 6) as y from t), hit as (select distinct id, extra from bx join rt on x between round(x0 - 1, 6) and round(x0 + w + 1, 6) and y between round(y0 - 1, 6) and round(y0 + h + 1, 6)),
    ch as (select bx.*, hit.id is not null as met from bx left join hit on hit.id = bx.id and hit.extra = bx.extra),
    be as (select * from ch qualify row_number() over (partition by id order by met, case when met then -extra else extra end) = 1)
    select be.id as name_id, row, z, round(case when ux > 0.35 then x0 when ux < -0.35 then x0 + w else x0 + w / 2 end, 4) + 0 as x, round(y0 + (row + 1) * 9 * 1.1::double - 2.7, 4) + 0 as y, case when ux > 0.35 then 'start' when ux < -0.35 then 'end' else 'middle' end as anchor from be join z on z.id = be.id""")
def blocks_beside_tracks(spark, sf_dir):
    """The same names set level beside their tracks, where no track runs through them."""
    track, names, _, sides = _named(spark, sf_dir)
    return B.blocks(names, sides, track).select("name_id", F.col("row").cast("long").alias("row"), "z", _r("x"), _r("y"), "anchor")


@query(f"""with {NAMES_SQL}, mi as (select id, avg(x) as mx, avg(y) as my from t group by id),
    o as (select d.*, case when round(sqrt(power(x + ey - mx, 2) + power(y - ex - my, 2)), 6) >= round(sqrt(power(x - ey - mx, 2) + power(y + ex - my, 2)), 6) then 1 else -1 end as out from d join mi on mi.id = d.id),
    i as (select *, -ey * out as ix, ex * out as iy, case when out = -1 then l else r end as g from o), tt as (select *, case when round(-iy, 9) < 0 then iy else -iy end as tx, case when round(-iy, 9) < 0 then -ix else ix end as ty from i),
    be as (select *, case when iy * tx - ix * ty > 0 then 1 else -1 end as below from tt),
    wy as (select id, i, x, y, last_value(x) over f - first_value(x) over b as dx, last_value(y) over f - first_value(y) over b as dy from t window f as (partition by id order by i rows between current row and 5 following), b as (partition by id order by i rows between 5 preceding and current row)),
    ri as (select s_suppkey as id, unnest([s_suppkey, s_suppkey + 1]) as line, unnest([false, s_suppkey % 2 = 0]) as against from supplier), rj as (select * from ri where line in (select id from t)),
    ne as (select rj.id, line, against, arg_min(dx * tx + dy * ty, (round(power(wy.x - be.x, 2) + power(wy.y - be.y, 2), 6), i)) as along from rj join be on be.id = rj.id join wy on wy.id = rj.line group by rj.id, line, against),
    bw as (select id, line, (round(along, 9) > 0) <> against as ahead, (length(line::varchar) + case when length(line::varchar) > 1 then 1 else 0 end) * 4::double + 6 as w from ne)
    select bw.id as name_id, line as line_id, ahead, round(coalesce(sum(w + 2) over (partition by bw.id order by ahead, line rows between unbounded preceding and 1 preceding), 0) - (sum(w) over (partition by bw.id) + 2 * (count(*) over (partition by bw.id) - 1)) / 2 + (bw.id % 3)::double, 4) + 0 as x,
        round(case when below > 0 then g + 7.5 else -g - 19.5 end, 4) + 0 as y, round(below * (g + 3.5), 4) + 0 as arrow, round(degrees(atan2(ty, tx)), 3) + 0 as angle from bw join be on be.id = bw.id""")
def ring_badges(spark, sf_dir):
    """Badges of a track and the next one inside of the first, those that drive on in reading direction on the right."""
    track, names, _, sides = _named(spark, sf_dir)
    i = F.col("s_suppkey").cast("long")
    one = lambda pos, line, against: F.struct(F.lit(pos).alias("ring_pos"), line.alias("line_id"), against.alias("against"))
    rings = A.table(spark, sf_dir, "supplier").select(i.alias("name_id"), (i % 3).cast("double").alias("shift"), F.explode(F.array(one(0, i, F.lit(False)), one(1, i + 1, i % 2 == 0))).alias("r")).select("name_id", "shift", "r.*")
    found = B.ring_badges(track, rings, B.outside(track, rings, sides), 8.0, 3.0, 12.0)
    return found.select("name_id", "line_id", "ahead", _r("x"), _r("y"), _r("arrow"), _r("angle", 3))


@query(f"""with {NAMES_SQL}, o as (select id, x, y, case when id % 2 = 0 then 30 else -120 end as dx, case id % 3 when 0 then 20 when 1 then -40 else -4.95 end::double as dy from d),
    s as (select id, x, y, x + dx - 2 as ax, y + dy + 4.95::double as ay from o), v as (select *, abs(y - ay) <= 1e-6 as level from s),
    u as (select *, case when level then x - ax else 0 end as vx, y - ay as vy from v), n as (select *, vx / greatest(sqrt(vx * vx + vy * vy), 1e-9) as ux, vy / greatest(sqrt(vx * vx + vy * vy), 1e-9) as uy from u)
    select id as name_id, round(ax, 4) + 0 as ax, round(ay, 4) + 0 as ay, round(x - ux * 9, 4) + 0 as tx, round(y - uy * 9, 4) + 0 as ty, round(x - ux * 12 - 1.6 * uy, 4) + 0 as px, round(y - uy * 12 + 1.6 * ux, 4) + 0 as py from n""")
def arrows_to_tracks(spark, sf_dir):
    """Arrows from blocks that stand apart onto their tracks."""
    _, names, _, sides = _named(spark, sf_dir)
    i = F.col("name_id")
    apart = names.withColumn("dx", F.when(i % 2 == 0, 30.0).otherwise(-120.0)).withColumn("dy", F.when(i % 3 == 0, 20.0).when(i % 3 == 1, -40.0).otherwise(-4.95))
    _, arrows = B.pointing(apart, sides)
    return arrows.select("name_id", *[_r(c) for c in ("ax", "ay", "tx", "ty")], (F.round("p.x", 4) + 0).alias("px"), (F.round("p.y", 4) + 0).alias("py"))
