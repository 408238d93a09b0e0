"""Queries of joints, turns, ways and ends of lines, with SQL; registered beside those of linework.plans.registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.functions import geometry as G
from linework.operators import bundles, edges, sequences, spatial
from linework.operators import tracks as T
from linework.plans.registry import ARC_SQL, LEGS, SEGMENTS_SQL, SQL, STEPS_SQL, _segments, joined, query
from linework.sources import adapters as A

STREETS_SQL = SEGMENTS_SQL.replace(A.POINTS_SQL, A.SITES_SQL)

# ---- joints


JOINTS_SQL = f"""{STREETS_SQL.replace('with p', 'with recursive p', 1)}, e as (select seg * 2 as e, ax as x, ay as y from s union all select seg * 2 + 1, zx, zy from s),
    h as (select seg * 2 + 1 as a, seg * 2 + 2 as b from s union all select seg * 2 + 1, seg * 2 + 3 from s),
    n as (select a, b from h join e ea on ea.e = a join e eb on eb.e = b where sqrt(power(ea.x - eb.x, 2) + power(ea.y - eb.y, 2)) < 14.5),
    u as (select a, b from n union select b, a from n), r(node, root) as (select a, a from u union select u.b, r.root from r join u on u.a = r.node), c as (select node, min(root) as joint from r group by node),
    j as (select e // 2 as piece, e % 2 as "end", avg(x) over (partition by joint) as jx, avg(y) over (partition by joint) as jy from c join e on e.e = c.node)"""


def _joints(spark, sf_dir) -> DataFrame:
    """Each street goes on to the next one, to its start and to its end."""
    s = _segments(spark, sf_dir, A.sites)
    end = lambda e, x, y: F.struct(F.lit(e).cast("long").alias("end"), F.col(x).alias("x"), F.col(y).alias("y"))
    ends = s.select(F.col("seg").alias("piece"), F.explode(F.array(end(0, "ax", "ay"), end(1, "bx", "by"))).alias("e")).select("piece", "e.*")
    hops = s.select(F.col("seg").alias("p"), F.lit(1).alias("p_end"), (F.col("seg") + 1).alias("q"), F.explode(F.array(F.lit(0), F.lit(1))).alias("q_end"))
    return T.joints(ends, hops, 14.5)


@query(f'{JOINTS_SQL} select piece, "end", round(jx, 5) as jx, round(jy, 5) as jy from j')
def joint_ends(spark, sf_dir):
    return _joints(spark, sf_dir).select("piece", "end", F.round("jx", 5).alias("jx"), F.round("jy", 5).alias("jy"))


@query(f"""{JOINTS_SQL}, g as (select piece, max(jx) filter ("end" = 0) as x0, max(jy) filter ("end" = 0) as y0, max(jx) filter ("end" = 1) as x1, max(jy) filter ("end" = 1) as y1 from j group by piece),
    t as (select seg, ax, ay, zx, zy, sqrt(power(zx - ax, 2) + power(zy - ay, 2)) as total, unnest(range(0, 5)) as k from s),
    b as (select *, least(cast(6.5 as double), total / 2) as reach, ax + (zx - ax) * k / cast(4 as double) as x, ay + (zy - ay) * k / cast(4 as double) as y from t left join g on g.piece = t.seg),
    v as (select *, case when reach > 0 then greatest(cast(0 as double), least(cast(1 as double), 1 - total * k / 4 / reach)) else cast(1 as double) end as c0, case when reach > 0 then greatest(cast(0 as double), least(cast(1 as double), 1 - total * (4 - k) / 4 / reach)) else cast(1 as double) end as c1,
        coalesce(x0 - ax, 0) as sx, coalesce(y0 - ay, 0) as sy from b),
    w as (select *, c0 * c0 * (3 - 2 * c0) as w0, c1 * c1 * (3 - 2 * c1) as w1, case when reach > 0 then 0 else 1 end as still from v)
    select seg as line_id, k + 1 as pos, round(x + w0 * sx + w1 * coalesce(x1 - zx - still * sx, 0), 4) as x, round(y + w0 * sy + w1 * coalesce(y1 - zy - still * sy, 0), 4) as y from w""")
def blended_pieces(spark, sf_dir):
    """Five points of each street, drawn to its joints."""
    s = _segments(spark, sf_dir, A.sites)
    along = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * (F.col("pos") - 1) / F.lit(4.0)
    points = s.withColumn("pos", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long")))).select(F.col("seg").alias("line_id"), "pos", along("ax", "bx").alias("x"), along("ay", "by").alias("y"))
    return T.blended(points, _joints(spark, sf_dir), 6.5).select("line_id", "pos", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


# ---- turns, directions, seams


@query(f"""with p as ({A.POLYLINES_SQL}), h as (select *, count(*) over (partition by line_id) as n, atan2(cast(lead(y) over w - y as double), cast(lead(x) over w - x as double)) as h from p window w as (partition by line_id order by pos)),
    b as (select *, (((lead(h) over w - h + pi()) % (2 * pi())) + 2 * pi()) % (2 * pi()) - pi() as bend from h window w as (partition by line_id order by pos)),
    t as (select line_id, pos, n, round(abs(sum(bend) over w), 9) as turn, count(bend) over w as full_ from b window w as (partition by line_id order by pos rows between current row and 1 following)),
    q as (select *, case when coalesce(pos - lag(pos) over (partition by line_id order by pos) > 1, true) then 1 else 0 end as new from t where n >= 8 and full_ = 2 and turn > 1.5),
    r as (select *, sum(new) over (partition by line_id order by pos) as run from q)
    select line_id, pos + 1 as pos, round(turn, 6) as turn from r qualify row_number() over (partition by line_id, run order by turn desc, pos) = 1""")
def sharp_turns(spark, sf_dir):
    return sequences.turns(A.polylines(spark, sf_dir), 1, 1.5).select("line_id", "pos", F.round("turn", 6).alias("turn"))


@query(f"""{ARC_SQL}, n as (select *, row_number() over (partition by line_id order by pos) as i, count(*) over (partition by line_id) as n, max(s) over (partition by line_id) as total from s),
    k as (select *, least(greatest(coalesce(min(i) filter (s >= 1000) over (partition by line_id), n), 2), n) as a, greatest(least(min(i) filter (s >= total - 1000) over (partition by line_id), n - 1), 1) as b from n where total > 0)
    select line_id, max(x) filter (i = a) - max(x) filter (i = 1) as dx, max(y) filter (i = a) - max(y) filter (i = 1) as dy, max(x) filter (i = n) - max(x) filter (i = b) as ex, max(y) filter (i = n) - max(y) filter (i = b) as ey from k group by line_id""")
def end_directions(spark, sf_dir):
    p = A.polylines(spark, sf_dir)
    last = sequences.directions(p, 1000, from_end=True).withColumnsRenamed({"dx": "ex", "dy": "ey"})
    return sequences.directions(p, 1000).join(last, "line_id")


@query(f"""{STREETS_SQL}, d as (select *, sqrt(power(zx - ax, 2) + power(zy - ay, 2)) as n from s)
    select seg, round(case when n = 0 then 0 else (zx - ax) / n end, 6) as ux, round(case when n = 0 then 0 else (zy - ay) / n end, 6) as uy from d""")
def leg_directions(spark, sf_dir):
    ux, uy = G.leg_direction(*[F.col(c) for c in ("ax", "ay", "bx", "by")])
    return _segments(spark, sf_dir, A.sites).select("seg", F.round(ux, 6).alias("ux"), F.round(uy, 6).alias("uy"))


@query(f"""with l as ({LEGS}), j as (select *, lag(len) over w as before, lag(turn) over w = turn as same from l window w as (partition by line_id order by pos)),
    m as (select line_id, pos as start from j where same qualify row_number() over (partition by line_id order by least(before, len) desc, pos) = 1), n as (select *, count(*) over (partition by line_id) as n from l)
    select line_id, (pos - coalesce(start, 1) + n) % n + 1 as pos, station_id from n left join m using (line_id)""")
def rotated_rings(spark, sf_dir):
    legs = A.legs(spark, sf_dir)
    seams = T.seams(legs.select("line_id", "pos", F.col("turn").alias("value"), F.col("len").alias("length")))
    return T.rotated(legs.select("line_id", "pos", "station_id"), seams)


@query(f"""{STEPS_SQL}, n as (select *, len(steps) as n from s) select line_id, case when line_id % 2 = 0 then steps[n] end as before, case when line_id % 2 = 0 or n > 2 then steps[2 % n + 1] end as third,
    case when line_id % 3 = 0 then steps[n] else steps[1] end as enters from n""")
def driven_steps(spark, sf_dir):
    """What comes before the first step and third, where every other line is a ring, and where a third of them, driven backwards, begins."""
    s = sequences.steps_array(A.legs(spark, sf_dir))
    at = lambda i: G.entry(F.col("steps"), F.lit(i), F.col("line_id") % 2 == 0)
    way = F.when(F.col("line_id") % 3 == 0, -1).otherwise(1)
    return s.select("line_id", at(-1).alias("before"), at(2).alias("third"), F.get(G.oriented(F.col("steps"), way), 0).alias("enters"))


# ---- lanes


WALK_SQL = f"""with l as ({LEGS}), h as (select line_id, pos, len, cast((sum(turn) over (partition by line_id order by pos) % 360 + 360) % 360 as bigint) // 45 + 1 as h from l),
    w as (select line_id, pos, len * [1, 1, 0, -1, -1, -1, 0, 1][h] as dx, len * [0, 1, 1, 1, 0, -1, -1, -1][h] as dy from h),
    e as (select *, sum(dx) over o as bx, sum(dy) over o as by_ from w window o as (partition by line_id order by pos)),
    g as (select line_id, pos, cast(bx - dx as double) as ax, cast(by_ - dy as double) as ay, cast(bx as double) as bx, cast(by_ as double) as zy, dx / sqrt(dx * dx + dy * dy) as ux, dy / sqrt(dx * dx + dy * dy) as uy, sqrt(dx * dx + dy * dy) as len, ((line_id + pos // 2) % 3 - 1) * 0.75::double as d, case pos % 3 when 0 then 'start' when 1 then 'end' end as spot from e),
    s as (select *, ax - uy * d as sx, ay + ux * d as sy, bx - uy * d as tx, zy + ux * d as ty from g),
    p as (select *, lag(ux) over o as pux, lag(uy) over o as puy, d - lag(d) over o as delta, lag(sx) over o as psx, lag(sy) over o as psy, lag(tx) over o as ptx, lag(ty) over o as pty, lead(pos) over o is null as ends from s window o as (partition by line_id order by pos)),
    k as (select *, case when pux is null then 'end' when abs(ux - pux) > 1e-9 or abs(uy - puy) > 1e-9 then 'curve' when abs(delta) < 1e-12 then 'along' else 'KIND' end as kind, pux * uy - puy * ux as det, LONG as long from p),
    f as (select *, case spot when 'start' then 0 when 'end' then greatest(len - long, 0) else greatest(len - long, 0) / 2 end as ahead from k),
    v as (select line_id, pos, 0 as part, kind, case when kind = 'curve' and abs(det) > 1e-12 then psx + ((sx - psx) * uy - (sy - psy) * ux) / det * pux when kind = 'KIND' then ptx + ux * ahead else sx end as x,
            case when kind = 'curve' and abs(det) > 1e-12 then psy + ((sx - psx) * uy - (sy - psy) * ux) / det * puy when kind = 'KIND' then pty + uy * ahead else sy end as y, case when kind = 'change' then sign(delta) * 45 end as turn, case when kind = 'change' then long * sqrt(2) / 2 end as tangent from f
        union all select line_id, pos, 1, kind, ptx + ux * ahead + ux * long - uy * delta, pty + uy * ahead + uy * long + ux * delta, case when kind = 'change' then -sign(delta) * 45 end, case when kind = 'change' then long * sqrt(2) / 2 end from f where kind = 'KIND'
        union all select line_id, pos, 2, 'end', tx, ty, null, null from f where ends)
    select line_id, pos, cast(part as int) as part, kind, round(x, 5) + 0 as x, round(y, 5) + 0 as y, cast(turn as int) as turn, round(tangent, 5) as tangent, round(tangent / tan(radians(22.5)), 5) as radius from v"""


def _walk(spark, sf_dir) -> DataFrame:
    """Legs walked on the grid, in eight directions; every second leg a line takes its next lane of three."""
    legs = A.legs(spark, sf_dir)
    h = (F.pmod(F.sum("turn").over(sequences.so_far()), F.lit(360)) / 45).cast("int")
    step = lambda d: F.col("len") * F.get(F.array(*map(F.lit, d)), F.col("h"))
    w = legs.withColumn("h", h).withColumn("dx", step((1, 1, 0, -1, -1, -1, 0, 1))).withColumn("dy", step((0, 1, 1, 1, 0, -1, -1, -1)))
    w = w.withColumn("bx", F.sum("dx").over(sequences.so_far())).withColumn("by", F.sum("dy").over(sequences.so_far()))
    at = F.when(F.col("pos") % 3 == 0, "start").when(F.col("pos") % 3 == 1, "end")
    off = (F.col("line_id") + F.floor(F.col("pos") / 2)) % 3 - 1
    real = lambda v, n: v.cast("double").alias(n)
    return w.select("line_id", "pos", real(F.col("bx") - F.col("dx"), "ax"), real(F.col("by") - F.col("dy"), "ay"), real(F.col("bx"), "bx"), real(F.col("by"), "by"), off.alias("off"), at.alias("at"))


def _vertices(path: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 5) + 0
    return path.select("line_id", "pos", "part", "kind", r("x").alias("x"), r("y").alias("y"), "turn", F.round("tangent", 5).alias("tangent"), F.round("radius", 5).alias("radius"))


@query(WALK_SQL.replace("KIND", "change").replace("LONG", "abs(delta)"))
def lane_paths(spark, sf_dir):
    return _vertices(bundles.lane_path(_walk(spark, sf_dir), 0.75))


@query(WALK_SQL.replace("KIND", "bezier").replace("LONG", "least(abs(delta) * 4, len)"))
def lane_curves(spark, sf_dir):
    return _vertices(bundles.lane_path(_walk(spark, sf_dir), 0.75, 4.0))


# ---- crossings, stations, ways


@query(f"""{STREETS_SQL}, f as (select seg % 9 as line_id, seg % 9 % 4 as family, ax, ay, zx, zy from s), q as (select id, id % 9 as l, id % 9 % 4 as f, x, y from p),
    n as (select q.id, x, y, l, f, line_id, family, ax, ay, zx, zy from q join f on ax between x - 62 and x + 62 and ay between y - 62 and y + 62 where least(power(ax - x, 2) + power(ay - y, 2), power(zx - x, 2) + power(zy - y, 2)) < 41 * 41),
    c as (select m.id, o.family, m.x, m.y, m.ax, m.ay, m.zx - m.ax as dx, m.zy - m.ay as dy, o.zx - o.ax as ex, o.zy - o.ay as ey, o.ax - m.ax as qx, o.ay - m.ay as qy from n m join n o on m.id = o.id and m.line_id = m.l and o.family <> o.f),
    t as (select *, (qx * ey - qy * ex) / cast(dx * ey - dy * ex as double) as t, (qx * dy - qy * dx) / cast(dx * ey - dy * ex as double) as u from c where dx * ey - dy * ex <> 0),
    k as (select id, count(distinct family) as n from t where t between 0 and 1 and u between 0 and 1 and sqrt(power(ax + t * dx - x, 2) + power(ay + t * dy - y, 2)) < 20.5 group by id)
    select p.id, coalesce(n, 0) as n from p left join k using (id)""")
def crossed_near_sites(spark, sf_dir):
    family = lambda c: F.col(c) % 9 % 4
    streets = _segments(spark, sf_dir, A.sites).select((F.col("seg") % 9).alias("line_id"), family("seg").alias("family"), "ax", "ay", "bx", "by")
    places = A.sites(spark, sf_dir).select("id", (F.col("id") % 9).alias("line_id"), family("id").alias("family"), "x", "y")
    return T.crossed_near(places, streets, 20.5)


@query(SQL["locate_stations"].replace(A.POINTS_SQL, A.SITES_SQL).replace("select id as node, x, y from p where id % 2 = 0", f"select id as node, x, y from ({A.VISITORS_SQL})").replace(" from p where id % 2 = 1", " from p")
       .replace("n as (select id, id // 40 as key from p)", "n as (select id, case when id % 10 = 0 then id // 40 + 1 else id // 40 end as key from p)"))
def located_sites(spark, sf_dir):
    """Stations by the mean of the stops of their key, or of their alias, near the track."""
    p = A.sites(spark, sf_dir)
    key = F.floor(F.col("id") / 40)
    aliases = p.where("id % 10 = 0").select("id", (key + 1).alias("alias"))
    tracks = A.visitors(spark, sf_dir).withColumnRenamed("id", "node")
    placed, _ = spatial.located(p.select("id", key.alias("key")), p.select(key.alias("key"), "x", "y"), tracks, 40, aliases)
    return placed.select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "n_stops")


@query(f"""with p as ({A.SITES_SQL}), c as (select *, coalesce(sum(1 + id % 5) over (order by id rows between unbounded preceding and 1 preceding), 0) as along from p), k as (select s_suppkey as k, x, y from supplier join p on p.id = 5 * s_suppkey),
    n as (select k, along, 3 * sqrt(power(k.x - c.x, 2) + power(k.y - c.y, 2)) as cost from k join c on c.x between k.x - 24 and k.x + 24 and c.y between k.y - 24 and k.y + 24 where power(k.x - c.x, 2) + power(k.y - c.y, 2) < 600)
    select a.k as a, b.k as b, round(min(a.cost + b.cost + abs(a.along - b.along)), 5) as cost from n a join n b on b.k = a.k + 1 group by a.k, b.k""")
def routed_stations(spark, sf_dir):
    """Ways between suppliers over a track from site to site; every third pair is asked for in both directions."""
    p = A.sites(spark, sf_dir)
    k = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    stations = k.join(p.withColumn("k", F.col("id") / 5), "k").select(F.col("k").alias("station_id"), "x", "y")
    there = k.join(k.select((F.col("k") - 1).alias("k")), "k", "left_semi").select(F.col("k").alias("place"), F.col("k").alias("a"), (F.col("k") + 1).alias("b"))
    back = there.where("a % 3 = 0").select((F.col("place") + 1_000_000_000).alias("place"), F.col("b").alias("a"), F.col("a").alias("b"))
    track = p.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (1 + F.col("id") % 5).alias("w")).join(p.select(F.col("id").alias("b")), "b", "left_semi")
    ways = T.routed(there.unionByName(back), stations, p.withColumnRenamed("id", "node"), track, 600**0.5)
    return ways.select("a", "b", F.round("cost", 5).alias("cost"))


# ---- ends


ENDS_SQL = f"""with l as ({LEGS}), e as (select line_id, arg_min(station_id, pos) as first, arg_max(station_id, pos) as last from l group by line_id),
    f as (select line_id, case when line_id % 2 = 0 then line_id - 1 else line_id end as shown, case when line_id % 4 = 0 then first when line_id % 2 = 0 then last end as joins, unnest([first, last]) as station_id from e where first <> last),
    t as (select line_id, shown, station_id from f where joins is null or station_id <> joins)"""


def _ends(spark, sf_dir) -> DataFrame:
    """Even lines are branches of the lines before them, and join them at one end."""
    ends = edges.line_ends(A.legs(spark, sf_dir))
    branch = ends.where("line_id % 2 = 0").select("line_id", (F.col("line_id") - 1).alias("trunk_id"), F.when(F.col("line_id") % 4 == 0, F.col("first")).otherwise(F.col("last")).alias("joins"))
    return edges.free_ends(ends, branch)


@query(f"{ENDS_SQL}, g as (select station_id, shown, min(line_id) as line_id from t group by station_id, shown) select station_id, string_agg(shown, ',' order by line_id) as lines from g group by station_id")
def shown_ends(spark, sf_dir):
    return edges.shown_ends(_ends(spark, sf_dir)).select("station_id", joined("lines"))


@query(f"""{ENDS_SQL}, c as (select line_id, 'S' || station_id % 7 as name, arg_max(station_id, pos) as station_id from l where station_id % 13 <> 0 group by all),
    r as (select distinct line_id, shown, unnest(['S' || line_id % 7, 'S' || line_id * 3 % 7]) as name from t), o as (select r.line_id, r.shown, c.station_id from r join c using (line_id, name) where (line_id, c.station_id) not in (select line_id, station_id from t)),
    m as (select line_id, shown, case when station_id % 9 = 0 then station_id + 1 else station_id end as station_id from o), d as (select distinct * from m where (shown, station_id) not in (select shown, station_id from t)),
    g as (select station_id, shown, min(line_id) as line_id from d group by station_id, shown) select station_id, string_agg(shown, ',' order by line_id) as lines from g group by station_id""")
def partial_ends(spark, sf_dir):
    """Trains of each line end at the stations of two names; the hidden are left out, every ninth is shown at the next."""
    ends, name = _ends(spark, sf_dir), lambda c: F.concat(F.lit("S"), (c % 7).cast("string"))
    calls = A.legs(spark, sf_dir).where("station_id % 13 <> 0").select("line_id", "pos", "station_id", name(F.col("station_id")).alias("name"))
    routes = ends.select("line_id", "shown", F.explode(F.array(name(F.col("line_id")), name(F.col("line_id") * 3))).alias("name")).distinct()
    redirect = A.table(spark, sf_dir, "supplier").where("s_suppkey % 9 = 0").select(F.col("s_suppkey").alias("station_id"), (F.col("s_suppkey") + 1).alias("at"))
    return edges.shown_ends(edges.partial_ends(routes, calls, ends, redirect)).select("station_id", joined("lines"))
