"""Queries of stations, where they are and what is drawn at them, with SQL; registered beside those of linework.plans.registry.

Orders are lines, every fifth a branch, suppliers their stations on ground that grows with them; every ninth customer is a station that no line calls at.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from linework.functions import geometry as G
from linework.functions import strings as X
from linework.operators import signs as S
from linework.operators import spatial
from linework.plans.maps import in_pixels
from linework.plans.registry import LEGS, _sql_normalized, query
from linework.sources import adapters as A

CALLS_SQL = f"""g as ({A._spread_sql('supplier', 's_suppkey', 70)}), st as (select id as station_id, x, y, case when id % 3 = 0 then 'hub' else 'station' end as kind, id % 7 = 1 as hidden from g
        union all select c_custkey + 1000000000, -c_custkey, 5, case when c_custkey % 2 = 0 then 'hub' else 'station' end, c_custkey % 4 = 1 from customer where c_custkey % 9 = 0),
    f as (select line_id, station_id, min(pos) as pos from ({LEGS}) group by line_id, station_id),
    c as (select line_id, pos, f.station_id, x + line_id % 5 - 2 as x, y + line_id % 3 as y, round(cos(radians(((line_id + pos) % 8 * 45)::double)), 9) as ux, round(sin(radians(((line_id + pos) % 8 * 45)::double)), 9) as uy from f join st on st.station_id = f.station_id),
    b as (select line_id, min(pos) as p0, max(pos) as p1 from c group by line_id having min(pos) <> max(pos) and line_id % 4 <> 0),
    e as (select c.line_id, c.station_id, x, y, case when pos = p1 then ux else -ux end as ux, case when pos = p1 then uy else -uy end as uy from c join b on b.line_id = c.line_id and c.pos in (p0, p1) where c.line_id % 5 <> 0 or c.station_id <> c.line_id % 10)"""


def _called(spark, sf_dir):
    """stations, calls, ends."""
    zero = F.lit(0).alias("map_id")
    x, y = A._spread("station_id", 70)
    k = F.col("station_id")
    served = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("station_id")).select("station_id", x.alias("x"), y.alias("y"), F.when(k % 3 == 0, "hub").otherwise("station").alias("kind"), (k % 7 == 1).alias("hidden"))
    c = F.col("c_custkey").cast("long")
    alone = A.table(spark, sf_dir, "customer").where("c_custkey % 9 = 0").select((c + 1_000_000_000).alias("station_id"), (-c).alias("x"), F.lit(5).cast("long").alias("y"), F.when(c % 2 == 0, "hub").otherwise("station").alias("kind"), (c % 4 == 1).alias("hidden"))
    stations = served.unionByName(alone).select(zero, "station_id", "kind", "hidden", *[F.col(v).cast("double").alias(v) for v in "xy"])
    first = A.legs(spark, sf_dir).groupBy("line_id", "station_id").agg(F.min("pos").alias("pos"))
    rad = F.radians(((F.col("line_id") + F.col("pos")) % 8 * 45).cast("double"))
    calls = first.join(stations, "station_id").select("map_id", "line_id", "pos", "station_id", (F.col("x") + F.col("line_id") % 5 - 2).alias("x"), (F.col("y") + F.col("line_id") % 3).alias("y"), F.round(F.cos(rad), 9).alias("ux"), F.round(F.sin(rad), 9).alias("uy"))
    lines = A.table(spark, sf_dir, "orders").select(zero, F.col("o_orderkey").alias("line_id"), (F.col("o_orderkey") % 4 == 0).alias("closed"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 10).alias("branch_join"))
    return stations, calls, S.ends(calls, lines)


@query(f"""with {CALLS_SQL}, n as (select c.* from c join st on st.station_id = c.station_id where kind <> 'hub' and not hidden),
    o as (select * from n qualify row_number() over (partition by round_even(x / 0.1, 0), round_even(y / 0.1, 0) order by line_id, station_id) = 1)
    select station_id, line_id, x::double as x, y::double as y from o union all select station_id, null, x, y from st where not hidden and station_id not in (select station_id from c)""")
def station_dots(spark, sf_dir):
    stations, calls, _ = _called(spark, sf_dir)
    return S.dots(calls, stations).select("station_id", "line_id", "x", "y")


@query(f"with {CALLS_SQL} select e.station_id, line_id, e.x::double as x, e.y::double as y from e join st on st.station_id = e.station_id where kind <> 'hub'")
def terminus_rings(spark, sf_dir):
    stations, _, ends = _called(spark, sf_dir)
    return S.rings(ends, stations).select("station_id", "line_id", "x", "y")


@query(f"""with {CALLS_SQL}, h as (select e.*, st.x as hx, st.y as hy from e join st on st.station_id = e.station_id where kind = 'hub'),
    k as (select h.line_id, h.station_id, ((c.x - h.x) * c.uy - (c.y - h.y) * c.ux) / (h.ux * c.uy - h.uy * c.ux) as t from h join c on c.station_id = h.station_id and c.line_id <> h.line_id where abs(h.ux * c.uy - h.uy * c.ux) >= 1e-6),
    m as (select line_id, station_id, min(t) as t from k where t <= 1e-6 group by line_id, station_id)
    select h.station_id, h.line_id, round(case when t is not null then x + t * ux else hx + ((x - hx) * 0.6 + (y - hy) * 0.8) * 0.6 end, 4) + 0 as x, round(case when t is not null then y + t * uy else hy + ((x - hx) * 0.6 + (y - hy) * 0.8) * 0.8 end, 4) + 0 as y, t is not null as met
    from h left join m on m.line_id = h.line_id and m.station_id = h.station_id""")
def hub_dots(spark, sf_dir):
    """Coloured dots of lines that end at hubs, on the line that they come upon first, else on the axis of a pill that leans by 3 to 4."""
    stations, calls, ends = _called(spark, sf_dir)
    pills = stations.where("kind = 'hub'").select("map_id", "station_id", "x", "y", F.lit(0.6).alias("nx"), F.lit(0.8).alias("ny"))
    return S.hub_ends(ends, calls, stations, pills).select("station_id", "line_id", (F.round("x", 4) + 0).alias("x"), (F.round("y", 4) + 0).alias("y"), "met")


# ---- stations by their names, windows, pixels

_STATION = "case s_suppkey % 4 when 0 then 'S+U ' || s_name when 1 then 'Berlin-' || s_name || ' (Berlin)' when 2 then s_name || ' Hbf' else s_name end"
_STOP = "case p_partkey % 3 when 0 then 'U ' || s_name when 1 then upper(s_name) else s_name || ' (Mark)' end || case when s_suppkey % 4 = 2 then ' Hauptbahnhof' else '' end"
_ALIAS = "case when s_suppkey % 10 = 3 then 'S ' || s_name || 'X' end"


@query(f"""with s as (select s_suppkey as id, {_sql_normalized(f"coalesce({_ALIAS}, {_STATION})")} as key from supplier), pt as ({A.SITES_SQL}), v as ({A.VISITORS_SQL}),
    o as (select p_partkey as stop, {_sql_normalized(f"{_STOP} || case when s_suppkey % 10 = 3 and p_partkey % 2 = 0 then 'x' else '' end")} as key from part join supplier on s_suppkey = p_partkey // 20),
    w as (select stop, o.key, x, y from o join pt on pt.id = stop), d as (select stop, min(sqrt(power(w.x - v.x, 2) + power(w.y - v.y, 2))) as d from w join v on v.x between w.x - 40 and w.x + 40 and v.y between w.y - 40 and w.y + 40 where power(w.x - v.x, 2) + power(w.y - v.y, 2) <= 1600 group by stop),
    b as (select s.id, w.x, w.y, first_value(w.x) over o as bx, first_value(w.y) over o as by_ from s join w on w.key = s.key join d on d.stop = w.stop window o as (partition by s.id order by d.d, w.x, w.y)),
    f as (select id, avg(x) as x, avg(y) as y, count(*) as n from b where sqrt(power(x - bx, 2) + power(y - by_, 2)) <= 40 group by id)
    select s.id, round(x, 5) as x, round(y, 5) as y, coalesce(n, 0) as n_stops from s left join f on f.id = s.id""")
def stations_by_name(spark, sf_dir):
    """Stations at the stops of their name, however that is written, or of their alias; those without one near a track have no place."""
    s = A.table(spark, sf_dir, "supplier")
    key = lambda text: X.normalize_name(F.expr(text)).alias("key")
    names = s.select(F.col("s_suppkey").alias("id"), key(_STATION))
    aliases = s.where(f"({_ALIAS}) is not null").select(F.col("s_suppkey").alias("id"), X.normalize_name(F.expr(_ALIAS)).alias("alias"))
    stops = A.table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 20).alias("s_suppkey")).join(s, "s_suppkey")
    stops = stops.select(F.col("p_partkey").cast("long").alias("id"), key(f"{_STOP} || case when s_suppkey % 10 = 3 and p_partkey % 2 = 0 then 'x' else '' end")).join(A.sites(spark, sf_dir), "id")
    placed, missing = spatial.located(names, stops.select("key", "x", "y"), A.visitors(spark, sf_dir).withColumnRenamed("id", "node"), 40, aliases)
    none = F.lit(None).cast("double")
    found = placed.select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "n_stops")
    return found.unionByName(missing.select("id", none.alias("x"), none.alias("y"), F.lit(0).cast("long").alias("n_stops")))


@query(f"""with p as (select id, 13.45455::double + x / 2000.0::double as lon, 52.52542::double - y / 3000.0::double as lat, 10 + id % 7 as w, 8 + id % 5 as h from ({A.SITES_SQL})), u as (select *, h * 0.55::double / 111.13::double as up from p), d as (select *, w * 0.55::double / (111.32::double * cos(radians(abs(lat) + up))) as aside from u)
    select id, round(lat - up, 7) as south, round(lon - aside, 7) as west, round(lat + up, 7) as north, round(lon + aside, 7) as east from d""")
def map_windows(spark, sf_dir):
    """The window around each site in degrees, with a margin."""
    i = F.col("id")
    p = A.sites(spark, sf_dir).select("id", (F.lit(13.45455) + F.col("x") / 2000.0).alias("lon"), (F.lit(52.52542) - F.col("y") / 3000.0).alias("lat"))
    box = G.window_box(F.col("lon"), F.col("lat"), (10 + i % 7).cast("double"), (8 + i % 5).cast("double"))
    return p.select("id", *[F.round(v, 7).alias(n) for v, n in zip(box, ("south", "west", "north", "east"), strict=True)])


@query(f"""with p as (select line_id, pos, x, y, case when pos % 3 > 0 then pos % 3 * 0.4::double end as r from ({A.POLYLINES_SQL}))
    select line_id as map_id, pos, round((x - min(x) over w) * 1.5::double + 36, 4) + 0 as x, round((y - min(y) over w) * 1.5::double + 36, 4) + 0 as y, round(r * 1.5::double, 4) as radius, round((max(x) over w - min(x) over w) * 1.5::double + 72, 4) + 0 as width, round((max(y) over w - min(y) over w) * 1.5::double + 72, 4) + 0 as height from p window w as (partition by line_id)""")
def vertices_in_pixels(spark, sf_dir):
    """Vertices and the radii of their corners in pixels of their own map."""
    v = A.polylines(spark, sf_dir).select(F.col("line_id").alias("map_id"), "pos", "x", "y", F.when(F.col("pos") % 3 > 0, F.col("pos") % 3 * 0.4).alias("radius"))
    return in_pixels(v, 1.5, 36.0).select("map_id", "pos", *[(F.round(c, 4) + 0).alias(c) for c in ("x", "y", "radius", "width", "height")])
