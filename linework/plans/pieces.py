"""Queries of map data by its tags, signs, hints and plans, with SQL; registered beside those of linework.plans.registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.functions import drawing as D
from linework.functions import geometry as G
from linework.operators import edges, overlay
from linework.operators import labels as L
from linework.operators import marks as M
from linework.operators import tracks as T
from linework.plans.registry import LEGS, SQL, _segments, query
from linework.plans.schematic import residuals
from linework.sources import adapters as A
from linework.sources import osm

# ---- map data: parts are ways, customers are nodes, suppliers are relations and closed ways

WAYS_SQL = """w as (select p_partkey as id, case p_partkey % 5 when 0 then 'light_rail' when 1 then 'rail' when 2 then 'tram' when 3 then 'rail' end as railway,
        case p_partkey % 7 when 0 then 'yard' when 1 then 'branch' when 2 then 'siding' end as service, p_partkey % 4 + 1 as n, p_partkey % 3 as source from part)"""
LINES_SQL = """r as (select s_suppkey as id, case s_suppkey % 3 when 0 then 'light_rail' when 1 then 'train' else 'bus' end as route, case when s_suppkey % 2 = 0 then 'S' || s_suppkey % 9 else 'RE1' end as ref from supplier),
    k as (select unnest([id * 2, id * 3]) as id from r where route in ('light_rail', 'train') and ref like 'S%'), n as (select id from r where route in ('light_rail', 'train') and ref like 'S%')"""
GEOMETRY, MEMBERS = "array<struct<lon:double,lat:double>>", "array<struct<type:string,ref:long,role:string,geometry:array<struct<lon:double,lat:double>>>>"


def _elements(rows: DataFrame, kind: str, source, tags, geometry=None, members=None, lon=None, lat=None) -> DataFrame:
    none = lambda v, t: (F.lit(None) if v is None else v).cast(t)
    return rows.select(source.cast("string").alias("source"), F.col("id").cast("int").alias("elem_pos"), F.lit(kind).alias("type"), F.col("id").cast("long").alias("id"), none(lon, "double").alias("lon"), none(lat, "double").alias("lat"), none(tags, "map<string,string>").alias("tags"), none(geometry, GEOMETRY).alias("geometry"), none(members, MEMBERS).alias("members"))


def _tags(**values):
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def _rail_data(spark, sf_dir) -> DataFrame:
    p = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    i = F.col("id")
    railway = F.when(i % 5 == 0, "light_rail").when(i % 5 == 2, "tram").when(i % 5 != 4, "rail")
    service = F.when(i % 7 == 0, "yard").when(i % 7 == 1, "branch").when(i % 7 == 2, "siding")
    spot = lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    tracks = _elements(p, "way", i % 3, _tags(railway=railway, service=service), F.transform(F.sequence(F.lit(0).cast("long"), i % 4), lambda k: spot(F.col("id"), k)))
    nodes = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    stop = F.when(i % 6 == 0, "station").when(i % 6 == 1, "halt").when(i % 6 == 2, "stations")
    nodes = _elements(nodes, "node", F.lit(0), _tags(railway=stop, name=F.when(i % 4 > 0, F.concat(F.lit("N"), i.cast("string")))), lon=F.when(i % 10 > 0, i), lat=i)
    s = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    member = lambda kind, ref: F.struct(F.lit(kind).alias("type"), ref.cast("long").alias("ref"), F.lit("").alias("role"), F.lit(None).cast(GEOMETRY).alias("geometry"))
    route, ref = F.when(i % 3 == 0, "light_rail").when(i % 3 == 1, "train").otherwise("bus"), F.when(i % 2 == 0, F.concat(F.lit("S"), (i % 9).cast("string"))).otherwise("RE1")
    lines = _elements(s, "relation", F.lit(0), _tags(route=route, ref=ref), members=F.array(member("way", i * 2), member("way", i * 3), member("node", i)))
    return tracks.unionByName(nodes).unionByName(lines)


@query(f"with {WAYS_SQL} select id as way_id, n from w where railway in ('light_rail', 'rail') and coalesce(service, '') not in ('crossover', 'siding', 'yard', 'spur') and n >= 2")
def rail_tracks(spark, sf_dir):
    return osm.rails(_rail_data(spark, sf_dir)).select("way_id", F.size("pts").cast("long").alias("n"))


@query(f"with {WAYS_SQL}, {LINES_SQL} select id, railway from w where (railway is not null and id in (select id from k)) or (railway = 'light_rail' and service is null)")
def numbered_tracks(spark, sf_dir):
    return osm.line_tracks(_rail_data(spark, sf_dir)).select("id", F.col("tags")["railway"].alias("railway"))


@query(f"with {LINES_SQL} select c_custkey as id from customer where c_custkey in (select id from n) or c_custkey % 6 in (0, 1)")
def numbered_stops(spark, sf_dir):
    return osm.line_stops(_rail_data(spark, sf_dir)).select("id")


@query("select 'N' || c_custkey as name, c_custkey::double as lon, c_custkey::double as lat from customer where c_custkey % 4 > 0 and c_custkey % 10 > 0")
def named_stops(spark, sf_dir):
    return osm.stops(_rail_data(spark, sf_dir))


@query("""with s as (select s_suppkey as id from supplier), o as (select id, 0 as ring, 5 as n, 5 * id + 8 as lon, 8 as lat, id % 11 <> 0 as there from s),
    i as (select id, case when id % 11 <> 0 then 1 else 0 end, 4, 4 * id + 5, 5, id % 3 <> 0 from s), w as (select id + 1000000000, 0, 5, 5 * id, 10, id % 2 = 0 from s)
    select id, ring, n, lon::double as lon, lat::double as lat from (select * from o union all select * from i union all select * from w) where there""")
def stitched_areas(spark, sf_dir):
    """Squares in three pieces, one of them the other way round and in a fifth of them missing, with triangles as holes; and closed ways."""
    s = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    i = F.col("id")
    line = lambda *xy: F.array(*[F.struct((F.col("id") + x).cast("double").alias("lon"), F.lit(float(y)).alias("lat")) for x, y in xy])
    member = lambda role, pts: F.struct(F.lit("way").alias("type"), F.lit(1).cast("long").alias("ref"), role.alias("role"), pts.alias("geometry"))
    outer = F.when(i % 11 == 0, "label").when(i % 7 == 0, "").otherwise("outer")
    inner = F.when(i % 3 == 0, line((1, 1), (2, 2))).otherwise(line((1, 1), (2, 1), (1, 2), (1, 1)))
    parts = F.array(member(outer, line((0, 0), (4, 0), (4, 4))), member(outer, F.when(i % 5 != 0, line((0, 0), (0, 4)))), member(F.lit("inner"), inner), member(outer, line((0, 4), (4, 4))))
    relations = _elements(s, "relation", F.lit(0), None, members=parts)
    closed = F.when(i % 2 == 0, line((0, 1), (0, 3), (0, 3), (0, 2), (0, 1))).otherwise(line((0, 1), (0, 3), (0, 3), (0, 2)))
    ways = _elements(s, "way", F.lit(1), None, geometry=closed)
    total = lambda c: F.aggregate(F.col("pts"), F.lit(0.0), lambda t, p: t + p[c])
    found = osm.areas(relations.unionByName(ways))
    return found.select((F.col("elem_pos") + F.when(F.col("source") == "1", 1_000_000_000).otherwise(0)).cast("long").alias("id"), F.col("ring_pos").alias("ring"), F.size("pts").alias("n"), total("lon").alias("lon"), total("lat").alias("lat"))


# ---- signs, hints, names


@query(f"""with p as ({A.SITES_SQL}), q as (select id, (id % 19 - 9)::double as dx, (id % 13 - 6)::double as dy, radians((id % 4 * 30)::double) as a, 4 + id % 3 as hl, id % 2 as hw from p),
    u as (select *, dx * cos(a) + dy * sin(a) as u, dy * cos(a) - dx * sin(a) as v from q),
    d as (select *, power(greatest(abs(u) - hl, 0), 2) + power(greatest(abs(v) - hw, 0), 2) as far, dx * dx + dy * dy as near from u)
    select id, case id % 3 when 0 then far <= 1.5 * 1.5 when 1 then near <= 9 else near <= 4 end as under, far <= 6.25 as marked from d""")
def points_under_signs(spark, sf_dir):
    """Points beside sites: under their hub, ring or dot, and under a marker like the hub's but wider."""
    i = F.col("id")
    q = A.sites(spark, sf_dir).select("id", F.col("x").alias("cx"), F.col("y").alias("cy"), (F.col("x") + i % 19 - 9).cast("double").alias("x"), (F.col("y") + i % 13 - 6).cast("double").alias("y"), (i % 4 * 30).cast("double").alias("angle"), (4 + i % 3).cast("double").alias("hl"), (i % 2).cast("double").alias("hw"))
    kind = F.when(i % 3 == 0, "hub").when(i % 3 == 1, "end").otherwise("dot")
    spot = [F.col(c) for c in ("cx", "cy", "angle", "hl", "hw")]
    return q.select("id", M.under_station(F.col("x"), F.col("y"), kind, *spot, 1.5, 3.0, 2.0).alias("under"), G.under_marker(F.col("x"), F.col("y"), *spot, F.lit(2.5)).alias("marked"))


@query("""with p as (select p_partkey as id, [p_partkey % 3, p_partkey % 5] as here, case when p_partkey % 4 = 0 then [] else [p_partkey % 2] end as along, [p_partkey % 7] as apart, [p_partkey % 6] as ends, case when p_partkey % 3 = 0 then [] else [p_partkey % 6 % 2] end as spot from part)
    select id, (len(along) = 0 or list_has_any(along, here)) and (len(spot) = 0 or list_has_any(spot, ends)) and not list_has_any(apart, here) as holds from p""")
def lane_hints(spark, sf_dir):
    i = F.col("id")
    some = lambda empty, v: F.when(empty, F.array().cast("array<long>")).otherwise(F.array(v))
    p = A.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"))
    return p.select("id", T.hint_holds(F.array(i % 3, i % 5), some(i % 4 == 0, i % 2), F.array(i % 7), F.array(i % 6), some(i % 3 == 0, i % 6 % 2)).alias("holds"))


@query("select 'k' || case when s_suppkey % 3 = 0 then s_suppkey + 1000000 else s_suppkey end as id, '(' || case when s_suppkey % 2 = 0 then 'L' || s_suppkey else s_name end || ')' as label, true as planned from supplier")
def planned_stations(spark, sf_dir):
    """Stations given as a map, whose keys go before their own ids, as planned ones."""
    s = A.table(spark, sf_dir, "supplier")
    key = F.concat(F.lit("k"), F.col("s_suppkey").cast("string"))
    given = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("k"), (F.col("s_suppkey") + 1_000_000).cast("string")))
    rows = s.select(key.alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("L"), F.col("s_suppkey").cast("string"))).alias("label"), F.col("s_name").alias("name"), F.lit(False).alias("planned"), given.alias("given"))
    return overlay.planned(overlay.listed(rows, "id", "given")).select("id", "label", "planned")


@query(f"""with h as ({SQL['streets_at_boxes']}), p as ({A.SITES_SQL}) select id, case when id % 9 = 0 then 'top' when id in (select box from h) then 'right' else 'left' end as side from p""")
def names_beside_sites(spark, sf_dir):
    """Names of steep tracks stand on the left, but where a street runs through their box; some are fixed."""
    p = A.sites(spark, sf_dir)
    boxes = p.select(F.col("id").alias("box"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 6).alias("x1"), (F.col("y") + 9).alias("y1"))
    taken = L.sideways(boxes, _segments(spark, sf_dir, A.sites), 40, 1).select(F.col("box").alias("id"), F.lit(True).alias("taken"))
    fixed = F.when(F.col("id") % 9 == 0, "top")
    return p.join(taken, "id", "left").select("id", L.label_side(fixed, F.lit(None).cast("string"), F.lit(False), F.lit("bottom"), F.lit(True), F.col("taken").isNull(), F.lit("left")).alias("side"))


@query("select p_partkey as id, not (p_size < 20 and p_partkey % 3 = 0) as drawn from part")
def drawn_areas(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), G.drawn_area(F.col("p_size"), F.col("p_partkey") % 3 + 1, 20).alias("drawn"))


# ---- arcs, layers, residuals


@query(f"""with p as ({A.SITES_SQL}), q as (select id, x, y, 5 + id % 10 as r, case id % 3 when 0 then pi() / 2 when 1 then -pi() / 2 else atan2(0.8::double, 0.6::double) end as turn from p),
    n as (select *, greatest(ceil(abs(turn) * r), 2)::bigint as n from q), k as (select *, unnest(range(n + 1)) as k from n)
    select id, k, round(x + r * sin(abs(turn) * k / n), 5) + 0 as px, round(y + sign(turn) * r * (1 - cos(turn * k / n)), 5) + 0 as py from k""")
def turned_arcs(spark, sf_dir):
    """Arcs that start eastwards at each site, in chords of about one."""
    i = F.col("id")
    ox, oy = F.when(i % 3 == 2, 0.6).otherwise(0.0), F.when(i % 3 == 0, 1.0).when(i % 3 == 1, -1.0).otherwise(0.8)
    arc = D.circle_arc(F.col("x"), F.col("y"), F.lit(1.0), F.lit(0.0), ox, oy, (5 + i % 10).cast("double"))
    r = lambda c: F.round(c, 5) + 0
    return A.sites(spark, sf_dir).select("id", F.posexplode(arc).alias("k", "p")).select("id", F.col("k").cast("long").alias("k"), r(F.col("p.x")).alias("px"), r(F.col("p.y")).alias("py"))


@query("""with n as (select c_custkey as id, c_custkey % 2 = 0 as area, c_custkey % 3 = 0 as lined, case c_custkey % 4 when 0 then '0.5' when 1 then '1' when 2 then '1.5' else '2' end as w, c_custkey % 5 = 0 as dashed, c_custkey % 6 = 0 as pale from customer)
    select id, '<path id="n' || id || '" ' || case when area then 'fill="' || case when id % 8 = 0 then 'none' else '#eee' end || '" fill-rule="evenodd"' else 'fill="none"' end
        || case when lined or not area then ' stroke="#123" stroke-width="' || w || '" stroke-linecap="round" stroke-linejoin="round"' || case when dashed then ' stroke-dasharray="4 2"' else '' end else '' end
        || case when pale then ' opacity="0.25"' else '' end || ' d="M0 0"/>' as text from n""")
def layer_elements(spark, sf_dir):
    i = F.col("c_custkey")
    area = i % 2 == 0
    width = F.get(F.array(*[F.lit(v) for v in (0.5, 1.0, 1.5, 2.0)]), (i % 4).cast("int"))
    layer = F.struct(
        F.concat(F.lit("n"), i.cast("string")).alias("name"), F.when(area, "area").otherwise("line").alias("kind"), F.when(area & (i % 8 != 0), "#eee").alias("fill"), F.when(~area | (i % 3 == 0), "#123").alias("stroke"), width.alias("width"),
        F.when(i % 5 == 0, "4 2").alias("dash"), F.when(i % 6 == 0, 0.25).otherwise(1.0).alias("opacity"),
    )
    return A.table(spark, sf_dir, "customer").select(i.alias("id"), layer.alias("layer")).select("id", D.layer_svg("layer", F.lit("M0 0")).alias("text"))


@query(f"""with l as ({LEGS}), b as (select *, ((45 + sum(turn) over (partition by line_id order by pos)) % 360 + 360) % 360 as d, lead(station_id) over (partition by line_id order by pos) as b from l),
    p as (select line_id, pos, station_id as a, b, turn = 0 as elastic, case when turn = 0 then 5 else len end as size, d from b where b is not null),
    x as (select *, 'x' as axis, b - a as step, sin(radians(cast(d as double))) as dir from p union all select *, 'y', 2 * (b - a), cos(radians(cast(d as double))) from p)
    select line_id || ':' || pos || ':' || axis as eq, round(step - size * dir, 5) + 0 as residual from x where a <> b or (elastic and dir <> 0)""")
def layout_residuals(spark, sf_dir):
    """What the equations leave with stations on a slope and elastic legs of 5."""
    terms, right = edges.equations(A.legs(spark, sf_dir).withColumn("elastic", F.col("turn") == 0), 45, with_line=True)
    value = F.when(F.col("var").startswith("len"), 5.0).otherwise(F.substr("var", F.lit(3)).cast("double") * F.when(F.col("var").startswith("y"), 2).otherwise(1))
    given = terms.select("var").distinct().withColumn("value", value)
    right = right.groupBy("line_id").agg(F.map_from_entries(F.collect_list(F.struct("eq", "rhs"))).alias("right"))
    both = terms.join(right.hint("merge"), "line_id").withColumn("rhs", F.try_element_at("right", F.col("eq"))).drop("right")
    return residuals(both, given, "line_id").select("eq", (F.round("residual", 5) + 0).alias("residual"))
