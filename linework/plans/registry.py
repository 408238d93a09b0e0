"""Queries over the star schema by name, each one operator or a few, and SQL with the same result.

Whole numbers are BIGINT and doubles are rounded to six decimals at most, in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linework.functions import geometry as G
from linework.functions import polyline as P
from linework.functions import strings as X
from linework.operators import edges, graph, overlay, sequences, spatial
from linework.operators import labels as L
from linework.operators import tracks as T
from linework.plans import schematic
from linework.sources import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LEGS = A.LEGS_SQL


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def joined(name: str) -> Column:
    return F.array_join(F.col(name), ",").alias(name)


EDGES_SQL = f"""with l as ({LEGS}), p as (select line_id, pos, station_id as a, lead(station_id) over (partition by line_id order by pos) as b, len, turn from l),
    e as (select *, least(a, b) as u, greatest(a, b) as v from p where b is not null and a <> b)"""


# ---- edges and corridors


@query(f"{EDGES_SQL} select u, v, count(distinct line_id) as n_lines from e group by u, v having count(distinct line_id) > 1")
def shared_corridors(spark, sf_dir):
    return edges.shared(A.legs(spark, sf_dir))


@query(f"{EDGES_SQL}, d as (select distinct u, v, line_id from e) select u, v, string_agg(line_id, ',' order by line_id) as lines from d group by u, v")
def corridor_user_lists(spark, sf_dir):
    return edges.edge_lines(A.legs(spark, sf_dir)).select("u", "v", joined("lines"))


@query(f"{EDGES_SQL} select (select count(distinct line_id) from l) as n_lines, (select count(distinct station_id) from l) as n_stations, (select count(*) from (select distinct u, v from e)) as n_edges")
def layout_report(spark, sf_dir):
    return edges.report(A.legs(spark, sf_dir))


@query(f"{EDGES_SQL} select u, v, line_id, pos, a = u as forward from e qualify row_number() over (partition by u, v order by line_id, pos) = 1")
def edge_builders(spark, sf_dir):
    return edges.first_use(A.legs(spark, sf_dir))


@query(f"with l as ({LEGS}) select line_id, arg_min(station_id, pos) as first, arg_max(station_id, pos) as last from l group by line_id")
def line_ends(spark, sf_dir):
    return edges.line_ends(A.legs(spark, sf_dir))


@query(f"""with l as ({LEGS}), e as (select line_id, arg_min(station_id, pos) as first, arg_max(station_id, pos) as last from l group by line_id),
    f as (select distinct line_id, unnest([first, last]) as station_id from e) select station_id, string_agg(line_id, ',' order by line_id) as lines from f group by station_id""")
def end_lists(spark, sf_dir):
    return edges.end_lists(A.legs(spark, sf_dir)).select("station_id", joined("lines"))


@query(f"""with l as ({LEGS}), e as (select line_id, arg_min(station_id, pos) as first, arg_max(station_id, pos) as last from l group by line_id),
    r as (select distinct line_id, station_id from l where turn <> 0)
    select r.line_id, r.station_id from r join e using (line_id) where r.station_id <> first and r.station_id <> last""")
def intermediate_ends(spark, sf_dir):
    legs = A.legs(spark, sf_dir)
    routes = legs.where("turn <> 0").select("line_id", "station_id").distinct()
    return edges.inner_ends(legs, routes)


@query(f"""with l as ({LEGS}), e as (select line_id, arg_min(station_id, pos) as first, arg_max(station_id, pos) as last from l group by line_id),
    t as (select line_id, line_id - 1 as trunk_id from e where line_id % 2 = 0),
    f as (select t.line_id, trunk_id, unnest([first, last]) as station_id from t join e using (line_id)), s as (select distinct line_id as trunk_id, station_id, 1 as there from l)
    select line_id, trunk_id, count(there) as n_on from f left join s using (trunk_id, station_id) group by line_id, trunk_id""")
def branch_join(spark, sf_dir):
    legs = A.legs(spark, sf_dir)
    trunk = legs.where("line_id % 2 = 0").select("line_id", (F.col("line_id") - 1).alias("trunk_id")).distinct()
    return edges.branches(legs, trunk)


@query(f"""with g as ({A.GROUPS_SQL}) select line_id, grp, case when line_id = 7 then 0.25 when line_id = 11 then -2.0 when grp = 'BUILDING' then -1.0 when grp = 'MACHINERY' then 1.0 when grp = 'AUTOMOBILE' then 0.5 end as "offset" from g""")
def offset_lookup(spark, sf_dir):
    table = F.create_map(*[F.lit(x) for x in ("7", 0.25, "11", -2.0, "BUILDING", -1.0, "MACHINERY", 1.0, "AUTOMOBILE", 0.5)])
    rows = A.groups(spark, sf_dir).select("line_id", "grp")
    return edges.offsets(rows, table, F.col("line_id").cast("string"), F.col("grp"), strict=False)


@query(f"""with l as ({LEGS}), p as (select line_id, station_id as a, lead(station_id) over (partition by line_id order by pos) as b from l),
    e as (select distinct least(a, b) as u, greatest(a, b) as v, 'F' || (line_id % 5) as family from p where b is not null and a <> b)
    select u, v, family, row_number() over (partition by u, v order by family) - 1 - (count(*) over (partition by u, v) - 1) / cast(2 as double) as slot from e""")
def lane_slots(spark, sf_dir):
    e = edges.undirected(A.legs(spark, sf_dir)).select("u", "v", F.concat(F.lit("F"), (F.col("line_id") % 5).cast("string")).alias("family")).distinct()
    return edges.slots(e)


@query(f"""{EDGES_SQL} select u, v, count(distinct round(case when a = u then len % 4 else -(len % 4) end, 6)) as width from e group by u, v""")
def bundle_width(spark, sf_dir):
    e = edges.undirected(A.legs(spark, sf_dir))
    lane = F.when(F.col("a") == F.col("u"), F.col("len") % 4).otherwise(-(F.col("len") % 4)).cast("double")
    return edges.lanes_per_edge(e.select("u", "v", lane.alias("lane")))


@query(f"""with l as ({LEGS}), g as (select line_id, case when pos % 3 = 0 then 'group ' || (len % 3) else 'leg ' || pos end as var, pos, len, turn from l where turn <> 0)
    select line_id, var, arg_min(len, pos) as preferred, count(*) as n_legs, max(len) = min(len) as agree from g group by line_id, var""")
def length_groups(spark, sf_dir):
    legs = A.legs(spark, sf_dir).where("turn <> 0")
    group = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("group "), (F.col("len") % 3).cast("string")))
    e = legs.select("line_id", "pos", group.alias("group"), F.col("len").alias("preferred"), F.lit(0.2).alias("minimum"), F.lit(float("inf")).alias("maximum"), F.lit(1.0).alias("flex"))
    return edges.length_variables(e).select("line_id", "var", "preferred", "n_legs", "agree")


@query(f"""with l as ({LEGS}), b as (select *, ((45 + sum(turn) over (partition by line_id order by pos)) % 360 + 360) % 360 as d, lead(station_id) over (partition by line_id order by pos) as b from l),
    p as (select line_id, pos, station_id as a, b, len, turn = 0 as elastic, d from b where b is not null),
    x as (select *, 'x' as axis, sin(radians(cast(d as double))) as dir from p union all select *, 'y', cos(radians(cast(d as double))) from p),
    t as (select line_id || ':' || pos || ':' || axis as eq, axis || ':' || b as var, cast(1 as double) as coef from x
          union all select line_id || ':' || pos || ':' || axis, axis || ':' || a, -1 from x
          union all select line_id || ':' || pos || ':' || axis, 'len:' || line_id || ':' || pos, -dir from x where elastic)
    select eq, var, round(sum(coef), 6) + 0 as coef from t group by eq, var having sum(coef) <> 0""")
def equations_coo(spark, sf_dir):
    terms, _ = edges.equations(A.legs(spark, sf_dir).withColumn("elastic", F.col("turn") == 0), 45)
    return terms.select("eq", "var", (F.round("coef", 6) + 0).alias("coef"))


@query(f"""with l as ({LEGS}), w as (select station_id as joint, line_id, min(pos) as start, max(pos + len) as stop from l group by station_id, line_id),
    j as (select joint, min(start) as start, max(stop) as stop from w group by joint) select joint, line_id, j.start, j.stop from w join j using (joint)""")
def switching_windows(spark, sf_dir):
    w = A.legs(spark, sf_dir).groupBy(F.col("station_id").alias("joint"), "line_id").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("len")).alias("stop"))
    return edges.switching_windows(w)


# ---- ordered steps


@query(f"""with l as ({LEGS}), s as (select line_id, pos * 2 as pos, station_id, null as turn from l union all select line_id, pos * 2 + 1, null, turn from l where turn <> 0),
    n as (select *, count(station_id) over (partition by line_id order by pos) as seg from s),
    g as (select line_id, seg, max(station_id) as a, count(turn) as modifiers, coalesce(cast(sum(turn) as bigint), 0) as turn from n where seg > 0 group by line_id, seg)
    select * from (select *, lead(a) over (partition by line_id order by seg) as b from g) where b is not null""")
def segments_parse(spark, sf_dir):
    step = F.explode(F.array(F.struct((F.col("pos") * 2).alias("pos"), F.col("station_id"), F.lit(None).cast("long").alias("turn")), F.struct((F.col("pos") * 2 + 1).alias("pos"), F.lit(None).cast("long").alias("station_id"), F.col("turn"))))
    steps = A.legs(spark, sf_dir).select("line_id", step.alias("s")).select("line_id", "s.*").where("station_id is not null or turn <> 0")
    return sequences.segments(steps)


@query(f"with l as ({LEGS}) select line_id, pos, cast(((45 + sum(turn) over (partition by line_id order by pos)) % 360 + 360) % 360 as bigint) as bearing from l")
def running_bearing(spark, sf_dir):
    return sequences.running_bearing(A.legs(spark, sf_dir), 45).select("line_id", "pos", *big("bearing"))


@query(f"""with l as ({LEGS}), t as (select *, case when turn = 0 then 0.0 else cast(0.8 as double) * tan(radians(cast(45 as double)) / 2) end as tangent from l)
    select line_id, pos, round(greatest(cast(len as double), coalesce(lag(tangent) over (partition by line_id order by pos), 0) + tangent), 6) as minimum from t""")
def curve_room(spark, sf_dir):
    return sequences.curve_room(A.legs(spark, sf_dir)).select("line_id", "pos", F.round("minimum", 6).alias("minimum"))


@query(f"""with l as ({LEGS}), c as (select line_id, pos, case when turn <> 0 or row_number() over (partition by line_id order by pos) = 1 then len end as v from l)
    select line_id, pos, last_value(v ignore nulls) over (partition by line_id order by pos) as lane from c""")
def lane_deferral(spark, sf_dir):
    return sequences.deferred(A.legs(spark, sf_dir), F.col("len"), F.col("turn") != 0).select("line_id", "pos", "lane")


@query(f"""with l as ({LEGS}), b as (select *, radians(cast(((45 + sum(turn) over (partition by line_id order by pos)) % 360 + 360) % 360 as double)) as r from l)
    select line_id, pos, round(sum(sin(r) * len) over (partition by line_id order by pos), 4) + 0 as x, round(sum(cos(r) * len) over (partition by line_id order by pos), 4) + 0 as y from b""")
def walked_legs(spark, sf_dir):
    return sequences.walked(A.legs(spark, sf_dir), 45).select("line_id", "pos", (F.round("x", 4) + 0).alias("x"), (F.round("y", 4) + 0).alias("y"))


ARC_SQL = f"""with p as ({A.POLYLINES_SQL}), d as (select *, coalesce(sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)), 0) as step from p window w as (partition by line_id order by pos)),
    s as (select line_id, pos, x, y, sum(step) over (partition by line_id order by pos) as s from d)"""


@query(f"{ARC_SQL} select line_id, pos, round(s, 2) as s from s")
def arc_length(spark, sf_dir):
    return sequences.arc_length(A.polylines(spark, sf_dir)).select("line_id", "pos", F.round("s", 2).alias("s"))


@query(f"""with p as ({A.POLYLINES_SQL}), n as (select *, count(*) over (partition by line_id) as n, first_value(x) over w as fx, first_value(y) over w as fy,
        last_value(x) over w as lx, last_value(y) over w as ly from p window w as (partition by line_id order by pos rows between unbounded preceding and unbounded following)),
    m as (select *, sum(x) over r as sx, sum(y) over r as sy, greatest(0, 3 - pos) as bm, greatest(0, 2 - (n - pos)) as am from n window r as (partition by line_id order by pos rows between 2 preceding and 2 following))
    select line_id, pos, round(case when n <= 5 or pos = 1 or pos = n then x else (sx + bm * fx + am * lx) / 5.0::double end, 4) as sx,
           round(case when n <= 5 or pos = 1 or pos = n then y else (sy + bm * fy + am * ly) / 5.0::double end, 4) as sy from m""")
def moving_average(spark, sf_dir):
    return sequences.moving_average(A.polylines(spark, sf_dir), 5).select("line_id", "pos", F.round("sx", 4).alias("sx"), F.round("sy", 4).alias("sy"))


@query(f"""{ARC_SQL}, t as (select *, max(s) over (partition by line_id) as total, lead(s) over w as s1, lead(x) over w as x1, lead(y) over w as y1 from s window w as (partition by line_id order by pos)),
    n as (select *, greatest(ceil(total / 500), 1) as n from t where total > 0), g as (select *, total / n as gap from n),
    i as (select *, unnest(range(cast(ceil(s / gap - 1e-9) as bigint), case when s1 >= total then cast(n as bigint) + 1 else cast(ceil(s1 / gap - 1e-9) as bigint) end)) as i from g where s1 > s)
    select line_id, i, round(x + (i * gap - s) / (s1 - s) * (x1 - x), 3) as x, round(y + (i * gap - s) / (s1 - s) * (y1 - y), 3) as y from i""")
def resampled(spark, sf_dir):
    return sequences.resampled(A.polylines(spark, sf_dir), 500.0, keep_still=False).select("line_id", "i", *[G.decimals(F.col(c), 3).alias(c) for c in ("x", "y")])


@query(f"""{ARC_SQL}, t as (select *, lead(s) over w as s1, lead(x) over w as x1, lead(y) over w as y1 from s window w as (partition by line_id order by pos)),
    c as (select line_id, s as k, cast(x as double) as x, cast(y as double) as y from s where s between 1000 and 9000
          union all select line_id, cut, x + (cut - s) / (s1 - s) * (x1 - x), y + (cut - s) / (s1 - s) * (y1 - y) from t, (values (cast(1000 as double)), (cast(9000 as double))) v(cut) where s < cut and s1 > cut)
    select line_id, round(k, 3) as k, round(x, 3) as x, round(y, 3) as y from c""")
def sliced(spark, sf_dir):
    return sequences.sliced(A.polylines(spark, sf_dir), 1000.0, 9000.0).select("line_id", *[F.round(c, 3).alias(c) for c in ("k", "x", "y")])


STEPS_SQL = f"with l as ({LEGS}), s as (select line_id, list(station_id order by pos) as steps from l group by line_id)"


@query(f"""{STEPS_SQL}, f as (select *, list_position(list_transform(range(1, len(steps)), lambda i: steps[i] % 10 = 3 and steps[i + 1] % 2 = 0), true) as place from s)
    select line_id, array_to_string(case when place > 0 then list_concat(list_concat(steps[1:place - 1], [-1, -2, -3]), steps[place + 2:]) else steps end, ',') as steps from f""")
def splice_steps(spark, sf_dir):
    lines = sequences.steps_array(A.legs(spark, sf_dir))
    # what to replace: each line's first pair of a station that ends in 3 and an even one
    here = F.filter(F.when(F.size("steps") > 1, F.sequence(F.lit(1), F.size("steps") - 1)).otherwise(F.array().cast("array<int>")), lambda i: (F.get("steps", i - 1) % 10 == 3) & (F.get("steps", i) % 2 == 0))
    old = F.when(F.size(here) > 0, F.slice("steps", F.get(here, 0), 2)).otherwise(F.array(F.lit(-9).cast("long"), F.lit(-9).cast("long")))
    new = F.array(*[F.lit(k).cast("long") for k in (-1, -2, -3)])
    return sequences.spliced(lines.withColumn("old", old), F.col("old"), new, strict=False).select("line_id", joined("steps"))


@query(f"""with l as ({LEGS}) select line_id, count(*) over (partition by line_id) + 1 - pos as pos, station_id, -turn as turn from l""")
def reverse_steps(spark, sf_dir):
    return sequences.reversed_legs(A.legs(spark, sf_dir)).select("line_id", *big("pos"), "station_id", "turn")


@query(f"""{STEPS_SQL}, f as (select line_id, steps, list_position(steps, list_min(steps)) as a, list_position(steps, list_max(steps)) as b from s)
    select line_id, case when b >= a then array_to_string(steps[a:b], ',') else '' end as steps from f""")
def slice_steps(spark, sf_dir):
    lines = sequences.steps_array(A.legs(spark, sf_dir))
    return sequences.between(lines, F.array_min("steps"), F.array_max("steps")).select("line_id", joined("steps"))


@query(f"""{STEPS_SQL}, f as (select line_id, steps, list_position(steps, list_max(steps)) as a from s)
    select line_id, array_to_string(list_concat(list_concat(steps[1:a], [-7]), steps[a + 1:]), ',') as steps from f""")
def insert_after(spark, sf_dir):
    lines = sequences.steps_array(A.legs(spark, sf_dir))
    return sequences.inserted(lines, F.array_max("steps"), F.array(F.lit(-7).cast("long"))).select("line_id", joined("steps"))


@query(f"""with p as ({A.POINTS_SQL}) select id, case when row_number() over (partition by round(y, 6) order by x, id) % 2 = 1 then 'top' else 'bottom' end as side from p""")
def alternating_labels(spark, sf_dir):
    return sequences.alternating(A.points(spark, sf_dir)).select("id", "side")


# ---- legend


BLOCKS_SQL = f"""with g as ({A.GROUPS_SQL}), k as (select *, cast(line_id % 10 as varchar) || '.' || cast(line_id as varchar) as key, line_id % 7 as col from g),
    m as (select *, case when grp is not distinct from lag(grp) over w and row_number() over w > 1 then 0 else 1 end as new from k window w as (partition by col order by key)),
    b as (select *, sum(new) over (partition by col order by key) as block from m)"""


def _blocks(spark, sf_dir):
    key = F.concat((F.col("line_id") % 10).cast("string"), F.lit("."), F.col("line_id").cast("string"))
    rows = A.groups(spark, sf_dir).withColumn("key", key).withColumn("col", F.col("line_id") % 7)
    return sequences.islands(rows, ["col"], "key", F.col("grp"), "block")


@query(f"{BLOCKS_SQL} select col, cast(block as bigint) as block, min(grp) as grp, string_agg(line_id, ',' order by key) as lines from b group by col, block")
def legend_blocks(spark, sf_dir):
    by = _blocks(spark, sf_dir).groupBy("col", F.col("block").cast("long").alias("block"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("key", "line_id"))), lambda x: x["line_id"])
    return by.agg(F.min("grp").alias("grp"), F.array_join(ordered, ",").alias("lines"))


@query(f"""{BLOCKS_SQL}, h as (select col, block, greatest(18 + (sum(n) - 1) * 14, count(*) * 18) as height from b group by col, block)
    select col, cast(block as bigint) as block, cast(height as bigint) as height, cast(coalesce(sum(height) over (partition by col order by block rows between unbounded preceding and 1 preceding), 0) as bigint) as top from h""")
def legend_layout(spark, sf_dir):
    h = _blocks(spark, sf_dir).groupBy("col", "block").agg(F.greatest(18 + (F.sum("n") - 1) * 14, F.count("*") * 18).alias("height"))
    return sequences.running_boxes(h, ["col"], ["block"], F.col("height")).select("col", *big("block", "height"), F.col("offset").cast("long").alias("top"))


@query(f"""with n as ({A.NAMES_SQL}), w as (select src, id, id % 50 as row, length(case when length(name) > 1 then name || ' ' else name end) * cast(4 as double) + 6 as width from n)
    select src, id, row, width, coalesce(sum(width + 2) over (partition by src, row order by id rows between unbounded preceding and 1 preceding), 0) as "offset" from w""")
def badge_rows(spark, sf_dir):
    rows = A.names(spark, sf_dir).select("src", "id", (F.col("id") % 50).alias("row"), X.badge_width(F.col("name"), 8.0, 3.0).alias("width"))
    return sequences.running_boxes(rows, ["src", "row"], ["id"], F.col("width"), 2.0)


@query(f"with g as ({A.GROUPS_SQL}) select grp, count(*) as n_lines, arg_max(n, line_id) as last_n, max(n) as most from g group by grp")
def elastic_report(spark, sf_dir):
    return A.groups(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n_lines"), F.max_by("n", "line_id").alias("last_n"), F.max("n").alias("most"))


# ---- versions


PARENT_SQL, DELTA_SQL = A.PARENT_SQL, A.DELTA_SQL


@query(f"""with p as ({PARENT_SQL}), d as ({DELTA_SQL}) select coalesce(d.key, p.key) as key, case when d.key is not null then d.value else p.value end as value
    from p full join d on p.key = d.key where not coalesce(d.tombstone, false)""")
def derive_merge(spark, sf_dir):
    return overlay.merged(*A.overlay(spark, sf_dir), ["key"], check=True)


@query(f"""with p as ({PARENT_SQL}), d as ({DELTA_SQL}) select distinct key from (select key from p union select key from d where not tombstone) where key not in (select key from d where tombstone)""")
def derive_set(spark, sf_dir):
    parent, delta = A.overlay(spark, sf_dir)
    return overlay.merged_set(parent.select("key"), delta.select("key", "tombstone"))


@query(f"""with p as ({PARENT_SQL}), d as ({DELTA_SQL}), c as (select key, value, false as tombstone, 0 as version from p union all select key, value, tombstone, 1 from d
        union all select key, value * 2, key % 5 = 0, 2 from p),
    l as (select key, arg_max(value, version) as value, arg_max(tombstone, version) as gone from c group by key) select key, round(value, 2) as value from l where not gone""")
def derive_chain(spark, sf_dir):
    parent, delta = A.overlay(spark, sf_dir)
    third = parent.select("key", (F.col("value") * 2).alias("value"), (F.col("key") % 5 == 0).alias("tombstone"), F.lit(2).alias("version"))
    every = parent.withColumn("tombstone", F.lit(False)).withColumn("version", F.lit(0)).unionByName(delta.withColumn("version", F.lit(1))).unionByName(third)
    return overlay.chained(every, ["key"], "version").select("key", F.round("value", 2).alias("value"))


# ---- points and boxes


PX = f"""with p as ({A.POINTS_SQL}), r as (select id, radians(lat) as phi, radians(lon - 13.45455::double) as lam from p),
    k as (select *, 6378137.0::double / sqrt(1 - e2 * sin(phi) * sin(phi)) as n, tan(phi) * tan(phi) as t, ep2 * cos(phi) * cos(phi) as c, lam * cos(phi) as a
          from r, (select f * (2 - f) as e2, f * (2 - f) / (1 - f * (2 - f)) as ep2 from (select 1 / 298.257222101::double as f)) q)"""
ARC = """6378137.0::double * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 * e2 * e2 / 256) * {p} - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * e2 * e2 * e2 / 1024) * sin(2 * {p})
    + (15 * e2 * e2 / 256 + 45 * e2 * e2 * e2 / 1024) * sin(4 * {p}) - 35 * e2 * e2 * e2 / 3072 * sin(6 * {p}))"""


@query(f"""{PX} select id, round(n * (a + (1 - t + c) * a * a * a / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * power(a, 5) / 120), 4) + 0 as east,
    round({ARC.format(p='phi')} - {ARC.format(p='radians(52.52542::double)')} + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * power(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * power(a, 6) / 720), 4) + 0 as north from k""")
def project_points(spark, sf_dir):
    east, north = G.transverse_mercator(F.col("lon"), F.col("lat"))
    return A.points(spark, sf_dir).select("id", (F.round(east, 4) + 0).alias("east"), (F.round(north, 4) + 0).alias("north"))


@query(f"with p as ({A.POLYLINES_SQL}) select line_id, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from p group by line_id")
def polyline_bbox(spark, sf_dir):
    return A.polylines(spark, sf_dir).groupBy("line_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


@query(f"""with p as ({A.POLYLINES_SQL}), b as (select line_id, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from p group by line_id)
    select line_id from b where x1 >= -50 and y1 >= -50 and x0 <= 1050 and y0 <= 150""")
def viewport_filter(spark, sf_dir):
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return polyline_bbox(spark, sf_dir).where(G.in_viewport(box, 1000.0, 100.0, 50.0)).select("line_id")


@query(f"with p as ({A.POINTS_SQL}) select cast(floor(min(x) - 8) as bigint) as x0, cast(floor(min(y) - 8) as bigint) as y0, cast(ceil(max(x) + 8) as bigint) as x1, cast(ceil(max(y) + 8) as bigint) as y1 from p")
def content_bounds(spark, sf_dir):
    low, high = lambda c: F.floor(F.min(c) - 8).cast("long"), lambda c: F.ceil(F.max(c) + 8).cast("long")
    return A.points(spark, sf_dir).agg(low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))


@query(f"""with p as ({A.POLYLINES_SQL}), n as (select line_id, x, y, coalesce(lead(x) over w, first_value(x) over w) as x1, coalesce(lead(y) over w, first_value(y) over w) as y1 from p window w as (partition by line_id order by pos))
    select line_id, abs(sum(cast(x as double) * y1 - cast(x1 as double) * y)) / 2 as area from n group by line_id""")
def ring_area(spark, sf_dir):
    pts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return A.polylines(spark, sf_dir).groupBy("line_id").agg(pts.alias("pts")).select("line_id", G.ring_area("pts").alias("area"))


def _nodes(spark, sf_dir):
    return A.points(spark, sf_dir).where("id % 2 = 0").select(F.col("id").alias("node"), "x", "y")


def _probes(spark, sf_dir):
    return A.points(spark, sf_dir).where("id % 2 = 1").select("id", "x", "y")


@query(f"""with p as ({A.POINTS_SQL}) select a.id, b.id as node, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d2 from p a, p b
    where a.id % 2 = 1 and b.id % 2 = 0 and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900""")
def near_nodes(spark, sf_dir):
    return spatial.near(_probes(spark, sf_dir), _nodes(spark, sf_dir), 30).select("id", "node", ((F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny"))).alias("d2"))


@query(f"""with p as ({A.POINTS_SQL}), d as (select a.id, b.id as node, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d2 from p a, p b where a.id % 2 = 1 and b.id % 2 = 0)
    select id, node, d2 from d qualify row_number() over (partition by id order by d2, node) = 1""")
def nearest_node(spark, sf_dir):
    return spatial.nearest(_probes(spark, sf_dir), _nodes(spark, sf_dir), 20).select("id", "node", F.round(F.col("d") * F.col("d")).cast("long").alias("d2"))


BOXES_SQL = f"with p as ({A.POINTS_SQL}), b as (select id, x as x0, y as y0, x + 5 + id % 20 as x1, y + 5 + id % 13 as y1 from p)"


def _boxes(spark, sf_dir, points=A.points):
    return points(spark, sf_dir).select("id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 5 + F.col("id") % 20).alias("x1"), (F.col("y") + 5 + F.col("id") % 13).alias("y1"))


@query(f"{BOXES_SQL} select a.id as a, o.id as b from b a join b o on a.id < o.id and a.x0 < o.x1 and o.x0 < a.x1 and a.y0 < o.y1 and o.y0 < a.y1")
def box_overlaps(spark, sf_dir):
    return spatial.overlapping(_boxes(spark, sf_dir), 32)


SEGMENTS_SQL = f"with p as ({A.POINTS_SQL}), s as (select id as seg, id % 5 as family, x as ax, y as ay, x + id % 37 - 18 as zx, y + id % 41 - 20 as zy from p)"


def _segments(spark, sf_dir, points=A.points):
    return points(spark, sf_dir).select(F.col("id").alias("seg"), (F.col("id") % 5).alias("family"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + F.col("id") % 37 - 18).alias("bx"), (F.col("y") + F.col("id") % 41 - 20).alias("by"))


@query(f"""{SEGMENTS_SQL}, q as (select s.seg as a, o.seg as b, s.ax, s.ay, s.zx - s.ax as dx, s.zy - s.ay as dy, o.zx - o.ax as ex, o.zy - o.ay as ey, o.ax - s.ax as qx, o.ay - s.ay as qy
        from s join s o on s.seg < o.seg and s.family <> o.family and abs(s.ax - o.ax) < 80 and abs(s.ay - o.ay) < 80),
    t as (select *, dx * ey - dy * ex as det, qx * ey - qy * ex as t, qx * dy - qy * dx as u from q)
    select a, b, round(ax + t / cast(det as double) * dx, 4) as x, round(ay + t / cast(det as double) * dy, 4) as y from t
    where det <> 0 and t * sign(det) > 0 and t * sign(det) < abs(det) and u * sign(det) > 0 and u * sign(det) < abs(det)""")
def segment_crossings(spark, sf_dir):
    return spatial.crossings(_segments(spark, sf_dir), 40).select("a", "b", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""{SEGMENTS_SQL}, b as (select id as box, x as x0, y as y0, x + 6 as x1, y + 9 as y1 from p),
    c as (select seg, box, ax, ay, zx, zy, x0 - 1 as x0, y0 - 1 as y0, x1 + 1 as x1, y1 + 1 as y1 from s, b where greatest(ax, zx) >= x0 - 1 and least(ax, zx) <= x1 + 1 and greatest(ay, zy) >= y0 - 1 and least(ay, zy) <= y1 + 1),
    k as (select *, (zx - ax) * (y0 - ay) - (zy - ay) * (x0 - ax) as c1, (zx - ax) * (y0 - ay) - (zy - ay) * (x1 - ax) as c2, (zx - ax) * (y1 - ay) - (zy - ay) * (x0 - ax) as c3, (zx - ax) * (y1 - ay) - (zy - ay) * (x1 - ax) as c4 from c)
    select seg, box from k where least(c1, c2, c3, c4) <= 0 and greatest(c1, c2, c3, c4) >= 0""")
def segment_hits_box(spark, sf_dir):
    boxes = A.points(spark, sf_dir).select(F.col("id").alias("box"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 6).alias("x1"), (F.col("y") + 9).alias("y1"))
    return spatial.hits(_segments(spark, sf_dir), boxes, 40, 1)


@query(f"{BOXES_SQL} select b.id as box, count(*) as n from b join p on p.x between x0 and x1 and p.y between y0 and y1 group by b.id")
def points_in_boxes(spark, sf_dir):
    return spatial.points_in_boxes(A.points(spark, sf_dir).select("x", "y"), _boxes(spark, sf_dir).withColumnRenamed("id", "box"), 32)


@query(f"""{SEGMENTS_SQL}, q as (select id, x, y from p where id % 2 = 1), d as (select q.id, seg, x, y, ax, ay, zx - ax as dx, zy - ay as dy from q, s where s.seg % 2 = 0 and abs(q.x - s.ax) < 60 and abs(q.y - s.ay) < 60),
    t as (select *, case when dx = 0 and dy = 0 then 0 else greatest(cast(0 as double), least(cast(1 as double), ((x - ax) * dx + (y - ay) * dy) / cast(dx * dx + dy * dy as double))) end as t from d),
    e as (select *, sqrt(power(x - (ax + t * dx), 2) + power(y - (ay + t * dy), 2)) as d from t) select id, round(min(d), 5) as d from e where d <= 25 group by id""")
def nearest_segment(spark, sf_dir):
    segs = _segments(spark, sf_dir).where("seg % 2 = 0")
    return spatial.nearest_segment(_probes(spark, sf_dir), segs, 25).select("id", F.round("d", 5).alias("d"))


@query(f"""with p as ({A.POINTS_SQL}), t as (select id as node, x, y from p where id % 2 = 0), s as (select id, id // 40 as key, x, y from p where id % 2 = 1), n as (select id, id // 40 as key from p),
    d as (select s.id, s.key, s.x, s.y, min(sqrt(power(s.x - t.x, 2) + power(s.y - t.y, 2))) as d from s, t group by all),
    g as (select n.id, d.* exclude (id), d.id as stop from n join d using (key) where d <= 40), b as (select *, first_value(x) over w as zx, first_value(y) over w as zy from g window w as (partition by id order by d, x, y))
    select id, round(avg(x), 5) as x, round(avg(y), 5) as y, count(*) as n_stops from b where sqrt(power(x - zx, 2) + power(y - zy, 2)) <= 40 group by id""")
def locate_stations(spark, sf_dir):
    p = A.points(spark, sf_dir)
    stops = p.where("id % 2 = 1").select(F.floor(F.col("id") / 40).alias("key"), "x", "y")
    tracks = p.where("id % 2 = 0").select(F.col("id").alias("node"), "x", "y")
    names = p.select("id", F.floor(F.col("id") / 40).alias("key"))
    placed, _ = spatial.located(names, stops, tracks, 40)
    return placed.select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "n_stops")


@query(f"""with p as ({A.POINTS_SQL}), o as (select unnest(range(-3, 4)) as d), c as (select distinct x + a.d as cx, y + b.d as cy from p, o a, o b where a.d * a.d + b.d * b.d <= 9) select cx, cy from c""")
def raster_band(spark, sf_dir):
    return spatial.raster_band(A.points(spark, sf_dir), 3)


@query(f"""with g as ({A.GROUPS_SQL}), q as (select line_id as a, line_id * 7 % 1500 + 1 as b, n as na, line_id % 4 as nb, grp from g)
    select a, b, case when grp = 'BUILDING' then a when na <> nb then case when na > nb then a else b end when (a % 5 = 0) <> (b % 5 = 0) then case when a % 5 = 0 then b else a end when a % 100 >= b % 100 then a else b end as upper from q""")
def crossing_priority(spark, sf_dir):
    q = A.groups(spark, sf_dir).select(F.col("line_id").alias("a"), (F.col("line_id") * 7 % 1500 + 1).alias("b"), "n", "grp")
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    upper = F.when(F.col("grp") == "BUILDING", a).when(n != a % 4, F.when(n > a % 4, a).otherwise(b)).when((a % 5 == 0) != (b % 5 == 0), F.when(a % 5 == 0, b).otherwise(a))
    return q.select("a", "b", upper.when(a % 100 >= b % 100, a).otherwise(b).alias("upper"))


# ---- graphs


LINKS_SQL = f"l as ({A.LINKS_SQL}), e as (select a, b from l union select b, a from l)"


@query(f"with recursive {LINKS_SQL}, r(node, root) as (select a, a from e union select e.b, r.root from r join e on e.a = r.node) select node, min(root) as component from r group by node")
def components(spark, sf_dir):
    return graph.components(A.links(spark, sf_dir))


@query(f"""with recursive {LINKS_SQL}, s as (select distinct a as node from e where a % 50 = 0), r(node, level) as (select node, 0 from s union select e.b, level + 1 from r join e on e.a = r.node where level < 400)
    select node, cast(min(level) as bigint) as level from r group by node""")
def link_levels(spark, sf_dir):
    e = A.links(spark, sf_dir)
    starts = graph.both_ways(e).where("a % 50 = 0").select(F.col("a").alias("node"))
    return graph.levels(e, starts).select("node", *big("level"))


@query(f"""with {LINKS_SQL}, n as ({A.POINTS_SQL}), m as (select e.a as node, avg(x) as nx, avg(y) as ny, count(*) as n from e join n on n.id = e.b group by e.a)
    select n.id as node, round(x + case when m.n >= 2 then 0.5::double * (nx - x) else 0 end, 5) as x, round(y + case when m.n >= 2 then 0.5::double * (ny - y) else 0 end, 5) as y from n left join m on m.node = n.id""")
def graph_smooth_step(spark, sf_dir):
    nodes = A.points(spark, sf_dir).select(F.col("id").alias("node"), "x", "y")
    return graph.smoothed(nodes, A.links(spark, sf_dir), 0.5).select("node", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("""with recursive i as (select s_suppkey as id from supplier), o as (select s_suppkey as upper, s_suppkey // 2 as lower from supplier where s_suppkey > 1),
    r(id, level) as (select id, 0 from i union select o.upper, level + 1 from r join o on o.lower = r.id) select id, cast(max(level) as bigint) as level from r group by id""")
def draw_order(spark, sf_dir):
    ids = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    over = ids.where("id > 1").select(F.col("id").alias("upper"), F.floor(F.col("id") / 2).cast("long").alias("lower"))
    return graph.draw_order(ids, over).select("id", *big("level"))


@query("select c_custkey as id, row_number() over (partition by c_custkey // 250 order by c_custkey) - 1 as level from customer")
def deep_order(spark, sf_dir):
    """Stacks of 250 customers: each lies over the one before it and over the one seven before."""
    ids = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    lower = F.explode(F.array(F.col("id") - 1, F.col("id") - 7))
    over = ids.select(F.col("id").alias("upper"), lower.alias("lower")).where("lower >= 0 and lower div 250 = upper div 250")
    return graph.draw_order(ids, over).select("id", *big("level"))


@query("""with c as (select c_custkey as id, c_custkey // 1000 as chain, c_nationkey % 8 * 45 as delta from customer), s as (select *, row_number() over (partition by chain order by id) = 1 as first from c)
    select id as line_id, cast((case when chain % 3 = 0 then 90 else 45 end + sum(case when first then 0 else delta end) over (partition by chain order by id)) % 360 as bigint) as bearing from s""")
def passed_bearings(spark, sf_dir):
    """Chains of a thousand lines that share an edge with the next one; every third chain has a start, at its first line."""
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("line_id"), (F.col("c_nationkey") % 8 * 45).alias("delta"), F.floor(F.col("c_custkey") / 1000).alias("chain"))
    ids = c.select(F.col("line_id").alias("a"), F.col("chain").alias("same"))
    shared = c.select((F.col("line_id") - 1).alias("a"), F.col("line_id").alias("b"), "delta", "chain").join(ids, "a").where("chain = same").select("a", "b", "delta")
    starts = c.where("chain % 3 = 0").groupBy("chain").agg(F.min("line_id").alias("line_id")).select("line_id", F.lit(90).alias("bearing"))
    return graph.bearings(shared, starts, c.select("line_id", F.col("line_id").alias("line_pos")), 45).select("line_id", *big("bearing"))


@query(f"""with recursive {LINKS_SQL}, r(node, cost) as (select distinct a, 0 from e where a % 50 = 0 union select e.b, r.cost + 1 + (e.a + e.b) % 3 from r join e on e.a = r.node where r.cost < 600)
    select node, cast(min(cost) as bigint) as cost from r group by node""")
def cheapest_ways(spark, sf_dir):
    e = A.links(spark, sf_dir).withColumn("w", 1 + (F.col("a") + F.col("b")) % 3)
    sources = graph.both_ways(e).where("a % 50 = 0").select(F.col("a").alias("node"), F.lit(0).cast("long").alias("cost"))
    return graph.reached(e, sources)


# ---- names and text


def _sql_normalized(n: str) -> str:
    out = f"replace(lower({n}), 'ß', 'ss')"
    for p in (X.PREFIX, X.CITY, X.PLACE):
        out = f"regexp_replace({out}, '{p}', '', 'g')"
    for _ in range(2):
        out = f"regexp_replace({out}, '{X.MAIN}', '\\1{X.MAIN_NAME}\\2', 'g')"
    return f"regexp_replace({out}, '{X.OTHER}', '', 'g')"


@query(f"with n as ({A.NAMES_SQL}) select src, id, {_sql_normalized('name')} as key from n")
def normalize_names(spark, sf_dir):
    return A.names(spark, sf_dir).select("src", "id", X.normalize_name(F.col("name")).alias("key"))


_ADVANCES = ", ".join(f"('{c}', {w}::double)" for c, w in X.ADVANCE.items())


@query(f"""with n as ({A.NAMES_SQL}), a(c, w) as (values {_ADVANCES}), s as (select src, id, unnest(case when name = '' then [''] else string_split(name, '') end) as c from n)
    select src, id, round(sum(case when s.c = '' then 0 else coalesce(w, 0.62::double) end) * 10, 4) as width from s left join a on a.c = s.c group by src, id""")
def text_width(spark, sf_dir):
    return A.names(spark, sf_dir).select("src", "id", F.round(X.text_width(F.col("name"), 10.0), 4).alias("width"))


@query(f"""with n as (select *, replace(name, ' ', chr(10)) as label from ({A.NAMES_SQL})), z as (select src, id, string_split(label, chr(10)) as z from n)
    select src, id, len(z) as n_lines, cast(list_max(list_transform(z, lambda x: length(x))) as bigint) as longest, z[1] as first from z""")
def label_lines(spark, sf_dir):
    z = X.lines(F.replace("name", F.lit(" "), F.lit("\n")))
    return A.names(spark, sf_dir).select("src", "id", F.size(z).cast("long").alias("n_lines"), F.array_max(F.transform(z, F.length)).cast("long").alias("longest"), F.element_at(z, 1).alias("first"))


@query(f"with n as ({A.NAMES_SQL}) select src, id, replace(replace(replace('<' || name || ' & \"x\">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as text from n")
def escape_xml(spark, sf_dir):
    return A.names(spark, sf_dir).select("src", "id", X.escape_xml(F.concat(F.lit("<"), "name", F.lit(' & "x">'))).alias("text"))


@query(f"with n as ({A.NAMES_SQL}) select src, id, case when length(name) > 1 then substr(name, 1, 1) || ' ' || substr(name, 2) else name end as badge from n")
def badge_text(spark, sf_dir):
    return A.names(spark, sf_dir).select("src", "id", X.badge_text(F.col("name")).alias("badge"))


@query(f"""with p as (select line_id, pos, x, y * 3 as y from ({A.POLYLINES_SQL})), d as (select *, x - lag(x) over w as dx, y - lag(y) over w as dy from p window w as (partition by line_id order by pos)),
    k as (select *, row_number() over (partition by line_id order by pos) as k, count(*) over (partition by line_id) as n from d where dx is null or dx <> 0 or dy <> 0),
    f as (select line_id, pos, k, n, case when dx is null then x else dx end as a, case when dx is null then y else dy end as b from k),
    t as (select *, case when a < 0 then '-' else '' end || case when abs(a) % 10 = 0 then cast(abs(a) // 10 as varchar) when abs(a) < 10 then '.' || abs(a) else (abs(a) // 10) || '.' || (abs(a) % 10) end as ta,
        case when b < 0 then '-' else '' end || case when abs(b) % 10 = 0 then cast(abs(b) // 10 as varchar) when abs(b) < 10 then '.' || abs(b) else (abs(b) // 10) || '.' || (abs(b) % 10) end as tb from f)
    select line_id, case when max(n) < 2 then '' else 'M' || max(case when k = 1 then ta || ' ' || tb end) || 'l' || coalesce(string_agg(ta || ' ' || tb, ' ' order by pos) filter (k > 1), '') end as d from t group by line_id""")
def delta_path(spark, sf_dir):
    pts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct((p["x"] / F.lit(10.0)).alias("x"), (p["y"] * 3 / F.lit(10.0)).alias("y")))
    return A.polylines(spark, sf_dir).groupBy("line_id").agg(pts.alias("pts")).select("line_id", X.draw_path(F.col("pts"), False).alias("d"))


@query(f"""with l as ({LEGS}) select station_id, arg_min(line_id, line_id * 100000 + pos) as line_id, min(line_id * 100000 + pos) as place from l group by station_id""")
def dedup_ways(spark, sf_dir):
    """Of equal ways the first in order of elements and members stays."""
    w = Window.partitionBy("station_id").orderBy("line_id", "pos")
    first = A.legs(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r = 1")
    return first.select("station_id", "line_id", (F.col("line_id") * 100000 + F.col("pos")).alias("place"))


@query(f"""with l as ({LEGS}), b as (select line_id, pos, ((45 + sum(turn) over (partition by line_id order by pos)) % 180 + 180) % 90 as axis, station_id from l), w as (select station_id, axis, count(distinct line_id) as weight from b group by station_id, axis)
    select station_id, cast(arg_max(axis, weight * 1000 - axis) as bigint) as heavy, cast(arg_min(axis, weight * 1000 + axis) as bigint) as light, max(weight) as weight from w group by station_id""")
def hub_axes(spark, sf_dir):
    """Axis weights of hubs: lines by bearing modulo 90; the heaviest and the lightest, the smaller axis of equal ones."""
    b = sequences.running_bearing(A.legs(spark, sf_dir), 45).select("station_id", "line_id", F.pmod("bearing", F.lit(90)).cast("long").alias("axis")).distinct()
    w = b.groupBy("station_id", "axis").agg(F.count("*").alias("weight"))
    return w.groupBy("station_id").agg(F.max_by("axis", F.struct("weight", -F.col("axis"))).alias("heavy"), F.min_by("axis", F.struct("weight", "axis")).alias("light"), F.max("weight").alias("weight"))


# ---- bearings, corners and curves


@query(f"with l as ({LEGS}) select line_id, pos, cast(((45 + sum(turn) over (partition by line_id order by pos)) % 360 + 360) % 360 as bigint) as bearing from l")
def bearing_of_legs(spark, sf_dir):
    """Bearings found again from legs' vectors."""
    b = sequences.running_bearing(A.legs(spark, sf_dir), 45)
    rad = F.radians("bearing")
    return b.select("line_id", "pos", G.bearing(F.sin(rad) * F.col("len"), F.cos(rad) * F.col("len")).cast("long").alias("bearing"))


@query(f"""{SEGMENTS_SQL} select seg, case when ax < zx or (ax = zx and ay <= zy) then 1 else -1 end as sign, round(degrees(atan2(cast((zx - ax) * 3 - (zy - ay) * 4 as double), cast((zx - ax) * 4 + (zy - ay) * 3 as double))), 5) + 0 as turn from s""")
def lane_signs(spark, sf_dir):
    s = _segments(spark, sf_dir)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    turn = G.turn_angle(dx, dy, F.lit(4), F.lit(3))
    return s.select("seg", G.canonical_sign(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).cast("long").alias("sign"), (F.round(turn, 5) + 0).alias("turn"))


@query(f"""with l as ({LEGS}), c as (select line_id, pos, turn * 3 as delta, cast(len as double) / 10 as room, cast(pos % 5 - 2 as double) / 10 as o, len % 4 = 0 as forced from l where turn <> 0)
    select line_id, pos, round(greatest(0, case when forced then 0.4::double else least(0.4::double, room / tan(radians(67.5::double))) end - case when delta < 0 then -1 else 1 end * o), 6) as radius,
           round(case when room / 5 >= 1 then 1 else room / 5 * room / 5 * (3 - 2 * room / 5) end, 6) as eased from c""")
def corner_radii(spark, sf_dir):
    c = A.legs(spark, sf_dir).where("turn <> 0").withColumn("delta", F.col("turn") * 3)
    room = F.col("len") / F.lit(10.0)
    radius = G.corner_radius(F.col("delta"), G.curve_radius(F.col("delta")), room, (F.col("pos") % 5 - 2) / F.lit(10.0), F.col("len") % 4 == 0)
    return c.select("line_id", "pos", F.round(radius, 6).alias("radius"), F.round(G.smoothstep(room / 5), 6).alias("eased"))


@query(f"""{SEGMENTS_SQL}, q as (select s.seg, s.ax, s.ay, s.zx - s.ax as dx, s.zy - s.ay as dy, o.ax - s.ax as qx, o.ay - s.ay as qy, o.zx - o.ax as ex, o.zy - o.ay as ey from s join s o on o.seg = s.seg + 1)
    select seg, round(ax + (qx * ey - qy * ex) / cast(dx * ey - dy * ex as double) * dx, 3) + 0 as x, round(ay + (qx * ey - qy * ex) / cast(dx * ey - dy * ex as double) * dy, 3) + 0 as y from q where dx * ey - dy * ex <> 0""")
def line_intersections(spark, sf_dir):
    s = _segments(spark, sf_dir)
    o = s.select((F.col("seg") - 1).alias("seg"), *[F.col(c).alias(f"o{c}") for c in ("ax", "ay", "bx", "by")])
    c = F.col
    x, y = G.intersection(c("ax"), c("ay"), c("bx") - c("ax"), c("by") - c("ay"), c("oax"), c("oay"), c("obx") - c("oax"), c("oby") - c("oay"))
    return s.join(o, "seg").select("seg", (F.round(x, 3) + 0).alias("x"), (F.round(y, 3) + 0).alias("y")).where("x is not null")


@query(f"""{SEGMENTS_SQL}, u as (select *, unnest(range(0, 5)) as i from s), v as (select *, cast(i as double) / 4 as u from u)
    select seg, i, round(ax * (1 + 2 * u) * power(1 - u, 2) + 10 * u * power(1 - u, 2) + zx * u * u * (3 - 2 * u) + 5 * u * u * (u - 1), 5) + 0 as hermite,
           round(ay * power(1 - u, 3) + (ay + 10) * 3 * u * power(1 - u, 2) + (zy - 10) * 3 * u * u * (1 - u) + zy * power(u, 3), 5) + 0 as bezier,
           round(least(400::double, 1.5::double / (1 / cos(radians(cast(seg % 80 + 5 as double)) / 2) - 1)), 4) as widest from v""")
def curves(spark, sf_dir):
    ax, ay, bx, by = (F.col(c).cast("double") for c in ("ax", "ay", "bx", "by"))
    h, b = P.hermite(ax, F.lit(10.0), bx, F.lit(5.0), 5), P.bezier(ay, ay + 10, by - 10, by, 5)
    rows = _segments(spark, sf_dir).select("seg", F.posexplode(F.arrays_zip(F.array(*h).alias("h"), F.array(*b).alias("b"))).alias("i", "z"))
    widest = P.largest_radius(F.radians((F.col("seg") % 80 + 5).cast("double")), 1.5, 400.0)
    return rows.select("seg", *big("i"), (F.round("z.h", 5) + 0).alias("hermite"), (F.round("z.b", 5) + 0).alias("bezier"), F.round(widest, 4).alias("widest"))


# ---- labels and badges


@query(f"""{SEGMENTS_SQL}, d as (select seg, cast(zx - ax as double) as dx, cast(zy - ay as double) as dy from s), u as (select seg, case when dx = 0 and dy = 0 then 1 else dx / sqrt(dx * dx + dy * dy) end as ux, case when dx = 0 and dy = 0 then 0 else dy / sqrt(dx * dx + dy * dy) end as uy from d),
    a as (select seg, ux, uy, case when abs(uy) < 0.35 then 'bottom' when abs(ux) < 0.35 then 'left' when ux * uy < 0 then 'bottom_right' else 'bottom_left' end as auto from u),
    f as (select seg, case when seg % 17 = 0 then 'top_left' when seg % 11 = 0 then 'right' when abs(uy) < 0.35 then case when seg % 2 = 0 then 'top' else 'bottom' end when abs(ux) < 0.35 and seg % 3 = 0 then 'right' else auto end as side from a)
    select seg, side, round(case side when 'right' then 9 when 'left' then -9 when 'top_left' then -9 * sqrt(0.5) when 'bottom_left' then -9 * sqrt(0.5) when 'bottom_right' then 9 * sqrt(0.5) else 0 end, 6) + 0 as dx,
           round(case side when 'top' then -10 when 'bottom' then 16 when 'top_left' then -9 * sqrt(0.5) - 1 when 'bottom_left' then 9 * sqrt(0.5) + 7 when 'bottom_right' then 9 * sqrt(0.5) + 7 else 3 end, 6) as dy,
           case when side in ('top', 'bottom') then 'middle' when side in ('right', 'bottom_right') then 'start' else 'end' end as anchor from f""")
def label_sides(spark, sf_dir):
    seg, dx, dy = F.col("seg"), (F.col("bx") - F.col("ax")).cast("double"), (F.col("by") - F.col("ay")).cast("double")
    n = F.hypot(dx, dy)
    flat, steep = (n == 0) | (F.abs(dy / n) < 0.35), (n > 0) & (F.abs(dx / n) < 0.35)
    side = L.label_side(F.when(seg % 17 == 0, "top_left"), F.when(seg % 11 == 0, "right"), flat, F.when(seg % 2 == 0, "top").otherwise("bottom"), steep, seg % 3 != 0, L.automatic_side(dx, dy))
    ox, oy, anchor = L.label_offset(F.col("side"), 9.0)
    return _segments(spark, sf_dir).select("seg", side.alias("side")).select("seg", "side", (F.round(ox, 6) + 0).alias("dx"), F.round(oy, 6).alias("dy"), anchor.alias("anchor"))


@query(f"""with l as (select distinct station_id, cast(line_id as varchar) as line_id from ({LEGS})), h as (select *, length(line_id) % 2 = 0 as hollow, [cast(station_id * 3 as varchar), cast(station_id * 5 as varchar)] as wanted from l)
    select station_id, line_id, row_number() over (partition by station_id order by hollow, coalesce(nullif(list_position(wanted, line_id), 0), 1000000), line_id) as rank from h""")
def badge_orders(spark, sf_dir):
    l = A.legs(spark, sf_dir).select("station_id", F.col("line_id").cast("string").alias("line_id")).distinct()  # noqa: E741
    rows = l.withColumn("hollow", F.length("line_id") % 2 == 0).withColumn("wanted", F.array((F.col("station_id") * 3).cast("string"), (F.col("station_id") * 5).cast("string")))
    return L.badge_order(rows, "wanted").select("station_id", "line_id", *big("rank"))


@query(f"""with n as ({A.NAMES_SQL}) select src, id, regexp_replace('S' || name, '^S+', '') as key, coalesce(nullif(regexp_replace(name, '[^0-9]', '', 'g'), '')::hugeint % 1000000007, 0)::bigint as number,
    trim(string_split('A ' || name || ' <> B <> ' || name || ' Z', '<>')[1]) as first, trim(string_split('A ' || name || ' <> B <> ' || name || ' Z', '<>')[-1]) as last from n""")
def line_names(spark, sf_dir):
    """Legend keys, family numbers, and ends of routes."""
    route = X.route_ends(F.concat(F.lit("A "), "name", F.lit(" <> B <> "), "name", F.lit(" Z")))
    return A.names(spark, sf_dir).select("src", "id", X.legend_key(F.concat(F.lit("S"), "name")).alias("key"), (X.family_number(F.col("name")) % 1000000007).alias("number"), route["first"].alias("first"), route["last"].alias("last"))


@query(f"""with n as ({A.NAMES_SQL}), a(c, w) as (values {_ADVANCES}), s as (select src, id, unnest(string_split(name, '')) as c, unnest(range(0, length(name))) as k from n where name <> ''),
    r as (select src, id, k, s.c, coalesce(w, 0.62::double) * 10 as w from s left join a on a.c = s.c)
    select src, id, k, c, round(sum(w) over (partition by src, id order by k) - w / 2 - sum(w) over (partition by src, id) / 2, 4) + 0 as middle from r""")
def letters_along(spark, sf_dir):
    """Each letter's middle along a path, around the text's own middle."""
    letters = A.names(spark, sf_dir).select("src", "id", F.posexplode(X.characters(F.col("name"))).alias("k", "c")).withColumn("w", X.text_width(F.col("c"), 10.0))
    boxes = sequences.running_boxes(letters, ["src", "id"], ["k"], F.col("w"))
    total = F.sum("w").over(Window.partitionBy("src", "id"))
    return boxes.select("src", "id", *big("k"), "c", (F.round(F.col("offset") + F.col("w") / 2 - total / 2, 4) + 0).alias("middle"))


@query(f"""with g as ({A.GROUPS_SQL}), e as (select line_id % 40 as map_id, 1 as level, line_id as id, '<path id="' || line_id || '" class="' || replace(grp, '&', '&amp;') || '"/>' as text from g
        union all select line_id % 40, 2, line_id, '<circle r="' || n || '"/>' from g)
    select map_id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 100 80">' || chr(10) || string_agg(text, chr(10) order by level, id) || chr(10) || '</svg>' as svg from e group by map_id""")
def svg_documents(spark, sf_dir):
    g = A.groups(spark, sf_dir).withColumn("map_id", F.col("line_id") % 40)
    path = g.select("map_id", F.lit(1).alias("level"), F.col("line_id").alias("id"), F.concat(F.lit('<path id="'), F.col("line_id").cast("string"), F.lit('" class="'), X.escape_xml(F.col("grp")), F.lit('"/>')).alias("text"))
    dot = g.select("map_id", F.lit(2).alias("level"), F.col("line_id").alias("id"), F.concat(F.lit('<circle r="'), F.col("n").cast("string"), F.lit('"/>')).alias("text"))
    return L.documents(path.unionByName(dot), 100, 80)


@query()
def label_placement(spark, sf_dir):
    """Greedy placement, one map for each square of 250; sequential within a map, so SQL can't express it."""
    p = A.points(spark, sf_dir).withColumn("map_id", F.floor(F.col("x") / 250) * 100 + F.floor(F.col("y") / 250))
    labels = p.select("map_id", "id", F.col("id").alias("first"), "x", "y", (F.col("id") % 30 + 20).alias("w"), F.lit(10).alias("h"))
    return L.placed(labels, p.select("map_id", "x", "y"))


def _off_sql(dx: str, dy: str, cx: str, cy: str) -> str:
    """The distance of (dx, dy) from the chord (cx, cy), both from its start."""
    dx, dy, cx, cy = (f"({t})::double" for t in (dx, dy, cx, cy))
    return f"(case when {cx} = 0 and {cy} = 0 then sqrt({dx} * {dx} + {dy} * {dy}) else abs({dy} * {cx} - {dx} * {cy}) / sqrt({cx} * {cx} + {cy} * {cy}) end)"


OFF_SQL = _off_sql("m.x - a.x", "m.y - a.y", "b.x - a.x", "b.y - a.y")
SIMPLIFIED_SQL = f"""with recursive v as materialized ({A.POLYLINES_SQL}), e as (select line_id, min(pos) as lo, max(pos) as hi from v group by line_id),
    s(line_id, lo, hi) as (select * from e union all
        select line_id, case when k = 0 then lo else far end, case when k = 0 then far else hi end from (
            select s.line_id, s.lo, s.hi, arg_min(m.pos, (-{OFF_SQL}, m.pos)) as far, max({OFF_SQL}) as most
            from s join v a on a.line_id = s.line_id and a.pos = s.lo join v b on b.line_id = s.line_id and b.pos = s.hi join v m on m.line_id = s.line_id and m.pos > s.lo and m.pos < s.hi
            group by s.line_id, s.lo, s.hi), (values (0), (1)) t(k) where most > 500),
    k as (select line_id, lo as pos from s union select line_id, hi from s)"""


@query(f"{SIMPLIFIED_SQL}, c as (select line_id, count(*) as n_kept from k group by line_id) select line_id, n, n_kept from c join (select line_id, count(*) as n from v group by line_id) using (line_id)")
def simplify_polyline(spark, sf_dir):
    """How many vertices of each line stay within a tolerance."""
    n = A.polylines(spark, sf_dir).groupBy("line_id").agg(F.count("*").alias("n"))
    return n.join(simplified_vertices(spark, sf_dir).groupBy("line_id").agg(F.count("*").alias("n_kept")), "line_id")


@query(f"{SIMPLIFIED_SQL} select line_id, pos, x, y from k join v using (line_id, pos)")
def simplified_vertices(spark, sf_dir):
    return sequences.simplified(A.polylines(spark, sf_dir), 500.0)


# ---- tracks and bundles


@query(f"""with l as ({LEGS}), n as (select line_id, station_id % 40 as piece, lag(station_id % 40) over w as p, lead(station_id % 40) over w as n from l window w as (partition by line_id order by pos)),
    g as (select piece, min(least(p, n) * 1000 + greatest(p, n)) = max(least(p, n) * 1000 + greatest(p, n)) as one, count(*) filter (p is null or n is null) as ends from n group by piece) select piece from g where one and ends = 0""")
def through_pieces(spark, sf_dir):
    return T.through_pieces(A.legs(spark, sf_dir).select("line_id", "pos", (F.col("station_id") % 40).alias("piece")))


@query(f"""with l as ({LEGS}), m as (select *, case when turn = lag(turn) over (partition by line_id order by pos) then 0 else 1 end as new from l), r as (select *, sum(new) over (partition by line_id order by pos) as island from m)
    select line_id, pos, cast(sum(len) over (partition by line_id, island) as bigint) as run from r""")
def common_runs(spark, sf_dir):
    return T.common_runs(A.legs(spark, sf_dir), F.col("turn"), F.col("len")).select("line_id", "pos", "run")


@query(f"""{ARC_SQL}, t as (select *, max(s) over (partition by line_id) as total, lead(s) over w as s1, lead(x) over w as x1, lead(y) over w as y1 from s window w as (partition by line_id order by pos)),
    g as (select *, total / 20 as gap from t where total > 0), i as (select *, unnest(range(cast(ceil(s / gap - 1e-9) as bigint), case when s1 >= total then 21 else cast(ceil(s1 / gap - 1e-9) as bigint) end)) as i from g where s1 > s)
    select line_id % 10 as bundle, i, round(avg(x + (i * gap - s) / (s1 - s) * (x1 - x)), 3) as x, round(avg(y + (i * gap - s) / (s1 - s) * (y1 - y)), 3) as y from i group by line_id % 10, i""")
def mean_tracks(spark, sf_dir):
    return T.mean_track(A.polylines(spark, sf_dir), F.col("line_id") % 10, 21).select("bundle", "i", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"""{SEGMENTS_SQL}, d as (select distinct (ax + zx) / cast(2 as double) as mx, (ay + zy) / cast(2 as double) as my, family, seg % 3 as lane from s) select mx, my, string_agg(family || ':' || lane, ',' order by family, lane) as lanes from d group by mx, my""")
def lanes_at_points(spark, sf_dir):
    rows = T.lanes_at_points(_segments(spark, sf_dir).withColumn("lane", F.col("seg") % 3))
    return rows.select("mx", "my", F.array_join(F.transform("lanes", lambda x: F.concat_ws(":", x["family"], x["lane"])), ",").alias("lanes"))


@query(f"with l as ({LEGS}), n as (select line_id, station_id as a, lead(station_id) over (partition by line_id order by pos) as b from l) select a, b, min(line_id) as line_id from n where b is not null group by a, b")
def first_lines(spark, sf_dir):
    return T.first_lines(A.legs(spark, sf_dir))


@query(f"with p as ({A.POINTS_SQL}) select id % 200 as joint, round(avg(x), 6) as x, round(avg(y), 6) as y, (min(x) + max(x)) / cast(2 as double) as middle from p group by id % 200")
def welded_joints(spark, sf_dir):
    p = A.points(spark, sf_dir).withColumn("joint", F.col("id") % 200)
    middle = T.bundle_middle(p.select(F.col("joint").alias("bundle"), F.col("x").alias("lane")))
    return T.welded(p).join(middle.withColumnRenamed("bundle", "joint"), "joint").select("joint", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "middle")


@query(f"""with l as ({LEGS}), j as (select *, lag(len) over w as before, lag(turn) over w = turn as same from l window w as (partition by line_id order by pos))
    select line_id, pos from j where same qualify row_number() over (partition by line_id order by least(before, len) desc, pos) = 1""")
def ring_seams(spark, sf_dir):
    return T.seams(A.legs(spark, sf_dir).select("line_id", "pos", F.col("turn").alias("value"), F.col("len").alias("length")))


@query(SQL["segment_crossings"].replace("select a, b, round", ", k as (select a, b, round").rstrip().replace("\n    , k as", ",\n    k as") + "), c as (select a as seg, b % 5 as family from k union all select b, a % 5 from k) select seg, count(distinct family) as n from c group by seg")
def crossed_families(spark, sf_dir):
    return spatial.crossed(_segments(spark, sf_dir), 40).groupBy("seg").agg(F.count("*").alias("n"))


@query(f"""with p as ({A.POLYLINES_SQL}), h as (select line_id, pos, atan2(cast(y - lag(y, 2) over w as double), cast(x - lag(x, 2) over w as double)) as i, atan2(cast(lead(y, 2) over w - y as double), cast(lead(x, 2) over w - x as double)) as o from p window w as (partition by line_id order by pos)),
    t as (select line_id, pos, ((degrees(o - i) + 180) % 360 + 360) % 360 - 180 as turn from h), n as (select *, coalesce(abs(turn) >= 60, false) as on_ from t),
    m as (select *, case when on_ = lag(on_) over (partition by line_id order by pos) then 0 else 1 end as new from n), r as (select *, sum(new) over (partition by line_id order by pos) as island from m)
    select line_id, pos, round(turn, 4) as turn from r where on_ qualify row_number() over (partition by line_id, island order by round(abs(turn), 6) desc, pos) = 1""")
def strongest_corners(spark, sf_dir):
    return sequences.corners(A.polylines(spark, sf_dir), 2, 60.0).select("line_id", "pos", F.round("turn", 4).alias("turn"))


# ---- layout


@query(f"""with l as ({LEGS}), b as (select *, radians(cast(45 + coalesce(sum(turn) over (partition by line_id order by pos rows between unbounded preceding and 1 preceding), 0) as double)) as r from l),
    v as (select line_id, pos, len * sin(r) + case when turn <> 0 then 0.6::double * sin(r + radians(turn::double)) else 0 end as dx, len * cos(r) + case when turn <> 0 then 0.6::double * cos(r + radians(turn::double)) else 0 end as dy from b)
    select line_id, pos, round(coalesce(sum(dx) over w, 0), 3) + 0 as x, round(coalesce(sum(dy) over w, 0), 3) + 0 as y from v where line_id in (select line_id from v where pos > 1) window w as (partition by line_id order by pos rows between unbounded preceding and 1 preceding)""")
def solve_layout(spark, sf_dir):
    """Every order of two items or more as a network of its own: elastic legs of the wished length, turns behind them.

    Nothing contradicts the wishes, so the least-squares solution is the walk.
    """
    l = graph.kept(A.legs(spark, sf_dir).withColumn("_n", F.count("*").over(Window.partitionBy("line_id"))).where("_n > 1").drop("_n"))  # noqa: E741
    net = F.col("line_id").cast("string")
    lines = l.where("pos = 1").select(net.alias("net_id"), F.lit("L").alias("line_id"), F.lit(0).alias("line_pos"), F.lit("#000").alias("color"), F.lit(45).alias("start"), F.lit(None).cast("struct<x:double,y:double>").alias("anchor"), F.lit(1.2).alias("spacing"), F.lit(None).cast("string").alias("direction"), F.lit(False).alias("closed"), F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("branch_of"))
    path = F.struct(F.col("len").cast("double").alias("length"), F.lit(None).cast("double").alias("minimum"), F.lit(None).cast("double").alias("maximum"), F.lit(True).alias("flexibility"), F.lit(1.0).alias("flex"), F.lit(None).cast("string").alias("group"))
    one = lambda k, kind, station=None, turn=None, path_=None: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("step_kind"), (station if station is not None else F.lit(None)).cast("string").alias("station_id"), (turn if turn is not None else F.lit(None)).cast("int").alias("turn_delta"), F.lit(None).cast("double").alias("turn_radius"), (path_ if path_ is not None else F.lit(None)).cast("struct<length:double,minimum:double,maximum:double,flexibility:boolean,flex:double,`group`:string>").alias("path"))
    three = F.array(one(0, "station", F.col("pos")), one(1, "path", None, None, path), one(2, "turn", None, F.col("turn")))
    steps = l.select(net.alias("net_id"), F.lit("L").alias("line_id"), "pos", "turn", F.explode(three).alias("s")).where("s.k < 2 or turn <> 0")
    steps = steps.select("net_id", "line_id", (F.col("pos") * 3 + F.col("s.k")).cast("int").alias("pos"), "s.step_kind", "s.station_id", "s.turn_delta", "s.turn_radius", "s.path")
    stations = l.select(net.alias("net_id"), F.col("pos").cast("string").alias("id"), F.lit("station").alias("kind"))
    xy = schematic.layout(stations, lines, steps)["coordinates"]
    return xy.select(F.col("net_id").cast("long").alias("line_id"), F.col("station").cast("long").alias("pos"), (F.round("x", 3) + 0).alias("x"), (F.round("y", 3) + 0).alias("y"))


# ---- routing


@query(f"""with {LINKS_SQL}, p as (select p_partkey as a from part), k as (select a.a as route, a.a as n0, l1.b as n1, l2.b as n2, l3.b as n3 from p a join l l1 on l1.a = a.a join l l2 on l2.a = l1.b join l l3 on l3.a = l2.b)
    select route, cast((n0 % 4) + 1 + (n0 + n1) % 3 + 1 + (n1 + n2) % 3 + 1 + (n2 + n3) % 3 as double) as cost, n0 || ',' || n1 || ',' || n2 || ',' || n3 as path from k""")
def route_paths(spark, sf_dir):
    """From every part to the part three links on."""
    e = A.links(spark, sf_dir).withColumn("w", 1 + (F.col("a") + F.col("b")) % 3)
    p = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("route"))
    sources = p.select("route", F.col("route").alias("node"), (F.col("route") % 4).alias("cost"))
    targets = p.select("route", (F.col("route") + 39).alias("node"), F.lit(0).cast("long").alias("cost"))
    return graph.routes(e, sources, targets).select("route", "cost", joined("path"))


# ---- hubs, rays, layers


@query(f"""with l as ({LEGS}), b as (select line_id, pos, station_id, ((45 + sum(turn) over (partition by line_id order by pos)) % 180 + 180) % 90 as axis from l), w as (select station_id, axis, count(distinct line_id) as weight from b group by station_id, axis),
    h as (select station_id, arg_max(axis, weight * 1000 - axis) as axis from w group by station_id), p as (select station_id, line_id % 97 as x, pos * 3 as y from l), t as (select station_id, x * sin(radians(axis::double)) + y * cos(radians(axis::double)) as u, x * cos(radians(axis::double)) - y * sin(radians(axis::double)) as v from p join h using (station_id))
    select station_id, round(max(u) - min(u), 5) as length, round(max(v) - min(v), 5) as breadth from t group by station_id""")
def hub_extents(spark, sf_dir):
    axes = hub_axes(spark, sf_dir).select("station_id", F.col("heavy").alias("axis"))
    points = A.legs(spark, sf_dir).select("station_id", (F.col("line_id") % 97).alias("x"), (F.col("pos") * 3).alias("y"))
    return T.hub_extents(points, axes).select("station_id", F.round("length", 5).alias("length"), F.round("breadth", 5).alias("breadth"))


@query(f"""{SEGMENTS_SQL}, r as (select id as ray, x as ax, y as ay, x + id % 83 - 41 as zx, y + id % 61 - 30 as zy from p),
    q as (select ray, seg, r.zx - r.ax as dx, r.zy - r.ay as dy, s.ax - r.ax as qx, s.ay - r.ay as qy, s.zx - s.ax as ex, s.zy - s.ay as ey from r join s on abs(r.ax - s.ax) < 80 and abs(r.ay - s.ay) < 80),
    d as (select *, dx * ey - dy * ex as det from q), t as (select ray, seg, (qx * ey - qy * ex) / cast(det as double) as t, (qx * dy - qy * dx) / cast(det as double) as u from d where det <> 0)
    select ray, round(min(t), 6) as t from t where t > 0 and t <= 1 and u between 0 and 1 group by ray""")
def first_crossings(spark, sf_dir):
    p = A.points(spark, sf_dir)
    rays = p.select(F.col("id").alias("ray"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + F.col("id") % 83 - 41).alias("bx"), (F.col("y") + F.col("id") % 61 - 30).alias("by"))
    return spatial.first_on_rays(rays, _segments(spark, sf_dir).drop("family"), 40).select("ray", F.round("t", 6).alias("t"))


@query(f"with p as ({A.POINTS_SQL}) select min(id) as id, x // 30 as x, y // 30 as y from p group by x // 30, y // 30")
def drawn_dots(spark, sf_dir):
    dots = A.points(spark, sf_dir).select("id", (F.floor(F.col("x") / 30) / F.lit(10.0)).alias("x"), (F.floor(F.col("y") / 30) / F.lit(10.0)).alias("y"))
    return T.once_at_each_place(dots).select("id", F.rint(F.col("x") * 10).cast("long").alias("x"), F.rint(F.col("y") * 10).cast("long").alias("y"))


@query(f"""with g as (select line_id as a, line_id * 7 % 1500 + 1 as b, grp as fa from ({A.GROUPS_SQL})), n as (select fa, rank() over (order by count(*) desc, fa) as rank from g group by fa)
    select a, b, rank, layer, kind from g join n using (fa), (values (cast(0 as bigint), 'white'), (1, 'colour')) v(layer, kind)""")
def casing_layers(spark, sf_dir):
    g = A.groups(spark, sf_dir).select(F.col("line_id").alias("a"), (F.col("line_id") * 7 % 1500 + 1).alias("b"), F.col("grp").alias("fa"))
    return T.casing_layers(g).select("a", "b", *big("rank", "layer"), "kind")


@query(f"""with l as ({LEGS}), s as (select line_id, pos, turn, len, sum(len) over (partition by line_id order by pos) as s from l), b as (select *, sign(turn) as sense from s where abs(turn) >= 2 * len),
    n as (select *, case when coalesce(sense <> lag(sense) over w or s - lag(s) over w > 40, true) then 1 else 0 end as new from b window w as (partition by line_id order by pos)),
    r as (select *, sum(new) over (partition by line_id order by pos) as run from n)
    select line_id, cast(run as bigint) as run, cast(min(s) as bigint) as start, cast(max(s) as bigint) as stop, cast(sum(turn) as bigint) as turn from r group by line_id, run having abs(sum(turn)) >= 45""")
def curve_runs(spark, sf_dir):
    l = A.legs(spark, sf_dir).withColumn("s", F.sum("len").over(sequences.so_far()))  # noqa: E741
    points = l.where("turn <> 0").select("line_id", "pos", "s", F.col("turn").alias("bend"), F.col("len").alias("reach"))
    return sequences.curve_runs(points, 2.0, 45.0, 40.0).select("line_id", *big("run", "start", "stop", "turn"))


@query(f"""{STEPS_SQL} select line_id, len(steps) + 3 as n, list_min(steps) as low, list_contains(list_transform(range(1, len(steps)), lambda i: steps[i] % 50 = 7 and steps[i + 1] % 2 = 1), true) as has from s""")
def extended_lines(spark, sf_dir):
    lines = sequences.steps_array(A.legs(spark, sf_dir))
    at = F.filter(F.when(F.size("steps") > 1, F.sequence(F.lit(1), F.size("steps") - 1)).otherwise(F.array().cast("array<int>")), lambda i: (F.get("steps", i - 1) % 50 == 7) & (F.get("steps", i) % 2 == 1))
    pattern = F.when(F.size(at) > 0, F.slice("steps", F.get(at, 0), 2)).otherwise(F.array(F.lit(-9).cast("long")))
    found = lines.withColumn("pattern", pattern).withColumn("has", sequences.contains("steps", F.col("pattern"))).withColumn("low", F.array_min("steps"))
    one = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    return sequences.extended(found, one(-1), one(-2, -3)).select("line_id", F.size("steps").cast("long").alias("n"), "low", "has")


from linework.plans import bundling, courses, drawings, legends, lettering, networks, sites, stations, versions, pieces  # noqa: E402, F401  their queries register themselves here
