"""Queries of networks that derive from others, in all their fields; registered beside those of linework.plans.registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from linework.operators import overlay
from linework.plans.registry import big, query
from linework.sources import adapters as A

NAMES = list(overlay.FIELDS)
# A base of 300 customers has stages 0 .. 3, each deriving from the one before, and a fourth that derives from the first.
ENTRIES_SQL = f"""f as (select {NAMES} as names),
    c as (select c_custkey // 300 as base, c_custkey // 7 % 4 as stage, names[c_custkey % 15 + 1] as field, case when c_custkey % 15 = 14 then '' else 'k' || c_custkey * 7 % 11 end as key, c_name as value, c_custkey as place, c_nationkey % 2 = 0 as odd from customer, f),
    d as (select base, stage, field, key, value, place, odd from c qualify row_number() over (partition by base, stage, field, key order by place) = 1),
    p as (select base, unnest(range(11)) as i from (select distinct c_custkey // 300 as base from customer)),
    e as (select base, stage, field, key, value, place, stage = 3 and odd and (base, field, key) in (select base, field, key from d where stage = 0) and field not in ('groups', 'colors', 'legend_at') as tombstone from d where field <> 'colors' or stage > 0
        union all select base, 0, 'colors', 'k' || i, '#' || i, i, false from p)"""


@query(f"""with {ENTRIES_SQL}, n(stage, source, depth) as (values (0, 0, 0), (1, 0, 0), (1, 1, 1), (2, 0, 0), (2, 1, 1), (2, 2, 2), (3, 0, 0), (3, 1, 1), (3, 2, 2), (3, 3, 3), (4, 0, 0), (4, 1, 1)),
    r as (select base, n.stage, field, key, value, place, tombstone, depth, max(depth) over (partition by base, n.stage, field) as latest from e join n on n.source = e.stage),
    l as (select base, stage, field, key, arg_max(value, depth) as value, arg_max(tombstone, depth) as gone, min((depth, place)) as given from r where field <> 'groups' or depth = latest group by base, stage, field, key),
    k as (select * from l where not gone and (field <> 'groups' or (base, stage, key) in (select base, stage, key from l where field = 'lines' and not gone)))
    select base * 5 + stage as net, field, key, value, row_number() over (partition by base, stage, field order by given, key) as place from k""")
def derived_networks(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer")
    base, key = F.floor(F.col("c_custkey") / 300), F.col("c_custkey")
    field = F.get(F.array(*map(F.lit, NAMES)), (key % 15).cast("int"))
    name = F.when(key % 15 == 14, "").otherwise(F.concat(F.lit("k"), (key * 7 % 11).cast("string")))
    rows = c.select(base.alias("base"), (F.floor(key / 7) % 4).alias("stage"), field.alias("field"), name.alias("key"), F.struct(key.alias("place"), F.col("c_name").alias("value"), (F.col("c_nationkey") % 2 == 0).alias("odd")).alias("v"))
    rows = rows.groupBy("base", "stage", "field", "key").agg(F.min("v").alias("v"))
    first = rows.where("stage = 0").select("base", "field", "key", F.lit(True).alias("there"))
    gone = (F.col("stage") == 3) & F.col("v.odd") & F.col("there").isNotNull() & ~F.col("field").isin("groups", "colors", "legend_at")
    said = rows.where("field <> 'colors' or stage > 0").join(first, ["base", "field", "key"], "left").select("base", "stage", "field", "key", "v.value", "v.place", gone.alias("tombstone"))
    i = F.col("i").cast("string")
    colors = rows.select("base").distinct().withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long")))).select("base", F.lit(0).cast("long").alias("stage"), F.lit("colors").alias("field"), F.concat(F.lit("k"), i).alias("key"), F.concat(F.lit("#"), i).alias("value"), F.col("i").alias("place"), F.lit(False).alias("tombstone"))
    net = lambda s: F.col("base") * 5 + s
    entries = said.unionByName(colors).withColumn("net_id", net(F.col("stage"))).drop("base", "stage")
    stage = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(p).cast("int").alias("p")) for s, p in ((0, None), (1, 0), (2, 1), (3, 2), (4, 1))]))
    versions = rows.select("base").distinct().withColumn("v", stage).select(net(F.col("v.s")).alias("net_id"), net(F.col("v.p")).alias("parent_id"))
    return overlay.derived_fields(versions, entries).select(F.col("net_id").alias("net"), "field", "key", "value", *big("place"))
