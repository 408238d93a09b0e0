"""Star-schema tables seen as network definitions, so that every operator has data of any size.

legs: an order is a line, its suppliers are stations, quantity is a leg's length, the return flag a turn behind it.
points: parts on an integer grid, with degrees. sites, visitors: parts and customers on ground that grows with them. polylines: a user's events. overlay: suppliers changed by customers.
groups: customers' segments as group lists. names: all names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one task orders.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by the key over so many tasks that a task has about TASK_ROWS of them however large the table is; a fixed number of
    partitions would have each task grow with the table, and Spark puts small ones together by their compressed size."""
    return rows.repartition(max(rows.count() // TASK_ROWS + 1, rows.sparkSession.sparkContext.defaultParallelism), key)


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, pos, station_id, len, turn."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_extendedprice"]
    items = dealt(table(spark, sf_dir, "lineitem").select(*columns), "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_extendedprice")
    turn = F.when(F.col("l_returnflag") == "A", -45).when(F.col("l_returnflag") == "R", 45).otherwise(0)
    return items.select(F.col("l_orderkey").alias("line_id"), F.row_number().over(order).cast("long").alias("pos"), F.col("l_suppkey").alias("station_id"), F.col("l_quantity").cast("long").alias("len"), turn.cast("long").alias("turn"))


LEGS_SQL = """select l_orderkey as line_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_extendedprice) as pos,
    l_suppkey as station_id, cast(l_quantity as bigint) as len, cast(case l_returnflag when 'A' then -45 when 'R' then 45 else 0 end as bigint) as turn from lineitem"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y (whole numbers), lon, lat."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") * 7919) % 1009).alias("x"), ((F.col("p_partkey") * 104729) % 1013).alias("y"))
    return p.select("id", "x", "y", (F.lit(13.45455) + (F.col("x") - 504) / F.lit(2000.0)).alias("lon"), (F.lit(52.52542) + (F.col("y") - 506) / F.lit(3000.0)).alias("lat"))


POINTS_SQL = """select p_partkey as id, (p_partkey * 7919) % 1009 as x, (p_partkey * 104729) % 1013 as y,
    cast(13.45455 as double) + ((p_partkey * 7919) % 1009 - 504) / cast(2000 as double) as lon,
    cast(52.52542 as double) + ((p_partkey * 104729) % 1013 - 506) / cast(3000 as double) as lat from part"""


def _spread(key: str, step: int) -> tuple[Column, Column]:
    """Whole coordinates of a key from 0: keys fill the diagonals of a quadrant one after the other, each with a square of `step` for
    itself, so that the ground grows with the table and its density doesn't."""
    k = F.col(key)
    diagonal = F.floor((F.sqrt((8 * k + 1).cast("double")) - 1) / 2).cast("long")
    along = k - (diagonal * (diagonal + 1) / 2).cast("long")
    return (diagonal - along) * step + (k * 7919) % 13, along * step + (k * 104729) % 11


def _spread_sql(table_: str, key: str, step: int) -> str:
    d = f"cast(floor((sqrt(cast(8 * {key} + 1 as double)) - 1) / 2) as bigint)"
    return f"""select id, (d - (id - d * (d + 1) // 2)) * {step} + (id * 7919) % 13 as x, (id - d * (d + 1) // 2) * {step} + (id * 104729) % 11 as y
    from (select {key} as id, {d} as d from {table_})"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y: parts, one for each square of 16."""
    x, y = _spread("id", 16)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id")).select("id", x.alias("x"), y.alias("y"))


SITES_SQL = _spread_sql("part", "p_partkey", 16)


def visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y: customers, one for each square of 23; many are beyond the sites' ground."""
    x, y = _spread("id", 23)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id")).select("id", x.alias("x"), y.alias("y"))


VISITORS_SQL = _spread_sql("customer", "c_custkey", 23)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, pos, x, y: suppliers as two straight parts of whole length, one track for each square of 70."""
    x, y = _spread("id", 70)
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id")).select("id", x.cast("double").alias("x"), y.cast("double").alias("y"))
    spot = lambda *xy: F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in xy])
    kind = F.col("id") % 4
    way = F.when(kind == 0, spot((0, 0), (130, 0), (130, 110))).when(kind == 1, spot((0, 0), (60, 80), (180, 80))).when(kind == 2, spot((0, 0), (-130, 0), (-130, 110))).otherwise(spot((0, 0), (0, 120), (-110, 120)))
    return own.select(F.col("id").alias("line_id"), "x", "y", F.posexplode(way).alias("pos", "p")).select("line_id", F.col("pos").cast("long").alias("pos"), (F.col("x") + F.col("p.x")).alias("x"), (F.col("y") + F.col("p.y")).alias("y"))


TRACKS_SQL = _spread_sql("supplier", "s_suppkey", 70)


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, pos, x, y: whole numbers."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = dealt(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id")
    return events.select(F.col("user_id").alias("line_id"), F.row_number().over(order).cast("long").alias("pos"), F.round(F.col("value") * 100).cast("long").alias("x"), F.col("event_id").alias("y"))


POLYLINES_SQL = "select user_id as line_id, row_number() over (partition by user_id order by ts, event_id) as pos, cast(round(value * 100) as bigint) as x, event_id as y from events"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a, b: every part and the one 13 further on, but where a rule on the part breaks the chain: many components."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"))
    joined = p.where((F.col("a") * 7919) % 11 != 0).select("a", (F.col("a") + 13).alias("b"))
    return joined.join(p.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")


LINKS_SQL = "select p_partkey as a, p_partkey + 13 as b from part where (p_partkey * 7919) % 11 <> 0 and p_partkey + 13 in (select p_partkey from part)"


def overlay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(parent, delta): key, value, and in the delta a tombstone; every tombstone's key is in the parent.

    Suppliers are the parent; customers change and add, and every seventh removes.
    """
    parent = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value"))
    delta = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"), (F.col("c_custkey") % 7 == 0).alias("tombstone"))
    here = parent.select("key", F.lit(True).alias("_here"))
    return parent, delta.join(here, "key", "left").where("not tombstone or _here").drop("_here")


PARENT_SQL = "select s_suppkey as key, s_acctbal as value from supplier"
DELTA_SQL = "select c_custkey as key, c_acctbal as value, c_custkey % 7 = 0 as tombstone from customer where c_custkey % 7 <> 0 or c_custkey in (select s_suppkey from supplier)"


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, grp, n."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("line_id"), F.col("c_mktsegment").alias("grp"), (F.col("c_nationkey") % 3 + 1).cast("long").alias("n"))


GROUPS_SQL = "select c_custkey as line_id, c_mktsegment as grp, cast(c_nationkey % 3 + 1 as bigint) as n from customer"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, id, name."""
    parts = [("p", "part", "p_partkey", "p_name"), ("s", "supplier", "s_suppkey", "s_name"), ("n", "nation", "n_nationkey", "n_name")]
    out = None
    for src, name, key, text in parts:
        own = table(spark, sf_dir, name).select(F.lit(src).alias("src"), F.col(key).cast("long").alias("id"), F.col(text).alias("name"))
        out = own if out is None else out.unionByName(own)
    return out


NAMES_SQL = "select 'p' as src, cast(p_partkey as bigint) as id, p_name as name from part union all select 's', s_suppkey, s_name from supplier union all select 'n', n_nationkey, n_name from nation"
