"""Edges between stations: shared corridors, line ends, branches, lanes and lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.operators.sequences import pairs, running_bearing


def undirected(legs: DataFrame) -> DataFrame:
    """Adds u <= v of the consecutive stations a, b; legs within one station are left out."""
    return pairs(legs).where("a <> b").withColumn("u", F.least("a", "b")).withColumn("v", F.greatest("a", "b"))


def edge_lines(legs: DataFrame) -> DataFrame:
    """u, v, lines: each edge's distinct lines in order. Repeats go before lines are gathered."""
    single = undirected(legs).select("u", "v", "line_id").distinct()
    return single.groupBy("u", "v").agg(F.array_sort(F.collect_list("line_id")).alias("lines"))


def shared(legs: DataFrame) -> DataFrame:
    """u, v, n_lines of the edges that several lines use. Only counts travel."""
    single = undirected(legs).select("u", "v", "line_id").distinct()
    return single.groupBy("u", "v").agg(F.count("*").alias("n_lines")).where("n_lines > 1")


def report(legs: DataFrame) -> DataFrame:
    """One row: lines, stations and edges."""
    e = undirected(legs).select("u", "v").distinct().agg(F.count("*").alias("n_edges"))
    return legs.agg(F.countDistinct("line_id").alias("n_lines"), F.countDistinct("station_id").alias("n_stations")).crossJoin(F.broadcast(e))


def line_ends(legs: DataFrame) -> DataFrame:
    """line_id, first, last."""
    return legs.groupBy("line_id").agg(F.min_by("station_id", "pos").alias("first"), F.max_by("station_id", "pos").alias("last"))


def end_lists(legs: DataFrame) -> DataFrame:
    """station_id, lines: the lines that end at each station."""
    ends = line_ends(legs)
    flat = ends.select("line_id", F.explode(F.array("first", "last")).alias("station_id")).distinct()
    return flat.groupBy("station_id").agg(F.array_sort(F.collect_list("line_id")).alias("lines"))


def inner_ends(legs: DataFrame, routes: DataFrame) -> DataFrame:
    """Ends of routes (line_id, station_id) that lie on their line but aren't its ends."""
    on = routes.join(legs.select("line_id", "station_id").distinct(), ["line_id", "station_id"], "left_semi")
    ends = line_ends(legs).select("line_id", F.explode(F.array("first", "last")).alias("station_id"))
    return on.join(ends, ["line_id", "station_id"], "left_anti").distinct()


def free_ends(ends: DataFrame, branch: DataFrame) -> DataFrame:
    """line_id, shown, station_id: where lines (line_id, first, last) really end: rings nowhere, branches (branch: line_id, trunk_id,
    joins) at the end where they don't join their trunk, under whose name they are shown."""
    both = ends.where("first <> last").join(branch.select("line_id", "trunk_id", "joins"), "line_id", "left")
    flat = both.select("line_id", F.coalesce("trunk_id", "line_id").alias("shown"), "joins", F.explode(F.array("first", "last")).alias("station_id"))
    return flat.where("joins is null or station_id <> joins").select("line_id", "shown", "station_id")


def shown_ends(ends: DataFrame) -> DataFrame:
    """station_id, lines: the names shown at each station (ends: line_id, shown, station_id), once each, in the order of lines."""
    once = ends.groupBy("station_id", "shown").agg(F.min("line_id").alias("line_id"))
    return once.groupBy("station_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "shown"))), lambda x: x["shown"]).alias("lines"))


def partial_ends(routes: DataFrame, calls: DataFrame, ends: DataFrame, redirect: DataFrame) -> DataFrame:
    """line_id, shown, station_id: where some trains of a line end but not the line. routes: (line_id, shown, name), names of trains'
    ends; calls: (line_id, pos, station_id, name) without hidden stations; ends: as of free_ends; redirect: (station_id, at), stations
    that are shown at another one. Names that aren't on the line are left out, and so is what ends there anyway; of stations with
    one name on a line the last counts."""
    named = calls.groupBy("line_id", "name").agg(F.max_by("station_id", "pos").alias("station_id"))
    on = routes.join(named, ["line_id", "name"]).join(ends.select("line_id", "station_id").distinct(), ["line_id", "station_id"], "left_anti")
    moved = on.join(redirect, "station_id", "left").select("line_id", "shown", F.coalesce("at", "station_id").alias("station_id"))
    return moved.join(ends.select("shown", "station_id").distinct(), ["shown", "station_id"], "left_anti").select("line_id", "shown", "station_id").distinct()


def branches(legs: DataFrame, trunk: DataFrame) -> DataFrame:
    """line_id, trunk_id, n_on: how many ends of a branch lie on its trunk; exactly one is right.

    trunk: (line_id, trunk_id).
    """
    ends = line_ends(legs).join(trunk, "line_id").select("line_id", "trunk_id", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("first").alias("station_id")), F.struct(F.lit(1).alias("end"), F.col("last").alias("station_id")))).alias("e"))
    there = legs.select(F.col("line_id").alias("trunk_id"), "station_id").distinct().withColumn("on", F.lit(1))
    flat = ends.select("line_id", "trunk_id", F.col("e.station_id").alias("station_id"))
    return flat.join(there, ["trunk_id", "station_id"], "left").groupBy("line_id", "trunk_id").agg(F.count("on").alias("n_on"))


def offsets(rows: DataFrame, table: Column, line: Column, family: Column, strict: bool = True) -> DataFrame:
    """offset: of the line, else of its family, else an error (null if not strict)."""
    missing = F.raise_error(F.concat(F.lit("no lane for line "), line.cast("string"))).cast("double") if strict else F.lit(None).cast("double")
    return rows.withColumn("offset", F.coalesce(F.try_element_at(table, line), F.try_element_at(table, family), missing))


def slots(edge_families: DataFrame) -> DataFrame:
    """slot: families of an edge side by side in the order of their names, centred on 0."""
    w = Window.partitionBy("u", "v")
    rank = F.row_number().over(w.orderBy("family")) - 1
    return edge_families.withColumn("slot", rank - (F.count("*").over(w) - 1) / 2)


def length_variables(elastic: DataFrame, agreement: float = 1e-9) -> DataFrame:
    """One row for each (line_id, group) of elastic legs: bounds, flex, how many legs, and whether they agree.

    A leg without a group is one of its own.
    """
    key = F.coalesce(F.col("group"), F.concat(F.lit("leg "), F.col("pos").cast("string")))
    spread = lambda c: F.max(c) - F.min(c) <= agreement
    fields = ("preferred", "minimum", "maximum", "flex")
    agree = spread("preferred") & spread("minimum") & (F.max("maximum").eqNullSafe(F.min("maximum")) | spread("maximum")) & spread("flex")
    return elastic.withColumn("var", key).groupBy("line_id", "var").agg(*[F.min_by(c, "pos").alias(c) for c in fields], F.count("*").alias("n_legs"), agree.alias("agree"))


def equations(legs: DataFrame, start: int, with_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """The layout's linear equations: (eq, var, coef) and (eq, rhs), two for each pair of stations; with_line, both with line_id first.

    x_b - x_a - sum of elastic lengths * direction = sum of rigid lengths * direction. legs: (line_id, pos, station_id,
    len, turn, elastic); an equation is line:pos:axis, a variable x:station, y:station or len:line:pos.
    """
    legs = running_bearing(legs, start)
    p = pairs(legs.withColumnRenamed("bearing", "b0"))
    rad = F.radians("b0")
    axes = F.array(F.struct(F.lit("x").alias("axis"), F.sin(rad).alias("d")), F.struct(F.lit("y").alias("axis"), F.cos(rad).alias("d")))
    e = p.select("*", F.explode(axes).alias("ax")).withColumn("eq", F.concat_ws(":", "line_id", "pos", "ax.axis"))
    name = lambda c: F.concat_ws(":", F.col("ax.axis"), F.col(c))
    terms = F.array(
        F.struct(name("b").alias("var"), F.lit(1.0).alias("coef")), F.struct(name("a").alias("var"), F.lit(-1.0).alias("coef")),
        F.when(F.col("elastic"), F.struct(F.concat_ws(":", F.lit("len"), "line_id", "pos").alias("var"), (-F.col("ax.d")).alias("coef"))),
    )
    flat = e.select("line_id", "eq", F.explode(F.filter(terms, lambda t: t.isNotNull())).alias("t")).select("line_id", "eq", "t.var", "t.coef")
    line = ["line_id"] if with_line else []
    rhs = e.select(*line, "eq", F.when(F.col("elastic"), 0.0).otherwise(F.col("ax.d") * F.col("len")).alias("rhs"))
    # an equation is of one line, by which its rows are dealt already: with the line in the key they don't move again
    return flat.groupBy("line_id", "eq", "var").agg(F.sum("coef").alias("coef")).where("coef <> 0").select(*line, "eq", "var", "coef"), rhs


def lanes_per_edge(lanes: DataFrame) -> DataFrame:
    """u, v, width: number of distinct lanes, to 6 decimals."""
    return lanes.groupBy("u", "v").agg(F.countDistinct(F.round("lane", 6)).alias("width"))


def switching_windows(windows: DataFrame) -> DataFrame:
    """Lines that change lane at one joint do it in the same window: (joint, line_id, start, stop) with the union of all."""
    wide = windows.groupBy("joint").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return windows.drop("start", "stop").join(wide, "joint")


def first_use(legs: DataFrame) -> DataFrame:
    """u, v, line_id, pos, forward: the line that builds each edge, and whether it drives u to v."""
    e = undirected(legs)
    best = e.groupBy("u", "v").agg(F.min(F.struct("line_id", "pos", (F.col("a") == F.col("u")).alias("forward"))).alias("s"))
    return best.select("u", "v", "s.*")
