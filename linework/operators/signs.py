"""Dots of stations, rings and coloured dots where lines end.

calls: (map_id, line_id, pos, station_id, x, y, ux, uy): where a line's lane passes a station and in which direction (a unit vector), once for each
station. stations: (map_id, station_id, kind, hidden, x, y). lines: (map_id, line_id, closed, branch_join: the station at which a
branch runs into its main line, else null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["map_id", "station_id"]


def dots(calls: DataFrame, stations: DataFrame, step: float = 0.1) -> DataFrame:
    """map_id, station_id, line_id, x, y: a dot for each lane that passes a station, of those in one place (to `step`) the first line's; a station that no
    line calls at has one at its own place, without a line. Hidden stations have none, nor have hubs that lines call at."""
    shown = stations.where("not coalesce(hidden, false)")
    own = calls.select(*KEY, "line_id", "x", "y").join(shown.where("kind <> 'hub'").select(*KEY), KEY, "left_semi")
    place = lambda c: F.rint(F.col(c) / step).alias(f"_{c}")
    once = own.groupBy("map_id", place("x"), place("y")).agg(F.min(F.struct("line_id", "station_id", "x", "y")).alias("d"))
    alone = shown.join(calls.select(*KEY).distinct(), KEY, "left_anti")
    return once.select("map_id", "d.station_id", "d.line_id", "d.x", "d.y").unionByName(alone.select(*KEY, F.lit(None).cast(calls.schema["line_id"].dataType).alias("line_id"), "x", "y"))


def ends(calls: DataFrame, lines: DataFrame) -> DataFrame:
    """map_id, station_id, line_id, x, y, ux, uy: both ends of lines that aren't closed, of branches the free ones, with the direction in which the line comes to its end."""
    whole = Window.partitionBy("map_id", "line_id")
    at = calls.withColumn("_first", F.min("pos").over(whole) == F.col("pos")).withColumn("_last", F.max("pos").over(whole) == F.col("pos"))
    open_ = lines.where("not coalesce(closed, false)").select("map_id", "line_id", F.col("branch_join").alias("_join"))
    sign = F.when(F.col("_last"), 1).otherwise(-1)
    return at.where("_first <> _last").join(open_, ["map_id", "line_id"]).where("not station_id <=> _join").select(*KEY, "line_id", "x", "y", (sign * F.col("ux")).alias("ux"), (sign * F.col("uy")).alias("uy"))


def rings(ends_: DataFrame, stations: DataFrame) -> DataFrame:
    """Ends at stations that aren't hubs: they get a ring with a dot in the line's colour."""
    return ends_.join(stations.where("kind <> 'hub'").select(*KEY), KEY, "left_semi").select(*KEY, "line_id", "x", "y")


def hub_ends(ends_: DataFrame, calls: DataFrame, stations: DataFrame, pills: DataFrame) -> DataFrame:
    """map_id, station_id, line_id, x, y, met: the coloured dots of lines that end at hubs, on the line that they come upon first (met), else on the
    axis of the hub's pill. pills: (map_id, station_id, x, y, nx, ny), one for each hub, else the dot stays at the line's end.

    How far ahead another line lies is linear in its distance from a common point, so of all lines in one direction only the two outermost are joined: a hub of any
    number of lines sends a few rows for each direction.
    """
    hubs = stations.where("kind = 'hub'").select(*KEY, F.col("x").alias("hx"), F.col("y").alias("hy"))
    d = lambda c: F.round(c, 9).alias(f"d{c[1]}")
    passing = calls.join(hubs, KEY).select(*KEY, d("ux"), d("uy"), (F.col("x") - F.col("hx")).alias("x"), (F.col("y") - F.col("hy")).alias("y"))
    aside = F.col("x") * F.col("dy") - F.col("y") * F.col("dx")
    outer = passing.groupBy(*KEY, "dx", "dy").agg(F.min(aside).alias("low"), F.max(aside).alias("high"))
    here = ends_.join(hubs, KEY).withColumn("rx", F.col("x") - F.col("hx")).withColumn("ry", F.col("y") - F.col("hy"))
    turn = F.col("ux") * F.col("dy") - F.col("uy") * F.col("dx")
    both = here.join(outer, KEY).where(F.abs(turn) >= 1e-6)
    own = F.col("rx") * F.col("dy") - F.col("ry") * F.col("dx")
    t = F.least((F.col("low") - own) / turn, (F.col("high") - own) / turn)
    first = both.withColumn("t", t).where("t <= 1e-6").groupBy(*KEY, "line_id").agg(F.min("t").alias("t"))
    axis = pills.select(*KEY, F.col("x").alias("px"), F.col("y").alias("py"), "nx", "ny")
    out = here.join(first, [*KEY, "line_id"], "left").join(axis, KEY, "left")
    along = (F.col("x") - F.col("px")) * F.col("nx") + (F.col("y") - F.col("py")) * F.col("ny")
    at = lambda c: F.when(F.col("t").isNotNull(), F.col(c) + F.col("t") * F.col(f"u{c}")).otherwise(F.coalesce(F.col(f"p{c}") + along * F.col(f"n{c}"), F.col(c))).alias(c)
    return out.select(*KEY, "line_id", at("x"), at("y"), F.col("t").isNotNull().alias("met"))
