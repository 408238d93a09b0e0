"""Queries of map data and solved networks, with SQL; registered beside those of linework.plans.registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.operators import tracks as T
from linework.plans import maps, schematic, whole
from linework.plans.registry import LEGS, query
from linework.schema import PATH
from linework.sources import adapters as A
from linework.sources import osm


@query(f"""with l as ({LEGS}), q as (select line_id, pos, (line_id % 10) * 100 + pos + case when line_id % 10 >= 6 and pos = 3 and line_id % 3 = 0 then 50 else 0 end as piece from l where pos <= 4 and line_id in (select line_id from l where pos = 4)),
    n as (select piece, lag(piece) over w as p, lead(piece) over w as n from q window w as (partition by line_id order by pos)),
    g as (select piece, min(least(p, n) * 100000 + greatest(p, n)) = max(least(p, n) * 100000 + greatest(p, n)) as one, count(*) filter (p is null or n is null) as ends from n group by piece) select piece from g where one and ends = 0""")
def passing_pieces(spark, sf_dir):
    """Ten bundles of four pieces; in four of them some lines take another third piece."""
    legs = A.legs(spark, sf_dir)
    long_ = legs.where("pos = 4").select("line_id").distinct()
    piece = (F.col("line_id") % 10) * 100 + F.col("pos") + F.when((F.col("line_id") % 10 >= 6) & (F.col("pos") == 3) & (F.col("line_id") % 3 == 0), 50).otherwise(0)
    return T.through_pieces(legs.where("pos <= 4").join(long_, "line_id", "left_semi").select("line_id", "pos", piece.alias("piece")))


def _elements(spark, sf_dir) -> DataFrame:
    """Orders as relations of three sources whose members are ways: suppliers. Every eleventh mention has one point only."""
    point = lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    legs = A.legs(spark, sf_dir)
    a, b = point(F.col("station_id"), F.col("line_id")), point(F.col("pos"), F.col("line_id"))
    shape = F.when((F.col("line_id") + F.col("pos")) % 11 == 0, F.array(a)).otherwise(F.array(a, b))
    member = F.struct(F.lit("way").alias("type"), F.col("station_id").alias("ref"), F.lit("outer").alias("role"), shape.alias("geometry"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", member.alias("m")))), lambda x: x["m"])
    return legs.groupBy("line_id").agg(ordered.alias("members")).select(
        (F.col("line_id") % 3).cast("string").alias("source"), F.col("line_id").cast("int").alias("elem_pos"), F.lit("relation").alias("type"), F.col("line_id").alias("id"),
        F.lit(None).cast("array<struct<lon:double,lat:double>>").alias("geometry"), "members", F.create_map(F.lit("route"), F.lit("train"), F.lit("ref"), F.concat(F.lit("S"), (F.col("line_id") % 5).cast("string"))).alias("tags"),
    )


@query(f"""with l as ({LEGS}), f as (select station_id as way_id, cast(line_id % 3 as varchar) as source, line_id, pos from l qualify row_number() over (partition by line_id % 3, station_id order by line_id, pos) = 1)
    select way_id, source, line_id as elem_pos, pos - 1 as member_pos from f where (line_id + pos) % 11 <> 0""")
def first_ways(spark, sf_dir):
    """Of the mentions of a way within a source the first counts, and goes if it is too short."""
    return osm.ways(_elements(spark, sf_dir)).select("way_id", "source", F.col("elem_pos").cast("long").alias("elem_pos"), F.col("member_pos").cast("long").alias("member_pos"))


@query("""with k as (select s_suppkey as net, 2 + s_suppkey % 5 as p, 6 + s_suppkey % 3 as r from supplier), y as (select *, least(3.5::double, r - (r - 3 + 2 * p) / 3::double) as y from k)
    select net, 'A' as station, 0::double as x, 0::double as y from y union all select net, 'B', round(r - y, 5), 0 from y union all select net, 'C', r, 0 from y
    union all select net, 'D', round(r - y + 2 + 0.6::double * sin(radians(135::double)), 5), round(0.6::double * cos(radians(135::double)), 5) from y""")
def solve_shared(spark, sf_dir):
    """A network for each supplier: a rigid line across two elastic edges, one of which two lines share; a bound may hold.

    The second line's bearing follows from the shared edge. Two wishes for the first edge and one for the second give way to
    the rigid length, until the second edge is as long as it may be.
    """
    xy = _shared(spark, sf_dir)["coordinates"]
    r = lambda c: F.round(c, 5) + 0
    return xy.select(F.col("net_id").cast("long").alias("net"), "station", r("x").alias("x"), r("y").alias("y"))


@query("select s_suppkey as net, 0 as n_off from supplier")
def rebuilt_shared(spark, sf_dir):
    """How many pairs of stations of those networks aren't met by walking their legs again."""
    s = _shared(spark, sf_dir)
    off = maps.rebuilt(s["legs"], s["bearings"], s["solution"], s["coordinates"]).groupBy("net_id").agg(F.count("*").alias("n"))
    nets = s["coordinates"].select("net_id").distinct()
    return nets.join(off, "net_id", "left").select(F.col("net_id").cast("long").alias("net"), F.coalesce("n", F.lit(0)).cast("int").alias("n_off"))


def _path(length: Column, most: Column | None = None, elastic: bool = True) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(length.cast("double").alias("length"), none.alias("minimum"), (none if most is None else most.cast("double")).alias("maximum"), F.lit(elastic).alias("flexibility"), F.lit(1.0).alias("flex"), F.lit(None).cast("string").alias("group")).cast(PATH)


def _shared(spark, sf_dir) -> dict[str, DataFrame]:
    return schematic.layout(*_networks(spark, sf_dir))


def _networks(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """stations, lines, steps of a small network for each supplier."""
    k = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("net_id"), (2 + F.col("s_suppkey") % 5).alias("p"), (6 + F.col("s_suppkey") % 3).alias("r"))
    stop, path, turn = (lambda s: ("station", F.lit(s), None, None)), (lambda c: ("path", None, None, c)), ("turn", None, F.lit(45), None)
    courses = {
        "0": [stop("A"), path(_path(F.col("p"))), stop("B"), path(_path(F.lit(3), F.lit(3.5))), stop("C")],
        "1": [stop("A"), path(_path(F.col("p"))), stop("B"), path(_path(F.lit(2))), turn, stop("D")],
        "2": [stop("A"), path(_path(F.col("r"), elastic=False)), stop("C")],
    }

    def step(line: str, i: int, kind: str, station: Column | None, delta: Column | None, path_: Column | None) -> Column:
        or_null = lambda v, t: (F.lit(None) if v is None else v).cast(t)
        return F.struct(F.lit(line).alias("line_id"), F.lit(i).alias("pos"), F.lit(kind).alias("step_kind"), or_null(station, "string").alias("station_id"), or_null(delta, "int").alias("turn_delta"), F.lit(None).cast("double").alias("turn_radius"), or_null(path_, PATH).alias("path"))

    steps = k.select("net_id", F.explode(F.array(*[step(line, i, *s) for line, own in courses.items() for i, s in enumerate(own)])).alias("s")).select("net_id", "s.*")
    start = {"0": F.lit(90), "1": F.lit(None).cast("int"), "2": F.lit(90)}
    line = lambda i, s: F.struct(F.lit(i).alias("line_id"), F.lit(int(i)).alias("line_pos"), F.lit("#000").alias("color"), s.cast("int").alias("start"), F.lit(None).cast("struct<x:double,y:double>").alias("anchor"), F.lit(1.2).alias("spacing"), F.lit(None).cast("string").alias("direction"), F.lit(False).alias("closed"), F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("branch_of"))
    lines = k.select("net_id", F.explode(F.array(*[line(i, s) for i, s in start.items()])).alias("l")).select("net_id", "l.*")
    stations = k.select("net_id", F.explode(F.array(*map(F.lit, "ABCD"))).alias("id")).withColumn("kind", F.lit("station"))
    return stations, lines, steps


# Lanes are 8 pixels apart: lines 0 and 1 share the first edge, 4 above and below its middle; line 0 changes to the middle of its second edge by
# a curve of 16 pixels, line 1 in its corner, of radius 16; line 2 runs in the middle all along.
MAP_SQL = """with k as (select s_suppkey as net, 2 + s_suppkey % 5 as p, 6 + s_suppkey % 3 as r from supplier), y as (select net, r::double as r, least(3.5::double, r - (r - 3 + 2 * p) / 3::double) as y from k),
    g as (select net, r * 20 as r, (r - y) * 20 as m, y * 20 as y, sqrt(0.5::double) as h, tan(radians(22.5::double)) * 16 as t from y), v as (select *, m + (y - 16) / 2 as f, m + 36 as c, m + 40 + 12 * h as dx, 12 * h as dy from g),
    e as (select net, 1 as level, 1 as place, '0' as id, printf('M 0.000 4.000 L %.3f 4.000 C %.3f 4.000 %.3f 0.000 %.3f 0.000 L %.3f 0.000', f, f + 8, f + 8, f + 16, m + y) as d from v
        union all select net, 1, 2, '1', printf('M 0.000 -4.000 L %.3f -4.000 L %.3f -4.000 A 16.000 16.000 0 0 1 %.3f %.3f L %.3f %.3f', m, c - t, c + t * h, -4 + t * h, dx, dy) from v
        union all select net, 1, 3, '2', printf('M 0.000 0.000 L %.3f 0.000', r) from v),
    l as (select net, level, place, id, '<path stroke="#ffffff" stroke-width="5.5" d="' || d || '"/>' || chr(10) || '<path id="line-' || id || '" stroke="#000" stroke-width="4" d="' || d || '"/>' as text from e),
    s as (select net, 'A' as id, 0 as x, 0 as y, 4 as half, 1 as place from v union all select net, 'B', m, 0, 4, 2 from v union all select net, 'C', r, 0, 0, 3 from v union all select net, 'D', dx, dy, 0, 4 from v),
    n as (select *, printf('<path d="M %.1f -4.0 L %.1f 4.0" stroke="#111" stroke-width="10" stroke-linecap="round"/>', x, x) || printf('<path d="M %.1f -4.0 L %.1f 4.0" stroke="#fff" stroke-width="7" stroke-linecap="round"/>', x, x) as pill,
        printf('<circle cx="%.1f" cy="%.1f" r="3" fill="#fff" stroke="#111"/>', x, y) as dot from s)
    select net, level, place, id, text from l union all select net, 2, place, id, case when half > 0 then pill else dot end from n
    union all select net, 3, place, id, printf('<text x="%.1f" y="%.1f" font-size="10">%s</text>', x + 8, y + 10 / 3::double, id) from n"""


@query(MAP_SQL)
def network_maps(spark, sf_dir):
    """Those networks drawn, with lanes, a rounded corner, a curve from lane to lane, pills and names, as rows in drawing order."""
    stations, lines, steps = _networks(spark, sf_dir)
    none = lambda t: F.lit(None).cast(t)
    stations = stations.withColumns({"name": F.col("id"), "label": none("string"), "hidden": none("boolean"), "planned": none("boolean")})
    at_once = stations.where("id = 'B'").select("net_id", F.lit("B").alias("u"), F.lit("C").alias("v"), F.lit("middle").alias("at"))
    rows = whole.map_rows(stations, lines, steps, at_once=at_once, span=4.0)
    return rows.select(F.col("map_id").cast("long").alias("net"), "level", F.col("place").cast("long").alias("place"), "id", "text")
