"""Map data from stored query answers: JSON documents, gzip or plain, read by Spark with a fixed schema.

Answers are stored by the hash of their query, so any label finds them again. Fetching isn't part of this package.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linework.errors import require_empty
from linework.schema import OSM

RING = "array<struct<lon:double,lat:double>>"


def cache_key(query: str) -> str:
    """The first 12 digits of the query's SHA-1: the name under which its answer is stored."""
    return hashlib.sha1(query.encode()).hexdigest()[:12]


def build_query(selectors: list[str], box: tuple[float, float, float, float], tags: bool, timeout: int = 300, maxsize: int = 0) -> str:
    """The text of a query for (south, west, north, east). The box stands at each selector: a global one would cut
    geometries off. Without tags only shapes are asked for. maxsize: bytes that the server may use, its default if 0."""
    where = "(" + ",".join(f"{v:.5f}" for v in box) + ");"
    head = f"[out:json][timeout:{timeout}]" + (f"[maxsize:{maxsize}]" if maxsize else "") + ";"
    return "\n".join([head, "(", *(f"  {s}{where}" for s in selectors), ");", "out geom qt;" if tags else "out skel geom qt;"])


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """source, elem_pos and each element's fields. An answer with a remark and no elements is an error."""
    docs = spark.read.schema(OSM).json(path, multiLine=True).withColumn("source", F.input_file_name())
    require_empty(docs.where("remark is not null and coalesce(size(elements), 0) <= 0").select("source", "remark"), "a query failed")
    return docs.select("source", F.posexplode("elements").alias("elem_pos", "e")).select("source", "elem_pos", "e.*")


def _points(geometry: str):
    return F.coalesce(F.filter(F.col(geometry), lambda p: p.isNotNull()), F.array().cast(RING))


def ways(elements: DataFrame) -> DataFrame:
    """way_id, source, elem_pos, member_pos, pts: ways and relations' member ways, each way once, the first in order.

    A way that comes first with less than two points is left out all the same.
    """
    own = elements.where("type = 'way'").select("source", "elem_pos", F.lit(0).alias("member_pos"), F.col("id").alias("way_id"), "geometry")
    members = elements.where("type = 'relation'").select("source", "elem_pos", F.posexplode("members").alias("member_pos", "m")).where("m.type = 'way'")
    every = own.unionByName(members.select("source", "elem_pos", "member_pos", F.col("m.ref").alias("way_id"), F.col("m.geometry").alias("geometry")))
    first = Window.partitionBy("source", "way_id").orderBy("elem_pos", "member_pos")
    once = every.withColumn("_r", F.row_number().over(first)).where("_r = 1").withColumn("pts", _points("geometry"))
    return once.where(F.size("pts") >= 2).select("way_id", "source", "elem_pos", "member_pos", "pts")


def stitched(ways_: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Rings from pieces that meet at their ends, in either direction; what stays open is closed by force.

    Pieces are edges of a graph whose nodes are their ends. A walk starts with the first piece left, at that piece's end, and
    takes at each node the first piece left there, until it is back or stuck; rings of less than four points are dropped.
    """
    at: dict[tuple[float, float], list[int]] = {}
    for i, w in enumerate(ways_):
        for node in {w[0], w[-1]}:
            at.setdefault(node, []).append(i)
    left = set(range(len(ways_)))
    rings = []
    for i in range(len(ways_)):
        if i not in left:
            continue
        walk, ring = i, [ways_[i][0]]
        while walk is not None:
            left.discard(walk)
            piece = ways_[walk]
            ring.extend(piece[1:] if piece[0] == ring[-1] else piece[-2::-1])
            closed = ring[-1] == ring[0]
            walk = None if closed else next((k for k in at[ring[-1]] if k in left), None)
        if ring[-1] != ring[0]:
            ring.append(ring[0])
        if len(ring) >= 4:
            rings.append(ring)
    return rings


def areas(elements: DataFrame) -> DataFrame:
    """source, elem_pos, ring_pos, pts: closed ways of four points or more, and relations' rings, outer before inner.

    An empty role is outer. Only a relation's own members meet in a task.
    """
    pts = _points("geometry")
    closed = elements.where("type = 'way'").withColumn("pts", pts).where((F.size("pts") >= 4) & (F.try_element_at("pts", F.lit(1)) == F.try_element_at("pts", F.lit(-1))))
    own = closed.select("source", "elem_pos", F.lit(0).alias("ring_pos"), "pts")
    members = elements.where("type = 'relation'").select("source", "elem_pos", F.posexplode("members").alias("member_pos", "m")).where("m.type = 'way'")
    parts = members.select("source", "elem_pos", "member_pos", F.coalesce(F.nullif(F.col("m.role"), F.lit("")), F.lit("outer")).alias("role"), F.col("m.geometry").alias("geometry"))
    parts = parts.where("role in ('outer', 'inner')").withColumn("pts", pts).where(F.size("pts") >= 2)
    flat = parts.select("source", "elem_pos", "role", "member_pos", "pts")

    def rings(rows: pd.DataFrame) -> pd.DataFrame:
        out, at = [], 0
        for role in ("outer", "inner"):
            own_ = rows[rows.role == role].sort_values("member_pos")
            for ring in stitched([[(p["lon"], p["lat"]) for p in w] for w in own_.pts]):
                out.append((rows.source.iloc[0], rows.elem_pos.iloc[0], at, [{"lon": x, "lat": y} for x, y in ring]))
                at += 1
        return pd.DataFrame(out, columns=["source", "elem_pos", "ring_pos", "pts"])

    return own.unionByName(flat.groupBy("source", "elem_pos").applyInPandas(rings, f"source string, elem_pos int, ring_pos int, pts {RING}"))


def stops(elements: DataFrame) -> DataFrame:
    """name, lon, lat of named nodes."""
    return elements.where("type = 'node' and lon is not null").select(F.try_element_at("tags", F.lit("name")).alias("name"), "lon", "lat").where("name is not null")


#: Tracks that are drawn, and service tracks that aren't.
RAILWAY, SKIP_SERVICE = ("light_rail", "rail"), ("crossover", "siding", "yard", "spur")


def rails(elements: DataFrame, railway: tuple[str, ...] = RAILWAY, skip_service: tuple[str, ...] = SKIP_SERVICE) -> DataFrame:
    """way_id, source, elem_pos, pts: ways of two points or more that are such tracks and no such service tracks."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    own = elements.where("type = 'way'").where(tag("railway").isin(*railway) & ~F.coalesce(tag("service"), F.lit("")).isin(*skip_service))
    return own.select(F.col("id").alias("way_id"), "source", "elem_pos", _points("geometry").alias("pts")).where(F.size("pts") >= 2)


def of_relations(elements: DataFrame, relations: Column, kind: str, members: Column, others: Column) -> DataFrame:
    """Elements of a kind ('way' or 'node') that a relation of the given condition has as members and that meet `members`, or
    that meet `others` by themselves; each once. The conditions are columns of elements."""
    wanted = elements.where("type = 'relation'").where(relations).select(F.explode("members").alias("m")).where(F.col("m.type") == kind).select(F.col("m.ref").alias("id")).distinct()
    own = elements.where(F.col("type") == kind)
    return own.where(members).join(wanted, "id", "left_semi").unionByName(own.where(others)).dropDuplicates(["id"])


def line_tracks(elements: DataFrame) -> DataFrame:
    """Tracks that a numbered light-rail line's relation uses, and light-rail tracks that are no service tracks."""
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    return of_relations(elements, _numbered(), "way", tag("railway").isNotNull(), (tag("railway") == "light_rail") & tag("service").isNull())


def line_stops(elements: DataFrame) -> DataFrame:
    """Stops of numbered light-rail lines' relations, and all stations and halts."""
    return of_relations(elements, _numbered(), "node", F.lit(True), F.coalesce(F.try_element_at("tags", F.lit("railway")).rlike("^(station|halt)$"), F.lit(False)))


def _numbered() -> Column:
    return F.coalesce(F.try_element_at("tags", F.lit("route")).rlike("^(light_rail|train)$") & F.try_element_at("tags", F.lit("ref")).rlike("^S[0-9]"), F.lit(False))


def store(answers: DataFrame, path: str) -> None:
    """Writes answers (query, document) gzipped, each in a folder named by its query's key."""
    key = F.substring(F.sha1("query"), 1, 12)
    answers.select(key.alias("key"), "document").dropDuplicates(["key"]).write.mode("append").partitionBy("key").option("compression", "gzip").text(path)


def stored(spark: SparkSession, path: str, query: str) -> DataFrame:
    """read_elements of the answer to one query, found by its key alone."""
    return read_elements(spark, f"{path}/key={cache_key(query)}")
