"""Later versions of a network as changes to an earlier one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.errors import require_empty
from linework.operators import graph


def missing_tombstones(parent: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Tombstones whose key the parent doesn't have: errors of the definition."""
    return delta.where("tombstone").join(parent.select(*keys), keys, "left_anti")


def merged(parent: DataFrame, delta: DataFrame, keys: list[str], check: bool = False) -> DataFrame:
    """Keys of either; the delta's values win, tombstones go. check: tombstones without a parent key raise."""
    if check:
        require_empty(missing_tombstones(parent, delta, keys).select(*keys), "removed but not there")
    values = [c for c in parent.columns if c not in keys]
    p = parent.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in values])
    d = delta.select(*keys, *[F.col(c).alias(f"_d_{c}") for c in values], F.col("tombstone").alias("_gone"), F.lit(True).alias("_new"))
    both = p.join(d, keys, "full_outer").where("not coalesce(_gone, false)")
    return both.select(*keys, *[F.when(F.col("_new"), F.col(f"_d_{c}")).otherwise(F.col(f"_p_{c}")).alias(c) for c in values])


def ordered(parent: DataFrame, delta: DataFrame, key: str, place: str) -> DataFrame:
    """merged, in definition order: replaced keys keep the parent's place, new ones follow in the delta's order."""
    out = merged(parent.drop(place), delta.drop(place), [key])
    old = parent.select(key, F.struct(F.lit(0).alias("late"), F.col(place).alias("at")).alias("_old"))
    new = delta.select(key, F.struct(F.lit(1).alias("late"), F.col(place).alias("at")).alias("_new"))
    return out.join(old, key, "left").join(new, key, "left").withColumn("place", F.coalesce("_old", "_new")).drop("_old", "_new")


def merged_set(parent: DataFrame, delta: DataFrame) -> DataFrame:
    """Elements of either, without the delta's tombstones."""
    cols = parent.columns
    return parent.unionByName(delta.where("not tombstone").select(*cols)).distinct().join(delta.where("tombstone").select(*cols), cols, "left_anti")


def chained(changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """A chain of versions at once: each key's last change counts, and goes if that is a tombstone.

    changes: all versions' rows with `version` rising along the chain, the base's without tombstones.
    """
    values = [c for c in changes.columns if c not in (*keys, version)]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), version).alias("v"))
    return last.where("not v.tombstone").select(*keys, *[F.col(f"v.{c}").alias(c) for c in values if c != "tombstone"])


def planned(stations: DataFrame) -> DataFrame:
    """Copies of stations that are only planned: the label stands in brackets."""
    return stations.withColumn("label", F.concat(F.lit("("), F.coalesce("label", "name"), F.lit(")"))).withColumn("planned", F.lit(True))


def listed(rows: DataFrame, key: str = "id", given: str | None = None) -> DataFrame:
    """A definition's rows keyed by `key`, whether they came as a list or as a map with its own keys (column `given`).

    Rows of a list are keyed by themselves; in a map the given key counts. Keys that repeat raise GeometryError.
    """
    out = rows if given is None else rows.withColumn(key, F.coalesce(F.col(given), F.col(key))).drop(given)
    require_empty(out.groupBy(key).count().where("count > 1").select(key), f"{key} repeats")
    return out


def derived(parent: dict[str, DataFrame], deltas: dict[str, DataFrame], keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The next version of a network: every table of the parent with its changes, as merged has them; tables without changes stay.

    A delta for a table that the parent doesn't have raises KeyError. Derived networks are parents of later ones.
    """
    unknown = sorted(set(deltas) - set(parent))
    if unknown:
        raise KeyError(f"no such tables: {', '.join(unknown)}")
    return {name: merged(t, deltas[name], keys[name], check=True) if name in deltas else t for name, t in parent.items()}


# The fields of a network's definition and how each takes changes: map and set entries are added, replaced and removed by key;
# giving any groups gives all of them anew; a value has no keys.
FIELDS = {
    "stations": "map", "lines": "map", "colors": "map", "corridors": "map", "label_override": "map", "label_offsets": "map", "badge_offsets": "map",
    "badge_opposite_corner": "set", "badge_above": "set", "badge_order": "map", "crossing_over": "map", "draw_over": "map", "direction_arrows": "map", "groups": "anew", "legend_at": "value",
}


def lineage(versions: DataFrame) -> DataFrame:
    """(net_id, source, depth): each network and all that it derives from, by (net_id, parent_id or null); depth 0 has no parent.

    Ways to the root are doubled each round, so a chain of n stages needs log2 n rounds. A network that derives from itself is an error.
    """
    at = graph.kept(versions.select("net_id", F.col("net_id").alias("source"), F.lit(0).alias("up")))
    jump, reach = graph.kept(versions.where("parent_id is not null").select("net_id", "parent_id")), 1
    while not jump.isEmpty():
        require_empty(jump.where("net_id = parent_id").select("net_id"), "a network derives from itself")
        more = at.join(jump.select(F.col("net_id").alias("source"), F.col("parent_id").alias("to")), "source").select("net_id", F.col("to").alias("source"), (F.col("up") + reach).alias("up"))
        at, reach = graph.kept(at.unionByName(more)), 2 * reach
        jump = graph.kept(jump.join(jump.select(F.col("net_id").alias("parent_id"), F.col("parent_id").alias("to")), "parent_id").select("net_id", F.col("to").alias("parent_id")))
    top = Window.partitionBy("net_id")
    return at.select("net_id", "source", (F.max("up").over(top) - F.col("up")).alias("depth"))


def derived_fields(versions: DataFrame, entries: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """(net_id, field, key, value, place): all fields of all networks, whatever they derive from, by one join and one window.

    versions: (net_id, parent_id or null). entries: (net_id, field, key, value, tombstone, place): what each network says itself; what it doesn't
    say is inherited. A tombstone takes an inherited entry out; one without such an entry raises GeometryError, except for a value, which it
    switches off. Entries stand in the order in which they were first given: replacing keeps an entry's place, removing and giving it again doesn't.
    Of `groups` the last network that gives any decides (a row with a null key gives none), for lines that it has. Lines without a
    colour raise GeometryError, unknown fields KeyError.
    """
    rules = FIELDS if fields is None else fields
    unknown = [r["field"] for r in entries.where(~F.col("field").isin(list(rules))).select("field").distinct().limit(5).collect()]
    if unknown:
        raise KeyError(f"no such fields: {', '.join(sorted(unknown))}")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]), F.col("field"))
    said = entries.withColumnRenamed("net_id", "source").withColumn("kind", kind)
    said = said.withColumn("key", F.when(F.col("kind") == "value", F.lit("")).otherwise(F.col("key")))
    every = graph.kept(lineage(versions).join(said, "source"))
    latest = F.max(F.when(F.col("kind") == "anew", F.col("depth"))).over(Window.partitionBy("net_id", "field"))
    own = Window.partitionBy("net_id", "field", "key").orderBy("depth")
    row = every.withColumn("latest", latest).where("kind <> 'anew' or (depth = latest and key is not null)")
    row = row.withColumn("before", F.lag("tombstone").over(own)).withColumn("life", F.sum(F.col("tombstone").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    require_empty(row.where("tombstone and kind <> 'value' and coalesce(before, true)").select("net_id", "field", "key"), "removed but not there")
    row = row.withColumn("given", F.min(F.struct("depth", "place")).over(Window.partitionBy("net_id", "field", "key", "life", "tombstone")))
    last = row.groupBy("net_id", "field", "key").agg(F.max_by(F.struct("value", "tombstone", "given", "kind"), "depth").alias("v"))
    last = graph.kept(last.where("not v.tombstone").select("net_id", "field", "key", "v.value", "v.given", "v.kind"))
    keys = lambda f, c: last.where(F.col("field") == f).select("net_id", F.col("key").alias(c))
    require_empty(keys("lines", "key").join(keys("colors", "key"), ["net_id", "key"], "left_anti"), "lines without a colour")
    lines = last.where("kind = 'anew'").join(keys("lines", "key"), ["net_id", "key"], "left_semi").select(last.columns)
    out = last.where("kind <> 'anew'").unionByName(lines)
    return out.select("net_id", "field", "key", "value", F.row_number().over(Window.partitionBy("net_id", "field").orderBy("given", "key")).alias("place"))


def changed(rows: DataFrame, which: Column, **fields: Column) -> DataFrame:
    """A copy in which the rows that meet `which` have other fields. Fields that aren't there raise KeyError."""
    unknown = sorted(set(fields) - set(rows.columns))
    if unknown:
        raise KeyError(f"no such fields: {', '.join(unknown)}")
    return rows.withColumns({c: F.when(which, v).otherwise(F.col(c)) for c, v in fields.items()})


def families(lines: DataFrame) -> DataFrame:
    """line_id, family of the lines that have one of their own."""
    return lines.where("family is not null and family <> ''").select("line_id", "family")
