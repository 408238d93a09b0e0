import pytest

from linework.errors import GeometryError
from linework.operators import overlay

ENTRY = "net_id string, field string, key string, value string, tombstone boolean, place int"


def state(spark, versions, entries):
    v = spark.createDataFrame(versions, "net_id string, parent_id string")
    rows = [(n, f, k, x, x is None and f not in ("badge_above", "badge_opposite_corner") or x == "GONE", i) for i, (n, f, k, x) in enumerate(entries)]
    out = {}
    for r in overlay.derived_fields(v, spark.createDataFrame(rows, ENTRY)).orderBy("net_id", "field", "place").collect():
        out.setdefault(r.net_id, {}).setdefault(r.field, []).append((r.key, r.value))
    return out


def test_all_rules(spark):
    base = [("a", "lines", "1", "one"), ("a", "lines", "2", "two"), ("a", "colors", "1", "#1"), ("a", "colors", "2", "#2"), ("a", "colors", "3", "#3"), ("a", "badge_above", "s", None), ("a", "groups", "1", "g1"), ("a", "groups", "2", "g2"), ("a", "legend_at", None, "0,0")]
    base = [(n, f, k, v if f != "badge_above" else "") for n, f, k, v in base]
    b = [("b", "lines", "3", "three"), ("b", "lines", "1", "uno"), ("b", "badge_above", "t", ""), ("b", "badge_above", "s", "GONE"), ("b", "legend_at", None, "GONE")]
    c = [("c", "lines", "2", "GONE"), ("c", "groups", "3", "g3"), ("c", "groups", "9", "none"), ("c", "badge_above", "s", "")]
    d = [("d", "lines", "2", "again"), ("d", "groups", None, "")]
    got = state(spark, [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "b")], base + b + c + d)
    colors = [("1", "#1"), ("2", "#2"), ("3", "#3")]
    assert got["a"] == {"lines": [("1", "one"), ("2", "two")], "colors": colors, "badge_above": [("s", "")], "groups": [("1", "g1"), ("2", "g2")], "legend_at": [("", "0,0")]}
    assert got["b"] == {"lines": [("1", "uno"), ("2", "two"), ("3", "three")], "colors": colors, "badge_above": [("t", "")], "groups": [("1", "g1"), ("2", "g2")]}
    assert got["c"] == {"lines": [("1", "uno"), ("3", "three")], "colors": colors, "badge_above": [("t", ""), ("s", "")], "groups": [("3", "g3")]}
    assert got["d"] == {"lines": [("1", "uno"), ("3", "three"), ("2", "again")], "colors": colors, "badge_above": [("t", ""), ("s", "")]}
    assert got["e"] == got["b"]


def test_errors(spark):
    nets = [("a", None), ("b", "a")]
    base = [("a", "lines", "1", "one"), ("a", "colors", "1", "#1")]
    with pytest.raises(GeometryError, match="not there"):
        state(spark, nets, [*base, ("b", "corridors", "x", "GONE")])
    with pytest.raises(GeometryError, match="colour"):
        state(spark, nets, [*base, ("b", "lines", "2", "two")])
    with pytest.raises(KeyError, match="wrong"):
        state(spark, nets, [*base, ("b", "wrong", "2", "two")])
    with pytest.raises(GeometryError, match="itself"):
        state(spark, [("a", "b"), ("b", "a")], base)
