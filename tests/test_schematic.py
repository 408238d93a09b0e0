import pytest

from linework import schema
from linework.errors import GeometryError
from linework.plans import schematic


class Turn:
    def __init__(self, delta, radius=None):
        self.delta, self.radius = delta, radius


def flex(length=None, minimum=None, maximum=None, flex=1.0, group=None):
    return (length, minimum, maximum, True, flex, group)


def fix(length):
    return (length, None, None, False, 1.0, None)


def net(spark, lines, spacing=1.0):
    """lines: name -> (start, steps, other fields)."""
    step_rows, line_rows, ids = [], [], {}
    for k, (name, (start, steps, *rest)) in enumerate(lines.items()):
        more = rest[0] if rest else {}
        line_rows.append(("n", name, k, "#000", start, more.get("anchor"), spacing, "forward", more.get("closed", False), None, None))
        for pos, s in enumerate(steps):
            if isinstance(s, str):
                ids[s] = None
                step_rows.append(("n", name, pos, "station", s, None, None, None))
            elif isinstance(s, Turn):
                step_rows.append(("n", name, pos, "turn", None, s.delta, s.radius, None))
            else:
                step_rows.append(("n", name, pos, "path", None, None, None, s))
    stations = [("n", i, i, i, "station", None, False, False, None) for i in ids]
    return spark.createDataFrame(stations, schema.STATION), spark.createDataFrame(line_rows, schema.LINE), spark.createDataFrame(step_rows, schema.STEP)


def solved(spark, lines, **kw):
    out = schematic.layout(*net(spark, lines, **kw))
    xy = {r.station: (r.x, r.y) for r in out["coordinates"].collect()}
    lengths = {r["var"]: r.value for r in out["solution"].where("var like 'len:%'").collect()}
    return out, xy, lengths


def close(a, b):
    return a == pytest.approx(b, abs=1e-6)


def test_shared_edge_driven_the_other_way(spark):
    out, xy, _ = solved(spark, {"X": (90, ["a", "b", "c"]), "Y": (None, ["c", "b", Turn(45), "d"])})
    assert {r.line_id: r.bearing for r in out["bearings"].collect()} == {"X": 90, "Y": 270}
    assert all(close(xy[s], p) for s, p in {"a": (0, 0), "b": (1, 0), "c": (2, 0), "d": (0.146447, 0.353553)}.items())
    corner = out["legs"].where("delta is not null").first()
    assert (corner.a, corner.b, corner.delta, corner.radius, corner.forced) == ("b", "d", 45, 0.8, False)


def test_coupled_lengths_stiffness_and_bounds(spark):
    base = {"L1": (90, ["m", fix(3.0), "n"])}
    _, xy, _ = solved(spark, base | {"L2": (90, ["m", flex(1.0, group="g"), "k", flex(1.0, group="g"), "n"])})
    assert close(xy["k"], (1.5, 0))
    _, _, lens = solved(spark, base | {"L2": (90, ["m", flex(1.0), "k", flex(1.0, flex=2.0), "n"])})
    assert close(sorted(lens.values()), [1.2, 1.8])
    _, _, lens = solved(spark, base | {"L2": (90, ["m", flex(1.0), "k", flex(1.0, flex=2.0, maximum=1.5), "n"])})
    assert close(sorted(lens.values()), [1.5, 1.5])


def test_contradictions(spark):
    with pytest.raises(Exception, match="contradictory lengths"):
        solved(spark, {"L1": (90, ["m", fix(3.0), "n"]), "L2": (90, ["m", fix(1.0), "k", fix(1.0), "n"])})
    with pytest.raises(GeometryError, match="shape"):
        solved(spark, {"X": (90, ["a", "b"]), "V": (None, ["a", fix(2.0), "b"])})
    with pytest.raises(GeometryError, match="bearings"):
        solved(spark, {"X": (90, ["a", "b"]), "V": (0, ["a", "b"])})
    with pytest.raises(GeometryError, match="twice"):
        solved(spark, {"X": (90, ["a", "b", "c", "a"])})
    with pytest.raises(GeometryError, match="two paths"):
        solved(spark, {"X": (90, ["a", fix(1.0), fix(1.0), "b"])})


def test_components_stand_side_by_side(spark):
    _, xy, _ = solved(spark, {"X": (90, ["a", "b"]), "W": (90, ["p", "q"])})
    assert close(xy["a"], (0, 0)) and close(xy["p"], (40, 0)) and close(xy["q"], (41, 0))


def test_anchor_default_start_and_zero_legs(spark):
    _, xy, _ = solved(spark, {"X": (90, ["a", "b"], {"anchor": (5.0, 6.0)}), "Z": (None, ["q", "r"])})
    assert close(xy["a"], (5, 6)) and close(xy["b"], (6, 6))
    assert close(xy["r"], (40 + 0.5**0.5, 0.5**0.5))
    out, _, _ = solved(spark, {"S": (90, ["a", fix(1.0), "b"]), "T": (None, ["a", fix(0.0), Turn(90), fix(1.0), "b"])})
    assert {r.line_id: r.bearing for r in out["bearings"].collect()} == {"S": 90, "T": 0}


def test_ring(spark):
    out, xy, _ = solved(spark, {"R": (90, ["a", Turn(90), "b", Turn(90), "c", Turn(90), "d", Turn(90), "a"], {"closed": True})})
    assert out["segments"].count() == 4 and len(xy) == 4


def test_definition_rules(spark):
    stations, lines, steps = net(spark, {"X": (90, ["a", "b"])})
    with pytest.raises(GeometryError, match="repeat"):
        schematic.check_definitions(stations.union(stations), lines, steps)
    with pytest.raises(GeometryError, match="unknown stations"):
        schematic.check_definitions(stations.where("id = 'a'"), lines, steps)
    with pytest.raises(GeometryError, match="colour"):
        schematic.check_definitions(stations, lines.withColumn("color", schematic.F.lit(None)), steps)
    with pytest.raises(GeometryError, match="two stations"):
        schematic.check_definitions(stations, lines, steps.where("pos = 0"))


def test_rules_of_corridors_trains_and_layers(spark):
    corridor = lambda at: spark.createDataFrame([("n", "c", at)], "net_id string, name string, shift_at string")
    schematic.check_corridors(corridor("end").union(corridor(None)))
    with pytest.raises(GeometryError, match="change"):
        schematic.check_corridors(corridor("near"))
    train = lambda cars, hollow: spark.createDataFrame([("n", "l", 0, cars, hollow)], "net_id string, line_id string, pos int, cars int, hollow int")
    schematic.check_trains(train(4, 4).union(train(1, 0)))
    for cars, hollow in ((0, 0), (5, 0), (2, 3), (2, -1)):
        with pytest.raises(GeometryError, match="cars"):
            schematic.check_trains(train(cars, hollow))
    layer = lambda kind, stroke: spark.createDataFrame([("m", 0, (kind, stroke))], "map_id string, layer_pos int, layer struct<kind:string,stroke:string>")
    schematic.check_layers(layer("line", "#000").union(layer("area", None)))
    for bad in (layer("point", "#000"), layer("line", None), layer(None, None)):
        with pytest.raises(GeometryError, match="layer"):
            schematic.check_layers(bad)


def test_components_over_batches(spark):
    """Components of any number of batches, and batches of any number of components."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    lines = {"X": (90, ["a", "b", "c", "d", "e"]), "Y": (None, ["c", "b", Turn(45), "f"]), "W": (90, ["p", "q"]), "V": (90, ["r", flex(1.0), "s"])}
    _, whole, _ = solved(spark, lines)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        assert solved(spark, lines)[1] == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
