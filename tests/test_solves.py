"""Networks are put together and solved many in a task; before, all shared the rounds of one graph and each component was a dense solve of its own."""

import numpy as np
import pytest

from linework.operators import graph
from linework.plans import schematic


def component(rng, n, low=0.0):
    """Legs of a random tree of n stations, of which one is pinned: rigid, elastic and of two legs."""
    rows = [("", -1, -1, -1, "s0", None, None, 3.0, 4.0, None, None, None, None)]
    for i in range(1, n):
        ends = [f"s{i}", f"s{rng.integers(i)}"]
        for leg in range(int(rng.integers(1, 3))):
            turn, var = rng.integers(8) * np.pi / 4, f"len:L{i}:0.{leg}" if rng.random() < 0.6 else None
            rows.append((f"L{i}", i, 0, leg, *ends, var, np.sin(turn), np.cos(turn), float(rng.integers(1, 9)), low, np.inf, 1.0 + leg if var else None))
    names = ("line_id", "line_pos", "seg", "leg", "a", "b", "var", "dx", "dy", "preferred", "minimum", "maximum", "flex")
    return {c: np.array(x, object if c in ("line_id", "a", "b", "var") else float) for c, x in zip(names, zip(*rows, strict=True), strict=True)}


def test_trees_are_solved_together():
    rng = np.random.default_rng(3)
    parts = [component(rng, n) for n in (2, 4, 4, 4, 6, 2, 9)] + [component(rng, 4, low=20.0)]
    round_ = component(rng, 3)  # a fourth leg closes a circle
    more = {"line_id": "Z", "line_pos": 9.0, "seg": 0.0, "leg": 0.0, "a": "s0", "b": "s2", "var": "len:Z:0.0", "dx": 0.0, "dy": 1.0, "preferred": 2.0, "minimum": 0.0, "maximum": np.inf, "flex": 1.0}
    parts.append({c: np.append(x, np.array([more[c]], x.dtype)) for c, x in round_.items()})
    rows = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    part = np.repeat(np.arange(len(parts)), [len(p["a"]) for p in parts])
    done, ends, lengths = schematic.solve_trees(rows, part)
    assert done[:7].all() and not done[8]
    for i in np.flatnonzero(done):
        names, values = schematic.solve_component(schematic.equations(parts[i]))
        want = dict(zip(names, values, strict=True))
        at, own = ends["part"] == i, lengths["part"] == i
        got = {f"{axis}:{s}": v for axis in "xy" for s, v in zip(ends["name"][at], ends[axis][at], strict=True)} | dict(zip(lengths["name"][own], lengths["value"][own], strict=True))
        assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v], abs=1e-6) for v in want)


def test_lines_that_hang_together(spark, monkeypatch):
    rows = [("n", "1", "b", "c"), ("n", "2", "d", "c"), ("n", "3", "f", "e"), ("n", "4", "f", "f"), ("n", "5", "z", "z"), ("m", "1", "b", "a"), ("m", "1", "a", "c")]
    edges = spark.createDataFrame(rows, "net_id string, line_id string, a string, b string")
    want = {("n", "1", "n\x1fb"), ("n", "2", "n\x1fb"), ("n", "3", "n\x1fe"), ("n", "4", "n\x1fe"), ("m", "1", "m\x1fa")}
    assert {tuple(r) for r in graph.line_parts(edges, small=2).collect()} == want  # n by rounds, m in a task
    monkeypatch.setattr(graph, "components", None)
    assert {tuple(r) for r in graph.line_parts(edges).collect()} == want


def test_rounds_of_routes_group_instead_of_joining_all_states(spark, monkeypatch):
    """Before, each round joined all states with what became cheaper, and with what entering costs."""
    plans, real = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1])
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1)], "a long, b long, w long")
    at = lambda node: spark.createDataFrame([(7, node, 0)], "route long, node long, cost long")
    assert [tuple(r) for r in graph.routes(edges, at(1), at(3)).collect()] == [(7, 2.0, [1, 2, 3])]
    assert not any("FullOuter" in p for p in plans)
