"""Graph operators without a limit on rounds, and simplification, against plain versions."""

import random

import pytest

from linework.errors import GeometryError
from linework.operators import graph, sequences


def pairs(spark, rows, names="a long, b long"):
    return spark.createDataFrame(rows, names)


def test_draw_order(spark):
    rng = random.Random(1)
    n = 60
    over = [(i, j) for i in range(n) for j in range(i) if rng.random() < 0.08] + [(5, 3)] * 3
    ids = pairs(spark, [(i,) for i in range(n + 3)], "id long")
    level = [0] * (n + 3)
    for i in range(n):
        level[i] = max([level[j] + 1 for u, j in over if u == i], default=0)
    for small in (0, 60, 100_000):  # by rounds alone, by both, in a task
        got = graph.draw_order(ids, pairs(spark, over, "upper long, lower long"), small).collect()
        assert sorted((r.id, r.level) for r in got) == list(enumerate(level))


def test_many_deep_orders_need_no_rounds(spark, monkeypatch):
    """Before, rounds went on until all heaps together had few pairs left: as many as the deepest one has levels."""
    monkeypatch.setattr(graph, "_frontiers", None)
    ids = pairs(spark, [(i,) for i in range(400)], "id long")
    over = pairs(spark, [(i, i - k) for i in range(400) for k in (1, 7) if i % 40 >= k], "upper long, lower long")
    assert sorted((r.id, r.level) for r in graph.draw_order(ids, over, 100).collect()) == [(i, i % 40) for i in range(400)]


def test_deep_order_and_cycle(spark):
    n = 300
    ids = pairs(spark, [(i,) for i in range(n)], "id long").coalesce(1)
    over = pairs(spark, [(i + 1, i) for i in range(n - 1)], "upper long, lower long").coalesce(1)
    got = graph.draw_order(ids, over).collect()
    assert sorted((r.id, r.level) for r in got) == [(i, i) for i in range(n)]
    ring = over.union(pairs(spark, [(0, n - 1)], "upper long, lower long"))
    with pytest.raises(GeometryError, match="circle"):
        graph.draw_order(ids, ring)
    tail = pairs(spark, [(1, 0), (2, 1), (3, 2), (2, 3), (4, 3)], "upper long, lower long")
    for small in (0, 100_000):
        with pytest.raises(GeometryError, match="circle"):
            graph.draw_order(pairs(spark, [(i,) for i in range(5)], "id long"), tail, small)


def test_bearings_over_a_thousand_lines(spark):
    n, rng = 1000, random.Random(2)
    names = list(range(n))
    rng.shuffle(names)
    delta = [rng.choice([0, 45, 90, 315]) for _ in range(n - 1)]
    shared = [(names[i], names[i + 1], delta[i]) if rng.random() < 0.5 else (names[i + 1], names[i], -delta[i]) for i in range(n - 1)]
    want, at = {}, 0
    for i in range(n):
        want[names[i]] = at % 360
        at += delta[i] if i < n - 1 else 0
    lines = pairs(spark, [(i, i) for i in range(n + 1)], "line_id long, line_pos long")
    edges = pairs(spark, shared, "a long, b long, delta long")
    starts = pairs(spark, [(names[700], want[names[700]] + 90)], "line_id long, bearing int")
    got = {r.line_id: r.bearing for r in graph.bearings(edges, starts, lines, 45).collect()}
    assert got == {k: (v + 90) % 360 for k, v in want.items()} | {n: 45}
    edges = pairs(spark, shared[:30], "a long, b long, delta long")
    starts = pairs(spark, [(names[20], 0)], "line_id long, bearing int")
    more = starts.union(pairs(spark, [(names[3], want[names[3]] - want[names[20]] + 45)], "line_id long, bearing int"))
    with pytest.raises(GeometryError, match="bearings"):
        graph.bearings(edges, more, lines, 45)
    loop = edges.union(pairs(spark, [(names[0], names[25], want[names[25]] + 45)], "a long, b long, delta long"))
    with pytest.raises(GeometryError, match="bearings"):
        graph.bearings(loop, starts, lines, 45)


def test_components(spark):
    rng = random.Random(5)
    for n, edges in ((400, [(i, i + 1) for i in range(399) if i % 150]), (300, [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]), (90, [(89, i) for i in range(80)]), (3, [])):
        names = rng.sample(range(n), n) if n != 90 else list(range(n))
        edges = [(names[a], names[b]) for a, b in edges]
        near = {}
        for a, b in edges:
            if a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        want = {}
        for x in sorted(near):
            todo = [x] if x not in want else []
            while todo:
                y = todo.pop()
                if y not in want:
                    want[y] = x
                    todo += near[y]
        assert {r.node: r.component for r in graph.components(pairs(spark, edges)).collect()} == want


def test_levels(spark):
    e = [(i, i + 1) for i in range(150)] + [(0, 40), (200, 201)]
    got = {r.node: r.level for r in graph.levels(pairs(spark, e), pairs(spark, [(0,), (149,), (0,)], "node long")).collect()}
    assert got == {i: min(i, abs(i - 40) + 1, abs(149 - i), 150) for i in range(151)}


def test_routes_take_the_smaller_of_equal_ways(spark):
    """All ways of a small graph, listed: the cheapest, then the smallest."""
    rng = random.Random(3)
    for zero in (False, True):
        edges = {(a, b): rng.randrange(0 if zero else 1, 3) for a in range(9) for b in range(a) if rng.random() < 0.45}
        both = edges | {(b, a): w for (a, b), w in edges.items()}

        def ways(at, seen, both=both):
            yield [*seen, at]
            for (a, b) in both:
                if a == at and b not in seen and b != at:
                    yield from ways(b, [*seen, at])

        asked = [(k, rng.sample(range(9), 2), rng.sample(range(9), 2)) for k in range(12)]
        want = {}
        for k, s, t in asked:
            every = [(i + sum(both[p, q] for p, q in zip(w, w[1:], strict=False)) + j, w) for i, a in enumerate(s) for w in ways(a, []) for j, b in enumerate(t) if w[-1] == b]
            if every:
                want[k] = min(every)
        e = pairs(spark, [(a, b, float(w)) for (a, b), w in edges.items()], "a long, b long, w double")
        sides = [pairs(spark, [(k, n, float(i)) for k, *x in asked for i, n in enumerate(x[side])], "route long, node long, cost double") for side in (0, 1)]
        got = {r.route: (r.cost, r.path) for r in graph.routes(e, *sides).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        if not zero:  # of ways of no length there may be several as small
            assert got == want
    with pytest.raises(GeometryError, match="negative"):
        graph.routes(pairs(spark, [(1, 2, -1.0)], "a long, b long, w double"), *sides)


def test_long_way(spark):
    e = pairs(spark, [(i, i + 1, 1.0) for i in range(70)], "a long, b long, w double").coalesce(1)
    end = lambda n: pairs(spark, [(1, n, 0.5)], "route long, node long, cost double")
    r = graph.routes(e, end(0), end(70)).first()
    assert (r.cost, r.path) == (71.0, list(range(71)))


def test_simplified(spark):
    def farthest(xy, lo, hi, tolerance):
        """Places that stay between lo and hi, by the contract's words."""
        (ax, ay), (bx, by) = xy[lo], xy[hi]
        size = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        gaps = [(abs((xy[k][1] - ay) * (bx - ax) - (xy[k][0] - ax) * (by - ay)) / size if size else ((xy[k][0] - ax) ** 2 + (xy[k][1] - ay) ** 2) ** 0.5, k) for k in range(lo + 1, hi)]
        top = max((g for g, _ in gaps), default=0)
        if top <= tolerance:
            return []
        at = min(k for g, k in gaps if g == top)
        return [*farthest(xy, lo, at, tolerance), at, *farthest(xy, at, hi, tolerance)]

    rng = random.Random(4)
    lines = {k: [(float(rng.randrange(40)), float(rng.randrange(40))) for _ in range(rng.randrange(1, 60))] for k in range(12)}
    lines[20] = [(0.0, 0.0), (1.0, 0.1), (2.0, -0.1), (3.0, 5.0), (4.0, 6.0), (5.0, 7.0), (6.0, 8.1), (7.0, 9.0), (8.0, 9.0), (9.0, 9.0)]
    lines[21] = [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 0.0)]
    rows = pairs(spark, [(k, i, x, y, "c") for k, xy in lines.items() for i, (x, y) in enumerate(xy)], "line_id long, pos long, x double, y double, note string")
    for tolerance in (0.0, 1.0, 6.5, 100.0):
        got = sequences.simplified(rows, tolerance)
        assert got.columns == rows.columns
        want = {(k, i) for k, xy in lines.items() for i in (range(len(xy)) if tolerance == 0 else {0, len(xy) - 1, *farthest(xy, 0, len(xy) - 1, tolerance)})}
        assert {(r.line_id, r.pos) for r in got.collect()} == want
    assert sequences.simplified(rows.limit(0), 1.0).count() == 0
