"""Stretches against their definition, on edges that meet twice or at one station with both ends."""

import random

from linework.operators import bundles


def straight(edges):
    ends = lambda e: [(e[1], e[4] % 360), (e[2], (e[5] + 180) % 360)]
    return {(a[0], b[0]) for a in edges for b in edges if a[0] < b[0] and a[3] == b[3] and any(s == t and p == (q + 180) % 360 for s, p in ends(a) for t, q in ends(b))}


def test_pairs_and_links(spark):
    r = random.Random(3)
    edges = [(i, r.randrange(4), r.randrange(4), "FG"[i % 2], r.randrange(8) * 45, r.randrange(8) * 45) for i in range(80)]
    df = spark.createDataFrame(edges, "edge long, u long, v long, families string, leaves long, arrives long")
    want = straight(edges)
    assert sorted(map(tuple, bundles.stretch_pairs(df).collect())) == sorted(want)  # each once
    low = {e[0]: e[0] for e in edges}
    for _ in edges:
        for a, b in want:
            low[a] = low[b] = min(low[a], low[b])
    assert {s.edge: s.stretch for s in bundles.stretches(df).collect()} == low


def test_links_grow_with_edges(spark):
    """A hub where hundreds of edges run straight into hundreds: two links at most for each edge, not their product."""
    edges = spark.range(600).selectExpr("id as edge", "0L as u", "id + 1 as v", "'F' as families", "id % 2 * 180 as leaves", "id % 2 * 180 + 45 as arrives")
    assert bundles.stretch_pairs(edges).count() == 300 * 300
    assert bundles.stretch_links(edges).count() <= 1200
    assert {s.stretch for s in bundles.stretches(edges).collect()} == {0}


def test_corners_are_one_window(spark):
    """Before, legs were made twice and joined with themselves. Legs that repeat meet each other, gaps and null keys have no corner."""
    kinds = "line_id string, k int, family long, ax double, ay double, bx double, by double, off double, delta int"
    leg = lambda line, k, off, delta: (line, k, 1, float(k or 0), 0.0, 1.0, 1.0, off, delta)
    rows = [leg("1", 1, 0.5, 0), leg("1", 2, 1.0, 45), leg("1", 2, 1.0, 45), leg("1", 3, 2.0, -45), leg("1", 5, 3.0, 45), leg("1", 6, 4.0, 0), leg("1", 7, 5.0, None), leg("1", None, 6.0, 45), leg("2", 2, 7.0, 45), leg(None, 1, 8.0, 0), leg(None, 2, 9.0, 45)]
    found = bundles.corners(spark.createDataFrame(rows, kinds))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.line_id, r.k, r.off, r.delta, r.p_ax, r.p_ay, r.p_bx, r.p_by, r.p_off) for r in found.collect())
    assert got == [("1", 2, 1.0, 45, 1.0, 0.0, 1.0, 1.0, 0.5)] * 2 + [("1", 3, 2.0, -45, 2.0, 0.0, 1.0, 1.0, 1.0)] * 2
