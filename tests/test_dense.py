"""Spatial joins on crowded and on wide ground, against brute force; and that a small table's joins are dealt over all tasks."""

import math
import random
from collections import Counter

import duckdb
import pytest

from linework.operators import marks, spatial
from linework.plans import registry


def segments(n, ground, seed=5):
    r = random.Random(seed)
    at = lambda: (r.randrange(ground), r.randrange(ground))
    return [(i, i % 3, x, y, x + r.randrange(-9, 10), y + r.randrange(-9, 10)) for i, (x, y) in ((i, at()) for i in range(n))]


def gap(px, py, s):
    _, _, ax, ay, bx, by = s
    dx, dy = bx - ax, by - ay
    n2 = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / n2)) if n2 else 0.0
    return math.hypot(px - ax - t * dx, py - ay - t * dy)


def meet(a, b):
    _, _, ax, ay, bx, by = a
    _, _, ox, oy, zx, zy = b
    dx, dy, ex, ey = bx - ax, by - ay, zx - ox, zy - oy
    det = dx * ey - dy * ex
    return ((((ox - ax) * ey - (oy - ay) * ex) / det), ((ox - ax) * dy - (oy - ay) * dx) / det) if det else None


SCHEMA = "seg long, family long, ax long, ay long, bx long, by long"


@pytest.mark.parametrize("ground", [12, 300])
def test_searches(spark, ground):
    segs = segments(150, ground)
    df = spark.createDataFrame(segs, SCHEMA)
    probes = [(i, x, y) for i, _, x, y, _, _ in segments(60, ground, 6)]
    p = spark.createDataFrame(probes, "id long, x long, y long")
    got = {r.id: r.d for r in spatial.nearest_segment(p, df, 25).collect()}
    want = {i: d for i, x, y in probes if (d := min(gap(x, y, s) for s in segs)) <= 25}
    assert got == pytest.approx(want)
    rays = [(s[0], *s[2:]) for s in segments(60, ground, 7)]
    first = {r.ray: r.t for r in spatial.first_on_rays(spark.createDataFrame(rays, "ray long, ax long, ay long, bx long, by long"), df, 40).collect()}
    hits = {ray[0]: [m[0] for s in segs if (m := meet((0, 0, *ray[1:]), s)) and 0 < m[0] <= 1 and 0 <= m[1] <= 1] for ray in rays}
    assert first == pytest.approx({k: min(v) for k, v in hits.items() if v})
    pairs = {(a[0], b[0]) for a in segs for b in segs if a[1] != b[1] and (m := meet(a, b)) and 0 < m[0] < 1 and 0 < m[1] < 1}
    assert sorted((r.a, r.b) for r in spatial.crossings(df, 40).collect()) == sorted(x for x in pairs if x[0] < x[1])
    assert sorted((r.seg, r.family) for r in spatial.crossed(df, 40).collect()) == sorted({(a, b % 3) for a, b in pairs})
    own = [(i, i % 2, x, y) for i, x, y in probes]
    lines = spark.createDataFrame([(s[0], s[0] % 2, *s[2:]) for s in segs], "seg long, line_id long, ax long, ay long, bx long, by long")
    on = marks.line_points(spark.createDataFrame(own, "station_id long, line_id long, x long, y long"), lines, 12.0).collect()
    near = {i: d for i, k, x, y in own if (d := min(gap(x, y, s) for s in segs if s[0] % 2 == k and s[2:4] != s[4:6])) <= 12}
    place = {i: (x, y) for i, x, y in probes}
    assert {r.station_id: math.hypot(r.x - place[r.station_id][0], r.y - place[r.station_id][1]) for r in on} == pytest.approx(near)


def test_dealt_over_tasks(spark):
    """Before, a table of one small file was joined in one task, or its cells were put together in a few."""
    df = spark.createDataFrame(segments(200, 60), SCHEMA)
    boxes = df.selectExpr("seg as id", "ax as x0", "ay as y0", "ax + 5 as x1", "ay + 5 as y1")
    least = 8 * spark.sparkContext.defaultParallelism
    named = boxes.withColumnRenamed("id", "box")
    for joined in (spatial.overlapping(boxes, 32), spatial.hits(df, named, 40, 1), spatial.crossings(df, 40)):
        assert joined.rdd.getNumPartitions() >= least


def touches(s, box, margin):
    """Clipped side by side."""
    (ax, ay, bx, by), (x0, y0, x1, y1) = s, box
    low, high = 0.0, 1.0
    for a, b, near, far in ((ax, bx, x0 - margin, x1 + margin), (ay, by, y0 - margin, y1 + margin)):
        if a == b:
            if not near <= a <= far:
                return False
        else:
            t = sorted(((near - a) / (b - a), (far - a) / (b - a)))
            low, high = max(low, t[0]), min(high, t[1])
    return low <= high


@pytest.mark.parametrize("ground, margin, shift", [(12, 1, 0), (150, 1, 0), (60, 0.25, 0.5)])
def test_segments_at_boxes(spark, monkeypatch, ground, margin, shift):
    """Places with many boxes, segments without length, ground on both sides of 0, fractions; each pair once, whatever is tested together."""
    monkeypatch.setattr(spatial, "TOGETHER", 3)
    segs = [(s[0], *(v - ground // 2 + shift for v in s[2:])) for s in segments(120, ground)] + [(900 + i, i - 3, 2, i - 3, 2) for i in range(6)]
    boxes = [(i, x - ground // 2, y - ground // 2, x - ground // 2 + i % 3 * 4, y - ground // 2 + 9) for i, _, x, y, _, _ in segments(100, ground, 8)] + [(500 + i, 2, 3, 8, 12) for i in range(20)]
    kind = "double" if shift else "long"
    frame = lambda rows, key, names: spark.createDataFrame([(r[0], *map(float if shift else int, r[1:])) for r in rows], f"{key} long, " + ", ".join(f"{n} {kind}" for n in names))
    got = spatial.hits(frame(segs, "seg", ("ax", "ay", "bx", "by")), frame(boxes, "box", ("x0", "y0", "x1", "y1")), 40, margin)
    assert Counter(map(tuple, got.collect())) == Counter((s[0], b[0]) for s in segs for b in boxes if touches(s[1:], b[1:], margin))


def test_boxes_at_one_place_are_tested_once(spark, monkeypatch, tmp_path):
    """Before, every box of a place was tested by itself, all of a task's were held in memory, and tasks grew with the table."""
    monkeypatch.setattr(spatial, "TASK_BOXES", 10)
    con = duckdb.connect()
    con.execute(f"copy (select a.a + 1009 * 1013 * b.b as p_partkey from range(300) a(a), range(5) b(b)) to '{tmp_path}/part.parquet' (format parquet)")
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    got = registry.segment_hits_box(spark, str(tmp_path))
    assert Counter(map(tuple, got.select("seg", "box").collect())) == Counter(con.execute(registry.SQL["segment_hits_box"]).fetchall())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(boxes") < plan.index("SortMergeJoin") and "HashJoin" not in plan
    assert got.rdd.getNumPartitions() >= 150
