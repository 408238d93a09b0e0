"""Iterative joins over station graphs. Every round is written to the shared folder, so no lineage grows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from linework.errors import require_empty
from linework.storage import Rounds, written


def kept(df: DataFrame) -> DataFrame:
    return written(df, "graph")


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) in both directions, once."""
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reached, for every node of edges (a, b) that has another.

    Every node hooks to its smallest neighbour, hooks are followed to their ends by doubling, and what became one node is contracted: of
    the nodes of an edge only those smaller than all their neighbours are left, so a few rounds end any graph, and edges shrink with each.
    Joins are merged: tables of nodes are small as files, and a broadcast would send all of a round's nodes through the driver.
    """
    e, ups = kept(both_ways(edges)), []
    while True:
        up = kept(e.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        while True:
            moved = Observation()
            on = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")).hint("merge"), "up")
            up = kept(on.observe(moved, F.max((F.col("top") != F.col("up")).cast("int")).alias("any")).select("node", F.col("top").alias("up")))
            if not moved.get["any"]:  # counted as the round was written, without a job of its own
                break
        ups.append(up)
        left = Observation()
        end = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"{c}_")).hint("merge")  # noqa: E731, B023
        short = e.join(end("a"), "a").join(end("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b")).where("a <> b").distinct()
        e = kept(short.observe(left, F.count(F.lit(1)).alias("n")))
        if not left.get["n"]:
            break
    found = ups.pop()
    while ups:
        found = ups.pop().join(found.select(F.col("node").alias("up"), F.col("up").alias("top")).hint("merge"), "up", "left").select("node", F.coalesce("top", "up").alias("up"))
    return kept(found.select("node", F.col("up").alias("component")))


def spread(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """n rows dealt by the keys over so many tasks that one has about 250,000 of them."""
    return rows.repartition(max(n // 250_000 + 1, rows.sparkSession.sparkContext.defaultParallelism), *keys)


def dealt_over(rows: DataFrame, key: str) -> int | None:
    """Over how many tasks the rows' plan has dealt them by the key, None if it hasn't; nothing is run."""
    plan = rows._jdf.queryExecution().executedPlan()
    how = (plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan).outputPartitioning().toString()
    found = re.search(rf"hashpartitioning\({re.escape(key)}#\d+L?, (\d+)\)", how)
    return int(found[1]) if found else None


def line_parts(edges: DataFrame, small: int = 100_000) -> DataFrame:
    """(net_id, line_id, component): the smallest station that a line reaches, behind its network's name; edges: (net_id, line_id, a, b).

    Networks of at most `small` edges are put together in one task each, many side by side; larger ones by the rounds of `components`. Lines
    that only lead from a station to itself and meet no other are absent.
    """
    most = Observation()
    size = kept(edges.groupBy("net_id").agg(F.count("*").alias("n")).observe(most, F.max("n").alias("most"), F.sum("n").alias("n")))
    heavy = (most.get["most"] or 0) > small
    few = edges.join(size.where(F.col("n") > small).hint("merge"), "net_id", "left_anti") if heavy else edges
    found = _joined(spread(few, most.get["n"] or 0, "net_id").sortWithinPartitions("net_id"))
    if heavy:
        many = kept(edges.join(size.where(F.col("n") > small).hint("merge"), "net_id", "left_semi"))
        own = lambda c: F.concat_ws("\x1f", "net_id", c)
        ends = many.groupBy("net_id", "line_id").agg(F.min("a").alias("a")).select("net_id", "line_id", own("a").alias("node"))
        found = found.unionByName(ends.join(components(many.select(own("a").alias("a"), own("b").alias("b"))).hint("merge"), "node").select("net_id", "line_id", "component"))
    return found


def _joined(edges: DataFrame) -> DataFrame:
    """line_parts of edges whose networks lie whole in a partition, one after the other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up, ends, net = {}, {}, None

        def top(x: str) -> str:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def closed() -> list[tuple]:
            return [(net, line, f"{net}\x1f{top(a)}") for line, a in ends.items() if a in up]

        for frame in frames:
            out: list[tuple] = []
            for n, line, a, b in zip(*(frame[c].tolist() for c in ("net_id", "line_id", "a", "b")), strict=True):
                if n != net:
                    out += closed()
                    up, ends, net = {}, {}, n
                ends.setdefault(line, a)
                if a != b:
                    up.setdefault(a, a), up.setdefault(b, b)
                    u, v = top(a), top(b)
                    up[max(u, v)] = min(u, v)
            yield pd.DataFrame(out, columns=["net_id", "line_id", "component"])
        yield pd.DataFrame(closed(), columns=["net_id", "line_id", "component"])

    return edges.select("net_id", "line_id", "a", "b").mapInPandas(run, "net_id string, line_id string, component string")


def levels(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, level): steps from the nearest of starts (node). Unreached nodes are absent.

    A round joins the last level alone: what lies beside it is on it, on the one before or new.
    """
    e, found = kept(both_ways(edges)), Rounds(edges.sparkSession, "levels")
    front, n = found.add(starts.select("node").distinct())
    before = front.limit(0)
    while n:
        step = e.join(front.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        before, (front, n) = front, found.add(step.join(front, "node", "left_anti").join(before, "node", "left_anti"))
    return found.all(edges.sparkSession).select("node", F.col("round").alias("level"))


def potentials(edges: DataFrame, modulus: int) -> DataFrame:
    """(node, root, offset): each node's value is its root's plus the offset; the root is the smallest node that it reaches.

    edges: (a, b, delta): value of b = value of a + delta, modulo `modulus`. Contraction as in `components`, with differences added up on
    the way: a chain of n edges in any order needs about log n rounds. Where edges contradict each other one of them is taken,
    which is left to the caller to find.
    """
    wrap = lambda c: F.pmod(c, F.lit(modulus))
    e = edges.where("a <> b").select("a", "b", wrap(F.col("delta")).cast("long").alias("delta"))
    e, ups = kept(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), wrap(-F.col("delta")).alias("delta"))).distinct()), []
    while True:
        # a's value is b's less delta; a node smaller than its neighbours stands for itself
        least = F.least(F.struct(F.col("a").alias("to"), F.lit(0).cast("long").alias("off")), F.col("near"))
        up = kept(e.groupBy("a").agg(F.min(F.struct(F.col("b").alias("to"), wrap(-F.col("delta")).alias("off"))).alias("near")).select(F.col("a").alias("node"), least.alias("up")).select("node", "up.*"))
        while True:
            moved = Observation()
            on = up.join(up.select(F.col("node").alias("to"), F.col("to").alias("top"), F.col("off").alias("more")), "to")
            up = kept(on.observe(moved, F.max((F.col("top") != F.col("to")).cast("int")).alias("any")).select("node", F.col("top").alias("to"), wrap(F.col("off") + F.col("more")).alias("off")))
            if not moved.get["any"]:
                break
        ups.append(up)
        left = Observation()
        end = lambda c: up.select(F.col("node").alias(c), F.col("to").alias(f"{c}_"), F.col("off").alias(f"{c}_off"))  # noqa: E731, B023
        short = e.join(end("a"), "a").join(end("b"), "b").where("a_ <> b_").select(F.col("a_").alias("a"), F.col("b_").alias("b"), wrap(F.col("delta") + F.col("a_off") - F.col("b_off")).alias("delta")).distinct()
        e = kept(short.observe(left, F.count(F.lit(1)).alias("n")))
        if not left.get["n"]:
            break
    found = ups.pop()
    while ups:
        on = ups.pop().join(found.select(F.col("node").alias("to"), F.col("to").alias("top"), F.col("off").alias("more")), "to", "left")
        found = on.select("node", F.coalesce("top", "to").alias("to"), wrap(F.col("off") + F.coalesce("more", F.lit(0))).alias("off"))
    return kept(found.select("node", F.col("to").alias("root"), F.col("off").alias("offset")))


def bearings(shared: DataFrame, starts: DataFrame, lines: DataFrame, default: int) -> DataFrame:
    """(line_id, bearing): start bearings spread over shared edges.

    shared: (a, b, delta): bearing of b = bearing of a + delta, modulo 360. starts: (line_id, bearing). lines: (line_id,
    line_pos); the first line of each component without a start takes the default. A contradiction raises GeometryError.
    """
    own = lines.join(potentials(shared, 360).withColumnRenamed("node", "line_id"), "line_id", "left")
    own = kept(own.select("line_id", "line_pos", F.coalesce("root", "line_id").alias("root"), F.coalesce("offset", F.lit(0)).cast("int").alias("offset")))
    given = own.join(starts.select("line_id", "bearing"), "line_id").groupBy("root").agg(*[f(F.pmod(F.col("bearing") - F.col("offset"), F.lit(360))).alias(n) for f, n in ((F.min, "base"), (F.max, "top"))])
    first = own.groupBy("root").agg(F.min_by("offset", F.struct("line_pos", "line_id")).alias("offset"))
    base = kept(first.join(given, "root", "left").select("root", F.coalesce("base", F.pmod(F.lit(default) - F.col("offset"), F.lit(360))).alias("base"), "top"))
    require_empty(base.where("top <> base").select("root", "base", "top"), "contradictory bearings")
    known = kept(own.join(base, "root").select("line_id", F.pmod(F.col("base") + F.col("offset"), F.lit(360)).alias("bearing")))
    there = shared.join(known.select(F.col("line_id").alias("a"), F.col("bearing").alias("ba")), "a").join(known.select(F.col("line_id").alias("b"), F.col("bearing").alias("bb")), "b")
    require_empty(there.where("pmod(ba + delta - bb, 360) <> 0").select("a", "b", "ba", "bb"), "contradictory bearings")
    return known


def smoothed(nodes: DataFrame, edges: DataFrame, factor: float) -> DataFrame:
    """One half-step of smoothing: nodes (node, x, y) with two neighbours or more move by factor towards their mean."""
    near = both_ways(edges).join(nodes.select(F.col("node").alias("b"), F.col("x").alias("nx"), F.col("y").alias("ny")), "b")
    mean = near.groupBy(F.col("a").alias("node")).agg(F.avg("nx").alias("nx"), F.avg("ny").alias("ny"), F.count("*").alias("n"))
    move = lambda c: (F.col(c) + F.when(F.col("n") >= 2, factor * (F.col(f"n{c}") - F.col(c))).otherwise(0.0)).alias(c)
    return nodes.join(mean, "node", "left").select("node", move("x"), move("y"))


def draw_order(ids: DataFrame, over: DataFrame, small: int = 100_000) -> DataFrame:
    """(id, level): how many lines lie below at least; over: (upper, lower). A cycle raises GeometryError.

    Lines that hang together by at most `small` pairs are peeled whole in one task, many such heaps side by side. Larger heaps are peeled
    from below: a round takes those off that lie over no line which is left, and joins them alone with what lies over them. Once at
    most `small` pairs are left, one task peels the rest. What never comes off lies in a circle, or above one.
    """
    spark, kind = ids.sparkSession, ids.schema["id"].dataType.simpleString()
    e = over.select("upper", "lower").distinct().join(ids.select(F.col("id").alias("lower")), "lower", "left_semi")
    e = kept(e.join(ids.select(F.col("id").alias("upper")), "upper", "left_semi"))
    require_empty(e.where("upper = lower").select(F.col("upper").alias("id")), "lines lie over each other in a circle")
    heap = components(e.select(F.col("upper").alias("a"), F.col("lower").alias("b"))).select(F.col("node").alias("upper"), "component")
    e, pairs = e.join(heap, "upper"), Observation()
    size = kept(e.groupBy("component").agg(F.count("*").alias("n")).observe(pairs, F.sum(F.when(F.col("n") <= small, F.col("n"))).alias("few"), F.max("n").alias("most")))
    few, most = pairs.get["few"] or 0, pairs.get["most"] or 0
    e = e.join(size, "component")
    found = ids.select("id").distinct().join(heap.select(F.col("upper").alias("id")), "id", "left_anti").select("id", F.lit(0).alias("level"))
    if few:
        rest = e.where(F.col("n") <= small).select("component", "upper", "lower")
        found = found.unionByName(_peeled(rest.repartition(max(few // small + 1, spark.sparkContext.defaultParallelism), "component"), kind))
    if most > small:
        large = heap.join(size.where(F.col("n") > small), "component", "left_semi").select(F.col("upper").alias("id"))
        found = found.unionByName(_frontiers(kept(large), kept(e.where(F.col("n") > small).select("upper", "lower")), small))
    return found


def _frontiers(ids: DataFrame, e: DataFrame, small: int) -> DataFrame:
    """(id, level) of draw_order, a round for each level, until at most `small` pairs e (upper, lower) are left."""
    spark, kind = ids.sparkSession, ids.schema["id"].dataType.simpleString()
    below = e.groupBy(F.col("upper").alias("id")).agg(F.count("*").alias("missing"))
    taken = Rounds(spark, "order")
    both, left = taken.add(ids.join(below, "id", "left").select("id", F.coalesce("missing", F.lit(0)).alias("missing")), F.sum("missing"))
    while left > small:
        freed = both.where("missing = 0").select(F.col("id").alias("lower"))
        hit = e.join(freed, "lower").groupBy(F.col("upper").alias("id")).agg(F.count("*").alias("gone"))
        step = both.where("missing > 0").join(hit, "id", "left").select("id", (F.col("missing") - F.coalesce("gone", F.lit(0))).alias("missing"))
        before = left
        both, left = taken.add(step, F.sum("missing"))
        if left == before:
            require_empty(both.select("id"), "lines lie over each other in a circle")
    done = taken.all(spark).where("missing = 0").select("id", F.col("round").alias("level"))
    if not left:
        return done
    here = both.select(F.col("id").alias("lower"))
    rest = e.join(both.where("missing > 0").select(F.col("id").alias("upper")), "upper").join(here, "lower").select("upper", "lower")
    # the lines taken last are level 0 of the rest and counted already
    peeled = _peeled(rest.repartition(1), kind).where("level > 0").select("id", (F.col("level") + taken.count - 1).alias("level"))
    return done.unionByName(peeled)


def _peeled(pairs: DataFrame, kind: str) -> DataFrame:
    """(id, level) of pairs (upper, lower), each partition's by itself: what lies over none of its lines is level 0, and -1 what never comes off."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above, missing, lowers = defaultdict(list), Counter(), set()
        for frame in frames:
            for upper, lower in zip(frame["upper"].tolist(), frame["lower"].tolist(), strict=True):
                above[lower].append(upper)
                missing[upper] += 1
                lowers.add(lower)
        level = {x: 0 for x in lowers if not missing[x]}
        free = list(level)
        while free:
            x = free.pop()
            for y in above[x]:
                level[y] = max(level.get(y, 0), level[x] + 1)
                missing[y] -= 1
                if not missing[y]:
                    free.append(y)
        out = [(x, n) for x, n in level.items() if not missing[x]] + [(x, -1) for x, n in missing.items() if n]
        if out:
            yield pd.DataFrame(out, columns=["id", "level"])

    found = kept(pairs.select("upper", "lower").mapInPandas(run, f"id {kind}, level int"))
    require_empty(found.where("level < 0").select("id"), "lines lie over each other in a circle")
    return found


def _weighted(edges: DataFrame) -> DataFrame:
    """(a, b, w) in both directions, the lightest of parallel ones. Negative weights have no cheapest ways: an error."""
    require_empty(edges.where("w < 0").select("a", "b", "w"), "negative weights")
    return kept(edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.min("w").alias("w")))


def reached(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, cost): cheapest way from sources (node, cost) over weighted edges (a, b, w), by relaxing the nodes that
    became cheaper; for graphs of any size."""
    e = _weighted(edges)
    best = kept(sources.groupBy("node").agg(F.min("cost").alias("cost")))
    front = best
    while True:
        step = e.join(front.select(F.col("node").alias("a"), "cost"), "a").groupBy(F.col("b").alias("node")).agg(F.min(F.col("cost") + F.col("w")).alias("new"))
        both = kept(best.join(step, "node", "full_outer"))
        front = both.where("new is not null and (cost is null or new < cost)").select("node", F.col("new").alias("cost"))
        if front.isEmpty():
            return best
        best = both.select("node", F.least("cost", "new").alias("cost"))


def routes(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(route, cost, path): the cheapest way of each route from any of its sources to any of its targets, all at once.

    edges: (a, b, w), both ways, w >= 0; sources and targets: (route, node, cost), the cost of entering or leaving there. Of equal
    ways the one with the smaller path is taken; routes without a way are absent.

    Costs are relaxed backwards from the targets, so that a state (route, node) has what is left to pay from there, and how many steps:
    its width is fixed however long ways are. A state as dear as its route's best way is followed no further. Then each state knows its next node, the
    smallest on a cheapest way, and ways are put together by doubling: a round joins to each place of a way the node as many steps ahead as
    places are known.
    """
    e = _weighted(edges)
    enter = kept(sources.groupBy("route", "node").agg(F.min("cost").cast("double").alias("enter")))
    kind = "struct<cost:double,steps:int>"
    none = F.lit(None)
    # a state knows what entering there costs, so that a round is one join with the edges and one grouping; sources are states before they are reached
    old = enter.select("route", "node", none.cast(kind).alias("old"), none.cast(kind).alias("new"), "enter")
    step = targets.select("route", "node", none.cast(kind).alias("old"), F.struct(F.col("cost").cast("double").alias("cost"), F.lit(0).alias("steps")).alias("new"), none.cast("double").alias("enter"))
    while True:
        fresh = Observation()
        by = old.unionByName(step).groupBy("route", "node").agg(F.min("old").alias("old"), F.least(F.min("old"), F.min("new")).alias("s"), F.min("enter").alias("enter"))
        both = by.select("route", "node", "s", "enter", (F.col("s").isNotNull() & (F.col("old").isNull() | (F.col("s") < F.col("old")))).alias("fresh"))
        both = kept(both.observe(fresh, F.count_if("fresh").alias("n")))
        if not fresh.get["n"]:
            break
        bound = both.where("enter is not null and s is not null").groupBy("route").agg(F.min(F.col("s.cost") + F.col("enter")).alias("bound"))
        live = both.where("fresh").join(bound, "route", "left").where("bound is null or s.cost < bound").select("route", F.col("node").alias("b"), "s")
        on = F.struct((F.col("s.cost") + F.col("w")).alias("cost"), (F.col("s.steps") + 1).alias("steps"))
        step = live.join(e, "b").select("route", F.col("a").alias("node"), none.cast(kind).alias("old"), on.alias("new"), none.cast("double").alias("enter"))
        old = both.select("route", "node", F.col("s").alias("old"), none.cast(kind).alias("new"), "enter")
    best = both.where("s is not null").select("route", "node", "s")
    found = best.join(enter, ["route", "node"]).groupBy("route").agg(F.min(F.struct((F.col("s.cost") + F.col("enter")).alias("cost"), "node")).alias("way"))
    found = kept(found.select("route", "way.cost", "way.node"))
    onward = best.where("s.steps > 0").select("route", F.col("node").alias("a"), F.col("s").alias("here")).join(e, "a")
    onward = onward.join(best.select("route", F.col("node").alias("b"), "s"), ["route", "b"]).where("here.cost = s.cost + w and (w > 0 or here.steps > s.steps)")
    ahead = kept(onward.groupBy("route", F.col("a").alias("node")).agg(F.min("b").alias("to")))
    places, reach = kept(found.select("route", F.lit(0).alias("place"), "node")), 1
    while True:
        more = places.join(ahead, ["route", "node"]).select("route", (F.col("place") + reach).alias("place"), F.col("to").alias("node"))
        new = Observation()
        places = kept(places.unionByName(more.observe(new, F.count(F.lit(1)).alias("n"))))
        if not new.get["n"]:
            break
        further = ahead.withColumnsRenamed({"node": "via", "to": "node"}).join(ahead, ["route", "node"])
        ahead, reach = kept(further.select("route", F.col("via").alias("node"), "to")), 2 * reach
    path = places.groupBy("route").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda p: p["node"]).alias("path"))
    return found.join(path, "route").select("route", "cost", "path")
