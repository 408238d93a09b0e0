"""From definitions to a schematic layout: legs, shared edges, bearings, equations, coordinates.

All but the last solve are windows, groupings and joins; equations are solved for each connected component alone, so
many networks, and many parts of one, are solved side by side. Tables are those of linework.schema.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from linework.config import LAYOUT, Layout
from linework.errors import GeometryError, require_empty
from linework.functions import geometry as G
from linework.operators import graph

KEY = ["net_id", "line_id"]
#: columns of `solve`
SOLVED = "net_id string, component string, station string, x double, y double, var string, value double"


def check_definitions(stations: DataFrame, lines: DataFrame, steps: DataFrame) -> None:
    """The rules that a definition must keep; the first that fails raises GeometryError.

    Rules on a row are looked at together, in one pass over each table; those on stations and on lines take one grouping each.
    """
    stops, paths = steps.where("step_kind = 'station'"), "path.length < 0 or path.minimum < 0 or path.minimum > path.maximum or path.flex <= 0 or (not path.flexibility and path.length is null)"
    mentions = stations.select("net_id", "id", F.lit(1).alias("defined")).unionByName(stops.select("net_id", F.col("station_id").alias("id"), F.lit(0).alias("defined")))
    known = mentions.groupBy("net_id", "id").agg(F.sum("defined").alias("count"))
    # a closed line calls at its last station once more
    calls = stops.groupBy(*KEY, "station_id").agg(F.count("*").alias("n"), F.min("pos").alias("from"), F.max("pos").alias("to"))
    # only numbers are gathered, for which rows needn't be sorted: a line's first station is its last if one reaches over the whole line
    own = calls.groupBy(*KEY).agg(
        F.sum("n").alias("stops"), F.min("from").alias("from"), F.max("to").alias("to"), F.max(F.col("to").cast("long") - F.col("from")).alias("reach"), F.sum((F.col("n") > 1).cast("int")).alias("again"), F.max_by("n", "to").alias("at_end"),
    )
    own = lines.select(*KEY, F.coalesce("closed", F.lit(False)).alias("closed"), F.lit(True).alias("here")).join(own, KEY, "full_outer")
    once = "again - case when at_end > 1 then 1 else 0 end = 0 and at_end <= 2"
    rules = [
        (known, "count > 1", ["net_id", "id"], "station ids repeat"),
        (stations, "kind not in ('station', 'hub')", ["net_id", "id", "kind"], "unknown kind of station"),
        (lines, "color is null", KEY, "lines without a colour"),
        (lines, "spacing <= 0", KEY, "spacing isn't positive"),
        (lines, "start is not null and pmod(start, 45) <> 0", [*KEY, "start"], "a start isn't a multiple of 45"),
        (steps, "step_kind = 'turn' and (pmod(turn_delta, 45) <> 0 or turn_radius <= 0)", [*KEY, "pos", "turn_delta"], "a turn isn't a multiple of 45, or its radius isn't positive"),
        (steps, f"step_kind = 'path' and ({paths})", [*KEY, "pos"], "a path's lengths contradict each other"),
        (known, "count = 0 and id is not null", ["net_id", "id"], "unknown stations"),
        (steps, "step_kind = 'station' and (station_id is null or net_id is null)", [*KEY, "pos"], "unknown stations"),
        (own, "here and coalesce(stops, 0) < 2", KEY, "a line needs two stations at least"),
        (own, "closed and reach <> cast(to as long) - from", KEY, "a closed line doesn't end where it starts"),
        (own, f"not if(coalesce(closed, false), {once}, again = 0)", KEY, "a line calls at a station twice"),
    ]
    failed = set()
    for table in (known, stations, lines, steps, own):
        asked = [i for i, r in enumerate(rules) if r[0] is table]
        found = table.agg(*[F.coalesce(F.bool_or(F.expr(rules[i][1])), F.lit(False)).alias(str(i)) for i in asked]).first()
        failed |= {i for i in asked if found[str(i)]}
    for i in sorted(failed):
        table, bad, shown, message = rules[i]
        require_empty(table.where(bad).select(*shown), message)


def check_corridors(corridors: DataFrame) -> None:
    """shift_at is a place on an edge: start, middle or end."""
    require_empty(corridors.where("coalesce(shift_at, 'middle') not in ('start', 'middle', 'end')").select("net_id", "name", "shift_at"), "a lane doesn't change there")


def check_trains(groups: DataFrame) -> None:
    """Train groups have one to four cars, of which at most all are hollow."""
    require_empty(groups.where("cars not between 1 and 4").select(*KEY, "pos", "cars"), "a train has one to four cars")
    require_empty(groups.where("hollow not between 0 and cars").select(*KEY, "pos", "hollow"), "more hollow cars than cars")


def check_layers(layers: DataFrame) -> None:
    """Layers (map_id, layer_pos, layer) are lines, which have a stroke, or areas."""
    require_empty(layers.where("layer.kind is null or layer.kind not in ('line', 'area')").select("map_id", "layer_pos", "layer.kind"), "a layer is of lines or areas")
    require_empty(layers.where("layer.kind = 'line' and coalesce(layer.stroke, '') = ''").select("map_id", "layer_pos"), "a layer of lines needs a stroke")


def legs(lines: DataFrame, steps: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """One row for each leg: net_id, line_id, line_pos, seg, a, b, leg, offset (bearing from the line's start), elastic, preferred,
    minimum, maximum, flex, group, the corner before it (delta, radius, forced), and the number of its path steps.

    A turn ends the leg before it; a path step describes the leg that it stands in. Legs are the steps that end them, a turn or the
    next station, so that only these are sorted by legs, not all steps.
    """
    line = Window.partitionBy(*KEY).orderBy("pos", "_rest")
    so_far, before = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, -1)
    # a station's step that holds more is two, of which the station is the first
    more = F.col("turn_delta").isNotNull() | F.col("turn_radius").isNotNull() | F.col("path").isNotNull()
    none = lambda c: F.lit(None).cast(steps.schema[c].dataType).alias(c)
    rest = ("turn_delta", "turn_radius", "path")
    station, other = F.struct(F.lit(0).alias("_rest"), "station_id", *map(none, rest)), F.struct(F.lit(1).alias("_rest"), none("station_id"), *rest)
    own = F.when(F.col("station_id").isNull(), F.array(other)).when(more, F.array(station, other)).otherwise(F.array(station))
    s = graph.spread(steps.select(*KEY, "pos", F.explode(own).alias("s")).select(*KEY, "pos", "s.*"), steps.count(), *KEY)
    s = s.withColumns({"seg": F.count("station_id").over(so_far), "bend": F.count("turn_delta").over(before), "a": F.last("station_id", True).over(before)})
    latest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("seg", "bend", c))).over(so_far)
    s = s.withColumns({"_radius": latest("turn_radius"), "_path": latest("path"), "_paths": F.count(F.when((F.col("seg") > 0) & F.col("path").isNotNull(), 1)).over(so_far)})
    # a station ends the last leg of the segment before it
    s = s.withColumn("seg", F.when(F.col("station_id").isNotNull(), F.col("seg") - 1).otherwise(F.col("seg"))).where("seg > 0 and (station_id is not null or turn_delta is not null)")
    here = lambda c, name: F.when((F.col(f"{c}.seg") == F.col("seg")) & (F.col(f"{c}.bend") == F.col("bend")), F.col(f"{c}.{name}")).alias(name)
    s = s.withColumn("paths", F.col("_paths") - F.lag("_paths", 1, 0).over(line))
    by = s.select(*KEY, "seg", "bend", "a", F.col("station_id").alias("b"), F.col("turn_delta").alias("turn"), here("_radius", "turn_radius"), here("_path", "path"), "paths")
    # with the lines before the windows, one sort does for all of them
    by = by.join(lines.select(*KEY, "line_pos", "spacing").hint("merge"), KEY)
    order, whole = Window.partitionBy(*KEY, "seg").orderBy("bend"), Window.partitionBy(*KEY, "seg")
    all_ = Window.partitionBy(*KEY).orderBy("seg", "bend")
    before_ = F.sum("turn").over(all_.rowsBetween(Window.unboundedPreceding, -1))
    by = by.withColumn("offset", F.pmod(F.coalesce(before_, F.lit(0)), F.lit(360)).cast("int"))
    by = by.withColumns({"b": F.max("b").over(whole), "_first": F.min("bend").over(whole), "_last": F.max("bend").over(whole)}).where("b is not null")
    out = by.withColumns({"leg": F.col("bend") - F.col("_first"), "turns": F.col("_last") - F.col("_first")})
    tangent = F.when(F.col("turn").isNotNull(), F.coalesce(F.col("turn_radius") * G.tangent_factor(F.col("turn")), F.col("spacing") / 2))
    radius = F.coalesce("turn_radius", G.curve_radius(F.col("turn"), layout))
    out = out.withColumns({"_t": tangent, "_curve": F.when(F.col("turn").isNotNull(), radius), "_forced": F.col("turn_radius").isNotNull()})
    out = out.withColumns({"_lag_t": F.lag("_t").over(order), "delta": F.lag("turn").over(order), "radius": F.lag("_curve").over(order), "forced": F.lag("_forced").over(order)})
    out = out.withColumn("default", F.coalesce("_t", "_lag_t", "spacing"))
    elastic = F.coalesce(F.col("path.flexibility"), F.lit(False))
    untouched = (F.col("turns") == 0) & F.col("path").isNull()
    preferred = F.coalesce(F.col("path.length"), F.when(elastic, F.col("spacing")).otherwise(F.col("default")))
    out = out.withColumn("elastic", elastic).withColumn("preferred", preferred)
    out = out.withColumn("minimum", F.when(elastic, F.coalesce("path.minimum", F.lit(layout.min_gap))).when(untouched, F.lit(layout.min_gap)).otherwise(F.col("preferred")))
    out = out.withColumn("maximum", F.when(elastic, F.coalesce("path.maximum", F.lit(float("inf")))).otherwise(F.col("preferred")))
    room = F.coalesce(F.col("radius") * G.tangent_factor(F.col("delta")), F.lit(0.0))
    out = out.withColumn("_room", room + F.coalesce(F.lead(room).over(order), F.lit(0.0)))
    for name in ("minimum", "preferred", "maximum"):
        out = out.withColumn(f"_{name}", F.when(F.col("elastic"), F.greatest(name, "_room")).otherwise(F.col(name)))
    return out.select(
        *KEY, "line_pos", "seg", "a", "b", "leg", "offset", "elastic", F.col("_preferred").alias("preferred"), F.col("_minimum").alias("minimum"), F.col("_maximum").alias("maximum"),
        F.when(F.col("elastic"), F.coalesce("path.flex", F.lit(1.0))).alias("flex"), F.col("path.group").alias("group"), "delta", "radius", "forced", "paths",
    )


def segments(legs_: DataFrame) -> DataFrame:
    """One row for each pair of stations: its legs' shape in driving direction and the other way, first and last bearing.

    Rigid legs of no length don't count for the shape.
    """
    r = lambda c: F.round(c, 8)
    one = F.struct("leg", "offset", "elastic", r("preferred").alias("preferred"), r("minimum").alias("minimum"), r("maximum").alias("maximum"), r("flex").alias("flex"))
    by = legs_.groupBy("net_id", "line_id", "line_pos", "seg", "a", "b").agg(F.array_sort(F.collect_list(one)).alias("all"))
    by = by.withColumn("legs", F.filter("all", lambda x: x["elastic"] | (x["preferred"] > 0))).withColumn("legs", F.when(F.size("legs") > 0, F.col("legs")).otherwise(F.col("all")))
    first, last = F.element_at("legs", 1)["offset"], F.element_at("legs", -1)["offset"]
    shape = lambda legs, base: F.transform(legs, lambda x: F.struct(F.pmod(x["offset"] - base, F.lit(360)).alias("turned"), x["elastic"], x["preferred"], x["minimum"], x["maximum"], x["flex"]))
    # every bearing of the reverse is 180 degrees off, which the difference to its own first one doesn't show
    return by.select(
        "net_id", "line_id", "line_pos", "seg", "a", "b", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), first.alias("first"), last.alias("last"),
        shape("legs", first).alias("shape"), shape(F.reverse("legs"), last).alias("reverse"),
    )


def shared(segments_: DataFrame) -> DataFrame:
    """(net_id, base, other, delta, same): each edge's later segments against its first, in line order."""
    edge = Window.partitionBy("net_id", "u", "v")
    both = segments_.withColumn("base", F.min_by(F.struct("line_id", "seg", "a", "first", "last", "shape"), F.struct("line_pos", "line_id", "seg")).over(edge)).where("line_id <> base.line_id or seg <> base.seg")
    along = F.col("a") == F.col("base.a")
    delta = F.when(along, F.col("base.first") - F.col("first")).otherwise(F.col("base.last") - F.col("first") + 180)
    same = F.when(along, F.col("shape") == F.col("base.shape")).otherwise(F.col("reverse") == F.col("base.shape"))
    return both.select("net_id", F.col("base.line_id").alias("base"), F.col("line_id").alias("other"), "u", "v", F.pmod(delta, F.lit(360)).cast("int").alias("delta"), same.alias("same"))


def met_again(legs_: DataFrame) -> DataFrame:
    """The legs of edges on which more than one segment runs: only those can be shared."""
    u, v, more = F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), Observation()
    often = legs_.where("leg = 0").groupBy("net_id", u, v).agg(F.count("*").alias("n")).where("n > 1").select("net_id", "u", "v")
    often = graph.kept(often.observe(more, F.count(F.lit(1)).alias("n")))
    if not more.get["n"]:
        return legs_.where(F.lit(False))
    return legs_.withColumns({"u": F.least("a", "b"), "v": F.greatest("a", "b")}).join(often.hint("merge"), ["net_id", "u", "v"], "left_semi").drop("u", "v")


def start_bearings(lines: DataFrame, shared_: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """(net_id, line_id, bearing) of every line."""
    require_empty(shared_.where("not same").select("net_id", "u", "v", "base", "other"), "lines that share an edge differ in its shape")
    own = lambda c: F.concat_ws("\x1f", "net_id", c)
    pairs = shared_.where("base <> other")
    tied = graph.kept(pairs.select("net_id", F.explode(F.array("base", "other")).alias("line_id")).distinct())
    alone = lines.join(tied.hint("merge"), KEY, "left_anti").select(*KEY, F.pmod(F.coalesce("start", F.lit(layout.default_start)), F.lit(360)).cast("int").alias("bearing"))
    lines = lines.join(tied.hint("merge"), KEY, "left_semi")
    found = graph.bearings(
        pairs.select(own("base").alias("a"), own("other").alias("b"), "delta"),
        lines.where("start is not null").select(own("line_id").alias("line_id"), F.col("start").alias("bearing")),
        lines.select(own("line_id").alias("line_id"), "line_pos"), layout.default_start,
    )
    loops = shared_.where("base = other and delta <> 0").select("net_id", "base", "u", "v")
    require_empty(loops, "contradictory bearings")
    part = lambda i: F.split("line_id", "\x1f")[i]
    return found.select(part(0).alias("net_id"), part(1).alias("line_id"), F.col("bearing").cast("int").alias("bearing")).unionByName(alone)


def check_groups(legs_: DataFrame, layout: Layout = LAYOUT) -> None:
    """Elastic legs of one group of a line are one unknown and agree in what they ask for."""
    off = F.lit(False)
    for c in ("preferred", "minimum", "maximum", "flex"):
        off = off | ~((F.max(c) == F.min(c)) | (F.max(c) - F.min(c) <= layout.agreement))
    by = legs_.where("elastic and group is not null").groupBy(*KEY, "group").agg(off.alias("off"))
    require_empty(by.where("off").select(*KEY, "group"), "legs of one group differ in their lengths")


def solve_component(rows: dict[str, np.ndarray], layout: Layout = LAYOUT) -> tuple[list[str], np.ndarray]:
    """Least squares of one component: coordinates near nothing, lengths near what they prefer, all equations kept.

    rows: columns of kind 'eq' (eq, var, coef, rhs) and 'var' (var, preferred, minimum, maximum, flex, ordinal). Bounds are
    added one by one, the worst violated first, until all hold. Returns the unknowns' names and values.
    """
    is_var = rows["kind"] == "var"
    order = np.flatnonzero(is_var)[np.argsort(rows["ordinal"][is_var].astype(str), kind="stable")]
    lens = {c: rows[c][order] for c in ("preferred", "minimum", "maximum", "flex")}
    elastic = rows["var"][order].tolist()
    eq, var, coef, right_ = (rows[c][~is_var].tolist() for c in ("eq", "var", "coef", "rhs"))
    coords = sorted(set(var) - set(elastic))
    names = [*coords, *elastic]
    place = {v: i for i, v in enumerate(names)}
    number = {e: i for i, e in enumerate(sorted(set(eq)))}
    a, b = np.zeros((len(number), len(names))), np.zeros(len(number))
    for e, v, c, r in zip(eq, var, coef, right_, strict=True):
        a[number[e], place[v]] += c
        b[number[e]] = r
    weight = np.concatenate((np.full(len(coords), layout.regularisation), 1 / lens["flex"].astype(float) ** 2))
    target = np.concatenate((np.zeros(len(coords)), lens["preferred"].astype(float)))
    low = np.concatenate((np.full(len(coords), -np.inf), lens["minimum"].astype(float)))
    high = np.concatenate((np.full(len(coords), np.inf), lens["maximum"].astype(float)))
    pinned: dict[int, float] = {}
    n = len(names)
    for _ in range(len(elastic) + 1):
        fixed = np.zeros((len(pinned), n))
        fixed[np.arange(len(pinned)), list(pinned)] = 1
        full, right = np.vstack((a, fixed)), np.concatenate((b, list(pinned.values())))
        m = len(full)
        kkt = np.block([[np.diag(weight), full.T], [full, np.zeros((m, m))]])
        z = np.linalg.lstsq(kkt, np.concatenate((weight * target, right)), rcond=None)[0][:n]
        if np.abs(full @ z - right).max(initial=0) > layout.residual:
            raise GeometryError(f"contradictory lengths in the component of {coords[0] if coords else names[0]}")
        over = np.maximum(low - z, z - high)
        over[list(pinned)] = -np.inf
        worst = int(np.argmax(over)) if n else 0
        if not n or over[worst] <= layout.bound_slack:
            return names, z
        pinned[worst] = low[worst] if low[worst] > z[worst] else high[worst]
    raise GeometryError("length bounds don't settle")


def equations(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The rows of `solve_component` of one component's legs and pins."""
    eq, elastic = {}, {}
    order = np.lexsort((rows["leg"], rows["seg"], rows["line_pos"]))
    columns = ("a", "b", "line_id", "seg", "var", "dx", "dy", "preferred", "minimum", "maximum", "flex")
    for a, b, line, seg, var, dx, dy, *length in zip(*(rows[c][order].tolist() for c in columns), strict=True):
        for axis, d in (("x", dx), ("y", dy)):
            right, terms = eq.setdefault((line, seg, axis, b is None), ([], defaultdict(float)))
            if not right:
                right.append(0.0)
                terms[f"{axis}:{a}"] += 1.0 if b is None else -1.0
                if b is not None:
                    terms[f"{axis}:{b}"] += 1.0
            if b is None:
                right[0] = d
            elif var is None:
                right[0] += d * length[0]
            else:
                terms[var] -= d
        if var is not None:
            elastic.setdefault(var, length)
    flat = [("eq", i, v, c, right[0], None, None, None, None, None) for i, (right, terms) in enumerate(eq.values()) for v, c in terms.items()]
    flat += [("var", None, v, None, None, *length, i) for i, (v, length) in enumerate(elastic.items())]
    out = {c: np.array(x, object) for c, x in zip(("kind", "eq", "var", "coef", "rhs", "preferred", "minimum", "maximum", "flex", "number"), zip(*flat, strict=True), strict=True)}
    return out | {"ordinal": np.array([None if n is None else f"{n:09d}" for n in out["number"]], object)}


def solve_trees(rows: dict[str, np.ndarray], part: np.ndarray, layout: Layout = LAYOUT) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The same least squares for many components at once, where nothing goes round: as many segments as stations but one, and one pin.

    part: each row's component from 0, ascending. Each coordinate then follows from the lengths, so that these alone are solved for. Returns which components are solved
    (others go round, or a bound doesn't hold), each row's first station as a number, and stations and lengths as columns part, name and values.
    """
    n = int(part[-1]) + 1

    def numbered(of: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each key's number from 0 within its component, the components of the distinct keys, where each stands first, and how many a component has."""
        code = of.astype(np.int64)
        for key in keys:
            own, names = pd.factorize(key)
            code = code * max(len(names), 1) + own
        _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        count = np.bincount(of[first], minlength=n)
        start = np.concatenate(([0], np.cumsum(count)[:-1]))
        return inverse - start[of], of[first], first, count

    leg = np.flatnonzero(~pd.isna(rows["b"]))
    pin = np.flatnonzero(pd.isna(rows["b"]))
    both = np.concatenate((rows["a"], rows["b"][leg]))
    station, station_part, station_first, stations = numbered(np.concatenate((part, part[leg])), both)
    a, b = station[: len(part)], np.zeros(len(part), np.int64)
    b[leg] = station[len(part) :]
    seg, _, seg_first, segs = numbered(part[leg], rows["line_id"][leg], rows["seg"][leg])
    row = np.zeros(len(part), np.int64)
    row[leg] = seg
    pins = np.bincount(part[pin], minlength=n)
    row[pin] = segs[part[pin]]  # the only one, where it is used
    order = leg[np.lexsort((rows["leg"][leg], rows["seg"][leg], rows["line_pos"][leg], part[leg]))]
    free = order[~pd.isna(rows["var"][order])]
    place, length_part, length_first, lengths = numbered(part[free], rows["var"][free])
    column = np.zeros(len(part), np.int64)
    column[free] = place
    rigid = np.ones(len(part), bool)
    rigid[free] = False
    rigid[pin] = False

    done = np.zeros(n, bool)
    tree = (segs + 1 == stations) & (pins == 1)
    values = {c: np.zeros(len(station_part)) for c in "xy"} | {"value": np.zeros(len(length_part))}
    at_station, at_length = np.concatenate(([0], np.cumsum(stations)))[:-1], np.concatenate(([0], np.cumsum(lengths)))[:-1]
    shape = np.where(tree, stations * (int(lengths.max()) + 1) + lengths, -1)
    for kind in np.unique(shape[tree]):
        own = np.flatnonzero(shape == kind)
        s, k, g = int(stations[own[0]]), int(lengths[own[0]]), len(own)
        index = np.full(n, -1)
        index[own] = np.arange(g)
        here = lambda i: i[index[part[i]] >= 0]  # noqa: E731, B023
        between, right, terms = np.zeros((g, s, s)), np.zeros((2, g, s)), np.zeros((2, g, s, k))
        once, fixed, stiff, soft = here(leg[seg_first]), here(pin), here(np.flatnonzero(rigid)), here(free)
        np.add.at(between, (index[part[once]], row[once], b[once]), 1.0)
        np.add.at(between, (index[part[once]], row[once], a[once]), -1.0)
        between[index[part[fixed]], row[fixed], a[fixed]] = 1.0
        for axis, c in enumerate(("dx", "dy")):
            right[axis][index[part[fixed]], row[fixed]] = rows[c][fixed]
            np.add.at(right[axis], (index[part[stiff]], row[stiff]), rows[c][stiff] * rows["preferred"][stiff])
            np.add.at(terms[axis], (index[part[soft]], row[soft], column[soft]), rows[c][soft])
        # coordinates are spot + reach @ lengths
        both_ = np.linalg.solve(between[None], np.concatenate((right[..., None], terms), -1))
        spot, reach = both_[..., 0], both_[..., 1:]
        asked = free[length_first].reshape(-1)
        asked = asked[index[part[asked]] >= 0]
        want, low, high, flex = (rows[c][asked].astype(float).reshape(g, k) for c in ("preferred", "minimum", "maximum", "flex"))
        weight = 1 / flex**2
        normal = layout.regularisation * np.einsum("agsk,agsl->gkl", reach, reach)
        normal[:, np.arange(k), np.arange(k)] += weight
        found = np.linalg.solve(normal, (weight * want - layout.regularisation * np.einsum("agsk,ags->gk", reach, spot))[..., None])[..., 0]
        x, y = spot + np.einsum("agsk,gk->ags", reach, found)
        ok = np.maximum(low - found, found - high).max(axis=1, initial=-np.inf) <= layout.bound_slack
        done[own[ok]] = True
        spread = (at_station[own][:, None] + np.arange(s)).ravel()
        values["x"][spread], values["y"][spread] = x.ravel(), y.ravel()
        values["value"][(at_length[own][:, None] + np.arange(k)).ravel()] = found.ravel()
    ends = {"part": station_part, "name": both[station_first], "x": values["x"], "y": values["y"]}
    return done, ends, {"part": length_part, "name": rows["var"][free][length_first], "value": values["value"]}


def solve(lines: DataFrame, legs_: DataFrame, bearings: DataFrame, layout: Layout = LAYOUT) -> DataFrame:
    """(net_id, component, station, x, y, var, value): a row for each station and one for each length.

    A component without an anchored line puts its first station at (40 * its number, 0). What travels to the solves are legs, not the terms of
    their equations.
    """
    check_groups(legs_, layout)
    n = legs_.count()
    segs = legs_.where("leg = 0")
    parts = graph.line_parts(segs.select(*KEY, "a", "b"))
    heads = segs.groupBy(*KEY, "line_pos").agg(F.min_by("a", "seg").alias("a"), F.min("seg").alias("seg"))
    heads = heads.join(parts.hint("merge"), KEY).join(bearings.hint("merge"), KEY).join(lines.select(*KEY, "anchor").hint("merge"), KEY)
    heads = graph.kept(heads.select(*KEY, "component", "bearing", "anchor", "a", F.struct("line_pos", "seg").alias("ordinal")))
    first = heads.groupBy("net_id", "component").agg(F.min_by("a", "ordinal").alias("a"), F.min("ordinal").alias("ordinal"), F.count("anchor").alias("anchors"))
    number = F.row_number().over(Window.partitionBy("net_id").orderBy("ordinal")) - 1
    free = first.withColumn("number", number).where("anchors = 0").select("net_id", "component", F.lit("").alias("line_id"), "a", (F.col("number") * layout.component_gap).cast("double").alias("dx"), F.lit(0.0).alias("dy"))
    pins = free.unionByName(heads.where("anchor is not null").select("net_id", "component", "line_id", "a", F.col("anchor.x").alias("dx"), F.col("anchor.y").alias("dy")))

    rad = F.radians(F.col("bearing") + F.col("offset"))
    var = F.when(F.col("elastic"), F.concat_ws(":", F.lit("len"), "line_id", F.coalesce(F.concat(F.lit("group "), "group"), F.concat_ws(".", "seg", "leg"))))
    # a task reads its legs once past its lines' heads, of which it has as many as legs at most, and holds no legs
    dealt = graph.spread(legs_, n, *KEY).join(heads.select(*KEY, "component", "bearing").hint("shuffle_hash"), KEY)
    rows = dealt.select("net_id", "component", "line_id", "line_pos", "seg", "leg", "a", "b", var.alias("var"), F.sin(rad).alias("dx"), F.cos(rad).alias("dy"), "preferred", "minimum", "maximum", "flex")
    rows = rows.unionByName(pins, allowMissingColumns=True).fillna({"line_pos": -1, "seg": -1, "leg": -1})

    def table(n: int, columns: dict) -> pd.DataFrame:
        kind = {"x": float, "y": float, "value": float}
        return pd.DataFrame({c: pd.Series(columns.get(c), index=range(n), dtype=kind.get(c, object)) for c in ("net_id", "component", "station", "x", "y", "var", "value")})

    def solved(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(frame):
            return
        columns = {c: frame[c].to_numpy() for c in frame.columns}
        net, part = columns["net_id"], columns["component"]
        new = np.flatnonzero((net[1:] != net[:-1]) | (part[1:] != part[:-1])) + 1
        at = np.concatenate(([0], new))
        done, ends, lengths = solve_trees(columns, np.repeat(np.arange(len(at)), np.diff(np.append(at, len(frame)))), layout)
        for found in (ends, lengths):
            ok = done[found["part"]]
            own = at[found["part"][ok]]
            name = {"station" if found is ends else "var": found["name"][ok]}
            yield table(len(own), {"net_id": net[own], "component": part[own]} | name | {c: found[c][ok] for c in ("x", "y", "value") if c in found})
        for i in np.flatnonzero(~done).tolist():
            lo, hi = at[i], at[i + 1] if i + 1 < len(at) else len(frame)
            names, values = solve_component(equations({c: x[lo:hi] for c, x in columns.items()}), layout)
            value = dict(zip(names, values.tolist(), strict=True))
            stations = [v[2:] for v in names if v.startswith("x:")]
            yield table(len(stations), {"net_id": net[lo], "component": part[lo], "station": stations, "x": [value[f"x:{v}"] for v in stations], "y": [value[f"y:{v}"] for v in stations]})
            own = [v for v in names if v.startswith("len:")]
            yield table(len(own), {"net_id": net[lo], "component": part[lo], "var": own, "value": [value[v] for v in own]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the open component, which may reach over many batches and is put together once
        for frame in frames:
            if not len(frame):
                continue
            net, part = frame["net_id"].to_numpy(), frame["component"].to_numpy()
            other = np.flatnonzero((net != net[-1]) | (part != part[-1]))
            start = int(other[-1]) + 1 if len(other) else 0
            if held and (start or held[0]["net_id"].iloc[0] != net[0] or held[0]["component"].iloc[0] != part[0]):
                yield from solved(pd.concat([*held, frame[:start]], ignore_index=True))
                held = []
            elif start:
                yield from solved(frame[:start])
            held.append(frame[start:])
        if held:
            yield from solved(pd.concat(held, ignore_index=True))

    # many small components in a task, each whole and its rows together
    ordered = graph.spread(rows, n, "net_id", "component").sortWithinPartitions("net_id", "component")
    return ordered.mapInPandas(run, SOLVED)


def residuals(terms: DataFrame, solution: DataFrame, part: str) -> DataFrame:
    """(part, eq, residual) of equations (part, eq, var, coef, rhs) under (var, value): what a solution leaves.

    An equation is of one part, such as a line, that has few unknowns. Terms stay where their part is: each part asks once for each of its
    unknowns, and what travels are those and their values, not the terms. Values are dealt over as many tasks as the terms, else Spark would
    deal the side of fewer tasks once more.
    """
    asked = terms.select(part, "var").distinct().join(solution.hint("merge"), "var")
    tasks = graph.dealt_over(terms, part)
    values = (asked.repartition(tasks, part) if tasks else asked).groupBy(part).agg(F.map_from_entries(F.collect_list(F.struct("var", "value"))).alias("_values"))
    known = terms.join(values.hint("merge"), part).where(F.map_contains_key("_values", F.col("var")))
    return known.groupBy(part, "eq").agg((F.sum(F.col("coef") * F.try_element_at("_values", F.col("var"))) - F.first("rhs")).alias("residual"))


def solution(solved: DataFrame) -> DataFrame:
    """(net_id, component, var, value): x:station, y:station and lengths."""
    one = lambda axis: F.struct(F.concat_ws(":", F.lit(axis), "station").alias("var"), F.col(axis).alias("value"))
    each = F.when(F.col("station").isNotNull(), F.array(one("x"), one("y"))).otherwise(F.array(F.struct("var", "value")))
    return solved.select("net_id", "component", F.explode(each).alias("v")).select("net_id", "component", "v.*")


def layout(stations: DataFrame, lines: DataFrame, steps: DataFrame, config: Layout = LAYOUT) -> dict[str, DataFrame]:
    """All phases: legs, segments, shared, bearings, solution, coordinates."""
    stations, lines, steps = (graph.kept(t) for t in (stations, lines, steps))  # the rules read them again and again
    check_definitions(stations, lines, steps)
    own = graph.kept(legs(lines, steps, config))
    require_empty(own.where("paths > 1").select(*KEY, "a", "b"), "two paths on one leg")
    own = own.drop("paths")
    common = graph.kept(shared(segments(met_again(own))))
    found = graph.kept(start_bearings(lines, common, config))
    solved = graph.kept(solve(lines, own, found, config))
    xy = solved.where("station is not null").select("net_id", "station", "x", "y")
    return {"legs": own, "segments": segments(own), "shared": common, "bearings": found, "solution": solution(solved), "coordinates": xy}
