"""Queries of bundles, drawings and versions, with SQL; registered beside those of linework.plans.registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.functions import geometry as G
from linework.operators import bundles as B
from linework.operators import edges, graph, sequences
from linework.plans.registry import EDGES_SQL, LEGS, query
from linework.sources import adapters as A

# ---- stretches, corridors, curves

STRETCH_SQL = f"""{EDGES_SQL}, b as (select line_id, pos, ((45 + sum(turn) over (partition by line_id order by pos)) % 360 + 360) % 360 as d from l),
    f as (select u, v, a, line_id, pos, d from e join b using (line_id, pos) qualify row_number() over (partition by u, v order by line_id, pos) = 1),
    g as (select u, v, string_agg(distinct 'F' || line_id % 2, ',' order by 'F' || line_id % 2) as families from e group by u, v),
    s as (select u * 100000 + v as edge, a, case when a = u then v else u end as b, families, d from f join g using (u, v)),
    x as (select edge, families, a as station, d as out from s union all select edge, families, b, (d + 180) % 360 from s),
    sp as (select distinct x.edge as e1, y.edge as e2 from x join x y on x.families = y.families and x.station = y.station and y.out = (x.out + 180) % 360 and x.edge < y.edge)"""


def _stored(spark, sf_dir) -> DataFrame:
    """Edges as their first line drives them, with the bearings at both ends and all lines' families."""
    legs = A.legs(spark, sf_dir)
    b = sequences.running_bearing(legs, 45).select("line_id", "pos", F.col("bearing").cast("long").alias("bearing"))
    first = edges.first_use(legs).join(b, ["line_id", "pos"])
    family = edges.undirected(legs).select("u", "v", F.concat(F.lit("F"), (F.col("line_id") % 2).cast("string")).alias("f")).distinct()
    sets = family.groupBy("u", "v").agg(F.array_join(F.array_sort(F.collect_list("f")), ",").alias("families"))
    own = first.join(sets, ["u", "v"])
    return own.select((F.col("u") * 100000 + F.col("v")).alias("edge"), F.when(F.col("forward"), F.col("u")).otherwise(F.col("v")).alias("u"), F.when(F.col("forward"), F.col("v")).otherwise(F.col("u")).alias("v"), "families", F.col("bearing").alias("leaves"), F.col("bearing").alias("arrives"))


@query(f"{STRETCH_SQL} select e1, e2 from sp")
def stretch_pairs(spark, sf_dir):
    return B.stretch_pairs(_stored(spark, sf_dir))


@query(f"""{STRETCH_SQL.replace('with l as', 'with recursive l as', 1)}, q as (select e1, e2 from sp union select e2, e1 from sp), r(edge, root) as (select edge, edge from s union select q.e2, r.root from r join q on q.e1 = r.edge)
    select edge, min(root) as stretch from r group by edge""")
def stretch_ids(spark, sf_dir):
    return B.stretches(_stored(spark, sf_dir))


OFFSETS = {"F0": -1.0, "F1": 0.0, "F2": 1.0, "7": 2.5, "35": -2.5}


@query(f"""{EDGES_SQL}, f as (select u as lo, v as hi, a as u, b as v from e qualify row_number() over (partition by e.u, e.v order by line_id, pos) = 1),
    c as (select u as lo, v as hi, arg_max(a, line_id * 1000 + pos) as a from e where line_id % 3 = 0 group by e.u, e.v), w as (select distinct u as lo, v as hi, line_id from e)
    select f.u, f.v, line_id, (case when line_id = 7 then 2.5 when line_id = 35 then -2.5 else line_id % 4 - 1 end)::double * case when c.a = f.u then 1 else -1 end as slot
    from w join c using (lo, hi) join f using (lo, hi) where line_id in (7, 35) or line_id % 4 < 3""")
def corridor_slots(spark, sf_dir):
    """Every third line is a corridor; two lines have offsets of their own, of four families one has none."""
    legs = A.legs(spark, sf_dir)
    lines = sequences.steps_array(legs.where("line_id % 3 = 0"))
    corridors = lines.select(F.col("line_id").cast("string").alias("name"), F.col("line_id").alias("corridor_pos"), "steps", F.create_map(*[F.lit(x) for kv in OFFSETS.items() for x in kv]).alias("offsets"))
    own = F.when(F.col("forward"), F.struct("u", "v")).otherwise(F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    stored = edges.first_use(legs).select("u", "v", own.alias("e"))
    used = edges.undirected(legs).select("u", "v", "line_id").distinct().join(stored, ["u", "v"]).select("e.u", "e.v", "line_id", F.concat(F.lit("F"), (F.col("line_id") % 4).cast("string")).alias("family"))
    return B.corridor_slots(used, corridors, stored.select("e.u", "e.v"), strict=False)


#: Lines that walk on a grid of few lengths, so that many share legs; lanes by family, every fifth line changes its lane.
CURVE_SQL = f"""with l as ({LEGS}), b as (select line_id, pos, turn, len % 3 + 1 as n, radians(cast(45 + coalesce(sum(turn) over (partition by line_id order by pos rows between unbounded preceding and 1 preceding), 0) as double)) as r from l),
    w as (select *, sum(n * sin(r)) over w as wx, sum(n * cos(r)) over w as wy, lag(turn, 1, 0) over w as delta from b window w as (partition by line_id order by pos)),
    g as (select line_id, pos as k, line_id % 4 as family, round(coalesce(lag(wx) over w, 0), 4) + 0 as ax, round(coalesce(lag(wy) over w, 0), 4) + 0 as ay, round(wx, 4) + 0 as zx, round(wy, 4) + 0 as zy,
        cast(line_id % 4 as double) - 1.5::double + case when line_id % 5 = 0 and pos % 2 = 0 then 1 else 0 end as off, delta from w window w as (partition by line_id order by pos)),
    h as (select *, ax < zx or (ax = zx and ay < zy) as fwd, round((ax + zx) / 2, 6) + 0 as mx, round((ay + zy) / 2, 6) + 0 as my from g),
    m as (select mx, my, family, arg_max(case when fwd then off else -off end, line_id * 100 + k) as lane from h group by mx, my, family),
    c as (select h.line_id, h.k, h.family, h.ax, h.ay, h.off, p.off as p_off, h.mx, h.my, p.mx as pmx, p.my as pmy, h.fwd, p.fwd as p_fwd, (p.off + h.off) / 2 * 1.5::double as shift, sign(h.delta) as sgn from h join h p on p.line_id = h.line_id and p.k = h.k - 1 where h.delta <> 0),
    q as (select c.*, case when p_fwd then i.lane else -i.lane end - p_off as gap, case when fwd then o.lane else -o.lane end - off as gap2 from c join m i on i.mx = pmx and i.my = pmy and i.family <> c.family join m o on o.mx = c.mx and o.my = c.my and o.family = i.family),
    t as (select line_id, k, max(sgn * (shift + gap * 1.5::double)) as most, max(abs(gap)) > 1e-9 as beside from q where abs(gap - gap2) <= 1e-9 group by line_id, k),
    z as (select c.line_id, c.k, ax as x, ay as y, sgn, shift, greatest(sgn * shift, most) as innermost, coalesce(beside, false) as beside from c left join t using (line_id, k))"""


def _curve_legs(spark, sf_dir) -> DataFrame:
    legs = A.legs(spark, sf_dir).withColumn("n", F.col("len") % 3 + 1)
    line, far = sequences.line(), sequences.so_far()
    r = F.radians((F.coalesce(F.sum("turn").over(line.rowsBetween(sequences.Window.unboundedPreceding, -1)), F.lit(0)) + 45).cast("double"))
    w = legs.withColumn("dx", F.col("n") * F.sin(r)).withColumn("dy", F.col("n") * F.cos(r)).withColumn("wx", F.sum("dx").over(far)).withColumn("wy", F.sum("dy").over(far))
    at = lambda c: F.round(c, 4) + 0.0
    off = (F.col("line_id") % 4).cast("double") - 1.5 + F.when((F.col("line_id") % 5 == 0) & (F.col("pos") % 2 == 0), 1).otherwise(0)
    return w.select(
        "line_id", F.col("pos").alias("k"), (F.col("line_id") % 4).alias("family"), at(F.coalesce(F.lag("wx").over(line), F.lit(0.0))).alias("ax"), at(F.coalesce(F.lag("wy").over(line), F.lit(0.0))).alias("ay"),
        at(F.col("wx")).alias("bx"), at(F.col("wy")).alias("by"), off.alias("off"), F.coalesce(F.lag("turn").over(line), F.lit(0)).alias("delta"),
    )


@query(f"{CURVE_SQL} select line_id, k, round(shift, 6) + 0 as shift, round(innermost, 6) + 0 as innermost, beside from z")
def curve_bundles(spark, sf_dir):
    b = B.curve_bundle(_curve_legs(spark, sf_dir), 1.5)
    return b.select("line_id", "k", (F.round("shift", 6) + 0).alias("shift"), (F.round("innermost", 6) + 0).alias("innermost"), "beside")


@query(f"""{CURVE_SQL}, r as (select x, y, arg_max(4 + k % 3, line_id * 100 + k) as radius, arg_max(sgn * shift - innermost, line_id * 100 + k) as correction from z where line_id % 11 = 0 group by x, y)
    select x, y, radius::double as radius, round(correction, 6) + 0 as correction from r""")
def radius_targets(spark, sf_dir):
    """Every eleventh line gives the radius at its corners."""
    return _radius_targets(B.curve_bundle(_curve_legs(spark, sf_dir), 1.5))


def _radius_targets(b: DataFrame) -> DataFrame:
    wanted = b.where("line_id % 11 = 0").select("line_id", "x", "y", (F.col("line_id") * 100 + F.col("k")).alias("pos"), (4 + F.col("k") % 3).cast("double").alias("radius"))
    last = wanted.groupBy("line_id", "x", "y").agg(F.max_by("radius", "pos").alias("radius"), F.max("pos").alias("pos"))
    return B.radius_targets(b, last).select("x", "y", "radius", (F.round("correction", 6) + 0).alias("correction"))


@query(f"""{CURVE_SQL}, r as (select x, y, arg_max(4 + k % 3, line_id * 100 + k) as radius, arg_max(sgn * shift - innermost, line_id * 100 + k) as correction from z where line_id % 11 = 0 group by x, y),
    d as (select line_id, k, sgn, line_id % 13 = 0 as own, line_id % 17 = 0 as central, r.radius + r.correction as target, case when line_id % 17 = 0 then case when beside then shift else 0 end else sgn * (sgn * shift - innermost) end as offs from z left join r using (x, y))
    select line_id, k, round(greatest(0, case when own then 3 else coalesce(target, 2)::double - sgn * offs end), 6) as radius from d""")
def bundled_radii(spark, sf_dir):
    """Radii that lines draw: of their own, a reference line's, or the default for the innermost lane."""
    b = graph.kept(B.curve_bundle(_curve_legs(spark, sf_dir), 1.5))  # read by the lines that give radii and by those that take them
    t = _radius_targets(b)
    own, central = F.when(F.col("line_id") % 13 == 0, 3.0), F.col("line_id") % 17 == 0
    radius, offset, forced = B.corner_choice(own, F.col("radius"), F.col("correction"), F.lit(2.0), F.lit(True), F.col("sign"), F.col("shift"), F.col("innermost"), central, F.col("beside"))
    both = b.join(t, ["x", "y"], "left")
    return both.select("line_id", "k", F.round(G.corner_radius(F.col("sign") * 45, radius, F.lit(1.0), offset, forced), 6).alias("radius"))
