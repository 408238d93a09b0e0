"""Queries on ground and groups that grow with the tables: density and group sizes stay the same at any scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from linework.functions import strings as X
from linework.operators import labels as L
from linework.operators import marks as M
from linework.operators import sequences, spatial
from linework.operators import tracks as T
from linework.plans.registry import BLOCKS_SQL, SQL, _boxes, _segments, big, joined, query
from linework.sources import adapters as A

SHEET = 320


def _on_sites(name: str) -> str:
    """The SQL of a query on points, on sites instead."""
    return SQL[name].replace(A.POINTS_SQL, A.SITES_SQL)


# ---- spatial joins, every row against every other


@query(f"""with p as ({A.SITES_SQL}) select a.id as a, b.id as b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d2 from p a join p b
    on a.id < b.id and a.x between b.x - 30 and b.x + 30 and a.y between b.y - 30 and b.y + 30 where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900""")
def near_sites(spark, sf_dir):
    p = A.sites(spark, sf_dir)
    dx, dy = F.col("x") - F.col("nx"), F.col("y") - F.col("ny")
    both = spatial.near(p, p.withColumnRenamed("id", "node"), 30)
    return both.where("id < node").select(F.col("id").alias("a"), F.col("node").alias("b"), (dx * dx + dy * dy).alias("d2"))


@query(f"""with p as ({A.SITES_SQL}), v as ({A.VISITORS_SQL}) select v.id, arg_min(p.id, ((v.x - p.x) * (v.x - p.x) + (v.y - p.y) * (v.y - p.y)) * 1000000000 + p.id) as node,
    min((v.x - p.x) * (v.x - p.x) + (v.y - p.y) * (v.y - p.y)) as d2 from v, p group by v.id""")
def nearest_site(spark, sf_dir):
    found = spatial.nearest(A.visitors(spark, sf_dir), A.sites(spark, sf_dir).withColumnRenamed("id", "node"), 16)
    return found.select("id", "node", F.round(F.col("d") * F.col("d")).cast("long").alias("d2"))


@query(_on_sites("box_overlaps"))
def site_overlaps(spark, sf_dir):
    return spatial.overlapping(_boxes(spark, sf_dir, A.sites), 32)


@query(_on_sites("segment_crossings"))
def street_crossings(spark, sf_dir):
    return spatial.crossings(_segments(spark, sf_dir, A.sites), 40).select("a", "b", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(_on_sites("crossed_families"))
def crossed_streets(spark, sf_dir):
    return spatial.crossed(_segments(spark, sf_dir, A.sites), 40).groupBy("seg").agg(F.count("*").alias("n"))


@query(_on_sites("segment_hits_box"))
def streets_at_boxes(spark, sf_dir):
    boxes = A.sites(spark, sf_dir).select(F.col("id").alias("box"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 6).alias("x1"), (F.col("y") + 9).alias("y1"))
    return spatial.hits(_segments(spark, sf_dir, A.sites), boxes, 40, 1)


@query(_on_sites("points_in_boxes"))
def sites_in_boxes(spark, sf_dir):
    return spatial.points_in_boxes(A.sites(spark, sf_dir).select("x", "y"), _boxes(spark, sf_dir, A.sites).withColumnRenamed("id", "box"), 32)


@query(_on_sites("nearest_segment").replace(" from p where id % 2 = 1", " from p").replace("s.seg % 2 = 0 and ", "s.seg <> q.id and "))
def nearest_street(spark, sf_dir):
    """Every site's nearest street of another site."""
    streets = _segments(spark, sf_dir, A.sites)
    return spatial.nearest_segment(A.sites(spark, sf_dir), streets, 25, apart=F.col("seg") != F.col("id")).select("id", F.round("d", 5).alias("d"))


@query(f"with p as ({A.SITES_SQL}), o as (select unnest(range(-3, 4)) as d) select distinct x + a.d as cx, y + b.d as cy from p, o a, o b where a.d * a.d + b.d * b.d <= 9")
def site_band(spark, sf_dir):
    return spatial.raster_band(A.sites(spark, sf_dir), 3)


# ---- sheets, columns and bundles


def _sheets(spark, sf_dir):
    sheet = F.floor(F.col("x") / SHEET) * 1_000_000 + F.floor(F.col("y") / SHEET)
    return A.sites(spark, sf_dir).withColumn("map_id", sheet.cast("long"))


@query()
def sheet_labels(spark, sf_dir):
    """Greedy placement on sheets of at most 400 sites each; sequential within a sheet, so SQL can't express it."""
    p = _sheets(spark, sf_dir)
    labels = p.select("map_id", "id", F.col("id").alias("first"), "x", "y", (F.col("id") % 30 + 20).alias("w"), F.lit(10).alias("h"))
    return L.placed(labels, p.select("map_id", "x", "y"))


@query()
def sheet_blocks(spark, sf_dir):
    """Name blocks on the same sheets, by all five ways of placing them; sequential within a sheet, so SQL can't express it."""
    p = _sheets(spark, sf_dir)
    n, x, y, one = F.col("id"), F.col("x").cast("double"), F.col("y").cast("double"), F.lit(1.0)
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    mark = [(x - 3).alias("mx0"), (y - 3).alias("my0"), (x + 3).alias("mx1"), (y + 3).alias("my1")]
    shift = [F.when(n % 5 == 4, x + 9).otherwise(n % 3).cast("double").alias("shift_x"), F.when(n % 5 == 4, y - 5).otherwise(0.0).alias("shift_y")]
    labels = p.select(
        "map_id", "id", n.alias("first"), pick(["auto", "beside", "toward", "corner", "fixed"]).alias("mode"), x.alias("x"), y.alias("y"), (n % 30 + 20).cast("double").alias("w"), (one * 10).alias("h"), (one * 4).alias("reach"),
        pick([u for u, _ in L.AROUND]).alias("ux"), pick([v for _, v in L.AROUND]).alias("uy"), *shift, (n % 2 == 0).alias("through"), (n % 3 == 0).alias("ends_only"), (one * 8).alias("font"), F.lit(1).alias("n_lines"), *mark,
    )
    r = lambda c: F.round(c, 4).alias(c)
    return L.settled(labels, p.select("map_id", "x", "y")).select("map_id", "id", *map(r, ("x0", "y0", "x1", "y1")))


@query(f"""with p as (select id, x // {SHEET} * 1000000 + y // {SHEET} as map_id, x, y from ({A.SITES_SQL})),
    e as (select map_id, 1 as level, id, '<path d="M' || x || ',' || y || '"/>' as text from p union all select map_id, 2, id, '<text>' || id || '</text>' from p)
    select map_id, row_number() over (partition by map_id order by level, id, text) as at, text from e""")
def sheet_elements(spark, sf_dir):
    p = _sheets(spark, sf_dir)
    s = lambda c: F.col(c).cast("string")
    path = p.select("map_id", F.lit(1).alias("level"), "id", F.concat(F.lit('<path d="M'), s("x"), F.lit(","), s("y"), F.lit('"/>')).alias("text"))
    name = p.select("map_id", F.lit(2).alias("level"), "id", F.concat(F.lit("<text>"), X.escape_xml(s("id")), F.lit("</text>")).alias("text"))
    return L.drawing_order(path.unionByName(name))


@query(f"""{BLOCKS_SQL.replace("line_id % 7", "line_id // 60")}, h as (select col, block, greatest(18 + (sum(n) - 1) * 14, count(*) * 18) as height from b group by col, block)
    select col, cast(block as bigint) as block, cast(height as bigint) as height, cast(coalesce(sum(height) over (partition by col order by block rows between unbounded preceding and 1 preceding), 0) as bigint) as top from h""")
def legend_columns(spark, sf_dir):
    """Columns of sixty lines at most."""
    key = F.concat((F.col("line_id") % 10).cast("string"), F.lit("."), F.col("line_id").cast("string"))
    rows = A.groups(spark, sf_dir).withColumn("key", key).withColumn("col", F.floor(F.col("line_id") / 60))
    h = sequences.islands(rows, ["col"], "key", F.col("grp"), "block").groupBy("col", "block").agg(F.greatest(18 + (F.sum("n") - 1) * 14, F.count("*") * 18).alias("height"))
    return sequences.running_boxes(h, ["col"], ["block"], F.col("height")).select("col", *big("block", "height"), F.col("offset").cast("long").alias("top"))


@query(SQL["badge_rows"].replace("id % 50", "id // 30"))
def badge_strips(spark, sf_dir):
    rows = A.names(spark, sf_dir).select("src", "id", F.floor(F.col("id") / 30).alias("row"), X.badge_width(F.col("name"), 8.0, 3.0).alias("width"))
    return sequences.running_boxes(rows, ["src", "row"], ["id"], F.col("width"), 2.0)


@query(SQL["mean_tracks"].replace("line_id % 10", "line_id // 5"))
def bundle_means(spark, sf_dir):
    """Bundles of five lines."""
    return T.mean_track(A.polylines(spark, sf_dir), F.floor(F.col("line_id") / 5), 21).select("bundle", "i", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


# ---- marks and badges


@query(f"""with p as ({A.SITES_SQL}), t as (select id, x::double as x, y::double as y, radians((id % 12 * 15)::double) as a, radians((id % 12 * 15 + 40 + id % 5 * 20)::double) as b, id % 7 <> 0 as joined, (id % 3) / 2::double as st, case id % 4 when 1 then 'a' when 2 then 'b' else '' end as keep from p),
    w as (select *, -sin(a) as ax, cos(a) as ay, -sin(b) as bx, cos(b) as by_, sin(b - a) as det, (pi() / 2 - (b - a)) * st / 2 as half from t),
    c as (select *, x + 3 - ay * (-3 * bx + 5 * by_) / det as mx, y + ax * (-3 * bx + 5 * by_) / det as my, a + pi() / 2 + case keep when 'a' then 0 when 'b' then -2 * half else -half end as fa, b + pi() / 2 + case keep when 'b' then 0 when 'a' then 2 * half else half end as fb from w),
    e as (select *, 2 * (sin(fb) - sin(fa)) / sin(fb - fa) as px, 2 * (cos(fa) - cos(fb)) / sin(fb - fa) as py, 2 * (sin(fb) + sin(fa)) / sin(fb - fa) as qx, 2 * (-cos(fa) - cos(fb)) / sin(fb - fa) as qy from c),
    u as (select id, 1 as mark, '1,2,3,4' as lines, mx as x, my as y, mx + px as x1, my + py as y1, greatest(sqrt(px * px + py * py), sqrt(qx * qx + qy * qy)) + 3 as reach, mx - greatest(abs(px), abs(qx)) - 3 as x0, greatest(abs(px * 0.6 + py * 0.8), abs(qx * 0.6 + qy * 0.8)) + 3 as along, 65 as n from e where joined
        union all select id, 1, '1,2', x + 3, y, null, null, 5, x + 3 - abs(ax) * 2 - 3, abs(ax * 0.6 + ay * 0.8) * 2 + 3, 9 from e where not joined
        union all select id, 2, '3,4', x, y + 5, null, null, 5, x - abs(bx) * 2 - 3, abs(bx * 0.6 + by_ * 0.8) * 2 + 3, 9 from e where not joined)
    select id, mark, lines, round(x, 4) + 0 as x, round(y, 4) + 0 as y, round(x1, 4) + 0 as x1, round(y1, 4) + 0 as y1, round(reach, 4) as reach, round(x0, 4) + 0 as x0, round(along, 4) as along, n from u""")
def station_crossings(spark, sf_dir):
    """Two bundles of two lines at each site; at most sites one mark covers their crossing, straightened by none, half or all."""
    p = A.sites(spark, sf_dir)
    first, second = F.radians((F.col("id") % 12 * 15).cast("double")), F.radians((F.col("id") % 12 * 15 + 40 + F.col("id") % 5 * 20).cast("double"))
    at = lambda k, side, r, x, y: F.struct(F.lit(str(k)).alias("line_id"), (F.col("x") + x - F.sin(r) * side).alias("x"), (F.col("y") + y + F.cos(r) * side).alias("y"), F.cos(r).alias("ux"), F.sin(r).alias("uy"))
    points = p.select(F.col("id").alias("station_id"), F.explode(F.array(at(1, 2, first, 3, 0), at(2, -2, first, 3, 0), at(3, 2, second, 0, 5), at(4, -2, second, 0, 5))).alias("p")).select("station_id", "p.*")
    crossings = p.where("id % 7 <> 0").select(F.col("id").alias("station_id"), (F.col("id") % 3 / 2).alias("straighten"), F.when(F.col("id") % 4 == 1, "1").when(F.col("id") % 4 == 2, "3").alias("keep"))
    marks = M.station_marks(points, 4.0, crossings)
    # a name in a select may mean the column made beside it, so what reads x and y comes first
    marks = marks.select("*", M.mark_reach(3.0).alias("reach"), M.mark_box(3.0)[0].alias("x0"), M.mark_extent(F.lit(0.6), F.lit(0.8), 3.0).alias("along"), F.size(M.mark_points(3.0)).alias("n"))
    r = lambda c: F.round(c, 4) + 0
    corner = F.get("corners", F.lit(0))
    return marks.select(
        F.col("station_id").alias("id"), F.when(F.array_contains("lines", "1"), 1).otherwise(2).alias("mark"), joined("lines"), r(F.col("x")).alias("x"), r(F.col("y")).alias("y"), r(corner["x"]).alias("x1"), r(corner["y"]).alias("y1"),
        F.round("reach", 4).alias("reach"), r(F.col("x0")).alias("x0"), F.round("along", 4).alias("along"), "n",
    )


SIDE_VALUES = ", ".join(f"({i}, '{n}', {u}::double, {v}::double, '{L.OPPOSITE[n]}')" for i, (n, (u, v)) in enumerate(L.SIDES.items()))


@query(f"""with p as ({A.SITES_SQL}), d(i, side, u, v, other) as (values {SIDE_VALUES}), o as (select a.i, a.side, b.u, b.v, b.side as other from d a join d b on b.side = a.other),
    l as (select id, x::double as sx, y::double as sy, o.*, id % 5 = 0 as hub, id % 6 = 0 as opp, id % 4 = 0 as above from p join o on o.i = id % 8),
    q as (select id, sx + id % 9 - 2 as x, sy + id % 4 as y from l union all select id, sx - 3, sy + 1 - id % 3 from l),
    f as (select id, greatest(max((x - sx) * u + (y - sy) * v), -1e9) as far, max((x - sx) * sign(u)) as fx, max((y - sy) * sign(v)) as fy, avg(y) as mean from l join q using (id) group by id),
    c as (select *, hub and abs(u) > 0.3 and abs(v) > 0.3 as corner, abs(u) > 0.3 and abs(v) <= 0.3 as beside from l join f using (id)),
    k as (select *, case when corner then sx + sign(u) * (fx + 6) else sx + u * (far + case when beside then 2.5 else 0 end) + u * 6 end as ox,
            case when corner then sy + sign(v) * fy + case when v > 0 then 13 else -7 end else case when beside then mean else sy + v * far end + case when v < -0.3 then v * 6 - 1 when v > 0.3 then v * 6 + 7 else 3 end end as oy,
            case when corner then case when u > 0 then 'start' else 'end' end when abs(u) < 0.3 then 'middle' when u > 0 then 'start' else 'end' end as oa, opp or (side = 'top_right' and not hub and not above) as over_there from c),
    g as (select id, case when over_there then 'corner' when above then 'above' else 'below' end as way, case when over_there then ox else sx + 4 end + id % 2 as lx, case when over_there then oa else 'middle' end as anchor,
            case when over_there then oy - 0.35::double * 9 - 4 when above then sy - 20 - 2 - 8 else sy + 5 + 2 + 1 end as up from k),
    b as (select id, k, k = id % 3 as hollow, 6 + (id + k) % 5::double as width, case when k = id % 3 then 1 else 0 end as more from p, (select unnest(range(1, 4)) as k)),
    w as (select *, width + 2 * more as wide, coalesce(sum(width + 2 * more + 2) over (partition by id order by k rows between unbounded preceding and 1 preceding), 0) as before, sum(width + 2 * more + 2) over (partition by id) - 2 as total from b join g using (id)),
    x as (select *, lx - case anchor when 'middle' then total / 2 when 'end' then total else 0 end + before as x0 from w)
    select id, k, way, round(x0, 4) + 0 as x0, round(up - more, 4) + 0 as y0, round(x0 + wide, 4) + 0 as x1, round(up + 8 + more, 4) + 0 as y1 from x""")
def badges_at_sites(spark, sf_dir):
    """Three badges at each site, whose name stands on one of eight sides: across the station, above the name or below it."""
    p = A.sites(spark, sf_dir).select("id", F.col("x").cast("double").alias("sx"), F.col("y").cast("double").alias("sy"))
    one, n = (F.lit(1.0), F.col("id"))
    pick = lambda i: F.get(F.array(*[F.lit(v[i]) for v in L.SIDES.values()]), (n % 8).cast("int"))
    labels = p.select(
        F.col("id").alias("station_id"), "sx", "sy", pick(0).alias("dx"), pick(1).alias("dy"), (n % 5 == 0).alias("hub"), (one * 2.5).alias("room"), (F.col("sx") + 4).alias("x"), (F.col("sy") + 5).alias("y"), F.lit("middle").alias("anchor"),
        (F.col("sy") - 20).alias("top"), (n % 6 == 0).alias("opposite"), (n % 4 == 0).alias("above"), (n % 2).cast("double").alias("nudge_x"), F.lit(None).cast("double").alias("nudge_y"),
    )
    points = p.select(n.alias("station_id"), F.explode(F.array(F.struct((F.col("sx") + n % 9 - 2).alias("x"), (F.col("sy") + n % 4).alias("y")), F.struct((F.col("sx") - 3).alias("x"), (F.col("sy") + 1 - n % 3).alias("y")))).alias("q")).select("station_id", "q.*")
    k = F.col("k")
    badges = p.withColumn("k", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)]))).select(n.alias("station_id"), k.alias("line_id"), (k == n % 3).alias("hollow"), (6 + (n + k) % 5).cast("double").alias("width"), k.alias("rank"))
    rows = L.badge_places(badges, labels, points, 6.0, 9.0, 8.0, 2.0, 1.0)
    r = lambda c: (F.round(c, 4) + 0).alias(c)
    return rows.select(F.col("station_id").alias("id"), F.col("line_id").alias("k"), "way", r("x0"), r("y0"), r("x1"), r("y1"))
