"""Names and signs along tracks: where a name stands, on which side, its letters one by one, blocks and badges beside it.

points: (line_id, pos, x, y), y downwards. names: (name_id, line_id, text, ax, ay, bx, by, side, shift, start): a text of one line or more beside
line_id between two stations a and b, read from a to b. `side` is left, right or null for the side with less under it; `shift` moves the middle
along the track; with `start` the text begins so far behind a. Names meet the track by (line, stretch of 64) and other tracks by cells,
so no name sees more than what lies around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.errors import require_empty
from linework.functions import strings as X
from linework.operators import marks, spatial
from linework.operators.graph import kept
from linework.operators.sequences import arc_length, moving_average, resampled

# The font's size, the lines' width, a row's height and where its baseline lies as parts of the font.
FONT, LINE_WIDTH, ROW, BASE = 9.0, 3.6, 1.1, 0.72
STRETCH = 64


def served(names: DataFrame, steps: DataFrame) -> DataFrame:
    """names (name_id, a, b, line_id) with the first line (line_pos) that drives from a to b or back where none is given; without one an error."""
    beyond = F.lead("station_id").over(Window.partitionBy("line_id").orderBy("pos"))
    pair = lambda a, b: [F.least(a, b).alias("_u"), F.greatest(a, b).alias("_v")]
    driven = steps.withColumn("next", beyond).where("next is not null").select("line_id", "line_pos", *pair("station_id", "next"))
    first = driven.groupBy("_u", "_v").agg(F.min_by("line_id", F.struct("line_pos", "line_id")).alias("_line"))
    out = names.select("*", *pair("a", "b")).join(first, ["_u", "_v"], "left").withColumn("line_id", F.coalesce("line_id", "_line")).drop("_u", "_v", "_line")
    require_empty(out.where("line_id is null").select("name_id", "a", "b"), "no line drives between a name's stations")
    return out


def track(points: DataFrame) -> DataFrame:
    """line_id, i, s, x, y: the lines in steps of about one, with their length so far."""
    return kept(arc_length(resampled(points).withColumnRenamed("i", "pos")).select("line_id", F.col("pos").alias("i"), "s", "x", "y"))


def _square(x: Column | str, y: Column | str, px: str, py: str) -> Column:
    return F.round(F.pow(F.col(x) - F.col(px), 2) + F.pow(F.col(y) - F.col(py), 2), 6)


def middles(track_: DataFrame, names: DataFrame) -> DataFrame:
    """names with middle (its length along the line), half (what the text takes on either side, with room) and sense (1 or -1: the line's direction)."""
    end = lambda c: F.struct(F.lit(c).alias("end"), F.col(f"{c}x").alias("px"), F.col(f"{c}y").alias("py"))
    ends = names.select("name_id", "line_id", F.explode(F.array(end("a"), end("b"))).alias("e")).select("name_id", "line_id", "e.*")
    spot = F.struct(_square("x", "y", "px", "py").alias("d"), "i", "s")
    at = track_.join(ends, "line_id").groupBy("name_id").agg(*[F.min(F.when(F.col("end") == c, spot)).alias(f"_{c}") for c in ("a", "b")])
    sense = F.when(F.col("_b.i") >= F.col("_a.i"), 1).otherwise(-1)
    width = F.array_max(F.transform(X.lines(F.col("text")), lambda z: X.text_width(z, FONT)))
    shift = F.coalesce("shift", F.lit(0.0))
    middle = F.coalesce(F.col("_a.s") + sense * (F.col("start") + width / 2 + shift), (F.col("_a.s") + F.col("_b.s")) / 2 + sense * shift)
    return names.join(at, "name_id").select(*names.columns, middle.alias("middle"), (width * 1.05 * 0.8).alias("half"), sense.alias("sense"))


def pieces(track_: DataFrame, middles_: DataFrame, smoothing: int = 15) -> DataFrame:
    """name_id, k, n, x, y, ex, ey: the smoothed piece of track beside a name, from a to b, with its direction. Pieces of fewer than three places are left out."""
    reach = F.col("half") + 20
    own = middles_.select("name_id", "line_id", "middle", "half", "sense", F.explode(spatial.cells(F.col("middle") - reach, F.col("middle") + reach, STRETCH)).alias("stretch"))
    off = F.round(F.abs(F.col("s") - F.col("middle")), 6)
    wide = track_.withColumn("stretch", F.floor(F.col("s") / STRETCH).cast("long")).join(own, ["line_id", "stretch"]).where(off <= F.round(reach, 6))
    smooth = moving_average(wide.select(F.col("name_id").alias("line_id"), F.col("i").alias("pos"), "x", "y", "s", "middle", "half", "sense"), smoothing)
    order = Window.partitionBy("name_id").orderBy(F.col("pos") * F.col("sense"))
    inside = smooth.where(off <= F.round("half", 6)).select(F.col("line_id").alias("name_id"), "pos", "sense", F.col("sx").alias("x"), F.col("sy").alias("y"))
    inside = inside.withColumn("k", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy("name_id")))
    ahead = lambda c: F.coalesce(F.lead(c).over(order), F.col(c)) - F.coalesce(F.lag(c).over(order), F.col(c))
    inside = inside.withColumn("dx", ahead("x")).withColumn("dy", ahead("y")).withColumn("d", F.greatest(F.hypot("dx", "dy"), F.lit(1e-9)))
    return kept(inside.where("n >= 3").select("name_id", "k", "n", "x", "y", (F.col("dx") / F.col("d")).alias("ex"), (F.col("dy") / F.col("d")).alias("ey")))


def sides(track_: DataFrame, names: DataFrame, pieces_: DataFrame) -> DataFrame:
    """name_id, x, y, ex, ey, left, right, side, flip: the piece's middle and direction, how far a text keeps off it on either side (beyond all lines
    of the bundle), the side (1: left of the direction), and whether the text is written against it so that it reads from left to right.
    """
    ends = pieces_.groupBy("name_id").agg(F.min_by("x", "k").alias("x0"), F.max_by("x", "k").alias("x1"))
    centre = kept(pieces_.where("k = n div 2").join(ends, "name_id").select("name_id", "x", "y", "ex", "ey", (F.round(F.col("x1") - F.col("x0"), 6) < 0).alias("flip")))
    nodes = track_.select(F.struct("line_id", "i").alias("node"), "x", "y")
    close = spatial.near(centre.select(F.col("name_id").alias("id"), "x", "y"), nodes, 25.0).where(F.round("d", 6) < 25)
    close = close.join(centre.select(F.col("name_id").alias("id"), "ex", "ey"), "id").withColumn("rx", F.col("nx") - F.col("x")).withColumn("ry", F.col("ny") - F.col("y"))
    across = close.where(F.round(F.abs(F.col("rx") * F.col("ex") + F.col("ry") * F.col("ey")), 6) < 3).select(F.col("id").alias("name_id"), (F.col("rx") * F.col("ey") - F.col("ry") * F.col("ex")).alias("v"))
    room = across.groupBy("name_id").agg(F.max("v").alias("_l"), F.min("v").alias("_r"))
    off = lambda v: F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)) + LINE_WIDTH / 2 + 2.0
    own = kept(centre.join(room, "name_id", "left").withColumn("left", off(F.col("_l"))).withColumn("right", off(-F.col("_r"))).drop("_l", "_r"))
    band = lambda sign, gap: F.struct(F.lit(sign).alias("sign"), (F.col("x") + sign * F.col("ey") * (F.col(gap) + FONT / 2)).alias("px"), (F.col("y") - sign * F.col("ex") * (F.col(gap) + FONT / 2)).alias("py"))
    probes = own.select("name_id", F.explode(F.array(band(1, "left"), band(-1, "right"))).alias("b")).select(F.struct("name_id", "b.sign").alias("id"), F.col("b.px").alias("x"), F.col("b.py").alias("y"))
    under = spatial.near(probes, nodes, FONT * 0.8).where(F.round("d", 6) < FONT * 0.8)
    under = under.groupBy(F.col("id.name_id").alias("name_id")).agg(F.sum("id.sign").alias("more"))  # those on the left less those on the right
    given = F.when(F.col("given") == "left", 1).when(F.col("given") == "right", -1)
    free = F.when(F.coalesce("more", F.lit(0)) <= 0, 1).otherwise(-1)
    out = own.join(under, "name_id", "left").join(names.select("name_id", F.col("side").alias("given")), "name_id")
    return kept(out.select("name_id", "x", "y", "ex", "ey", "left", "right", F.coalesce(given, free).alias("side"), "flip"))


def gap() -> Column:
    """How far a text on its side keeps off the middle of its track."""
    return F.when(F.col("side") == 1, F.col("left")).otherwise(F.col("right"))


def interpolated(paths: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """probes (*keys, s, tag) with x, y on paths (*keys, s, x, y), whose s rises; before the start and behind the end it is the path's own end."""
    both = paths.select(*keys, "s", F.struct("s", "x", "y").alias("v"), F.lit(None).alias("tag").cast(probes.schema["tag"].dataType))
    both = both.unionByName(probes.select(*keys, "s", F.lit(None).cast("struct<s:double,x:double,y:double>").alias("v"), "tag"))
    order = Window.partitionBy(*keys).orderBy("s", F.col("v").isNull())
    before = F.last("v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.first("v", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    at = both.withColumn("p", before).withColumn("q", behind).where("tag is not null").withColumn("p", F.coalesce("p", "q")).withColumn("q", F.coalesce("q", "p"))
    t = F.when(F.col("q.s") > F.col("p.s"), (F.col("s") - F.col("p.s")) / (F.col("q.s") - F.col("p.s"))).otherwise(0.0)
    return at.where("p is not null").select(*keys, "tag", *[(F.col(f"p.{c}") + t * (F.col(f"q.{c}") - F.col(f"p.{c}"))).alias(c) for c in ("x", "y")])


def letters(names: DataFrame, pieces_: DataFrame, sides_: DataFrame) -> DataFrame:
    """name_id, row, k, c, x, y, angle: every letter but spaces with its place on the baseline and its turn in degrees.

    Written to the left of its own direction, a name's first row is next to the track and each further one beyond it; on the other side the last row is. Letters
    are spread around the middle of their row's own baseline, which is the piece of track moved aside.
    """
    rows = names.select("name_id", F.size(X.lines(F.col("text"))).alias("rows"), F.posexplode(X.lines(F.col("text"))).alias("row", "z"))
    on_left = (F.col("side") == 1) != F.col("flip")
    up = F.when(on_left, F.col("row")).otherwise(F.col("rows") - 1 - F.col("row")) * FONT * ROW
    rows = rows.join(sides_, "name_id").select("name_id", "row", "z", "flip", (F.col("side") * (gap() + F.when(on_left, 0.0).otherwise(FONT * BASE) + up)).alias("aside"))
    moved = pieces_.join(rows.drop("z"), "name_id").select(
        F.struct("name_id", "row").alias("line_id"), F.when(F.col("flip"), -F.col("k")).otherwise(F.col("k")).alias("pos"), (F.col("x") + F.col("ey") * F.col("aside")).alias("x"), (F.col("y") - F.col("ex") * F.col("aside")).alias("y"),
    )
    keys = ["name_id", "row"]
    base = arc_length(moved).select("line_id.*", "s", "x", "y")
    length = base.groupBy(*keys).agg(F.max("s").alias("length"))
    each = rows.select(*keys, F.posexplode(X.characters(F.col("z"))).alias("k", "c")).withColumn("w", X.text_width(F.col("c"), FONT))
    till = F.sum("w").over(Window.partitionBy(*keys).orderBy("k"))
    each = each.withColumn("m", till - F.col("w") / 2 - F.sum("w").over(Window.partitionBy(*keys)) / 2).where("c <> ' '").join(length, keys)
    spots = each.select(*keys, F.explode(F.array(*[F.struct("k", "c", F.lit(j).alias("j"), (F.col("length") / 2 + F.col("m") + j).alias("s")) for j in (-1, 0, 1)])).alias("p"))
    found = interpolated(base, spots.select(*keys, F.col("p.s").alias("s"), F.struct("p.k", "p.c", "p.j").alias("tag")), keys)
    at = lambda j, c: F.max(F.when(F.col("tag.j") == j, F.col(c)))
    angle = F.degrees(F.atan2(at(1, "y") - at(-1, "y"), at(1, "x") - at(-1, "x")))
    return found.groupBy(*keys, F.col("tag.k").alias("k"), F.col("tag.c").alias("c")).agg(at(0, "x").alias("x"), at(0, "y").alias("y"), angle.alias("angle"))


def blocks(names: DataFrame, sides_: DataFrame, track_: DataFrame, tries: int = 30, cell: float = 64.0) -> DataFrame:
    """name_id, row, z, x, y, anchor: rows of names set level beside the track, as far out as they must go by ones so that no line runs through them;
    the last of the tries is taken where all are run through."""
    size = names.select("name_id", F.size(X.lines(F.col("text"))).alias("rows"), F.array_max(F.transform(X.lines(F.col("text")), lambda z: X.text_width(z, FONT))).alias("w"))
    ux, uy = F.col("ey") * F.col("side"), -F.col("ex") * F.col("side")
    tried = sides_.join(size, "name_id").select("name_id", "x", "y", ux.alias("ux"), uy.alias("uy"), "w", (F.col("rows") * FONT * ROW).alias("h"), gap().alias("gap"), F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("extra"))
    box = F.array(*marks.box_at(F.col("x"), F.col("y"), F.col("ux"), F.col("uy"), F.col("w"), F.col("h"), F.col("gap") + F.col("extra")))
    tried = tried.select("name_id", "extra", "ux", box.alias("box"))
    grown = [F.round(F.col("box")[i] + (-1 if i < 2 else 1), 6).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    met = spatial.points_in_boxes(track_.select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y")), tried.select(F.struct("name_id", "extra").alias("box"), *grown), cell)
    clear = tried.join(met.select("box.*", "n"), ["name_id", "extra"], "left")
    best = clear.groupBy("name_id").agg(F.min_by(F.struct("box", "ux"), F.struct(F.col("n").isNotNull(), F.when(F.col("n").isNull(), F.col("extra")).otherwise(-F.col("extra")))).alias("b"))
    name, x = marks.anchor(F.col("b.ux"), F.col("b.box")[0], F.col("b.box")[2], F.lit(None).cast("string"))
    rows = names.select("name_id", F.posexplode(X.lines(F.col("text"))).alias("row", "z")).join(best, "name_id")
    return rows.select("name_id", "row", "z", x.alias("x"), (F.col("b.box")[1] + (F.col("row") + 1) * FONT * ROW - FONT * 0.3).alias("y"), name.alias("anchor"))


def outside(track_: DataFrame, rings: DataFrame, sides_: DataFrame) -> DataFrame:
    """sides_ with the names of ring lines put on the side that lies farther from the middle of the ring's first line. rings: (name_id, ring_pos, line_id, against, shift)."""
    first = rings.groupBy("name_id").agg(F.min_by("line_id", "ring_pos").alias("line_id"))
    middle = track_.join(first.select("line_id").distinct(), "line_id", "left_semi").groupBy("line_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    far = lambda sign: F.round(F.hypot(F.col("x") + sign * F.col("ey") - F.col("mx"), F.col("y") - sign * F.col("ex") - F.col("my")), 6)
    out = sides_.join(first.join(middle, "line_id").drop("line_id"), "name_id", "left")
    side = F.when(F.col("mx").isNull(), F.col("side")).when(far(1) >= far(-1), 1).otherwise(-1)
    return out.withColumn("side", side).drop("mx", "my")


def ring_badges(track_: DataFrame, rings: DataFrame, sides_: DataFrame, font: float, padding: float, height: float, space: float = 2.0) -> DataFrame:
    """name_id, line_id, ahead, x, y, arrow, angle: badges of ring lines inside of the track, opposite to the name, side by side around the piece's middle; x and y are
    a badge's upper left corner and `arrow` the level of its arrow in axes turned by the angle at that middle. Lines that drive in reading direction (ahead) stand on the right.

    sides_: those of `outside`. A line's direction is that of ten steps around its place nearest to the middle, or the other one where it drives against its own order.
    """
    inner = -F.col("side")
    ix, iy = F.col("ey") * inner, -F.col("ex") * inner
    tx, ty = F.when(F.round(-iy, 9) < 0, iy).otherwise(-iy), F.when(F.round(-iy, 9) < 0, -ix).otherwise(ix)
    below = F.when(iy * tx - ix * ty > 0, 1).otherwise(-1)
    spot = sides_.select("name_id", F.col("x").alias("px"), F.col("y").alias("py"), tx.alias("tx"), ty.alias("ty"), below.alias("below"), F.when(inner == 1, F.col("left")).otherwise(F.col("right")).alias("gap"))
    around = Window.partitionBy("line_id").orderBy("i")
    ways = track_.join(rings.select("line_id").distinct(), "line_id", "left_semi")
    ways = ways.select("line_id", "i", "x", "y", *[(F.last(c).over(around.rowsBetween(0, 5)) - F.first(c).over(around.rowsBetween(-5, 0))).alias(f"d{c}") for c in ("x", "y")])
    wanted = rings.join(spot, "name_id")
    near = ways.join(wanted.select("name_id", "line_id", "px", "py"), "line_id").groupBy("name_id", "line_id").agg(F.min(F.struct(_square("x", "y", "px", "py").alias("d"), "i", "dx", "dy")).alias("w"))
    own = wanted.join(near, ["name_id", "line_id"]).withColumn("ahead", (F.round(F.col("w.dx") * F.col("tx") + F.col("w.dy") * F.col("ty"), 9) > 0) != F.col("against"))
    own = own.withColumn("w", X.badge_width(F.col("line_id").cast("string"), font, padding))
    row, whole = Window.partitionBy("name_id").orderBy("ahead", "line_id"), Window.partitionBy("name_id")
    start = F.coalesce(F.sum(F.col("w") + space).over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    x = start - (F.sum("w").over(whole) + space * (F.count("*").over(whole) - 1)) / 2 + F.coalesce("shift", F.lit(0.0))
    level = F.col("gap") + 3.5
    y = F.when(F.col("below") > 0, level + 4.0).otherwise(-level - 4.0 - height)
    return own.select("name_id", "line_id", "ahead", x.alias("x"), y.alias("y"), (F.col("below") * level).alias("arrow"), F.degrees(F.atan2("ty", "tx")).alias("angle"))


def pointing(names: DataFrame, sides_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks that stand apart (names with dx, dy: from the track to the block's upper left corner), with a bent arrow onto the track.

    Rows (name_id, row, z, x, y, anchor): the first begins at the arrow, others are centred. Arrows (name_id, ax, ay, kx, ky, tx, ty, p, q): from the text's begin
    level towards (kx, ky), then onto the track, up to just before it; p and q are the ends of its head's two strokes.
    """
    z = X.lines(F.col("text"))
    own = names.join(sides_.select("name_id", "x", "y"), "name_id").withColumn("x0", F.col("x") + F.col("dx")).withColumn("y0", F.col("y") + F.col("dy"))
    wide = own.withColumn("half", F.array_max(F.transform(z, lambda t: X.text_width(t, FONT))) / 2).select("name_id", "x0", "y0", "half", F.posexplode(z).alias("row", "z"))
    first = F.col("row") == 0
    x = F.col("x0") + F.col("half") - F.when(first, X.text_width(F.col("z"), FONT) / 2).otherwise(0.0)
    rows = wide.select("name_id", "row", "z", x.alias("x"), (F.col("y0") + (F.col("row") + 1) * FONT * ROW - FONT * 0.3).alias("y"), F.when(first, "start").otherwise("middle").alias("anchor"))
    a = own.select("name_id", "x", "y", (F.col("x0") - 2.0).alias("ax"), (F.col("y0") + FONT * 0.55).alias("ay"))
    level = F.abs(F.col("y") - F.col("ay")) <= 1e-6
    vx, vy = F.when(level, F.col("x") - F.col("ax")).otherwise(0.0), F.col("y") - F.col("ay")
    a = a.withColumn("d", F.greatest(F.hypot(vx, vy), F.lit(1e-9))).withColumn("ux", vx / F.col("d")).withColumn("uy", vy / F.col("d"))
    a = a.withColumn("tx", F.col("x") - F.col("ux") * LINE_WIDTH * 2.5).withColumn("ty", F.col("y") - F.col("uy") * LINE_WIDTH * 2.5)
    stroke = lambda sign: F.struct((F.col("tx") - 3.0 * F.col("ux") - sign * 1.6 * F.col("uy")).alias("x"), (F.col("ty") - 3.0 * F.col("uy") + sign * 1.6 * F.col("ux")).alias("y"))
    return rows, a.select("name_id", "ax", "ay", F.col("x").alias("kx"), F.col("ay").alias("ky"), "tx", "ty", stroke(1).alias("p"), stroke(-1).alias("q"))
