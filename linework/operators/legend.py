"""Tables of lines and their trains, as rows of elements with places; any number of legends at once.

badges: (legend_id, block, badge_pos, line_id): the lines of each block. trains: (legend_id, block, row, kind, route, cars, hollow, note, note_cars): its
train groups, from row 0. Blocks of the two are the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.functions import strings as X
from linework.operators.graph import kept
from linework.operators.sequences import running_boxes

HEAD = ("Linie", "Zuggruppe", "Laufweg", "Zugstärke")


@dataclass(frozen=True)
class Style:
    """Sizes of text, rows, badges and cars."""

    font: float = 10.0
    row: float = 18.0
    tight: float = 14.0
    padding: float = 5.0
    badge_font: float = 12.0
    badge_padding: float = 3.0
    badge_height: float = 15.0
    badge_gap: float = 2.0
    car_width: float = 16.0
    car_height: float = 5.0
    car_gap: float = 0.5
    margin: float = 36.0


STYLE = Style()


def widths(badges: DataFrame, trains: DataFrame, style: Style = STYLE) -> DataFrame:
    """legend_id, w0 to w3: the columns' widths, each as wide as its widest entry or its heading. A note's mark widens the last."""
    most = lambda *c: F.greatest(*[x for x in c]) + 2 * style.padding
    text = lambda c: F.max(X.text_width(F.col(c), style.font))
    head = [X.text_width(F.lit(t), style.font) for t in HEAD]
    cars = 4 * style.car_width + 3 * style.car_gap
    mark = F.when(F.max(F.coalesce(F.col("note"), F.lit("")) != ""), X.text_width(F.lit(" *"), style.font)).otherwise(0.0)
    badge = badges.groupBy("legend_id").agg(F.max(X.badge_width(F.col("line_id").cast("string"), style.badge_font, style.badge_padding)).alias("b"))
    train = trains.groupBy("legend_id").agg(text("kind").alias("k"), text("route").alias("r"), (mark + cars).alias("c"))
    both = badge.join(train, "legend_id", "left")
    return both.select("legend_id", *[most(F.coalesce(c, F.lit(0.0)), h).alias(f"w{i}") for i, (c, h) in enumerate(zip((F.col("b"), F.col("k"), F.col("r"), F.coalesce("c", F.lit(cars))), head, strict=True))])


def blocks(badges: DataFrame, trains: DataFrame, style: Style = STYLE) -> DataFrame:
    """legend_id, block, lines, rows, notes, height, pitch, offset: each block's size and how far below the heading it starts."""
    n = badges.groupBy("legend_id", "block").agg(F.count("*").alias("lines"))
    t = trains.groupBy("legend_id", "block").agg(F.count("*").alias("rows"), F.sum((F.coalesce(F.col("note"), F.lit("")) != "").cast("int")).alias("notes"))
    both = n.join(t, ["legend_id", "block"], "left").fillna(0, ["rows", "notes"])
    pitch = F.when(F.col("rows") <= 1, style.row).otherwise(style.tight)
    height = F.greatest(style.row + F.greatest(F.col("rows") - 1, F.lit(0)) * pitch, F.col("lines") * style.row)
    return kept(running_boxes(both.withColumn("pitch", pitch).withColumn("height", height), ["legend_id"], ["block"], F.col("height")))


def boxes(places: DataFrame, widths_: DataFrame, blocks_: DataFrame, ink: DataFrame, style: Style = STYLE) -> DataFrame:
    """legend_id, x0, y0, x1, y1, bottom, w0 to w3: where each legend stands; bottom: the table's, above the notes.

    places: (legend_id, x, y). Without y it hangs a margin above the highest of the map's boxes (ink: legend_id, x0, y0, x1, y1) in its column, or at 0.
    """
    high = blocks_.groupBy("legend_id").agg(F.sum("height").alias("table"), F.sum("notes").alias("notes"))
    own = places.join(widths_, "legend_id").join(high, "legend_id").withColumn("right", F.col("x") + F.col("w0") + F.col("w1") + F.col("w2") + F.col("w3"))
    own = own.withColumn("height", style.row + F.col("table") + F.col("notes") * style.row)
    under = ink.join(own.select("legend_id", "x", "right"), "legend_id").where("x0 < right and x1 > x").groupBy("legend_id").agg(F.min("y0").alias("top"))
    y = F.coalesce("y", F.col("top") - style.margin - F.col("height"), F.lit(0.0))
    own = own.join(under, "legend_id", "left").withColumn("y0", y)
    return kept(own.select("legend_id", F.col("x").alias("x0"), "y0", F.col("right").alias("x1"), (F.col("y0") + F.col("height")).alias("y1"), (F.col("y0") + style.row + F.col("table")).alias("bottom"), *[f"w{i}" for i in range(4)]))


def elements(badges: DataFrame, trains: DataFrame, blocks_: DataFrame, boxes_: DataFrame, style: Style = STYLE) -> DataFrame:
    """legend_id, kind, block, place, x, y, x1, y1, text: all elements.

    head, train, route, star, note: text from (x, y), its baseline; badge: a box with its line; car: a box, hollow or full; rule: a line. A block's texts stand in the
    middle of it, rows of several a little tighter, and so do its badges.
    """
    zero = F.lit(0).cast("long")
    edge = lambda i: sum((F.col(f"w{j}") for j in range(i)), F.col("x0"))
    text = lambda i: edge(i) + style.padding
    nothing = F.lit(None).cast("double")

    def part(rows: DataFrame, kind: str, place: Column, x: Column, y: Column, x1: Column = nothing, y1: Column = nothing, words: Column | None = None, block: Column = zero) -> DataFrame:
        return rows.select("legend_id", F.lit(kind).alias("kind"), block.cast("long").alias("block"), place.cast("long").alias("place"), x.alias("x"), y.alias("y"), x1.alias("x1"), y1.alias("y1"), (F.lit(None) if words is None else words).cast("string").alias("text"))

    heads = boxes_.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), text(i).alias("x"), F.lit(t).alias("t")) for i, t in enumerate(HEAD)])).alias("h"))
    out = part(heads, "head", F.col("h.i"), F.col("h.x"), F.col("y0") + style.row * 0.72, words=F.col("h.t"))
    out = out.unionByName(part(boxes_, "rule", F.lit(0), F.col("x0"), F.col("y0") + style.row, F.col("x1"), F.col("y0") + style.row))
    upright = boxes_.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), edge(i).alias("x")) for i in (1, 2, 3)])).alias("h"))
    out = out.unionByName(part(upright, "column", F.col("h.i"), F.col("h.x"), F.col("y0"), F.col("h.x"), F.col("bottom")))
    own = blocks_.join(boxes_, "legend_id").withColumn("top", F.col("y0") + style.row + F.col("offset"))
    low = F.col("top") + F.col("height")
    out = out.unionByName(part(own, "rule", F.lit(1), F.col("x0"), low, F.col("x1"), low, block=F.col("block")))

    step = style.badge_height + style.badge_gap
    nth = F.row_number().over(Window.partitionBy("legend_id", "block").orderBy("badge_pos", "line_id")) - 1
    badge = badges.withColumn("nth", nth).join(own, ["legend_id", "block"])
    y = F.col("top") + (F.col("height") - F.col("lines") * step + style.badge_gap) / 2 + F.col("nth") * step
    name = F.col("line_id").cast("string")
    out = out.unionByName(part(badge, "badge", F.col("nth"), text(0), y, text(0) + X.badge_width(name, style.badge_font, style.badge_padding), y + style.badge_height, X.badge_text(name), F.col("block")))

    train = trains.join(own, ["legend_id", "block"])
    middle = F.col("top") + (F.col("height") - F.col("rows") * F.col("pitch")) / 2 + (F.col("row") + 0.5) * F.col("pitch")
    train = train.withColumn("middle", middle)
    base = F.col("middle") + style.font * 0.35
    for kind, column, i in (("train", "kind", 1), ("route", "route", 2)):
        out = out.unionByName(part(train, kind, F.col("row"), text(i), base, words=F.col(column), block=F.col("block")))
    pitch = style.car_width + style.car_gap
    noted = F.coalesce(F.col("note"), F.lit("")) != ""
    out = out.unionByName(part(train.where(noted), "star", F.col("row"), text(3) + F.col("cars") * pitch + 2.0, base, words=F.lit("*"), block=F.col("block")))
    order = Window.partitionBy("legend_id").orderBy("block", "row")
    notes = train.where(noted).withColumn("top", F.col("bottom") + (F.row_number().over(order) - 1) * style.row)
    out = out.unionByName(part(notes, "note", F.col("row"), text(1), F.col("top") + style.row * 0.72, words=F.concat(F.lit("* "), F.col("note")), block=F.col("block")))
    for kind, rows, n, full, top in (
        ("car", train, F.col("cars"), F.col("cars") - F.coalesce("hollow", F.lit(0)), F.col("middle") - style.car_height / 2),
        ("note car", notes, F.coalesce("note_cars", F.lit(0)), F.coalesce("note_cars", F.lit(0)), F.col("top") + (style.row - style.car_height) / 2),
    ):
        each = rows.where(n > 0).select("*", full.alias("full"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("k"))
        x = text(3) + F.col("k") * pitch
        out = out.unionByName(part(each, kind, F.col("row") * 10 + F.col("k"), x, top, x + style.car_width, top + style.car_height, F.when(F.col("k") < F.col("full"), "full").otherwise("hollow"), F.col("block")))
    return out
