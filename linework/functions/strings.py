"""Column functions of names, labels and paths' text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Advance widths of the label font, as parts of its size.
ADVANCE = {
    " ": 0.2786, "(": 0.2950, ")": 0.2975, "-": 0.4075, "/": 0.3700,
    "A": 0.6850, "B": 0.7050, "C": 0.7400, "D": 0.7400, "E": 0.6475,
    "F": 0.5925, "G": 0.7600, "H": 0.7400, "I": 0.2950, "J": 0.5550,
    "K": 0.7225, "L": 0.5925, "M": 0.9075, "N": 0.7400, "O": 0.7775,
    "P": 0.6675, "R": 0.7225, "S": 0.6500, "T": 0.6125, "V": 0.6300,
    "W": 0.9450, "Y": 0.6650, "Z": 0.6475,
    "a": 0.5725, "b": 0.6100, "c": 0.5750, "d": 0.6125, "e": 0.5750,
    "f": 0.3150, "g": 0.6100, "h": 0.5925, "i": 0.2575, "k": 0.5750,
    "l": 0.2575, "m": 0.9050, "n": 0.5925, "o": 0.6100, "p": 0.6100,
    "r": 0.3875, "s": 0.5375, "t": 0.3500, "u": 0.5925, "v": 0.5200,
    "w": 0.8150, "x": 0.5375, "y": 0.5200, "z": 0.5175,
    "ß": 0.6100, "ä": 0.5725, "ö": 0.6100, "ü": 0.5925,
}
ADVANCE_DEFAULT = 0.62
# What names lose, in this order.
PREFIX, CITY = r"^(s\+u|s|u)\s+", r"^berlin[- ]"
PLACE = r"\s*\((b|bei)\.? [^)]*\)|\s*\(mark\)|\s*\(berlin\)"
MAIN, MAIN_NAME = r"(^|[^\p{L}\p{N}_])hbf($|[^\p{L}\p{N}_])", "hauptbahnhof"
OTHER = "[^a-z0-9äöü]"


def normalize_name(name: Column) -> Column:
    """A station's name without what sources write differently."""
    n = F.replace(F.lower(name), F.lit("ß"), F.lit("ss"))
    for pattern in (PREFIX, CITY, PLACE):
        n = F.regexp_replace(n, pattern, "")
    for _ in range(2):  # the mark between two occurrences belongs to the first match
        n = F.regexp_replace(n, MAIN, f"$1{MAIN_NAME}$2")
    return F.regexp_replace(n, OTHER, "")


def characters(text: Column) -> Column:
    """The text's characters; none for the empty text."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def text_width(text: Column, font: float | Column) -> Column:
    advance = F.create_map(*[F.lit(x) for x in chain.from_iterable(ADVANCE.items())])
    total = F.aggregate(characters(text), F.lit(0.0), lambda s, c: s + F.coalesce(F.try_element_at(advance, c), F.lit(ADVANCE_DEFAULT)))
    return total * font


def badge_text(line_id: Column) -> Column:
    """A line's name with a space behind its letter."""
    return F.when(F.length(line_id) > 1, F.concat(F.substring(line_id, 1, 1), F.lit(" "), F.substr(line_id, F.lit(2)))).otherwise(line_id)


def badge_width(line_id: Column, font: float, padding: float) -> Column:
    return F.length(badge_text(line_id)) * (font * 0.5) + 2 * padding


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def suffix_start(text: Column) -> Column:
    """Number of the first line that opens with a bracket; null without one or if it is line 0."""
    where = F.array_position(F.transform(lines(text), lambda z: z.startswith("(")), True)
    return F.when(where > 1, where - 1)


def label_width(text: Column, font: float, smaller: float = 0.0) -> Column:
    """Width of a label's widest line; from a bracketed suffix on, lines are set smaller."""
    start = F.coalesce(suffix_start(text), F.lit(1 << 30))
    return F.array_max(F.transform(lines(text), lambda z, i: text_width(z, F.when(i >= start, font - smaller).otherwise(font))))


def escape_xml(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def tenths(v: Column) -> Column:
    """A whole number of tenths as short as SVG allows: 12.3, -4, .5."""
    whole, rest = F.floor(F.abs(v) / 10).cast("long"), F.pmod(F.abs(v), F.lit(10))
    body = F.when(rest == 0, whole.cast("string")).when(whole == 0, F.concat(F.lit("."), rest.cast("string"))).otherwise(F.concat_ws(".", whole, rest))
    return F.concat(F.when(v < 0, "-").otherwise(""), body)


def route_ends(route: Column) -> Column:
    """(first, last) of a route written as A <> B <> C."""
    parts = F.transform(F.split(route, "<>"), lambda x: F.trim(x))
    return F.struct(F.element_at(parts, 1).alias("first"), F.element_at(parts, -1).alias("last"))


def legend_key(line_id: Column) -> Column:
    """Legend order: the name without leading S."""
    return F.regexp_replace(line_id, "^S+", "")


def family_number(family: Column) -> Column:
    """The digits of a family's name as a number; 0 without any."""
    digits = F.regexp_replace(family, "[^0-9]", "")
    return F.when(digits == "", 0).otherwise(digits.cast("long")).cast("long")


def draw_path(points: Column, closed: bool) -> Column:
    """Relative SVG path of (x, y) structs, rounded half-even to tenths before differences are taken; an empty text for
    less than two different neighbours."""
    q = F.transform(points, lambda p: F.struct(F.rint(p["x"] * 10).cast("long").alias("x"), F.rint(p["y"] * 10).cast("long").alias("y")))
    # each vertex beside the one before it, in one pass: an index into q would compute q again for every vertex
    before = F.concat(F.array(F.lit(None).cast("struct<x:bigint,y:bigint>")), q)
    moves = F.filter(F.arrays_zip(q.alias("q"), before.alias("b")), lambda z: z["q"].isNotNull() & ~z["q"].eqNullSafe(z["b"]))
    q = F.transform(moves, lambda z: z["q"])
    if closed:
        q = F.when((F.size(q) > 1) & (F.try_element_at(q, F.lit(1)) == F.try_element_at(q, F.lit(-1))), F.slice(q, F.lit(1), F.size(q) - 1)).otherwise(q)
    tail = F.slice(q, F.lit(2), F.greatest(F.size(q), F.lit(0)))
    steps = F.transform(F.filter(F.arrays_zip(tail.alias("n"), q.alias("o")), lambda z: z["n"].isNotNull()), lambda z: F.concat_ws(" ", tenths(z["n"]["x"] - z["o"]["x"]), tenths(z["n"]["y"] - z["o"]["y"])))
    head = F.concat(F.lit("M"), tenths(F.get(q, F.lit(0))["x"]), F.lit(" "), tenths(F.get(q, F.lit(0))["y"]), F.lit("l"))
    return F.when(F.size(q) > 1, F.concat(head, F.array_join(steps, " "), F.lit("z" if closed else ""))).otherwise("")
