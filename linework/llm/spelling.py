"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

Two words of lengths a and a or a + 1 that differ by one replaced or inserted code point differ first at some place p of
0 .. a. If p lies in the second half of these places, both have the same first half; if it lies in the first half, both have
the same last half. So every word stands in the forward dictionary under its first half and, spelled backwards, in the
reversed dictionary under its last half, once for each role (as long as the shorter word, or one longer). A pair is met in the
one block whose places hold its p and nowhere else, so nothing has to be made distinct.

Skewed blocks are subdivided by the same argument: a block for the places lo .. hi holds words with equal code points before
lo and after hi; its halves hold words with longer equal beginnings or endings. Blocks over MOST words are subdivided by Spark,
level by level (the number of levels is the logarithm of the longest word); smaller ones go on in their task, down to SMALL words
or one place. A block of one place holds words that are equal but there, so its size is bounded by the alphabet. What is
left is verified letter by letter.

A block is known by a 64-bit hash of its places and texts: a collision only adds words to verify. Counting words is native:
only words of the least length are taken out of the texts, and they are counted before they travel, so frequent words are one row
for each task.

Nulls: a null text has no words; a null doc_id counts as the empty text. Repeated rows count each time. An empty table gives
an empty result. Texts and words may be of any length. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.llm.common import grouped, lookup, written

#: Words that a task takes as one block, and words of which it compares all.
MOST, SMALL = 2000, 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted(docs: DataFrame, least_length: int = 7, least_count: int = 2, slip: int | None = 31) -> DataFrame:
    """(word, n): lower-cased runs of letters of whole texts. A run loses one code point, chosen by the CRC-32 of `doc_id:run`, where
    `slip` divides that; None: never."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all(text, F.lit(f"[a-zÀ-ÿ]{{{max(1, least_length)},}}"), F.lit(0))).alias("run"))
    word = F.col("run")
    if slip:
        at = F.col("h") % F.length("run")
        short = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run")))
        runs = runs.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
        word = F.when(F.col("h") % slip == 0, short).otherwise(word)
    words = runs.select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _with_block(rows: DataFrame) -> DataFrame:
    """Adds block: a hash of the role, the places lo .. hi (end exclusive) and the equal texts before and after them."""
    tail = F.greatest(F.col("a") - F.col("hi"), F.lit(0))
    before, after = F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.length("word") - tail + 1, tail)
    return rows.withColumn("block", F.xxhash64("a", "lo", "hi", before, after))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in the two halves of its places."""
    middle = F.expr("int((lo + hi) div 2)")
    both = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
    return _with_block(rows.withColumn("half", F.explode(both)).select("word", "n", "a", "half.lo", "half.hi"))


def _differ(u: str, v: str, lo: int, hi: int) -> bool:
    """Whether u and v, as long or one longer, differ by one edit whose first place is in lo .. hi - 1; they are equal before lo."""
    p, stop = lo, min(len(u), hi)
    while p < stop and u[p] == v[p]:
        p += 1
    if p >= hi:
        return False
    return u[p + 1 :] == v[p + 1 :] if len(u) == len(v) else u[p:] == v[p + 1 :]


def pairs(words: list[str], a: int, lo: int, hi: int, small: int = SMALL) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart at a place in lo .. hi - 1, of distinct words of lengths a and a + 1; the first one's length is a."""
    if len(words) < 2:
        return
    if len(words) <= small or hi - lo <= 1:
        short = [w for w in words if len(w) == a]
        for i, u in enumerate(short):
            for v in short[i + 1 :]:
                if _differ(u, v, lo, hi):
                    yield u, v
            for v in words:
                if len(v) > a and _differ(u, v, lo, hi):
                    yield u, v
        return
    middle, tail = (lo + hi) // 2, 0
    tail = max(0, a - middle)
    first, last = defaultdict(list), defaultdict(list)
    for w in words:
        first[w[lo:middle]].append(w)
        last[w[len(w) - tail :]].append(w)
    for block in first.values():
        yield from pairs(block, a, middle, hi, small)
    for block in last.values():
        yield from pairs(block, a, lo, middle, small)


def near(words: DataFrame, most: int = MOST, small: int = SMALL) -> DataFrame:
    """(word, n_near, best_n, best) of distinct (word, n): the number of words one edit away, and of those the one with the largest n,
    the first in code-point order of equals. Words without any aren't returned."""
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    roles = F.array(F.length("word"), F.length("word") - 1)
    rows = _halves(words.select("word", "n", F.explode(roles).alias("a")).withColumn("lo", F.lit(0)).withColumn("hi", F.col("a") + 1))
    ready = []
    while True:
        rows = written(rows, "dictionary")
        sizes = rows.groupBy("block").agg(F.count("*").alias("members"), F.max(F.col("hi") - F.col("lo")).alias("places")).where("members > 1")
        large = (F.col("members") > most) & (F.col("places") > 1)
        found = sizes.agg(F.sum(large.cast("long")).alias("large")).first()["large"]
        marked = lookup(rows, sizes, "block", "members", rows.count()).where("members > 1") if found else rows
        ready.append(marked.where(~large).select(rows.columns) if found else rows)
        if not found:
            break
        rows = _halves(marked.where(large))
    everything = ready[0]
    for r in ready[1:]:
        everything = everything.unionByName(r)
    forward = F.col("hi") > F.col("a")
    dictionary = everything.withColumn("spelled", F.when(forward, F.col("word")).otherwise(F.reverse("word"))).repartition(parts, "block").sortWithinPartitions("block", "spelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, int, str]] = []
        for block in grouped(batches, "block"):
            if block.num_rows < 2:
                continue
            text, n = block.column("word").to_pylist(), block.column("n").to_pylist()
            a, lo, hi = (block.column(c)[0].as_py() for c in ("a", "lo", "hi"))
            count = dict(zip(text, n, strict=True))
            best: dict[str, tuple[int, int, str]] = {}
            for u, v in pairs(text, a, lo, hi, small):
                for x, y in ((u, v), (v, u)):
                    seen, most_n, at = best.get(x, (0, 0, ""))
                    m = count[y]
                    best[x] = (seen + 1, m, y) if m > most_n or m == most_n and y < at else (seen + 1, most_n, at)
            out += [(x, *found) for x, found in best.items()]
            if len(out) >= 10000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    found = dictionary.select("word", "n", "a", "lo", "hi", "block").mapInArrow(run, "word string, n_near long, best_n long, best string")
    lead = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), lead.alias("lead")).select("word", "n_near", (-F.col("lead.less")).alias("best_n"), "lead.best")


def _batch(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. Each round doubles the steps taken; n grows tenfold with each step, so there are few."""
    step = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = step.select(F.col("word").alias("at"), F.col("root").alias("next"))
        jumped = step.join(up, step["root"] == up["at"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        jumped = written(jumped, "roots")
        step = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return step


def variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, slip: int | None = 31, times: int = 10, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word."""
    words = written(counted(docs, least_length, least_count, slip), "words")
    close = near(words, most)
    formed: Column = F.col("best_n") >= times * F.col("n")
    rows = words.join(close, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")
    )
    rows = written(rows, "variants")
    root = roots(rows.where("form is not null"))
    return rows.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
