"""Exact deduplication by a tree-merge of sorted digest runs.

Every input partition's rows are a run: its distinct digests with (largest identifier, count), counted before they travel.
Runs are exchanged in binomial rounds: with 2**k-way merging, round r brings together the runs of 2**k neighbouring groups, and at the same
time splits them by k more leading bits of the digest. So each round halves the number of runs k times and the digest
range of each run k times: no merge ever holds more than its share of the digests, and after the last round every
digest range has one merged run. A round deals by (digest range, group of runs) alone, so what is merged lies in one partition;
there Spark's sorter merges it by digest, and equal neighbours are joined in that order, without another exchange or sort.
A group of copies is one row for each run from the start, however many rows it has.

Identity is verified at each level: neighbours are joined on the SHA-256 digest together with the byte length and an
independent 64-bit hash of the text, so that a digest alone never joins two texts.

Nulls: null text counts as the empty text, a null doc_id is smaller than any other. Repeated rows (same doc_id,
same text) are copies of each other: exactly one is kept. An empty table gives an empty result. Other columns
are ignored by `groups` and kept unchanged by `deduplicated`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.llm.common import lookup, written


#: A round deals each digest range in 2**SPREAD_BITS parts, so that a partition gets many small parts instead of none or several large ones.
SPREAD_BITS = 4


def digests(docs: DataFrame, rid: str | None = None) -> DataFrame:
    """One row per document row: row number (docs' column `rid`, or made here), id and the digest of its whole text, written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return written(
        docs.select(
            (F.monotonically_increasing_id() if rid is None else F.col(rid)).alias("rid"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.struct(F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("check")).alias("digest"),
            F.spark_partition_id().alias("run"),
        ),
        "digests",
    )


def merged_runs(rows: DataFrame, runs: int, fan_bits: int = 3, keep: str = "largest") -> DataFrame:
    """(digest, keeper, n): binomial rounds of 2**fan_bits-way merges over `runs` sorted runs."""
    pick = {"largest": F.max, "smallest": F.min}[keep]
    rounds = max(1, math.ceil(math.log2(max(2, runs)) / fan_bits))
    width = rounds * fan_bits
    lead = F.conv(F.hex(F.substring(F.col("digest.sha"), 1, 4)), 16, 10).cast("long")
    runs_ = rows.select(F.pmod("run", F.lit(1 << width)).alias("run"), "digest", F.struct("doc_id", "rid").alias("keeper"))
    out = runs_.groupBy("run", "digest").agg(pick("keeper").alias("keeper"), F.count("*").alias("n"))  # counted before they travel
    for r in range(1, rounds + 1):
        done = r * fan_bits
        span = F.shiftright(lead, 32 - min(32, done + SPREAD_BITS))
        dealt = out.select(span.alias("span"), F.shiftright("run", done).alias("group"), "digest", "keeper", "n").repartition("span", "group")
        merged = dealt.sortWithinPartitions("span", "group", "digest").groupBy("span", "group", "digest").agg(pick("keeper").alias("keeper"), F.sum("n").alias("n"))
        out = merged.select("digest", "keeper", "n", F.shiftleft("group", done).alias("run"))
    return out.drop("run")


def _marked(rows: DataFrame, keep: str) -> DataFrame:
    """rid, doc_id, digest, and their group's n and keeper, of every digest."""
    stat = rows.agg(F.count("*").alias("n"), F.coalesce(F.max("run"), F.lit(0)).alias("runs")).first()
    best = written(merged_runs(rows, stat["runs"] + 1, keep=keep), "merged")
    return lookup(rows.select("rid", "doc_id", "digest"), best, "digest", "n", stat["n"])


def groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document row, dropped ones too."""
    return _marked(digests(docs), keep).select(
        "doc_id",
        F.col("keeper.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("keeper.rid") == F.col("rid")).alias("kept"),
        F.lower(F.hex("digest.sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows are found by number, so ids may repeat or be null."""
    rid = "__linework_rid"
    numbered = written(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    rows = digests(numbered, rid)
    runs = rows.agg(F.coalesce(F.max("run"), F.lit(0))).first()[0] + 1
    stay = merged_runs(rows, runs, keep=keep).select(F.col("keeper.rid").alias(rid))
    return numbered.join(stay, rid, "left_semi").select(docs.columns)
