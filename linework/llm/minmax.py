"""Near-duplicates by min-max hashing, with links confirmed on full shingle sets.

Signatures. A permutation is evaluated once for each shingle, and both its smallest and its largest value are kept: half the
evaluations for the same number of values. Each of the two agrees between two sets with probability J (the Jaccard
similarity), so their mean is unbiased, and its variance is below that of two independent permutations, because one shingle can't be both
the smallest and the largest. A band takes the minima of `rows` permutations, the next band the maxima of the same ones; the values
within a band are independent. With 24 bands of 4, two sets with J = 0.85 share no band with probability (1 - 0.85**4)**24 = 2e-8.

Candidates. Equal sets (length and 128 bits of the sorted shingles) are one node from the start. Nodes that share a band are
candidates; chains of candidates are families, found by stars within bands. A family of at most MOST_NODES nodes and MOST_SHINGLES
shingles is taken whole: each text travels once, and all its pairs are decided on full sets. A larger family is taken by
its bands instead; a band that is itself too large is cut into chunks, and every two chunks are decided together, except
those of one component. This runs twice: first one chunk against all others, so that most of a large group of copies is one
component, then what is left. No task holds more than two chunks, and no pair is left out. What remains quadratic are unlinked
sets that share a band, over the size of a chunk.

Deciding. In a task, postings of its shingles count a set's overlap with all others at once; sets that are known to be
connected to the anchor (the set that shares most shingles) aren't asked again, since two of them need no link between them.

A shingle is a 64-bit hash of its words' 64-bit hashes. Nulls: a null text, like one without words, has an empty set and is linked with nothing;
a null doc_id takes no part in the smallest id unless its component has no other. Repeated rows are copies of each other and
both kept if their id is the smallest. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.llm.common import grouped, lookup, raw, written
from linework.llm.simhash import components

BANDS, ROWS = 24, 4
MOST_NODES, MOST_SHINGLES = 2000, 4_000_000
#: Shingles that are hashed at once.
BLOCK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_words: dict[bytes, int] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word(word: bytes) -> int:
    found = _words.get(word)
    if found is None:
        if len(_words) >= 200_000:
            _words.clear()
        found = _words[word] = xxhash.xxh64_intdigest(word)
    return found


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Distinct shingles in ascending order; of fewer words, the whole sequence; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word, words), np.uint64, len(words))
    k = min(width, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * _ODD + h[i : i + n]
    return np.unique(_mixed(out))


def bands(sets: list[np.ndarray], count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """uint64 [set, band] of non-empty sets: minima of `rows` permutations and maxima of the same ones, in turn."""
    number = np.arange(1, 1 + (count + 1) // 2 * rows, dtype=np.uint64)
    flips, odd = _mixed(number * _ODD), _mixed(number * _ODD + np.uint64(1)) | np.uint64(1)
    out = np.zeros((len(sets), count), np.uint64)
    sizes = np.array([len(s) for s in sets])
    lo = 0
    while lo < len(sets):
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), BLOCK, "right")) + lo)
        h = np.concatenate(sets[lo:hi])
        starts = np.concatenate(([0], np.cumsum(sizes[lo:hi])[:-1]))
        for p in range(len(number)):
            values = (h ^ flips[p]) * odd[p]
            for side, least in ((0, np.minimum), (1, np.maximum)):
                band = 2 * (p // rows) + side
                if band < count:
                    out[lo:hi, band] = _mixed(out[lo:hi, band] * _ODD + least.reduceat(values, starts) + np.uint64(band))
        lo = hi
    return out


def signatures(docs: DataFrame, width: int, count: int, rows: int) -> DataFrame:
    """(rid, doc_id, n_shingles, whole, bands) of (rid, doc_id, text): whole is 128 bits of the sorted set, bands are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                sets = [shingles(t, width) for t in raw(b.column(2))]
                full = [i for i, s in enumerate(sets) if len(s)]
                own = bands([sets[i] for i in full], count, rows).view(np.int64) if full else np.zeros((0, count), np.int64)
                stops = np.zeros(len(sets) + 1, np.int32)
                stops[[i + 1 for i in full]] = count
                values = pa.ListArray.from_arrays(pa.array(np.cumsum(stops, dtype=np.int32)), pa.array(own.ravel()))
                whole = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(whole, pa.binary()), values], names=["rid", "doc_id", "n_shingles", "whole", "bands"])

    return docs.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, n_shingles long, whole binary, bands array<long>")


def linked(sets: list[np.ndarray], known: list[int], share: int = 85) -> list[tuple[int, int]]:
    """Links that join sets with 100 * intersection >= share * union into their components; known: equal numbers are joined already."""
    count = len(sets)
    up = list(range(count))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    first: dict[int, int] = {}
    left = 0
    for i, k in enumerate(known):
        up[i] = first.setdefault(k, i)
        left += up[i] == i
    sizes = np.array([len(s) for s in sets], np.int64)
    every, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(count), sizes)
    shared = times[number] > 1  # a shingle of one set joins nothing
    number, owner = number[shared], owner[shared]
    order = np.argsort(number, kind="stable")
    posted = owner[order]
    ends = np.cumsum(np.bincount(number, minlength=len(every)))
    starts = ends - np.bincount(number, minlength=len(every))
    own_end = np.cumsum(np.bincount(owner, minlength=count))
    weight = np.bincount(owner, weights=times[number], minlength=count)
    anchor = int(weight.argmax())
    found: list[tuple[int, int]] = []
    for x in [anchor, *(i for i in np.argsort(-weight, kind="stable").tolist() if i != anchor)]:
        if left == 1:
            break
        if x != anchor and find(x) == find(anchor):
            continue
        mine = number[own_end[x - 1] if x else 0 : own_end[x]]
        if not len(mine):
            continue
        a, n = starts[mine], ends[mine] - starts[mine]
        at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(posted[at], minlength=count)
        for y in np.flatnonzero(100 * both >= share * (sizes[x] + sizes - both)).tolist():
            i, j = find(x), find(y)
            if i != j:
                up[max(i, j)] = min(i, j)
                left -= 1
                found.append((x, y))
    return found


def _decided(tasks: DataFrame, texts: DataFrame, width: int, share: int) -> DataFrame:
    """(a, b): links between the nodes of each task. tasks: (task, node, known); texts: (node, text)."""
    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tasks.join(texts, "node").repartition(parts, "task").sortWithinPartitions("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, "task"):
            if group.num_rows > 1:
                node = group.column("node").to_numpy()
                found = linked([shingles(t, width) for t in raw(group.column("text"))], group.column("known").to_pylist(), share)
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(node[list(a)]), pa.array(node[list(b)])], names=["a", "b"])

    return rows.select("task", "node", "known", "text").mapInArrow(run, "a long, b long")


def _labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with the smallest node that each reaches as `known`."""
    return nodes.join(components(edges), "node", "left").withColumn("known", F.coalesce("label", "node")).drop("label")


def _chunks(large: DataFrame, most_nodes: int, most_shingles: int, first: bool) -> DataFrame:
    """(task, node, known) of (bucket, node, n, known): every two chunks of a bucket, but for those of its largest component alone.

    first: only the pairs with one chunk, which is enough to join most of a group of copies.
    """
    total = large.groupBy("bucket", "known").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    chunk = lambda m, s: F.ceil(F.greatest(F.col(m) / (most_nodes / 2), F.col(s) / (most_shingles / 2))).cast("int")
    sizes = total.groupBy("bucket").agg(F.max(F.struct("m", "known", "s")).alias("main"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count("*").alias("labels"))
    sizes = sizes.where("labels > 1").select("bucket", "m", F.col("main.known").alias("main"), chunk("main.m", "main.s").alias("k"), (F.col("m") - F.col("main.m")).alias("rm"), (F.col("s") - F.col("main.s")).alias("rs"))
    sizes = sizes.select("bucket", "m", "main", "k", chunk("rm", "rs").alias("r"))
    rows = lookup(large, sizes, "bucket", "m", large.count()).where("main is not null")
    apart = F.col("known") != F.col("main")
    own = F.when(apart, F.pmod(F.xxhash64("node"), F.col("r"))).otherwise(F.col("r") + F.pmod(F.xxhash64("node"), F.col("k")))  # chunks 0 .. r - 1 aren't of the main component
    every = F.sequence(F.lit(0), F.col("r") - 1)
    others = F.when(F.col("own") < F.col("r"), F.sequence(F.lit(0), F.col("r") + F.col("k") - 1)).otherwise(every)
    if first:  # pairs with chunk 0
        others = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("r") + F.col("k") - 1)).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("own", own.cast("int")).withColumn("other", F.explode(others)).where("own <> other")  # two chunks' task has the pairs within each too
    return rows.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "node", "known")


def _links(nodes: DataFrame, texts: DataFrame, width: int, share: int, most_nodes: int, most_shingles: int) -> DataFrame:
    """(a, b): links that make up the components. nodes: (node, n, bands), one for each distinct set."""
    rows = nodes.select("node", "n", F.posexplode("bands").alias("band", "value"))
    rows = rows.select(F.xxhash64("band", "value").alias("bucket"), "node", "n")
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("head")).where("members > 1")
    shared = written(lookup(rows, buckets, "bucket", "members", nodes.count() * BANDS).where("members > 1"), "buckets")
    family = components(shared.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")))
    member = written(family.select("node", F.col("label").alias("family")).join(nodes.select("node", "n"), "node"), "members")
    texts = written(member.select("node").join(texts, "node"), "texts", "zstd")
    size = member.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    sized = lookup(member, size, "family", "m", member.count())
    fits = (F.col("m") <= most_nodes) & (F.col("s") <= most_shingles)
    found = written(_decided(sized.where(fits).select(F.xxhash64("family").alias("task"), "node", F.col("node").alias("known")), texts, width, share), "links")
    large = written(sized.where(~fits).select("node"), "large")
    if large.isEmpty():
        return found
    shared = written(shared.join(large, "node").select("bucket", "node", "n", "members"), "buckets")
    total = shared.groupBy("bucket").agg(F.sum("n").alias("s"), F.count("*").alias("m"))
    for first in (True, False):
        known = written(_labels(shared, found), "known")
        weights = lookup(known, total, "bucket", "m", known.count())
        fits = (F.col("m") <= most_nodes) & (F.col("s") <= most_shingles)
        chunked = _chunks(written(weights.where(~fits).select("bucket", "node", "n", "known"), "chunked"), most_nodes, most_shingles, first)
        tasks = chunked
        if first:  # bands that fit: of several with the same nodes one is enough
            small = weights.where(fits).select("bucket", "node", "known")
            same = small.groupBy("bucket").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("xor"), F.count("*").alias("m"))
            one = same.groupBy("sum", "xor", "m").agg(F.min("bucket").alias("bucket"))
            tasks = tasks.unionByName(small.join(one.select("bucket"), "bucket").select(F.xxhash64("bucket").alias("task"), "node", "known"))
        found = written(found.unionByName(_decided(tasks, texts, width, share)), "links")
    return found


def near_duplicates(docs: DataFrame, width: int = 5, share: int = 85, count: int = BANDS, rows: int = ROWS, most_nodes: int = MOST_NODES, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document row. Documents are linked if 100 * intersection >= share * union."""
    numbered = written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "numbered", "zstd")
    found = written(signatures(numbered, width, count, rows), "signatures")
    full = found.where("whole is not null")
    equal = full.groupBy("whole").agg(F.min("rid").alias("node"), F.min("doc_id").alias("first_id"), F.count("*").alias("m"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = written(equal, "nodes")
    edges = _links(nodes.select("node", "n", "bands"), numbered.select(F.col("rid").alias("node"), "text"), width, share, most_nodes, most_shingles)
    label = written(_labels(nodes.select("whole", "node", "first_id", "m"), edges), "labelled")
    heads = label.groupBy("known").agg(F.min("first_id").alias("component_id"), F.count("*").alias("nodes"))
    named = written(lookup(label.select("whole", "m", "known"), heads, "known", "nodes", label.count()).select("whole", "m", "component_id"), "named")
    kept: Column = F.col("doc_id").eqNullSafe(F.col("component_id"))
    out = lookup(full.select("whole", "doc_id", "n_shingles"), named, "whole", "m", full.count()).select("doc_id", "n_shingles", "component_id")
    empty = found.where("whole is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(empty).withColumn("kept", kept)
