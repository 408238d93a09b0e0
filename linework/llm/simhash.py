"""SimHash near-duplicates: exact Hamming neighbours by vantage-point trees, then connected components.

Fingerprints: the majority of each bit over the XXH64 hashes of a text's word shingles.

Shards. Random 64-bit codes lie 32 +- 4 bits apart, so rings of Hamming distance around whole-code vantage points
overlap almost wholly at radius 4 and each level would copy most fingerprints to both sides. Distance on a subset
of the bits is a lower bound of the whole distance, so the upper levels partition by it instead: the code is cut
into radius + k bands, and two fingerprints within the radius agree on k bands at least, i.e. lie at distance 0 in
that subspace. A fingerprint is sent to one shard for each choice of k bands (the shards that its ball overlaps);
k grows with the number of fingerprints, so that shards stay small. In each shard a vantage-point tree splits by
the whole Hamming distance, prunes branches by the triangle inequality, and takes a branch whole when it lies
inside the query's ball. Shards emit a spanning star for each local component, never all pairs.

Nulls and empty texts have fingerprint zero and are linked like any other. Equal fingerprints are one node.
Repeated rows give repeated result rows. A null doc_id takes no part in the smallest id unless its component has
no other. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.llm.common import lookup, raw, written
from linework.operators import graph

LEAF = 128


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    first, last = (ends - size), ends
    k = min(width, len(words))
    starts, stops = first[: len(words) - k + 1].tolist(), last[k - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    on = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(on.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, rid: str | None = None) -> DataFrame:
    """(doc_id, fp), and rid if docs has row numbers of that name: fp is the unsigned fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width, seed) for t in raw(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], names=["doc_id", "fp", *["rid"][: rid is not None]])

    more = [] if rid is None else [F.col(rid).alias("rid")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).mapInArrow(run, "doc_id long, fp long" + ", rid long" * len(more))


def _distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class _Sets:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


class VantageTree:
    """Vantage-point tree over distinct 64-bit codes, for a self-join within a radius."""

    def __init__(self, codes: np.ndarray, leaf: int = LEAF):
        self.codes, self.leaf = codes, leaf
        self.root = self._build(np.arange(len(codes)))

    def _build(self, ids: np.ndarray) -> tuple:
        if len(ids) <= self.leaf:
            return ("leaf", ids)
        at = ids[0]
        rest = ids[1:]
        d = _distance(self.codes[rest], self.codes[at])
        middle = np.median(d)
        near = d <= middle
        if near.all():  # all at one distance or nearer: cut the ball by rank, bounds stay true
            near = np.arange(len(d)) < len(d) // 2
        inner, outer = rest[near], rest[~near]
        return ("node", at, self._build(inner), (int(d[near].min()), int(d[near].max()), inner), self._build(outer), (int(d[~near].min()), int(d[~near].max()), outer))

    def components(self, radius: int) -> np.ndarray:
        """The smallest index that each code reaches over links of at most radius bits."""
        sets = _Sets(len(self.codes))
        self._visit(self.root, np.arange(len(self.codes)), radius, sets)
        return np.array([sets.find(i) for i in range(len(self.codes))])

    def _visit(self, node: tuple, asked: np.ndarray, radius: int, sets: _Sets) -> None:
        if not len(asked):
            return
        if node[0] == "leaf":
            ids = node[1]
            for lo in range(0, len(asked), 4096):
                q = asked[lo : lo + 4096]
                a, b = np.nonzero(_distance(self.codes[q][:, None], self.codes[ids][None, :]) <= radius)
                a, b = q[a], ids[b]
                apart = a < b
                for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                    sets.link(x, y)
            return
        _, at, inner, inside, outer, outside = node
        d = _distance(self.codes[asked], self.codes[at])
        for x in asked[d <= radius].tolist():
            sets.link(x, int(at))
        for branch, (least, most, ids) in ((inner, inside), (outer, outside)):
            whole = d + most <= radius  # the branch lies in the query's ball
            for x in asked[whole].tolist():
                sets.link(x, int(ids[0]))
            if whole.any():
                for y in ids.tolist():
                    sets.link(int(ids[0]), y)
            self._visit(branch, asked[~whole & (d - radius <= most) & (d + radius >= least)], radius, sets)


def band_masks(radius: int, agree: int) -> list[int]:
    """Masks of each choice of `agree` bands out of radius + agree nearly equal ones."""
    n = radius + agree
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    bands = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(x) for x in combinations(bands, agree)]


def links(fps: DataFrame, count: int, radius: int = 4, shard_size: int = 1000) -> DataFrame:
    """(a, b): spanning links between distinct fingerprints at most `radius` bits apart. fps: one row per fp."""
    spark = fps.sparkSession
    agree = 1
    while count > shard_size * 2 ** (64 * agree // (radius + agree)) and agree < 8:
        agree += 1
    masks = [m - (1 << 64) if m >> 63 else m for m in band_masks(radius, agree)]
    shards = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("band", "part"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards.repartition(parts, "band", "part").sortWithinPartitions("band", "part", "fp")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:  # a shard may reach over the end of a batch
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = (frame["band"] == frame["band"].iloc[-1]) & (frame["part"] == frame["part"].iloc[-1])
            held = frame[last]
            yield from solve(frame[~last])
        if held is not None:
            yield from solve(held)

    def solve(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(frame) < 2:
            return
        band, part, codes = frame["band"].to_numpy(), frame["part"].to_numpy(), frame["fp"].to_numpy().view(np.uint64)
        new = np.flatnonzero((band[1:] != band[:-1]) | (part[1:] != part[:-1])) + 1
        edges = np.concatenate(([0], new, [len(codes)]))
        out = []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if hi - lo > 1:
                own = codes[lo:hi]
                root = VantageTree(own).components(radius)
                away = root != np.arange(len(own))
                if away.any():
                    out.append(pd.DataFrame({"a": own[away].view(np.int64), "b": own[root[away]].view(np.int64)}))
        if out:
            yield pd.concat(out, ignore_index=True)

    return shards.mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) reaches."""
    return graph.components(edges).withColumnRenamed("component", "label")


def _heads(rows: DataFrame, first: Column, radius: int) -> tuple[DataFrame, DataFrame, dict]:
    """(fp, n, label), the smallest `first` of each label as component_id, and the numbers of fingerprints and rows."""
    nodes = written(rows.groupBy("fp").agg(F.min(first).alias("first_id"), F.count("*").alias("n")), "nodes")
    stat = nodes.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    found = components(links(nodes.select("fp"), stat["k"], radius))
    label = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    label = written(label, "labelled")
    heads = label.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count("*").alias("m"))
    return label, heads, stat.asDict()


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id: one row per document row."""
    rows = written(fingerprints(docs, width, seed), "fingerprints")
    label, heads, stat = _heads(rows, F.col("doc_id"), radius)
    named = lookup(label.select("fp", "n", "label"), heads, "label", "m", stat["k"]).select("fp", "n", "component_id")
    return lookup(rows, written(named, "named"), "fp", "n", stat["n"]).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    Ids may repeat or be null (null ones come last), so the rows are numbered: one row stays, whatever the others' ids.
    """
    rid = "__linework_rid"
    numbered = written(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    rows = written(fingerprints(numbered, width, rid=rid), "fingerprints")
    _, heads, _ = _heads(rows, F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid"), radius)
    return numbered.join(heads.select(F.col("component_id.rid").alias(rid)), rid, "left_semi").select(docs.columns)
