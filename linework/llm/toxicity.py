"""Toxicity by multiple-instance learning: sentences are instances, documents are bags.

A sentence scores p = sigmoid(bias + sum of the weights of its features); features are its words and their leading
3 to 6 bytes. A sentence without any learned feature scores 0, so that length alone makes no document toxic. A
document's score is the noisy-or 1 - prod(1 - p) over its sentences. Only document labels are known: the weights (of
either sign) and the bias are trained on the noisy-or's likelihood, and then locate the sentences that caused the score.

Training uses at most MOST_TRAIN labelled documents, those with the smallest hash of the id (a documented bound);
their features are counted on the executors, and only packed numbers of those features come to the driver that say something about
the label; how many is bounded by the sample alone. Every document is scored whole.

Nulls: a null or empty text has no sentence and scores 0. A null label doesn't train; of several labels of one id
the largest counts, of several texts of one id the smallest in byte order trains. Repeated documents give repeated rows. Without labels of both kinds nothing is
toxic. Empty tables give an empty result. Other columns are ignored by `scores` and kept by `accepted`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.llm.common import blocks, raw

MOST_TRAIN = 20_000
#: A feature is used if it occurs in so many documents and its log odds are so many standard errors from 0, either way.
LEAST_DOCS, LEAST_Z = 8, 3.5
#: Where training starts: the bias of sentences with features, and each weight.
FIRST_BIAS, FIRST_WEIGHT = -6.0, 1.0
SENTENCE = re.compile(rb"[^.!?\n]+")
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(word: bytes) -> set[bytes]:
    return {word, *(b"^" + word[:k] for k in range(3, 7) if len(word) > k)}


@dataclass
class Model:
    bias: float
    weights: dict[bytes, float]
    known: dict[bytes, float | None] = field(default_factory=dict)

    def word(self, w: bytes) -> float | None:
        """The sum of a word's weights, None without any; remembered, for words repeat."""
        if len(self.known) > 500_000:
            self.known.clear()
        own = [self.weights[f] for f in sorted(features(w)) if f in self.weights]
        x = self.known[w] = sum(own) if own else None
        return x

    def sentences(self, text: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The probability of each sentence with features, and its bytes' start and end."""
        z, spans, known = [], [], self.known
        for m in SENTENCE.finditer(text):
            own = [x for w in set(m[0].translate(WORDS).split()) if (x := known[w] if w in known else self.word(w)) is not None]
            if own:
                z.append(self.bias + sum(own))
                spans.append(m.span())
        return 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -30, 30))), spans

    def score(self, text: bytes) -> tuple[float, list[tuple[int, int, float]]]:
        p, spans = self.sentences(text)
        total = abs(float(np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())))
        return total, [(*spans[i], float(p[i])) for i in np.flatnonzero(p >= 0.5)]


def _training_rows(docs: DataFrame, labels: DataFrame, train: Column, most: int) -> DataFrame:
    """(text, toxic) of the sample; ids repeat neither in labels nor in texts."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.where(train).orderBy(F.xxhash64("_id"), "_id").limit(most)
    slim = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    return slim.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).drop("_id")


def _counts(sample: DataFrame) -> DataFrame:
    """(feature, docs, toxic docs) over the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "text", 24 << 20):
            every, bad = Counter(), Counter()
            for t, y in zip(raw(table.column("text")), table.column("toxic").to_pylist(), strict=True):
                own: set[bytes] = set()
                for w in set(t.translate(WORDS).split()):
                    own |= features(w)
                every.update(own)
                if y:
                    bad.update(own)
            names = list(every)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([every[x] for x in names], pa.int64()), pa.array([bad[x] for x in names], pa.int64())], names=["feature", "n", "bad"])

    return sample.mapInArrow(run, "feature binary, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _bags(sample: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """One row per document: its label, and its sentences' feature numbers laid end to end; featureless ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, flat = [], []  # as little-endian 32-bit numbers
            for t in raw(b.column(b.schema.get_field_index("text"))):
                size, ids = [], []
                for m in SENTENCE.findall(t):
                    own = [number[f] for w in set(m.translate(WORDS).split()) for f in features(w) if f in number]
                    if own:
                        size.append(len(own))
                        ids += own
                sizes.append(np.array(size, "<i4").tobytes())
                flat.append(np.array(ids, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("toxic")), pa.array(sizes, pa.binary()), pa.array(flat, pa.binary())], names=["toxic", "sizes", "flat"])

    return sample.mapInArrow(run, "toxic int, sizes binary, flat binary")


def fit_bags(labels: np.ndarray, sizes: list, flat: list, n: int, rounds: int = 500, decay: float = 1e-4) -> tuple[float, np.ndarray]:
    """Full-batch Adam on the noisy-or likelihood. sizes, flat: each document's numbers. Returns bias and weights."""
    none = np.zeros(0, np.int64)
    size, feature = (np.concatenate([none, *x]).astype(np.int64) for x in (sizes, flat))
    doc = np.repeat(np.arange(len(labels)), [len(s) for s in sizes])
    sent = np.repeat(np.arange(len(size)), size)
    y = labels.astype(np.float64)
    x = np.append(np.full(n, FIRST_WEIGHT), FIRST_BIAS)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, rounds + 1):
        z = x[n] + np.bincount(sent, x[feature], len(size))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        q = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(labels)))
        pull = np.where(y > 0, -q / np.maximum(1 - q, 1e-9), 1.0)[doc] * p / len(labels)
        grad = np.append(np.bincount(feature, pull[sent], n) + decay * x[:n], pull.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.98 * v + 0.02 * grad * grad
        x -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8)
    return float(x[n]), x[:n]


def train(docs: DataFrame, labels: DataFrame, use: Column, most: int = MOST_TRAIN) -> Model:
    """use: condition on `_id` for the labelled ids that may train."""
    sample = _training_rows(docs, labels, use, most).persist()
    try:
        total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        good, bad = total.get(0, 0), sum(n for k, n in total.items() if k)
        if not good or not bad:
            return Model(-30.0, {})
        odds = F.log((F.col("bad") + 0.5) / (bad - F.col("bad") + 0.5)) - F.log((F.col("n") - F.col("bad") + 0.5) / (good - F.col("n") + F.col("bad") + 0.5))
        error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("n") - F.col("bad") + 0.5) + 1 / (bad - F.col("bad") + 0.5) + 1 / (good - F.col("n") + F.col("bad") + 0.5))
        kept = _counts(sample).where(f"n >= {LEAST_DOCS}").withColumn("z", odds / error).where(f"abs(z) >= {LEAST_Z}")
        chosen = sorted(bytes(r["feature"]) for r in kept.select("feature").collect())
        number = {f: i for i, f in enumerate(chosen)}
        rows = sorted((r["toxic"], bytes(r["sizes"]), bytes(r["flat"])) for r in _bags(sample, number).collect())  # the same sums whatever the order of partitions
        sizes, flat = ([np.frombuffer(r[i], "<i4") for r in rows] for i in (1, 2))
        bias, w = fit_bags(np.array([bool(r[0]) for r in rows]), sizes, flat, len(number))
    finally:
        sample.unpersist()
    return Model(bias, {f: float(w[i]) for f, i in number.items()})


def _in_code_points(text: bytes, found: list[tuple[int, int, float]]) -> list[dict]:
    """Spans in ascending order, whose places in bytes become places in code points; the text is decoded once."""
    out, at, seen = [], 0, 0
    for i, j, p in found:
        start = seen + len(text[at:i].decode())
        at, seen = j, start + len(text[i:j].decode())
        out.append({"start": start, "end": seen, "p": p})
    return out


def _apply(docs: DataFrame, model: Model, keep_only: bool) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for b in batches:
            scores, spans = [], []
            for t in raw(b.column(b.schema.get_field_index("text"))):
                total, found = own.score(t)
                scores.append(total)
                if not keep_only:
                    spans.append(_in_code_points(t, found))
            if keep_only:
                yield b.filter(pa.array([x < 0.5 for x in scores], pa.bool_()))
            else:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "sentences"])

    if keep_only:
        return docs.mapInArrow(run, docs.schema)
    return docs.mapInArrow(run, "doc_id long, score double, sentences array<struct<start:long,end:long,p:double>>")


def scores(docs: DataFrame, labels: DataFrame, use: Column | None = None) -> DataFrame:
    """doc_id, score, and the offending sentences (code points, p of at least 0.5) of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _apply(slim, train(slim, labels, F.lit(True) if use is None else use), False)


def accepted(docs: DataFrame, labels: DataFrame, use: Column | None = None) -> DataFrame:
    """The documents that score below 0.5, with all their columns."""
    return _apply(docs, train(docs, labels, F.lit(True) if use is None else use), True)
