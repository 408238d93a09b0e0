"""Language identification with a string kernel: presence of blended byte n-grams, Nystroem landmarks, ridge regression.

A text is the set of its byte 1-, 2- and 3-grams (case folded, other than letters one space). The kernel of two texts is
|common| / sqrt(|a| |b|), exact: a text's n-grams are counted without hashing, and those it shares with landmark texts are
found by a table of the landmarks' n-grams. One-versus-rest kernel ridge regression on the landmark features gives one
number per language, and whole batches are scored by two matrix products.

Training takes a bounded sample, at most MOST_TRAIN texts, dealt evenly over the languages (the MOST_TRAIN most frequent
ones) and chosen by the smallest hash of the text: which texts they are doesn't depend on partitions or ids, and copies
count once. Every document is predicted from its whole text.

Nulls: a null text, and one without a letter, is `und` with score 0. Rows without lang don't train. Without any
training row everything is `und`. Equal scores go to the first language in alphabetical order. Repeated documents
give repeated rows, an empty table an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.llm.common import raw

MOST_TRAIN, MOST_EACH, LANDMARKS, RIDGE = 4000, 600, 128, 0.05
#: n-grams of 3 bytes are numbered by their bytes, those of 2 and 1 behind them.
PAIRS, SINGLES, GRAMS = 1 << 24, (1 << 24) + (1 << 16), (1 << 24) + (1 << 16) + (1 << 8)
SPACES = bytes(32 if c < 128 and not (65 <= c <= 90 or 97 <= c <= 122) else c for c in range(256))
BATCH = 256
SHARP = 6.0
MASK = (1 << 53) - 1


@cache
def _scratch() -> np.ndarray:
    return np.zeros(GRAMS, np.int32)


def grams(text: bytes) -> np.ndarray:
    """The numbers of a text's distinct n-grams, in any order."""
    a = np.frombuffer(b" " + text.decode().lower().encode().translate(SPACES) + b" ", np.uint8).astype(np.int32)
    pair = a[:-1] << 8 | a[1:]
    every = np.concatenate((a + SINGLES, pair + PAIRS, pair[:-1] << 8 | a[2:]))
    # of equal numbers the last writer of the shared table stays
    place, last = np.arange(len(every), dtype=np.int32), _scratch()
    last[every] = place
    return every[last[every] == place]


def presence(texts: list[bytes], known: np.ndarray | None = None) -> np.ndarray:
    """One row of 0 and 1 for each text: which of the n-grams `known` (ascending; None: all of the texts) it has."""
    sets = [grams(t) for t in texts]
    known = np.unique(np.concatenate(sets)) if known is None else known
    return _rows(sets, _places(known), len(known))


def _places(known: np.ndarray) -> np.ndarray:
    """Each n-gram's place among `known`; len(known) for all others."""
    table = np.full(GRAMS, len(known), np.int32)
    table[known] = np.arange(len(known))
    return table


def _rows(sets: list[np.ndarray], table: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(sets), n + 1), np.float32)
    for row, own in zip(out, sets, strict=True):
        row[table[own]] = 1
    return out[:, :n]


def kernel(x: np.ndarray, y: np.ndarray, nx: np.ndarray | None = None, ny: np.ndarray | None = None) -> np.ndarray:
    """x, y: presence rows; nx, ny: the texts' numbers of n-grams, where the rows don't have all of them."""
    nx, ny = x.sum(1) if nx is None else nx, y.sum(1) if ny is None else ny
    return (x @ y.T) / np.sqrt(np.maximum(nx, 1)[:, None] * np.maximum(ny, 1)[None, :])


@dataclass
class Model:
    languages: list[str]
    known: np.ndarray  # the landmarks' n-grams
    landmarks: np.ndarray  # their presence, packed bits
    weights: np.ndarray  # landmarks x languages, Nystroem's root folded in
    bias: np.ndarray

    def opened(self) -> tuple[np.ndarray, np.ndarray]:
        return _places(self.known), np.unpackbits(self.landmarks, axis=1)[:, : len(self.known)].astype(np.float32)

    def predict(self, texts: list[bytes], opened: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        table, marks = opened or self.opened()
        names, sure = [], []
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            sets = [grams(t) for t in part]
            s = kernel(_rows(sets, table, len(self.known)), marks, np.array([len(x) for x in sets], np.float32)) @ self.weights + self.bias
            e = np.exp(SHARP * (s - s.max(1, keepdims=True)))
            best = s.argmax(1)
            share = e[np.arange(len(part)), best] / e.sum(1)
            for t, b, p in zip(part, best.tolist(), share.tolist(), strict=True):
                letters = any(map(str.isalpha, t.decode()))
                names.append(self.languages[b] if letters else "und")
                sure.append(float(p) if letters else 0.0)
        return names, sure


def fit(x: list[np.ndarray], y: list[str]) -> Model:
    """x: the texts' sets of n-grams, y: their languages, both in a fixed order."""
    languages = sorted(set(y))
    if not languages:
        return Model([], np.zeros(0, np.int32), np.zeros((0, 0), np.uint8), np.zeros((0, 0)), np.zeros(0))
    own = {k: [i for i, v in enumerate(y) if v == k] for k in languages}
    share = max(1, LANDMARKS // len(languages))
    chosen = [x[i] for k in languages for i in own[k][:share]]
    known = np.unique(np.concatenate(chosen))
    table = _places(known)
    marks = _rows(chosen, table, len(known))
    value, vector = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    root = vector / np.sqrt(np.maximum(value, 1e-6))
    sets = [x[at : at + BATCH] for at in range(0, len(x), BATCH)]
    z = np.concatenate([kernel(_rows(s, table, len(known)), marks, np.array([len(v) for v in s], np.float32)) for s in sets]) @ root
    target = np.where(np.array(y)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = np.array([1 / len(own[k]) for k in y])[:, None] * len(y) / len(languages)  # languages count alike
    centre, mean = (weight * z).sum(0) / weight.sum(), (weight * target).sum(0) / weight.sum()
    zc = z - centre
    w = np.linalg.solve(zc.T @ (weight * zc) + RIDGE * len(y) / 100 * np.eye(z.shape[1]), zc.T @ (weight * (target - mean)))
    return Model(languages, known.astype(np.int32), np.packbits(marks.astype(bool), axis=1), (root @ w).astype(np.float32), (mean - centre @ w).astype(np.float32))


def train(docs: DataFrame, use: Column) -> Model:
    """use: condition on doc_id for the rows that may train."""
    slim = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & use).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = slim.withColumn("h", F.xxhash64("text", F.lit("language")).bitwiseAND(MASK))
    most = known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_TRAIN)
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    if not sizes:
        return fit([], [])
    each = max(1, min(MOST_EACH, MOST_TRAIN // len(sizes)))
    # texts whose hash lies below a rate that leaves about twice as many as needed, with small languages whole
    rates = docs.sparkSession.createDataFrame([(k, int(min(1.0, (2 * each + 50) / max(n, 1)) * MASK)) for k, n in sizes.items()], "_lang string, _rate long")
    chosen = known.join(F.broadcast(rates), known["lang"] == F.col("_lang")).where("h <= _rate").select("h", "lang", "text").dropDuplicates(["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.sort(grams(t)).astype("<i4").tobytes() for t in raw(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], names=["h", "lang", "grams"])

    rows = chosen.mapInArrow(run, "h long, lang string, grams binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["h"], bytes(r["grams"])))
    held: dict[str, list] = {}
    for r in rows:
        if len(own := held.setdefault(r["lang"], [])) < each:
            own.append(np.frombuffer(r["grams"], "<i4"))
    return fit([x for k in sorted(held) for x in held[k]], [k for k in sorted(held) for _ in held[k]])


def identify(docs: DataFrame, use: Column | None = None) -> DataFrame:
    """doc_id, lang_pred, score of every document, learnt from the rows that `use` admits."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, F.lit(True) if use is None else use))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = held.value.opened() if held.value.languages else None
        for b in batches:
            names, sure = held.value.predict(raw(b.column(1)), opened)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
