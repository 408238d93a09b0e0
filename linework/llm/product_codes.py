"""Product quantisation of vectors in integers: nearest entries by float32 products that are screened rigorously.

A component x is the integer floor(scale * x). Vectors are cut into equal consecutive parts, and each part position has a
codebook that starts as that part of the vectors with the smallest ids. A round assigns every part to the nearest entry
and moves each entry to the floor of its parts' mean; entries without parts stay.

Nearest entries. |x - c|**2 orders entries as |c|**2 - 2 x.c does, which one float32 matrix product gives for a block of
rows and all entries. With u = 2**-24, a float32 dot product of w terms whose factors were rounded too is off by at most
g(w + 2) * sum |x_i c_i|, whatever the order of its sum, g(n) = n u / (1 - n u); |c|**2 is exact and rounded once, and the
difference once more. So the score is off by at most g(w + 4) * (|c|**2 + 2 |x| |c|). Every entry whose interval reaches
down to the lowest upper end is evaluated again in int64, and of the equally near ones the first is taken: the result is
that of integer arithmetic, whatever the rounding.

Where the work is. Each round reads the vectors once; a task sends one sum for each (part, entry, place) that it has, so
what is exchanged doesn't grow with its rows. Only the codebooks (entries x components, a bounded model) pass through the
driver.

Nulls: a null vector, or one with a null or non-finite component, is dropped. A null id is larger than any other, rows with
equal ids follow their components; equal rows give equal result rows. Rows with a null label are one group. Fewer vectors than
entries give smaller codebooks; an empty table gives an empty result; vectors without components have code 00... and error 0.
Kept vectors of different lengths, or of a length that the parts don't divide, are an error, and so are components so large
that an error could leave 64 bits (beyond about 2**26 in 64 components). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.llm.common import lookup, written

#: Rows of a block: with 64 entries, a few arrays of 4 MB.
ROWS = 8192


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of int64 rows: the index of the nearest entry (the first of equals), its squared distance, and the number of entries that
    were evaluated in int64."""
    square, length = (book * book).sum(1), x.shape[1]
    score = square.astype(np.float32)[None, :] - np.float32(2) * (x.astype(np.float32) @ book.astype(np.float32).T)
    n = (length + 4) * 2.0**-24
    norms = np.sqrt((x * x).sum(1).astype(np.float64))[:, None] * np.sqrt(square.astype(np.float64))[None, :]
    reach = n / (1 - n) * (square[None, :] + 2 * norms) * (1 + 1e-6)  # the last factor covers the float64 steps
    middle = score.astype(np.float64)
    row, entry = np.nonzero(middle - reach <= (middle + reach).min(1)[:, None])
    away = x[row] - book[entry]
    distance = (away * away).sum(1)
    starts = np.searchsorted(row, np.arange(len(x)))
    best = np.minimum.reduceat(distance, starts)
    first = np.flatnonzero(distance == best[row])
    first = first[np.searchsorted(row[first], np.arange(len(x)))]
    return entry[first], best, len(row)


def integers(vectors: pa.Array, length: int, scale: int) -> np.ndarray:
    """floor(scale * x) as int64 rows of `length` components."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != length).any():
        raise ValueError(f"a vector has {sizes[sizes != length][0]} components, the first has {length}")
    x = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if x.size and 4 * length * (np.abs(x).max() + 1) ** 2 >= 2.0**63:
        raise OverflowError("components are too large for 64-bit distances")
    return x.astype(np.int64).reshape(len(sizes), length)


def _assigned(batch: pa.RecordBatch, column: int, books: np.ndarray, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, vectors by part, entries, squared distances) for blocks of the batch."""
    parts, _, width = books.shape
    for at in range(0, batch.num_rows, ROWS):
        x = integers(batch.column(column).slice(at, ROWS), parts * width, scale)
        x = x.reshape(len(x), parts, width)
        found = [nearest(x[:, p], books[p]) for p in range(parts)]
        yield at, x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _moved(kept: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for _, x, entry, _ in _assigned(b, 0, books, scale):
                for p in range(parts):
                    np.add.at(total[p], entry[:, p], x[:, p])
                    count[p] += np.bincount(entry[:, p], minlength=entries)
        part, entry, place = (i.ravel() for i in np.indices(books.shape))
        used = count[part, entry] > 0
        yield pa.RecordBatch.from_arrays([pa.array(v[used]) for v in (part, entry, place, total.ravel(), count[part, entry])], names=["part", "entry", "place", "total", "n"])

    sums = kept.select("vector").mapInArrow(run, "part long, entry long, place long, total long, n long")
    sums = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    moved = books.copy()
    for r in sums.collect():  # one row for each component of the codebooks
        moved[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return moved


def fit(kept: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> np.ndarray:
    """Codebooks as int64 [part, entry, place], of rows (id, vector)."""
    first = kept.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    length = len(first[0]["vector"]) if first else 0
    if length % parts:
        raise ValueError(f"{parts} equal parts don't make {length} components")
    starts = integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), length, scale)
    books = starts.reshape(len(first), parts, length // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if length and first else 0):
        books = _moved(kept, books, scale)
    return books


def encoded(kept: DataFrame, books: np.ndarray, scale: int = 256) -> DataFrame:
    """(id, label, code, error) of rows (id, label, vector): two hex digits for each part, and the squared distance to the entries."""
    if books.shape[1] > 256:
        raise ValueError("two hex digits hold 256 entries at most")
    digits, kind = 2 * len(books), kept.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, _, entry, distance in _assigned(b, 2, books, scale):
                text = entry.astype(np.uint8).tobytes().hex()
                codes = pa.array([text[i : i + digits] for i in range(0, len(text), digits)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, ROWS), b.column(1).slice(at, ROWS), codes, pa.array(distance.sum(1))], names=["id", "label", "code", "error"])

    return kept.select("id", "label", "vector").mapInArrow(run, f"id long, label {kind}, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, as decimal text joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) for each kept row; label_error is the error summed over equal labels."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kept = rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    books = fit(kept, parts, entries, rounds, scale)
    group = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))  # nulls are one group
    coded = written(encoded(kept, books, scale).withColumn("label", group), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    found = lookup(coded, sums, "label", "n", coded.count())
    return found.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
