"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.storage import written

__all__ = ["HOT_SHARE", "blocks", "grouped", "id_bucket", "lookup", "raw", "written"]

#: A key with at least this share of all rows is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1e-3
#: What a row costs beside its text: an id, a length, a few counts.
ROW_BYTES = 64


def id_bucket(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % modulus


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left-joins right, which has one row per key, without sending a hot key's rows to one task.

    weight: the column of right with the key's number of rows in left. At most 1 / HOT_SHARE keys reach that
    share of total, so they are broadcast; the others are joined by a shuffle in which no key is large.
    left rows with a null key keep null columns.
    """
    least = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(right.where(F.col(weight) >= least))
    names = [c for c in right.columns if c != key]
    there = left.join(hot.withColumn("_hot", F.lit(True)), key, "left")
    first = there.where("_hot").drop("_hot")
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(weight) < least), key, "left")
    cols = [*left.columns, *names]
    return first.select(cols).unionByName(rest.select(cols))


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.Table]:
    """Joins and cuts Arrow batches into tables that hold `most` bytes of text or at most one row more; rows aren't cut. A row counts as
    ROW_BYTES more than its text, so empty texts fill a block too."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        stop, at = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES), 0
        while at < batch.num_rows:
            before = int(stop[at - 1]) if at else 0
            end = min(int(np.searchsorted(stop, before + most - size)) + 1, batch.num_rows)
            held.append(batch.slice(at, end - at))
            size, at = size + int(stop[end - 1]) - before, end
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, one table after the other, of batches that are sorted by the key (a long without nulls). A group may reach
    over batches; its slices are joined once."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[at] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, end - at))
            last = keys[at]
    if held:
        yield pa.Table.from_batches(held)


def raw(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
