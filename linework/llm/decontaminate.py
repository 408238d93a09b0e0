"""Benchmark decontamination with suffix arrays over the training text.

Every block of documents (a shard) gets a suffix array over its words: places are ordered by all that follows them, up to the
first word that the benchmark doesn't have or the document's end. Ranks are found by prefix doubling, together with those of
the benchmark's suffixes, so that each test suffix is binary-searched in the shard's array. Its neighbours there give the
longest verbatim match of each place; the range that shares a window's words gives all places of the window.

Only stretches of benchmark words as long as the shortest window can hold a match, so only their suffixes are sorted, whole.
Equal windows are searched once, with the list of their items behind them, and places with the same items are joined before
items are listed: copies of a passage in documents and in items don't multiply.

The benchmark is the stated query set: it is measured first, and searched in blocks of about BLOCK_BYTES of text (items are
dealt to them by hash, an item isn't cut), each sent to all shards. Nothing is shuffled but the short rows of documents when
there are several such blocks.

Nulls: null text has no words. An item without words has no window. Rows that repeat an item_id are texts of one item. Rows
with a null item_id take no part in `hits` unless it is asked for them (`nameless`); then, as in op10's SQL and in `clean`,
their words are hit like any other's, and `items` holds one null for them. Of equally long matches the first place in the
document counts. Repeated documents give repeated rows. Empty tables give an empty result or no hits. Other columns are
ignored by `hits` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.llm.common import blocks, raw, written

BLOCK_BYTES = 8 << 20
#: Separators of words become a space, A-Z lower case; other bytes stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort alike."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def _doubled(text: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
    """Ranks of places by their next 1, 2, 4, ... words; left: how many words follow each place, its own included. Places
    lie stretch by stretch. Ranks start at 1; the last array orders by all that is left."""
    out = [np.unique(text, return_inverse=True)[1].astype(np.int32) + 1]
    step, n = 1, len(text)
    while n and step < left.max() and out[-1].max() < n:
        rank = out[-1].astype(np.int64)
        behind = np.zeros(n, np.int64)
        more = np.flatnonzero(left > step)
        behind[more] = rank[more + step]
        out.append(np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int32) + 1)
        step *= 2
    return out


def _common(levels: list[np.ndarray], left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the places a and b have in common from there on."""
    out = np.zeros(len(a), np.int64)
    a, b = a.copy(), b.copy()
    open_ = np.ones(len(a), bool)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        # equal ranks of places that both go on so far are equal words
        at = np.flatnonzero(open_)
        same = (levels[k][a[at]] == levels[k][b[at]]) & (left[a[at]] >= step) & (left[b[at]] >= step)
        at = at[same]
        out[at] += step
        ends = (left[a[at]] == step) | (left[b[at]] == step)
        open_[at[ends]] = False
        a[at[~ends]] += step
        b[at[~ends]] += step
    return out


class Queries:
    """The benchmark's windows over its own vocabulary; word number 0 is any other word."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = 13):
        self.window = window
        self.number: dict[bytes, int] = {}
        index: dict[str | None, int] = {}
        texts: dict[bytes, set[int]] = {}  # equal texts are searched once
        for name, text in items:
            w = np.array([self.number.setdefault(x, len(self.number) + 1) for x in words(text)], np.int32)
            if len(w):
                texts.setdefault(w.tobytes(), set()).add(index.setdefault(name, len(index)))
        self.ids = list(index)
        parts = [np.frombuffer(w, np.int32) for w in texts]
        size = np.array([len(w) for w in parts], np.int64)
        #: Distinct texts end to end, and how many words follow each place in its text.
        self.text = np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int64)
        n = len(self.text)
        self.left = np.repeat(np.cumsum(size), size) - np.arange(n)
        whole = np.repeat(size, size)
        starts = np.flatnonzero((self.left >= window) | ((whole < window) & (self.left == whole)))
        length = np.minimum(self.left[starts], window)
        inside = np.arange(window)[None, :] < length[:, None]
        rows = np.where(inside, self.text[np.minimum(starts[:, None] + np.arange(window)[None, :], max(n - 1, 0))] if n else 0, 0)
        self.low, one, back = np.unique(_keys(rows), return_index=True, return_inverse=True)
        self.length = length[one]
        self.high = _keys(np.where(inside[one], rows[one], 2**32 - 1))
        self.shortest = int(length.min()) if len(length) else 0
        # the items behind each window; many windows have the same
        owners = list(texts.values())
        pair = np.unique(back.astype(np.int64) * max(1, len(owners)) + np.repeat(np.arange(len(size)), size)[starts])
        window_, text_ = np.divmod(pair, max(1, len(owners)))
        cut = np.flatnonzero(np.diff(window_, prepend=-1)).tolist()
        groups = [tuple(text_[i:j].tolist()) for i, j in zip(cut, [*cut, len(text_)][1:], strict=True)]
        number = {own: i for i, own in enumerate(dict.fromkeys(groups))}
        self.sets = [sorted(set().union(*(owners[t] for t in own))) for own in number]
        self.owners = np.array([number[own] for own in groups], np.int64)

    def search(self, text: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """text: word numbers; row: each word's document. (place, words that windows cover from there, longest match from there)
        of every place where a window begins, and (place, set of items), each pair once."""
        none = (np.empty(0, np.int64),) * 5
        if not self.shortest or not len(text):
            return none
        # stretches of benchmark words within a document
        cut = np.concatenate(([True], (row[1:] != row[:-1]) | (text[1:] == 0) | (text[:-1] == 0)))
        first = np.flatnonzero(cut)
        size = np.diff(np.concatenate((first, [len(text)])))
        good = (size >= self.shortest) & (text[first] > 0)
        first, size = first[good], size[good]
        if not len(first):
            return none
        n = int(size.sum())
        place = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(n)
        left = np.repeat(np.cumsum(size), size) - np.arange(n)
        both, left = np.concatenate((text[place], self.text)), np.concatenate((left, self.left))
        levels = _doubled(both, left)
        rank = levels[-1]
        begin = np.flatnonzero(left[:n] >= self.shortest)
        begin = begin[np.argsort(rank[begin], kind="stable")]  # the shard's suffix array
        ahead = begin[:, None] + np.arange(self.window)[None, :]
        keys = _keys(np.where(np.arange(self.window)[None, :] < left[begin][:, None], both[np.minimum(ahead, len(both) - 1)], 0))
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        many = hi - lo
        which = np.repeat(np.arange(len(lo)), many)
        slot = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        cover = np.zeros(len(begin), np.int64)
        np.maximum.at(cover, slot, self.length[which])
        hit = np.flatnonzero(cover)
        # test suffixes in their order, and the two around each place that is hit
        tests = n + np.argsort(rank[n:], kind="stable")
        after = np.searchsorted(rank[tests], rank[begin[hit]], "left")
        best = np.zeros(len(hit), np.int64)
        for near in (np.maximum(after - 1, 0), np.minimum(after, len(tests) - 1)):
            best = np.maximum(best, _common(levels, left, begin[hit], tests[near]))
        best = np.where(best >= self.window, best, cover[hit])  # shorter ones count where they are whole items
        pair = np.unique(begin[slot] * len(self.sets) + self.owners[which])
        at, owners = np.divmod(pair, len(self.sets))
        return place[begin[hit]], cover[hit], best, place[at], owners


def _block(table: pa.Table, asked: Queries) -> dict[str, list]:
    get = asked.number.get
    numbers, sizes = [], []
    for t in raw(table.column("text")):
        w = words(t)
        sizes.append(len(w))
        numbers.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
    sizes_ = np.array(sizes, np.int64)
    text = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes_)
    first = np.cumsum(sizes_) - sizes_
    place, cover, best, at, owners = asked.search(text, row)
    mark = np.zeros(len(text) + 1, np.int64)
    mark[place] += 1  # a place is there once
    np.add.at(mark, place + cover, -1)
    hit = np.cumsum(mark)[:-1] > 0
    pad = np.concatenate(([0], np.cumsum(hit)))
    n_hit = pad[first + sizes_] - pad[first] if len(sizes) else np.empty(0, np.int64)
    longest = np.zeros(len(sizes), np.int64)
    where = np.full(len(sizes), -1, np.int64)
    items: list[list[str]] = [[] for _ in sizes]
    spans: list[list[str]] = [[] for _ in sizes]
    if len(place):
        order = np.lexsort((-place, best))
        longest[row[place[order]]] = best[order]
        where[row[place[order]]] = (place - first[row[place]])[order]
        kinds = np.unique(row[at] * len(asked.sets) + owners)
        for d, own in zip((kinds // len(asked.sets)).tolist(), (kinds % len(asked.sets)).tolist(), strict=True):
            items[d].append(own)
        for d in np.unique(kinds // len(asked.sets)).tolist():
            items[d] = [asked.ids[i] for i in sorted(set().union(*(asked.sets[own] for own in items[d])))]
    for i in np.flatnonzero(n_hit).tolist():
        own = np.concatenate(([0], hit[first[i] : first[i] + sizes[i]].astype(np.int8), [0]))
        turn = np.flatnonzero(np.diff(own))
        spans[i] = [f"{a}:{b}" for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)]
    return {"n_words": sizes, "n_hit": n_hit.tolist(), "items": items, "hit_spans": spans, "longest": longest.tolist(), "longest_at": where.tolist()}


RESULT = "n_words long, n_hit long, items array<string>, hit_spans array<string>, longest long, longest_at long"


def _queries(benchmark: DataFrame, window: int, nameless: bool) -> tuple[int, Callable[[int], Queries]]:
    """The number of blocks of items of about BLOCK_BYTES, and how to get one."""
    items = (benchmark if nameless else benchmark.where("item_id is not null")).select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // BLOCK_BYTES) or 1

    def block(i: int) -> Queries:
        some = items.where(F.pmod(F.xxhash64("item_id", F.when(F.col("item_id").isNull(), F.col("text"))), F.lit(n)) == i).collect()
        return Queries(sorted(((r["item_id"], r["text"].encode()) for r in some), key=lambda x: (x[0] is not None, x[0] or "", x[1])), window)

    return n, block


def _searched(docs: DataFrame, asked: Queries, keep_when=None, block_bytes: int = 24 << 20) -> DataFrame:
    """docs with the result's columns behind; keep_when(n_hit, n_words): only those rows, without the result."""
    held = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "text", block_bytes):
            got = _block(table, held.value)
            if keep_when:
                stay = pa.array([bool(keep_when(h, n)) for h, n in zip(got["n_hit"], got["n_words"], strict=True)], pa.bool_())
                yield from table.filter(stay).to_batches()
            else:
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64()]
                out = table.drop_columns(["text"])
                for (name, values), kind in zip(got.items(), kinds, strict=True):
                    out = out.append_column(name, pa.array(values, kind))
                yield from out.to_batches()

    if keep_when:
        return docs.mapInArrow(run, docs.schema)
    return docs.mapInArrow(run, f"doc_id long, {RESULT}")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, nameless: bool = False) -> DataFrame:
    """Per document: n_words, n_hit, items, word spans that are hit, the longest verbatim match and its place."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, block = _queries(benchmark, window, nameless)
    if n == 1:
        return _searched(slim, block(0))
    rows = written(slim.withColumn("rid", F.monotonically_increasing_id()), "numbered")
    return rows.select("rid", "doc_id").join(_merged(rows, n, block), "rid").drop("rid")


def _merged(rows: DataFrame, n: int, block: Callable[[int], Queries]) -> DataFrame:
    """rid and the result of all blocks of queries for written rows (rid, text)."""
    parts = None
    for i in range(n):  # one block of queries is held at a time
        part = written(_searched(rows.select(F.col("rid").alias("doc_id"), "text"), block(i)), "part")
        parts = part if parts is None else parts.unionByName(part)
    span = F.explode_outer("hit_spans")
    flat = parts.select("doc_id", span.alias("span")).where("span is not null").select("doc_id", F.sequence(F.split("span", ":")[0].cast("long"), F.split("span", ":")[1].cast("long") - 1).alias("at"))
    merged = flat.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"))
    # consecutive words share the difference of value and rank
    runs = F.expr("transform(at, (x, i) -> x - i)")
    merged = merged.select("doc_id", F.size("at").cast("long").alias("n_hit"), F.transform(F.array_distinct(runs), lambda r: F.concat_ws(":", F.element_at("at", F.array_position(runs, r).cast("int")), F.element_at("at", (F.size("at") - F.array_position(F.reverse(runs), r) + 1).cast("int")) + 1)).alias("hit_spans"))
    rest = parts.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max(F.struct("longest", (-F.col("longest_at")).alias("at"))).alias("best"))
    return rest.join(merged, "doc_id", "left").select(F.col("doc_id").alias("rid"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "items", F.coalesce("hit_spans", F.array().cast("array<string>")).alias("hit_spans"), F.col("best.longest").alias("longest"), (-F.col("best.at")).alias("longest_at"))


def contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    n, block = _queries(benchmark, window, True)
    if n == 1:
        return _searched(docs, block(0), keep_when=lambda h, n: not contaminated(h, n))
    rid = "__linework_rid"  # ids may repeat or be null: each row is judged on its own text
    rows = written(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    slim = rows.select(F.col(rid).alias("rid"), F.col("text").cast("string").alias("text"))
    bad = _merged(slim, n, block).where("n_hit > 0 and 20 * n_hit >= n_words").select(F.col("rid").alias(rid))
    return rows.join(bad, rid, "left_anti").select(docs.columns)


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)

