"""Packing by non-negative least squares over the corpus's length histogram.

Documents are tokenised once, block by block, and their ids written in the shared folder. A document's full windows are
sequences of their own. For the remainders:

1. lengths are counted over the whole corpus in units of UNIT tokens (the rest below a unit is cut off, to fill windows
   later); only the counts come to the driver;
2. all combinations of up to three remainders that fill a window are enumerated, and the repeat counts that best
   explain the histogram are solved as non-negative least squares;
3. the counts are rounded and limited to what the histogram holds; each remainder's rank among those of its length, which
   needs no more than counts for each partition, tells its window and its place there, so no ids are shuffled;
4. residual remainders and the cut-off ends are packed greedily where they are, longest first, cutting at window
   borders; the last window's worth is cut at powers of two, which need no padding.

So every window is full: padding is 0 whatever the lengths are.

Nulls: a null or empty text is the closing id alone. A null doc_id stays null. Repeated documents are packed as often
as they occur. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linework.llm.common import blocks, raw, written

WINDOW, UNIT, CLOSE = 2048, 32, 1
BLOCK_BYTES = 5 << 20
#: Words and parts of words whose ids a worker remembers between blocks.
WORDS_HELD, STEMS_HELD = 150_000, 400_000
#: ASCII punctuation, but for the apostrophe.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def gather(which: np.ndarray, first: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The stretches of flat that `which` names, end to end; in pieces, so that the indices stay small."""
    out = []
    for lo in range(0, len(which), 1 << 18):
        w = which[lo : lo + (1 << 18)]
        c = size[w]
        out.append(flat[np.repeat(first[w] - (np.cumsum(c) - c), c) + np.arange(c.sum())])
    return np.concatenate(out) if out else flat[:0]


def letters(part: bytes) -> bool:
    """Whether the tokenizer's normaliser leaves nothing but letters."""
    return part.isalpha() or (not part.isascii() and unicodedata.normalize("NFC", part.decode()).lower().isalpha())


class Stems:
    """Ids of parts of words, remembered between blocks; part 0 is empty.

    Parts of letters are encoded many at a time, with spaces between: each ends with the only word end among its ids. Where
    their number isn't that of the word ends, and for all other parts, each is encoded alone.
    """

    JOINED = 200

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.number: dict[bytes, int] = defaultdict(count(1).__next__, {b"": 0})
        self.size, self.first, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint16)
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    def look_up(self, parts: list[bytes]) -> np.ndarray:
        number, old = self.number, len(self.number)
        out = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
        new = list(islice(number, old, None))
        joined, alone = [], []
        for i, x in enumerate(new):
            (joined if letters(x) else alone).append(i)
        places, sizes, ids = [], [], [self.flat]
        for at in range(0, len(joined), 100 * self.JOINED):
            some = [joined[k : k + self.JOINED] for k in range(at, min(at + 100 * self.JOINED, len(joined)), self.JOINED)]
            texts = [b" ".join([new[i] for i in own]).decode() for own in some]
            for own, e in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                flat = np.array(e.ids, np.uint16)
                size = np.diff(np.flatnonzero(self.ends[flat]), prepend=-1)
                if len(size) == len(own) and size.sum() == len(flat):
                    places += own
                    sizes.append(size)
                    ids.append(flat)
                else:
                    alone += own
        for at in range(0, len(alone), 20_000):
            own = alone[at : at + 20_000]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([new[i].decode() for i in own], add_special_tokens=False)]
            places += own
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), np.uint16))
        size = np.concatenate([np.zeros(0, np.int64), *sizes])
        order = np.array(places, np.int64)
        first = np.empty(len(new), np.int64)
        first[order] = len(self.flat) + np.cumsum(size) - size
        own_size = np.empty(len(new), np.int64)
        own_size[order] = size
        self.size, self.first = np.concatenate((self.size, own_size)), np.concatenate((self.first, first))
        self.flat = np.concatenate(ids)
        return out


class Words:
    """Ids of white-space separated words, as the tokenizer gives them for the whole text.

    It never joins across white space, and folds case, so a text's ids are those of its lower-cased words. It never
    joins letters and punctuation either (but for the apostrophe of contractions), so a word that its normaliser leaves
    as letters with ASCII punctuation behind is encoded as these two parts. Strings of special tokens keep their case, for
    the tokenizer knows them before it folds it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the machine already
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.stems = Stems(self.tokenizer)
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.size, self.first, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def cut(self, text: bytes) -> list[bytes]:
        """A text's words; those of a text that may hold a special token keep their case."""
        low = text.lower()
        return (text if any(s.lower() in low for s in self.special) else low).split()

    @staticmethod
    def stems_of(words: Iterable[bytes]) -> list[bytes]:
        """For each word its letters and the punctuation behind them, which are encoded apart; else the word and nothing."""
        out = []
        for w in words:
            stem = w.rstrip(MARKS)
            out += (stem, w[len(stem) :]) if len(stem) < len(w) and letters(stem) else (w, b"")
        return out

    def encode(self, texts: list[bytes], close: int) -> tuple[np.ndarray, np.ndarray]:
        """All documents' ids end to end, each with the closing id, and their counts."""
        if len(self.number) > WORDS_HELD:
            self.forget()
        if len(self.stems.number) > STEMS_HELD:
            self.stems = Stems(self.tokenizer)
        number, old = self.number, len(self.number)
        rows, lens = [], []
        for t in texts:
            w = self.cut(t)
            lens.append(len(w))
            rows.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
        if len(number) > old:
            index = self.stems.look_up(self.stems_of(islice(number, old, None)))
            s = self.stems
            self.flat = np.concatenate((self.flat, gather(index, s.first, s.size, s.flat)))
            self.size = np.concatenate((self.size, s.size[index].reshape(-1, 2).sum(1)))
            self.first = np.cumsum(self.size) - self.size
        word = np.concatenate(rows) if rows else np.empty(0, np.int32)
        doc = np.repeat(np.arange(len(texts)), lens)
        total = np.bincount(doc, self.size[word], len(texts)).astype(np.int64) + 1
        out = np.full(int(total.sum()), close, np.uint16)
        place = np.ones(len(out), bool)
        place[np.cumsum(total) - 1] = False
        out[place] = gather(word, self.first, self.size, self.flat)
        return out, total


@cache
def _words(path: str) -> Words:
    return Words(path)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """argmin |a x - b| for x >= 0, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    slope = a.T @ (b - a @ x)
    for _ in range(rounds):
        open_ = np.where(free, -np.inf, slope)
        j = int(np.argmax(open_))
        if open_[j] <= 1e-8:
            break
        free[j] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min(initial=0) > -1e-12:
                break
            low = free & (s <= 0)
            gap = x[low] - s[low]
            x = x + np.min(np.where(gap > 0, x[low] / np.where(gap > 0, gap, 1), 0)) * (s - x)
            free &= x > 1e-12
        x = np.maximum(s, 0)
        slope = a.T @ (b - a @ x)
    return x


@cache
def combinations(units: int, depth: int = 3) -> list[tuple[int, ...]]:
    """Ascending lengths, two to depth of them, that add up to units."""

    def grow(start: int, left: int, held: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if held and start <= left:
            yield (*held, left)
        if len(held) + 2 <= depth:
            for k in range(start, left // 2 + 1):
                yield from grow(k, left - k, (*held, k))

    return sorted(set(c for c in grow(1, units, ()) if len(c) > 1))


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and their repeats that the histogram (by units, 0 unused) can fill."""
    units = len(histogram)
    if not histogram.any():
        return []
    every = combinations(units)
    a = np.zeros((units, len(every)))
    for j, c in enumerate(every):
        for k in c:
            a[k, j] += 1
    x = nnls(a[1:], histogram[1:].astype(float))
    left, out = histogram.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable").tolist():
        need = a[:, j].astype(np.int64)
        most = int((left[need > 0] // need[need > 0]).min())
        times = min(int(np.rint(x[j])), most)
        if times > 0:
            left -= need * times
            out.append((every[j], times))
    return out


@dataclass
class Slots:
    """Where remainders of each length in units go: by rank, the run of slots that starts at or before it."""

    first: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    capacity: dict[int, int]

    @classmethod
    def of(cls, chosen: list[tuple[tuple[int, ...], int]], unit: int) -> Slots:
        held: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for combo, times in chosen:
            at = 0
            for k in combo:
                held.setdefault(k, []).append((used.get(k, 0), sequence, at))
                used[k] = used.get(k, 0) + times
                at += k * unit
            sequence += times
        column = lambda i: {k: np.array([x[i] for x in v], np.int64) for k, v in held.items()}
        return cls(column(0), column(1), column(2), used)


def pieces(total: np.ndarray, rank: np.ndarray, slots: Slots, window: int = WINDOW, unit: int = UNIT) -> tuple[np.ndarray, ...]:
    """(doc, start, length, sequence, offset, local) arrays that pack documents of `total` ids into full windows.

    rank: each remainder's place among those of its length in units. local: sequences numbered from 0 for this call alone.
    """
    out: list[tuple] = []
    full = total // window
    d = np.repeat(np.arange(len(total)), full)
    k = np.arange(len(d)) - np.repeat(np.cumsum(full) - full, full)
    out.append((d, k * window, np.full(len(d), window), np.arange(len(d)), np.zeros(len(d), np.int64), np.ones(len(d), bool)))
    sequence = len(d)
    rest, from_ = total % window, full * window
    u = rest // unit
    placed = np.zeros(len(total), bool)
    for size, first in slots.first.items():
        own = np.flatnonzero((u == size) & (rank < slots.capacity[size]))
        i = np.searchsorted(first, rank[own], "right") - 1
        placed[own] = True
        out.append((own, from_[own], np.full(len(own), size * unit), slots.sequence[size][i] + rank[own] - first[i], slots.offset[size][i], np.zeros(len(own), bool)))
    # the residual stream: whole remainders, longest first, then the ends cut off above
    whole = np.flatnonzero(~placed & (rest > 0))
    whole = whole[np.argsort(-rest[whole], kind="stable")]
    ends = np.flatnonzero(placed & (rest % unit > 0))
    own = np.concatenate((whole, ends))
    begin = np.concatenate((from_[whole], from_[ends] + u[ends] * unit))
    size = np.concatenate((rest[whole], rest[ends] % unit))
    stop = np.cumsum(size)
    all_ = int(size.sum())
    borders = list(range(0, all_ - all_ % window + 1, window))
    left = all_ % window
    while left:  # powers of two, largest first
        borders.append(borders[-1] + (1 << (left.bit_length() - 1)))
        left -= 1 << (left.bit_length() - 1)
    cuts = np.union1d(np.concatenate(([0], stop)), borders).astype(np.int64)
    a, b = cuts[:-1], cuts[1:]
    i = np.searchsorted(stop, a, "right")
    w = np.searchsorted(borders, a, "right") - 1
    out.append((own[i], begin[i] + a - (stop - size)[i], b - a, sequence + w, a - np.array(borders, np.int64)[w], np.ones(len(a), bool)))
    return tuple(np.concatenate(x).astype(x[0].dtype if x[0].dtype == bool else np.int64) for x in zip(*out, strict=True))


def tokenised(docs: DataFrame, path: str, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """(part, doc_id, total, size, rank, ids): ids as unsigned 16-bit numbers, the remainder's length in units, and its
    rank among the part's remainders of that length. Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(window // unit, np.int64)
        encoder = _words(path)
        for table in blocks(batches, "text", BLOCK_BYTES):
            ids, total = encoder.encode(raw(table.column("text")), CLOSE)
            size = total % window // unit
            order = np.argsort(size, kind="stable")
            among = np.empty(len(size), np.int64)
            counts = np.bincount(size, minlength=len(seen))
            among[order] = np.arange(len(size)) - np.repeat(np.cumsum(counts) - counts, counts)
            rank = seen[size] + among
            seen += counts
            last = np.cumsum(total)
            data = [ids[i:j].tobytes() for i, j in zip((last - total).tolist(), last.tolist(), strict=True)]
            columns = [pa.array(np.full(len(total), part), pa.int32()), table.column("doc_id").combine_chunks(), pa.array(total), pa.array(size, pa.int32()), pa.array(rank), pa.array(data, pa.binary())]
            yield from pa.table(dict(zip(("part", "doc_id", "total", "size", "rank", "ids"), columns, strict=True))).to_batches(2000)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(slim.mapInArrow(run, "part int, doc_id long, total long, size int, rank long, ids binary"), "ids", compression="zstd")


#: The parts' counts are sent to all tasks up to so many rows, and joined by a shuffle beyond.
MOST_SENT = 200_000


def pack(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """One row per piece; with_ids: its ids too, as little-endian unsigned 32-bit numbers."""
    rows = tokenised(docs, vocabulary or default_vocabulary(), window, unit)
    counts = written(rows.groupBy("part", "size").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(window // unit, np.int64)
    for r in counts.where("size > 0").groupBy("size").agg(F.sum("n").alias("n")).collect():
        histogram[r["size"]] = r["n"]
    held = docs.sparkSession.sparkContext.broadcast(Slots.of(plan(histogram), unit))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if offsets.count() <= MOST_SENT:
        offsets = F.broadcast(offsets)
    ranked = rows.join(offsets, ["part", "size"]).select("doc_id", "total", (F.col("rank") + F.col("before")).alias("rank"), "ids")
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = (1 << 50) + (TaskContext.get().partitionId() << 28)  # this task's own sequences, beside the planned ones
        for table in blocks(batches, "ids", BLOCK_BYTES):
            total = table.column("total").to_numpy()
            ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.uint16)
            first = np.cumsum(total) - total
            doc, start, length, seq, off, local = pieces(total, table.column("rank").to_numpy(), held.value, window, unit)
            names = table.column("doc_id").combine_chunks()
            for lo in range(0, len(doc), 20_000):
                s = slice(lo, lo + 20_000)
                a = first[doc[s]] + start[s]
                data = [ids[i:j].astype("<u4").tobytes() for i, j in zip(a.tolist(), (a + length[s]).tolist(), strict=True)]
                crc = np.fromiter(map(zlib.crc32, data), np.int64, len(data))
                columns = {"doc_id": names.take(pa.array(doc[s])), "start": start[s], "length": length[s], "ids_crc32": crc, "doc_tokens": total[doc[s]], "sequence_id": np.where(local[s], sequence + seq[s], seq[s]), "offset": off[s]}
                yield from pa.table(columns | ({"ids": pa.array(data, pa.binary())} if with_ids else {})).to_batches()
            sequence += int(seq[local].max(initial=-1)) + 1

    return ranked.mapInArrow(run, kinds)
