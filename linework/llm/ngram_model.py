"""Language-model scoring with sharded Elias-Fano bigram tries.

Model. p(w | v) = (c(v w) + mu * low(w)) / (c(v) + mu), low(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)): Dirichlet smoothing
over the training vocabulary and one class for all other words, normalised. The numerators, over N + mu, are stored
as 16-bit codes of their logarithm: one for each bigram, and one for each word alone, its backoff.

Sharding. Bigrams are dealt by their second word w, so a shard has c(v w) and c(w) of its words whole. What is
missing, c(v) of the contexts, isn't needed there: a document's contexts are its own words, shifted by one, so the sum
of log(c(v) + mu) over its positions is the sum of log(c(w) + mu) over its words (the start counts as often as the end).

Jobs.
1. Words of training texts are counted: each block of texts sends one list of (word, count) to each shard of words.
   What comes to the driver is bounded: N, V, and the hot words (at most min(8 * shards, 1 / FREQUENT)).
2. Each block sends each shard its distinct bigrams: hashes and training counts. A shard adds up the counts, builds its
   trie in a memory map, looks every bigram up, and answers each block with a code for each bigram and a count for each
   word that it asked for. The block's own row, which says in which documents its bigrams occur, meets the answers and
   adds them up. A bigram occurs once for each block however frequent it is, and a hot word, whose count is known from
   job 1, is split over all shards by the word before. What travels is in proportion to the text at any number of shards.
So no task holds more than a block or a shard, whose size is fixed; their number grows with the corpus.

Words are 64-bit XXH64 hashes in job 2; N, V and the hot words are of exact strings.

Nulls: a null or empty text is its end token alone. Rows with the same doc_id are scored on their own. Without
training text every count is 0. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count as counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.llm.common import blocks, raw, written
from linework.llm.elias_fano import PROBABILITY, Trie

BLOCK_BYTES = 7 << 20
SHARD_TOKENS = 500_000
FREQUENT = 1e-5
MU = 300.0
END, START = b"", b" start"  # no word is empty or has a space
ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(w, 42) for w in words], np.uint64)


# ---- job 1: words


def _word_lists(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, words, counts) of each block's training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "text", BLOCK_BYTES):
            number: dict[bytes, int] = defaultdict(counter().__next__)
            parts = []
            for t in raw(table.column("text").filter(table.column("train"))):
                w = tokens(t)
                parts.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
            if not number:
                continue
            total = np.bincount(np.concatenate(parts), minlength=len(number)).astype(np.int64)
            words = list(number)
            shard = (hashes(words) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = [(s, order[a:b]) for s, a, b in zip(range(shards), cut[:-1], cut[1:], strict=True) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in rows], pa.int32()), pa.array([b"\n".join([words[i] for i in own.tolist()]) for _, own in rows], pa.binary()), pa.array([total[own].tobytes() for _, own in rows], pa.binary())],
                names=["shard", "words", "counts"],
            )

    return docs.mapInArrow(run, "shard int, words binary, counts binary")


def _word_shard(table: pa.Table) -> pa.Table:
    """A shard's tokens, vocabulary, and the words that may be hot."""
    count: dict[bytes, int] = {}
    for words, numbers in zip(table.column("words").to_pylist(), table.column("counts").to_pylist(), strict=True):
        for w, n in zip(words.split(b"\n"), np.frombuffer(numbers, np.int64).tolist(), strict=True):
            count[w] = count.get(w, 0) + n
    total = sum(count.values())
    hot = {w: n for w, n in count.items() if n >= FREQUENT * total}
    return pa.table({"kind": pa.array(["tokens", "words", *["hot"] * len(hot)], pa.string()), "key": pa.array([b"", b"", *hot], pa.binary()), "value": pa.array([total, len(count), *hot.values()], pa.int64())})


@dataclass
class Totals:
    """N, V, the number of shards, and the hot words' hashes (sorted) and counts."""

    tokens: int
    vocabulary: int
    shards: int
    hot: np.ndarray
    hot_count: np.ndarray

    @property
    def floor(self) -> float:
        return self.tokens + 0.1 * (self.vocabulary + 1)


def totals(docs: DataFrame, shards: int) -> Totals:
    parts = written(_word_lists(docs, shards).groupBy("shard").applyInArrow(_word_shard, "kind string, key binary, value long"), "word-totals")
    total = {r["kind"]: r["n"] for r in parts.where("kind <> 'hot'").groupBy("kind").agg(F.sum("value").alias("n")).collect()}
    n = total.get("tokens", 0)
    least = max(FREQUENT * n, n / (8 * shards), 1)
    hot = parts.where("kind = 'hot'").where(F.col("value") >= least).select("key", "value").collect()
    h = hashes([bytes(r["key"]) for r in hot])
    order = np.argsort(h)
    return Totals(n, total.get("words", 0), shards, h[order], np.array([r["value"] for r in hot], np.int64)[order])


# ---- job 2: bigrams


SENT = "shard int, block long, word binary, children binary, context binary, count binary, head binary"
SENT_NAMES = [x.split()[0] for x in SENT.split(", ")]


def _small(a: np.ndarray) -> bytes:
    """Unsigned numbers in the smallest of 1, 2, 4 and 8 bytes, which the first byte tells."""
    for size in (1, 2, 4, 8):
        if not len(a) or int(a.max()) < 1 << (8 * size):
            return bytes([size]) + a.astype(f"<u{size}").tobytes()
    raise OverflowError


def _large(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _grouped(key: np.ndarray, doc: np.ndarray, n_docs: int, train: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order: (keys, training count, documents that hold each, those documents, times there)."""
    both = key * n_docs + doc
    both.sort()
    head = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate((head, [len(both)])))
    k, d = np.divmod(both[head], n_docs)
    del both
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    holders = np.diff(np.concatenate((head, [len(k)])))
    return k[head], np.add.reduceat(times * train[d], head) if len(head) else head, holders, d, times


class Sender:
    """Cuts a block's texts into the rows that go to the shards."""

    def __init__(self, total: Totals):
        self.shards, self.hot = total.shards, total.hot

    def block(self, table: pa.Table, block: int) -> dict[str, list]:
        """The rows' columns: one row for each shard, and the block's own, with the place of each bigram in the order sent."""
        number: dict[bytes, int] = defaultdict(counter(2).__next__, {END: 0, START: 1})
        rows = []
        for t in raw(table.column("text")):
            w = t.lower().split()
            own = np.empty(len(w) + 2, np.int32)
            own[0], own[-1] = 1, 0
            own[1:-1] = np.fromiter(map(number.__getitem__, w), np.int32, len(w))
            rows.append(own)
        h = hashes(list(number))
        del number
        order = np.argsort(h)
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        h = h[order]
        size = np.array([len(r) - 1 for r in rows], np.int64)
        line = np.concatenate(rows)
        del rows
        first, last = np.zeros(len(line), bool), np.zeros(len(line), bool)
        last[np.cumsum(size + 1) - 1] = True
        first[np.cumsum(size + 1) - size - 1] = True
        key = rank[line[~first]] * len(h) + rank[line[~last]]
        del line, first, last
        key, count, holders, holder, times = _grouped(key, np.repeat(np.arange(len(size)), size), len(size), np.array(table.column("train").to_pylist(), np.int64))
        word, context = np.divmod(key, len(h))
        del key
        # by the word or, where it is hot, by both words
        mixed = np.where(np.isin(h[word], self.hot), h[word] ^ (h[context] * ODD), h[word])
        shard = ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(self.shards)).astype(np.int64)
        begin = np.cumsum(holders) - holders
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        out: dict[str, list] = {n: [] for n in SENT_NAMES}
        below = []
        for s in np.flatnonzero(np.diff(cut)).tolist():
            own = order[cut[s] : cut[s + 1]]
            words, children = np.unique(word[own], return_counts=True)
            below.append(children)
            row = (s, block, h[words].tobytes(), _small(children), h[context[own]].tobytes(), _small(count[own]), b"")
            for name, value in zip(SENT_NAMES, row, strict=True):
                out[name].append(value)
        n = holders[order]
        at = np.repeat(begin[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        parts = [_small(np.concatenate(below) if below else n), _small(n), _small(holder[at]), _small(times[at])]
        head = pa.table({"doc_id": table.column("doc_id"), "n_tokens": pa.array(size)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, head.schema) as w:
            w.write_table(head)
        parts.append(sink.getvalue().to_pybytes())
        row = {"shard": block % self.shards, "block": block, "head": b"".join(len(x).to_bytes(8, "little") + x for x in parts)}
        for name in SENT_NAMES:
            out[name].append(row.get(name, b""))
        return out


ANSWER = "block long, shard int, codes binary, counts binary, head binary"


class Shard:
    """Adds up a shard's counts, builds its trie, and answers each block."""

    def __init__(self, total: Totals, mu: float):
        self.total, self.mu = total, mu

    def levels(self, table: pa.Table) -> pa.Table:
        made = self.trie(*self.bigrams(table.to_pylist()))[0]
        return pa.table({"shard": table.column("shard")[:1], "levels": pa.array([made.to_bytes()], pa.binary())})

    @staticmethod
    def bigrams(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word = np.concatenate([np.repeat(np.frombuffer(r["word"], np.uint64), _large(r["children"])) for r in rows])
        return word, np.concatenate([np.frombuffer(r["context"], np.uint64) for r in rows]), np.concatenate([_large(r["count"]) for r in rows])

    def answers(self, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        heads = [r for r in rows if r["head"]]
        rows = [r for r in rows if not r["head"]]
        out = [(r["block"], -1, b"", b"", r["head"]) for r in heads]  # the block's own row passes on
        if rows:
            trie, (w, v), back, c, root = self.trie(*self.bigrams(rows))
            weight, alone = trie.look_up(w, v)  # numerators over N + mu; alone is 1 where the word has no entry
            outside = self.mu * (c + 0.1) / self.total.floor / (self.total.tokens + self.mu)  # also hot words all of whose bigrams here are new
            code = PROBABILITY.encode(np.log10(np.where(weight > 0, weight, np.where(alone < 1, alone, outside[root]))))
            at = 0
            for r in rows:
                children = _large(r["children"])
                own = back[at : at + children.sum()]
                at += len(own)
                first = np.cumsum(children) - children
                out.append((r["block"], r["shard"], code[own].tobytes(), _small(c[root[own[first]]].astype(np.int64)), b""))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({n.split()[0]: pa.array(x, k) for n, x, k in zip(ANSWER.split(", "), zip(*out, strict=True), kinds, strict=True)})

    def trie(self, word: np.ndarray, context: np.ndarray, count: np.ndarray) -> tuple:
        """The trie of the bigrams with a training count (the predicted word above, its contexts below it); the distinct
        bigrams, each row's number among them, the distinct words' counts, and each bigram's word among these."""
        words, w = np.unique(word, return_inverse=True)
        contexts, v = np.unique(context, return_inverse=True)
        key, back = np.unique(w * len(contexts) + v, return_inverse=True)
        times = np.bincount(back, count, len(key))
        root, kv = np.divmod(key, len(contexts))
        c = np.bincount(root, times, len(words))
        if len(self.total.hot):  # the other contexts of hot words lie in other shards
            place = np.minimum(np.searchsorted(self.total.hot, words), len(self.total.hot) - 1)
            c = np.where(self.total.hot[place] == words, self.total.hot_count[place], c)
        seen = times > 0
        low = self.mu * (c + 0.1) / self.total.floor
        all_ = self.total.tokens + self.mu
        own = np.unique(root[seen])
        made = Trie.build(words[root[seen]], contexts[kv[seen]], np.log10((times[seen] + low[root[seen]]) / all_), np.log10(low[own] / all_))
        return made, (words[root], contexts[kv]), back, c, root


def _sent(docs: DataFrame, total: Totals) -> DataFrame:
    """The shards' rows, and one row with a head for each block: its documents."""
    held = docs.sparkSession.sparkContext.broadcast(Sender(total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * (len(SENT_NAMES) - 2)]
        for k, table in enumerate(blocks(batches, "text", BLOCK_BYTES)):
            block = (TaskContext.get().partitionId() << 24) + k
            out = held.value.block(table, block)
            for at in range(0, len(out["shard"]), 16):  # small batches: a row can be a megabyte
                yield pa.RecordBatch.from_arrays([pa.array(out[n][at : at + 16], t) for n, t in zip(SENT_NAMES, kinds, strict=True)], names=SENT_NAMES)

    return docs.mapInArrow(run, SENT)


def _added(table: pa.Table, total: Totals, mu: float) -> pa.Table:
    """One block's documents with their sums: its own row and the shards' answers, in the order of shards."""
    rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
    data, parts = rows[0]["head"], []
    while data:
        n = int.from_bytes(data[:8], "little")
        parts.append(data[8 : 8 + n])
        data = data[8 + n :]
    children, holders, doc, times = map(_large, parts[:4])
    documents = pa.ipc.open_stream(parts[4]).read_all()
    n = documents.num_rows
    code = np.concatenate([np.frombuffer(r["codes"], np.uint16) for r in rows[1:]])
    c = np.repeat(np.concatenate([_large(r["counts"]) for r in rows[1:]]), children)
    pair = np.repeat(np.arange(len(holders)), holders)
    sums = lambda x: np.bincount(doc, x[pair] * times, n)
    value = PROBABILITY.decode(code) + np.log10((total.tokens + mu) / (c + mu))
    known = np.rint(sums((c > 0).astype(float))).astype(np.int64)
    return pa.table({"doc_id": documents.column("doc_id"), "n_tokens": documents.column("n_tokens"), "n_known": pa.array(known), "base_score": pa.array(sums(np.log10((c + 0.1) / total.floor))), "score": pa.array(sums(value))})


def _prepared(docs: DataFrame, train: Column) -> tuple[DataFrame, Totals]:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (6 * SHARD_TOKENS)))
    return slim, totals(slim, shards)


def score(docs: DataFrame, train: Column, mu: float = MU) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; train: condition for rows to learn from."""
    slim, total = _prepared(docs, train)
    shard = Shard(total, mu)

    def answers(table: pa.Table) -> pa.Table:
        return shard.answers(table)

    def added(table: pa.Table) -> pa.Table:
        return _added(table, total, mu)

    parts = _sent(slim, total).groupBy("shard").applyInArrow(answers, ANSWER)
    rows = parts.groupBy("block").applyInArrow(added, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return rows.select("doc_id", "n_tokens", "n_known", F.lit(total.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def tries(docs: DataFrame, train: Column, mu: float = MU) -> DataFrame:
    """(shard, levels): the model's shards, each as the bytes of a Trie, to be kept with any of Spark's writers."""
    slim, total = _prepared(docs, train)
    shard = Shard(total, mu)

    def levels(table: pa.Table) -> pa.Table:
        return shard.levels(table)

    return _sent(slim, total).where(F.octet_length("head") == 0).groupBy("shard").applyInArrow(levels, "shard int, levels binary")
