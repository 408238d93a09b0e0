import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linework.llm import ngram_model
from linework.llm.elias_fano import PROBABILITY, EliasFano, Trie


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1), (5, 100), (1000, 1 << 64), (1000, 1003), (4000, 50), (50_000, 1 << 44)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
    e = EliasFano.of(v, universe)
    assert (e.access(np.arange(n)) == v).all()
    q = np.concatenate((v, rng.integers(0, universe, 300, dtype=np.uint64)))
    at, same = e.successor(q)
    assert (same == np.isin(q, v)).all()
    if n:
        assert (at == np.searchsorted(v, q)).all()


def test_trie_keeps_ranges_apart():
    rng = np.random.default_rng(2)
    pairs = np.unique(np.stack([rng.integers(0, 200, 4000), rng.integers(0, 900, 4000)]).astype(np.uint64) << np.uint64(50), axis=1)
    top = np.unique(pairs[0])
    p, b = -rng.random(pairs.shape[1]) * 9, -rng.random(len(top)) - 0.1
    t = Trie.from_bytes(Trie.build(*pairs, p, b).to_bytes())
    got, back = t.look_up(*pairs)
    assert np.allclose(np.log10(got), p, atol=PROBABILITY.step) and np.allclose(np.log10(back), b[np.searchsorted(top, pairs[0])], atol=PROBABILITY.step)
    ask = np.stack(np.meshgrid(top, np.arange(950, dtype=np.uint64) << np.uint64(50))).reshape(2, -1)
    there = set(map(tuple, pairs.T.tolist()))
    assert ((t.look_up(*ask)[0] > 0) == [tuple(x) in there for x in ask.T.tolist()]).all()
    got, back = t.look_up(pairs[0] + np.uint64(1), pairs[1])
    assert (got == 0).all() and (back == 1).all()


def brute(rows, train, mu):
    cut = lambda t: (t or "").encode().lower().split()
    c, pair, seqs = Counter(), Counter(), {}
    for k, (i, t) in enumerate(rows):
        seqs[k] = [" start", *cut(t), ""]
        if train(i):
            c.update(seqs[k])
            pair.update(zip(seqs[k], seqs[k][1:], strict=False))
    n, v = sum(c.values()) - c[" start"], len(c) - (" start" in c)
    low = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    out = []
    for k, (i, _) in enumerate(rows):
        w = seqs[k]
        base = sum(math.log10(low(x)) for x in w[1:])
        full = sum(math.log10((pair[a, b] + mu * low(b)) / (c[a] + mu)) for a, b in zip(w, w[1:], strict=False))
        out.append((i, len(w) - 1, sum(c[x] > 0 for x in w[1:]), n, base, full))
    return out


def corpus():
    rng = random.Random(5)
    words = [f"W{i}" for i in range(300)] + ["é", "the"] * 30
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(60)) + ["the"] * (i % 40))) for i in range(200)]
    return [*rows, (500, None), (501, ""), (7, "dup doc"), (None, "the the"), (502, "the\tW1\n" * 9000)]


@pytest.mark.parametrize("parts", [1, 6])
def test_scores_against_brute_force(docs, parts):
    rows = corpus()
    got = ngram_model.score(docs(rows).repartition(parts), F.pmod("doc_id", F.lit(10)) != 0, 20.0).collect()
    key = lambda r: tuple(-1 if x is None else round(x, 3) for x in r[:5])
    want = sorted(brute(rows, lambda i: i is not None and i % 10 != 0, 20.0), key=key)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9)
        assert a[5] == pytest.approx(b[5], abs=a[1] * PROBABILITY.step)  # the codes' rounding


def test_probabilities_add_up_to_one(docs):
    """Over the vocabulary and the class of other words, after any context."""
    rows = [(i, t) for i, t in [(1, "a b a c"), (2, "b a"), (3, "c c b")]]
    asked = [(100 + k, f"{v} {w}".strip()) for k, (v, w) in enumerate((v, w) for v in ("a", "zz") for w in ("a", "b", "c", "other", ""))]
    got = {r.doc_id: r.score for r in ngram_model.score(docs(rows + asked), F.col("doc_id") < 100, 3.0).collect()}
    want = {i: s for i, *_, s in brute(rows + asked, lambda i: i < 100, 3.0)}
    assert all(got[i] == pytest.approx(want[i], abs=1e-3) for i in got)


def test_no_training_rows_and_empty(docs):
    got = ngram_model.score(docs([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(1, 3, 0, 0), (2, 1, 0, 0)}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert ngram_model.score(docs([]), F.lit(True)).count() == 0


def test_tries_are_kept_as_rows(docs):
    rows = ngram_model.tries(docs(corpus()), F.lit(True)).collect()
    h = ngram_model.hashes([b"w1", b"the"])
    found = [Trie.from_bytes(r.levels).look_up(h[:1], h[1:])[0][0] for r in rows]
    assert sum(p > 0 for p in found) == 1
