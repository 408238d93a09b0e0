import random
import zlib

import numpy as np
import pytest

from linework.llm import packing

ROWS = [(1, None), (2, ""), (3, "one Two\tthree\n\nfour"), (None, "x"), (3, "one Two\tthree\n\nfour"), (5, "don't <|endoftext|> été   42!")]


def check(got, want):
    """want: ids of each document row, by doc_id."""
    from collections import Counter

    rows = Counter()
    for r in got:
        assert r.doc_tokens == len(want[r.doc_id])
        part = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32
        for k in range(r.start, r.start + r.length):
            rows[r.doc_id, k] += 1
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for own in sequences.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return rows, padding


def test_packs_every_id(docs):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    words = ["alpha", "Beta,", "gamma's", "délta", "x1y2", "It'S...", "wie?!", "a\u0301b\u00a0C,", "ΣΑΣ.", "»so«,", "1,5%", "İx;", "e-mail:x@y.z"]
    rows = ROWS + [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 40, 300, 900, 5000])))) for i in range(10, 120)]
    t = Tokenizer.from_file(packing.default_vocabulary())
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in rows}
    got = packing.pack(docs(rows).repartition(3)).collect()
    seen, padding = check(got, want)
    for i, _ in rows:
        n = sum(1 for j, _ in rows if j == i)
        assert all(seen[i, k] == n for k in range(len(want[i])))
    assert padding == 0


def test_ids_come_along(docs):
    got = packing.pack(docs(ROWS), with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)


def test_empty(docs):
    assert packing.pack(docs([])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_nnls(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.random((12, 20)), rng.random(12) * 5
    x = packing.nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope <= 1e-6).all() and np.abs(slope[x > 1e-9]).max(initial=0) < 1e-6


def test_combinations():
    every = packing.combinations(64)
    assert all(sum(c) == 64 and 2 <= len(c) <= 3 and list(c) == sorted(c) for c in every)
    assert len(every) == 32 + sum(1 for a in range(1, 22) for b in range(a, 64) if b <= 64 - a - b)


def test_plan_explains_the_histogram():
    h = np.zeros(64, np.int64)
    h[40], h[24], h[20] = 100, 60, 40
    h[12] = 20
    made = np.zeros(64, np.int64)
    for c, n in packing.plan(h):
        for k in c:
            made[k] += n
    assert (made <= h).all() and made.sum() > 0.5 * h.sum()


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    rng = random.Random(5)
    t = Tokenizer.from_file(packing.default_vocabulary())
    bits = [*"abIsSt.,!?'\"-<|>019 \n\t\x0b\x1c\x85", "\u0130", "\u0307", "\u0301", "\u212a", "\u03a3", "\u00df", "\ufb01", "\u00a0", "\u2028", "\u3000", "\u4e2d", "\u0e01\u0e34", "\u00b2", "\U0001f600", "\u200d",
            "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endof", "text|>"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(20_000)]
    words = packing.Words(packing.default_vocabulary())
    for at in range(0, len(texts), 2000):
        part = texts[at : at + 2000]
        ids, total = words.encode([x.encode() for x in part], 1)
        rows = np.split(ids, np.cumsum(total)[:-1])
        for x, row in zip(part, rows, strict=True):
            assert row.tolist() == [*t.encode(x, add_special_tokens=False).ids, 1], repr(x)


def test_parts_joined_or_alone_have_the_same_ids(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    parts = [x.encode() for x in ("alpha", "straße", "\u212aelvin", "ΣΑΣ", "日本語", "x1", "!!", "e\u0301t", "\ufb01n", "don't", "\u0130x", "a\U0001e5d0b", "ꟑ", "z" * 300)]
    want = [t.encode(p.decode(), add_special_tokens=False).ids for p in parts]
    for joined in (1, 2, 5, 200):
        monkeypatch.setattr(packing.Stems, "JOINED", joined)
        stems = packing.Stems(t)
        index = np.concatenate([stems.look_up(parts[:4]), stems.look_up(parts[2:])[2:]])
        assert [stems.flat[stems.first[i] : stems.first[i] + stems.size[i]].tolist() for i in index] == want
