import random

import numpy as np
import xxhash

from linework.llm import simhash


def plain(text, width=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(width, len(w))
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(codes, radius):
    up = list(range(len(codes)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def test_fingerprint():
    for t in ("", "One", "a b c", "A b\tc\nd e é", "x " * 3000, "a b c d " * 40):
        assert simhash.fingerprint(t.encode()) == plain(t)


def planted(n, rng):
    codes = set()
    while len(codes) < n:
        c = rng.getrandbits(64)
        codes.add(c)
        for _ in range(rng.randrange(4)):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                c ^= 1 << b
            codes.add(c)
    return sorted(codes)


def test_tree_against_brute_force():
    rng = random.Random(3)
    dense = {sum(1 << b for b in rng.sample(range(12), 3)) for _ in range(300)}
    for codes in (planted(700, rng), sorted(dense), [0], [5, 7]):
        got = simhash.VantageTree(np.array(codes, np.uint64), leaf=8).components(4)
        assert got.tolist() == brute(codes, 4)


def test_components_on_spark(spark, docs):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randrange(30, 200))) for _ in range(30)]
    texts = [None, "", "one", "one"]
    for b in base:
        texts += [b, b.upper()]
        w = b.split()
        for _ in range(4):
            w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    rows = list(enumerate(texts, 10))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(rows)).collect()}
    fps = [plain(t) for _, t in rows]
    want = brute(fps, 4)
    for k, (i, _) in enumerate(rows):
        assert got[i].fp % 2**64 == fps[k]
        assert got[i].component_id == rows[want[k]][0]
    assert {r.doc_id for r in simhash.one_of_each(docs(rows)).collect()} == {rows[w][0] for w in want}


def test_more_bands_same_links(spark):
    codes = planted(400, random.Random(8))
    fps = spark.createDataFrame([(c - 2**64 if c >> 63 else c,) for c in codes], "fp long")
    want = brute(codes, 4)
    for shard_size in (1, 0.01):
        found = {r.node % 2**64: r.label for r in simhash.components(simhash.links(fps, len(codes), 4, shard_size)).collect()}
        groups = {}
        for c, w in zip(codes, want, strict=True):
            groups.setdefault(w, set()).add(found.get(c, c - 2**64 if c >> 63 else c))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_empty(docs):
    assert simhash.near_duplicates(docs([])).count() == 0


def test_one_row_of_each_component(docs):
    rng = random.Random(7)
    near = [[" ".join(w), " ".join(w).upper(), " ".join(w).title()] for w in ([f"{c}{rng.randrange(500)}" for _ in range(60)] for c in "abcd")]
    rows = [(None, t) for t in near[0]] + [(4, t) for t in near[1]] + [(3, near[2][0]), (5, near[2][1]), (5, near[3][0]), (None, near[3][1])]
    table = docs(rows)
    got = simhash.one_of_each(table)
    assert got.columns == table.columns
    got = sorted(((r.doc_id or 0), r.text.lower()) for r in got.collect())
    assert got == sorted([(0, near[0][0]), (4, near[1][0]), (3, near[2][0]), (5, near[3][0])])
