import random

import numpy as np

from linework.llm import minmax


def plain_sets(text, width=5):
    w = (text or "").encode().lower().split()
    k = min(width, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, share=85):
    """(doc_id, size, component, kept) from all pairs of sets."""
    sets = [plain_sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= share * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return sorted(((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at] = f"e{rng.randrange(10**6)}"
    return out


def family(size, length, most_edits, rng):
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    return [" ".join(edited(base, rng.randrange(most_edits + 1), rng)) for _ in range(size)]


def corpus(rng):
    texts = [None, "", " \t\n", "One two", "one TWO", "one two three four five", "a a a a a a a a", "a a a a a a", "é É", "É É"]
    texts += family(60, 200, 6, rng) + family(30, 80, 3, rng) + family(5, 1000, 20, rng) + family(2, 12, 1, rng)
    passage = " ".join(f"p{k}" for k in range(150))
    texts += [f"{passage} {' '.join(f'q{rng.randrange(10**6)}' for _ in range(60))}" for _ in range(40)]
    texts += [" ".join(f"s{rng.randrange(10**6)}" for _ in range(30)) for _ in range(30)]
    texts += [texts[20]] * 9
    rng.shuffle(texts)
    rows = list(enumerate(texts, 100))
    return [*rows, rows[5], rows[5], (None, rows[8][1]), (None, None)]


def test_against_brute_force(spark, docs):
    rows = corpus(random.Random(11))
    want = brute(rows)
    for limits in ({}, {"most_nodes": 10}, {"most_shingles": 900}):  # whole families, then bands and chunks
        got = minmax.near_duplicates(docs(rows), **limits)
        assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want, limits


def test_empty_and_long(spark, docs):
    assert minmax.near_duplicates(docs([])).collect() == []
    assert minmax.near_duplicates(docs([(1, None), (2, "")])).where("kept").count() == 2
    long = " ".join(f"w{k % 70001}" for k in range(300_000))
    got = minmax.near_duplicates(docs([(3, long), (2, long + " end"), (1, "w1 w2 w3")]))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1, True), (2, 70002, 2, True), (3, 70001, 2, False)]


def test_signature():
    """Both ends of a permutation agree as often as the sets do, and the mean of both varies less than two minima would."""
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 2**63, 1500, dtype=np.uint64))
    a, b = h[:1000], h[150:1150]  # similarity 850 / 1150
    x, y = minmax.bands([a, b], 4000, 1)
    same = (x == y).reshape(-1, 2)
    j = 850 / 1150
    assert abs(same[:, 0].mean() - j) < 0.04 and abs(same[:, 1].mean() - j) < 0.04
    assert same.mean(1).var() < 1.1 * j * (1 - j) / 2
    again = minmax.bands([a, np.concatenate([h, h[:0]]), b], 4000, 1)
    assert (again[0] == x).all() and (again[2] == y).all()
    assert minmax.bands([h], 5, 3).shape == (1, 5)


def test_linked_joins_what_brute_force_joins():
    rng = random.Random(2)
    for _ in range(60):
        base = [[rng.randrange(3000) for _ in range(40)] for _ in range(3)]
        sets = [np.unique(np.array([x if rng.random() > 0.05 else rng.randrange(3000) for x in rng.choice(base)], np.uint64)) for _ in range(25)]
        known = [rng.choice([i, i, 99]) for i in range(25)]
        up = list(range(25))

        def find(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i in range(25):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if known[i] == known[j] or 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    up[find(i)] = find(j)
        want = [[find(i) == find(j) for j in range(25)] for i in range(25)]
        up[:] = range(25)
        for i, j in [*minmax.linked(sets, known), *((i, j) for i in range(25) for j in range(i) if known[i] == known[j])]:
            up[find(i)] = find(j)
        assert [[find(i) == find(j) for j in range(25)] for i in range(25)] == want
