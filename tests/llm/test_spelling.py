import random
import re
import zlib
from collections import Counter

from linework.llm import spelling


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if u == v or len(v) - len(u) > 1:
        return False
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v, strict=True)) == 1
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    close = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(c, key=lambda v: (-n[v], v)) for w, c in close.items() if c}
    form = {w: v for w, v in form.items() if n[v] >= 10 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n[w], len(close[w]), n.get(form.get(w))) for w in n), key=str)


def variants(df, **more):
    got = spelling.variants(df, **more)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(rng):
    letters = "abcdeéßÀ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 13))) for _ in range(25)]
    words = []
    for w in base:
        words += [w.upper() if rng.random() < 0.1 else w] * rng.choice([1, 3, 40, 400])
        for _ in range(12):
            at, c = rng.randrange(len(w)), rng.choice(letters)
            words += [rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])] * rng.choice([1, 2, 2, 30])
    words += ["chainab"] * 3 + ["chainac"] * 40 + ["chainacd"] * 600
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"] * 3 + ["prefixed" + a + b for a in "abcdefgh" for b in "abcdefgh"] * 2 + [a + b + "suffixed" for a in "abcd" for b in "abcd"] * 2
    rng.shuffle(words)
    rows = [(k, " 1".join(words[k::97])) for k in range(97)]
    return [*rows, rows[4], rows[4], (None, rows[5][1]), (200, None), (201, ""), (202, "123 中文 short"), (203, "x" * 3000 + " " + "x" * 2999), (204, "x" * 3000 + "-" + "x" * 2999)]


def test_against_brute_force(spark, docs):
    rows = corpus(random.Random(4))
    want = brute(rows)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)
    for more in ({}, {"most": 20}, {"most": 2}):  # one level of blocks, then several
        assert variants(docs(rows), **more) == want


def test_pairs_are_met_once():
    rng = random.Random(6)
    for a in (1, 2, 3, 6, 7):
        words = list({"".join(rng.choice("abc") for _ in range(a + rng.randrange(2))) for _ in range(150)})
        met = Counter(frozenset(p) for p in spelling.pairs(words, a, 0, a + 1, small=3))
        want = {frozenset((u, v)) for u in words for v in words if one_edit(u, v) and min(len(u), len(v)) == a}
        assert set(met) == want and set(met.values()) <= {1}


def test_chain_and_ties(spark, docs):
    text = " ".join(["lettera"] * 2 + ["letterb"] * 20 + ["letterbb"] * 20 + ["letterbbb"] * 300)
    got = {r[0]: r for r in variants(docs([(7, text)]), slip=None)}
    assert got["lettera"] == ("lettera", "letterb", "letterb", 2, 1, 20)
    assert got["letterb"][1] is None and got["letterbb"][1:3] == ("letterbbb", "letterbbb")
    text = " ".join(["wordsab"] * 2 + ["wordsac"] * 20 + ["wordsaa"] * 20)
    assert {r[0]: r for r in variants(docs([(7, text)]), slip=None)}["wordsab"] == ("wordsab", "wordsaa", "wordsaa", 2, 2, 20)


def test_empty(spark, docs):
    assert variants(docs([])) == [] and variants(docs([(1, None), (2, "word word")])) == []
