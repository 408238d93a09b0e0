import hashlib
import math
import random

import numpy as np
import pytest

from linework.llm import product_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, n long, id long"


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """The contract with Python's integers, one part after the other."""
    kept = [(i, e, g) for i, e, g in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    whole = [([math.floor(scale * float(np.float32(x))) for x in e], i, g) for i, e, g in kept]
    width = len(whole[0][0]) // parts
    cut = [[q[p * width : (p + 1) * width] for p in range(parts)] for q, _, _ in whole]
    order = sorted(range(len(whole)), key=lambda k: (whole[k][1] is None, whole[k][1] or 0, whole[k][0]))[:entries]
    books = [[list(cut[k][p]) for k in order] for p in range(parts)]

    def away(x, c):
        return sum((u - v) ** 2 for u, v in zip(x, c, strict=True))

    def assign():
        return [[min(range(len(order)), key=lambda e: (away(x[p], books[p][e]), e)) for p in range(parts)] for x in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(order)):
                own = [cut[k][p] for k in range(len(cut)) if found[k][p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    errors = [sum(away(x[p], books[p][f[p]]) for p in range(parts)) for x, f in zip(cut, found, strict=True)]
    digest = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{e:02x}" for e in f), err, sum(x for x, (_, _, h) in zip(errors, whole, strict=True) if h == g), digest) for (_, i, g), f, err in zip(whole, found, errors, strict=True)),
        key=str,
    )


def compress(spark, rows, **more):
    df = spark.createDataFrame([(i, e, g, "x", 1, 2, 3) for i, e, g in rows], SCHEMA)
    return sorted((tuple(r) for r in product_codes.compress(df, **more).collect()), key=str)


def test_nearest_against_integers():
    rng = np.random.default_rng(3)
    for scale, width, entries in ((3, 4, 64), (200, 4, 64), (2**26, 4, 50), (2**26, 1, 7), (2**24 + 1, 16, 64), (5, 0, 3)):
        x, book = (rng.integers(-scale, scale + 1, (n, width)) for n in (500, entries))
        if scale > 2**20 and width:  # differences that float32 doesn't see
            book = book[:1] + rng.integers(-3, 4, (entries, width))
            x = book[:1] + rng.integers(-3, 4, (500, width))
        entry, distance, evaluated = product_codes.nearest(x, book)
        all_ = ((x[:, None, :].astype(object) - book[None, :, :].astype(object)) ** 2).sum(2) if width else np.zeros((500, entries), object)
        assert (entry == all_.argmin(1)).all() and (distance == all_.min(1)).all()
        assert evaluated >= 500 and (scale != 200 or evaluated < 1500)  # most entries are screened out


def test_against_plain_version(spark):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(32)], rng.choice([1, 2, None])) for k in range(150)]
    rows += [(7, rows[3][1], 1), (7, rows[3][1], 1), (None, rows[9][1], 2), (400, None, 1), (401, [None] * 32, 1), (402, [float("nan")] * 32, None), (403, [float("-inf")] + [0.0] * 31, 2), (-5, [0.0] * 32, None)]
    rows += [(500 + k, rows[0][1], 1) for k in range(40)]
    assert compress(spark, rows) == plain(rows)
    assert compress(spark, rows, parts=4, entries=9, rounds=3, scale=7) == plain(rows, 4, 9, 3, 7)


def test_few_and_no_vectors(spark):
    rows = [(2, [0.5, -0.001] * 16, None), (1, [0.25, -0.002] * 16, None)]
    assert compress(spark, rows) == plain(rows)
    assert compress(spark, []) == [] and compress(spark, [(1, None, 2)]) == []
    assert [r[:4] for r in compress(spark, [(1, [], 2), (2, [], None)])] == [(1, "00" * 16, 0, 0), (2, "00" * 16, 0, 0)]


def test_what_has_no_result(spark):
    for rows in ([(1, [1.0] * 32, 1), (2, [1.0] * 16, 1)], [(1, [1.0] * 17, 1)], [(1, [1e30] * 32, 1)]):
        with pytest.raises(Exception, match="components"):
            compress(spark, rows)
