import random

import numpy as np
from pyspark.sql import functions as F

from linework.llm import language

WORDS = {
    "en": "the of and house water running quickly through with their which would".split(),
    "de": "der die und straße wasser schnell durch mit ihrer welche würde ein".split(),
    "fr": "le la et maison eau rapidement à travers avec leur laquelle été".split(),
}


def corpus(n=240):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randrange(8, 60))), lang))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double")


def test_held_out_accuracy(spark):
    rows = corpus()
    got = {r.doc_id: r for r in language.identify(table(spark, rows), F.pmod("doc_id", F.lit(4)) != 2).collect()}
    held = [(i, lang) for i, _, lang in rows if i % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_partitions_do_not_matter(spark):
    rows = corpus(120)
    a = {r.doc_id: (r.lang_pred, round(r.score, 4)) for r in language.identify(table(spark, rows)).collect()}
    b = {r.doc_id: (r.lang_pred, round(r.score, 4)) for r in language.identify(table(spark, rows[::-1]).repartition(5)).collect()}
    assert a == b


def test_odd_texts(spark):
    rows = [*corpus(60), (900, None, "en"), (901, "", "en"), (902, "123 !?", "de"), (903, "der " * 50_000, None), (None, "the water", None), (903, "the of and", None)]
    got = [r for r in language.identify(table(spark, rows)).collect() if r.doc_id is None or r.doc_id >= 900]
    assert len(got) == 6
    assert {(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id in (900, 901, 902)} == {(i, "und", 0.0) for i in (900, 901, 902)}


def test_nothing_to_learn_from(spark):
    got = language.identify(table(spark, [(1, "abc", None)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert language.identify(table(spark, [])).count() == 0


def test_kernel_is_shared_grams():
    x = language.presence([b"abc", b"abd", b"xyz"])
    k = language.kernel(x, x)
    assert np.allclose(np.diag(k), 1) and k[0, 1] > k[0, 2] > 0


def test_kernel_against_sets():
    rng = random.Random(3)
    texts = [" ".join(rng.choices([w for k in WORDS for w in WORDS[k]] + ["Ünd", "x1", "日本"], k=rng.randrange(1, 40))).encode() for _ in range(40)]

    def plain(t):
        b = b" " + t.decode().lower().encode().translate(language.SPACES) + b" "
        return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    sets = [plain(t) for t in texts]
    want = [[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    assert np.allclose(language.kernel(language.presence(texts), language.presence(texts)), want, atol=1e-5)
    # rows over the landmarks' n-grams alone give the same numbers
    known = np.unique(np.concatenate([language.grams(t) for t in texts[:5]]))
    some = language.presence(texts, known)
    assert np.allclose(language.kernel(some, some[:5], np.array([len(s) for s in sets])), np.array(want)[:, :5], atol=1e-5)


def test_repeated_and_null_ids_train(spark):
    rows = corpus()
    for ids in ([7] * len(rows), [None] * len(rows)):
        known = [(i, t, lang) for i, (_, t, lang) in zip(ids, rows, strict=True)]
        copies = [(3, "der die das " * 4, "de")] * 2000  # one text is a hot group; it counts once
        asked = [(1000 + k, t, None) for k, (_, t, _) in enumerate(rows)]
        got = {r.doc_id: r.lang_pred for r in language.identify(table(spark, known + copies + asked)).where("doc_id >= 1000").collect()}
        assert sum(got[1000 + k] == lang for k, (_, _, lang) in enumerate(rows)) >= 0.95 * len(rows)


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_TRAIN", 40)
    seen = []
    plain = language.fit
    monkeypatch.setattr(language, "fit", lambda x, y: seen.append(y) or plain(x, y))
    language.train(table(spark, corpus()), F.lit(True))
    assert {k: seen[0].count(k) for k in WORDS} == {"en": 13, "de": 13, "fr": 13}
