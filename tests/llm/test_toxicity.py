import random
import re

import numpy as np
from pyspark.sql import functions as F

from linework.llm import toxicity


def corpus():
    rng = random.Random(6)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        s = [" ".join(rng.choices(plain, k=8)) for _ in range(rng.randrange(1, 9))]
        if bad:
            s.insert(rng.randrange(len(s) + 1), f"you é {rng.choice(['zorg', 'blargs', 'Blargen'])} {rng.choice(plain)}")
        rows.append((i, ". ".join(s) + "."))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_finds_sentences_and_keeps_clean_documents(spark, docs):
    rows, labels = corpus()
    table, marks = docs(rows), spark.createDataFrame([*labels, (9999, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(table, marks, F.pmod("_id", F.lit(4)) != 0).collect()}
    for i, text in rows:
        assert (got[i].score >= 0.5) == (i % 5 == 0), (i, got[i].score)
        for s in got[i].sentences:
            part = text[s.start : s.end].lower()
            assert "zorg" in part or "blarg" in part
        assert bool(got[i].sentences) == (i % 5 == 0)
    kept = toxicity.accepted(table, marks)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if i % 5}


def test_nulls_and_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.scores(docs([(1, None), (2, ""), (None, "a. b"), (2, "a b " * 50_000)]), none).collect()
    assert len(got) == 4 and all(0 <= r.score < 0.5 and not r.sentences for r in got)
    assert toxicity.scores(docs([]), none).count() == 0
    assert toxicity.accepted(docs([]), none).count() == 0


def test_same_model_whatever_the_partitions(spark, docs):
    rows, labels = corpus()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a = {r.doc_id: r.score for r in toxicity.scores(docs(rows), marks).collect()}
    b = {r.doc_id: r.score for r in toxicity.scores(docs(rows[::-1]).repartition(7), marks).collect()}
    assert a == b


def test_length_alone_is_not_toxic(spark, docs):
    rows, labels = corpus()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    clean = "new words here. so it goes\n" * 25_000  # 50,000 sentences without a learned feature
    table = docs([*rows, (5000, clean), (5001, clean + "you zorg")])
    got = {r.doc_id: r for r in toxicity.scores(table, marks).where("doc_id >= 5000").collect()}
    assert got[5000].score == 0 and not got[5000].sentences
    assert got[5001].score >= 0.5 and len(got[5001].sentences) == 1
    assert {r.doc_id for r in toxicity.accepted(table, marks).where("doc_id >= 5000").collect()} == {5000}


def test_scores_are_the_fitted_probabilities():
    toxic = np.arange(200) % 10 < 7  # seven of ten documents with the word are toxic
    bias, w = toxicity.fit_bags(toxic, [[1]] * 200, [[0]] * 200, 1)
    score, spans = toxicity.Model(bias, {b"zorg": float(w[0])}).score(b"Zorg. Other words.")
    assert abs(score - 0.7) < 0.02 and [s[:2] for s in spans] == [(0, 4)]


def test_score_is_the_noisy_or_of_sentences():
    rng = random.Random(8)
    weights = {b"zorg": 6.0, b"^zor": 1.5, b"fine": -3.0}
    model = toxicity.Model(-7.0, weights)
    for _ in range(300):
        text = "".join(rng.choice(["Zorg", "zorgs", "fine", "other", " ", " ", ". ", "! ", "\n", "é"]) for _ in range(rng.randrange(40)))
        clean = 1.0
        for sentence in re.split(r"[.!?\n]+", text):
            words = {w for w in re.split(r"[^a-zé]+", sentence.lower()) if w}
            own = [weights[f] for w in words for f in toxicity.features(w.encode()) if f in weights]
            clean *= 1 - (1 / (1 + np.exp(7.0 - sum(own))) if own else 0)
        assert abs(model.score(text.encode())[0] - (1 - clean)) < 1e-9


def test_repeated_ids_train_on_one_text(spark, docs):
    rows, labels = corpus()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = [*rows, *((i, t + " zzz zorg") for i, t in rows if i % 5), *rows[:50]]  # greater texts of the same ids
    a = {(r.doc_id, r.score) for r in toxicity.scores(docs(more), marks).collect()}
    b = {(r.doc_id, r.score) for r in toxicity.scores(docs(more[::-1]).repartition(5), marks).collect()}
    c = {(r.doc_id, r.score) for r in toxicity.scores(docs(rows), marks).collect()}
    assert a == b and c <= a


def test_places_of_many_sentences():
    """Places are counted once over the text: a text of 10 MB with half a million toxic sentences takes seconds."""
    import time

    own = toxicity.Model(0.0, {b"bad": 5.0})
    text = "é bad ü. fine. ".encode() * 600_000
    began = time.perf_counter()
    total, found = own.score(text)
    spans = toxicity._in_code_points(text, found)
    assert time.perf_counter() - began < 60 and total == 1.0 and len(spans) == 600_000
    whole = text.decode()
    assert all(whole[x["start"] : x["end"]].strip() == "é bad ü" for x in spans[::10_000])
