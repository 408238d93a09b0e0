import random
import re

import duckdb

from linework.llm import decontaminate, registry

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window=13):
    cut = lambda t: WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    out = {}
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for name, x in items:
            v = cut(x)
            k = min(window, len(v))
            for a in range(len(v) - k + 1 if v else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[a : a + k]:
                        hit |= set(range(p, p + k))
                        found.add(str(name))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def made(rng):
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "ß9"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 13, 14, 30, 60])))) for k in range(12)] + [(99, None), (98, "--")]
    items = [(k, t) for k, t in items if t is None or len(t.split()) > 2]
    docs = [(1, None), (2, ""), (3, "--- !"), (4, "w1")]
    for i in range(5, 40):
        w = rng.choices(vocabulary + ["other"] * 5, k=rng.randrange(1, 300))
        for _ in range(rng.randrange(3)):
            own = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(w))
            w[at:at] = own[rng.randrange(max(1, len(own))) :]
        docs.append((i, rng.choice([" ", "\n", "--"]).join(w).upper()))
    return docs, items


def test_against_brute_force(spark, docs, monkeypatch):
    rng = random.Random(2)
    rows, items = made(rng)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", decontaminate.F.lit(1))
    want = brute(rows, items)
    for size in (decontaminate.BLOCK_BYTES, 400):  # the second searches the benchmark in several blocks
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = decontaminate.hits(docs(rows), bench).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_words, r.n_hit, sorted(r["items"])) == want[r.doc_id]
            spans = [tuple(map(int, s.split(":"))) for s in r.hit_spans]
            assert sum(b - a for a, b in spans) == r.n_hit
            assert r.longest >= max([b - a for a, b in spans], default=0) or len(r["items"]) > 1
        stay = {r.doc_id for r in decontaminate.clean(docs(rows), bench).collect()}
        assert stay == {i for i, (n, h, _) in want.items() if not (h and 20 * h >= n)}


def test_longest_match_and_place(spark, docs):
    words = [f"q{i}" for i in range(40)]
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = decontaminate.hits(docs([(1, "a b " + " ".join(words[3:33]) + " c"), (2, " ".join(words[:12]))]), bench)
    by = {r.doc_id: r for r in got.collect()}
    assert (by[1].longest, by[1].longest_at, by[1].n_hit, by[1].hit_spans) == (30, 2, 30, ["2:32"])
    assert (by[2].longest, by[2].longest_at, by[2].n_hit) == (0, -1, 0)


def test_texts_of_one_item(spark, docs):
    a, b = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    bench = spark.createDataFrame([(5, a), (5, b), (5, a), (None, "x " * 20)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.hits(docs([(1, a), (2, b), (3, a + " " + b), (4, "x " * 20)]), bench).collect()}
    assert [got[i]["items"] for i in (1, 2, 3, 4)] == [["5"], ["5"], ["5"], []]
    assert [(got[i].n_hit, got[i].longest) for i in (1, 2, 3, 4)] == [(20, 20), (20, 20), (40, 20), (0, 0)]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.hits(docs([]), none).count() == 0
    assert decontaminate.hits(docs([(1, "a")]), none).first().n_hit == 0
    assert decontaminate.clean(docs([(1, "a")]), none).count() == 1


def test_clean_judges_each_row(spark, docs, monkeypatch):
    passage = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, passage), (2, "other " * 20), (3, "more " * 20)], "item_id long, text string")
    table = docs([(1, passage), (1, "clean one"), (None, passage), (None, "clean two"), (2, "clean three"), (2, "clean three")])
    for size in (decontaminate.BLOCK_BYTES, 100):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = decontaminate.clean(table, bench)
        assert got.columns == table.columns
        assert sorted(r.text for r in got.collect()) == ["clean one", "clean three", "clean three", "clean two"]


def test_items_without_id_against_sql(spark, docs, monkeypatch, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    spark.createDataFrame([(5, a), (None, b), (None, c), (None, b)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, a), (2, b), (3, a + " " + b + " " + c), (4, "clean"), (5, None)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    base = duckdb.connect()
    for t in ("documents", "benchmark"):
        base.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(base.execute(f"select {', '.join(cols)} from ({registry.SQL['op10_suffix_decontam']})").fetchall())
    assert [x[5] for x in want] == [True, True, True, False, False]
    for size in (decontaminate.BLOCK_BYTES, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert sorted(tuple(x) for x in registry.op10_suffix_decontam(spark, str(tmp_path)).select(cols).collect()) == want
        assert {x.doc_id for x in decontaminate.clean(docs(rows), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()} == {4, 5}


def longest(doc, items, window=13):
    cut = lambda t: WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    best, w = (0, -1), cut(doc)
    for v in {tuple(cut(x)) for _, x in items}:
        for p in range(len(w)):
            for a in range(len(v)):
                n = 0
                while p + n < len(w) and a + n < len(v) and w[p + n] == v[a + n]:
                    n += 1
                if n >= window or (n and n == len(v)):
                    best = max(best, (n, -p))
    return best[0], -best[1] if best[0] else -1


def test_longest_matches_against_brute_force(spark, docs, monkeypatch):
    rng = random.Random(11)
    rows, items = made(rng)
    rows = [*rows, *[(i + 100, (items[3][1] + " ") * 3) for i in range(3)], (200, " ".join(["w1"] * 70)), (201, (items[0][1] + " other ") + items[1][1] + " " + items[2][1])]
    items = [*items, (50, " ".join(["w1"] * 40)), (51, items[3][1]), (52, "w3 " + items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: longest(t, items) for i, t in rows}
    for size in (decontaminate.BLOCK_BYTES, 400):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert {r.doc_id: (r.longest, r.longest_at) for r in decontaminate.hits(docs(rows), bench).collect()} == want


def test_copies_of_items_and_of_passages_do_not_multiply():
    import pyarrow as pa

    passage = " ".join(f"q{i}" for i in range(13))
    asked = decontaminate.Queries([(str(k), passage.encode()) for k in range(1500)])
    assert len(asked.low) == 1 and len(asked.sets) == 1
    table = pa.table({"text": [passage] * 1500})
    text = decontaminate.np.array([asked.number[w.encode()] for w in passage.split()] * 1500)
    place, cover, best, at, owners = asked.search(text, decontaminate.np.repeat(decontaminate.np.arange(1500), 13))
    assert len(place) == len(owners) == 1500 and set(best.tolist()) == {13}
    got = decontaminate._block(table.slice(0, 2), asked)
    assert got["items"][1] == [str(k) for k in range(1500)] and got["n_hit"] == [13, 13]


def test_long_copies_stay_fast():
    import time

    import pyarrow as pa

    words = " ".join(["aa", "bb"] * 30_000)  # every place's suffix agrees with half of the others'
    began = time.perf_counter()
    got = decontaminate._block(pa.table({"text": [words, words + " cc"]}), decontaminate.Queries([("1", words.encode())]))
    assert got["longest"] == [60_000, 60_000] and got["n_hit"] == [60_000, 60_000]
    assert time.perf_counter() - began < 30
