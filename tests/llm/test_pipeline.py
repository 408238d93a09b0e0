import random
import zlib

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from linework.llm import packing, toxicity
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_simhash import brute as linked
from tests.llm.test_simhash import plain


@pytest.fixture
def sf_dir(spark, tmp_path):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("ban", "dor", "fel", "gin", "hus", "jak")]
    items = [(k, " ".join(f"q{k}x{j}" for j in range(30))) for k in range(3)]
    rows, labels = [], []
    for i in range(160):
        s = [" ".join(rng.choices(words, k=9)) for _ in range(rng.randrange(2, 9))]
        if i % 8 == 0:
            s.append(f"you {rng.choice(['zorg', 'blarg'])} {rng.choice(words)}")
        labels.append((i, 1, int(i % 8 == 0)))
        rows.append((i, ". ".join(s)))
    for i in range(160, 200):
        t = rows[rng.randrange(160)][1]
        rows.append((i, t if i % 2 else t.upper()))
    rows += [(200, "some words " + items[1][1][:150] + " more"), (201, None), (202, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, items


def test_run_against_a_plain_version(spark, sf_dir):
    path, rows, items = sf_dir
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    bad = {r.doc_id for r in toxicity.scores(docs, labels, corpus_pipeline.id_bucket("_id", 5) != 0).collect() if r.score >= 0.5}
    assert bad >= {i for i in range(160) if i % 8 == 0}
    kept = [(i, t) for i, t in rows if i not in bad]
    best = {}
    for i, t in kept:
        best[t or ""] = max(i, best.get(t or "", -1))
    kept = [(i, t) for i, t in kept if best[t or ""] == i]
    heads = linked([plain(t) for _, t in sorted(kept)], 4)
    kept = [x for k, x in enumerate(sorted(kept)) if heads[k] == k]
    hit = contaminated(kept, items)
    kept = [(i, t) for i, t in kept if not (hit[i][1] and 20 * hit[i][1] >= hit[i][0])]
    assert 200 not in dict(kept)
    got = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in got} == {i for i, _ in kept}
    t = Tokenizer.from_file(packing.default_vocabulary())
    for i, x in kept:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in own] == [0, *(r.start + r.length for r in own)][:-1] and own[-1].start + own[-1].length == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids[r.start : r.start + r.length])) for r in own)


def test_stages_keep_the_columns(spark, sf_dir):
    path, *_ = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0
