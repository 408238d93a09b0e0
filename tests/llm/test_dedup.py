import hashlib
import random

from linework.llm import exact_dedup

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (None, "a"), (2, "a"), (6, "B"), (7, "x" * 200_000)]


def test_groups(docs):
    got = exact_dedup.groups(docs(ROWS)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = next((t or "" for i, t in ROWS if i == r.doc_id), None)
        same = [i for i, t in ROWS if (t or "") == text]
        assert r.group_size == len(same)
        assert r.keep_id == max(i for i in same if i is not None)
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sum(r.kept for r in got) == len({t or "" for _, t in ROWS})


def test_hot_group_and_rounds(docs):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 == 0 else f"t{rng.randrange(400)}") for i in range(4000)]
    table = docs(rows).repartition(13)
    got = {r.doc_id: r for r in exact_dedup.groups(table).collect()}
    best = {}
    for i, t in rows:
        best[t] = max(best.get(t, -1), i)
    assert all(got[i].keep_id == best[t] and got[i].kept == (best[t] == i) for i, t in rows)


def test_deduplicated_keeps_columns(docs):
    table = docs(ROWS)
    out = exact_dedup.deduplicated(table)
    assert out.columns == table.columns
    assert sorted(t or "" for t in (r.text for r in out.collect())) == sorted({t or "" for _, t in ROWS})


def test_empty(docs):
    assert exact_dedup.groups(docs([])).count() == 0
    assert exact_dedup.deduplicated(docs([])).count() == 0


def test_deduplicated_with_repeated_and_null_ids(docs):
    rows = [(1, "a"), (1, "b"), (1, "a"), (None, "c"), (None, "d"), (None, "c"), (2, "a"), (5, None), (None, "")]
    out = [(r.doc_id, r.text) for r in exact_dedup.deduplicated(docs(rows).repartition(3)).collect()]
    assert sorted(out, key=str) == sorted([(2, "a"), (1, "b"), (None, "c"), (None, "d"), (5, None)], key=str)


def test_rounds_merge_sorted_runs_where_they_lie(docs, capsys):
    rows = exact_dedup.digests(docs([(i, f"t{i % 50}") for i in range(300)]).repartition(70))
    merged = exact_dedup.merged_runs(rows, 70)
    merged.explain()
    plan = capsys.readouterr().out
    assert {r.n for r in merged.collect()} == {6} and merged.count() == 50
    rounds = plan.split("Exchange")[:-1]  # from the last round down to the runs
    assert len(rounds) == 4  # the runs, and three rounds of eight
    for part in rounds[:-1]:
        assert part.count("Sort [") == 1 and part.count("SortAggregate") == 2
    assert plan.count("hashpartitioning(span") == 3 and plan.count("hashpartitioning(") == 4
