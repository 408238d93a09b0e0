import random

import pyarrow as pa
import pytest

from linework.llm.common import ROW_BYTES, blocks


@pytest.mark.parametrize("most", [1, 10, 100, 10_000])
def test_blocks_cut_between_rows(most):
    rng = random.Random(most)
    rows = [None if rng.random() < 0.1 else "x" * rng.choice([0, 1, 7, 60, 300]) for _ in range(400)]
    batches = [pa.RecordBatch.from_pydict({"i": list(range(a, b)), "text": pa.array(rows[a:b], pa.string())}) for a, b in ((0, 150), (150, 150), (150, 151), (151, 400))]
    made = list(blocks(iter(batches), "text", most))
    assert [t for b in made for t in b.column("text").to_pylist()] == rows
    sizes = [[len(t or "") + ROW_BYTES for t in b.column("text").to_pylist()] for b in made]
    assert all(sum(s) >= most for s in sizes[:-1]) and all(sum(s[:-1]) < most for s in sizes)


def test_blocks_of_empty_texts_are_bounded():
    batch = pa.RecordBatch.from_pydict({"text": pa.nulls(10_000, pa.string())})
    sizes = [b.num_rows for b in blocks(iter([batch] * 300), "text", 24 << 20)]
    assert sum(sizes) == 3_000_000 and max(sizes) <= (24 << 20) // ROW_BYTES + 1
