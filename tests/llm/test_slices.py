"""Batches and groups of texts are worked on in bounded parts, without loss and with the same results."""

import numpy as np
import pyarrow as pa
import pytest

from countspark.llm import common, quality, templates


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_slices_hold_every_row(kind):
    sizes = [3, 0, None, 10, 1, 1, 25, 2, None, None, 4]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([None if n is None else "a" * n for n in sizes], kind)], ["id", "text"])
    parts = list(common.slices(iter([batch.slice(0, 0), batch, batch.slice(5)]), 1, 10))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() + batch.slice(5).to_pylist()
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 10 for p in parts)
    big = pa.RecordBatch.from_arrays([pa.array(["x" * 5000] * 5000)], ["text"])  # a batch as Spark sends it
    assert max(p.num_rows for p in common.slices([big], 0)) * 5000 <= common.SLICE_BYTES


def test_groups_are_small_and_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    words = np.array(["and", "went", "to", "see", "the", "river", "12", "km", "Maria", "Peter", "slowly"])
    texts = [" ".join(words[rng.integers(0, len(words), n)]).encode() for n in [300] * 600 + [60_000, 0, 400_000, 5]]
    grouped = list(common.groups(texts))
    assert sorted({i for at, _ in grouped for i in at}) == list(range(len(texts)))
    assert all(len(part) == 1 or sum(map(len, part)) <= 1 << 18 for _, part in grouped)
    weights = rng.normal(size=1 << quality.BITS)
    every = lambda: sorted((int(i), int(h), int(p), int(s)) for a, b, c, d, _ in templates.windows(texts) for i, h, p, s in zip(a, b, c, d))
    dots, found = quality.dot_products(texts, weights), every()
    monkeypatch.setattr(common, "GROUP_BYTES", common.PIECE_BYTES)
    assert (quality.dot_products(texts, weights) == dots).all() and every() == found
