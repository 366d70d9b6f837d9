"""Texts of a bucket arrive in many small blocks: they are read together, and what is wanted of them is looked up once."""

import numpy as np
import pytest

from abacist.llm import recur, substrings


def blocks(texts, monkeypatch, each):
    import pyarrow as pa

    monkeypatch.setattr(recur, "FLUSH_BYTES", each)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    return [r for b in recur._blocks(1)([batch]) for r in b.to_pylist()]


def test_small_blocks_are_read_together(monkeypatch):
    texts = [f"text {k} " * (k % 7) for k in range(200)] + ["x" * 5000, "", "end"]
    rows = blocks(texts, monkeypatch, 100)
    assert len(rows) > 50
    monkeypatch.setattr(recur, "BLOCK_BYTES", 3000)
    read = list(recur.texts_of(rows))
    assert len(read) <= 2 + 2 * sum(map(len, texts)) // 3000
    assert all(len(data) <= 3000 or len(ids) == 1 for ids, data, _ in read)
    found = {int(i): bytes(data[a:b]).decode() for ids, data, at in read for i, a, b in zip(ids, at[:-1], at[1:])}
    assert found == dict(enumerate(texts))


def test_what_is_wanted_is_sorted_once_for_a_bucket(monkeypatch):
    shared = "this line of more than fifty bytes stands in each of the texts below"
    texts = [f"{k * 7919} {shared} {k * 104729}" for k in range(300)]
    rows = blocks(texts, monkeypatch, 200)
    monkeypatch.setattr(recur, "BLOCK_BYTES", 2000)
    unit = recur.Unit(substrings._bytes, 50, 20, own=False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    seen = [b for b in recur._triggers(unit, 1)([batch])]
    pairs = [b for b in recur._recurring(1, 1 << 20)(seen)]
    batches = [*pairs, *[recur.packed(*[r[f] for f in recur.FIELDS]) for r in rows]]
    calls = []
    # Sorting what is wanted again for each block of a bucket costs the square of the input.
    for name in ("isin", "unique"):
        monkeypatch.setattr(np, name, lambda *a, f=getattr(np, name), **b: calls.append(len(a[-1])) or f(*a, **b))
    found = list(recur._candidates(unit, 1, np.zeros(0, np.uint64))(batches))
    assert sum(1 for n in calls if n) == 1
    assert sum(r["n"] for b in found for r in b.to_pylist() if r["kind"] == 2)


@pytest.mark.parametrize("many", [0, 1, 3000])
def test_among(many):
    rng = np.random.default_rng(4)
    wanted = rng.integers(0, 5000, many).astype(np.uint64) << np.uint64(20) | rng.integers(0, 3, many).astype(np.uint64)
    values = rng.integers(0, 5000, 9000).astype(np.uint64) << np.uint64(20) | rng.integers(0, 3, 9000).astype(np.uint64)
    values = np.concatenate([values, wanted])
    assert (recur.among(wanted)(values) == np.isin(values, wanted)).all()
