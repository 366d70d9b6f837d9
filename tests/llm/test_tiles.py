"""Tiles of the Jaccard join: linked sets share one, unrelated sets do not."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from abacist.llm import jaccard
from abacist.llm.jaccard import Rule, _packing, jaccard_components, tokens


def named(rule, sets):
    found = np.concatenate([np.sort(s) for s in sets])
    name, count = tokens(rule, found, np.array([len(s) for s in sets]))
    return np.split(name, np.cumsum(count)[:-1])


@pytest.mark.parametrize("rule", [Rule(5, 80), Rule(3, 90), Rule(5, 60)])
def test_linked_sets_share_a_tile(rule):
    rng = np.random.default_rng(rule.percent)
    for n in [*range(1, 60), 90, 150, 333, 800]:
        for _ in range(12):
            a = rng.integers(1, 1 << 62, n, dtype=np.uint64)
            most = int(n * (100 - rule.percent) / rule.percent)  # elements they may differ in, near the limit
            gone = int(rng.integers(0, most + 1))
            b = np.concatenate([a[gone // 2 :], rng.integers(1, 1 << 62, gone - gone // 2, dtype=np.uint64)])
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= rule.percent * (len(a) + len(b) - shared):
                x, y = named(rule, [a, b])
                assert len(np.intersect1d(x, y)), (n, gone)


def test_unrelated_sets_share_no_tile():
    rng = np.random.default_rng(2)
    sets = [rng.integers(1, 1 << 62, int(n), dtype=np.uint64) for n in rng.integers(4, 500, 4000)]
    name = np.concatenate([np.unique(x) for x in named(Rule(5, 80), sets)])
    assert len(np.unique(name)) == len(name)


def test_five_words_eighty_percent_against_brute_force(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(400)]
    docs = []
    for k in range(150):
        words = list(rng.choice(vocabulary, int(rng.integers(1, 90))))
        docs.append(words)
        for _ in range(int(rng.integers(0, 3))):
            copy = list(words)
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(0, len(copy)))] = str(rng.choice(vocabulary))
            docs.append(copy)
    texts = [(i, " ".join(w)) for i, w in enumerate(docs)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    found = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), Rule(5, 80)).collect()}
    assert found == {i: find(i) for i in range(len(sets))}


def test_packing_holds_few_tokens():
    def batches():
        rng = np.random.default_rng(3)
        for k in range(12):
            names = pa.ListArray.from_arrays(pa.array(np.arange(0, 200_001, 50), pa.int32()), pa.array(rng.integers(0, 1 << 62, 200_000)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4000) + 4000 * k), names], names=["id", "tokens"])

    tracemalloc.start()
    rows = sum(sum(b.column(2).to_pylist()) for b in _packing(64)(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2_400_000 and peak < 64 << 20


def near_misses(copies):
    """Texts of one group: any two differ in 240 shingles of 996 each, too many for 80 percent, but too few for 1024 bits to tell."""
    for i in range(copies):
        yield " ".join([f"w{k}" for k in range(880)] + [f"x{i}_{k}" for k in range(120)])


def test_rows_made_grow_with_the_group_not_with_its_pairs(spark, monkeypatch):
    made, kept = {}, jaccard.written

    def counted(df):
        out = kept(df)
        if out.columns in (["a", "b"], ["a", "b", "same"]):
            made[copies] = made.get(copies, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 100_000, raising=False)
    for copies in (30, 120):
        texts = [*near_misses(copies)]
        texts += [texts[-1] + f" end{k}" for k in range(3)]
        rows = [(i, t) for i, t in enumerate(texts)]
        found = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), Rule(5, 80)).collect()}
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
        linked = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        assert min(min(p) for p in linked) == copies - 1
        assert found == {i: min(i, copies - 1) for i in range(len(texts))}
    assert made[120] <= 6 * made[30]


def test_forest_of_a_tile_has_fewer_links_than_rows():
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 62, 300, dtype=np.uint64)
    sets = [np.sort(np.concatenate([base[:280], rng.integers(1, 1 << 62, 20, dtype=np.uint64)])) for _ in range(60)]
    table = pa.table(
        {
            "key": np.zeros(60, np.int64),
            "id": np.arange(60),
            "n": np.full(60, 300),
            "label": np.arange(60),
            "own": np.zeros(60, np.int32),
            "alone": np.ones(60, bool),
            "before": pa.array([[]] * 60, pa.list_(pa.int64())),
            "members": [s.view(np.int64) for s in sets],
        }
    )
    links = [(a, b) for batch in jaccard._forests(Rule(5, 80))(table.to_batches(13)) for a, b in zip(*(c.to_pylist() for c in batch.columns))]
    assert len(links) == 59 and len({*range(60)} - {x for link in links for x in link}) == 0
