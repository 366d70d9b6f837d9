"""Rows that share an id, or have none, keep their own texts and results."""

import hashlib
import random

import pytest

from abacist.llm import passages, substrings, warc

SCHEMA = "doc_id long, text string"


def made():
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    a, x, y = say(40), say(45), say(200)
    rows = [(1, a), (7, f"{x} {a}"), (7, "short"), (7, y), (7, f"{say(9)} {y}"), (3, f"{a} {x}"), (None, f"{say(5)} {x}"), (None, None), (None, "short"), (9, y), (9, y)]
    return rows + [(7, " ".join([x, say(3), a]))]


def order(i):
    return (i is None, i or 0)


def plain(rows, units, size, own):
    """What is removed by comparing (id, place) of every window, row by row."""
    first = {}
    for i, t in rows:
        u = units(t or "")
        for j in range(len(u) - size + 1):
            k, at = tuple(u[j : j + size]), (order(i), j if own else 0)
            first[k] = min(first.get(k, at), at)
    out = []
    for i, t in rows:
        u = units(t or "")
        gone = [False] * len(u)
        for j in range(len(u) - size + 1):
            if first[tuple(u[j : j + size])] < (order(i), j if own else 0):
                gone[j : j + size] = [True] * size
        out.append((order(i), len(u), sum(gone), [x for x, g in zip(u, gone) if not g]))
    return out


@pytest.mark.parametrize("heavy", [0, 2 << 20])
def test_substrings_and_passages(spark, monkeypatch, heavy):
    from abacist.llm import recur

    monkeypatch.setattr(recur, "HEAVY_BYTES", heavy)
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((order(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in substrings.remove_substrings(docs).collect())
    assert got == sorted((i, n, g, hashlib.sha256(bytes(k)).hexdigest()) for i, n, g, k in plain(rows, lambda t: t.encode(), 50, False))
    got = sorted((order(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_passages(docs).collect())
    assert got == sorted((i, n, g, hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, n, g, k in plain(rows, str.split, 20, True))


def test_pages_of_one_id(spark):
    a, b, c = "a" * 150, "b" * 150, "c" * 150
    pages = [(3, "u", a), (4, "u", b), (7, "u", a), (7, "u", b), (7, "u", c), (None, "u", a)]
    rows = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    found = sorted((r.page_id or 0, r.payload_digest, r.record_type, r.refers_to or 0) for r in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = [(3, sha(a), "response", 0), (4, sha(b), "response", 0), (7, sha(a), "revisit", 3), (7, sha(b), "revisit", 4), (7, sha(c), "response", 0), (0, sha(a), "response", 0)]
    assert found == sorted(wanted)


def test_vectors_of_any_magnitude(spark):
    from abacist.llm import vectors

    rows = [(1, [1e-170, 2e-170]), (2, [1.1e-170, 2e-170]), (3, [1e200, 2e200]), (4, [1.1e200, 2.1e200]), (5, [5e-324, 1e-323]), (6, [1.0, -2.0]), (7, [1e308, 0.0]), (8, [0.0, 1e-300]), (9, [2e-300, 1e-310])]
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = {i: [x / max(map(abs, v)) for x in v] for i, v in rows}
    cos = lambda u, v: sum(a * b for a, b in zip(u, v)) / (sum(a * a for a in u) * sum(b * b for b in v)) ** 0.5
    assert {i: n for i, (n, _) in found.items()} == {i: sum(j != i and cos(unit[i], unit[j]) >= 0.9 for j in unit) for i in unit}
