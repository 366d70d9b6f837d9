"""Text operators against brute force, on texts with nulls, ties, repeats and odd characters."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from abacist.llm import exact_dedup, jaccard, langid, mixing, passages, substrings

SCHEMA = "doc_id long, text string, lang string, source string, id string, n int, key string, size string, score string, bucket int, _text_ string, label int"
SPACE = r"[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 6))) for _ in range(60)]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    common = text(70)
    texts = [None, "", " \t\n", "a", "A", "a b", "A  B", "x" * 5000, "ab" * 2000, "q r " * 400, common, common.upper(), "İ ǆ \x85z ", "\x0b\x0cend"]
    texts += [common[:200] + text(20) + common[150:] for _ in range(10)]
    for _ in range(25):
        base = text(rng.randint(20, 120)).split(" ")
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "  ", "\n"]).join(copy))
    texts += [texts[20]] * 12
    out = [(i * 3 - 20, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "Z", None])) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "k", "s", "p", 7, "t", 3) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup(docs, rows, none):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lower(t)].append(i)
    want = {(i, max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, *_ in rows}
    assert {tuple(r) for r in exact_dedup.exact_dedup(docs).collect()} == want
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a"), (1, "A"), (2, "b"), (2, "B"), (None, "z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()), key=str)
    assert got == sorted([(None, 1, 2, False), (1, 1, 2, True), (2, 2, 2, True), (2, 2, 2, True), (None, None, 1, True)], key=str)


def test_chunk_names_that_stand_for_two_chunks(spark, docs, rows, monkeypatch):
    """With names of two bits every name is unclear, and digests decide."""
    monkeypatch.setattr(exact_dedup, "span_hashes", lambda data, s, e: (e - s).astype("uint64") & 3)
    got = {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(docs).collect()}
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lower(t)].append(i)
    assert got == {(i, max(groups[lower(t)])) for i, t, *_ in rows}


def mixed(rows, weights=(5, 2, 1), epochs=3):
    size = {i: len(words(t)) for i, t, *_ in rows}
    own = defaultdict(list)
    for i, _, _, s in rows:
        own[s].append(i)
    names = sorted([s for s in own if s is not None]) + [None] * (None in own)
    w = {s: float(weights[k % len(weights)]) for k, s in enumerate(names)}
    total = {s: sum(size[i] for i in own[s]) for s in names}
    most = {s: float(epochs * total[s]) for s in names}
    target, free = {}, set(names)
    while True:
        left = sum(total.values()) - sum(most[s] for s in names if s not in free)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most[s]}
        if not over:
            break
        free -= over
    target = {s: share[s] if s in free else most[s] for s in names}
    out = {}
    for s in names:
        whole = math.floor(target[s] + 0.5)
        rounds, rest = divmod(whole, total[s]) if total[s] else (0, 0)
        for i in sorted(own[s], key=lambda i: hashlib.md5(f"{i}:mix".encode()).hexdigest()):
            part = max(0, min(size[i], rest))
            rest -= part
            out[i] = (size[i], total[s], round(target[s], 3), rounds * size[i] + part)
    return out


@pytest.mark.parametrize("share", [1, 4096])
def test_mix(docs, rows, monkeypatch, share):
    monkeypatch.setattr(mixing, "RANGE_ROWS", share)
    got = mixing.mix(docs).collect()
    want = mixed(rows)
    assert {r.doc_id: (r.size, r.source_size, round(r.target, 3), r.taken) for r in got} == want
    assert all(r.taken <= 3 * r["size"] for r in got)


def test_mix_of_nothing(spark, none):
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (None, "", None)], "doc_id long, text string, source string")
    assert {r.taken for r in mixing.mix(blank).collect()} == {0}


def sets(rows, k):
    out = {}
    for i, t, *_ in rows:
        w = words(lower(t))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("rule", [jaccard.Rule(), jaccard.Rule(1, 60), jaccard.Rule(5, 80)])
def test_jaccard(docs, rows, rule, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 3)
    monkeypatch.setattr(jaccard, "FLUSH_TOKENS", 500)
    own = sets(rows, rule.words)
    ids = sorted(own)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if own[a] and own[b] and 100 * len(own[a] & own[b]) >= rule.percent * len(own[a] | own[b])]
    want = components(ids, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, rule).collect()}
    assert got == {i: (len(own[i]), want[i]) for i in ids}
    assert len(set(want.values())) < len(ids) - 10


def test_wide_signatures_never_rule_out_a_link():
    import numpy as np

    rng, rule = np.random.default_rng(6), jaccard.Rule(5, 80)
    base = rng.integers(1, 1 << 62, 2100).astype(np.uint64)
    for keep, new in ((2100, 0), (1900, 0), (2000, 40), (2100, 260), (2060, 150), (1200, 900)):
        other = np.concatenate([base[:keep], rng.integers(1, 1 << 62, new).astype(np.uint64)])
        room = jaccard._possible(rule, len(base), len(other), *jaccard._folded(jaccard._wide(base), jaccard._wide(other)))[0]
        linked = 100 * keep >= rule.percent * (len(base) + len(other) - keep)
        assert room or not linked
        if keep == 1200:
            assert not room


def test_jaccard_of_nothing(spark, none):
    assert jaccard.jaccard_components(none).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (2, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 2, None), (4, 2, 4), (4, 2, 4), (2, 0, 2)], key=str)


def passages_of(rows, window):
    seen, out = set(), {}
    for i, t in sorted((i, t) for i, t, *_ in rows):
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            if k in seen:
                gone[j : j + window] = [True] * window
            seen.add(k)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [2, 7, 20])
def test_passages(docs, rows, window):
    own = [r for r in rows]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_passages(docs, window).collect()}
    assert got == passages_of(own, window)


def substrings_of(rows, length):
    first, out = {}, {}
    for i, t in sorted((i, t or "") for i, t, *_ in rows):
        b = t.encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if first.setdefault(b[j : j + length], i) < i:
                gone[j : j + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [3, 24, 50])
def test_substrings(docs, rows, length):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_substrings(docs, length).collect()}
    assert got == substrings_of(rows, length)


def test_small_flushes_and_portions(docs, rows, monkeypatch):
    from abacist.llm import recur

    monkeypatch.setattr(recur, "FLUSH_BYTES", 2000)
    monkeypatch.setattr(recur, "BLOCK_BYTES", 500)
    monkeypatch.setattr(recur, "PART_BYTES", 4000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_substrings(docs).collect()}
    assert got == substrings_of(rows, 50)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_passages(docs).collect()}
    assert got == passages_of(rows, 20)


@pytest.mark.parametrize("most", [0, 2000])
def test_no_task_judges_a_hot_trigger_whole(spark, rows, monkeypatch, most):
    from abacist.llm import recur

    rng = random.Random(8)
    line = " ".join(f"hot{k}" for k in range(8))
    some = [(i, t) for i, t, *_ in rows] + [(1000 + k, " ".join(f"{rng.randrange(4 + k % 2 * 9999)}" for _ in range(20)) + f"  {line} " + " ".join(f"{rng.randrange(4 + k % 2 * 9999)}" for _ in range(20))) for k in range(150)]
    some += [(2000, some[-1][1]), (2001, f"{some[-1][1]} {some[-1][1]}")]

    def bounded(judge):
        def run(trigger, ids, start, count, bodies):
            size = {}
            for t, b in zip(trigger.tolist(), bodies):
                size[t] = size.get(t, 0) + len(b)
            assert max(size.values(), default=0) <= most
            return judge(trigger, ids, start, count, bodies)

        return run

    monkeypatch.setattr(recur, "HEAVY_BYTES", most, raising=False)
    for module in (substrings, passages):
        monkeypatch.setattr(module, "_judge", lambda window, judge=module._judge: bounded(judge(window)))
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_substrings(docs).collect()}
    assert got == substrings_of(some, 50)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.remove_passages(docs).collect()}
    assert got == passages_of(some, 20)


def test_repeats_of_nothing(spark, none):
    assert passages.remove_passages(none).count() == substrings.remove_substrings(none).count() == 0
    df = spark.createDataFrame([(None, "x"), (1, None), (1, None)], "doc_id long, text string")
    assert sorted(r.n_words for r in passages.remove_passages(df).collect()) == [0, 0, 1]
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in passages.remove_passages(df).collect()) == [(1, 30, 0), (1, 30, 0), (2, 30, 30)]
    assert sorted(tuple(r)[:3] for r in substrings.remove_substrings(df).collect()) == [(1, len(text), 0), (1, len(text), 0), (2, len(text), len(text))]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.filter(~langid.held_out()))
    judged = model.predict(docs.filter(langid.held_out() & F.col("lang").isNotNull()))
    right = judged.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98
    odd = spark.createDataFrame([(None, 1), ("", 2), ("12 -- 7", 3), ("the", 4), ("日本", 5), ("x" * 300_000, 6)], "text string, score int").withColumn("k", F.col("score"))
    got = [(r.lang_pred, r.score) for r in model.predict(odd).orderBy("k").collect()]
    assert got[:3] == [("und", 0.0)] * 3
    assert all(p in model.languages and 0 <= s <= 1 for p, s in got[3:])


def test_filters_return_every_language_of_a_gram(spark):
    df = spark.createDataFrame([(1, "aaaa bbbb", "x"), (2, "aaaa cccc", "y"), (3, None, "x"), (4, "dd", None)], "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.languages == ["x", "y"]
    code = int.from_bytes(b"aaa", "little") | (3 << 56)
    import numpy as np

    at = langid.slots(np.array([code], np.uint64), langid.SLOTS)
    assert all(model.masks[a[0], 0] & np.uint64(3) == 3 for a in at)
    assert [r.lang_pred for r in model.predict(df).orderBy("doc_id").collect()] == ["x", "y", "und", "x"]


def test_language_without_training_rows(none, docs):
    model = langid.train(none)
    assert {r.lang_pred for r in model.predict(docs).collect()} == {"und"}
    assert model.predict(none).count() == 0
