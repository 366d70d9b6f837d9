"""Decontamination against plain loops over word lists."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from abacist.llm.decontaminate import decontaminate

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window):
    patterns = []
    for name, text in items:
        w = words(text)
        patterns += [("" if name is None else str(name), w[i : i + window]) for i in range(max(1, len(w) - window + 1)) if w]
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for name, p in patterns:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(name)
        told = ",".join(sorted(found, key=str.encode))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(told.encode()).hexdigest(), bool(hit)))
    return out


def made(rng):
    vocabulary = ["A", "the", "Né", "x1", "été", "b", "日本", "question", "2024"]
    gaps = [" ", "  ", ", ", "\n", "--", "_", "? "]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice(gaps) for _ in range(n))
    items = [(k % 25, say(rng.randrange(3, 14))) for k in range(30)] + [(77, None), (78, ""), (79, "?!"), (None, say(5)), (10, "b"), (500, "lonely")]
    docs = [(k if k % 7 else None, say(rng.randrange(0, 60))) for k in range(40)]
    docs += [(100 + k, say(3) + "( " + items[k][1].upper() + say(4)) for k in range(20)]
    return docs + [(1, None), (1, ""), (1, "  ?"), (200, "lonely"), (200, "lonely"), (201, "LONELY\x00lonely"), (202, "alonely")], items


@pytest.mark.parametrize("limit", [1 << 20, 1500])
def test_against_brute_force(spark, limit):
    docs, items = made(random.Random(8))
    docs = docs if limit > 1500 else docs[::3]
    mine = decontaminate(spark.createDataFrame(docs, DOCS).withColumn("items", F.lit(0)).withColumn("N_Words", F.lit(0)), spark.createDataFrame(items, ITEMS).withColumn("item", F.lit(3)), window=4, automaton_bytes=limit)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in mine.collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(brute(docs, items, 4), key=key)


def test_spans_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two Three four, one two"), (2, "nothing here")], DOCS)
    items = spark.createDataFrame([(9, "two three"), (10, "two")], ITEMS)
    rows = {r.doc_id: r for r in decontaminate(docs, items).collect()}
    assert [tuple(s) for s in rows[1].spans] == [(1, 3), (5, 6)] and rows[1]["items"] == ["10", "9"]
    assert rows[2].n_hit == 0 and rows[2].items_sha256 == hashlib.sha256(b"").hexdigest() and not rows[2].contaminated
    assert [r.n_hit for r in decontaminate(docs, items.limit(0)).collect()] == [0, 0]
    assert decontaminate(docs.limit(0), items).count() == 0
