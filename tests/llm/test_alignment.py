"""Token alignment against plain loops over the libraries' tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from abacist.llm import alignment as al

BYTES, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def brute(texts):
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = al.byte_letters()
    rows, total = [], Counter()
    for text in texts:
        groups, links = [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            spell_a = [bytes(letters[c] for c in a.id_to_token(i)) if i != 50256 else b"" for i in ids_a]
            spell_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            whole = (" " + text).encode()
            if b"".join(spell_a) == whole == b"".join(spell_b):
                span_a = list(zip(np.cumsum([0, *map(len, spell_a)]).tolist(), np.cumsum(list(map(len, spell_a))).tolist()))
                span_b = list(zip(np.cumsum([0, *map(len, spell_b)]).tolist(), np.cumsum(list(map(len, spell_b))).tolist()))
                links = [(x, y) for x, (p, q) in zip(ids_a, span_a) for y, (r, s) in zip(ids_b, span_b) if max(p, r) < min(q, s)]
                cuts = sorted({q for _, q in span_a} & {s for _, s in span_b})
                for lo, hi in zip([0, *cuts], cuts):
                    groups.append(([x for x, (p, q) in zip(ids_a, span_a) if lo <= p and q <= hi], [y for y, (r, s) in zip(ids_b, span_b) if lo <= r and s <= hi]))
        total.update(links)
        rows.append((groups, links))
    highest = {}
    for (_, y), n in total.items():
        highest[y] = max(highest.get(y, 0), n)
    out = []
    for groups, links in rows:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(total[l] == highest[l[1]] for l in links),
            sum(total[l] for l in links), hashlib.sha256(told.encode()).hexdigest() if groups else "",
        ))
    return out


def test_documents(spark, monkeypatch):
    rng = random.Random(4)
    words = ["entreuon", "the", "zueinen", "antidisestablishment", "3.14159", "don't", "éè", "日本語", "\U0001f600", "<s>", "<|endoftext|>", "<0x41>", "\n\n", "  ", "\t", "a_b", " "]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    texts += [None, "", " ", "▁ mark", "x▁", "ﬁ ligature", "\u0000 nul", "same text", "same text", "é", "\n", "a" * 700]
    long_ = " ".join(rng.choice(words[:7]) for _ in range(300))
    texts.append(long_)
    docs = spark.createDataFrame([(k if k % 9 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("sizes", F.lit(1)).withColumn("Code", F.lit("x"))
    monkeypatch.setattr(al, "SLICE_BYTES", 600)
    found = al.align_documents(docs, BYTES, PIECES).collect()
    wanted = [(k if k % 9 else None, *r) for k, r in enumerate(brute(texts))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)


def test_nothing(spark):
    assert al.align_documents(spark.createDataFrame([], "doc_id long, text string"), BYTES, PIECES).count() == 0
    rows = al.align_documents(spark.createDataFrame([(1, None), (1, ""), (None, None)], "doc_id long, text string"), BYTES, PIECES).collect()
    assert len(rows) == 3 and {tuple(r)[1:] for r in rows} == {(0, 0, 0, 0, 0, 0, "")}


def test_lanes_do_not_change_links():
    rng = np.random.default_rng(3)
    for lane in (1, 2, 7, 1000):
        ends = [np.unique(np.append(rng.choice(400, 150, replace=False) + 1, 401)) for _ in "ab"]
        i, j, end = al.align(*ends, np.array([0]), lane)
        cuts = np.union1d(*ends)
        assert i.tolist() == np.searchsorted(ends[0], cuts).tolist() and j.tolist() == np.searchsorted(ends[1], cuts).tolist()
        assert end.tolist() == np.isin(cuts, np.intersect1d(*ends)).tolist()


def test_both_libraries_agree_on_byte_level_ids():
    model = al.ByteLevel(BYTES)
    for text in ["plain words, it's 42%", "<|endoftext|>", "日本語 \U0001f600\n\n  x", "\u0000\t "]:
        assert model.encode(text) == model._library(text)
