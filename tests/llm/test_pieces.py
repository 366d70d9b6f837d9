"""Piece encoding against the public library and against brute force; exact round trips."""

import itertools
import random

import numpy as np
import pytest

from abacist.llm import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(MODEL)


def odd_texts():
    rng = random.Random(3)
    texts = ["", " ", "   ", "a", "\x00", "a▁b", "日本𐍈 ﬁ", "x" * 3000, "the" * 300, "  a   b    c", "    " * 20, "İstanbul ǆ", "a b" * 700, "tail  "]
    return texts + ["".join(rng.choice("abcdet hinor  \n\t.,éß日") for _ in range(rng.randint(0, 80))) for _ in range(800)]


def test_ids_equal_the_library(vocabulary):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts()
    encoder = pieces.Encoder(vocabulary)
    for s in range(0, len(texts), 100):
        flat, counts = encoder.encode(texts[s : s + 100])
        ends = np.cumsum(counts)
        for t, e, c in zip(texts[s : s + 100], ends, counts):
            assert flat[e - c : e].tolist() == library.encode(t), t


def test_round_trip(spark, vocabulary):
    texts = [*odd_texts(), None]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, Token_Ids string").repartition(3)
    got = pieces.decode(pieces.encode(df, vocabulary), vocabulary).collect()
    assert {r.doc_id: r.decoded for r in got} == {i: t if t is None else t.replace("▁", " ") for i, t in enumerate(texts)}
    assert pieces.encode(df.limit(0), vocabulary).count() == 0


def best(text, scores):
    """The highest sum of scores over all ways to cut the text; letters without a piece cost 10 more than the worst."""
    lowest = min(scores.values()) - 10
    top = -np.inf
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, start = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                parts.append(text[start:k])
                start = k
        parts.append(text[start:])
        if all(p in scores or len(p) == 1 for p in parts):
            top = max(top, sum(scores.get(p, lowest) for p in parts))
    return top


def test_scores_vocabulary():
    rng = random.Random(9)
    names = sorted({"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(25)})
    names = [x for x in names if "▁" not in x[1:]]
    scores = {x: -rng.random() * 8 for x in names}
    text = ["<unk>", *names]
    p = pieces.Pieces(text, False, np.array([0.0] + [scores[x] for x in names]), np.array([False] + [True] * len(names)), [], 0)
    encoder = pieces.Encoder(p)
    for _ in range(60):
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 9)))
        flat, _ = encoder.encode([t])
        full = "▁" + t.replace(" ", "▁")
        cost = sum(scores[text[i]] if i else min(scores.values()) - 10 for i in flat.tolist())
        assert cost == pytest.approx(best(full, scores))


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    texts = odd_texts()
    whole = [x.tolist() for x in pieces.Encoder(vocabulary).encode(texts)]
    monkeypatch.setattr(pieces, "KNOWN_WORDS", 10)
    encoder = pieces.Encoder(vocabulary)
    parts = [encoder.encode(texts[s : s + 7]) for s in range(0, len(texts), 7)]
    assert [np.concatenate([p[k] for p in parts]).tolist() for k in (0, 1)] == whole
