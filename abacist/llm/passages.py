"""Passage dedup by Aho-Corasick automata over the words of recurring phrases."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from abacist.llm.common import span_hashes, word_spans
from abacist.llm.recur import Unit, repeats

TRIGGER_WORDS = 6

def _words(data, offsets):
    start, end, row = word_spans(data, offsets)
    return span_hashes(data, start, end), row, start, end


def _same(body: bytes) -> bytes:
    return b" ".join(body.split())


def _judge(window: int, bits: int = 0):
    def run(trigger, ids, start, count, bodies):
        import ahocorasick

        split = [b.split() for b in bodies]
        group = np.cumsum(np.append(True, trigger[1:] != trigger[:-1])) if len(trigger) else np.zeros(0, np.int64)
        many = np.bincount(group, minlength=1)[group] > 1
        # A phrase alone under its trigger has only itself to repeat.  Two equal windows d words
        # apart have at most d different words, and all windows share the words in the middle.
        open_ = {k for k, m in enumerate(many.tolist()) if m or len(set(split[k][int(count[k]) - 1 : window])) < count[k]}
        order = [k for k in np.lexsort((start, ids >> bits)).tolist() if k in open_]
        numbers = {w: i for i, w in enumerate(sorted({w for k in order for w in split[k]}))}
        base = int(len(numbers) ** 0.5) + 1
        # A word is two digits of separate alphabets: nodes have few children, and matches start at words.
        digits = {w: (i // base, base + i % base) for w, i in numbers.items()}
        machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        texts = {k: tuple(d for w in split[k] for d in digits[w]) for k in order}
        for k in reversed(order):  # against corpus order, so the first occurrence is what stays
            doc, at, words = int(ids[k]) >> bits, int(start[k]), texts[k]
            for i in range(int(count[k]) - 1, -1, -1):
                name = words[2 * i : 2 * (i + window)]
                # Rows of one id may lie in each other's way: the least place is kept.
                if not bits or machine.get(name, (doc, at + i)) >= (doc, at + i):
                    machine.add_word(name, (doc, at + i))
        out = []
        if len(machine):
            machine.make_automaton()
            for k in order:
                doc, at = int(ids[k]), int(start[k])
                for last, first in machine.iter(texts[k]):
                    place = at + last // 2 - window + 1
                    if first < (doc >> bits, place):
                        out.append((doc, place))
        found = np.array(out, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1], found[:, 1] + 1

    return run


def _finish(data, offsets, first, lo, hi, removed):
    total = np.concatenate([[0], np.cumsum(removed)])
    body = data.tobytes()
    kept = np.flatnonzero(~removed)
    words = [body[a:b] for a, b in zip(lo[kept].tolist(), hi[kept].tolist())]
    at = first - total[first]
    shas = [hashlib.sha256(b" ".join(words[a:b])).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return [pa.array(np.diff(first), pa.int64()), pa.array(np.diff(total[first]), pa.int64()), pa.array(shas)]


def remove_passages(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document what is left when repeated passages of words go.

    A window is `window` consecutive words of one document.  Every word covered
    by a window whose words also start earlier (smaller id, or the same
    document further up) is removed; windows are judged on the input.  Phrases
    whose trigger recurs are confirmed by their words; automata over the
    windows of recurring phrases, sharded by trigger, find every place where
    one occurs, and all but the first are repeats.

    Returns id, n_words, n_removed, kept_sha256 (kept words joined by one
    space).  Null text has no words.  Every row is judged: under a shared id, a
    window that starts further up in any of its rows is the earlier one, and
    equal places count as one; a null id comes after all others.  Other columns are ignored; an empty table gives an
    empty result.
    """
    unit = Unit(_words, window, min(TRIGGER_WORDS, window), own=True, same=_same)
    return repeats(docs, id_col, text_col, unit, lambda bits: _judge(window, bits) if bits else _judge(window), _finish, f"{id_col} long, n_words long, n_removed long, kept_sha256 string")
