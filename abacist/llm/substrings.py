"""Substring dedup by prefix-free parsing: phrases between rolling-hash triggers, sorted by suffix."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from abacist.llm.common import byte_values
from abacist.llm.recur import Unit, repeats

TRIGGER_BYTES = 20


def _bytes(data, offsets):
    at = np.arange(len(data))
    return byte_values(data), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), at, at + 1


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the string of `length` bytes at every place: a suffix order to that depth, by doubling.

    Places less than `length` bytes before the end see zeros behind it.
    """
    padded = np.concatenate([data, np.zeros(length, np.uint8)]).astype(np.uint64)
    rank, depth = padded, 1
    while depth < 8 and depth * 2 <= length:
        rank = (rank[:-depth] << np.uint64(8 * depth)) | rank[depth:]
        depth *= 2
    while depth < length:
        step = min(depth, length - depth)
        _, rank = np.unique(rank, return_inverse=True)
        pair = rank[:-step].astype(np.uint64) * np.uint64(len(rank) + 1) + rank[step:].astype(np.uint64)
        rank, depth = pair, depth + step
    return np.unique(rank[: len(data)], return_inverse=True)[1]


def _judge(length: int, bits: int = 0):
    def run(trigger, ids, start, count, bodies):
        # A phrase alone under its trigger has no equal strings elsewhere.
        group = np.cumsum(np.append(True, trigger[1:] != trigger[:-1])) if len(trigger) else np.zeros(0, np.int64)
        many = np.bincount(group, minlength=1)[group] > 1
        ids, start, count = ids[many], start[many], count[many]
        bodies = [b for b, m in zip(bodies, many.tolist()) if m]
        if not bodies:
            return ids, start, start
        # The dictionary is the phrases one after another, each with the bytes its last window needs.
        data = np.frombuffer(b"".join(bodies), np.uint8)
        size = np.array([len(b) for b in bodies])
        rank = ranks(data, length)
        at = np.repeat(np.cumsum(size) - size, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        owner = np.repeat(np.arange(len(bodies)), count)
        order = rank[at]
        least = np.full(int(order.max()) + 1 if len(order) else 0, np.iinfo(np.int64).max)
        document = ids[owner] >> bits
        np.minimum.at(least, order, document)
        again = least[order] < document
        place = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        return _runs(again, owner, ids[owner], place)

    return run


def _runs(again, owner, ids, place):
    """Stretches of repeated windows of one phrase."""
    first, last = again.copy(), again.copy()
    first[1:] &= ~again[:-1] | (owner[1:] != owner[:-1])
    last[:-1] &= ~again[1:] | (owner[1:] != owner[:-1])
    return ids[first], place[first], place[last] + 1


def _finish(data, offsets, first, lo, hi, removed):
    n = np.diff(offsets)
    total = np.concatenate([[0], np.cumsum(removed)])
    head = removed.copy()
    head[1:] &= ~removed[:-1]
    head[offsets[:-1][n > 0]] = removed[offsets[:-1][n > 0]]
    heads = np.concatenate([[0], np.cumsum(head)])
    kept = data[~removed].tobytes()
    at = offsets - total[offsets]
    shas = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return [pa.array(n, pa.int64()), pa.array(np.diff(total[offsets]), pa.int64()), pa.array(np.diff(heads[offsets]), pa.int64()), pa.array(shas)]


def remove_substrings(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document what is left when repeated byte strings go.

    Every byte covered by a string of `length` bytes that also starts in a
    document with a smaller id is removed; strings are judged on the input.
    Texts are parsed into phrases at rolling-hash triggers (the least hash of
    20 bytes within a string).  The dictionary holds each recurring phrase once
    per task, with the bytes its last string needs, so the suffix order of the
    dictionary to that depth is the order of all strings in the corpus; strings
    of equal rank are equal, and their least document keeps its bytes.

    Returns id, n_bytes, n_removed, n_spans, kept_sha256.  Null text counts as
    empty.  Each row is a document; rows that repeat an id never remove each
    other's bytes, and a null id counts as larger than all others.  Other columns are
    ignored; an empty table gives an empty result.
    """
    unit = Unit(_bytes, length, min(TRIGGER_BYTES, length), own=False)
    return repeats(docs, id_col, text_col, unit, lambda bits: _judge(length, bits) if bits else _judge(length), _finish, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
