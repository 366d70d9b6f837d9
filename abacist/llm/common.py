"""Helpers shared by the operators: tables on shared storage, joins, raw text bytes, word hashes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.plans.session import ensure_checkpoint_dir

#: A table of at most so many narrow rows may be sent to every executor.
SMALL_ROWS = 500_000
#: Bytes of text that numpy works on at once.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20_260).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def shared_folder(spark) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: lineage ends here and lost executors cost nothing."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text(docs: DataFrame, kept: list[str], text_col: str) -> tuple[DataFrame, int]:
    """The columns `kept` and the text, sent once if it is one of them; the text's place."""
    names = [c.lower() for c in kept]
    columns = [F.col(f"`{c}`") for c in kept]
    if text_col.lower() in names:
        return docs.select(*columns), names.index(text_col.lower())
    return docs.select(*columns, F.col(f"`{text_col}`").alias(spare(docs, "_text_"))), len(kept)


def small(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows, without a copy; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges of at most `most` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes that are not white space."""
    word = ~SPACE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = word[first]
    last = first[first > 0] - 1
    end[last] = word[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        n = max(n, 1 << 16)
        for name, x in (("up", _BASE), ("down", _INVERSE)):
            out = np.ones(n, np.uint64)
            done = 1
            while done < n:
                k = min(done, n - done)
                out[done : done + k] = out[:k] * np.uint64(pow(x, done, 1 << 64))
                done += k
            _POWERS[name] = out
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes have equal hashes wherever they stand."""
    sums, down = _prefix(_BYTE[data])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k consecutive values."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    sums, down = _prefix(values)
    return mix((sums[k:] - sums[:-k]) * down[: len(values) - k + 1])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose rows hold so many of the values."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
