"""Exact dedup by recipes of content-defined chunks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.llm.common import LOWER, byte_values, lists, raw, slices, small, span_hashes, written

WINDOW = 16
#: One cut in so many bytes on average, and none within so many bytes after a trigger.
CHUNK_BITS = 10
QUIET = 64


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of chunks: after triggers of a rolling hash over 16 bytes, and at row ends.

    A trigger counts only if none stands in the 64 bytes before it, so runs of
    one byte do not fall apart.  Both rules look at the row's own bytes only.
    """
    h = byte_values(data)
    for k in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint64(k)
        h = h + shifted
    at = np.flatnonzero((h >> np.uint64(64 - CHUNK_BITS - 20)) & np.uint64((1 << CHUNK_BITS) - 1) == 0)
    row = np.searchsorted(offsets, at, "right") - 1
    at = at[at - offsets[row] >= WINDOW - 1]
    row = np.searchsorted(offsets, at, "right") - 1
    if len(at):
        far = np.ones(len(at), bool)
        far[1:] = (np.diff(at) > QUIET) | (row[1:] != row[:-1])
        at = at[far]
    return np.unique(np.concatenate([at + 1, offsets[1:][offsets[1:] > offsets[:-1]]]))


def _recipes(batches):
    for batch in batches:
        data, offsets = raw(batch.column(1))
        data = LOWER[data]
        for i, j in slices(offsets):
            at = offsets[i : j + 1] - offsets[i]
            part = data[offsets[i] : offsets[j]]
            ends = cuts(part, at)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
            prints = span_hashes(part, starts, ends).view(np.int64)
            body = part.tobytes()
            digests = [hashlib.blake2b(body[s:e], digest_size=16).digest() for s, e in zip(starts, ends)]
            counts = np.diff(np.searchsorted(ends, at, "right"))
            whole = [hashlib.sha256(body[s:e]).hexdigest() for s, e in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array(whole, pa.string()),
                    lists(prints, counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(digests, pa.binary())),
                ],
                names=["_id", "_bytes", "_sha", "_ids", "_digests"],
            )


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its ordered chunk identifiers, each verified.

    A chunk is named by a 64-bit hash.  The table of distinct chunks shows
    whether a name stands for more than one 128-bit digest; documents that hold
    such a name are listed by digests instead.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = written(rows.mapInArrow(_recipes, f"_id {kind}, _bytes long, _sha string, _ids array<long>, _digests array<binary>"))
    chunks = found.select("_id", F.explode(F.arrays_zip(F.col("_ids").alias("name"), F.col("_digests").alias("digest"))).alias("c")).select("_id", "c.name", "c.digest")
    names = chunks.groupBy("name").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    unclear = written(names.filter(F.col("low") != F.col("high")).select("name"))
    listed = written(chunks.join(small(unclear), "name", "left_semi").select(F.col("_id").alias("_unclear")).distinct())
    marked = found.join(small(listed), F.col("_id").eqNullSafe(F.col("_unclear")), "left")
    digests = F.when(F.col("_unclear").isNotNull(), F.col("_digests"))
    return marked.select("_id", "_bytes", "_sha", "_ids", digests.alias("_exact"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts that are identical after lower-casing A-Z.

    Returns one row per input row: id, keep_id (largest id of the group),
    group_size (rows, repeated ones too), kept, text_sha256.  Null text counts
    as empty; an empty text is a group like any other.  A null id never stays
    while its group holds another; if all ids of a group are null, keep_id is
    null and all stay.  Rows that repeat an id and its text stay together.
    Other columns are ignored.  An empty table gives an empty result.
    """
    rows = recipes(docs, id_col, text_col)
    key = ["_bytes", "_ids", "_exact"]
    groups = rows.groupBy(*key).agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    groups = written(groups).select("_keep", "_n", *[F.col(k).alias(f"{k}_g") for k in key])
    same = (F.col("_bytes") == F.col("_bytes_g")) & (F.col("_ids") == F.col("_ids_g")) & F.col("_exact").eqNullSafe(F.col("_exact_g"))
    keep = F.when(F.col("_n").isNotNull(), F.col("_keep")).otherwise(F.col("_id"))
    return rows.join(groups, same, "left").select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
