"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.llm.common import LOWER, lists, raw, slices, written

#: Words of a window.
WINDOW = 10
#: Bytes of all windows in one automaton (some 60 bytes of memory each).  More windows make more automata, each of which reads the texts.
AUTOMATON_BYTES = 4 << 20

#: Bytes of words once A-Z are lower case: digits, a-z and all of other letters.
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
#: Between texts; no window holds it.
BORDER = 0x0A


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, lower-cased, with one space before and after each; the place of each word; the words up to each text."""
    data = LOWER[data]
    word = WORD[data]
    head, tail = word.copy(), word.copy()
    head[1:] &= ~word[:-1]
    tail[:-1] &= ~word[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    head[first] = word[first]
    last = first[first > 0] - 1
    tail[last] = word[last]
    starts, size = np.flatnonzero(head), np.flatnonzero(tail) + 1 - np.flatnonzero(head)
    upto = np.searchsorted(starts, offsets)
    # Each word takes its bytes and a space; each text a border and a space more.
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(upto))
    place = np.cumsum(size + 1) - size - 1 + 2 * (texts + 1)
    out = np.full(int((size + 1).sum()) + 2 * (len(offsets) - 1), 0x20, np.uint8)
    out[np.concatenate([[0], np.cumsum(size + 1)])[upto[:-1]] + 2 * np.arange(len(offsets) - 1)] = BORDER
    at = np.flatnonzero(word)
    out[at + np.repeat(place - starts, size)] = data[at]
    return out, place, upto


def _windows(window: int):
    """(item, pattern): every window of words of an item, or all words of a shorter one."""

    def run(batches):
        for batch in batches:
            data, offsets = raw(batch.column(1))
            for i, j in slices(offsets):
                text, place, upto = normalised(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                body = text.tobytes()
                many = np.diff(upto)
                count = np.where(many > 0, np.maximum(many - window + 1, 1), 0)
                own = np.repeat(np.arange(j - i), count)
                first = upto[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                size = np.minimum(many[own], window)
                ends = np.append(place[1:], len(text) + 1) - 1
                # The last word of a text is followed by the border of the next text.
                ends[upto[1:][many > 0] - 1] = np.append(np.flatnonzero(text == BORDER), len(text))[1:][many > 0] - 1
                names = batch.column(0).slice(i, j - i).take(pa.array(own))
                patterns = [body[a - 1 : b + 1] for a, b in zip(place[first].tolist(), ends[first + size - 1].tolist())]
                yield pa.RecordBatch.from_arrays([names, pa.array(patterns, pa.binary())], names=["item", "pattern"])

    return run


_BUILT: dict = {}


def _automaton(name: str, patterns: list[bytes]):
    """The automaton of this task's windows, built once in a worker."""
    if name not in _BUILT:
        import ahocorasick

        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, p in enumerate(patterns):
            machine.add_word(p.decode("latin-1"), k)
        machine.make_automaton()
        _BUILT.clear()
        _BUILT[name] = machine
    return _BUILT[name]


def _scanning(shared, only_hits: bool):
    """Per text: its words, the runs of hit words, and the items found."""

    def run(batches):
        name, patterns, first, owned, items = shared.value
        machine = _automaton(name, patterns) if patterns else None
        size = np.array([len(p) for p in patterns], np.int64)
        for batch in batches:
            data, offsets = raw(batch.column(batch.schema.get_field_index("text")))
            keys = [c for c in batch.schema.names if c != "text"]
            for i, j in slices(offsets):
                text, place, upto = normalised(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = j - i
                hits = np.array(list(machine.iter(text.tobytes().decode("latin-1"))) if machine else [], np.int64).reshape(-1, 2)
                last, pattern = hits[:, 0], hits[:, 1]
                # Back to words: a match starts with the space before its first word and ends with the one after its last.
                begin = np.searchsorted(place, last - size[pattern] + 2) if len(hits) else last
                end = np.searchsorted(place, last, "right") if len(hits) else last
                own = np.searchsorted(upto, begin, "right") - 1
                change = np.zeros(len(place) + 1, np.int64)
                np.add.at(change, begin, 1)
                np.add.at(change, end, -1)
                hit = np.cumsum(change[:-1]) > 0
                text_of = np.repeat(np.arange(n), np.diff(upto))
                new, stop = hit.copy(), hit.copy()
                new[1:] &= ~hit[:-1] | (text_of[1:] != text_of[:-1])
                stop[:-1] &= ~hit[1:] | (text_of[1:] != text_of[:-1])
                new, stop = np.flatnonzero(new), np.flatnonzero(stop) + 1
                runs = np.bincount(text_of[new], minlength=n)
                found = np.unique(np.stack([own, pattern], axis=1), axis=0)
                many = (first[1:] - first[:-1])[found[:, 1]]
                item = owned[np.repeat(first[found[:, 1]] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
                told = np.unique(np.stack([np.repeat(found[:, 0], many), item], axis=1), axis=0)
                table = pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(batch.schema.get_field_index(c)).slice(i, n) for c in keys],
                        pa.array(np.diff(upto), pa.int64()),
                        lists(new - upto[text_of[new]], runs, pa.int64()),
                        lists(stop - upto[text_of[new]], runs, pa.int64()),
                        lists([items[k] for k in told[:, 1].tolist()], np.bincount(told[:, 0], minlength=n), pa.string()),
                    ],
                    names=[*keys, "n_words", "from", "upto", "items"],
                )
                yield table.filter(pa.array(runs > 0)) if only_hits else table

    return run


def window_table(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (item, pattern) of test items; items without words have none.  A null id is named by the empty string."""
    told = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return told.mapInArrow(_windows(window), "item string, pattern binary").distinct()


def _shared(spark, rows: list):
    """One automaton's windows as a broadcast: patterns, and the items of each in the order of their names."""
    items = sorted({r.item for r in rows}, key=str.encode)
    number = {x: k for k, x in enumerate(items)}
    owners: dict[bytes, list[int]] = {}
    for r in rows:
        owners.setdefault(bytes(r.pattern), []).append(number[r.item])
    first = np.concatenate([[0], np.cumsum([len(o) for o in owners.values()], dtype=np.int64)])
    owned = np.array([k for o in owners.values() for k in o], np.int64)
    return spark.sparkContext.broadcast((uuid.uuid4().hex, list(owners), first, owned, items))


def _covered(spans):
    """Words that lie in any of the spans, which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("last"))

    def add(acc, s):
        rest = F.greatest(s["upto"] - F.greatest(s["from"], acc["last"]), F.lit(0).cast("long"))
        return F.struct((acc["total"] + rest).alias("total"), F.greatest(acc["last"], s["upto"]).alias("last"))

    return F.aggregate(F.array_sort(spans), start, add, lambda acc: acc["total"])


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """Per document the words that stand in windows of test items, and the items found.

    Words are runs of digits, letters a-z (A-Z are lower-cased) and anything
    beyond ASCII.  A window is `window` consecutive words of an item, or all
    words of a shorter item.  Texts are normalised to words between single
    spaces, read once by an automaton over all windows, and matches are mapped
    back to the words of the text.  The windows are distinct rows of a written
    table whose size is summed first: up to `automaton_bytes` they form one
    automaton; more are dealt to several by hash, and hits are put together.

    Returns id, n_words, n_hit, n_items, items (ids as strings, sorted),
    spans (from, upto: runs of hit words, upto excluded), items_sha256 (of the
    ids joined by commas) and contaminated.  Null texts have no words; repeated
    and null ids are kept row by row; a null item id is named ''; items that
    share an id are one item.  Other columns are ignored; an empty table of
    documents gives an empty result, one of items finds nothing.
    """
    spark = docs.sparkSession
    windows = written(window_table(items, item_col, item_text, window))
    size = windows.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    count = max(1, -(-size // automaton_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = "n_words long, from array<long>, upto array<long>, items array<string>"
    if count == 1:
        scanned = rows.mapInArrow(_scanning(_shared(spark, windows.collect()), False), f"id long, {found}")
        scanned = scanned.withColumn("spans", F.arrays_zip("from", "upto"))
    else:
        keyed = rows.withColumn("name", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
        hits = None
        for k in range(count):
            part = windows.filter(F.pmod(F.xxhash64("item", "pattern"), F.lit(count)) == k).collect()
            some = written(keyed.dropDuplicates(["id", "name"]).mapInArrow(_scanning(_shared(spark, part), True), f"id long, name binary, {found}"))
            hits = some if hits is None else hits.unionByName(some)
        # As many rows of a document as there are automata.
        spans = F.flatten(F.collect_list(F.arrays_zip("from", "upto"))).alias("spans")
        merged = hits.groupBy("id", "name").agg(spans, F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        counted = keyed.mapInArrow(_scanning(_shared(spark, []), False), f"id long, name binary, {found}").select("id", "name", "n_words")
        same = F.col("id").eqNullSafe(F.col("id_hit")) & (F.col("name") == F.col("name_hit"))
        scanned = counted.join(merged.withColumnsRenamed({"id": "id_hit", "name": "name_hit"}), same, "left")
        none = F.array().cast("array<struct<from:bigint,upto:bigint>>")
        scanned = scanned.select("id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    hit = _covered(F.col("spans"))
    return scanned.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
