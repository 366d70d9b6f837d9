"""Windows of symbols that occur again: the shared search of the two passage operators.

A window is so many consecutive bytes or words.  Its trigger is the least of
the rolling hashes of the `inner` symbols inside it, so equal windows have
equal triggers.  Consecutive windows with one trigger form a phrase.  Three
exchanges, all packed in blocks, find every window that occurs again:

1. triggers meet by value; those that occur once are out;
2. texts meet their recurring triggers and send the phrases, by trigger; those of
   triggers with too many phrases for one task send digests of single windows
   instead, by digest;
3. texts meet the windows found to be repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.llm.common import mix, raw, slices, window_hashes, written
from abacist.plans.ordering import with_row_index
from abacist.plans.skew import skew_join

#: Bytes of text that one task holds packed at a time, and that one partition of packed rows stands for.
FLUSH_BYTES = 24 << 20
PART_BYTES = 24 << 20
#: Bytes of text in one compressed block.
BLOCK_BYTES = 1 << 20
#: Bytes of all phrases of one trigger from which its windows are sent one by one, and windows that a task holds at a time then.
HEAVY_BYTES = 2 << 20
HEAVY_WINDOWS = 1 << 20
BUCKETS_PER_PART = 2
PACKED = "bucket int, kind int, n int, f0 binary, f1 binary, f2 binary, f3 binary, f4 binary"
FIELDS = ["bucket", "kind", "n", "f0", "f1", "f2", "f3", "f4"]


@dataclass(frozen=True)
class Unit:
    """What a window is made of.

    parse(data, offsets) gives a hash for every symbol, the row of every
    symbol, and its byte span.  own: windows that recur within one row count.
    same(bytes) is equal for the bytes of equal windows.
    """

    parse: Callable
    window: int
    inner: int
    own: bool
    same: Callable = bytes
    bits: int = 0

    def sooner(self, ids, start, other, later):
        """Whether places come before others: in a document of smaller id, or further up under one id if that counts."""
        a, b = ids >> self.bits, other >> self.bits
        return (a < b) | (self.own & (a == b) & (start < later))


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, and so on: compresses well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def flat(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def short(trigger: np.ndarray) -> bytes:
    """The low 40 bits of triggers; the bucket holds some of the others."""
    return planes(trigger)[: 5 * len(trigger)]


def long(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return flat(data + bytes(3 * n), np.uint64)


LOW = np.uint64((1 << 40) - 1)


def packed(bucket, kind, n, *fields) -> pa.RecordBatch:
    cells = [*fields, *[b""] * (5 - len(fields))]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([n], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], names=FIELDS)


def phrases(unit: Unit, values: np.ndarray, row: np.ndarray, rows: int):
    """Row, first window, number of windows and trigger of every phrase; windows count from the row's start."""
    none = np.zeros(0, np.int64)
    total = len(values) - unit.window + 1
    if total <= 0:
        return none, none, none, none.astype(np.uint64)
    least = window_hashes(values, unit.inner)
    wide = unit.window - unit.inner + 1
    done = 1
    while done < wide:  # minimum of `wide` neighbours from minima of fewer
        step = min(done, wide - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    inside = row[:total] == row[unit.window - 1 :]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (least[1:total] != least[: total - 1]) | (row[1:total] != row[: total - 1])
    start = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
    first = np.searchsorted(row, np.arange(rows))
    return row[start], start - first[row[start]], stop - start, least[start]


def by_bucket(buckets: np.ndarray, count: int):
    """Index ranges of each bucket that occurs, for values sorted by bucket."""
    edges = np.searchsorted(buckets, np.arange(count + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), slice(edges[b], edges[b + 1])


def bucket_by_high_bits(trigger, count):
    return ((trigger >> np.uint64(40)) % np.uint64(count)).astype(np.int32)


def _id_bucket(ids, count):
    return (mix(ids.view(np.uint64)) % np.uint64(count)).astype(np.int32)


def _triggers(unit: Unit, buckets: int):
    def flush(trigger, ids, size):
        order = np.argsort(trigger)
        trigger, ids, size = trigger[order], ids[order], np.concatenate([[0], np.cumsum(size[order])])
        first = np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1])[: len(trigger)])
        edges = np.append(first, len(trigger))
        size, count = np.diff(size[edges]), np.diff(edges)
        many = count > 1 if unit.own else np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        # Triggers that occur again right here are known to recur; one row of them tells the others.
        again = np.repeat(many, count)
        yield from send_pairs(trigger[again], ids[again], buckets, unit.own)
        b = bucket_by_high_bits(trigger[first], buckets)
        order = np.argsort(b, kind="stable")
        t, i, m, z, b = trigger[first][order], ids[first][order], many[order], size[order], b[order]
        for bucket, s in by_bucket(b, buckets):
            yield packed(bucket, 0, s.stop - s.start, short(t[s]), planes(i[s]), m[s].tobytes(), planes(z[s]))

    def triggers(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = raw(batch.column(1))
            for i, j in slices(offsets):
                values, at_row, begin, end = unit.parse(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                row, start, count, trigger = phrases(unit, values, at_row, j - i)
                at = np.searchsorted(at_row, np.arange(j - i))[row] + start
                long_ = end[at + count + unit.window - 2] - begin[at]
                if unit.own:  # a trigger that stands twice in a document recurs even if all its windows are one phrase
                    inner = window_hashes(values, unit.inner)
                    names, times = np.unique(mix(inner ^ mix(at_row[: len(inner)].astype(np.uint64))), return_counts=True)
                    twice = np.isin(mix(trigger ^ mix(row.astype(np.uint64))), names[times > 1])
                    trigger, row, long_ = np.concatenate([trigger, trigger[twice]]), np.concatenate([row, row[twice]]), np.concatenate([long_, np.zeros(int(twice.sum()), np.int64)])
                held.append((trigger, ids[row + i], long_))
                size += int(offsets[j] - offsets[i])
                if size >= FLUSH_BYTES:
                    yield from flush(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield from flush(*map(np.concatenate, zip(*held)))

    return triggers


def send_pairs(trigger, ids, buckets, copies=True):
    """Recurring triggers of documents, packed by document."""
    b = _id_bucket(ids, buckets)
    order = np.lexsort((trigger, ids, b))
    trigger, ids, b = trigger[order], ids[order], b[order]
    if not copies and len(ids):
        new = np.append(True, (trigger[1:] != trigger[:-1]) | (ids[1:] != ids[:-1]))
        trigger, ids, b = trigger[new], ids[new], b[new]
    for bucket, s in by_bucket(b, buckets):
        yield packed(bucket, 1, s.stop - s.start, short(trigger[s]), planes(ids[s]))


def buckets_of(batches):
    """(bucket, its rows as dicts) of a partition sorted by bucket."""
    held, at = [], None
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != at and held:
                yield at, held
                held = []
            at = r["bucket"]
            held.append(r)
    if held:
        yield at, held


def _again_of(values: np.ndarray) -> np.ndarray:
    """Which of sorted values occur more than once."""
    same = np.zeros(len(values), bool)
    same[1:] = values[1:] == values[:-1]
    again = same.copy()
    again[:-1] |= same[1:]
    return again


def _recurring(buckets: int, most: int):
    def recurring_triggers(batches):
        out = []
        for bucket, rows in buckets_of(batches):
            seen = [r for r in rows if r["kind"] == 0]
            for r in rows:
                if r["kind"] == 1:
                    yield packed(bucket, 1, r["n"], r["f0"], r["f1"])
            if not seen:
                continue
            trigger = np.concatenate([long(r["f0"]) for r in seen])
            ids = np.concatenate([flat(r["f1"], np.int64) for r in seen])
            many = np.concatenate([np.frombuffer(r["f2"], bool) for r in seen])
            size = np.concatenate([flat(r["f3"], np.int64) for r in seen])
            order = np.argsort(trigger)
            trigger, ids, many, size = trigger[order], ids[order], many[order], size[order]
            new = np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1]))
            heavy = trigger[new][np.add.reduceat(size, new) > most]
            if len(heavy):
                yield packed(bucket, 5, len(heavy), planes(heavy | np.uint64(bucket << 40)))
            take = _again_of(trigger) & ~many
            out.append((trigger[take], ids[take]))
        if out:
            yield from send_pairs(*map(np.concatenate, zip(*out)), buckets)

    return recurring_triggers


def _blocks(buckets: int):
    """Texts in compressed blocks, packed by document."""

    def text_blocks(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = raw(batch.column(1))
            for i, j in slices(offsets, FLUSH_BYTES):
                b = _id_bucket(ids[i:j], buckets)
                order = np.argsort(b, kind="stable")
                for bucket, s in by_bucket(b[order], buckets):
                    own = order[s] + i
                    size = offsets[own + 1] - offsets[own]
                    for x, y in slices(np.concatenate([[0], np.cumsum(size)]), BLOCK_BYTES):
                        text = b"".join(data[offsets[k] : offsets[k + 1]].tobytes() for k in own[x:y])
                        yield packed(bucket, 9, y - x, planes(ids[own[x:y]]), planes(size[x:y]), pa.compress(text, "zstd", asbytes=True), len(text).to_bytes(8, "little"))

    return text_blocks


def texts_of(rows):
    """(ids, bytes, offsets) of the text among packed rows, as many blocks at a time as BLOCK_BYTES hold.

    The more buckets there are, the smaller are the blocks that a task gets of each.
    """

    def together():
        ids, sizes, data = zip(*held)
        data = data[0] if len(data) == 1 else b"".join(data)
        return np.concatenate(ids), np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    held, size = [], 0
    for r in rows:
        if r["kind"] == 9:
            n = int.from_bytes(r["f3"], "little")
            if held and size + n > BLOCK_BYTES:
                yield together()
                held, size = [], 0
            held.append((flat(r["f0"], np.int64), flat(r["f1"], np.int64), pa.decompress(r["f2"], n, "zstd")))
            size += n
    if held:
        yield together()


def among(wanted: np.ndarray) -> Callable:
    """Tells which of the values it gets are wanted.  A table of low bits, made once, rules most of the others out."""
    wanted = np.unique(wanted)
    low = np.uint64((1 << min(26, (16 * len(wanted)).bit_length())) - 1)
    seen = np.zeros(int(low) + 1, bool)
    seen[wanted & low] = True

    def run(values: np.ndarray) -> np.ndarray:
        hit = seen[values & low]
        at = np.flatnonzero(hit)
        hit[at] = wanted[np.minimum(np.searchsorted(wanted, values[at]), len(wanted) - 1)] == values[at]
        return hit

    return run


def _again(unit: Unit, high, low, ids, start):
    """Order of windows by digest and place, and which of them, so ordered, repeat the first of their digest."""
    order = np.lexsort((start, ids >> unit.bits, low, high))
    high, low, ids, start = high[order], low[order], ids[order], start[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(high)), 0))
    return order, unit.sooner(ids[head], start[head], ids, start)


def _windows(unit: Unit, buckets: int, ids, start, digests: bytes):
    """Windows of heavy triggers: those that repeat one in this task are known, the others meet by digest."""
    high, low = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
    order, later = _again(unit, high, low, ids, start)
    known, keep = order[later], order[~later]
    yield from send_spans(ids[known], start[known], start[known] + 1, buckets)
    b = (high[keep] % np.uint64(buckets)).astype(np.int32)
    keep = keep[np.lexsort((start[keep], ids[keep], b))]
    for bucket, s in by_bucket((high[keep] % np.uint64(buckets)).astype(np.int32), buckets):
        k = keep[s]
        yield packed(bucket, 4, len(k), planes(high[k]), planes(low[k]), planes(ids[k]), planes(start[k]))


def _candidates(unit: Unit, buckets: int, heavy: np.ndarray):
    """Phrases with recurring triggers: of equal ones in a task, only the first goes on."""

    def flush(ids, start, count, trigger, sizes, bodies):
        # Equal phrases of one flush: those after the first are repeats as a whole.
        later = _first_of_equal(unit, trigger, ids, start, bodies)
        yield from send_spans(ids[later], start[later], start[later] + count[later], buckets)
        keep = np.flatnonzero(~later)
        b = bucket_by_high_bits(trigger[keep], buckets)
        keep = keep[np.lexsort((trigger[keep], b))]
        for bucket, s in by_bucket(bucket_by_high_bits(trigger[keep], buckets), buckets):
            k = keep[s]
            yield packed(bucket, 2, len(k), planes(trigger[k]), planes(ids[k]), planes(start[k]), planes(np.concatenate([count[k], sizes[k]])), pa.compress(b"".join(bodies[x] for x in k), "zstd", asbytes=True))

    def digest(ids, start, count, lo, hi, body):
        """Digests of all windows of phrases: of each the document, the place and 16 bytes."""
        own = np.repeat(np.arange(len(ids)), count)
        inside = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        spans = zip(lo[inside + np.repeat(start, count)].tolist(), hi[inside + np.repeat(start, count) + unit.window - 1].tolist())
        return ids[own], inside, own, b"".join(hashlib.blake2b(unit.same(body[x:y]), digest_size=16).digest() for x, y in spans)

    def candidate_phrases(batches):
        held, size = [], 0
        lone, windows = [], 0
        much_of = among(heavy)
        for _, rows in buckets_of(batches):
            pairs = [r for r in rows if r["kind"] == 1]
            trigger = np.concatenate([long(r["f0"]) for r in pairs]) if pairs else np.zeros(0, np.uint64)
            owner = np.concatenate([flat(r["f1"], np.int64) for r in pairs]) if pairs else np.zeros(0, np.int64)
            wanted = among(mix(trigger ^ mix(owner.view(np.uint64))))
            for ids, data, offsets in texts_of(rows):
                values, row, begin, end = unit.parse(data, offsets)
                owner, start, count, trigger = phrases(unit, values, row, len(ids))
                hit = wanted(mix((trigger & LOW) ^ mix(ids.view(np.uint64))[owner]))
                owner, start, count, trigger = owner[hit], start[hit], count[hit], trigger[hit]
                if not len(owner):
                    continue
                at = np.searchsorted(row, np.arange(len(ids)))[owner] + start
                body = data.tobytes()
                much = much_of((trigger & LOW) | (bucket_by_high_bits(trigger, buckets).astype(np.uint64) << np.uint64(40)))
                edges = np.concatenate([[0], np.cumsum(count[much])])
                for x, y in slices(edges, HEAVY_WINDOWS):
                    k = np.flatnonzero(much)[x:y]
                    doc, inside, own, digests = digest(ids[owner[k]], at[k], count[k], begin, end, body)
                    lone.append((doc, start[k][own] + inside, np.frombuffer(digests, np.uint8)))
                    windows += len(doc)
                    if windows >= HEAVY_WINDOWS:
                        doc, place, digests = map(np.concatenate, zip(*lone))
                        yield from _windows(unit, buckets, doc, place, digests.tobytes())
                        lone, windows = [], 0
                owner, start, count, trigger, at = owner[~much], start[~much], count[~much], trigger[~much], at[~much]
                if not len(owner):
                    continue
                lo, hi = begin[at], end[at + count + unit.window - 2]
                held.append((ids[owner], start, count, trigger, hi - lo, [body[x:y] for x, y in zip(lo.tolist(), hi.tolist())]))
                size += int((hi - lo).sum())
                if size >= FLUSH_BYTES:
                    yield from flush(*_joined(held))
                    held, size = [], 0
        if held:
            yield from flush(*_joined(held))
        if lone:
            doc, place, digests = map(np.concatenate, zip(*lone))
            yield from _windows(unit, buckets, doc, place, digests.tobytes())

    return candidate_phrases


def _joined(held):
    *columns, bodies = zip(*held)
    return [*map(np.concatenate, columns), [b for part in bodies for b in part]]


def send_spans(ids, begin, end, buckets):
    """Ranges of windows to remove, packed by document."""
    b = _id_bucket(ids, buckets)
    order = np.lexsort((begin, ids, b))
    ids, begin, end, b = ids[order], begin[order], end[order], b[order]
    # Ranges of one document that follow each other are sent as one.
    new = np.ones(len(ids) + 1, bool)
    new[1:-1] = (ids[1:] != ids[:-1]) | (begin[1:] != end[:-1])
    ids, begin, end, b = ids[new[:-1]], begin[new[:-1]], end[new[1:]], b[new[:-1]]
    for bucket, s in by_bucket(b, buckets):
        yield packed(bucket, 3, s.stop - s.start, planes(ids[s]), planes(begin[s]), planes(end[s]))


def _first_of_equal(unit: Unit, trigger, ids, start, bodies) -> np.ndarray:
    """Whether a phrase repeats, as a whole, one that comes before it."""
    name = np.fromiter(map(hash, bodies), np.int64, len(bodies)).view(np.uint64) ^ trigger
    order = np.argsort(name)
    order = order[_again_of(name[order])]  # only phrases that share a name are put in corpus order
    order = order[np.lexsort((start[order], ids[order] >> unit.bits, name[order]))]
    new = np.append(True, name[order][1:] != name[order][:-1])[: len(order)]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    # The name is a hash: only equal bytes count as equal.
    same = np.fromiter((bodies[k] == bodies[h] for k, h in zip(order.tolist(), head.tolist())), bool, len(order))
    later = np.zeros(len(ids), bool)
    later[order] = same & unit.sooner(ids[head], start[head], ids[order], start[order])
    return later


def _decided(judge: Callable, unit: Unit, buckets: int):
    def repeated_windows(batches):
        found: list = []
        for bucket, rows in buckets_of(batches):
            for r in rows:
                if r["kind"] == 3:
                    yield packed(bucket, 3, r["n"], r["f0"], r["f1"], r["f2"])
            single = [r for r in rows if r["kind"] == 4]
            if single:
                high, low = (np.concatenate([flat(r[f], np.uint64) for r in single]) for f in ("f0", "f1"))
                ids, start = (np.concatenate([flat(r[f], np.int64) for r in single]) for f in ("f2", "f3"))
                order, later = _again(unit, high, low, ids, start)
                known = order[later]
                found.append((ids[known], start[known], start[known] + 1))
            sent = [r for r in rows if r["kind"] == 2]
            if not sent:
                continue
            trigger = np.concatenate([flat(r["f0"], np.uint64) for r in sent])
            ids = np.concatenate([flat(r["f1"], np.int64) for r in sent])
            start = np.concatenate([flat(r["f2"], np.int64) for r in sent])
            pair = np.concatenate([flat(r["f3"], np.int64).reshape(2, -1) for r in sent], axis=1)
            count, size = pair
            each = [int(p.sum()) for p in (flat(r["f3"], np.int64).reshape(2, -1)[1] for r in sent)]
            data = b"".join(pa.decompress(r["f4"], n, "zstd", asbytes=True) for r, n in zip(sent, each))
            ends = np.cumsum(size)
            order = np.lexsort((start, ids >> unit.bits, trigger))
            # Whole groups of one trigger, in portions of bounded size.
            edges = np.append(np.flatnonzero(np.append(True, trigger[order][1:] != trigger[order][:-1])), len(order))
            upto = np.concatenate([[0], np.cumsum(size[order])])
            for x, y in slices(upto[edges], BLOCK_BYTES):
                k = order[edges[x] : edges[y]]
                bodies = [data[e - s : e] for e, s in zip(ends[k].tolist(), size[k].tolist())]
                later = _first_of_equal(unit, trigger[k], ids[k], start[k], bodies)
                found.append((ids[k[later]], start[k[later]], start[k[later]] + count[k[later]]))
                rest = k[~later]
                found.append(judge(trigger[rest], ids[rest], start[rest], count[rest], [b for b, x in zip(bodies, later.tolist()) if not x]))
        if found:
            yield from send_spans(*map(np.concatenate, zip(*found)), buckets)

    return repeated_windows


def _finished(finish: Callable, unit: Unit, names: list[str]):
    def kept_text(batches):
        for _, rows in buckets_of(batches):
            spans = [r for r in rows if r["kind"] == 3]
            empty = np.zeros(0, np.int64)
            ids, begin, end = (np.concatenate([flat(r[f], np.int64) for r in spans]) if spans else empty for f in ("f0", "f1", "f2"))
            order = np.lexsort((begin, ids))
            ids, begin, end = ids[order], begin[order], end[order]
            for own, data, offsets in texts_of(rows):
                values, row, lo, hi = unit.parse(data, offsets)
                first = np.searchsorted(row, np.arange(len(own) + 1))
                change = np.zeros(len(values) + 1, np.int64)
                left, right = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
                take = np.repeat(left - np.cumsum(right - left) + (right - left), right - left) + np.arange((right - left).sum())
                base = np.repeat(first[:-1], right - left)
                np.add.at(change, base + begin[take], 1)
                np.add.at(change, base + end[take] + unit.window - 1, -1)
                removed = np.cumsum(change[:-1]) > 0
                yield pa.RecordBatch.from_arrays([pa.array(own), *finish(data, offsets, first, lo, hi, removed)], names=names)

    return kept_text


#: Bits of a key that number the rows of one document id.
ROW_BITS = 31


def _keyed(texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Texts under a key of their own, and which id each key stands for: None if the ids are such keys as they are.

    Keys order as the ids do, nulls last; rows of one id are numbered in the
    order of their digests.  No task gathers the rows of one id.
    """
    if texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR id IS NULL").isEmpty():
        return texts, None
    named = texts.withColumns({"none": F.col("id").isNull(), "sha": F.sha2(F.coalesce("text", F.lit("")), 256), "lies": F.monotonically_increasing_id()})
    placed = written(with_row_index(named, ["none", "id", "sha", "lies"], "place").select("id", "text", "place"))
    firsts = placed.groupBy("id").agg(F.min("place").alias("first"))
    order = written(with_row_index(firsts, ["first"], "rank"))
    keyed = skew_join(placed, order, ["id"], null_safe=True)
    key = F.shiftleft("rank", ROW_BITS) + F.col("place") - F.col("first")
    keyed = written(keyed.select("id", key.alias("key"), "text"))
    return keyed.select(F.col("key").alias("id"), "text"), keyed.select("key", F.col("id").alias("told"))


def repeats(docs: DataFrame, id_col: str, text_col: str, unit: Unit, judge: Callable, finish: Callable, schema: str) -> DataFrame:
    """One row per row of docs from `finish`, which is told the removed symbols of whole texts.

    judge(bits) gives a function of (trigger, ids, start, count, bodies) that
    gets phrases sorted by trigger, document and place, and returns documents,
    first and last windows (end excluded) that are repeats.
    """
    texts, told = _keyed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    unit = replace(unit, bits=0 if told is None else ROW_BITS)
    found = _repeats(texts, unit, judge(unit.bits), finish, schema)
    if told is None:
        return found
    back = found.withColumnRenamed(id_col, "key").join(told, "key")
    return back.select(F.col("told").alias(id_col), *[c for c in found.columns if c != id_col])


def _repeats(texts: DataFrame, unit: Unit, judge: Callable, finish: Callable, schema: str) -> DataFrame:
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    count = parts * BUCKETS_PER_PART

    def met(df):
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")

    blocks = texts.mapInArrow(_blocks(count), PACKED)
    pairs = written(met(texts.mapInArrow(_triggers(unit, count), PACKED)).mapInArrow(_recurring(count, HEAVY_BYTES), PACKED))
    # At most one trigger for every HEAVY_BYTES phrases of text.
    heavy = [flat(r["f0"], np.uint64) for r in pairs.filter("kind = 5").select("f0").collect()]
    heavy = np.concatenate(heavy) if heavy else np.zeros(0, np.uint64)
    pairs = pairs.filter("kind <> 5")
    found = met(pairs.unionByName(blocks)).mapInArrow(_candidates(unit, count, heavy), PACKED)
    spans = written(met(found).mapInArrow(_decided(judge, unit, count), PACKED))
    names = [x.split()[0] for x in schema.split(",")]
    return met(spans.unionByName(blocks)).mapInArrow(_finished(finish, unit, names), schema)
