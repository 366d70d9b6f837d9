"""Jaccard join on word shingles: size-banded tiles, bitmap bounds, exact intersection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abacist.llm.common import LOWER, lists, mix, raw, slices, small, span_hashes, window_hashes, word_spans, written
from abacist.llm.recur import LOW, PACKED, bucket_by_high_bits, buckets_of, by_bucket, flat, long, packed, planes, short
from abacist.plans.components import connected_components

#: Bits of a document's signature: parities of the elements that hash to them.
BITS = 1024
#: Rows of a tile that meet in one block; larger tiles are cut in blocks, and every two blocks meet.
BLOCK_ROWS = 4096
#: Bytes of wide signatures or of whole sets that meet in one block.
BLOCK_BYTES = 1 << 22
#: Tiles before the present one that a row names, so that a pair is one tile's work.
EARLIER = 16
#: Bytes of text whose shingles are formed at a time: some 100 bytes of memory each.
TEXT_BYTES = 1 << 18
#: Hashes that deal a set into parts, tried in turn.
HASHES = 8
#: Rounds in which tiles of several components try the first set of a second one before all pairs are compared.
ROUNDS = 2
#: Tile rows that a task holds packed at a time (about 100 bytes each at the peak), and tokens for which one partition is meant.
FLUSH_TOKENS = 1 << 18
PART_TOKENS = 1 << 21


@dataclass(frozen=True)
class Rule:
    """Sets of `words`-word shingles link when 100 * intersection >= percent * union."""

    words: int = 3
    percent: int = 90

    def bands(self, most: int) -> np.ndarray:
        """First sizes of the size bands up to `most`: sets that link are in one band or in neighbours."""
        first = [1]
        while first[-1] <= most:
            first.append(first[-1] * 100 // self.percent + 1)
        return np.array([*first, first[-1] * 100 // self.percent + 1], np.int64)

    def differ(self, following):
        """In how many elements two linked sets may differ, if the smaller has fewer than `following`."""
        return (following - 1) * (100 - self.percent) // self.percent

    def spare(self, least, following):
        """Parts beyond those that may differ: about twice as many as are empty in a set of `least` elements."""
        parts = self.differ(following) + 1
        return np.floor(2 * parts * np.exp(-least / parts) + 0.8).astype(np.int64) * (parts > 1)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes by row, sorted within the row, and how many each row has."""
    data = LOWER[data]
    starts, ends, row = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    full = window_hashes(hashes, words)
    inside = row[: len(full)] == row[words - 1 :] if len(full) else np.zeros(0, bool)
    found, owner = [full[inside]], [row[: len(full)][inside]]
    first = np.cumsum(count) - count
    for k in range(1, words):  # texts with fewer words: the whole sequence is the one shingle
        short = np.flatnonzero(count == k)
        if len(short):
            at = first[short][:, None] + np.arange(k)
            found.append(mix(window_hashes(hashes[at].ravel(), k)[::k] + np.uint64(k)))
            owner.append(short)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.bincount(owner[new], minlength=n)


def tokens(rule: Rule, found: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tile names of each set, and how many each set has.

    In the tile of its own size band and in the one below, a set falls into
    parts by hash; a tile's name is such a part.  Let linked sets differ in d
    elements at most, so in d parts, of d + 1 + spare.  A set with at most
    `spare` empty parts has more than d that are not empty, one of which the
    other set must share: empty parts, which all sets of a band would share,
    give no name.  A set with more empty parts has names by another hash as
    well, and so on until one suits it; two sets meet by the first hash that
    suits either.  Only sets that none of the hashes suits keep empty parts.
    """
    first = rule.bands(int(size.max(initial=1)))
    band = np.searchsorted(first, size, "right") - 1
    owner = np.repeat(np.arange(len(size)), size)
    value = mix(found + np.uint64(17))
    names, owners = [], []
    for below in (0, 1):
        tile = np.maximum(band - below, 0)
        spare = rule.spare(first[tile], first[tile + 1])
        parts = rule.differ(first[tile + 1]) + 1 + spare
        left = (size > 0) & (band >= below)
        for seed in range(HASHES):
            count = np.where(left, parts, 0)
            base = np.cumsum(count) - count
            inside = left[owner]
            own, hashed = owner[inside], found[inside]
            if seed:
                hashed = mix(hashed + np.uint64(seed))
            at = base[own] + ((hashed >> np.uint64(20)) % count[own].astype(np.uint64)).astype(np.int64)
            sums, filled = np.zeros(int(count.sum()), np.uint64), np.zeros(int(count.sum()), bool)
            np.add.at(sums, at, value[inside])
            filled[at] = True
            of = np.repeat(np.arange(len(size)), count)
            left = left & (np.bincount(of[~filled], minlength=len(size)) > spare)
            if seed + 1 == HASHES:
                filled |= left[of]
            place = np.arange(len(sums)) - base[of]
            kind = ((tile[of] * HASHES + seed) * (1 << 32) + place).astype(np.uint64)
            names.append(mix(sums ^ mix(kind))[filled])
            owners.append(of[filled])
            if not left.any():
                break
    names, owners = np.concatenate(names), np.concatenate(owners)
    return names[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(size))


def _signing(rule: Rule):
    def run(batches):
        for batch in batches:
            data, offsets = raw(batch.column(1))
            for i, j in slices(offsets, TEXT_BYTES):
                found, size = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], rule.words)
                rows = j - i
                # Parities: what two sets share cancels out, so the bits that differ count their difference only.
                place = np.repeat(np.arange(rows), size) * BITS + (found & np.uint64(BITS - 1)).astype(np.int64)
                bits = (np.bincount(place, minlength=rows * BITS) & 1).astype(bool).reshape(rows, BITS)
                ends = np.concatenate([[0], np.cumsum(size)])
                marks = []
                for seed in (1, 2):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(found + np.uint64(seed)))])
                    marks.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
                names, count = tokens(rule, found, size)
                wide = [_wide(found[s:e]) if e - s > BITS else b"" for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
                signature = pa.py_buffer(np.packbits(bits, axis=1).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, rows),
                        pa.array(size, pa.int64()),
                        pa.array(marks[0]),
                        pa.array(marks[1]),
                        pa.FixedSizeBinaryArray.from_buffers(pa.binary(BITS // 8), rows, [None, signature]).cast(pa.binary()),
                        pa.array(wide, pa.binary()),
                        lists(names.view(np.int64), count, pa.int64()),
                    ],
                    names=["id", "n", "mark1", "mark2", "bits", "wide", "tokens"],
                )

    return run


def _packing(buckets: int):
    """Tokens by bucket.  Those that several sets of a task have are known to be shared and come out at once."""

    def flush(token, ids):
        order = np.lexsort((ids, token))
        token, ids = token[order], ids[order]
        first = np.ones(len(token), bool)
        first[1:] = token[1:] != token[:-1]
        count = np.diff(np.append(np.flatnonzero(first), len(token)))
        many = np.repeat(count > 1, count)
        shared = np.flatnonzero(many)
        for s in range(0, len(shared), 1 << 16):
            k = shared[s : s + (1 << 16)]
            name = (token[k] & LOW) | (bucket_by_high_bits(token[k], buckets).astype(np.uint64) << np.uint64(40))
            yield packed(int(bucket_by_high_bits(token[k[:1]], buckets)[0]), 1, len(k), planes(name), planes(ids[k]))
        t, i, m = token[first], ids[first], count > 1
        b = bucket_by_high_bits(t, buckets)
        order = np.argsort(b, kind="stable")
        t, i, m = t[order], i[order], m[order]
        for bucket, s in by_bucket(b[order], buckets):
            yield packed(bucket, 0, s.stop - s.start, short(t[s]), planes(i[s]), m[s].tobytes())

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            token = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            held.append((token, np.repeat(ids, batch.column(1).value_lengths().to_numpy(zero_copy_only=False))))
            size += len(token)
            if size >= FLUSH_TOKENS:
                yield from flush(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            yield from flush(*map(np.concatenate, zip(*held)))

    return run


def _sharing(batches):
    """(token, id) of all tokens that more than one set has.  A token is now 40 of its bits and its bucket."""
    for bucket, rows in buckets_of(batches):
        for r in rows:
            if r["kind"] == 1:
                yield pa.RecordBatch.from_arrays([pa.array(flat(r["f0"], np.int64)), pa.array(flat(r["f1"], np.int64))], names=["token", "id"])
        seen = [r for r in rows if r["kind"] == 0]
        if not seen:
            continue
        token = np.concatenate([long(r["f0"]) for r in seen]).view(np.int64) | (bucket << 40)
        ids = np.concatenate([flat(r["f1"], np.int64) for r in seen])
        many = np.concatenate([np.frombuffer(r["f2"], bool) for r in seen])
        order = np.argsort(token, kind="stable")
        token, ids, many = token[order], ids[order], many[order]
        again = np.zeros(len(token), bool)
        again[1:] = token[1:] == token[:-1]
        again[:-1] |= again[1:].copy()
        take = again & ~many
        yield pa.RecordBatch.from_arrays([pa.array(token[take]), pa.array(ids[take])], names=["token", "id"])


def _full_sets(words: int):
    def run(batches):
        for batch in batches:
            data, offsets = raw(batch.column(1))
            for i, j in slices(offsets, TEXT_BYTES):
                found, size = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists(found.view(np.int64), size, pa.int64())], names=["id", "members"])

    return run


def _possible(rule: Rule, n, m, a, b):
    """Whether bit counts and sizes leave room for a link; two sets differ in at least as many elements as bits."""
    differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    most = np.minimum((n + m - differ) // 2, np.minimum(n, m))
    return (100 + rule.percent) * most >= rule.percent * (n + m)


def _earlier(column: pa.ChunkedArray) -> np.ndarray:
    """The tiles that rows name, -1 where they name fewer."""
    named = column.combine_chunks()
    out = np.full((len(named), EARLIER), -1, np.int64)
    out[np.arange(EARLIER) < named.value_lengths().to_numpy()[:, None]] = named.flatten().to_numpy()
    return out


def _met(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether two rows name an earlier tile both: their pair is that tile's work."""
    found = np.zeros(len(y), bool)
    for k in range(EARLIER):
        found |= ((x == y[:, k : k + 1]) & (x >= 0)).any(axis=1)
    return found


def _whole_keys(batches):
    """Tables of whole keys, from rows sorted by key, of about BLOCK_BYTES."""
    held, size = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            table = pa.concat_tables(held)
            key = table["key"].to_numpy()
            whole = int(np.searchsorted(key, key[-1]))
            if whole:
                yield table.slice(0, whole)
            held, size = [table.slice(whole)], 0
    if held:
        yield pa.concat_tables(held)


def _each_tile(t: pa.Table):
    """First and last row of each key."""
    key = t["key"].to_numpy()
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)).tolist()
    return zip([0, *ends[:-1]], ends)


def _tiles(rule: Rule):
    """Rows of tiles, sorted by key and size, that may link to a row with another label: at most as many as come in."""

    def possible(key, n, bits, label, own, alone, before):
        found = np.zeros(len(key), bool)
        live, d = np.arange(len(key)), 0
        while len(live):
            d += 1
            live = live[live + d < len(key)]
            # Sorted by size: once a partner is too large, those after it are as well.
            live = live[(key[live] == key[live + d]) & (100 * n[live] >= rule.percent * n[live + d])]
            i = live[(label[live] != label[live + d]) & (alone[live] | (own[live] != own[live + d])) & ~(found[live] & found[live + d])]
            if len(i):
                i = i[_possible(rule, n[i], n[i + d], bits[i], bits[i + d])]
                i = i[~_met(before[i], before[i + d])]
                found[i] = found[i + d] = True
        return found

    def run(batches):
        for t in _whole_keys(batches):
            bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(len(t), -1)
            key, n, label, own, alone = (t[x].to_numpy() for x in ("key", "n", "label", "own", "alone"))
            found = possible(key, n, bits, label, own, alone, _earlier(t["before"]))
            yield from _sent_on(t, found)

    return run


def _sent_on(t: pa.Table, found: np.ndarray):
    return t.select(["token", "id", "n", "label", "before"]).filter(pa.array(found)).combine_chunks().to_batches()


def _candidates(rule: Rule, t: pa.Table, bits: np.ndarray, root: np.ndarray):
    """Each row of one tile with later rows that may link to it and have another root when its turn comes."""
    n, own, alone, before = t["n"].to_numpy(), t["own"].to_numpy(), t["alone"].to_numpy(), _earlier(t["before"])
    last = np.searchsorted(n, 100 * n // rule.percent, "right")
    for i in range(len(n) - 1):
        j = np.arange(i + 1, last[i])
        j = j[(root[j] != root[i]) & (alone[i] | (own[j] != own[i]))]
        j = j[_possible(rule, n[i], n[j], bits[i], bits[j])]
        j = j[~_met(before[[i]], before[j])]
        if len(j):
            yield i, j.tolist()


def _wide_tiles(rule: Rule):
    """As `_tiles`, by the signatures of large sets as well."""

    def run(batches):
        for t in _whole_keys(batches):
            found = np.zeros(len(t), bool)
            bits = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(len(t), -1)
            for s, e in _each_tile(t):
                tile, here = t.slice(s, e - s), found[s:e]
                n, wide = tile["n"].to_numpy(), tile["wide"].to_pylist()
                for i, later in _candidates(rule, tile, bits[s:e], tile["label"].to_numpy()):
                    for k in later:
                        if not (here[i] and here[k]) and _room(rule, n[i], n[k], wide[i], wide[k]):
                            here[i] = here[k] = True
            yield from _sent_on(t, found)

    return run


def _forests(rule: Rule):
    """Links of whole sets that join the components of a tile: fewer than it has rows, whatever the number of its pairs."""

    def forest(tile):
        n, root = tile["n"].to_numpy(), tile["label"].to_numpy().copy()
        sets = [x.values.to_numpy().view(np.uint64) for x in tile["members"].combine_chunks()]
        bits = np.stack([_parities(x, BITS) for x in sets]).view(np.uint64)
        wide = [_wide(x) if len(x) > BITS else b"" for x in sets]
        for i, later in _candidates(rule, tile, bits, root):
            for k in later:
                if root[k] != root[i] and _room(rule, n[i], n[k], wide[i], wide[k]) and _links(rule, sets[i], sets[k]):
                    root[root == root[k]] = root[i]
                    yield i, k

    def run(batches):
        for t in _whole_keys(batches):
            pairs = [(s + i, s + k) for s, e in _each_tile(t) for i, k in forest(t.slice(s, e - s))]
            x, y = t["id"].to_numpy()[np.array(pairs, np.int64).reshape(-1, 2)].T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def _room(rule: Rule, n: int, m: int, u: bytes, v: bytes) -> bool:
    """Whether the signatures of two large sets leave room for a link; smaller sets have none."""
    return not (u and v) or bool(_possible(rule, n, m, *_folded(u, v))[0])


def _links(rule: Rule, s: np.ndarray, t: np.ndarray) -> bool:
    shared = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * shared >= rule.percent * (len(s) + len(t) - shared)


def _meet(rule: Rule):
    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            x, y = batch.column(2), batch.column(3)
            keep = []
            for k in range(len(a)):
                keep.append(_links(rule, x[k].values.to_numpy(), y[k].values.to_numpy()))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return run


def _parities(members: np.ndarray, bits: int) -> np.ndarray:
    """Signature of one set: parities of the elements that hash to each bit."""
    return np.packbits(np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1)


def _wide(members: np.ndarray) -> bytes:
    """Signature of a large set: a power of two of at least as many bits as it has elements."""
    return _parities(members, 1 << (len(members) - 1).bit_length()).tobytes()


def _folded(u: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two wide signatures at the shorter one's length: halves of parities add up to parities."""
    size = min(len(u), len(v))
    return tuple(np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, size // 8), axis=0)[None] for x in (u, v))


def _bounded(rule: Rule):
    """Pairs whose signatures leave room for a link; `same` where the marks say that the sets are equal."""

    def run(batches):
        for batch in batches:
            a, b, n, m, same = (batch.column(k) for k in range(5))
            if not len(a):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(len(a), -1) for k in (5, 6))
            room = _possible(rule, n.to_numpy(), m.to_numpy(), x, y)
            for k in np.flatnonzero(room).tolist():
                room[k] = _room(rule, n[k].as_py(), m[k].as_py(), batch.column(7)[k].as_py(), batch.column(8)[k].as_py())
            mask = pa.array(room)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask), same.filter(mask)], names=["a", "b", "same"])

    return run


def _sets(rule: Rule, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The whole sets of the documents named."""
    wanted = written(ids.distinct())
    texts = docs.join(small(wanted), "id", "left_semi").select("id", "text").dropDuplicates(["id"])
    return written(texts.mapInArrow(_full_sets(rule.words), "id long, members array<long>"))


def _linked(rule: Rule, docs: DataFrame, signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that do link: equal sets by their 128-bit marks, others by intersection of the whole sets."""
    one = signed.select(F.col("id").alias("a"), F.struct("n", "mark1", "mark2").alias("x"), F.col("bits").alias("bits1"), F.col("wide").alias("wide1"))
    two = signed.select(F.col("id").alias("b"), F.struct("n", "mark1", "mark2").alias("y"), F.col("bits").alias("bits2"), F.col("wide").alias("wide2"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.col("x.n").alias("n"), F.col("y.n").alias("m"), (F.col("x") == F.col("y")).alias("same"), "bits1", "bits2", "wide1", "wide2")
    known = written(both.mapInArrow(_bounded(rule), "a long, b long, same boolean"))
    unsure = known.filter("NOT same").select("a", "b")
    sets = _sets(rule, docs, unsure.select(F.explode(F.array("a", "b")).alias("id")))
    both = unsure.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    met = written(both.select("a", "b", "x", "y").mapInArrow(_meet(rule), "a long, b long"))
    return met.unionByName(known.filter("same").select("a", "b"))


def _labelled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, id, label): the tiles with the component that each set is in so far."""
    return written(shared.join(labels, "id", "left").select("token", "id", F.coalesce("root", "id").alias("label")))


def _second_heads(named: DataFrame) -> DataFrame:
    """Pairs of each set with the first set of its tile that is in another component than the tile's first one: as many as there are rows."""
    first = named.groupBy("token").agg(F.min(F.struct("id", "label")).alias("first"))
    mixed = named.join(first, "token").filter("label <> first.label")
    second = mixed.groupBy("token").agg(F.min(F.struct("id", "label")).alias("second"))
    pairs = named.join(second, "token").filter("label <> second.label")
    return pairs.select(F.least("id", "second.id").alias("a"), F.greatest("id", "second.id").alias("b")).distinct()


def _blocked(rows: DataFrame, blocks) -> DataFrame:
    """Rows of tiles cut in blocks, one key for every two blocks of a tile and for each alone."""
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return rows.withColumn("key", F.xxhash64("token", low, high)).withColumn("alone", low == high)


def _again(rows: DataFrame, bytes_each: float) -> DataFrame:
    """The rows sent on, once each, in blocks of so many rows and bytes for each element."""
    rows = rows.dropDuplicates(["token", "id"])
    size = rows.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("elements"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("elements") * bytes_each / BLOCK_BYTES))
    return _blocked(rows.join(size, "token"), blocks.cast("int"))


def _by_tile(rows: DataFrame, judge, schema: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartition(parts, "key").sortWithinPartitions("key", "n", "id").mapInArrow(judge, schema))


def _crossing(rule: Rule, docs: DataFrame, named: DataFrame, known: DataFrame) -> DataFrame:
    """Links that join the components of each tile.

    Every pair of a tile that is in two components is judged: by its sizes and
    signatures, by the wide signatures of large sets, by the whole sets.  The
    rows that may have a link are sent on to the next of these, as rows, not as
    pairs, and in the end only links that join two components come out.  Two
    sets that share several tiles are judged in the first; rows name the tiles
    just before the present one, and where those do not tell, the pair is
    judged again.
    """
    mixed = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("rows")).filter("low <> high")
    just_before = Window.partitionBy("id").orderBy("token").rowsBetween(-EARLIER, -1)
    rows = named.join(mixed.select("token", "rows"), "token").withColumn("before", F.collect_list("token").over(just_before))
    rows = _blocked(rows.join(known.select("id", "n", "bits"), "id"), F.ceil(F.col("rows") / BLOCK_ROWS).cast("int"))
    carried, sent = ["key", "token", "id", "n", "label", "own", "alone", "before"], "token long, id long, n long, label long, before array<long>"
    near = _by_tile(rows.select(*carried, "bits"), _tiles(rule), sent)
    rows = _again(near, 1 / 8).join(known.select("id", "bits", "wide"), "id")
    near = _by_tile(rows.select(*carried, "bits", "wide"), _wide_tiles(rule), sent)
    rows = _again(near, 8).join(_sets(rule, docs, near.select("id")), "id")
    return _by_tile(rows.select(*carried, "members"), _forests(rule), "a long, b long")


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links).

    Words are runs without ASCII white space, A-Z lower-cased.  A set enters
    the tiles of its size band and of the one below, one for each part of the
    set, so that sets that link share a tile.  A first round compares each set
    with the smallest id of its tiles.  Where more than one component is left in
    a tile, further rounds compare each set with the first one of a second
    component.  The last takes the tiles in which components still differ and
    compares all pairs across them inside the tile:
    sizes and bit counts of signatures bound the intersection from above, then
    whole sorted sets decide.  Only links that join two components leave a
    tile, so that no table grows with the pairs of a group, and no link between
    components is lost.

    Null or empty texts, and texts of white space, have n_shingles 0, link with
    nothing and are their own component.  Ids are integers, unique but for
    repeated rows; a null id gives a row with a null component.  Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(rows.mapInArrow(_signing(rule), "id long, n long, mark1 long, mark2 long, bits binary, wide binary, tokens array<long>"))
    known = signed.select("id", "n", "mark1", "mark2", "bits", "wide").filter("id IS NOT NULL AND n > 0").dropDuplicates(["id"])

    total = signed.agg(F.sum(F.size("tokens"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_TOKENS))
    tiles = signed.filter("id IS NOT NULL AND n > 0").select("id", "tokens").mapInArrow(_packing(4 * parts), PACKED)
    tiles = tiles.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")
    shared = written(tiles.mapInArrow(_sharing, "token long, id long"))

    heads = shared.groupBy("token").agg(F.min("id").alias("a"))
    near = written(shared.join(heads, "token").filter("a < id").select("a", F.col("id").alias("b")).distinct())
    links = _linked(rule, rows, known, near)
    for _ in range(ROUNDS):
        more = _second_heads(_labelled(shared, _roots(links))).join(near, ["a", "b"], "left_anti")
        more = written(more)
        links, near = written(links.unionByName(_linked(rule, rows, known, more))), near.unionByName(more)
    rest = _crossing(rule, rows, _labelled(shared, _roots(links)), known)
    roots = _roots(links.unionByName(rest))
    return signed.select("id", "n").join(roots, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id")
    )


def _roots(links: DataFrame) -> DataFrame:
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return connected_components(nodes, edges).select(F.col("node").alias("id"), "root")
