"""SentencePiece encoding and decoding by a batched Viterbi search over sorted piece keys."""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abacist.llm.common import lists, mix, slices, spare, with_text

BLANK = 0x2581
#: Longer words are merged one by one, or searched in steps.
LONGEST = 256
#: Bits of the table of letter pairs that stand side by side in some piece.
PAIR_BITS = 22
SLICE_CHARS = 1 << 20
SLICE_IDS = 1 << 18
#: Words and pairs of pieces that a task remembers.
KNOWN_WORDS = 600_000
KNOWN_PAIRS = 1 << 20
NEVER = 1 << 60
_BASE = 0xD1342543DE82EF95
_UP = np.array([pow(_BASE, i, 1 << 64) for i in range(LONGEST + 2)], np.uint64)
_DOWN = np.array([pow(pow(_BASE, -1, 1 << 64), i, 1 << 64) for i in range(LONGEST + 2)], np.uint64)


def _values(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _sums(points: np.ndarray) -> np.ndarray:
    """Sums of letter values before each position; one row per word."""
    out = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    np.cumsum(_values(points) * _UP[: points.shape[1]], axis=1, out=out[:, 1:])
    return out


def _key(sums: np.ndarray, i: int, j: int) -> np.ndarray:
    return mix((sums[:, j] - sums[:, i]) * _DOWN[i] + np.uint64(j - i))


@dataclass
class Pieces:
    """A vocabulary: `text[i]` of every piece; `rank` for merging order or `score` for a sum of scores.

    In a merging vocabulary (BPE) the pieces of a word are those left when the
    best adjacent pair has been merged again and again.  A row of pieces is
    that result exactly if every two neighbours are the result for their joint
    text.  So one search from left to right finds it: of the pieces that end
    at a position and agree with the last piece before them there is just one.
    """

    text: list[str]
    merging: bool
    score: np.ndarray
    usable: np.ndarray
    byte_ids: list[int]
    unknown: int
    dummy_blank: bool = True
    keys: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        singles = {t for t, u in zip(self.text, self.usable) if u and len(t) == 1}
        letters = {c for t, u in zip(self.text, self.usable) if u for c in t}
        self.extra = sorted(letters - singles)  # letters that stand in pieces only; written as bytes
        names = [t if u else None for t, u in zip(self.text, self.usable)] + self.extra
        self.size = len(names)
        self.by_name = {t: i for i, t in enumerate(names) if t is not None}
        self.longest = max(map(len, self.by_name), default=1)
        ids, keys = [], []
        by_length: dict[int, list[str]] = {}
        for t in self.by_name:
            by_length.setdefault(len(t), []).append(t)
        for n, group in by_length.items():
            points = np.array([[ord(c) for c in t] for t in group], np.uint32)
            keys.append(_key(_sums(points), 0, n))
            ids.extend(self.by_name[t] for t in group)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(ids, np.int64)[order]
        pairs = np.array([(ord(a), ord(b)) for t in self.by_name for a, b in zip(t, t[1:])], np.uint32).reshape(-1, 2)
        self.joined = np.zeros(1 << PAIR_BITS, bool)
        self.joined[self._pair_slot(pairs[:, 0], pairs[:, 1])] = True
        full = np.concatenate([self.score, np.full(len(self.extra), -np.inf)])
        self.costs = full
        if self.merging:
            self._merges(names, full)

    @staticmethod
    def _pair_slot(a, b):
        return ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))) >> np.uint32(32 - PAIR_BITS)

    def breaks(self, points: np.ndarray) -> np.ndarray:
        """Whether no piece joins a letter with the one before it, so that a word may start there."""
        out = np.ones(len(points), bool)
        out[1:] = ~self.joined[self._pair_slot(points[:-1], points[1:])]
        return out

    def _merges(self, names, score):
        # Equal scores share a rank; the leftmost of them merges first.
        ranks = {s: i for i, s in enumerate(sorted(set(score.tolist()), reverse=True))}
        self.rank = np.array([ranks[s] for s in score.tolist()] + [NEVER], np.int64)
        left, right = np.full(self.size + 1, -1, np.int64), np.full(self.size + 1, -1, np.int64)
        self.proper = np.zeros(self.size + 1, bool)
        self.proper[self.size] = True
        first, second, merged = [], [], []
        for t, i in self.by_name.items():
            parts, last = self._merge([self.by_name[c] for c in t], list(t))
            if len(parts) == 1:
                self.proper[i] = True
                if last:
                    left[i], right[i] = last
            for k in range(1, len(t)):
                a, b = self.by_name.get(t[:k]), self.by_name.get(t[k:])
                if a is not None and b is not None:
                    first.append(a), second.append(b), merged.append(i)
        self.left, self.right = left, right
        pair = np.array(first, np.int64) * (self.size + 1) + np.array(second, np.int64)
        order = np.argsort(pair)
        self.pair_keys, self.pair_ids = pair[order], np.array(merged, np.int64)[order]

    def _merge(self, ids: list[int], texts: list[str]):
        """Merge one word pair by pair; unknown letters have the id `size`."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live, last = [True] * n, None
        heap: list[tuple] = []

        def offer(a, b):
            i = self.by_name.get(texts[a] + texts[b]) if b < n else None
            if i is not None:
                heapq.heappush(heap, (self.rank[i], a, b, len(texts[a]), len(texts[b]), i))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, la, lb, i = heapq.heappop(heap)
            if not (live[a] and b < n and live[b] and after[a] == b and len(texts[a]) == la and len(texts[b]) == lb):
                continue
            last = (ids[a], ids[b])
            ids[a], texts[a], live[b], after[a] = i, texts[a] + texts[b], False, after[b]
            if after[b] < n:
                before[after[b]] = a
            if before[a] >= 0:
                offer(before[a], a)
            offer(a, after[a])
        return [i for i, on in zip(ids, live) if on], last

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joint text of two pieces gives just these two.

        Looks along the right edge of one piece's merges and the left edge of
        the other's for a merge across the border that would come first.
        """
        ok = self.proper[a] & self.proper[b]
        x, x_gone = a.copy(), np.full(len(a), NEVER, np.int64)
        while True:
            have_x = ok & (x >= 0)
            if not have_x.any():
                return ok
            y, y_gone = b.copy(), np.full(len(b), NEVER, np.int64)
            while True:
                at = np.flatnonzero(have_x & ok & (y >= 0))
                if not len(at):
                    break
                key = x[at] * (self.size + 1) + y[at]
                k = np.minimum(np.searchsorted(self.pair_keys, key), max(0, len(self.pair_keys) - 1))
                hit = self.pair_keys[k] == key if len(self.pair_keys) else np.zeros(len(at), bool)
                m = self.rank[self.pair_ids[k]] if len(self.pair_keys) else np.zeros(len(at), np.int64)
                born_x, born_y = self._born(x[at]), self._born(y[at])
                crossing = hit & (m < x_gone[at]) & (m <= y_gone[at]) & (born_y < x_gone[at]) & (born_x < y_gone[at])
                ok[at[crossing]] = False
                y_gone[at] = self.rank[y[at]]
                y[at] = self.left[y[at]]
            on = x >= 0
            x_gone[on] = self.rank[x[on]]
            x[on] = self.right[x[on]]

    def _born(self, x):
        return np.where(self.left[x] >= 0, self.rank[x], -1)

    def letter_ids(self, letters: np.ndarray) -> np.ndarray:
        """Ids for letters without a piece: the byte below 128, else the size plus the letter."""
        if not self.byte_ids:
            return np.full(len(letters), self.unknown)
        low = np.array(self.byte_ids[:128], np.int64)
        return np.where(letters < 128, low[np.minimum(letters, 127)], self.size + letters)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_ids[at], -1)


class Encoder:
    """Encodes batches of text in one task and remembers words that it has met."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.pair_key = np.full(KNOWN_PAIRS, -1, np.int64)
        self.pair_ok = np.zeros(KNOWN_PAIRS, bool)
        self.forget()

    def forget(self):
        self.known, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int32)

    def _agree(self, a, b):
        key = a * (self.p.size + 1) + b
        slot = (mix(key.astype(np.uint64)) & np.uint64(KNOWN_PAIRS - 1)).astype(np.int64)
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            ok = self.p.agree(fresh // (self.p.size + 1), fresh % (self.p.size + 1))
            out = self.pair_ok[slot]
            out[new] = ok[back]
            self.pair_key[slot[new]], self.pair_ok[slot[new]] = key[new], ok[back]
            # Two new pairs may meet in one slot: the last one stays, so answers come from `out`.
            self.pair_ok[slot[new]] = ok[np.searchsorted(fresh, self.pair_key[slot[new]])]
            return out
        return self.pair_ok[slot]

    def search(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of one length, which advance together; flat ids and the count of each word."""
        p, (n, length) = self.p, points.shape
        sums = _sums(points)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        last, back = np.full((n, length + 1), -1, np.int64), np.zeros((n, length + 1), np.int64)
        lowest = (p.costs[np.isfinite(p.costs)].min() if len(p.costs) else 0) - 10
        for j in range(1, length + 1):
            for k in range(1, min(j, p.longest) + 1):
                i = j - k
                found = p.find(_key(sums, i, j))
                if k == 1:
                    found = np.where(found < 0, p.size, found)
                at = np.flatnonzero(found >= 0)
                if not len(at):
                    continue
                ids = found[at]
                if p.merging:
                    fits = p.proper[ids] if i == 0 else self._agree(last[at, i], ids)
                    value = np.where(fits, 0.0, -np.inf)
                else:
                    value = best[at, i] + np.where(ids < p.size, np.append(p.costs, lowest)[ids], lowest)
                better = value > best[at, j]
                at, ids = at[better], ids[better]
                best[at, j], last[at, j], back[at, j] = value[better], ids, k
        at, count = np.full(n, length), np.zeros(n, np.int64)
        steps = []
        rows = np.arange(n)
        while len(rows):
            ids = last[rows, at[rows]]
            strange = ids >= len(p.text)
            if strange.any():
                # A letter without a piece becomes its byte, or stands as a number for the letter.
                letter = points[rows[strange], at[rows[strange]] - 1].astype(np.int64)
                ids[strange] = p.letter_ids(letter)
            steps.append((rows, ids))
            at[rows] -= back[rows, at[rows]]
            count[rows] += 1
            rows = rows[at[rows] > 0]
        ends = np.cumsum(count)
        flat = np.zeros(int(ends[-1]) if n else 0, np.int64)
        for back_by, (rows, ids) in enumerate(steps):
            flat[ends[rows] - 1 - back_by] = ids
        return flat, count

    def _one(self, points: np.ndarray) -> np.ndarray:
        """A long word, or one whose blanks tie with each other, merged pair by pair."""
        text = [chr(c) for c in points.tolist()]
        merged = self.p._merge([self.p.by_name.get(c, self.p.size) for c in text], text)[0]
        ids = np.array(merged, np.int64)
        # A letter without a piece is never merged: its place follows from the widths before it.
        width = np.array([1 if i >= len(self.p.text) else len(self.p.text[i]) for i in merged])
        strange = ids >= len(self.p.text)
        ids[strange] = self.p.letter_ids(points[(np.cumsum(width) - width)[strange]].astype(np.int64))
        return ids

    def _odd(self, points: np.ndarray) -> np.ndarray:
        if self.p.merging:
            return self._one(points)
        # A vocabulary with scores and no place to cut: the search goes on in steps of LONGEST letters.
        return np.concatenate([self.search(points[None, s : s + LONGEST])[0] for s in range(0, len(points), LONGEST)])

    def _learn(self, points, starts, ends, names):
        lengths = ends - starts
        twice = (points[starts] == BLANK) & (lengths > 1) & (points[np.minimum(starts + 1, len(points) - 1)] == BLANK)
        odd = (lengths > LONGEST) | (twice & self.p.merging)
        out, sizes, order = [], [], []
        for n in np.unique(lengths[~odd]):
            rows = np.flatnonzero(~odd & (lengths == n))
            ids, count = self.search(points[starts[rows][:, None] + np.arange(n)])
            out.append(ids), sizes.append(count), order.append(rows)
        for r in np.flatnonzero(odd):
            ids = self._odd(points[starts[r] : ends[r]])
            out.append(ids), sizes.append(np.array([len(ids)])), order.append(np.array([r]))
        ids, sizes, rows = self._bytes(np.concatenate(out), np.concatenate(sizes)) + (np.concatenate(order),)
        begin = len(self.tokens) + np.cumsum(sizes) - sizes
        self.tokens = np.concatenate([self.tokens, ids.astype(np.int32)])
        new = np.argsort(names[rows])
        known = np.concatenate([self.known, names[rows][new]])
        s = np.argsort(known, kind="stable")
        self.known = known[s]
        self.start = np.concatenate([self.start, begin[new]])[s]
        self.count = np.concatenate([self.count, sizes[new]])[s]

    def _bytes(self, ids, sizes):
        """Letters from 128 that have no piece, as the bytes of their UTF-8."""
        strange = np.flatnonzero(ids >= self.p.size)
        if not len(strange):
            return ids, sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)[strange]
        parts = [[self.p.byte_ids[b] for b in chr(i - self.p.size).encode()] for i in ids[strange].tolist()]
        wide = np.ones(len(ids), np.int64)
        wide[strange] = [len(x) for x in parts]
        full = np.repeat(ids, wide)
        at = np.cumsum(wide) - wide
        for k, x in zip(strange.tolist(), parts):
            full[at[k] : at[k] + len(x)] = x
        sizes = sizes.copy()
        np.add.at(sizes, owner, wide[strange] - 1)
        return full, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the count of each."""
        blank = chr(BLANK)
        full = [(blank + t if self.p.dummy_blank else t) if t else "" for t in texts]
        points = np.frombuffer("".join(full).encode("utf-32-le"), np.uint32).copy()
        points[points == 0x20] = BLANK
        lengths = np.array([len(t) for t in full], np.int64)
        ends_of_text = np.cumsum(lengths)
        head = self.p.breaks(points)
        first = (ends_of_text - lengths)[lengths > 0]
        head[first] = True
        starts = np.flatnonzero(head)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        ends = np.append(starts[1:], len(points))
        names = self._names(points, starts, ends)
        new, at = np.unique(names, return_index=True)
        at = at[~np.isin(new, self.known, assume_unique=True)]
        if len(at):
            if len(self.known) > KNOWN_WORDS:
                self.forget()
                at = np.unique(names, return_index=True)[1]
            self._learn(points, starts[at], ends[at], names[at])
        k = np.searchsorted(self.known, names)
        begin, count = self.start[k], self.count[k]
        upto = np.cumsum(count)
        flat = self.tokens[np.repeat(begin - (upto - count), count) + np.arange(upto[-1])]
        per_word = np.concatenate([[0], upto])
        edges = np.searchsorted(starts, np.concatenate([[0], ends_of_text]))
        return flat, np.diff(per_word[edges])

    @staticmethod
    def _names(points, starts, ends):
        """128 bits would be more than enough; 64 bits name the words of one task."""
        value = _values(points)
        length = ends - starts
        inside = np.arange(len(points)) - np.repeat(starts, length)
        # Far letters of a long word use the powers again, with another value.
        far = inside // LONGEST
        if far.any():
            value = mix(value + far.astype(np.uint64))
        return mix(np.add.reduceat(value * _UP[inside % LONGEST], starts) + length.astype(np.uint64))


def load(model_file: str) -> Pieces:
    """A vocabulary from a SentencePiece model file, read on the driver."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(model_file, "rb") as f:
        model.ParseFromString(f.read())
    spec, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
    if spec.name not in ("identity", "") or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("only vocabularies for text as it is are supported")
    if model.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and merging vocabularies are supported")
    text = [p.piece for p in model.pieces]
    usable = np.array([p.type == kinds.NORMAL for p in model.pieces])
    of_byte = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
    byte_ids = [of_byte[f"<0x{b:02X}>"] for b in range(256)] if of_byte else []
    return Pieces(text, model.trainer_spec.model_type == 2, np.array([p.score for p in model.pieces], float), usable, byte_ids, next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN), spec.add_dummy_prefix)


def encode(docs: DataFrame, pieces: Pieces, text_col: str = "text", out: str = "token_ids", digest: str = "ids_sha256") -> DataFrame:
    """`docs` with the piece ids of the whole text and their digest added, or replaced.

    The digest is the SHA-256, in hex, of the ids as little-endian 32-bit numbers.

    Null text gives nulls, empty text an empty list.  Words are the stretches
    between places that no piece spans; equal words are encoded once per task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    kept = [c for c in docs.columns if c.lower() not in (out.lower(), digest.lower())]
    schema = docs.select(*[f"`{c}`" for c in kept]).schema.add(out, T.ArrayType(T.IntegerType())).add(digest, "string")
    rows, place = with_text(docs, kept, text_col)

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            column = batch.column(place)
            at = 0
            while at < len(column):
                texts, chars = [], 0
                while at + len(texts) < len(column) and (not texts or chars < SLICE_CHARS):
                    texts.append(column[at + len(texts)].as_py())
                    chars += len(texts[-1] or "")
                flat, counts = encoder.encode([t or "" for t in texts])
                ids = lists(flat, counts, pa.int32())
                ends = np.cumsum(counts)
                shas = [None if t is None else hashlib.sha256(flat[e - c : e].astype("<i4").tobytes()).hexdigest() for t, e, c in zip(texts, ends, counts)]
                if None in texts:
                    ids = pa.array([None if t is None else x for t, x in zip(texts, ids.to_pylist())], ids.type)
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], ids, pa.array(shas, pa.string())], names=[*kept, out, digest])
                at += len(texts)

    return rows.mapInArrow(run, schema)


def decode(docs: DataFrame, pieces: Pieces, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """`docs` with the text of the piece ids added, or replaced if `out` exists.

    Null ids give null.  Ids outside the vocabulary fail.  U+2581 in a text
    comes back as a blank, as the format has it; bytes that are not UTF-8
    become U+FFFD.
    """
    names = []
    for i, t in enumerate(pieces.text):
        names.append(t.replace(chr(BLANK), " ").encode() if pieces.usable[i] else b"")
    for b, i in enumerate(pieces.byte_ids):
        names[i] = bytes([b])
    names[pieces.unknown] = " ⁇ ".encode()
    shared = docs.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(names), np.uint8), np.cumsum([0, *map(len, names)])))
    dummy = pieces.dummy_blank
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    schema = docs.select(*[f"`{c}`" for c in kept]).schema.add(out, "string")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids_col}`").alias(spare(docs, "_ids_")))

    def run(batches):
        data, offsets = shared.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            counts = np.asarray(column.value_lengths().fill_null(0), np.int64)
            for i, j in slices(np.concatenate([[0], np.cumsum(counts)]), SLICE_IDS):
                texts = _texts(column.slice(i, j - i), data, offsets, dummy)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:-1], pa.array(texts, pa.string())], names=[*kept, out])

    return rows.mapInArrow(run, schema)


def _texts(column, data, offsets, dummy):
    flat = np.asarray(column.flatten(), np.int64)
    counts = np.asarray(column.value_lengths().fill_null(0), np.int64)
    size = offsets[flat + 1] - offsets[flat]
    upto = np.concatenate([[0], np.cumsum(size)])
    joined = data[np.repeat(offsets[flat] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
    at = upto[np.concatenate([[0], np.cumsum(counts)])]
    texts = [joined[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
    return [None if null else t[1:] if dummy and t[:1] == " " else t for t, null in zip(texts, column.is_null().to_pylist())]
