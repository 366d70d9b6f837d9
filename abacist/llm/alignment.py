"""Alignment of two tokenizers' tokens by diagonal run skipping, and corpus-wide counts of linked ids."""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.llm.common import raw, slices, written
from abacist.llm.recur import flat, planes

#: Bytes of text aligned at a time, and bytes of text (or distinct pairs) of which one block of documents consists.
SLICE_BYTES = 1 << 20
BLOCK_BYTES = 24 << 20
BLOCK_PAIRS = 1 << 21
#: Tokens after which a long text is cut, at the next common end, so that all lanes are about as long.
LANE = 256
#: First width of a probe.
PROBE = 4
#: Public pattern of byte-level BPE pre-tokenization; a fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


class ByteLevel:
    """Byte-level BPE from a tokenizers file: ids of texts, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, letters = told["model"], byte_letters()
        names = dict(model["vocab"])
        self.bytes = [b""] * (max([*names.values(), *(t["id"] for t in told.get("added_tokens", []))]) + 1)
        for name, k in names.items():
            self.bytes[k] = bytes(letters[c] for c in name)
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        cut = told.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not told.get("normalizer")
        self._path, self._slow, self._fast = path, None, None
        # Ids in the order of merges are ranks, which the faster library takes; it gives the same ids.
        if plain and [names[m] for m in merges] == list(range(256, 256 + len(merges))):
            import tiktoken

            ranks = {self.bytes[k]: k for k in names.values()}
            self._fast = tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def _library(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._path)
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        if self._fast is None:
            return self._library(text)
        try:
            return self._fast.encode_ordinary(text)
        except BaseException as failed:  # its pattern engine gives up on some endless runs
            if type(failed).__name__ != "PanicException":
                raise
            return self._library(text)


class Pieces:
    """A SentencePiece model: ids of texts, and the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self._model.get_piece_size()
        self.bytes = [
            bytes([int(self._model.id_to_piece(k)[1:-1], 16)]) if self._model.is_byte(k) else self._model.id_to_piece(k).replace("▁", " ").encode() for k in range(size)
        ]

    def encode(self, text: str) -> list[int]:
        return self._model.encode(text, num_threads=1)


class Table:
    """Bytes and decimal digits of a vocabulary's ids, as arrays."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        width = len(str(len(tokens)))
        k = np.arange(len(tokens))
        self.count = np.array([len(str(x)) for x in range(len(tokens))])
        self.digits = np.zeros((len(tokens), width + 1), np.uint8)
        self.used = np.arange(width + 1) <= self.count[:, None]
        for d in range(width):
            there = d < self.count
            self.digits[there, d] = 48 + k[there] // 10 ** (self.count[there] - 1 - d) % 10

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.data[np.repeat(self.start[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


@lru_cache(maxsize=2)
def _loaded(byte_path: str, piece_path: str):
    a, b = ByteLevel(byte_path), Pieces(piece_path)
    return a, b, Table(a.bytes), Table(b.bytes)


def seams(ends_a: np.ndarray, ends_b: np.ndarray, firsts: np.ndarray, lane: int = LANE) -> np.ndarray:
    """Tokens of A that start lanes: those of each text and, about every `lane` tokens, one after a common end."""
    at = np.arange(lane, len(ends_a), lane)
    found = []
    while len(at):
        other = np.searchsorted(ends_b, ends_a[at])
        common = ends_b[np.minimum(other, len(ends_b) - 1)] == ends_a[at]
        found.append(at[common] + 1)
        at = at[~common] + 1
    starts = np.unique(np.concatenate([firsts, *found])).astype(np.int64)
    return starts[starts < len(ends_a)]


def align(ends_a: np.ndarray, ends_b: np.ndarray, firsts: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of overlapping tokens: index in A, index in B, and whether a group ends there.

    Ends grow over all texts, which end alike in both.  Lanes run side by side.
    From a common end, a lane compares the two end arrays at its current shift
    in probes of doubling width and jumps over the one-to-one stretch so found;
    at the first difference it takes tokens from the side that ends first until
    the ends meet again, which gives the next shift.
    """
    if not len(ends_a):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(bool)
    i = seams(ends_a, ends_b, firsts, lane)
    stop = np.append(i[1:], len(ends_a))
    j = np.searchsorted(ends_b, np.where(i > 0, ends_a[i - 1], -1), "right")
    # A path's links have growing i + j, so their places need no sort.
    index = np.full(len(ends_a) + len(ends_b), -1, np.int64)
    ends = np.zeros(len(index), bool)
    while len(i):
        run = np.zeros(len(i), np.int64)
        going, width = np.arange(len(i)), PROBE
        while len(going):
            x = (i[going] + run[going])[:, None] + np.arange(width)
            y = (j[going] + run[going])[:, None] + np.arange(width)
            same = (ends_a[np.minimum(x, len(ends_a) - 1)] == ends_b[np.minimum(y, len(ends_b) - 1)]) & (x < stop[going][:, None])
            full = same.all(axis=1)
            run[going] += np.where(full, width, same.argmin(axis=1))
            going, width = going[full], width * 2
        inside = np.arange(int(run.sum())) - np.repeat(np.cumsum(run) - run, run)
        place = np.repeat(i + j, run) + 2 * inside
        index[place], ends[place] = np.repeat(i, run) + inside, True
        i, j = i + run, j + run
        left = i < stop
        i, j, stop = i[left], j[left], stop[left]
        open_ = np.arange(len(i))
        while len(open_):
            a, b = i[open_], j[open_]
            place, x, y = a + b, ends_a[a], ends_b[b]
            index[place], ends[place] = a, x == y
            i[open_] += x <= y
            j[open_] += y <= x
            open_ = open_[x != y]
        left = i < stop
        i, j, stop = i[left], j[left], stop[left]
    place = np.flatnonzero(index >= 0)
    return index[place], place - index[place], ends[place]


def _written_groups(table_a: Table, table_b: Table, ids_a, ids_b, last_a, last_b) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;...` of all groups as bytes, and where each group's text ends; last_a, last_b: last tokens of the groups."""
    before_b, before_a = np.concatenate([[0], last_b[:-1] + 1]), last_a + 1
    of_a = np.repeat(np.arange(len(last_a)), np.diff(np.concatenate([[-1], last_a])))
    of_b = np.repeat(np.arange(len(last_b)), np.diff(np.concatenate([[-1], last_b])))
    at_a, at_b = np.arange(len(ids_a)) + before_b[of_a], np.arange(len(ids_b)) + before_a[of_b]
    size = np.zeros(len(ids_a) + len(ids_b), np.int64)
    size[at_a], size[at_b] = table_a.count[ids_a] + 1, table_b.count[ids_b] + 1
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, ord(","), np.uint8)
    for table, ids, at in ((table_a, ids_a, at_a), (table_b, ids_b, at_b)):
        start, used = ends[at] - size[at], table.used[ids]
        used = used & (np.arange(used.shape[1]) < table.count[ids][:, None])
        out[(start[:, None] + np.arange(used.shape[1]))[used]] = table.digits[ids][used]
    out[ends[at_a[last_a]] - 1] = ord("|")
    out[ends[at_b[last_b]] - 1] = ord(";")
    return out, ends[at_b[last_b]]


def _flat_ids(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in rows], np.int64)
    return np.concatenate([np.array(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64), size


def _whole(table: Table, ids, size, data, ends):
    """Texts that their tokens spell byte by byte; data: all texts with a space before each."""
    length = np.diff(np.concatenate([[0], ends]))
    each = np.concatenate([[0], np.cumsum(table.size[ids])])
    upto = each[np.cumsum(size)] if len(size) else np.zeros(0, np.int64)
    fits = np.diff(np.concatenate([[0], upto])) == length
    spelled, good = table.spell(ids), fits.copy()
    if fits.all():
        good[np.searchsorted(ends, np.flatnonzero(spelled != data), "right")] = False
    else:
        for k in np.flatnonzero(fits).tolist():
            good[k] = np.array_equal(spelled[upto[k] - length[k] : upto[k]], data[ends[k] - length[k] : ends[k]])
    return good


_DOCS = ["ids", "n_a", "n_b", "n_groups", "n_links", "shas", "sizes"]
_PACKED = (
    "block long, kind int, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, shas array<string>, sizes array<long>, "
    "codes binary, places binary, times binary, code long, total long, best boolean"
)
_SCHEMA = pa.schema(
    [("block", pa.int64()), ("kind", pa.int32()), *[(n, pa.list_(pa.string() if n == "shas" else pa.int64())) for n in _DOCS],
     *[(n, pa.binary()) for n in ("codes", "places", "times")], ("code", pa.int64()), ("total", pa.int64()), ("best", pa.bool_())]
)


def _row(block: int, kind: int, **cells) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([{"block": block, "kind": kind, **cells}.get(f.name)], f.type) for f in _SCHEMA], schema=_SCHEMA)


def _squeezed(values: np.ndarray, kind) -> bytes:
    body = planes(values.astype(kind)) if len(values) else b""
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True) if body else b""


def _loosened(body: bytes, kind) -> np.ndarray:
    if not body:
        return np.zeros(0, np.int64)
    return flat(pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True), kind).astype(np.int64)


def _aligned_slice(model_a, model_b, table_a: Table, table_b: Table, texts: list):
    """Results of some texts, and the distinct pairs of each with their counts."""
    n = len(texts)
    spoken = [k for k, t in enumerate(texts) if t]
    ids_a, size_a = _flat_ids([model_a.encode(" " + texts[k]) for k in spoken])
    ids_b, size_b = _flat_ids([model_b.encode(texts[k]) for k in spoken])
    told = [b" " + texts[k].encode() for k in spoken]
    data, ends = np.frombuffer(b"".join(told), np.uint8), np.cumsum([len(t) for t in told], dtype=np.int64)
    good = _whole(table_a, ids_a, size_a, data, ends) & _whole(table_b, ids_b, size_b, data, ends) if spoken else np.zeros(0, bool)
    ids_a, ids_b = ids_a[np.repeat(good, size_a)], ids_b[np.repeat(good, size_b)]
    doc, size_a, size_b = np.array(spoken, np.int64)[good], size_a[good], size_b[good]
    first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    i, j, end = align(np.cumsum(table_a.size[ids_a]), np.cumsum(table_b.size[ids_b]), first_a)
    own = np.repeat(doc, size_a)[i]
    out = {name: np.zeros(n, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links", "sizes")}
    out["n_a"][doc], out["n_b"][doc] = size_a, size_b
    out["n_links"], out["n_groups"] = np.bincount(own, minlength=n), np.bincount(own[end], minlength=n)
    spelled, stops = _written_groups(table_a, table_b, ids_a, ids_b, i[end], j[end])
    stops = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(out["n_groups"])])]
    body = spelled.tobytes()
    shas = [hashlib.sha256(body[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
    codes, place = np.unique(ids_b[j] * len(table_a.size) + ids_a[i], return_inverse=True)
    named, times = np.unique(own * len(codes) + place, return_counts=True)
    owner, place = named // max(len(codes), 1), named % max(len(codes), 1)
    out["sizes"] = np.bincount(owner, minlength=n)
    return {**out, "shas": shas}, codes, np.bincount(place, weights=times, minlength=len(codes)).astype(np.int64), place, times


def _aligning(byte_path: str, piece_path: str):
    """Documents in packed slices, then the distinct pairs of every block of slices."""

    def run(batches):
        from pyspark import TaskContext

        model_a, model_b, table_a, table_b = _loaded(byte_path, piece_path)
        block, size = TaskContext.get().partitionId() << 24, 0
        known, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            _, offsets = raw(batch.column(1))
            for x, y in slices(offsets, SLICE_BYTES):
                told, codes, total, place, times = _aligned_slice(model_a, model_b, table_a, table_b, batch.column(1).slice(x, y - x).to_pylist())
                told = {k: v if k == "shas" else v.tolist() for k, v in told.items()}
                first = np.zeros(len(place), bool)
                heads = np.cumsum(told["sizes"]) - told["sizes"]
                first[heads[np.array(told["sizes"]) > 0]] = True
                step = np.diff(place, prepend=0)
                step[first] = place[first]
                yield _row(block, 1, ids=batch.column(0).slice(x, y - x).to_pylist(), **told, codes=_squeezed(np.diff(codes, prepend=0), np.uint64),
                           places=_squeezed(step, np.uint32), times=_squeezed(times, np.uint32))
                merged, at = np.unique(np.concatenate([known, codes]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([counts, total]), minlength=len(merged)).astype(np.int64)
                known, size = merged, size + int(offsets[y] - offsets[x])
                if size >= BLOCK_BYTES or len(known) >= BLOCK_PAIRS:
                    yield _row(block, 0, codes=_squeezed(known, np.uint64), times=_squeezed(counts, np.uint64))
                    block, size, known, counts = block + 1, 0, known[:0], counts[:0]
        if len(known):
            yield _row(block, 0, codes=_squeezed(known, np.uint64), times=_squeezed(counts, np.uint64))

    return run


def _pairs(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            codes, times = (_loosened(batch.column(c)[k].as_py(), np.uint64) for c in (1, 2))
            for s in range(0, len(codes), 1 << 16):
                part = codes[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), batch.column(0)[k].as_py())), pa.array(part), pa.array(times[s : s + (1 << 16)])], names=["block", "code", "times"])


def _counted(id_col: str):
    """Documents of a block meet the corpus-wide counts of its pairs, which come first."""

    def run(batches):
        at, seen, codes, total, best = None, [], None, None, None
        for batch in batches:
            kind = batch.column(1).to_numpy()
            block = batch.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1, [len(kind)]]) if len(kind) else [0]
            for x, y in zip(edges[:-1], edges[1:]):
                if block[x] != at:
                    at, seen, codes = block[x], [], None
                if kind[x] == 0:
                    seen.append([batch.column(c).slice(x, y - x).to_numpy(zero_copy_only=False) for c in (12, 13, 14)])
                    continue
                if codes is None:
                    codes, total, best = (np.concatenate(z) for z in zip(*seen)) if seen else (np.zeros(0, np.int64),) * 3
                    order, seen = np.argsort(codes), []
                    codes, total, best = codes[order], total[order].astype(np.int64), best[order].astype(np.int64)
                for k in range(x, y):
                    r = {n: batch.column(2 + c)[k].values for c, n in enumerate(_DOCS)}
                    own = np.cumsum(_loosened(batch.column(9)[k].as_py(), np.uint64))
                    step, times = (_loosened(batch.column(c)[k].as_py(), np.uint32) for c in (10, 11))
                    sizes = r["sizes"].to_numpy()
                    ends = np.cumsum(sizes)
                    run_ = np.cumsum(step)
                    heads = (ends - sizes)[sizes > 0]
                    place = run_ - np.repeat(run_[heads] - step[heads], sizes[sizes > 0])
                    found = np.searchsorted(codes, own)
                    sums = [np.concatenate([[0], np.cumsum(times * v[found][place])]) for v in (best, total)]
                    per = [pa.array(s[ends] - s[ends - sizes]) for s in sums]
                    yield pa.RecordBatch.from_arrays(
                        [r["ids"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], *per, r["shas"]],
                        names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                    )

    return run


def pair_counts(packed: DataFrame, ids_a: int) -> DataFrame:
    """Corpus-wide: code (id of B * ids_a + id of A), total, best (no pair of this B id has a higher total)."""
    blocks = packed.filter("kind = 0").select("block", "codes", "times").mapInArrow(_pairs, "block long, code long, times long")
    totals = written(blocks.groupBy("code").agg(F.sum("times").alias("total")))
    other = F.expr(f"code div {ids_a}")
    highest = totals.groupBy(other.alias("b")).agg(F.max("total").alias("highest"))
    return totals.withColumn("b", other).join(highest, "b").select("code", "total", (F.col("total") == F.col("highest")).alias("best"))


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: how the tokens of a byte-level BPE (A, of space + text) and of a SentencePiece model (B) lie over each other.

    Where tokens of both end, a group ends; tokens of both whose bytes overlap
    are linked.  Returns id, n_a, n_b, n_groups, n_links, n_best (links whose
    pair of ids is linked as often, in all documents, as any pair of its B
    id), count_sum (sum over links of how often their pair is linked) and
    groups_sha256 (of `a1,a2|b1;a3|b2`).

    A task aligns documents in slices and keeps the distinct pairs of a block
    of documents; only those meet in the count and come back to their block.
    Null and empty texts, and texts that the tokens of A or B do not spell byte
    by byte, have no tokens: zeros and ''.  Rows are judged one by one, so
    repeated and null ids are kept; other columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packed = written(rows.mapInArrow(_aligning(byte_path, piece_path), _PACKED))
    ids_a = len(_loaded(byte_path, piece_path)[2].size)
    counts = pair_counts(packed, ids_a)
    blocks = packed.filter("kind = 0").select("block", "codes", "times").mapInArrow(_pairs, "block long, code long, times long")
    back = blocks.join(counts, "code").select("block", F.lit(0).alias("kind"), *[F.lit(None).cast(packed.schema[n].dataType).alias(n) for n in packed.columns[2:12]], "code", "total", "best")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), packed.filter("kind = 0").count())
    met = packed.filter("kind = 1").unionByName(back).repartition(parts, "block").sortWithinPartitions("block", "kind")
    return met.mapInArrow(_counted(id_col), f"{id_col} long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
