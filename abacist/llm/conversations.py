"""Conversation structure repair: least-cost edits by dynamic programming, ties settled by prefix-doubling ranks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from abacist.llm.common import written

#: Bytes of conversation text that one sorted partition stands for.
PART_BYTES = 64 << 20
#: Bytes of repaired text in one row on its way to the digest of a conversation that spans partitions.
STREAM_BYTES = 1 << 20
#: Characters of a text that order rows tied on turn and role before the digest of the whole text does.
TIE_CHARS = 64

# States of the role pattern (s?(ua)+)?: nothing yet, after s, after u, after a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": 0, "u": 1, "a": 2}
#: The state after the one role that may be put in, or given to a row, in each state.
TURNS = np.array([USER, USER, ASSISTANT, USER])
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state after keeping a row with role initial s, u, a or another; -1 where the pattern forbids it.
KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Costs of a finished conversation by state: S lacks two rows, U one.
FINISHED = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
FAR = np.int64(1) << 40
LETTERS = np.frombuffer(b"DIKR", np.uint8)
SPACES = " \t\n\x0b\x0c\r"


def _layers(offsets: np.ndarray) -> np.ndarray:
    """First layer of each conversation: n rows have n + 1 layers of four states."""
    return offsets[:-1] + np.arange(len(offsets) - 1)


def costs(role, must, cut, offsets, end) -> np.ndarray:
    """Least cost from every (layer, state) to the end, whose states cost `end` (conversations x 4).

    role: 0 to 3 for s, u, a, other; must: only deletion is allowed; cut: staying costs more.
    Conversations advance together, from their last rows to their first.
    """
    n, base = np.diff(offsets), _layers(offsets)
    cost = np.zeros((int(offsets[-1]) + len(n), 4), np.int64)
    cost[base + n] = end
    order = np.argsort(-n, kind="stable")
    size = n[order]
    for t in range(1, int(n.max(initial=0)) + 1):
        c = order[: int(np.searchsorted(-size, -t, "right"))]
        row, layer = offsets[c] + n[c] - t, base[c] + n[c] - t
        here = np.minimum.reduce([x for x, _ in _steps(role[row], must[row], cut[row], cost[layer + 1])])
        once = here[:, TURNS] + INSERT
        cost[layer] = np.minimum(np.minimum(here, once), once[:, TURNS] + INSERT)
    return cost


def _steps(role, must, cut, ahead):
    """(cost, state) of deleting, keeping and re-roling a row in each state, given the costs of the next layer."""
    stay = np.where(must, FAR, np.where(cut, TRUNCATED, 0))[:, None]
    to = KEPT[role]
    keep = np.where(to >= 0, np.take_along_axis(ahead, np.maximum(to, 0), axis=1) + stay, FAR)
    return [
        (ahead + DELETE, np.broadcast_to(np.arange(4), ahead.shape)),
        (keep, to),
        (ahead[:, TURNS] + stay + REROLE, np.broadcast_to(TURNS, ahead.shape)),
    ]


def optimal_arcs(role, must, cut, offsets, cost, last) -> tuple[np.ndarray, np.ndarray]:
    """Arcs of least cost out of every node (layer * 4 + state), by letter D, I, K, R: whether they are there, and their targets.

    last: conversations that end here; the others stop at their last layer, whatever the state.
    A letter leaves a node by one arc only.
    """
    n, base = np.diff(offsets), _layers(offsets)
    layers = len(cost)
    there, to = np.zeros((layers, 4, 4), bool), np.zeros((layers, 4, 4), np.int64)
    inner = np.ones(layers, bool)
    inner[base + n] = False
    at = np.flatnonzero(inner)
    row = at - np.repeat(np.arange(len(n)), n)
    for letter, (value, state) in zip((0, 2, 3), _steps(role[row], must[row], cut[row], cost[at + 1])):
        there[at, :, letter] = value == cost[at]
        to[at, :, letter] = (at[:, None] + 1) * 4 + state
    grown = np.append(at, (base + n)[last])
    there[grown, :, 1] = cost[grown][:, TURNS] + INSERT == cost[grown]
    to[grown, :, 1] = grown[:, None] * 4 + TURNS
    return there.reshape(-1, 4), to.reshape(-1, 4)


def least_paths(there: np.ndarray, to: np.ndarray, start: np.ndarray):
    """The ASCII-least audit from each start: letters, nodes they leave, lengths, and the nodes where they end.

    Nodes are ranked by their least audits of 1, 2, 4, ... letters: the first
    half's rank, then the rank of the node that the doubled pointer leads to.
    Ranks of whole audits then choose the arc of every node, and doubled
    pointers read off the path at any place.
    """
    nodes = np.arange(len(there))
    end = ~there.any(axis=1)
    arc = np.where(end, 0, there.argmax(axis=1))
    pointer = np.where(end, nodes, to[nodes, arc])
    rank = np.where(end, 0, arc + 1)
    reach = pointer
    while True:
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[reach], return_inverse=True)[1]
        if end[reach[start]].all():
            break
        reach = reach[reach]
    best = np.where(there, np.arange(4) * np.int64(len(nodes) + 1) + rank[to], np.iinfo(np.int64).max).argmin(axis=1)
    doubled = [np.where(end, nodes, to[nodes, best])]
    while not end[doubled[-1][start]].all():
        doubled.append(doubled[-1][doubled[-1]])
    node, length = start.copy(), np.where(end[start], 0, 1)
    for k in range(len(doubled) - 1, -1, -1):
        further = ~end[doubled[k][node]]
        node, length = np.where(further, doubled[k][node], node), length + further * (1 << k)
    finish = np.where(end[start], start, doubled[0][node])
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    path = np.repeat(start, length)
    for k in range(len(doubled)):
        path = np.where(place >> k & 1 == 1, doubled[k][path], path)
    return best[path], path, length, finish


def repaired(roles: list, texts: list, letters: np.ndarray, nodes: np.ndarray, first_layer: int, first_row: int) -> list[str]:
    """`role:text` of every row that the edits leave; `roles` and `texts` count from `first_row`."""
    out = []
    for letter, node in zip(letters.tolist(), nodes.tolist()):
        row, state = node // 4 - first_layer + first_row, node % 4
        if letter == 1:
            out.append(f"{NAMES[int(TURNS[state])]}:")
        elif letter == 2:
            out.append(f"{roles[row]}:{texts[row]}")
        elif letter == 3:
            out.append(f"{NAMES[int(TURNS[state])]}:{texts[row]}")
    return out


def _tallies(role, turn, known, blank, again, cut, offsets):
    """gaps parts and fault counts of each stretch of rows: columns by name."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    fresh = known.copy()
    fresh[1:] &= ~known[:-1] | (turn[1:] != turn[:-1]) | (owner[1:] != owner[:-1])
    pairs = owner[1:] == owner[:-1]
    fine = ((role[:-1] == 0) & (role[1:] == 1)) | ((role[:-1] == 1) & (role[1:] == 2)) | ((role[:-1] == 2) & (role[1:] == 1))
    big = np.iinfo(np.int64).max
    low, high = np.full(n, big), np.full(n, -big)
    np.minimum.at(low, owner[known], turn[known])
    np.maximum.at(high, owner[known], turn[known])
    count = lambda mask: np.bincount(owner[mask], minlength=n)
    return {
        "low": low, "high": high, "turns": count(fresh), "blank": count(blank), "duplicate": count(again), "truncated": count(cut),
        "illegal": np.bincount(owner[1:][pairs & ~fine], minlength=n),
    }


def damaged(rows: DataFrame) -> DataFrame:
    """`conversations` with made faults, by the checksum of conversation and turn; dropped rows stay with `live` false."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    told = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    live = F.col("kind") != 0
    return told.select(
        "conv_id", "turn", F.when(live, F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).alias("role"),
        F.when(live, text).alias("text"), live.alias("live"), F.explode(times).alias("copy"),
    ).drop("copy")


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]
#: Rows of conversations at the borders of sorted partitions, beside whole results.
_ROW = "chunk int, pos long, turn long, role string, text string, live boolean, state int, name binary"


def _initials(column: pa.Array) -> np.ndarray:
    first = [r[:1] if r else "" for r in column.to_pylist()]
    return np.array([INITIALS.get(x, 3) for x in first], np.int64)


def _again(conv: np.ndarray, names: list, live: np.ndarray) -> np.ndarray:
    """Rows whose role and text stand earlier in the same conversation; rows lie in order."""
    seen, out = set(), np.zeros(len(names), bool)
    at = None
    for k, (c, name) in enumerate(zip(conv.tolist(), names)):
        if c != at:
            seen, at = set(), c
        if live[k]:
            out[k] = name in seen
            seen.add(name)
    return out


def _results(conv_ids, role, turn, known, blank, again, cut, offsets, roles, texts) -> pa.RecordBatch:
    """Result rows of whole conversations; the arrays hold their rows that were not dropped."""
    blank_, again_, cut_ = blank, again & ~blank, cut & ~blank & ~again
    tally = _tallies(role, turn, known, blank_, again_, cut_, offsets)
    must = blank_ | again_
    n = len(offsets) - 1
    cost = costs(role, must, cut_, offsets, np.broadcast_to(FINISHED, (n, 4)))
    base = _layers(offsets)
    there, to = optimal_arcs(role, must, cut_, offsets, cost, np.arange(n))
    letter, node, length, _ = least_paths(there, to, base * 4)
    ends = np.concatenate([[0], np.cumsum(length)]).tolist()
    audit = LETTERS[letter].tobytes().decode()
    shas = []
    for c in range(n):
        a, b = ends[c], ends[c + 1]
        rows = repaired(roles, texts, letter[a:b], node[a:b], int(base[c]), int(offsets[c]))
        shas.append(hashlib.sha256("\n".join(rows).encode()).hexdigest())
    some = tally["turns"] > 0
    gaps = np.where(some, np.where(some, tally["high"], 0) - np.where(some, tally["low"], 0) + 1 - tally["turns"], 0)
    return pa.RecordBatch.from_arrays(
        [conv_ids, pa.array(gaps), *[pa.array(tally[k], pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal")], pa.array(cost[base, 0]),
         pa.array([audit[a:b] for a, b in zip(ends[:-1], ends[1:])]), pa.array(shas)],
        names=_NAMES,
    )


def _nothing(schema: pa.Schema, names, rows: int) -> list[pa.Array]:
    return [pa.nulls(rows, schema.field(n).type) for n in names]


def _repairing(schema: pa.Schema):
    """A sorted partition: results of the conversations inside it, rows of the first and the last one."""

    def out(batch: pa.RecordBatch | pa.Table, rest: dict) -> pa.RecordBatch:
        rows = batch.num_rows
        cells = [batch.column(n) if n in batch.schema.names else rest.get(n, pa.nulls(rows, schema.field(n).type)) for n in schema.names]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cells], schema=schema)

    def run(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        chunk = TaskContext.get().partitionId()
        ids = table["conv_id"]
        null = ids.is_null().to_numpy()
        value = ids.fill_null(0).to_numpy()
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1])
        conv = np.cumsum(new) - 1
        heads = np.append(np.flatnonzero(new), len(value))
        live = table["live"].to_numpy()
        again = _again(conv, table["name"].to_pylist(), live)
        first, last = int(heads[1]), int(heads[-2])
        for a, b in ((0, first), (last, len(value))) if last else ((0, first),):
            part = table.slice(a, b - a)
            # A row that repeats one of its own chunk is known to be a duplicate: no name is needed any more.
            name = pa.array([None if x else y for x, y in zip(again[a:b].tolist(), part["name"].to_pylist())], pa.binary())
            part = part.drop_columns(["name"]).append_column("name", name)
            yield out(part, {"chunk": pa.array(np.full(b - a, chunk), pa.int32()), "pos": pa.array(np.arange(a, b))})
        if last <= first:
            return
        inside = np.flatnonzero((np.arange(len(value)) >= first) & (np.arange(len(value)) < last) & live)
        owner = conv[inside] - 1
        many = len(heads) - 3
        offsets = np.searchsorted(owner, np.arange(many + 1))
        some = table.take(pa.array(inside))
        state = some["state"].to_numpy()
        turn = some["turn"]
        result = _results(
            ids.take(pa.array(heads[1:-2])).combine_chunks(), _initials(some["role"]), turn.fill_null(0).to_numpy(), ~turn.is_null().to_numpy(),
            state == 1, again[inside], state == 2, offsets, some["role"].to_pylist(), some["text"].to_pylist(),
        )
        yield out(result, {})

    return run


def _codes(table: pa.Table):
    """Columns of the live rows of one piece of a conversation, in order."""
    table = table.sort_by("pos")
    table = table.filter(table["live"])
    state, turn = table["state"].to_numpy(), table["turn"]
    role = _initials(table["role"])
    blank, again = state == 1, table["again"].to_numpy(zero_copy_only=False) & (state != 1)
    cut = (state == 2) & ~again
    return table, role, turn.fill_null(0).to_numpy(), ~turn.is_null().to_numpy(), blank, again, cut


_PIECE = "conv_id long, chunk int, n long, head int, tail int, first_turn long, last_turn long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, matrix array<long>"
_PIECE_NAMES = [x.split()[0] for x in _PIECE.split(", ")]


def _measured(table: pa.Table) -> pa.Table:
    """One piece of a conversation: its tallies and the least costs from each state at its start to each at its end."""
    conv_id, chunk = table["conv_id"][:1].combine_chunks(), table["chunk"][:1].combine_chunks()
    table, role, turn, known, blank, again, cut = _codes(table)
    n = len(role)
    tally = _tallies(role, turn, known, blank, again, cut, np.array([0, n]))
    ends = np.where(np.eye(4, dtype=bool), 0, FAR)
    four = np.arange(5) * n
    cost = costs(np.tile(role, 4), np.tile(blank | again, 4), np.tile(cut, 4), four, ends)[_layers(four)]
    edge = [(int(role[k]) if n else None, int(turn[k]) if n and known[k] else None) for k in (0, -1)] if n else [(None, None)] * 2
    cells = [n, edge[0][0], edge[1][0], edge[0][1], edge[1][1], *[int(tally[k][0]) for k in ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")]]
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 9]
    matrix = pa.array([cost.T.ravel().tolist()], pa.list_(pa.int64()))
    return pa.Table.from_arrays([conv_id, chunk, *[pa.array([v], k) for v, k in zip(cells, kinds)], matrix], names=_PIECE_NAMES)


_SUM = "conv_id long, chunk int, after array<long>, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _chained(table: pa.Table) -> pa.Table:
    """All pieces of one conversation: the costs after each piece, and the tallies of the whole."""
    rows = table.sort_by("chunk").to_pylist()
    after, out = FINISHED, []
    for k in range(len(rows) - 1, -1, -1):
        out.append(np.minimum(after, FAR).tolist())
        after = (np.array(rows[k]["matrix"]).reshape(4, 4) + after).min(axis=1)
    full = [r for r in rows if r["n"]]
    turns, illegal = sum(r["turns"] for r in full), sum(r["illegal"] for r in full)
    for x, y in zip(full[:-1], full[1:]):
        illegal += (x["tail"], y["head"]) not in {(0, 1), (1, 2), (2, 1)}
        turns -= x["last_turn"] is not None and x["last_turn"] == y["first_turn"]
    told = [r for r in full if r["turns"]]
    gaps = max(r["high"] for r in told) - min(r["low"] for r in told) + 1 - turns if told else 0
    faults = [sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated")]
    one = [{"conv_id": r["conv_id"], "chunk": r["chunk"], "after": a, "gaps": gaps, **dict(zip(("blank", "duplicate", "truncated"), faults)),
            "illegal": illegal, "cost": int(after[0])} for r, a in zip(rows, out[::-1])]
    types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.int64()] * 6]
    return pa.Table.from_pylist(one, schema=pa.schema(list(zip([x.split()[0] for x in _SUM.split(", ")], types))))


def _paths(table: pa.Table, after, starts: np.ndarray, final: bool):
    """Least paths through one piece from each of the states in `starts`."""
    table, role, _, _, blank, again, cut = _codes(table)
    offsets = np.array([0, len(role)])
    cost = costs(role, blank | again, cut, offsets, np.array(after)[None])
    there, to = optimal_arcs(role, blank | again, cut, offsets, cost, np.arange(int(final)))
    return table, *least_paths(there, to, starts)


def _passed(rows: pa.Table) -> pa.Table:
    """The state at the end of a piece for each state at its start."""
    table, *_, finish = _paths(rows, rows["after"][0].as_py(), np.arange(4), bool(rows["final"][0].as_py()))
    return pa.Table.from_arrays([rows["conv_id"][:1].combine_chunks(), rows["chunk"][:1].combine_chunks(), pa.array([(finish % 4).tolist()], pa.list_(pa.int32()))], names=["conv_id", "chunk", "to"])


def _entered(table: pa.Table) -> pa.Table:
    """The state in which the least path of a conversation enters each of its pieces."""
    table = table.sort_by("chunk")
    state, out = EMPTY, []
    for to in table["to"].to_pylist():
        out.append(state)
        state = to[state]
    return pa.Table.from_arrays([table["conv_id"].combine_chunks(), table["chunk"].combine_chunks(), pa.array(out, pa.int32())], names=["conv_id", "chunk", "entry"])


_STREAM = "conv_id long, chunk int, seq int, audit string, body binary"


def _streamed(rows: pa.Table) -> pa.Table:
    """Audit letters and repaired rows of one piece, in blocks; every repaired row ends with a newline."""
    conv_id, chunk = rows["conv_id"][0].as_py(), rows["chunk"][0].as_py()
    table, letter, node, _, _ = _paths(rows, rows["after"][0].as_py(), np.array([rows["entry"][0].as_py()]), bool(rows["final"][0].as_py()))
    roles, texts = table["role"].to_pylist(), table["text"].to_pylist()
    blocks, at, size = [], 0, 0
    for k, x in enumerate(node.tolist()):
        size += len(texts[x // 4]) + 16 if x // 4 < len(texts) else 16
        if size >= STREAM_BYTES or k + 1 == len(node):
            body = "".join(f"{r}\n" for r in repaired(roles, texts, letter[at : k + 1], node[at : k + 1], 0, 0)).encode()
            blocks.append((LETTERS[letter[at : k + 1]].tobytes().decode(), body))
            at, size = k + 1, 0
    blocks = blocks or [("", b"")]
    n = len(blocks)
    return pa.Table.from_arrays(
        [pa.array([conv_id] * n, pa.int64()), pa.array([chunk] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([a for a, _ in blocks]), pa.array([b for _, b in blocks], pa.binary())],
        names=["conv_id", "chunk", "seq", "audit", "body"],
    )


def _hashed(batches):
    """Digest of each conversation from its blocks in order: only the running digest and the audit are held."""
    at, sha, audit, left = (), None, [], b""

    def done():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])

    for batch in batches:
        for k in range(batch.num_rows):
            conv = batch.column(0)[k].as_py()
            if sha is None or conv != at:
                if sha is not None:
                    yield done()
                at, sha, audit, left = conv, hashlib.sha256(), [], b""
            audit.append(batch.column(1)[k].as_py())
            body = batch.column(2)[k].as_py()
            if body:  # the newline after the last row is not part of the whole
                sha.update(left + body[:-1])
                left = b"\n"
    if sha is not None:
        yield done()


def _keyed(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null."""
    right = other.select(*[F.col(k).alias(f"{k}_right") for k in keys], *[c for c in other.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"{k}_right")) for k in keys]
    return df.join(right, on, how).drop(*[f"{k}_right" for k in keys])


def _spanning(border: DataFrame) -> DataFrame:
    """Results of conversations at partition borders: piece by piece, as long as they may be."""
    chunks = border.filter("name IS NOT NULL AND live").groupBy("conv_id", "name").agg(F.min("chunk").alias("first"))
    # Of a role and text each chunk names one row, so no key here has more rows than there are chunks.
    rows = _keyed(border, chunks, ["conv_id", "name"], "left")
    rows = written(rows.select("conv_id", "chunk", "pos", "turn", "role", "text", "live", "state", (F.col("live") & (F.col("name").isNull() | (F.col("first") < F.col("chunk")))).alias("again")))
    keys = ["conv_id", "chunk"]
    narrow = rows.drop("text").withColumn("text", F.lit(None).cast("string"))
    pieces = written(narrow.groupBy(*keys).applyInArrow(_measured, _PIECE))
    sums = written(pieces.groupBy("conv_id").applyInArrow(_chained, _SUM))
    last = sums.groupBy("conv_id").agg(F.max("chunk").alias("last"))
    known = _keyed(sums, last, ["conv_id"]).select(*keys, "after", (F.col("chunk") == F.col("last")).alias("final"))
    known = written(known)
    passed = written(_keyed(narrow, known, keys).groupBy(*keys).applyInArrow(_passed, "conv_id long, chunk int, to array<int>"))
    entered = written(passed.groupBy("conv_id").applyInArrow(_entered, "conv_id long, chunk int, entry int"))
    told = _keyed(_keyed(rows, known, keys), entered, keys)
    blocks = written(told.groupBy(*keys).applyInArrow(_streamed, _STREAM))
    parts = int(border.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = blocks.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "chunk", "seq").select("conv_id", "audit", "body")
    digests = ordered.mapInArrow(_hashed, "conv_id long, audit string, repaired_sha256 string")
    whole = sums.drop("chunk", "after").distinct()
    return _keyed(whole, digests, ["conv_id"]).select(*_NAMES)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Least-cost repair of conversations to the role pattern `(s?(ua)+)?`.

    `rows` has conv_id, turn, role, text, and may have `live` (false: the row
    only tells that its conversation exists).  Rows go by turn, nulls first;
    ties by role, then the first 64 characters and the digest of the text.
    The first fault of a row counts: blank (white space only), duplicate (role
    and text seen earlier), truncated (last character that is no white space
    is none of `.!?`).  Keeping a row costs 0, giving it the role user or
    assistant 1, deleting it 2 (required for blank and duplicate rows),
    inserting an empty row 5; a truncated row that stays costs 5 more.

    The whole table is sorted by range once.  Conversations inside a partition
    are repaired there; one that crosses borders is repaired in pieces, whose
    least costs combine as 4 x 4 matrices, so no task holds it.  Only its audit
    and the running digest meet in one task.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    (edits K, R, D, I in order; ASCII-least of the cheapest) and
    repaired_sha256.  A null conv_id is one conversation; null roles and texts
    count as one space; a null turn is in no gap.  Other columns are ignored;
    an empty table gives an empty result.
    """
    spark = rows.sparkSession
    live = F.col("live") if "live" in rows.columns else F.lit(True)
    told = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(live, F.coalesce("role", F.lit(" "))).alias("role"), F.when(live, F.coalesce("text", F.lit(" "))).alias("text"), live.alias("live"),
    )
    trimmed = F.rtrim("text", F.lit(SPACES))
    state = F.when(trimmed == "", 1).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2)
    name = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    told = told.withColumns({"state": F.when(F.col("live"), state).cast("int"), "name": F.when(F.col("live"), name)})
    size = told.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.left("text", F.lit(TIE_CHARS)).asc(), F.asc("name")]
    # Equal rows may be many: where they lie tells them apart, so that they too are split.
    lying = told.withColumn("lies", F.monotonically_increasing_id())
    sorted_ = lying.repartitionByRange(parts, *order, F.asc("lies")).sortWithinPartitions(*order).drop("lies")
    schema = f"{RESULT}, {_ROW}"
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    met = written(sorted_.select("conv_id", "turn", "role", "text", "live", "state", "name").mapInArrow(_repairing(kinds), schema))
    inner = met.filter("audit IS NOT NULL").select(*_NAMES)
    border = met.filter("audit IS NULL").select("conv_id", "chunk", "pos", "turn", "role", "text", "live", "state", "name")
    return inner.unionByName(_spanning(border))
