"""Conversation repair against a plain search over whole strings."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from abacist.llm import conversations as cv

WORD = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string"
STEP = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def broken(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows, all_ids):
    out = {}
    for conv in all_ids:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            last = WORD.findall(text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [x[2][:1] + y[2][:1] for x, y in zip(own, own[1:])]
        best = {0: (0, "", [])}

        def put(table, state, value):
            if state not in table or value[:2] < table[state][:2]:
                table[state] = value

        def grown(table):
            for _ in range(2):
                for q, (c, a, t) in list(table.items()):
                    name, to = STEP[q]
                    put(table, to, (c + 5, a + "I", [*t, {"u": "user:", "a": "assistant:"}[name]]))
            return table

        for (_, _, role, text), fault in zip(own, faults):
            after: dict = {}
            for q, (c, a, t) in grown(best).items():
                put(after, q, (c + 2, a + "D", t))
                if fault in ("blank", "duplicate"):
                    continue
                extra = 5 if fault == "truncated" else 0
                if (q, role[:1]) in KEEP:
                    put(after, KEEP[q, role[:1]], (c + extra, a + "K", [*t, f"{role}:{text}"]))
                name, to = STEP[q]
                put(after, to, (c + extra + 1, a + "R", [*t, {"u": "user:", "a": "assistant:"}[name] + text]))
            best = after
        cost, audit, told = min(v for q, v in grown(best).items() if q in (0, 3))
        count = Counter(faults)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("live", F.lit("other")).withColumn("Chunk", F.lit(1)).drop("live")
    found = {r["conv_id"]: tuple(r)[1:] for r in cv.repair_conversations(cv.damaged(df)).collect()}
    assert found == brute(broken(rows), {r[0] for r in rows})


def test_many_conversations(spark):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    texts = ["one. ", "two", "", " \n", None, "is it?", "well!", "word " * 40 + "end.", "é", "two."]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 12)):
            t = rng.choice([turn, turn, turn, turn * 3, None])
            rows.append((conv, t, rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts)))
    check(spark, rows)


def test_conversations_across_partitions(spark):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", "", f"{t}.", f"{t % 50}!"])) for t in range(400)]
    rows += [(2, None, "user", "same.")] * 150 + [(None, t // 3, rng.choice(["user", "assistant", "system"]), f"{t}.") for t in range(150)]
    check(spark, rows)


def test_empty_and_dropped(spark):
    assert cv.repair_conversations(cv.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    gone = [(c, 0, "user", "x.") for c in range(300) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows = cv.repair_conversations(cv.damaged(spark.createDataFrame(gone, SCHEMA))).collect()
    assert len(rows) == len(gone)
    assert {tuple(r)[1:] for r in rows} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_ranks_choose_among_arcs_of_one_letter_length():
    # Two optimal ways from node 0: letters differ only at the third edit.
    to = np.array([[1, 0, 4, 0], [0, 0, 2, 0], [0, 0, 3, 0], [0, 0, 0, 0], [0, 0, 5, 0], [6, 0, 0, 0], [0, 0, 0, 0]])
    there = np.array([[0, 0, 1, 0], [0, 0, 1, 0], [0, 0, 1, 0], [0, 0, 0, 0], [0, 0, 1, 0], [1, 0, 0, 0], [0, 0, 0, 0]], bool)
    letter, path, length, finish = cv.least_paths(there, to, np.array([0, 1, 3]))
    assert cv.LETTERS[letter].tobytes() == b"KKDKK" and length.tolist() == [3, 2, 0] and finish.tolist() == [6, 3, 3]
    assert path.tolist() == [0, 4, 5, 1, 2]
