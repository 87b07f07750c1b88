"""Repaired conversations beside an independent search for the cheapest edits, over odd rows, long conversations and a whole table."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, turns

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        at = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if at == 1:
            text = ""
        if at == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if at == 4 else role, text)] * {0: 0, 3: 2}.get(at, 1)
    return out


def cheapest(rows):
    """Least (cost, audit) by uniform-cost search over (rows read, state); rows are (initial, must go, truncated)."""
    heap, done = [(0, "", 0, 0)], set()
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, audit
        for to in (after[k] for k in after if k[0] == state and k[1] != "s"):
            heapq.heappush(heap, (cost + 5, audit + "I", at, to))
        if at < len(rows):
            initial, gone, open_ = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state))
            if not gone:
                if (state, initial) in after:
                    heapq.heappush(heap, (cost + 5 * open_, audit + "K", at + 1, after[state, initial]))
                for r in "ua":
                    if (state, r) in after:
                        heapq.heappush(heap, (cost + 1 + 5 * open_, audit + "R", at + 1, after[state, r]))


def told(table):
    out = []
    kept = {}
    for r in damaged(table):
        kept.setdefault(r[0], []).append(r)
    for conv in {r[0] for r in table}:
        rows = sorted(kept.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
        seen, marks, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in rows:
            words = WORD.findall(text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = {r[1] for r in rows if r[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:], strict=False))
        cost, audit = cheapest(marks)
        lines, left, last = [], iter(rows), ""
        for letter in audit:
            if letter == "I":
                lines.append(("assistant" if last[:1] == "u" else "user") + ":")
            else:
                _, _, role, text = next(left)
                if letter == "D":
                    continue
                lines.append(f"{role if letter == 'K' else 'assistant' if last[:1] == 'u' else 'user'}:{text}")
            last = lines[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("copies", "n", "h", "part", "edge", "audit", "kind")})


def random_rows(seed, conversations=60, most=14):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "and then", "", " \t", "What?", "Well. \n", "ok", ".", "..."]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3 - 5, None]), role, rng.choice([*texts, f"Line {rng.random()}.", None])))
    return rows


@pytest.mark.parametrize("partitions", [None, 9])
def test_odd_rows(spark, partitions):
    rows = random_rows(1) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, "user", None)]
    rows += [(900, 4, "user", "Same.")] * 30 + [(900, 4, "assistant", "Same too.")] * 3 + [(901, None, "system", "Sys.")] + [(902, t, "ursula", "x" * 60_000 + ".") for t in (1, 1, 5)]
    assert got(turns.repair_report(turns.damage(frame(spark, rows)), partitions)) == told(rows)


def test_long_conversations_span_tasks(spark):
    """Most rows in two conversations: their parts meet in a tree of several levels."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["A.", "b", f"Turn {t}.", f"turn {t}"])) for t in range(1500)]
    rows += [(8, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(700)] + random_rows(6, 20)
    assert got(turns.repair_report(turns.damage(frame(spark, rows)), 23, fan=2)) == told(rows)


def test_all_dropped_and_empty(spark):
    dropped = [(c, t, "user", "Hi.") for c, t in product(range(40), range(3)) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert dropped and got(turns.repair_report(turns.damage(frame(spark, dropped)))) == told(dropped)
    assert told(dropped)[0][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(turns.repair_report(turns.damage(frame(spark, dropped).where("false")))) == []


def test_repaired_turns_are_whole(spark):
    rows = random_rows(9, 30)
    report, repaired = turns.repair(turns.damage(frame(spark, rows)), 5)
    by = {}
    for r in repaired.collect():
        by.setdefault(r["conv_id"], []).append(r)
    for r in report.collect():
        lines = sorted(by.get(r["conv_id"], []), key=lambda x: x["nth"])
        assert [x["nth"] for x in lines] == list(range(len(r["audit"].replace("D", ""))))
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][:1] for x in lines))


def test_products_are_associative():
    rng = random.Random(2)
    some = [turns.turn_matrix(rng.choice(["s", "u", "a", ""]), live := rng.random() < 0.8, live and rng.random() < 0.3, rng.randrange(3) if live else 1 + rng.randrange(2)) for _ in range(300)]
    for a, b, c in zip(some, some[1:], some[2:], strict=False):
        assert turns.times(turns.times(a, b), c) == turns.times(a, turns.times(b, c))


def test_whole_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_turns(spark, path)) == told(rows)
