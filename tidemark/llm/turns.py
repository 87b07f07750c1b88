"""Repair of a conversation's structure: a product of 4x4 matrices over (cost, audit), taken chunk by chunk and then as a tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

GAP_CHARS = " \t\n\x0b\x0c\r"
#: Costs of a new role, a deletion, an inserted turn, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Neighbours whose roles' initials may follow each other.
LEGAL = ("su", "ua", "au")
#: Chunks that one step of the tree multiplies at most.
FAN = 8
#: Rows of one Arrow batch that a task hands on.
ROWS = 8192

# States of what has been kept so far: 0 nothing, 1 a system turn, 2 last a user's, 3 last an assistant's. Ends: 0 and 3.
Entry = tuple[int, str] | None
Matrix = tuple[Entry, ...]


def times(x: Matrix, y: Matrix) -> Matrix:
    """Min-plus product: costs add up, audits follow each other; the cheapest wins, and of equal costs the least audit in ASCII.

    Audits of the same turns and cost never are prefixes of each other (they would differ by inserted turns, which cost), so
    the least of two stays the least whatever follows, and the product is associative.
    """
    out = []
    for i in (0, 4, 8, 12):
        for j in range(4):
            ways = [(x[i + k][0] + y[4 * k + j][0], k) for k in range(4) if x[i + k] and y[4 * k + j]]
            if not ways:
                out.append(None)
                continue
            cost = min(ways)[0]
            out.append((cost, min(x[i + k][1] + y[4 * k + j][1] for c, k in ways if c == cost)))
    return tuple(out)


def _matrix(entries: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(entries.get((i, j)) for i in range(4) for j in range(4))


ONE = _matrix({(i, i): (0, "") for i in range(4)})
#: Any number of inserted turns: what follows what has been kept, or nothing. More than two never pay.
CLOSURE = _matrix({(i, i): (0, "") for i in range(4)} | {(0, 2): (INSERT, "I"), (1, 2): (INSERT, "I"), (2, 3): (INSERT, "I"), (3, 2): (INSERT, "I"), (0, 3): (2 * INSERT, "II"), (1, 3): (2 * INSERT, "II")})


def turn_matrix(initial: str, live: bool, truncated: bool, dead: int) -> Matrix:
    """A turn that may stay, if live, then so many that must go, with inserted turns before and after."""
    gone = _matrix({(i, i): (DELETE * dead, "D" * dead) for i in range(4)})
    if not live:
        return times(gone, CLOSURE)  # an audit that deletes before it inserts is less than one that inserts before
    more = TRUNCATED if truncated else 0
    step: dict[tuple[int, int], tuple[int, str]] = {(i, i): (DELETE, "D") for i in range(4)}
    step |= {at: (REROLE + more, "R") for at in ((0, 2), (1, 2), (3, 2), (2, 3))}
    step |= {at: (more, "K") for at in {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}.get(initial, ())}
    return times(times(CLOSURE, times(_matrix(step), gone)), CLOSURE)


class Fold:
    """A product taken from left to right in pieces of doubling length: audits are copied a logarithmic number of times."""

    def __init__(self) -> None:
        self.pieces: list[tuple[int, Matrix]] = []

    def push(self, m: Matrix, rank: int = 0) -> None:
        while self.pieces and self.pieces[-1][0] <= rank:
            r, left = self.pieces.pop()
            m, rank = times(left, m), max(r, rank) + 1
        self.pieces.append((rank, m))

    def total(self) -> Matrix:
        return reduce(lambda right, left: times(left, right), (m for _, m in reversed(self.pieces)), ONE)


def best(m: Matrix) -> tuple[int, str]:
    """From nothing to a legal end: nothing kept, or last an assistant's turn."""
    return min(e for e in (m[0], m[3]) if e)


def damage(conversations: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by crc32("conv_id:turn") % 20, for trials; a null is one space.

    0 drops the row (copies = 0), 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it (copies = 2),
    4 makes it the user's. Turns and ids that are null stay so; in the sum they are a space too.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conv_id), F.lit(":"), spaced(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), kind.alias("kind"))
    spoiled = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), spoiled.alias("text"), copies.cast("long").alias("copies"))


def _meet(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which nulls are equal to each other; the keys are the left side's."""
    other = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"{k}__r"]) for k in keys])
    return left.join(other, on, how).drop(*(f"{k}__r" for k in keys))


KEYS = ["conv_id", "turn", "role", "h"]


def _hashed(turns: DataFrame) -> DataFrame:
    return turns.withColumn("h", F.unhex(F.md5(F.col("text").cast("binary"))))


def faults(turns: DataFrame) -> DataFrame:
    """From (conv_id, turn, role, text, copies): one row per different (conv_id, turn, role, text), without the text, as a written table.

    h stands for the text, n counts its rows, live says that one of them may stay, truncated that this one ends in no full
    stop, exclamation or question mark; blank and duplicate count those that must go. Rows are counted before they are
    exchanged, and where a text was first said is a minimum per (conversation, role, text): no group passes one task whole.
    """
    bare = F.rtrim("text", F.lit(GAP_CHARS))
    rows = _hashed(turns).select(*KEYS, "copies", (bare == "").alias("empty"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"))
    rows = materialize(rows.groupBy(*KEYS, "empty", "open").agg(F.sum("copies").alias("n")))
    first = rows.where("n > 0").groupBy("conv_id", "role", "h").agg(F.min(F.struct("turn")).alias("first"))
    rows = _meet(rows, first, ["conv_id", "role", "h"], "left")
    live = ~F.col("empty") & (F.col("n") > 0) & F.struct("turn").eqNullSafe(F.col("first"))
    return materialize(
        rows.select(*KEYS, "n", live.alias("live"), (live & F.col("open")).alias("truncated"), F.when(F.col("empty"), F.col("n")).otherwise(0).alias("blank"))
        .withColumn("duplicate", F.when(F.col("blank") > 0, 0).otherwise(F.col("n") - F.col("live").cast("long")))
    )


PART = "illegal long, head string, tail string, costs array<long>, audits array<string>"


def _put(m: Matrix) -> tuple[list[int], list[str]]:
    return [-1 if e is None else e[0] for e in m], ["" if e is None else e[1] for e in m]


def _got(costs, audits) -> Matrix:
    return tuple(None if c < 0 else (int(c), a) for c, a in zip(costs, audits, strict=True))


def chunks(marked: DataFrame, partitions: int | None = None) -> DataFrame:
    """Turns and chunks from rows of faults(), as one written table.

    Rows are sorted by (conv_id, turn, role, h) across all tasks, so a long conversation spans many tasks. A task reads
    its rows once, in bounded memory. is_part = false: a turn, with part (its task) and at (its place there in its conversation).
    is_part = true: a conversation's product within a task; edge says that its other parts may be in the tasks beside it.
    """
    live = marked.where("n > 0").select(*KEYS, "n", "live", "truncated")
    spread = live.repartitionByRange(*([partitions] if partitions else []), *KEYS).sortWithinPartitions(*KEYS)
    kind = marked.schema["conv_id"].dataType.simpleString(), marked.schema["turn"].dataType.simpleString()
    schema = f"conv_id {kind[0]}, part int, is_part boolean, edge boolean, turn {kind[1]}, role string, h binary, at long, n long, {PART}"
    names = [f.split()[0] for f in schema.split(", ")]
    empty = dict.fromkeys(names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = lru_cache(100_000)(turn_matrix)  # made in the task: a cached function would be sent by its name only
        part, runs, seen, rows = TaskContext.get().partitionId(), 0, None, []
        fold, at, illegal, head, tail = Fold(), 0, 0, "", ""
        to_batch = lambda: pa.RecordBatch.from_pylist(rows, schema=arrow)

        def chunk(edge: bool) -> dict:
            costs, audits = _put(fold.total())
            return empty | {"conv_id": seen[0], "part": part, "is_part": True, "edge": edge, "n": at, "illegal": illegal, "head": head, "tail": tail, "costs": costs, "audits": audits}

        arrow = None
        for batch in batches:
            if arrow is None:
                own = {f.name: f.type for f in batch.schema}
                more = {"part": pa.int32(), "is_part": pa.bool_(), "edge": pa.bool_(), "at": pa.int64(), "illegal": pa.int64(), "head": pa.string(), "tail": pa.string(), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}
                arrow = pa.schema([(n, more.get(n) or own[n]) for n in names])
            for conv, turn, role, h, n, live_, truncated in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                initial = role[:1]
                if seen != (conv,):
                    if seen is not None:
                        rows.append(chunk(runs == 1))
                    seen, runs = (conv,), runs + 1
                    fold, at, illegal, head, tail = Fold(), 0, n - 1, initial, initial
                else:
                    illegal += n - 1 + (tail + initial not in LEGAL)
                    tail = initial
                fold.push(matrix(initial if initial in ("s", "u", "a") else "", live_, truncated, n - live_))
                if live_:
                    rows.append(empty | {"conv_id": conv, "part": part, "is_part": False, "edge": False, "turn": turn, "role": role, "h": h, "at": at, "n": n})
                at += n
                if len(rows) >= ROWS:
                    yield to_batch()
                    rows = []
        if seen is not None:
            rows.append(chunk(True))
            yield to_batch()

    return materialize(spread.mapInArrow(scan, schema))


def _product(group: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring parts of one conversation as one."""
    group = group.sort_values("part")
    parts = group.to_dict("records")
    fold, illegal = Fold(), 0
    for i, p in enumerate(parts):
        fold.push(_got(p["costs"], p["audits"]))
        illegal += int(p["illegal"]) + (i > 0 and parts[i - 1]["tail"] + p["head"] not in LEGAL)
    costs, audits = _put(fold.total())
    row = {"conv_id": parts[0]["conv_id"], "part": parts[0]["up"], "illegal": illegal, "head": parts[0]["head"], "tail": parts[-1]["tail"], "costs": costs, "audits": audits}
    return pd.DataFrame([row])


def roots(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """(conv_id, part, illegal, cost, audit) of whole conversations: parts at the borders of tasks are multiplied as a tree, `fan` at a time."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    columns = ["conv_id", "part", *(f.split()[0] for f in PART.split(", "))]
    whole, level = parts.where("NOT edge").select(*columns), parts.where("edge").select(*columns)
    while level.groupBy("conv_id").count().where("count > 1").limit(1).count():
        up = level.withColumn("up", F.floor(F.col("part") / fan).cast("int"))
        level = materialize(up.groupBy("conv_id", "up").applyInPandas(_product, f"conv_id {kind}, part int, {PART}").select(*columns))

    @F.pandas_udf("cost long, audit string")
    def ending(costs: pd.Series, audits: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best(_got(c, a)) for c, a in zip(costs, audits, strict=True)], columns=["cost", "audit"])

    ended = whole.unionByName(level).withColumn("e", ending("costs", "audits"))
    return materialize(ended.select("conv_id", "part", "illegal", "e.cost", "e.audit"))


def _slices(keys, leaves: pd.DataFrame, root: pd.DataFrame) -> pd.DataFrame:
    """A conversation's audit cut at the borders of its parts, with the number of turns kept before each."""
    letters = np.frombuffer(root["audit"].iloc[0].encode(), dtype=np.uint8)
    leaves = leaves.sort_values("part")
    own = np.cumsum(letters != ord("I"))  # turns of the input that an audit has spoken of
    ends = np.searchsorted(own, np.cumsum(leaves["n"].to_numpy()), side="left") + 1
    ends[-1] = len(letters)  # turns inserted at the end go with the last part
    starts = np.concatenate([[0], ends[:-1]])
    before = np.concatenate([[0], np.cumsum(letters != ord("D"))])
    cut = [letters[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    conv = leaves["conv_id"].iloc[0]
    return pd.DataFrame({"conv_id": [conv] * len(cut), "part": leaves["part"].to_numpy(), "audit": cut, "base": before[starts], "all": int(before[-1])})


def kept_turns(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """(conv_id, part, at, nth, letter, role) of every turn that the repair keeps (K), gives a role (R) or inserts (I).

    nth counts the repaired conversation's turns from 0, role is what stands there (null: as it was), at is null for inserted ones.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()
    leaves = parts.where("edge").select("conv_id", "part", "n")
    spanned = _meet(whole, leaves.select("conv_id").distinct(), ["conv_id"], "left_semi").select("conv_id", "audit")
    cut = leaves.groupBy("conv_id").cogroup(spanned.groupBy("conv_id")).applyInPandas(_slices, f"conv_id {kind}, part int, audit string, base long, all long")
    inner = parts.where("NOT edge").select("conv_id", "part")
    alone = _meet(whole.drop("part"), inner, ["conv_id"], "inner").select("conv_id", "part", "audit", F.lit(0).cast("long").alias("base"), F.length(F.translate("audit", "D", "")).cast("long").alias("all"))
    names = ["conv_id", "part", "at", "nth", "letter", "role"]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            rows: list[tuple] = []
            to_batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)  # noqa: E731, B023
            for conv, part, audit, nth, every in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, odd = 0, every % 2  # a repaired conversation has an odd number of turns only if it begins with the system's
                for letter in audit:
                    if letter != "D":
                        role = None if letter == "K" else ("user", "assistant")[(nth - odd) % 2]
                        rows.append((conv, part, None if letter == "I" else at, nth, letter, role))
                        nth += 1
                    at += letter != "I"
                    if len(rows) >= ROWS:
                        yield to_batch()
                        rows.clear()
            if rows:
                yield to_batch()

    return cut.unionByName(alone).mapInArrow(spell, f"conv_id {kind}, part int, at long, nth long, letter string, role string")


def repaired_turns(turns: DataFrame, table: DataFrame, whole: DataFrame) -> DataFrame:
    """(conv_id, nth, role, text) of every turn of the repaired conversations, in any order; texts join by conversation, turn, role and hash."""
    said = table.where("NOT is_part").select("conv_id", "part", "at", "turn", F.col("role").alias("was"), "h")
    out = kept_turns(table.where("is_part"), whole)
    stay = _meet(out.where("letter <> 'I'"), said, ["conv_id", "part", "at"], "inner")
    stay = stay.select(F.struct("conv_id", "turn", F.col("was").alias("role"), "h").alias("key"), "nth", F.coalesce("role", "was").alias("to"))
    # one struct as key: nulls within it are equal to each other, and the texts are exchanged once for both the grouping and the join
    # (both structs need the same nullability for that, hence the condition)
    key = F.struct("conv_id", "turn", F.when(F.col("copies") > 0, F.col("role")).alias("role"), "h")
    texts = _hashed(turns.where("copies > 0")).groupBy(key.alias("key")).agg(F.first("text").alias("text"))
    told = texts.join(stay, "key").select("key.conv_id", "nth", F.col("to").alias("role"), "text")
    return told.unionByName(out.where("letter = 'I'").select("conv_id", "nth", "role", F.lit("").alias("text")))


def transcript_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of role:text of a conversation's turns, joined by newlines.

    The digest chains from turn to turn, so a conversation's turns pass one task, as a sorted stream; none of it is gathered.
    """
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, state, types = None, None, [pa.int64(), pa.string()]
        for batch in batches:
            done, types = [], [batch.column(0).type, pa.string()]
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if seen != (conv,):
                    if seen is not None:
                        done.append((seen[0], state.hexdigest()))
                    seen, state = (conv,), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:".encode())
                state.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=["conv_id", "repaired_sha256"])
        if seen is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seen[0]], types[0]), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

    in_order = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "nth").select("conv_id", "role", "text")
    return in_order.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def repair(turns: DataFrame, partitions: int | None = None, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """The report of every conversation and the repaired turns, from (conv_id, turn, role, text, copies).

    Turns go by number, null ones first; equal numbers by role, then by the MD5 of the text; copies are adjacent. The report has
    conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit (see damage() and the matrices for their rules).
    A conversation without any turn has zeros and an empty audit. Roles and texts may not be null (damage() makes them a
    space); a null conv_id is a conversation of its own. Repeated rows count as copies. An empty table gives no rows.
    """
    marked = faults(turns)
    table = chunks(marked, partitions)
    whole = roots(table.where("is_part"), fan)
    seen = F.when(F.col("n") > 0, F.col("turn"))
    counted = marked.groupBy("conv_id").agg(
        F.coalesce(F.max(seen) - F.min(seen) + 1 - F.count_distinct(seen), F.lit(0)).cast("long").alias("gaps"),
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum(F.col("truncated").cast("long")).alias("truncated"),
    )
    report = _meet(counted, whole.drop("part"), ["conv_id"], "left")
    return report.withColumns({"illegal": F.coalesce("illegal", F.lit(0)), "cost": F.coalesce("cost", F.lit(0)), "audit": F.coalesce("audit", F.lit(""))}), repaired_turns(turns, table, whole)


def repair_report(turns: DataFrame, partitions: int | None = None, fan: int = FAN) -> DataFrame:
    """repair()'s report with repaired_sha256, the digest of the repaired conversation; without turns, that of an empty text."""
    report, repaired = repair(turns, partitions, fan)
    nothing: Column = F.sha2(F.lit("").cast("binary"), 256)
    found = _meet(report, transcript_digests(repaired), ["conv_id"], "left")
    return found.withColumn("repaired_sha256", F.coalesce("repaired_sha256", nothing)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
