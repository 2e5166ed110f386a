"""Conversation structure repair (operator 12), by dynamic programming over the turns that are retained.

A conversation in order has the role initials `(s?(ua)+)?`: an optional system turn, then pairs of user and
assistant. Edits are Keep (costs 0), Rerole to user or assistant (3), Delete (4) and Insert of an empty
user or assistant turn (3). Blank turns and repeated ones (role and text seen earlier in the conversation) must be
deleted; a truncated turn that stays costs 3 more.

The cheapest edits are found from the end: what follows a retained turn costs the deletions up to the
next retained one (a difference of prefix sums), the inserts that the pair of roles asks for, that turn's own edit,
and what follows it. The least of that over all next turns is carried as a running minimum for each role of
the next turn, so a conversation takes time in proportion to its turns. Walking forward, of all edits that
still reach the least cost the first by initial is taken (D, I, K, R), so ties go to the audit that is least in ASCII.

Turns of a conversation follow by turn (null first), then by role and text. Rows are sorted within their
partitions and stream through; one conversation at a time is held, in the memory of a Python worker: its
digest needs it whole, in order.

Defined results: null role and text are one space, so such a text is blank; white space is U+0020 and U+0009 to U+000D; a role
that is empty or begins with another letter than s, u or a can't be kept, only reroled or deleted; equal rows beyond the first are
duplicates; rows without conv_id are one conversation; gaps ignore turns that are null; very long texts and conversations
are worked on whole; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: The state is the role of the last turn so far: none, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NAME = {USER: "user", ASSISTANT: "assistant"}
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The role that may be inserted next, or that a reroled turn gets.
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL = {"su", "ua", "au"}
_NEVER = 1 << 60
#: Inserts between two roles that follow each other, and at the end.
BETWEEN = {NONE: {SYSTEM: 0, USER: 0, ASSISTANT: 1}, SYSTEM: {USER: 0, ASSISTANT: 1}, USER: {USER: 1, ASSISTANT: 0}, ASSISTANT: {USER: 0, ASSISTANT: 1}}
AT_END = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}


class Turn(NamedTuple):
    turn: int | None
    role: str
    text: str
    fault: str


class Repaired(NamedTuple):
    cost: int
    audit: str
    turns: list[tuple[str, str]]


def own_cost(t: Turn, state: int) -> int:
    """The cost of retaining a turn in the role of `state`, beside what lies between."""
    if t.fault in ("blank", "duplicate"):
        return _NEVER
    late = TRUNCATED if t.fault == "truncated" else 0
    if STATE.get(t.role[:1]) == state:
        return late
    return late + REROLE if state in NAME else _NEVER


def repair(turns: list[Turn]) -> Repaired:
    """The cheapest edits of one conversation."""
    n = len(turns)
    # rest[r, i]: the least cost of turns i.. once the last turn so far has role r
    rest = np.zeros((4, n + 1), np.int64)
    rest[:, n] = [INSERT * AT_END[r] for r in range(4)]
    least = {SYSTEM: _NEVER, USER: _NEVER, ASSISTANT: _NEVER}
    for i in range(n - 1, -1, -1):
        for q in least:
            least[q] = min(least[q], DELETE * i + own_cost(turns[i], q) + int(rest[q, i + 1]))
        for r, gaps in BETWEEN.items():
            ends = INSERT * AT_END[r] + DELETE * n
            rest[r, i] = min(ends, *(INSERT * k + least[q] for q, k in gaps.items())) - DELETE * i
    i, r, audit, out = 0, NONE, [], []
    while i < n or rest[r, i]:
        left, q = rest[r, i], NEXT[r]
        if i < n and DELETE + rest[r, i + 1] == left:
            audit.append("D")
            i += 1
            continue
        if INSERT + rest[q, i] == left:
            audit.append("I")
            out.append((NAME[q], ""))
            r = q
            continue
        t = turns[i]
        if r == NONE and t.role[:1] == "s" and own_cost(t, SYSTEM) + rest[SYSTEM, i + 1] == left:
            q = SYSTEM
        kept = STATE.get(t.role[:1]) == q
        audit.append("K" if kept else "R")
        out.append((t.role if kept else NAME[q], t.text))
        i, r = i + 1, q
    return Repaired(int(rest[NONE, 0]), "".join(audit), out)


def faults(rows: Iterable[tuple[int | None, str, str]]) -> list[Turn]:
    """The turns of a conversation with the first fault of each."""
    seen: set[tuple[str, str]] = set()
    out = []
    for turn, role, text in rows:
        body = text.rstrip(SPACES)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ENDS else "truncated"
        seen.add((role, text))
        out.append(Turn(turn, role, text, fault))
    return out


def summary(turns: list[Turn]) -> dict[str, int | str]:
    known = {t.turn for t in turns if t.turn is not None}
    found = {f: sum(t.fault == f for t in turns) for f in ("blank", "duplicate", "truncated")}
    illegal = sum(a.role[:1] + b.role[:1] not in LEGAL for a, b in zip(turns, turns[1:]))
    r = repair(turns)
    digest = hashlib.sha256()
    for k, (role, text) in enumerate(r.turns):
        digest.update(f"{chr(10) if k else ''}{role}:{text}".encode())
    return {"gaps": max(known) - min(known) + 1 - len(known) if known else 0, **found, "illegal": illegal, "cost": r.cost, "audit": r.audit, "repaired_sha256": digest.hexdigest()}


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Turn]]]:
    """Each conversation of sorted rows, though it may go on over batches."""
    key, rows = None, []
    for b in batches:
        for conv, *row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
            if rows and conv != key:
                yield key, faults(rows)
                rows = []
            key = conv
            rows.append(row)
    if rows:
        yield key, faults(rows)


def _each(work: Callable[[object, list[Turn]], Iterable[tuple]], schema: pa.Schema, most: int = 2000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows that `work` gives of all conversations, in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, turns in _conversations(batches):
            for row in work(conv, turns):
                out.append(row)
                if len(out) == most:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _sorted(turns: DataFrame) -> DataFrame:
    filled = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    return filled.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _arrow(turns: DataFrame, *more: tuple[str, pa.DataType]) -> pa.Schema:
    kind = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}[dict(turns.dtypes)["conv_id"]]
    return pa.schema([("conv_id", kind), *more])


def audit(turns: DataFrame) -> DataFrame:
    """conv_id, counts of gaps and faults, cost, audit and repaired_sha256 of each conversation."""
    schema = _arrow(turns, *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string()))
    kinds = ", ".join([f"conv_id {dict(turns.dtypes)['conv_id']}", *(f"{c} long" for c in COUNTS), "audit string, repaired_sha256 string"])
    return _sorted(turns).mapInArrow(_each(lambda conv, t: [(conv, *summary(t).values())], schema), kinds)


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text: the turns of all conversations after the cheapest edits."""
    schema = _arrow(turns, ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()))
    return _sorted(turns).mapInArrow(_each(lambda conv, t: ((conv, k, *x) for k, x in enumerate(repair(t).turns)), schema), f"conv_id {dict(turns.dtypes)['conv_id']}, place long, role string, text string")


def damage(turns: DataFrame) -> DataFrame:
    """Rows of `turns` with faults put in by the CRC-32 of conv_id:turn, null being one space, so that repairs can be judged."""
    blank = F.lit(" ")
    d = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fate = F.crc32(key) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    d = d.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))
    return d.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(True), F.col("times")))).drop("col")


def audit_all(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """`audit` of `turns`, with a row for each conv_id of `conversations`; those without turns cost nothing."""
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    a = audit(turns)
    d = ids.join(a, ids["_id"].eqNullSafe(a["conv_id"]), "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return d.select(F.col("_id").alias("conv_id"), *(F.coalesce(a[c], F.lit(0)).alias(c) for c in COUNTS), F.coalesce(a["audit"], F.lit("")).alias("audit"), F.coalesce(a["repaired_sha256"], nothing).alias("repaired_sha256"))
