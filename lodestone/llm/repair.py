"""Repair of conversation structure by arcs that lie on a cheapest path.

A conversation's messages, by turn, should have roles whose initials read
``(s?(ua)+)?``. Each message is kept (0), given the role user or assistant (3)
or deleted (4, a must for blank and duplicate ones); an empty message of user
or assistant is inserted anywhere (3); a truncated message that stays costs 3
more. The edits are arcs of a graph whose nodes are (messages read, state of
the pattern), of four states. Costs from the start and to the end tell which
arcs are tight, that is on a cheapest path; from the start the set of nodes
reached by the letters so far moves along the least tight letter, so the edits
found are the ASCII-least of the cheapest.

Conversations have no bound, so nothing gathers one. Messages are put in order
by ranges of (conversation, turn, role, hash), a partition is read as blocks of
up to a thousand messages of one conversation, and

1. ``blocks`` takes the costs through a block, four states by four;
2. ``_meet`` joins them along each conversation to the costs before and after
   each block (some hundred bytes a block);
3. ``_walk`` moves the node set through each block, from each set that may
   enter it, all blocks at once;
4. ``_choose`` follows the sets along each conversation;
5. ``edits`` writes each block's messages with their edits.

Equal messages of one turn are one row with a count until then, and which
message said a text first comes from an aggregation. Only a digest over the
whole of a conversation, as the query has, must read its blocks one after
another, one in memory.

Cases: a null conversation is a conversation like others; null turns come
first; null role and text are one space, and an empty role is like an unknown
one, which is never kept. Messages of one turn stand by role, then by the
SHA-256 of the text. Repeated rows are duplicates. An empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import combinations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written

#: Messages and characters at which a block is full.
ROWS, CHARS = 1024, 1 << 20
FAR = 1 << 60
RELABEL, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a; by the initials s, u, a the state that follows.
NEXT = ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))
ENDS = (0, 3)
NAMES = ("system", "user", "assistant")
SOUND, TRUNCATED, DOOMED = 0, 1, 2
LEGAL = {(0, 1), (1, 2), (2, 1)}
SPACES = " \t\n\x0b\x0c\r"


@lru_cache(None)
def arcs(kind: int) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, from, to, cost) past one message; kind is initial * 3 + fault."""
    initial, fault = divmod(kind, 3)
    out = [("D", q, q, DELETE) for q in range(4)]
    if fault != DOOMED:
        more = CUT_OFF if fault == TRUNCATED else 0
        out += [("K", q, NEXT[q][initial], more) for q in range(4) if initial < 3 and NEXT[q][initial] is not None]
        out += [("R", q, NEXT[q][x], RELABEL + more) for q in range(4) for x in (1, 2) if NEXT[q][x] is not None]
    return tuple(out)


INSERTS = tuple(("I", q, NEXT[q][x], INSERT) for q in range(4) for x in (1, 2) if NEXT[q][x] is not None)
#: The same with letters in order, for the walk.
LETTERS = "DIKR"


def _settled(v: list[int], back: bool) -> tuple[int, ...]:
    """Costs with inserts taken into account."""
    for _ in range(3):
        for _, q, r, c in INSERTS:
            if back:
                v[q] = min(v[q], c + v[r])
            else:
                v[r] = min(v[r], v[q] + c)
    return tuple(min(x, FAR) for x in v)


@lru_cache(1 << 16)
def _past(v: tuple[int, ...], kind: int, back: bool) -> tuple[int, ...]:
    """Costs after a message, or before it."""
    out = [FAR] * 4
    for _, q, r, c in arcs(kind):
        if back:
            out[q] = min(out[q], c + v[r])
        else:
            out[r] = min(out[r], v[q] + c)
    return _settled(out, back)


def past(v: tuple[int, ...], kind: int, n: int, back: bool = False) -> tuple[int, ...]:
    """Costs across one step: a message and its n - 1 repeats, or n messages that must go."""
    low = min(v)
    v = tuple(x - low if x < FAR else FAR for x in v)
    if kind % 3 == DOOMED:
        low += DELETE * n
    elif back:
        v, low = _past(v, kind, True), low + DELETE * (n - 1)
    else:
        v, low = _past(v, kind, False), low + DELETE * (n - 1)
    return tuple(x + low if x < FAR else FAR for x in v)


START = _settled([0, FAR, FAR, FAR], False)
END = _settled([0 if q in ENDS else FAR for q in range(4)], True)


def through(kinds: bytes, n: list[int]) -> list[int]:
    """Costs from each state before the block to each state after it, row by row."""
    out: list[int] = []
    for q in range(4):
        v = _settled([0 if x == q else FAR for x in range(4)], False)
        for kind, m in zip(kinds, n):
            v = past(v, kind, m)
        out += v
    return out


def steps(kinds: bytes, n: list[int]) -> tuple[bytes, list[int]]:
    """Messages with more than one copy as the message and its repeats, which must go."""
    k, m = bytearray(), []
    for kind, copies in zip(kinds, n):
        k.append(kind)
        m.append(copies if kind % 3 == DOOMED else 1)
        if kind % 3 != DOOMED and copies > 1:
            k.append(kind - kind % 3 + DOOMED)
            m.append(copies - 1)
    return bytes(k), m


def walk(kinds: bytes, n: list[int], before: tuple[int, ...], after: tuple[int, ...], cost: int, last: bool, first: bool) -> list[tuple[int, int, str]]:
    """(set that enters, set that leaves, letters) for each set of nodes that may enter the block; sets are bits. One D stands for a step of n deletions."""
    kinds, n = steps(kinds, n)
    ahead, behind = [before], [after]
    for kind, m in zip(kinds, n):
        ahead.append(past(ahead[-1], kind, m))
    for kind, m in zip(reversed(kinds), reversed(n)):
        behind.append(past(behind[-1], kind, m, True))
    behind.reverse()
    enter = [0] if first else [q for q in range(4) if before[q] + behind[0][q] == cost]
    out = []
    for some in (s for k in range(1, len(enter) + 1) for s in combinations(enter, k)):
        now, letters = set(some), []
        for i, (kind, m) in enumerate(zip(kinds, n)):
            while True:
                letter, now = _least(now, ahead[i], behind[i], behind[i + 1], kind, m, cost)
                letters.append(letter)
                if letter != "I":
                    break
        if last:
            while not any(q in ENDS and ahead[-1][q] == cost for q in now):
                now = {r for _, q, r, c in INSERTS if q in now and ahead[-1][q] + c + behind[-1][r] == cost}
                letters.append("I")
        out.append((sum(1 << q for q in some), sum(1 << q for q in now), "".join(letters)))
    return out


def _least(now: set[int], ahead: tuple[int, ...], here: tuple[int, ...], after: tuple[int, ...], kind: int, m: int, cost: int) -> tuple[str, set[int]]:
    for letter in LETTERS:
        if letter == "I":
            to = {r for _, q, r, c in INSERTS if q in now and ahead[q] + c + here[r] == cost}
        else:
            to = {r for x, q, r, c in arcs(kind) if x == letter and q in now and ahead[q] + (c if kind % 3 != DOOMED else c * m) + after[r] == cost}
        if to:
            return letter, to
    raise AssertionError("a node on a cheapest path has a tight arc")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _out(rows: Iterator[dict], schema: pa.Schema, size: Callable[[dict], int] = lambda r: 1, full: int = 4096) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += size(r)
        if n >= full:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _groups(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """Neighbours with one conversation."""
    held: list[dict] = []
    for r in rows:
        if held and held[0]["conv"] != r["conv"]:
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def _gather(limit: int):
    """Messages in order -> blocks."""

    def block(held: list[dict], number: int) -> dict:
        kinds, n = bytes(r["kind"] for r in held), [r["n"] for r in held]
        out = {"conv": held[0]["conv"], "block": number, "kinds": kinds, "n": n, "roles": [r["role"] for r in held], "texts": [r["text"] for r in held], "costs": through(kinds, n)}
        turns = [r["turn"] for r in held if r["turn"] is not None]
        out |= {"low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns))}
        doomed = [r for r in held if r["kind"] % 3 == DOOMED]
        out |= {"blank": sum(r["n"] for r in doomed if r["blank"]), "truncated": sum(r["kind"] % 3 == TRUNCATED for r in held)}
        out["duplicate"] = sum(r["n"] for r in doomed if not r["blank"]) + sum(r["n"] - 1 for r in held if r["kind"] % 3 != DOOMED)
        initials = [k // 3 for k in kinds]
        out["ends"] = [initials[0], initials[-1]]
        out["illegal"] = sum(m - 1 for m in n) + sum(p not in LEGAL for p in zip(initials, initials[1:]))
        return out

    def blocks(rows: Iterator[dict]) -> Iterator[dict]:
        number, held, chars = TaskContext.get().partitionId() << 33, [], 0
        for r in rows:
            if held and (held[0]["conv"] != r["conv"] or len(held) >= limit or chars >= CHARS):
                yield block(held, number)
                number, held, chars = number + 1, [], 0
            held.append(r)
            chars += len(r["text"])
        if held:
            yield block(held, number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _typed(batches, blocks, _BLOCK, lambda r: 1000 + sum(map(len, r["texts"])), CHARS)

    return run


def _typed(batches: Iterator[pa.RecordBatch], f: Callable[[Iterator[dict]], Iterator[dict]], fields: list, size: Callable[[dict], int] = lambda r: 1, full: int = 4096) -> Iterator[pa.RecordBatch]:
    """f on rows; the conversation's type is that of the input."""
    first = next(batches, None)
    if first is None:
        return
    schema = pa.schema([("conv", first.schema.field("conv").type), *fields])

    def rows() -> Iterator[dict]:
        yield from first.to_pylist()
        yield from _rows(batches)

    yield from _out(f(rows()), schema, size, full)


_LONGS = pa.list_(pa.int64())
_BLOCK = [("block", pa.int64()), ("kinds", pa.binary()), ("n", _LONGS), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("costs", _LONGS), ("ends", _LONGS), ("low", pa.int64()), ("high", pa.int64())]
_BLOCK += [(c, pa.int64()) for c in ("turns", "blank", "truncated", "duplicate", "illegal")]
_BLOCK_SQL = "block long, kinds binary, n array<long>, roles array<string>, texts array<string>, costs array<long>, ends array<long>, low long, high long, turns long, blank long, truncated long, duplicate long, illegal long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Along each conversation: costs before and after each block, and its counts on its first block."""

    def met(rows: Iterator[dict]) -> Iterator[dict]:
        for group in _groups(rows):
            before, after = [START], [END]
            for r in group:
                before.append(tuple(min(FAR, *(before[-1][q] + r["costs"][4 * q + x] for q in range(4))) for x in range(4)))
            for r in reversed(group):
                after.append(tuple(min(FAR, *(r["costs"][4 * q + x] + after[-1][x] for x in range(4))) for q in range(4)))
            after.reverse()
            cost = min(before[-1][q] for q in ENDS)
            low, high = min((r["low"] for r in group if r["low"] is not None), default=None), max((r["high"] for r in group if r["high"] is not None), default=None)
            turns = sum(r["turns"] for r in group) - sum(a["high"] is not None and a["high"] == b["low"] for a, b in zip(group, group[1:]))
            total = {c: sum(r[c] for r in group) for c in ("blank", "duplicate", "truncated", "illegal")}
            total["illegal"] += sum((a["ends"][1], b["ends"][0]) not in LEGAL for a, b in zip(group, group[1:]))
            for i, r in enumerate(group):
                out = {"conv": r["conv"], "block": r["block"], "before": before[i], "after": after[i + 1], "cost": cost, "first": i == 0, "last": i == len(group) - 1}
                yield out | (total | {"gaps": 0 if low is None else high - low + 1 - turns} if i == 0 else {})

    yield from _typed(batches, met, _MET)


_MET = [("block", pa.int64()), ("before", _LONGS), ("after", _LONGS), ("cost", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")]]
_MET_SQL = "block long, before array<long>, after array<long>, cost long, first boolean, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def walked(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            ways = walk(r["kinds"], r["n"], tuple(r["before"]), tuple(r["after"]), r["cost"], r["last"], r["first"])
            yield {"conv": r["conv"], "block": r["block"], "enter": [w[0] for w in ways], "leave": [w[1] for w in ways], "letters": [w[2] for w in ways]}

    yield from _typed(batches, walked, _WALKED)


_WALKED = [("block", pa.int64()), ("enter", pa.list_(pa.int32())), ("leave", pa.list_(pa.int32())), ("letters", pa.list_(pa.string()))]
_WALKED_SQL = "block long, enter array<int>, leave array<int>, letters array<string>"


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Along each conversation: the letters of each block, and how many messages of the result come after it."""

    def chosen(rows: Iterator[dict]) -> Iterator[dict]:
        for group in _groups(rows):
            now, out = 1, []
            for r in group:
                way = r["enter"].index(now)
                now = r["leave"][way]
                out.append({"conv": r["conv"], "block": r["block"], "letters": r["letters"][way], "later": 0})
            later = 0
            for r in reversed(out):
                r["later"] = later
                later += len(r["letters"]) - r["letters"].count("D")
            yield from out

    yield from _typed(batches, chosen, _CHOSEN)


_CHOSEN = [("block", pa.int64()), ("letters", pa.string()), ("later", pa.int64())]
_CHOSEN_SQL = "block long, letters string, later long"


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's edits: letter, how often (deletions), role and text."""

    def edited(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            expanded = []
            for kind, n, role, text in zip(r["kinds"], r["n"], r["roles"], r["texts"]):
                for k, m in zip(*steps(bytes([kind]), [n])):
                    expanded.append((m, role, text))
            left, out, step = r["later"] + len(r["letters"]) - r["letters"].count("D"), [], iter(expanded)
            for letter in r["letters"]:
                n, role, text = (1, "", "") if letter == "I" else next(step)
                if letter != "D":
                    # The result ends with an assistant, and before that users and assistants take turns.
                    role = role if letter == "K" else NAMES[2 if left % 2 else 1]
                    left -= 1
                out.append({"edit": letter, "n": n, "role": role, "text": text})
            yield {"conv": r["conv"], "block": r["block"], "edits": out}

    yield from _typed(batches, edited, _EDITED, lambda r: 100 * len(r["edits"]) + sum(len(e["text"]) for e in r["edits"]), CHARS)


_EDITED = [("block", pa.int64()), ("edits", pa.list_(pa.struct([("edit", pa.string()), ("n", pa.int64()), ("role", pa.string()), ("text", pa.string())])))]
_EDITED_SQL = "block long, edits array<struct<edit string, n long, role string, text string>>"


def faults(messages: DataFrame) -> DataFrame:
    """(conv, turn, role, text, digest, n, blank, kind): equal messages of one turn as one row, with their fault."""
    space = F.lit(" ")
    rows = messages.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", F.sha2("text", 256))
    said = rows.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("said"), F.lit(True).alias("_")).drop("_")
    said = said.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "said")
    same = rows["conv"].eqNullSafe(said["c"]) & (rows["role"] == said["r"]) & (rows["digest"] == said["d"])
    met = rows.join(said, same).select("conv", "turn", "role", "text", "digest", "n", (F.struct("turn") > F.col("said")).alias("again"), F.rtrim("text", F.lit(SPACES)).alias("t"))
    initial = F.expr("case substring(role, 1, 1) when 's' then 0 when 'u' then 1 when 'a' then 2 else 3 end")
    fault = F.expr(f"case when t = '' or again then {DOOMED} when right(t, 1) not in ('.', '!', '?') then {TRUNCATED} else {SOUND} end")
    return met.select("conv", "turn", "role", "text", "digest", "n", (F.col("t") == "").alias("blank"), (initial * 3 + fault).alias("kind"))


class Repair:
    """The repair of a table (conv_id, turn, role, text): ``summary`` one row for each conversation, ``edits`` one for each block of messages."""

    def __init__(self, messages: DataFrame, rows: int = ROWS) -> None:
        kind = messages.schema["conv_id"].dataType.simpleString()
        order = ("conv", "turn", "role", "digest")
        ordered = faults(messages).repartitionByRange(*order).sortWithinPartitions(*order).drop("digest")
        blocks = written(ordered.mapInArrow(_gather(rows), f"conv {kind}, {_BLOCK_SQL}"))
        light = blocks.select("conv", "block", "costs", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "ends")
        self.met = written(light.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_meet, f"conv {kind}, {_MET_SQL}"))
        walked = blocks.select("conv", "block", "kinds", "n").join(self.met.select("block", "before", "after", "cost", "first", "last"), "block").mapInArrow(_walk, f"conv {kind}, {_WALKED_SQL}")
        chosen = walked.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_choose, f"conv {kind}, {_CHOSEN_SQL}")
        bodies = blocks.select("conv", "block", "kinds", "n", "roles", "texts").join(chosen.select("block", "letters", "later"), "block")
        self.edits = written(bodies.mapInArrow(_edit, f"conv {kind}, {_EDITED_SQL}"))
        drop(blocks)
        self.summary = self.met.where("first").select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def messages(self) -> DataFrame:
        """(conv_id, at, edit, role, text) of the repaired conversations; ``at`` grows along a conversation."""
        rows = self.edits.select(F.col("conv").alias("conv_id"), F.col("block"), F.posexplode("edits").alias("i", "e")).where("e.edit <> 'D'")
        return rows.select("conv_id", F.struct("block", "i").alias("at"), "e.edit", "e.role", "e.text")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Along each conversation: all letters, and the SHA-256 of its messages, taken block by block."""

    def digests(rows: Iterator[dict]) -> Iterator[dict]:
        conv, held, audit, any_ = None, None, [], False
        for r in rows:
            if held is None or conv != r["conv"]:
                if held is not None:
                    yield {"conv": conv, "audit": "".join(audit), "repaired_sha256": held.hexdigest()}
                conv, held, audit, any_ = r["conv"], sha256(), [], False
            audit.append(r["letters"])
            if r["body"] is not None:
                held.update((b"\n" if any_ else b"") + r["body"].encode())
                any_ = True
        if held is not None:
            yield {"conv": conv, "audit": "".join(audit), "repaired_sha256": held.hexdigest()}

    yield from _typed(batches, digests, [("audit", pa.string()), ("repaired_sha256", pa.string())])


def digests(repair: Repair) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of each conversation that has messages."""
    kind = repair.edits.schema["conv"].dataType.simpleString()
    letters = F.expr("array_join(transform(edits, e -> repeat(e.edit, cast(e.n as int))), '')")
    stays = F.expr("filter(edits, e -> e.edit <> 'D')")
    body = F.when(F.size(stays) > 0, F.array_join(F.transform(stays, lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n"))
    rows = repair.edits.select("conv", "block", letters.alias("letters"), body.alias("body"))
    out = rows.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_digest, f"conv {kind}, audit string, repaired_sha256 string")
    return out.withColumnRenamed("conv", "conv_id")


def damage(messages: DataFrame) -> DataFrame:
    """The query's damage: of each row by the CRC-32 of ``conv_id:turn``."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = messages.select("conv_id", "turn", say("role").alias("role"), say("text").alias("text"), (F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn"))) % 20).alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.expr("array_repeat(0, if(h = 3, 2, 1))"))).drop("col")


def op11_conversation_repair(spark, sf_dir):
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row for each conversation."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    repair = Repair(damage(given))
    found = repair.summary.withColumnRenamed("conv_id", "c")
    said = digests(repair).withColumnRenamed("conv_id", "c2")
    ids = given.select("conv_id").distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(said, F.col("conv_id").eqNullSafe(F.col("c2")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))
