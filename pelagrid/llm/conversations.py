"""Conversation repair: the cheapest edits that give well-formed turns, by a checkpointed DP."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ranks import ranked
from ..session import written

# White space, what ends a text, and the costs of the edits.
SPACE = " \t\n\x0b\x0c\r"
ENDINGS = (".", "!", "?")
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
FAR = 2**60

# States of (s?(ua)+)? and the one role that may follow each: at the start, after s, after u, after a.
FOLLOWS = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
# Cheapest way to an end from each state: nothing, or the turns that lack.
AT_END = (0, 2 * INSERT, INSERT, 0)
STATES = range(4)


class Repaired:
    """Conversations with the cheapest edits that make their role initials (s?(ua)+)?.

    `rows` holds one turn a row; a null role or text counts as one space. The turns of a conversation
    are taken by turn, nulls first; those of one turn by role and a hash of their text. Rows that
    are equal stay rows of their own. Null ids are one conversation. Columns besides
    the four named play no part. The first fault of a turn counts: blank (no
    character but white space), duplicate (role and text of an earlier turn), truncated (last
    character but white space is none of .!?). Keeping a turn costs 0, giving it the role user or
    assistant 3, deleting it 4, an inserted turn without text 3, and a truncated turn that is not deleted 3 more;
    blank and duplicate turns are deleted. Of equally cheap edits the least row of initials counts.

    A conversation of n turns is cut into blocks of ceil(sqrt(n)) turns. Backward costs are kept
    at the block borders alone: what a block does to them is a 4 by 4 matrix, and the matrices of a
    conversation, sqrt(n) of them, give all borders. Each block is then walked forward on its
    own, from each state it may be entered in, with its inner costs computed again; last the
    entries are chained. No task or group holds more than sqrt(n) turns or blocks of one conversation.

    faults   conv, turns, blank, duplicate, truncated
    edits    conv, cost, illegal, audit: initials of the edits in order
    turns()  the repaired turns
    conv is the key, a text: "=" and the id, or " " for a null id. A table without rows gives tables without rows.
    """

    def __init__(self, rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self._turns = _flagged(written(_placed(rows, conv_id, turn, role, text)))
        marks = self._turns.select("conv", "block", "at", _mark().alias("mark"), _initial().alias("initial"))
        blocks = written(marks.groupBy("conv", "block").agg(*[
            _in_order("at", c).alias(f"{c}s") for c in ("mark", "initial")]))
        matrices = blocks.mapInArrow(_matrices, "conv string, block long, ends string, illegal long, costs array<long>")
        listed = matrices.groupBy("conv").agg(
            F.array_sort(F.collect_list(F.struct("block", "ends", "illegal", "costs"))).alias("blocks"))
        borders = written(listed.mapInArrow(_borders, "conv string, block long, last boolean, after array<long>, cost long, illegal long"))
        walks = blocks.join(borders, ["conv", "block"]).select("conv", "block", "marks", "last", "after")
        walked = written(walks.mapInArrow(_walks, "conv string, block long, audits array<string>, exits array<int>"))
        steps = walked.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "exits"))).alias("blocks"))
        entries = steps.mapInArrow(_entries, "conv string, block long, entry int")
        self._audits = written(walked.join(entries, ["conv", "block"]).select(
            "conv", "block", "entry", F.element_at("audits", F.col("entry") + 1).alias("audit")))
        ends = borders.where("block = 0").select("conv", "cost", "illegal")
        self.edits = self._audits.groupBy("conv").agg(_in_order("block", "audit").alias("audit")).join(ends, "conv")
        self.faults = self._turns.groupBy("conv").agg(
            F.count("*").alias("turns"), F.count_if("blank").alias("blank"),
            F.count_if("duplicate").alias("duplicate"), F.count_if("truncated").alias("truncated"))

    def turns(self) -> DataFrame:
        """conv, at, part, role, text of each turn there is after the edits, in the order
        of (at, part) within its conversation. Each block is replayed on its own."""
        nothing = F.lit(None)
        audits = self._audits.select("conv", "block", F.lit(-1).cast("bigint").alias("at"), "audit", "entry",
                                     nothing.cast("string").alias("role"), nothing.cast("string").alias("text"))
        turns = self._turns.select("conv", "block", "at", nothing.cast("string").alias("audit"),
                                   nothing.cast("int").alias("entry"), "role", "text")
        both = audits.unionByName(turns).repartition("conv", "block").sortWithinPartitions("conv", "block", "at")
        return both.mapInArrow(_replayed, "conv string, at long, part int, role string, text string")


def _in_order(place: str, text: str) -> Column:
    """The texts of a group as one, by their places."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, text))), lambda r: r[text]), "")


def key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(" "))


def _placed(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, role, text, at (position in its conversation), block. Positions are
    global ranks less the first of the conversation."""
    named = rows.select(
        key(F.col(f"`{conv_id}`")).alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("row"))
    ranks = ranked(named, [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text"), F.col("row")], "rank")
    sizes = ranks.groupBy("conv").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    at = F.col("rank") - F.col("first")
    block = F.floor(at / F.ceil(F.sqrt("n"))).cast("bigint")
    return ranks.join(sizes, "conv").select("conv", "role", "text", at.alias("at"), block.alias("block"))


def _flagged(turns: DataFrame) -> DataFrame:
    """The turns with their first fault. Where role and text repeat, the least position is one row."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    hashed = turns.withColumns({"blank": last == "", "whole": last.isin(*ENDINGS), "hash": F.sha2("text", 256)})
    firsts = hashed.groupBy("conv", "role", "hash").agg(F.min("at").alias("earliest"))
    again = ~F.col("blank") & (F.col("at") > F.col("earliest"))
    return hashed.join(firsts, ["conv", "role", "hash"]).select(
        "conv", "block", "at", "role", "text", "blank", again.alias("duplicate"),
        (~F.col("blank") & ~again & ~F.col("whole")).alias("truncated"))


def _initial() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def _mark() -> Column:
    """x for what must go, else the initial, in upper case where truncated."""
    return F.when(F.col("blank") | F.col("duplicate"), "x").when(F.col("truncated"), F.upper(_initial())).otherwise(_initial())


def step(mark: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from before a turn on, per state, given those after it."""
    best = []
    for s in STATES:
        cost = DELETE + after[s]
        if mark != "x":
            more = CUT_OFF if mark.isupper() else 0
            to = KEEPS.get(mark.lower(), {}).get(s)
            if to is not None:
                cost = min(cost, more + after[to])
            cost = min(cost, more + REROLE + after[FOLLOWS[s][0]])
        best.append(cost)
    # Insertions before the turn; a circle of them never pays.
    u, a = min(best[2], INSERT + best[3]), min(best[3], INSERT + best[2])
    return min(best[0], INSERT + u), min(best[1], INSERT + u), u, a


def walk(marks: str, after: tuple[int, ...], entry: int, last: bool) -> tuple[str, int]:
    """Least initials of the cheapest edits of a block entered in a state, and the state it is
    left in; the last block goes on to an end."""
    costs = [after]
    for mark in reversed(marks):
        costs.append(step(mark, costs[-1]))
    costs.reverse()
    out, s = [], entry
    for i, mark in enumerate(marks):
        while True:
            left, then = costs[i][s], costs[i + 1]
            if left == DELETE + then[s]:
                out.append("D")
                break
            if left == INSERT + costs[i][FOLLOWS[s][0]]:
                out.append("I")
                s = FOLLOWS[s][0]
                continue
            more = CUT_OFF if mark.isupper() else 0
            to = KEEPS.get(mark.lower(), {}).get(s)
            if to is not None and left == more + then[to]:
                out.append("K")
                s = to
            else:
                out.append("R")
                s = FOLLOWS[s][0]
            break
    while last and AT_END[s]:
        out.append("I")
        s = FOLLOWS[s][0]
    return "".join(out), s


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        # Row by row: a batch may hold long texts.
        for i in range(batch.num_rows):
            yield {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some thousand, or of some million characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= 4096 or size > 4_000_000:
            yield _batch(held, names, types)
            held, size = [], 0
    if held:
        yield _batch(held, names, types)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


LONG, TEXT = pa.int64(), pa.string()


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block costs from each state to each other one."""
    def rows():
        for r in _rows(batches):
            columns = []
            for end in STATES:
                costs = tuple(0 if s == end else FAR for s in STATES)
                for mark in reversed(r["marks"]):
                    costs = step(mark, costs)
                columns.append(costs)
            initials = r["initials"]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            yield r["conv"], r["block"], initials[0] + initials[-1], illegal, [columns[t][s] for s in STATES for t in STATES]

    return _batched(rows(), ["conv", "block", "ends", "illegal", "costs"], [TEXT, LONG, TEXT, LONG, pa.list_(LONG)])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs after each block of a conversation; with its first block what holds for the whole."""
    def rows():
        for r in _rows(batches):
            blocks = r["blocks"]
            after, kept = AT_END, []
            for b in reversed(blocks):
                kept.append(after)
                after = tuple(min(b["costs"][4 * s + t] + after[t] for t in STATES) for s in STATES)
            illegal = sum(b["illegal"] for b in blocks) + sum(
                a["ends"][1] + b["ends"][0] not in ("su", "ua", "au") for a, b in zip(blocks, blocks[1:]))
            for i, (b, costs) in enumerate(zip(blocks, reversed(kept))):
                yield r["conv"], b["block"], i == len(blocks) - 1, list(costs), *((after[0], illegal) if i == 0 else (None, None))

    return _batched(rows(), ["conv", "block", "last", "after", "cost", "illegal"],
                    [TEXT, LONG, pa.bool_(), pa.list_(LONG), LONG, LONG])


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for r in _rows(batches):
            ways = [walk(r["marks"], tuple(r["after"]), s, r["last"]) for s in STATES]
            yield r["conv"], r["block"], [w[0] for w in ways], [w[1] for w in ways]

    return _batched(rows(), ["conv", "block", "audits", "exits"], [TEXT, LONG, pa.list_(TEXT), pa.list_(pa.int32())])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for r in _rows(batches):
            state = 0
            for b in r["blocks"]:
                yield r["conv"], b["block"], state
                state = b["exits"][state]

    return _batched(rows(), ["conv", "block", "entry"], [TEXT, LONG, pa.int32()])


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through the sorted blocks of a task: the audit of each comes first, then its turns."""
    def rows():
        conv, at, state, edits = None, -1, 0, iter("")

        def inserted(part: int) -> tuple:
            return conv, at, part, FOLLOWS[state][1], ""

        for r in _rows(batches):
            if r["audit"] is not None:
                # What is left of the block before stands after its last turn.
                for part, _ in enumerate(edits, 4):
                    yield inserted(part)
                    state = FOLLOWS[state][0]
                conv, state, edits = r["conv"], r["entry"], iter(r["audit"])
                continue
            at = r["at"]
            for part, edit in enumerate(edits):
                if edit == "I":
                    yield inserted(part)
                    state = FOLLOWS[state][0]
                    continue
                if edit == "K":
                    yield conv, at, part, r["role"], r["text"]
                    state = KEEPS[r["role"][0]][state]
                elif edit == "R":
                    yield conv, at, part, FOLLOWS[state][1], r["text"]
                    state = FOLLOWS[state][0]
                break
        for part, _ in enumerate(edits, 4):
            yield inserted(part)
            state = FOLLOWS[state][0]

    return _batched(rows(), ["conv", "at", "part", "role", "text"], [TEXT, LONG, pa.int32(), TEXT, TEXT])


def hashed(turns: DataFrame) -> DataFrame:
    """conv, sha256 of its `role:text` lines. One hash runs over all of a conversation, so its
    turns pass through one task, in order and one at a time."""
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            conv, so_far = None, None
            for r in _rows(found):
                if r["conv"] != conv:
                    if so_far:
                        yield conv, so_far.hexdigest()
                    conv, so_far = r["conv"], hashlib.sha256()
                else:
                    so_far.update(b"\n")
                so_far.update(f"{r['role']}:{r['text']}".encode("utf-8", "surrogatepass"))
            if so_far:
                yield conv, so_far.hexdigest()

        return _batched(rows(), ["conv", "sha256"], [TEXT, TEXT])

    return turns.repartition("conv").sortWithinPartitions("conv", "at", "part").mapInArrow(batches, "conv string, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that the query plants, by CRC-32 of `conv_id:turn`."""
    space = F.lit(" ")
    id, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    named = F.concat(id, F.lit(":"), turn)
    code = F.crc32(named.cast("binary")) % 20
    text = F.coalesce("text", space)
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(code == 4, "user").otherwise(F.coalesce("role", space))
    copies = F.array_repeat(F.lit(0), F.when(code == 3, 2).otherwise(1).cast("int"))
    return rows.where(code != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def digest(rows: DataFrame) -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    found = written(damaged(rows))
    done = Repaired(found)
    ids = rows.groupBy("conv_id").count().select("conv_id", key(F.col("conv_id")).alias("conv"))
    turn = F.col("turn").cast("decimal(20,0)")
    between = F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)
    gaps = found.groupBy(key(F.col("conv_id")).alias("conv")).agg(
        F.least(F.coalesce(between, F.lit(0)), F.lit(2**63 - 1).cast("decimal(20,0)")).cast("bigint").alias("gaps"))
    sums = hashed(done.turns()).withColumnRenamed("sha256", "repaired_sha256")
    joined = ids
    for more in (gaps, done.faults, done.edits, sums):
        joined = joined.join(more, "conv", "left")
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
