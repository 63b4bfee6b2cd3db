"""Repair of damaged conversations by the cheapest edits (operator 12).

A repaired conversation is empty, or an optional system turn and then one or more pairs of user and assistant. Rows
are kept, given another role, deleted, or new ones with an empty text are put in; blank and duplicate rows must go.
The cheapest edits follow from a dynamic program over the rows with four states: nothing yet, after the system turn,
after a user, after an assistant.

The program is checkpointed. A first pass reads a conversation's rows backward (their symbols only) and holds one
vector of four costs; it keeps the vector at the end of every block of about sqrt(n) rows, with the block's symbols.
A second pass reads the rows forward: at each block it makes the block's vectors again from its checkpoint, then
walks forward through them. Among the edits that are tight (that reach the least cost) it takes the first in ASCII
order at each step, which gives the ASCII-least audit. Both passes are streams over sorted rows: a worker holds
about 2 sqrt(n) vectors and symbols, never the rows of a conversation or their texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runscope.llm.common import cut, map_batches

#: Costs of the edits; an undeleted truncated row costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may be put in, or what a row's role may become, in each state: the next state. There is one way in each.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What a kept row leads to, by state and by the row's initial (0 for none of s, u, a).
_KEEP = {(START, "s"): SYSTEM, **{(q, "u"): USER for q in (START, SYSTEM, ASSISTANT)}, (USER, "a"): ASSISTANT}
_NEVER = 1 << 60
#: Symbols of rows: those that must go; all others by the role's initial (x for none of s, u, a), upper case if truncated.
BLANK, DUPLICATE = "-", "="

WHITE = " \t\n\x0b\x0c\r"


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs to the end by state, once rows may be put in first: two steps reach all that can help."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[_NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


_END = _with_inserts([0, _NEVER, _NEVER, 0])


def _edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row, in ASCII order of the letters."""
    out = [("D", DELETE, state)]
    if symbol not in (BLANK, DUPLICATE):
        initial = symbol.lower()
        more = TRUNCATED if symbol.isupper() else 0
        if (state, initial) in _KEEP:
            out.append(("K", more, _KEEP[state, initial]))
        out.append(("R", REROLE + more, _NEXT[state]))
    return out


_EDITS = {s: [_edits(s, q) for q in range(4)] for s in "suaxSUAX" + BLANK + DUPLICATE}


def before_row(symbol: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """The cost vector before a row, from the one after it."""
    return _with_inserts([min(cost + after[to] for _, cost, to in edits) for edits in _EDITS[symbol]])


def walk(symbols: str, after: tuple[int, ...], state: int) -> Iterator[tuple[str, int]]:
    """For each row of a block: the letters of the rows put in before it and its own, and the state after it."""
    vectors = [after]
    for symbol in reversed(symbols):
        vectors.append(before_row(symbol, vectors[-1]))
    for symbol in symbols:
        now, letters = vectors.pop(), ""
        while True:
            letter, cost, to = _EDITS[symbol][state][0]
            if now[state] == cost + vectors[-1][to]:  # D comes before I
                break
            if now[state] == INSERT + now[_NEXT[state]]:
                letters, state = letters + "I", _NEXT[state]
                continue
            letter, cost, to = next(e for e in _EDITS[symbol][state] if now[state] == e[1] + vectors[-1][e[2]])
            break
        state = to
        yield letters + letter, state


_CHECKPOINT = pa.schema([("conv_id", pa.int64()), ("id", pa.int64()), ("symbols", pa.string()),
                         ("after", pa.list_(pa.int64()))])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations, each from its last to its first, to one checkpoint a block."""
    vector, block, after, out = _END, [], _END, []
    for batch in batches:
        for conv_id, row, pos, n, symbol in zip(*(batch.column(c).to_pylist() for c in
                                                  ("conv_id", "id", "pos", "n", "symbol"))):
            if pos == n - 1:
                vector = after = _END
            block.append(symbol)
            vector = before_row(symbol, vector)
            if pos % (math.isqrt(n - 1) + 1) == 0:
                out.append({"conv_id": conv_id, "id": row, "symbols": "".join(reversed(block)), "after": after})
                block, after = [], vector
        yield pa.RecordBatch.from_pylist(out, schema=_CHECKPOINT)
        out = []


_OUT = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                  ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
                  ("repaired_sha256", pa.string())])
_RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string, repaired_sha256 string")


class _Conversation:
    """What a worker knows of the conversation whose rows pass by."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = 0
        self.first_turn = self.last_turn = self.initial = None
        self.state, self.audit, self.sha, self.lines = START, [], hashlib.sha256(), 0
        self.plan: Iterator[tuple[str, tuple[str, int]]] = iter(())

    def _line(self, role: str, text: str) -> None:
        self.sha.update(("\n" * (self.lines > 0) + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _insert(self, letters: str) -> None:
        for _ in letters:
            self.state = _NEXT[self.state]
            self._line(_ROLE[self.state], "")
            self.cost += INSERT

    def row(self, turn, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        symbol, (letters, state) = next(self.plan)
        self.blank += symbol == BLANK
        self.duplicate += symbol == DUPLICATE
        self.truncated += symbol.isupper()
        self._insert(letters[:-1])
        if letters[-1] == "D":
            self.cost += DELETE
        else:
            self.cost += REROLE * (letters[-1] == "R") + TRUNCATED * symbol.isupper()
            self._line(_ROLE[state] if letters[-1] == "R" else role, text)
        self.state = state
        self.audit.append(letters)

    def result(self, conv_id) -> tuple:
        # Rows put in after the last one: the same choice of the tight edits, with no row left.
        while self.state not in (START, ASSISTANT):
            self.audit.append("I")
            self._insert("I")
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return (conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
                "".join(self.audit), self.sha.hexdigest())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), _OUT)], schema=_OUT)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in order: a mark of each (step 0), its checkpoints (1) before the rows (2) of their blocks."""
    names = ("step", "conv_id", "turn", "role", "text", "symbols", "after")
    current, conv_id = None, None
    for batch in batches:
        done = []
        for step, conv, turn, role, text, symbols, after in zip(*(batch.column(c).to_pylist() for c in names)):
            if step == 0:
                if current:
                    done.append(current.result(conv_id))
                current, conv_id = _Conversation(), conv
            elif step == 1:
                current.plan = zip(symbols, walk(symbols, tuple(after), current.state))
            else:
                current.row(turn, role, text)
        if done:
            yield _batch(done)
    if current:
        yield _batch([current.result(conv_id)])


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows with the query's damage: a row's fate is crc32(`conv_id:turn`) modulo 20. 0:
    dropped; 1: no text; 2: without ``.!?``; 3: there twice; 4: role user. Nulls in the key, role and text are one
    space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), space).alias("role"),
                       F.coalesce(F.col("text").cast("string"), space).alias("text"),
                       (F.crc32(key.cast("binary")) % 20).alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(
        F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fate") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                       F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def _sorted(rows: DataFrame, name: str) -> DataFrame:
    """Rows in the order (conv_id, turn, role, text digest), written, with ``id``, which ascends in that order. The sort
    is by ranges of the whole key, so a conversation that holds most rows is spread over many tasks."""
    order = ["conv_id", "turn", "role", "digest", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    return cut(rows.withColumn("id", F.monotonically_increasing_id()), name)


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pos``, the place in the conversation, and ``n``, its rows. Only the counts of (range,
    conversation) pairs are added up in windows."""
    parts = rows.groupBy("conv_id", F.shiftright("id", 33).alias("part")).agg(
        F.min("id").alias("start"), F.count("*").alias("own"))
    of_conv = Window.partitionBy("conv_id")
    before = of_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.sum("own").over(of_conv).alias("n"),
                         (F.coalesce(F.sum("own").over(before), F.lit(0)) - F.col("start")).alias("shift"))
    rows = rows.join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.shiftright("id", 33) == F.col("p")))
    return rows.withColumn("pos", F.col("id") + F.col("shift")).drop("c", "p", "shift")


def repair(conversations: DataFrame, all_ids: DataFrame | None = None, name: str = "conversations") -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Only conv_id, turn, role and text are read. Rows go by turn, null turns first; rows of one turn by role, then by a
    digest of the text, so that equal rows are neighbours. Null roles and texts are one space. A
    null conv_id is a conversation of its own. ``all_ids`` may name further conversations (conv_id), which have no
    rows: zeros, an empty audit, the digest of nothing. An empty table without them gives an empty result.

    gaps: turns that are missing between the first and the last one. blank, duplicate (role and text seen earlier) and
    truncated (the last character that is not white space is none of ``.!?``) count rows by their first fault;
    illegal counts neighbours whose roles' initials are not su, ua or au. audit holds the initials of the cheapest
    edits Keep, Rerole, Delete and Insert, of several the ASCII-least; cost is theirs. repaired_sha256 is the digest
    of the repaired ``role:text`` rows, joined by line feeds.
    """
    space = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("text", 256)), "row": F.monotonically_increasing_id()})
    rows = _sorted(rows, name)

    # The first of equal rows, where there are several: an aggregate, so a row that stands very often is two numbers
    # a task. Only digests move.
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min("id").alias("first"), F.count("*").alias("same"))
    first = first.where("same > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"),
                                           F.col("digest").alias("d"), "first")
    narrow = _placed(rows.select("conv_id", "id", "role", "digest",
                                 F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1)).alias("last")))
    narrow = narrow.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                         & (F.col("digest") == F.col("d")), "left")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(F.col("last") == "", BLANK).when(F.col("id") > F.col("first"), DUPLICATE).when(
        ~F.col("last").isin(".", "!", "?"), F.upper(initial)).otherwise(initial)
    backward = narrow.select("conv_id", "id", "pos", "n", symbol.alias("symbol")).repartition("conv_id")
    checkpoints = map_batches(backward.sortWithinPartitions("conv_id", F.desc("id")), _backward,
                              "conv_id long, id long, symbols string, after array<long>")
    checkpoints = cut(checkpoints, name)

    ids = rows.select("conv_id")
    if all_ids is not None:
        ids = ids.union(all_ids.select(F.col("conv_id").cast("long")))
    marks = ids.distinct().select("conv_id", F.lit(-1).cast("long").alias("id"), F.lit(0).alias("step"))
    stream = marks.unionByName(checkpoints.withColumn("step", F.lit(1)), allowMissingColumns=True).unionByName(
        rows.select("conv_id", "id", "turn", "role", "text", F.lit(2).alias("step")), allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "id", "step")
    return map_batches(stream.select("step", "conv_id", "turn", "role", "text", "symbols", "after"), _forward, _RESULT)
