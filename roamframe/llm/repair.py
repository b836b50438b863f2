"""Repair of conversations: the cheapest edits that make their roles take turns, with an audit of them.

Each row is kept, given another role, or deleted, and empty turns may be inserted anywhere, so that the
initials of the roles read ``(s?(ua)+)?``. What can come next is one of four states: nothing yet, after
the system's turn, after a user's, after an assistant's. The edits' initials are the audit; of the
cheapest audits the ASCII-least counts.

The audits of all states grow side by side and share what they have in common: a trail is a linked node
with its parent, the lengths and rolling hashes of all letters so far, and ancestors 1, 2, 4, ... nodes
up. Where two audits cost the same, their longest common prefix is searched by hashes of prefixes, the
letters behind it decide, and the prefix is compared letter by letter, so that a chance meeting of
hashes changes nothing. Two different audits of one state and one cost have the same rows behind them,
so neither begins with the other, and what follows cannot change their order.

A long conversation is cut into blocks of rows: each block gets, for every state before it and after it,
its cheapest audit, and only these pieces are linked in one place.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from roamframe.llm.ordering import in_order
from roamframe.ordered import step_block
from roamframe.storage import saved

#: Rows of one block.
BLOCK = 2048
#: What each edit costs, besides one more for a truncated row that is not deleted (fixed values).
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: Damage by remainder of a row's crc32 by 20 (fixed values).
DROP, EMPTY, UNEND, REPEAT, AS_USER = range(5)
SPACES = " \t\n\x0b\x0c\r"
#: A row's first fault.
SOUND, BLANK, COPY, CUT = range(4)

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {_START: "user", _SYSTEM: "user", _USER: "assistant", _ASSISTANT: "user"}
_AFTER = {_START: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_PRIME = (1 << 61) - 1
_BASE = 0x1F3D5B79A2C4E6


class Trail:
    """The letters of an audit: a piece, linked to what comes before it."""

    __slots__ = ("parent", "piece", "length", "hash", "jumps")

    def __init__(self, parent: Trail | None, piece: str):
        self.parent, self.piece = parent, piece
        self.length = (parent.length if parent else 0) + len(piece)
        self.hash = _rolled(parent.hash if parent else 0, piece)
        jumps = []
        up = parent
        while up is not None:
            jumps.append(up)
            # The ancestor 2^k up is 2^(k-1) up from the one 2^(k-1) up.
            up = up.jumps[len(jumps) - 1] if len(up.jumps) >= len(jumps) else None
        self.jumps = jumps

    def letters(self) -> str:
        pieces, at = [], self
        while at is not None:
            pieces.append(at.piece)
            at = at.parent
        return "".join(reversed(pieces))

    def prefix_hash(self, length: int) -> int:
        """Hash of the first ``length`` letters: climb to the piece that holds the last of them."""
        at = self
        for k in reversed(range(len(self.jumps))):
            while k < len(at.jumps) and at.jumps[k].length >= length:
                at = at.jumps[k]
        if at.length == length:
            return at.hash
        before = at.parent
        return _rolled(before.hash, at.piece[: length - before.length])

    def letter(self, place: int) -> str:
        """Letter number ``place``, from 0."""
        at = self
        for k in reversed(range(len(self.jumps))):
            while k < len(at.jumps) and at.jumps[k].length > place:
                at = at.jumps[k]
        return at.piece[place - (at.length - len(at.piece))]


def _rolled(value: int, piece: str) -> int:
    for letter in piece:
        value = (value * _BASE + ord(letter)) % _PRIME
    return value


def _apart(x: Trail, y: Trail) -> tuple[int, str, str]:
    """Letters that two trails share as nodes, and what each has behind them."""
    left, right = [], []
    while x is not y:
        if x.length > y.length or (x.length == y.length and x.parent is not None):
            left.append(x.piece)
            x = x.parent
        else:
            right.append(y.piece)
            y = y.parent
    return x.length, "".join(reversed(left)), "".join(reversed(right))


def less(x: Trail, y: Trail) -> bool:
    """Whether the letters of ``x`` come before those of ``y``."""
    if x is y:
        return False
    low, high = 0, min(x.length, y.length)
    while low < high:
        middle = (low + high + 1) // 2
        if x.prefix_hash(middle) == y.prefix_hash(middle):
            low = middle
        else:
            high = middle - 1
    shared, left, right = _apart(x, y)
    common = low - shared
    if left[: max(0, common)] != right[: max(0, common)]:
        return left < right
    if low == min(x.length, y.length):
        return x.length < y.length
    return x.letter(low) < y.letter(low)


ROOT = Trail(None, "")
States = dict[int, tuple[int, Trail]]


def _offer(states: States, state: int, cost: int, before: Trail, piece: str) -> None:
    """Put a way to ``state`` in place of what is there, if it is cheaper or reads before it."""
    held = states.get(state)
    if held is None or cost < held[0]:
        states[state] = cost, Trail(before, piece)
    elif cost == held[0]:
        trail = Trail(before, piece)
        if less(trail, held[1]):
            states[state] = cost, trail


def with_inserts(states: States) -> States:
    """The states, and those that one or two inserted turns lead to."""
    states = dict(states)
    for _ in range(2):
        for state in list(states):
            cost, trail = states[state]
            _offer(states, _AFTER[state], cost + INSERT, trail, "I")
    return states


def kept_state(state: int, initial: str) -> int | None:
    """The state after keeping a turn, or none if it can't stand there."""
    if initial == "s":
        return _SYSTEM if state == _START else None
    return _AFTER[state] if initial == _NEXT[state][0] else None


def with_row(states: States, initial: str, fault: int) -> States:
    """The states after one more row."""
    out: States = {}
    for state, (cost, trail) in with_inserts(states).items():
        _offer(out, state, cost + DELETE, trail, "D")
        if fault not in (BLANK, COPY):
            stays = cost + (TRUNCATED if fault == CUT else 0)
            to = kept_state(state, initial)
            if to is not None:
                _offer(out, to, stays, trail, "K")
            _offer(out, _AFTER[state], stays + REROLE, trail, "R")
    return out


def cheapest(states: States) -> tuple[int, Trail]:
    """The cheapest whole audit, the ASCII-least of these."""
    ends: States = {}
    for state, (cost, trail) in with_inserts(states).items():
        if state in (_START, _ASSISTANT):
            # One goal for both: the empty conversation, or an assistant's turn at its end.
            _offer(ends, _START, cost, trail, "")
    return ends[_START]


class Fixer:
    """Writes a repaired conversation to a digest, row by row, as its audit says."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.first, self.digest = audit, 0, _START, True, hashlib.sha256()

    def _write(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._write(_NEXT[self.state], "")
            self.state = _AFTER[self.state]
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._write(role, text)
            self.state = kept_state(self.state, role[:1])
        elif edit == "R":
            self._write(_NEXT[self.state], text)
            self.state = _AFTER[self.state]

    def closed(self) -> str:
        self._inserts()
        return self.digest.hexdigest()


def _plain(conversations: DataFrame) -> DataFrame:
    types = {"conv_id": "long", "turn": "long"}
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()], *texts)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with every row damaged, or not, as the crc32 of its id and turn says; nulls read as one space."""
    rows = _plain(conversations)
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name.cast("binary")) % 20
    text = F.when(kind == EMPTY, "").when(kind == UNEND, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        rows.select("conv_id", "turn", F.when(kind == AS_USER, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), kind.alias("kind"))
        .filter(F.col("kind") != DROP)
        .withColumn("again", F.explode(F.when(F.col("kind") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv_id", "turn", "role", "text")
    )


def faults(rows: DataFrame) -> DataFrame:
    """(conv, conv_id, place, initial, fault) of every row: its place in order, and its first fault.

    Rows go by conversation, turn (null first) and content; the same role and text in a conversation again
    is a copy, wherever it was seen first.
    """
    left = F.rtrim("text", F.lit(SPACES))
    narrow = rows.select(
        F.col("conv_id").isNotNull().cast("long").alias("_has"),
        F.coalesce("conv_id", F.lit(0)).alias("_conv"),
        "conv_id",
        "turn",
        "mark",
        F.substring("role", 1, 1).alias("initial"),
        (left == "").alias("blank"),
        (~F.substring(left, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    placed = in_order(narrow, ["_has", "_conv"], ["turn", "mark"]).withColumnRenamed("name", "conv").drop("turn")
    # Only what occurs more than once has a first place to be compared with.
    first = placed.groupBy("conv", "mark").agg(F.min("place").alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    fault = F.when(F.col("blank"), BLANK).when(F.col("place") > F.col("first"), COPY).when(F.col("cut"), CUT).otherwise(SOUND)
    return placed.join(first, ["conv", "mark"], "left").select("conv", "conv_id", "place", "initial", fault.alias("fault"))


_PIECES = (
    "conv bigint, conv_id bigint, block bigint, blank bigint, copies bigint, cut bigint, "
    "ways array<struct<before:int,after:int,cost:bigint,piece:string>>"
)


def _pieces(found: DataFrame) -> DataFrame:
    """Per block of a conversation, for each state before and after it, the cheapest audit of its rows."""
    size = BLOCK
    blocks = found.groupBy("conv", "conv_id", step_block("place", size).cast("long").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("place", "initial", "fault"))).alias("rows")
    )
    schema = to_arrow_schema(StructType.fromDDL(_PIECES))

    def work(batches):
        for batch in batches:
            out = []
            for conv, conv_id, block, rows in zip(*[batch.column(c).to_pylist() for c in ("conv", "conv_id", "block", "rows")]):
                ways, kinds = [], [0] * 4
                for row in rows:
                    kinds[row["fault"]] += 1
                # Places are numbered through all conversations: rows that begin inside a block begin their conversation.
                for before in [_START] if rows[0]["place"] % size else range(4):
                    states: States = {before: (0, ROOT)}
                    for row in rows:
                        states = with_row(states, row["initial"], row["fault"])
                    ways += [
                        {"before": before, "after": after, "cost": cost, "piece": trail.letters()}
                        for after, (cost, trail) in states.items()
                    ]
                out.append((conv, conv_id, block, kinds[BLANK], kinds[COPY], kinds[CUT], ways))
            yield _record(out, schema)

    return blocks.mapInArrow(work, _PIECES)


_AUDITS = "conv_id bigint, blank bigint, copies bigint, cut bigint, cost bigint, audit string"


def audits(found: DataFrame) -> DataFrame:
    """(conv_id, blank, copies, cut, cost, audit) per conversation, from the rows that ``faults`` gives."""
    schema = to_arrow_schema(StructType.fromDDL(_AUDITS))
    names = ["conv", "conv_id", "blank", "copies", "cut", "ways"]

    def link(batches):
        open_conv, states, told = None, None, None

        def closed():
            cost, trail = cheapest(states)
            return (*told, cost, trail.letters())

        for batch in batches:
            out = []
            for conv, conv_id, blank, copies, cut, ways in zip(*[batch.column(c).to_pylist() for c in names]):
                if conv != open_conv:
                    if told:
                        out.append(closed())
                    open_conv, states, told = conv, {_START: (0, ROOT)}, [conv_id, 0, 0, 0]
                told = [conv_id, told[1] + blank, told[2] + copies, told[3] + cut]
                after: States = {}
                for way in ways:
                    held = states.get(way["before"])
                    if held is not None:
                        _offer(after, way["after"], held[0] + way["cost"], held[1], way["piece"])
                states = after
            yield _record(out, schema)
        if told:
            yield _record([closed()], schema)

    return _pieces(found).repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(link, _AUDITS)


_REPAIRED = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)
_LEGAL = {"su", "ua", "au"}


def repair(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows of a conversation go by turn, null first, and rows of one turn by their content's hash. A null
    role or text reads as one space; rows with a null conv_id are one conversation. gaps counts turn
    numbers missing between the first and the last, without nulls. ``ids`` may name conversations (conv_id)
    that have no rows: they get zeros, an empty audit and the digest of the empty text, as does a
    conversation of which nothing stays. Other columns are ignored, whatever their names. An empty table
    gives the rows of ``ids``.

    The last step reads each conversation in order, one row at a time, as its digest has no other order.
    """
    rows = _plain(conversations)
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.withColumn("mark", F.unhex(F.sha2(content.cast("binary"), 256)))
    found = saved(faults(rows), "faults")
    head = "conv_id bigint, kind int, turn bigint, mark binary, role string, text string, blank bigint, copies bigint, cut bigint, cost bigint"
    columns = [c.split() for c in head.split(", ")]

    def part(df: DataFrame, kind: int, **given: Column) -> DataFrame:
        given = {c: F.col(c) for c in df.columns} | given | {"kind": F.lit(kind)}
        return df.select(*[given.get(name, F.lit(None)).cast(kind_of).alias(name) for name, kind_of in columns])

    known = rows.select("conv_id") if ids is None else ids.select(F.col("conv_id").cast("long").alias("conv_id"))
    told = part(audits(found), 1, text=F.col("audit"))
    together = part(known.distinct(), 0).union(told).union(part(rows, 2))
    names = [name for name, _ in columns if name != "mark"]
    schema = to_arrow_schema(StructType.fromDDL(_REPAIRED))

    def fix(batches):
        row = None
        for batch in batches:
            out = []
            for conv_id, kind, *values in zip(*[batch.column(n).to_pylist() for n in names]):
                if row is None or conv_id != row.conv_id:
                    if row is not None:
                        out.append(row.closed())
                    row = _Conversation(conv_id)
                row.take(kind, *values)
            yield _record(out, schema)
        if row is not None:
            yield _record([row.closed()], schema)

    ordered = together.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "mark")
    return ordered.select(*names).mapInArrow(fix, _REPAIRED)


class _Conversation:
    """Counts and the repaired digest of one conversation, fed with its audit, then its rows in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.told, self.audit, self.fixer = conv_id, (0, 0, 0, 0), "", Fixer("")
        self.first = self.last = self.initial = None
        self.turns = self.illegal = 0

    def take(self, kind: int, turn, role, text, blank, copies, cut, cost) -> None:
        if kind == 1:
            self.told, self.audit, self.fixer = (blank, copies, cut, cost), text, Fixer(text)
        elif kind == 2:
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last, self.turns = turn, self.turns + 1
            if self.initial is not None and self.initial + role[:1] not in _LEGAL:
                self.illegal += 1
            self.initial = role[:1]
            self.fixer.row(role, text)

    def closed(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        blank, copies, cut, cost = self.told
        return self.conv_id, gaps, blank, copies, cut, self.illegal, cost, self.audit, self.fixer.closed()


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows, with a row for every conversation there was before."""
    return repair(damaged(conversations), conversations)
