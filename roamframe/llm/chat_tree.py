"""Conversations as a prefix tree: turns that conversations have in common at their start are written once.

A node is a turn with all turns before it; conversations that begin alike share nodes. Each conversation
whose first turn is the same belongs to one tree, which is written as one stream of tokens, depth first.
A node's position ids count from the start of its conversation, not of the stream, and its attention
reaches the intervals of the stream that hold its ancestors.

The walk never visits nodes one after another. Of a node's children the one with the most conversations
is its heavy child; a node that isn't one starts a chain, which goes on with heavy children to a leaf. A
chain is one piece of the stream, and the pieces are in depth-first order when sorted by the list of
(depth, first node) of the chains that lead to them, the deepest branch first. A path enters at most
log2 of the conversations chains besides its first, which bounds that list and a token's intervals.

A token is a code point of the formatted text, so that every text can be read back from the tokens.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from roamframe.llm.ordering import in_order
from roamframe.ordered import BLOCK, last_value, row_number, running_sum, step_block, with_ordered
from roamframe.storage import saved

#: Control strings of the template (fixed values): an assistant's turn is <s>text</s>, any other [INST]role, line feed, text[/INST].
SAY, SAID, ASK, ASKED = "<s>", "</s>", "[INST]", "[/INST]"
CONTROL = r"</?s>|\[/?INST\]"
ASSISTANT = "assistant"
#: Digits of a turn's hash in each of the two running sums: together 120 bits.
_DIGITS = 15
_DEEP = 1 << 40

_MARK = re.compile(rf"\\(\\|\n|{CONTROL})|({CONTROL})")


def escaped(text: Column, line: bool = False) -> Column:
    """``text`` with a backslash before each control string and backslash; ``line`` does so for line feeds too."""
    return F.regexp_replace(text, rf"(\\|{CONTROL}{'|' + chr(10) if line else ''})", r"\\$1")


def formatted(role: Column, text: Column) -> Column:
    """A turn as the template writes it."""
    other = F.concat(F.lit(ASK), escaped(role, line=True), F.lit("\n"), escaped(text), F.lit(ASKED))
    return F.when(role == ASSISTANT, F.concat(F.lit(SAY), escaped(text), F.lit(SAID))).otherwise(other)


def unescaped(text: str) -> str:
    return _MARK.sub(lambda m: m[1] if m[1] is not None else m[0], text)


def parsed(segment: str) -> tuple[str, str]:
    """(role, text) of a turn that the template wrote."""
    controls = [m for m in _MARK.finditer(segment) if m[2]]
    kinds = [m[2] for m in controls]
    if kinds not in ([SAY, SAID], [ASK, ASKED]) or controls[0].start() or controls[1].end() != len(segment):
        raise ValueError(f"not a formatted turn: {segment[:80]!r}")
    inner = segment[controls[0].end() : controls[1].start()]
    if kinds[0] == SAY:
        return ASSISTANT, unescaped(inner)
    # The role ends at the first line feed without a backslash.
    at = next(m.start() for m in re.finditer(r"\\.|\n", inner, re.DOTALL) if m[0] == "\n")
    return unescaped(inner[:at]), unescaped(inner[at + 1 :])


@dataclass(frozen=True)
class ChatTree:
    """``segments``: one row per node of all trees; ordered by (tree, start) they are the streams.

    tree, start (offset in the stream of its tree), size, position (position id of its first token), chain,
    depth, text (formatted), loss_start and loss_end (offsets in the stream between which tokens count for
    the loss; null for other roles), sees (intervals of the stream that its tokens attend to; the last one
    holds the segment itself, of which a token sees what is before it) and shared (how many conversations).

    ``paths``: one row per conversation: conv, conv_id, turns, tokens, tree, and chains, an array of (first,
    last, chain, start, end): the depths on a chain and the interval of the stream that holds them. In
    order, the intervals hold the whole conversation and nothing else.
    """

    segments: DataFrame
    paths: DataFrame


def _lane(first: int) -> Column:
    """A hash of a turn and its depth: sums of it tell sequences of turns apart."""
    digest = F.sha2(F.concat(F.col("depth").cast("string").cast("binary"), F.lit(b":"), F.col("mark")), 256)
    return F.conv(F.substring(digest, first, _DIGITS), 16, 10).cast("decimal(38,0)")


def _turns(known: DataFrame) -> DataFrame:
    """Every row with its conversation's number, depth, first position id, and two sums that name its beginning."""
    turns = known.select(
        "conv_id",
        F.col("conv_id").isNotNull().cast("long").alias("_has"),
        F.coalesce("conv_id", F.lit(0)).alias("_conv"),
        "turn",
        "mark",
        F.length(formatted(F.col("role"), F.col("text"))).cast("long").alias("size"),
    )
    turns = in_order(turns, ["_has", "_conv"], ["turn", "mark"]).withColumnRenamed("name", "conv").drop("turn")
    along = {"keys": ["conv"], "order": ["place"], "block": step_block("place")}
    turns = with_ordered(turns, **along, ops={"depth": row_number(), "position": running_sum("size")})
    turns = turns.withColumns({"depth": F.col("depth").cast("long") - 1, "position": F.col("position") - F.col("size")})
    turns = saved(turns.withColumns({"own_a": _lane(1), "own_b": _lane(1 + _DIGITS)}), "turns")
    return saved(with_ordered(turns, **along, ops={"a": running_sum("own_a"), "b": running_sum("own_b")}), "turns")


def _nodes(turns: DataFrame) -> DataFrame:
    """(depth, a, b, node, shared, light) of every distinct beginning; its number is its first row's place."""
    alike = F.when(F.min("mark") == F.max("mark"), F.min("place")).otherwise(F.raise_error(F.lit("two beginnings share their sums")))
    nodes = saved(
        turns.groupBy("depth", "a", "b").agg(
            alike.cast("long").alias("node"), F.count("*").alias("shared"), F.max("own_a").alias("own_a"), F.max("own_b").alias("own_b")
        ),
        "nodes",
    )
    parent = [F.col("depth").alias("over"), (F.col("a") - F.col("own_a")).alias("over_a"), (F.col("b") - F.col("own_b")).alias("over_b")]
    heavy = (
        nodes.filter("depth > 0")
        .groupBy(*parent)
        .agg(F.max_by("node", F.struct("shared", -F.col("node"))).alias("node"))
        .select("node", F.lit(True).alias("heavy"))
    )
    return nodes.join(heavy, "node", "left").select("depth", "a", "b", "node", "shared", F.col("heavy").isNull().alias("light"))


def _heads(placed: DataFrame, roads: DataFrame) -> DataFrame:
    """(chain, tree, begins, start) of every chain: the position id of its first token and its place in the stream."""
    heads = (
        roads.select("road", F.explode("road").alias("head"))
        .filter("head.owner")
        .select("head.chain", "head.begins", F.filter("road", lambda p: p["first"] <= F.col("head")["first"]).alias("road"))
    )
    ends = placed.filter("place = node").groupBy("chain").agg(F.max(F.col("position") + F.col("size")).alias("end"))
    pair = lambda p: F.concat(*[F.lpad(F.hex(c), 16, "0") for c in (F.lit(_DEEP) - p["first"], p["chain"])])
    heads = heads.join(ends, "chain").select(
        "chain",
        F.col("road")[0]["chain"].alias("tree"),
        "begins",
        (F.col("end") - F.col("begins")).alias("tokens"),
        F.unhex(F.array_join(F.transform("road", pair), "")).alias("key"),
    )
    heads = in_order(heads, ["key"], ["chain"]).drop("name")
    heads = with_ordered(heads, ["tree"], ["place"], step_block("place"), {"start": running_sum("tokens")})
    return saved(heads.select("chain", "tree", "begins", (F.col("start") - F.col("tokens")).alias("start")), "heads")


def _paths(placed: DataFrame, roads: DataFrame, heads: DataFrame) -> DataFrame:
    """``paths`` of a ChatTree, and of each entry of chains whether its chain's first row is the conversation's."""
    about = placed.groupBy("conv").agg(
        F.max("conv_id").alias("conv_id"), F.count("*").alias("turns"), F.max(F.col("position") + F.col("size")).alias("tokens")
    )
    following = F.element_at("road", F.col("i") + 2)
    parts = (
        roads.join(about, "conv")
        .select("conv", "conv_id", "turns", "tokens", "road", F.posexplode("road").alias("i", "head"))
        .select(
            "conv",
            "conv_id",
            "turns",
            "tokens",
            "head.*",
            F.coalesce(F.when(F.col("i") + 1 < F.size("road"), following["first"]), F.col("turns")).alias("until"),
            F.coalesce(F.when(F.col("i") + 1 < F.size("road"), following["begins"]), F.col("tokens")).alias("stop"),
        )
        .join(heads.select("chain", "tree", "start"), "chain")
    )
    part = F.struct(
        "first",
        (F.col("until") - 1).alias("last"),
        "chain",
        "start",
        (F.col("start") + F.col("stop") - F.col("begins")).alias("end"),
        "owner",
    )
    return parts.groupBy("conv").agg(
        *[F.max(c).alias(c) for c in ("conv_id", "turns", "tokens", "tree")], F.sort_array(F.collect_list(part)).alias("chains")
    )


def chat_tree(conversations: DataFrame) -> ChatTree:
    """The prefix trees of ``conversations`` (conv_id, turn, role, text).

    Rows of a conversation go by turn, null first, and rows of one turn by their content's hash. A null
    role or text counts as empty; rows with a null conv_id are one conversation. Conversations that are
    alike, or of which one is the beginning of the other, share all they have in common. Repeated rows are
    turns of their own. Other columns are ignored, whatever their names; an empty table has no trees.

    Turns are told apart by SHA-256, beginnings by 120 bits of sums of such hashes; a beginning whose rows
    do not all end in the same turn is an error, so a chance meeting cannot merge two nodes unseen.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    known = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    )
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    known = known.withColumn("mark", F.unhex(F.sha2(content.cast("binary"), 256)))
    turns = _turns(known)
    placed = turns.join(_nodes(turns), ["depth", "a", "b"]).drop("a", "b", "own_a", "own_b")
    placed = placed.withColumns({"head": F.when(F.col("light"), F.col("node")), "head_at": F.when(F.col("light"), F.col("position"))})
    placed = with_ordered(
        placed, ["conv"], ["place"], step_block("place"), {"chain": last_value("head"), "begins": last_value("head_at")}
    )
    placed = saved(placed.drop("head", "head_at"), "placed")
    # At most log2 of the conversations of them in a row, besides the first.
    entry = F.struct(F.col("depth").alias("first"), "chain", "begins", (F.col("place") == F.col("node")).alias("owner"))
    roads = placed.filter("light").groupBy("conv").agg(F.sort_array(F.collect_list(entry)).alias("road"))
    heads = _heads(placed, roads)
    paths = saved(_paths(placed, roads, heads), "paths")
    before = F.transform(F.filter("chains", lambda c: c["first"] < F.col("own")["first"]), lambda c: F.struct(c["start"], c["end"]))
    sees = paths.select("chains", F.explode("chains").alias("own")).filter("own.owner").select("own.chain", before.alias("before"))
    texts = known.groupBy("mark").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    nodes = (
        placed.filter("place = node")
        .select("mark", "chain", "depth", "position", "size", "shared")
        .join(heads.withColumnRenamed("start", "chain_start"), "chain")
        .join(sees, "chain")
        .join(texts, "mark")
        .withColumn("start", F.col("chain_start") + F.col("position") - F.col("begins"))
        .withColumn("end", F.col("start") + F.col("size"))
    )
    counts = F.col("role") == ASSISTANT
    segments = nodes.select(
        "tree",
        "start",
        "size",
        "position",
        "chain",
        "depth",
        formatted(F.col("role"), F.col("text")).alias("text"),
        F.when(counts, F.col("start") + len(SAY)).alias("loss_start"),
        F.when(counts, F.col("end") - len(SAID)).alias("loss_end"),
        F.concat("before", F.array(F.struct(F.col("chain_start").alias("start"), "end"))).alias("sees"),
        "shared",
    )
    return ChatTree(saved(segments, "segments"), paths)


def read_back(tree: ChatTree) -> DataFrame:
    """Each conversation as its intervals of the stream give it: one row per conversation.

    conv_id, n_turns, turns_sha256 (of role, line feed, text, line feed of each turn), loss_chars and
    loss_sha256 (of all text under the loss mask, without escapes), formatted_chars. A conversation's
    segments pass through one task in order, one at a time: a digest has no other order, and a task holds
    one segment. An error tells of a segment outside its intervals or out of turn.
    """
    wanted = tree.paths.select("conv", "conv_id", "turns", F.explode("chains").alias("part")).select(
        "conv", "conv_id", "turns", "part.*"
    )
    blocks = F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"last div {BLOCK}"))
    within = F.sequence(F.greatest("first", F.col("block") * BLOCK), F.least("last", (F.col("block") + 1) * BLOCK - 1))
    wanted = wanted.withColumn("block", F.explode(blocks)).select(
        "conv", "conv_id", "turns", "chain", F.col("start").alias("low"), F.col("end").alias("high"), F.explode(within).alias("depth")
    )
    inside = (F.col("start") >= F.col("low")) & (F.col("start") + F.col("size") <= F.col("high"))
    found = wanted.join(tree.segments, ["chain", "depth"]).select(
        "conv",
        "conv_id",
        "turns",
        "position",
        "text",
        (F.col("loss_start") - F.col("start")).alias("loss_start"),
        (F.col("loss_end") - F.col("start")).alias("loss_end"),
        inside.alias("inside"),
    )
    names = found.columns
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def read(batches):
        open_conv, row = None, None
        for batch in batches:
            done = []
            for conv, conv_id, turns, position, text, loss_start, loss_end, inside in zip(*[batch.column(n).to_pylist() for n in names]):
                if conv != open_conv:
                    if row:
                        done.append(row.closed())
                    open_conv, row = conv, _Read(conv_id, turns)
                row.take(position, text, loss_start, loss_end, inside)
            yield _record(done, arrow)
        if row:
            yield _record([row.closed()], arrow)

    return found.repartition("conv").sortWithinPartitions("conv", "position").mapInArrow(read, schema)


def _record(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)


class _Read:
    """Digests of one conversation, fed with its segments in order."""

    def __init__(self, conv_id: int | None, turns: int):
        self.conv_id, self.expected = conv_id, turns
        self.turns = self.chars = self.loss = 0
        self.all, self.said = hashlib.sha256(), hashlib.sha256()

    def take(self, position: int, segment: str, loss_start: int | None, loss_end: int | None, inside: bool) -> None:
        if not inside or position != self.chars:
            raise ValueError(f"segment at position {position} of conversation {self.conv_id} is not where its path says")
        role, text = parsed(segment)
        self.all.update(f"{role}\n{text}\n".encode())
        if loss_start is not None:
            said = unescaped(segment[loss_start:loss_end])
            self.said.update(said.encode())
            self.loss += len(said)
        self.turns += 1
        self.chars += len(segment)

    def closed(self) -> tuple:
        if self.turns != self.expected:
            raise ValueError(f"conversation {self.conv_id} has {self.expected} turns, {self.turns} were found")
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.said.hexdigest(), self.chars


def chat_round_trip(conversations: DataFrame) -> DataFrame:
    """The prefix trees of ``conversations`` and of conversation -1, which says control strings, read back."""
    own = conversations.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    control = f"{SAID}{ASK} ok {ASKED}"
    more = own.sparkSession.createDataFrame([(-1, 0, "user", control), (-1, 1, ASSISTANT, control)], own.schema)
    return read_back(chat_tree(own.union(more)))
