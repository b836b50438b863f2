"""Exact dedup by deterministic block naming.

A text is cut into blocks of fixed size. All blocks are sorted and get integer names, equal blocks the
same one. Then the names of adjacent pairs are sorted and named in turn, until each document has a
single name. Names come from sorting and not from hashing, so no two different texts share one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamframe.llm.columns import text_or_empty
from roamframe.llm.ordering import in_order
from roamframe.storage import cut, saved

SPACE = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 4096
#: Bytes of a block by which, with a hash of it, blocks are dealt to the sorting tasks.
BEGINNING = 24


def normalised(name: str):
    return F.regexp_replace(text_or_empty(name), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when they are identical after each run of white space became one space. A null text
    counts as empty, and empty texts form one group. The smallest id of a group stays; null ids come
    last, and among rows that repeat an id one stays. Other columns of ``docs`` are ignored, whatever
    their names. An empty table gives an empty result.
    """
    text = docs.select(F.col(id_col).cast("long").alias("_id"), normalised(text_col).cast("binary").alias("_bytes"))
    size = F.octet_length("_bytes")
    count = F.greatest(F.lit(1), F.ceil(size / F.lit(block_bytes))).cast("int")
    rows = text.select(
        F.monotonically_increasing_id().alias("rid"),
        "_id",
        F.unhex(F.sha2("_bytes", 256)).alias("sha"),
        size.cast("long").alias("n_bytes"),
        count.alias("n"),
        F.transform(
            F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("_bytes"), i * block_bytes + 1, F.lit(block_bytes))
        ).alias("blocks"),
    )
    blocks = rows.select("rid", "_id", "sha", "n_bytes", "n", F.posexplode("blocks").alias("pos", "block"))
    # What belongs to the document travels with its first block only.
    first = F.col("pos") == 0
    blocks = blocks.select(
        "rid",
        "pos",
        "n",
        *[F.when(first, F.col(c)).alias(c) for c in ("_id", "sha", "n_bytes")],
        "block",
        F.substring("block", 1, BEGINNING).alias("begins"),
        F.xxhash64("block").alias("mark"),
    )
    level = in_order(blocks, ["block"], ["rid", "pos"], short=["begins", "mark"]).drop("place")
    about = level.filter("pos = 0").select("rid", "_id", "sha", "n_bytes")
    done = [level.filter("n = 1").select("rid", F.lit(0).alias("level"), "name")]
    level = level.filter("n > 1").select("rid", "pos", "n", "name")
    # Each round halves the names of a document: as many rounds as the longest one has halvings.
    longest = level.agg(F.max("n")).first()[0] or 1
    for depth in range(1, (longest - 1).bit_length() + 1):
        even = F.col("pos") % 2 == 0
        pairs = level.groupBy("rid", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.expr("(max(n) + 1) div 2").cast("int").alias("n"),
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).cast("long").alias("right"),
        )
        level = in_order(pairs, ["left", "right"], ["rid", "pos"]).drop("place")
        done.append(level.filter("n = 1").select("rid", F.lit(depth).alias("level"), "name"))
        level = level.filter("n > 1")
    named = saved(reduce(DataFrame.unionByName, done).join(about, "rid"), "named")
    groups = cut(
        named.groupBy("level", "name")
        .agg(F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "rid")).alias("keep"), F.count("*").alias("size"))
        .filter("size > 1")
    )
    own = F.col("keep").isNull()
    return named.join(groups, ["level", "name"], "left").select(
        F.col("_id").alias(id_col),
        F.when(own, F.col("_id")).otherwise(F.col("keep._id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (own | (F.col("keep.rid") == F.col("rid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "n_bytes",
    )
