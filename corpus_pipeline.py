"""Cleaning of the documents in five stages, each written as Parquet and read again by the next.

All stages but the last return the columns of documents. A row leaves when it is toxic, repeats another
text, is near to a document of smaller id, or holds a passage of the benchmark; the last stage replaces
the text by its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roamframe.llm.columns import prepare, table
from roamframe.llm.decontaminate import without_matches
from roamframe.llm.exact_dedup import exact_dedup, normalised
from roamframe.llm.parity_join import parity_join
from roamframe.llm.pieces import encode_documents
from roamframe.llm.queries import tokenizer_path
from roamframe.llm.toxicity import fit, without_toxic
from roamframe.storage import saved

#: Near copies of the stage share this many hundredths of their shingles of so many words; op3's query has its own values.
NEAR_PERCENT, NEAR_SHINGLE = 80, 5
#: Numbers that ids are hashed to; a table of them is at most this long, whatever the input, so it is broadcast.
ID_BUCKETS = 1 << 20


def _bucket() -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(ID_BUCKETS)).cast("int")


def _parted(docs: DataFrame, leaving: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id certainly isn't in ``leaving`` (doc_id), and the few that may be.

    The texts of the first are not shuffled: they pass by a broadcast table of the leaving ids' buckets.
    Only the second need an exact look. Were most ids leaving, these would be most rows, and the look an
    ordinary join.
    """
    buckets = F.broadcast(saved(leaving.select(_bucket().alias("_id_bucket")).distinct(), "leaving"))
    told = docs.withColumn("_id_bucket", _bucket())
    return tuple(told.join(buckets, "_id_bucket", how).select(docs.columns) for how in ("left_anti", "left_semi"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under the threshold, by a model of the labels; null texts have a score too."""
    prepare(spark)
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with one text up to white space, the one with the smallest id; null and empty texts are one text.

    Of rows that repeat an id and a text, one stays.
    """
    prepare(spark)
    found = saved(exact_dedup(docs).select(F.col("doc_id").alias("_kept"), "kept", F.col("text_sha256").alias("_print")), "copies")
    clear, doubtful = _parted(docs, found.filter("not kept").select(F.col("_kept").alias("doc_id")))
    marked = doubtful.withColumn("_own", F.sha2(normalised("text").cast("binary"), 256))
    kept = found.filter("kept").select("_kept", "_print").distinct()
    same = marked["doc_id"].eqNullSafe(kept["_kept"]) & (marked["_own"] == kept["_print"])
    stays = marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_own"]).drop("_own")
    return clear.unionByName(stays)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies; a document without words has none.

    Near copies share at least 80 hundredths of the union of their five-word shingles. Rows that share an
    id stay or go together; a null id stays.
    """
    prepare(spark)
    joined = parity_join(docs, percent=NEAR_PERCENT, shingle=NEAR_SHINGLE)
    gone = saved(joined.filter("component_id < doc_id").select("doc_id").distinct(), "gone")
    clear, doubtful = _parted(docs, gone)
    return clear.unionByName(doubtful.join(gone, "doc_id", "left_anti").select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of a benchmark item."""
    prepare(spark)
    return without_matches(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its pieces' ids in place of the text, and whether they decode to it again."""
    prepare(spark)
    return encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pieces", to_pieces),
]
#: The first and the last stage cannot be told in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
