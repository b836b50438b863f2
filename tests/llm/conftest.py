import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from roamframe.llm.columns import prepare


@pytest.fixture(scope="session", autouse=True)
def prepared(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as a table with further columns, some named like inner ones."""
    schema = StructType(
        [
            StructField("doc_id", LongType()),
            StructField("text", StringType()),
            *[StructField(n, StringType()) for n in ("lang", "source", "name", "_id", "key", "n", "node")],
        ]
    )

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", "x", "y", None, "1", "2") for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def rows_of():
    """Rows as sorted tuples, nulls first."""

    def read(df, *columns):
        found = [tuple(r[c] for c in columns) for r in df.collect()]
        return sorted(found, key=lambda r: [(v is not None, v) for v in r])

    return read


#: Null and empty texts, white space alone, a null id, a long text, rows that repeat.
ODD = [(None, "a b c d e f"), (3, None), (4, ""), (5, " \t\n"), (6, "word"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "é😀 " * 40_000), (9, "x" * 50_000)]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
