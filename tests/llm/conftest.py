import pytest

#: Names that an operator may use inside.
CLASHES = ("id", "key", "label", "score", "rep", "bucket", "text2", "n", "y", "chunk", "word", "conv", "url2", "digest", "shard", "start")


@pytest.fixture
def table(spark):
    """Rows as a table with further columns of clashing names."""

    def make(rows, schema, clashes=CLASHES):
        from pyspark.sql import functions as F

        found = spark.createDataFrame(rows, schema)
        return found.select("*", *(F.lit("x").alias(c) for c in clashes if c not in found.columns))

    return make


@pytest.fixture
def odd_docs(table):
    """Null, empty and wordless texts, a null id, repeated rows, ties, a very long text."""
    long = " ".join(f"w{i % 7919}" for i in range(60_000))
    rows = [(0, "one two three four five six seven"), (1, "One  two\tthree four five six SEVEN"), (2, None), (3, ""), (4, " \n\t "), (5, "short one"), (6, "short one"), (6, "short one"), (None, "one two three four five six seven"), (None, None), (7, long), (8, long + " tail"), (9, "é è ñ ß x́ あい. ..., it's\u00a0odd <|endoftext|>")]
    return table(rows, "doc_id long, text string")
