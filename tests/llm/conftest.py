import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use inside themselves.
CLASHING = ("key", "size", "hash", "gone", "gone_key", "gone_hash", "kept", "row", "copies", "target", "draw", "label", "v", "n", "component", "bucket", "shard", "start", "score")


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from rows; clash adds a column for each name that operators use themselves."""

    def make(rows, clash=False):
        rows = [tuple([*r, *["en", "a", 0][len(r) - 2 :]]) for r in rows]
        names = CLASHING if clash else ()
        schema = T.StructType([*SCHEMA.fields, *(T.StructField(c, T.StringType()) for c in names)])
        return spark.createDataFrame([(*r, *names) for r in rows], schema)

    return make


PROSE = "the quick brown fox jumps over the lazy dog while seven small birds sing about rain and wind in the old quiet town near a river"


@pytest.fixture(scope="session")
def edges(frame):
    """Nulls in any column, empty and long texts, white space, ties, repeated rows, clashing columns."""
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, PROSE), (4, PROSE), (5, PROSE), (6, PROSE + " today"), (7, "one"), (8, "one"), (9, "Zwölf Boxkämpfer jagen 東京 \U0001f600 ''s"),
        (None, PROSE), (None, None), (10, "word " * 60_000), (11, "x" * 200_000), (12, "a b c", None, None, None), (13, "<|endoftext|> and \x00 bytes \r\n here"), (-5, "ONE Two three"),
    ]
    return frame(rows, clash=True)
