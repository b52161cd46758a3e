import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that the operators use inside.
CLASHES = (
    "row_", "m_", "id", "tokens", "n", "kept", "kept_", "drops", "text_", "entropy", "assign", "words", "key_", "score",
    "component", "pivot", "version", "f_", "doc_", "new_", "length",
)


@pytest.fixture
def frame(spark):
    """Make a documents table from (doc_id, text) or full rows, with clashing columns on demand."""

    def make(rows, clash=False):
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)})
        return df

    return make


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
EDGE = [
    (1, None, "en", "s0"), (2, "", None, None), (3, " \n\t ", "en", None), (4, "One two three. Four five!\nSix", "en", "s0"),
    (4, "One two three. Four five!\nSix", "en", "s0"), (5, LONG, "de", "s1"), (6, "é😀 ſtraße\x0b\x0cÀ", None, "s0"),
    (None, "a text without an id, seven words", "en", "s0"), (7, "x", "fr", "s1"),
]


@pytest.fixture
def edge():
    return EDGE
