import pytest
from pyspark.sql import types as T

LONG = "lorem ipsum dolor sit amet, " * 8000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, texts and sources, empty and very long texts, repeated rows, clashing column names."""
    kinds = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        T.StructField("Score", T.IntegerType()), T.StructField("counts", T.StringType()), T.StructField("kept", T.BooleanType()), T.StructField("a.b", T.DoubleType()), T.StructField("label", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("copies", T.LongType()),
    ])
    words = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (6, words), (7, words), (8, words + " extra"), (9, LONG), (10, LONG), (11, "é ü 日本語 \U0001f600 x"), (None, words), (None, None), (12, "A b C"), (13, "a B c"), (14, "###$$$ " * 50),
    ]
    return spark.createDataFrame([(i, t, None, ["b", "a", None][k % 3], 0, 1, "x", False, 0.5, 1, "k", 9) for k, (i, t) in enumerate(rows)], kinds)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(1, 15)] + [(None, 1, 0), (3, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
