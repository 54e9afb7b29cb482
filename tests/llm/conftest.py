import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
SMALL = "/root/testdata/sf0.001"


def awkward_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long_text = " ".join(f"word{i % 97} and{i % 13}," for i in range(6000))
    return [
        (1, "one two three four five", "en", "a", 23),
        (2, "one two three four five", "en", "b", 23),
        (2, "one two three four five", "en", "b", 23),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \n\t ", "fr", "a", 4),
        (None, "un deux trois", "fr", None, 13),
        (None, None, None, None, None),
        (6, long_text, "en", "a", len(long_text)),
        (7, long_text + " tail", None, "a", None),
        (8, "ONE two\nthree four five\nune ligne\nune ligne\nune ligne", "fr", "c", 5),
        (9, "été 中文字 word x \U0001f600 é it's <|endoftext|> 12 IİΣς", "fr", "c", 5),
        (10, "une ligne\nune ligne\nrest", "en", "\U0001f600", 5),
        (2**40, "ONE two\nthree four five\nsomething else", "en", "c", 5),
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(spark):
    """Extra columns named like helper columns of the operators."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), DOCUMENTS)
    for name in ("key", "mark", "row", "digest", "text_mark", "kept_key", "kept_digest", "n_lines", "gone",
                 "copy_no", "its_key", "takes", "score", "predicted", "toxic", "component_id", "kept", "Label",
                 "run_key", "run_mark", "class_id", "words", "size", "source_size"):
        df = df.withColumn(name, F.lit(f"extra {name}"))
    return df


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
