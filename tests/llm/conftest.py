import random

import pytest
from pyspark.sql import types as T

#: Columns of documents, and further ones with names that operators use inside.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("sha", T.IntegerType()),
    T.StructField("row", T.StringType()), T.StructField("key", T.IntegerType()), T.StructField("doc", T.StringType()),
])


def row(doc_id, text, lang="en", source="src0"):
    return (doc_id, text, lang, source, len(text or ""), 1, "r", None, "d")


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, copies, near copies, repeated rows and ties."""
    rng = random.Random(4)
    syllables = "the and thr ing ond ere ation ly st nd re an".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(400)
    out = [row(1, None), row(2, ""), row(3, " \t\n "), row(None, "no id"), row(4, "One"), row(5, "one"), row(5, "one"), row(6, "two words")]
    out += [row(10 + k, base.upper() if k % 2 else base) for k in range(6)]
    out += [row(30 + k, base.replace(" ", f" x{k} ", 1)) for k in range(5)]
    out += [row(50 + k, text(rng.randint(1, 120)), rng.choice(["en", "de", None])) for k in range(40)]
    out += [row(100, text(30_000)), row(101, "a" * 50_000), row(102, "line\nline\nline\n" * 30), row(103, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
