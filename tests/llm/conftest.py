from __future__ import annotations

import pytest
from pyspark.sql import types as T

COLUMNS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use themselves.
        *(T.StructField(n, T.StringType()) for n in "row id size document rep tile block key bytes".split()),
    ]
)
EXTRA = tuple("abcdefghi")


def document(doc_id, text, source="a", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), *EXTRA)


def story(seed: int, words: int) -> str:
    """Words without repeats of any five in a row."""
    return " ".join(f"w{(seed * 7919 + k * k * 31 + k) % 9973}x{k % 13}" for k in range(words))


@pytest.fixture(scope="session")
def messy_rows():
    base = [story(k, 60 + k) for k in range(12)]
    rows = [document(k, t, source="abc"[k % 3]) for k, t in enumerate(base)]
    rows += [
        document(20, base[0].upper(), "a"),
        document(21, base[1] + " tail", "b"),
        document(22, base[1] + " tail more", None),
        document(23, base[2].replace("x1", "y1", 1), "c"),
        document(24, None, "a"),
        document(25, "", None),
        document(26, " \t\n ", "b"),
        document(27, "two words", "b"),
        document(28, "Two WORDS", "c"),
        document(29, story(99, 30000), "c"),
        document(30, "é ñ ü <|endoftext|> don't \x1c a,b .5!! " + "x" * 300, "a"),
        document(30, "é ñ ü <|endoftext|> don't \x1c a,b .5!! " + "x" * 300, "a"),
        document(31, "same id, other text", "a"),
        document(31, "same id, another text", "a"),
        document(None, "no id", "b"),
        document(None, "no id", "b"),
        document(32, "no id", "b", lang=None),
        (33, "all else null", *(None,) * (len(COLUMNS) - 2)),
    ]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
