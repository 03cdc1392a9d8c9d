import pytest

from pyspark.sql import functions as F

LONG_WORD = "x" * 5000
ODD_TEXTS = [
    (None, "row without an id, and words enough for the rules to keep it here"),
    (1, None),
    (2, ""),
    (3, " \t\n  \r\n "),
    (4, "one two three"),
    (5, "same text twice " * 12),
    (5, "same text twice " * 12),
    (6, "same text twice " * 12),
    (7, LONG_WORD),
    (8, " ".join(f"w{i % 977}" for i in range(60_000))),
    (9, "Zeile eins\nZeile zwei\nZeile eins\n\nÄpfel! it's we'll 'tis 3.14 <|endoftext|> end"),
    (10, "a\x00b́  ​\U0001f642 日本 \x1c\x85 mixed"),
    (None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, "en", "src0" if (i or 0) % 2 else None, 1) for i, t in ODD_TEXTS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = "kept n_tokens bits component_id start part file digest payload tokens epoch whole key label _id _mark in_text".split()
    return docs.select("*", *(F.lit("clash").alias(c) for c in clash))


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
