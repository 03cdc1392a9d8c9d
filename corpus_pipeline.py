"""The corpus pipeline: quality rules, near-dedup, passage dedup, source mixing, token ids."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe, mixing, ngramjoin, passages, quality, simhash
from colloquy.llm.runtime import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# Rows of a batch of texts that goes to the encoder: Spark's own 10,000 take tens of MB of an executor several times over.
TEXT_ROWS = 500


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the text rules and the classifier keep; it is fitted on the labelled ones among `docs`.

    Null and empty texts fail the rules. Rows with null ids, repeated rows and very
    long texts are judged like all others; without labels of both kinds the rules decide alone.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality.apply_rules(docs, model, keep=COLUMNS[1:])
    return judged.where("kept").select("doc_id", *(F.col(f"in_{c}").alias(c) for c in COLUMNS[1:]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, then the least text hash.

    First the groups of SimHash fingerprints. Most texts that share 80 in a hundred
    of their five-word shingles differ in more bits than those allow, so of what
    stays, the groups by shingles follow. Null ids come last in a group, repeated rows
    are one, texts of any length count whole, and texts without words are one SimHash group.
    """
    kept = ngramjoin.kept_rows(docs, written(simhash.kept_rows(docs), "kept"))
    return simhash.take_rows(docs, written(kept, "kept"), COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document, or an earlier place of the same one, has.

    No row goes: a repeated row keeps an empty text. Null texts become empty, null
    ids come after all others, and texts of any length count whole.
    """
    cut = passages.remove_repeats(docs, keep=["lang", "source"], characters=True)
    text = F.col("kept").cast("string")
    return cut.select(
        "doc_id", text.alias("text"), F.col("in_lang").alias("lang"), F.col("in_source").alias("source"),
        F.length(text).cast("long").alias("n_chars"),
    )


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of smaller sources again up to their weight.

    A null source is one of its own; documents without words come once. Repeated
    rows are rows of their own, and all rows with one id get the same key.
    """
    docs = docs.select(COLUMNS)
    return mixing.realised(docs, mixing.mixing_plan(mixing.token_table(docs))).select(COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text, little-endian unsigned 32-bit; null and empty texts have none.

    They are written here, as only then the batches of texts that go to Python are small.
    """
    coded = bpe.encode_documents(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    return written(coded, "ids", TEXT_ROWS)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("passages", repeated_passages),
    ("mix", source_mix),
    ("token_ids", token_ids),
]

# The classifier of the first stage has no SQL; tests compare the stages to brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
