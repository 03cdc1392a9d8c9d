"""Row filters. All are plain predicates, so they reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import has_devanagari, strip_ws

UNKNOWN_LABELS = ("Unknown", "UNKNOWN")


def drop_empty_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, strip_ws(text)).filter(F.col(text) != "")


def min_confidence(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Keep rows strictly above the threshold; a missing confidence counts as 0."""
    return df.filter(F.coalesce(F.col("confidence"), F.lit(0.0)) > threshold)


def valid_words(words: DataFrame) -> DataFrame:
    return words.dropna(subset=["speaker", "start_ms", "end_ms"])


def voiced_gender_only(regions: DataFrame) -> DataFrame:
    return regions.filter(F.col("gender").isin("male", "female"))


def drop_unknown_speaker(df: DataFrame, speaker: str = "speaker") -> DataFrame:
    return df.filter(F.coalesce(F.col(speaker), F.lit("Unknown")).isin(*UNKNOWN_LABELS) == F.lit(False))


def positive_length(df: DataFrame) -> DataFrame:
    return df.filter(F.col("end_ms") > F.col("start_ms"))


def episode_range(df: DataFrame, number: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows whose episode number lies in the range; unparsable numbers stay."""
    n = F.col(number)
    inside = F.lit(True)
    if start is not None:
        inside = inside & (n >= start)
    if end is not None:
        inside = inside & (n <= end)
    return df.filter(n.isNull() | inside)


def needs_translation(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `route`: translate or copy. Blank documents are left out."""
    return docs.filter(strip_ws(text) != "").withColumn(
        "route", F.when(has_devanagari(text), "translate").otherwise("copy")
    )


def min_two_speakers(segments: DataFrame, speaker: str = "speaker") -> DataFrame:
    """One row per episode: its number of speakers and whether it is accepted."""
    return (
        segments.select("episode_id", speaker)
        .distinct()
        .groupBy("episode_id")
        .agg(F.count(speaker).alias("n_speakers"))
        .withColumn("accepted", F.col("n_speakers") >= 2)
        .withColumn("error", F.when(~F.col("accepted"), F.lit("Need at least 2 speakers")))
    )
