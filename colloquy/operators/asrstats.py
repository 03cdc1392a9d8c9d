"""Speech-recognition responses to segments and statistics, whichever lists a response has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import strip_ws
from colloquy.operators.blocks import join_on
from colloquy.operators.sequences import words_to_segments
from colloquy.operators.stats import speaker_stats, talk_time_turns

UTTERANCE, FALLBACK = "utterance (sentence-like)", "segment (fallback)"


def without_utterances(words: DataFrame, utterances: DataFrame) -> DataFrame:
    """Words of the episodes that have no utterance."""
    return join_on(words, utterances.select("episode_id").distinct(), ["episode_id"], "left_anti")


def word_segments(words: DataFrame, utterances: DataFrame, gap_ms: int = 800) -> DataFrame:
    """Segments built from words, for the episodes without utterances."""
    built = words_to_segments(without_utterances(words, utterances), gap_ms)
    return built.select("episode_id", F.col("head_idx").alias("seg_idx"), F.col("speaker").alias("speaker_id"), "start_ms", "end_ms", "text")


def response_segments(utterances: DataFrame, words: DataFrame, gap_ms: int = 800) -> DataFrame:
    """Non-empty utterances of an episode if it has utterances, else segments built from its words."""
    spoken = utterances.filter(strip_ws("text") != "").select("episode_id", "seg_idx", "speaker_id", "start_ms", "end_ms", "text")
    return spoken.unionByName(word_segments(words, utterances, gap_ms))


def response_statistics(utterances: DataFrame, words: DataFrame, gap_ms: int = 800) -> DataFrame:
    """Statistics per speaker: of all utterances, empty ones included, or talk time and turns of the word segments."""
    full = speaker_stats(utterances.withColumn("speaker", F.col("speaker_id"))).withColumn("unit", F.lit(UTTERANCE))
    built = word_segments(words, utterances, gap_ms).withColumn("speaker", F.col("speaker_id"))
    brief = talk_time_turns(built).withColumn("unit", F.lit(FALLBACK))
    return full.unionByName(brief, allowMissingColumns=True).withColumnRenamed("speaker", "speaker_id")
