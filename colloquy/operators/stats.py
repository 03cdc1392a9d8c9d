"""Statistics per speaker and per episode.

All of them are one `groupBy` with mergeable aggregates, so a hot episode is
combined before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.labels import classify_pitch
from colloquy.functions.numeric import round_ratio, safe_div
from colloquy.functions.text import (
    cue_hits,
    host_score_text,
    is_question_segment,
    question_mark_flag,
    sentence_mark_count,
    strip_ws,
    word_count,
)
from colloquy.functions.timefmt import duration
from colloquy.operators.blocks import join_on, order_statistics
from colloquy.operators.filters import UNKNOWN_LABELS, drop_unknown_speaker


def utterance_facts(segments: DataFrame, question: str = "final") -> DataFrame:
    """Per utterance: clamped length, words and whether it is a question."""
    return segments.select(
        "episode_id",
        "speaker",
        "end_ms",
        duration("start_ms", "end_ms").cast("bigint").alias("dur_ms"),
        word_count("text").alias("n_words"),
        question_mark_flag("text", question).cast("bigint").alias("is_q"),
    )


AGGREGATES = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
# What partial rows hold; "rows" is 1 in every utterance.
PARTS = [("count", "rows")] + [(kind, value) for value in ("dur_ms", "n_words", "is_q") for kind in AGGREGATES]


def _of_rows(kind: str, value: str) -> Column:
    return AGGREGATES[kind](F.lit(1) if value == "rows" else F.col(value))


def _of_parts(kind: str, value: str) -> Column:
    """The same aggregate from partial rows: counts add up."""
    return AGGREGATES["sum" if kind == "count" else kind](f"{value}_{kind}")


def _summaries(prefix: str, value: str, scale: int, of: Callable[[str, str], Column] = _of_rows) -> list[Column]:
    """count, mean, min, max of an integer column; `scale` 1000 turns ms into s."""
    return [
        of("count", value).alias(f"{prefix}_count"),
        round_ratio(of("sum", value), of("count", value) * scale, 3).alias(f"{prefix}_mean"),
        (of("min", value) / scale).alias(f"{prefix}_min"),
        (of("max", value) / scale).alias(f"{prefix}_max"),
    ]


def _speaker_measures(
    wpm_places: int = 2, rate_places: int = 4, of: Callable[[str, str], Column] = _of_rows
) -> list[Column]:
    return [
        of("count", "rows").alias("num_sentences"),
        (of("sum", "dur_ms") / 1000).alias("total_speech_s"),
        of("sum", "n_words").alias("total_words"),
        round_ratio(of("sum", "n_words") * 60000, of("sum", "dur_ms"), wpm_places).alias("wpm_est"),
        of("sum", "is_q").alias("question_count"),
        round_ratio(of("sum", "is_q"), of("count", "rows"), rate_places).alias("question_rate_per_sentence"),
        *_summaries("duration", "dur_ms", 1000, of),
        *_summaries("words", "n_words", 1, of),
    ]


def speaker_stats(segments: DataFrame) -> DataFrame:
    return utterance_facts(segments).groupBy("episode_id", "speaker").agg(*_speaker_measures())


def speaker_parts(segments: DataFrame) -> DataFrame:
    """Partial rows per (episode, speaker), from which `merged_parts` and `stats_of_parts` go on."""
    return utterance_facts(segments).groupBy("episode_id", "speaker").agg(*(_of_rows(*p).alias(f"{p[1]}_{p[0]}") for p in PARTS))


def merged_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("episode_id", "speaker").agg(*(_of_parts(*p).alias(f"{p[1]}_{p[0]}") for p in PARTS))


def stats_of_parts(parts: DataFrame) -> DataFrame:
    """`speaker_stats` of all utterances that went into the partial rows."""
    return parts.groupBy("episode_id", "speaker").agg(*_speaker_measures(of=_of_parts))


def episode_stats(segments: DataFrame) -> DataFrame:
    return (
        utterance_facts(segments)
        .groupBy("episode_id")
        .agg(
            F.count(F.lit(1)).alias("num_utterances_total"),
            (F.greatest(F.max("end_ms"), F.lit(0)) / 1000).alias("audio_duration_s_est"),
            *_summaries("duration", "dur_ms", 1000),
            *_summaries("words", "n_words", 1),
        )
    )


def two_grain_stats(segments: DataFrame) -> DataFrame:
    """Both grains from one pass; `grain` tells episode rows from speaker rows."""
    facts = utterance_facts(segments)
    return (
        facts.groupingSets(
            [[F.col("episode_id")], [F.col("episode_id"), F.col("speaker")]], F.col("episode_id"), F.col("speaker")
        )
        .agg(
            F.grouping_id().alias("__g"),
            (F.greatest(F.max("end_ms"), F.lit(0)) / 1000).alias("audio_duration_s_est"),
            *_speaker_measures(),
        )
        .withColumn("grain", F.when(F.col("__g") == 0, "speaker").otherwise("episode"))
        .drop("__g")
    )


def summarize_median(segments: DataFrame) -> DataFrame:
    """Speaker statistics with the upper median and the coarser rounding."""
    facts = utterance_facts(segments, question="any")
    keys = ["episode_id", "speaker"]
    base = facts.groupBy(*keys).agg(*_speaker_measures(wpm_places=1, rate_places=2))
    values = facts.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit("duration").alias("metric"), F.col("dur_ms").alias("value")),
                F.struct(F.lit("words").alias("metric"), F.col("n_words").alias("value")),
            )
        ).alias("m"),
    ).select(*keys, "m.metric", "m.value")
    upper = {"median": F.floor(F.col("n") / 2).cast("bigint")}
    medians = (
        order_statistics(values, [*keys, "metric"], "value", upper)
        .groupBy(*keys)
        .agg(
            (F.max(F.when(F.col("metric") == "duration", F.col("median"))) / 1000).alias("duration_median"),
            F.max(F.when(F.col("metric") == "words", F.col("median"))).cast("double").alias("words_median"),
        )
    )
    return join_on(base, medians, keys)


def talk_time_turns(segments: DataFrame) -> DataFrame:
    """Fallback statistics: talk time and segment count per speaker."""
    per_speaker = (
        segments.withColumn("__d", duration("start_ms", "end_ms"))
        .groupBy("episode_id", "speaker")
        .agg((F.sum("__d") / 1000).alias("talk_time_s"), F.count(F.lit(1)).alias("turns"))
    )
    whole = Window.partitionBy("episode_id")
    return per_speaker.withColumn("num_segments", F.sum("turns").over(whole))


def questions_by_speaker(segments: DataFrame) -> DataFrame:
    return (
        drop_unknown_speaker(segments)
        .filter((strip_ws("text") != "") & is_question_segment("text"))
        .groupBy("episode_id", "speaker")
        .agg(F.count(F.lit(1)).alias("questions"))
    )


def keyword_votes(hits: DataFrame) -> DataFrame:
    """Votes and vote share per known speaker among segments that hit a category."""
    votes = drop_unknown_speaker(hits).groupBy("episode_id", "speaker").agg(F.count(F.lit(1)).alias("votes"))
    total = F.sum("votes").over(Window.partitionBy("episode_id"))
    return votes.withColumn("share", F.col("votes") / total)


def speaking_time(segments: DataFrame) -> DataFrame:
    """Unclamped seconds and share per known speaker."""
    per = (
        drop_unknown_speaker(segments)
        .groupBy("episode_id", "speaker")
        .agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("__ms"))
    )
    total = F.sum("__ms").over(Window.partitionBy("episode_id"))
    return per.select(
        "episode_id", "speaker", (F.col("__ms") / 1000).alias("speech_s"), safe_div(F.col("__ms"), total).alias("share")
    )


def _micro(confidence: str = "confidence") -> Column:
    return F.round(F.coalesce(F.col(confidence), F.lit(0.0)) * 1000000, 0).cast("bigint")


def speaker_duration_confidence(segments: DataFrame) -> DataFrame:
    """Total time, utterances and mean confidence per speaker."""
    return segments.groupBy("episode_id", "speaker").agg(
        (F.sum(F.col("end_ms") - F.col("start_ms")) / 1000).alias("total_time"),
        F.count(F.lit(1)).alias("utterance_count"),
        round_ratio(F.sum(_micro()), F.count(F.lit(1)) * 1000000, 6).alias("avg_confidence"),
    )


def speaker_confidence(segments: DataFrame) -> DataFrame:
    """0.6 of the speaker's time share plus 0.4 of its turn share."""
    per = segments.groupBy("episode_id", "speaker").agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("__ms"), F.count(F.lit(1)).alias("__n")
    )
    whole = Window.partitionBy("episode_id")
    time_share = safe_div(F.col("__ms"), F.sum("__ms").over(whole))
    turn_share = F.col("__n") / F.sum("__n").over(whole)
    return per.select(
        "episode_id", "speaker", (time_share * F.lit(0.6) + turn_share * F.lit(0.4)).alias("confidence_score")
    )


def turn_stats(lines: DataFrame, drop_empty: bool = False) -> DataFrame:
    """Turns and mean characters per speaker, with the episode's opener and size.

    The mean is over non-empty utterances. `drop_empty` removes empty ones
    before counting turns as well.
    """
    rows = lines.filter(F.col("text") != "") if drop_empty else lines
    chars = F.when(F.col("text") != "", F.length("text"))
    per = rows.groupBy("episode_id", "speaker").agg(
        F.count(F.lit(1)).alias("turn_count"),
        safe_div(F.coalesce(F.sum(chars), F.lit(0)), F.count(chars)).alias("avg_utterance_chars"),
        F.min("seg_idx").alias("__first"),
    )
    whole = Window.partitionBy("episode_id")
    return per.select(
        "episode_id", "speaker", "turn_count", "avg_utterance_chars",
        F.min_by("speaker", "__first").over(whole).alias("first_speaker"),
        F.sum("turn_count").over(whole).alias("num_turns"),
    )


def document_stats(docs: DataFrame) -> DataFrame:
    return docs.select(
        "episode", word_count("text").alias("word_count"), sentence_mark_count("text").alias("sentence_count")
    )


def host_score(segments: DataFrame) -> DataFrame:
    """Summed host-likeness per raw speaker."""
    return segments.groupBy("episode_id", F.col("speaker_raw").alias("speaker")).agg(
        F.sum(host_score_text("text")).alias("score")
    )


def heuristic_host_score(samples: DataFrame, asr: bool = False) -> DataFrame:
    """Score per speaker over its first ten samples: early, cue words, length.

    `asr` counts `?` as a cue and adds 5 for each.
    """
    marks = F.regexp_count("sample", F.lit(r"\?")) if asr else F.lit(0)
    early = Window.partitionBy("episode_id", "speaker").orderBy("seg_idx")
    first_ten = samples.withColumn("__rn", F.row_number().over(early)).filter(F.col("__rn") <= 10)
    return first_ten.groupBy("episode_id", "speaker").agg(
        (
            F.min_by("start_ms", "seg_idx") * F.lit(-0.5) / 1000
            + F.sum(cue_hits("sample", asr)) * 10.0
            + F.sum(F.length("sample")) * F.lit(0.01)
            + F.sum(marks) * 5.0
        ).alias("score"),
        F.min("seg_idx").alias("first_idx"),
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """Counts and times of a batch; the failures themselves go to `failed_items`."""
    ok = F.col("ok")
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        round_ratio(F.sum("time_ms"), F.lit(60000), 4).alias("total_time_minutes"),
        round_ratio(F.sum("time_ms"), F.count(F.lit(1)) * 60000, 4).alias("avg_time_per_file_minutes"),
    )


def failed_items(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("ok"))


def distinct_speakers(segments: DataFrame) -> DataFrame:
    """Each speaker once, with the gender and role of its first segment."""
    return segments.groupBy("episode_id", "speaker").agg(
        F.min_by("gender", "seg_idx").alias("gender"), F.min_by("role", "seg_idx").alias("role")
    )


def last_gender_by_role(segments: DataFrame) -> DataFrame:
    """Gender per role; a later segment overwrites an earlier one."""
    return segments.groupBy("episode_id", "role").agg(F.max_by("gender", "seg_idx").alias("gender"))


def category_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("episode_id").agg(
        F.count_if(F.col("speaker") == "Host").alias("host_segments"),
        F.count_if(F.col("speaker") == "Guest").alias("guest_segments"),
        F.count_if(F.col("speaker").isin(*UNKNOWN_LABELS)).alias("unknown_segments"),
    )


def pitch_verdict(mean: Column, std: Column) -> tuple[Column, Column]:
    """Gender and confidence from the mean and population deviation of pitch.

    The confidence is the mean of consistency and distance from the boundary;
    the distance has no upper limit.
    """
    gender = classify_pitch(mean)
    consistency = F.lit(1.0) - F.least(std / mean, F.lit(1.0))
    distance = F.when(gender == "male", F.greatest(F.lit(0.0), 165 - mean) / 80).otherwise(
        F.greatest(F.lit(0.0), mean - 180) / 75
    )
    confidence = (
        F.when(gender == "unknown", 0.0).when(gender == "ambiguous", 0.3).otherwise((consistency + distance) / 2)
    )
    return gender, confidence


def pitch_gender(samples: DataFrame) -> DataFrame:
    """Gender per speaker from sampled pitch medians (column `median_hz`).

    Sums run over whole hundredths of a hertz, so the deviation does not depend
    on the order in which partitions are combined.
    """
    centi = F.round(F.col("median_hz") * 100, 0).cast("decimal(18,0)")
    per = samples.groupBy("episode_id", "speaker").agg(
        F.sum(centi).alias("__s1"), F.sum((centi * centi).cast("decimal(28,0)")).alias("__s2"),
        F.count("median_hz").alias("sample_count"),
    )
    n = F.nullif(F.col("sample_count"), F.lit(0))
    wide = "decimal(38,0)"
    spread = n.cast("decimal(10,0)") * F.col("__s2").cast("decimal(28,0)") - (
        F.col("__s1").cast("decimal(18,0)") * F.col("__s1").cast("decimal(18,0)")
    )
    per = per.withColumns(
        {
            "avg_pitch": F.col("__s1").cast("double") / (n * 100),
            "std_pitch": F.sqrt(spread.cast(wide).cast("double")) / (n * 100),
        }
    )
    gender, confidence = pitch_verdict(F.col("avg_pitch"), F.col("std_pitch"))
    return per.select(
        "episode_id", "speaker", gender.alias("gender"), "avg_pitch", "std_pitch",
        confidence.alias("confidence"), "sample_count",
    )
