"""Sinks. Long episodes are written as bounded parts, never as one value.

A part covers 2**12 list positions. `layout="packed"` keeps many episodes per
file as JSON rows (episode_id, part, ...). `layout="files"` writes a folder per
episode with one file per part, for consumers that want plain text files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.labels import render_line, speaker_label
from colloquy.functions.text import strip_ws
from colloquy.operators.stats import episode_stats, speaker_stats, talk_time_turns
from colloquy.operators.blocks import join_on
from colloquy.operators.textops import PART_BITS, part_totals, reassemble_text


def transcript_lines(
    segments: DataFrame, style: str = "range", label: str = "speaker", gender: str | None = None
) -> DataFrame:
    """Rendered lines of the non-blank segments."""
    line = render_line(label, "text", "start_ms", "end_ms", gender, style)
    return segments.withColumn("line", line).filter(F.col("line").isNotNull()).select("episode_id", "seg_idx", "line")


def write_lines(lines: DataFrame, path: str, order: str = "seg_idx", layout: str = "packed") -> None:
    """Write (episode_id, order, line) as text documents in order."""
    if layout == "packed":
        reassemble_text(lines, "episode_id", order, "line").write.mode("overwrite").json(path)
        return
    parts = lines.withColumn("part", F.shiftright(F.col(order), PART_BITS))
    (
        parts.repartition("episode_id", "part")
        .sortWithinPartitions("episode_id", "part", order)
        .select("episode_id", "part", F.col("line").alias("value"))
        .write.mode("overwrite")
        .partitionBy("episode_id", "part")
        .text(path)
    )


def write_transcript_text(segments: DataFrame, path: str, style: str = "range", layout: str = "packed") -> None:
    write_lines(transcript_lines(segments, style), path, layout=layout)


def listed_parts(df: DataFrame, order: str, item: Column, name: str) -> DataFrame:
    """Group rows to (episode_id, part, offset, name) with an ordered list."""
    in_order = F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), item.alias("__i"))))
    parts = df.withColumn("part", F.shiftright(F.col(order), PART_BITS))
    return parts.groupBy("episode_id", "part").agg(
        F.min(order).alias("offset"), F.transform(in_order, lambda x: x["__i"]).alias(name)
    )


def _parts(df: DataFrame, order: str, item: Column, name: str) -> DataFrame:
    """The listed parts with totals of the whole episode."""
    totals = part_totals(df.withColumn("part", F.shiftright(F.col(order), PART_BITS)), "episode_id")
    return join_on(listed_parts(df, order, item, name), totals, ["episode_id"])


def labeled_documents(segments: DataFrame, provenance: DataFrame) -> DataFrame:
    """Labelled segments with the episode's host identification."""
    item = F.struct(
        (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text", "speaker",
        "speaker_original",
    )
    return join_on(_parts(segments, "seg_idx", item, "segments"), provenance, ["episode_id"], "left")


def write_labeled_json(segments: DataFrame, provenance: DataFrame, path: str) -> None:
    labeled_documents(segments, provenance).write.mode("overwrite").json(path)


def stats_documents(segments: DataFrame) -> DataFrame:
    """Nested statistics per episode; speakers by speech time, longest first."""

    def summary(prefix: str) -> Column:
        return F.struct(*[F.col(f"{prefix}_{m}").alias(m) for m in ("count", "mean", "min", "max")])

    speakers = speaker_stats(segments).select(
        "episode_id",
        F.struct(
            (-F.col("total_speech_s")).alias("__k"), "speaker", "num_sentences", "total_speech_s", "total_words",
            "wpm_est", "question_count", "question_rate_per_sentence",
            summary("duration").alias("sentence_duration_s"), summary("words").alias("sentence_word_count"),
        ).alias("s"),
    )
    listed = speakers.groupBy("episode_id").agg(
        F.transform(F.sort_array(F.collect_list("s")), lambda s: s.dropFields("__k")).alias("per_speaker")
    )
    whole = episode_stats(segments).select(
        "episode_id", F.lit("utterance (sentence-like)").alias("unit"), "num_utterances_total",
        "audio_duration_s_est", summary("duration").alias("global_sentence_duration_s"),
        summary("words").alias("global_sentence_word_count"),
    )
    return join_on(whole, listed, ["episode_id"])


def fallback_stats_documents(segments: DataFrame) -> DataFrame:
    per = talk_time_turns(segments)
    return per.groupBy("episode_id").agg(
        F.lit("segment (fallback)").alias("unit"), F.max("num_segments").alias("num_segments"),
        F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("talk_time_s")).alias("__k"), "speaker", "talk_time_s", "turns"))),
            lambda s: s.dropFields("__k"),
        ).alias("speakers"),
    )


def response_stats_documents(utterances: DataFrame, built: DataFrame) -> DataFrame:
    """A statistics document per episode: of its utterances, or the fallback form of the segments built from its words.

    `built` has segments of episodes without utterances (`asrstats.word_segments`).
    """
    return stats_documents(utterances).unionByName(fallback_stats_documents(built), allowMissingColumns=True)


def write_stats_json(segments: DataFrame, path: str, built: DataFrame | None = None) -> None:
    """Statistics documents; with `built` also those of the episodes that have no utterances."""
    docs = stats_documents(segments) if built is None else response_stats_documents(segments, built)
    docs.write.mode("overwrite").json(path)


def write_stats_csv(stats: DataFrame, path: str) -> None:
    """`episode,word_count,sentence_count` with header, sorted by name across the files."""
    stats.select("episode", "word_count", "sentence_count").orderBy("episode").write.mode("overwrite").csv(
        path, header=True
    )


# --- fixed value: what a document without utterances says ----------------------
NO_UTTERANCES = "No results.utterances found. Re-run with --utterances --diarize."


def sentence_documents(episodes: DataFrame, utterances: DataFrame) -> DataFrame:
    """Sentence documents; an episode without utterances gets an error document.

    Utterances with empty text are kept. `num_segments` counts the whole episode,
    however many parts it is written in.
    """
    item = F.struct(
        "speaker_id", speaker_label("speaker_id").alias("speaker_label"), (F.col("start_ms") / 1000).alias("start"),
        (F.col("end_ms") / 1000).alias("end"), strip_ws("text").alias("transcript"),
    )
    docs = _parts(utterances, "seg_idx", item, "segments")
    missing = F.col("part").isNull()
    return (
        join_on(episodes.select("episode_id").distinct(), docs, ["episode_id"], "left")
        .select(
            "episode_id", F.coalesce("part", F.lit(0).cast("bigint")).alias("part"),
            F.lit("utterance (sentence-like)").alias("unit"),
            F.when(missing, NO_UTTERANCES).alias("error"),
            F.col("n_pieces").alias("num_segments"), F.coalesce("n_parts", F.lit(0).cast("bigint")).alias("n_parts"),
            F.coalesce("segments", F.array()).alias("segments"),
        )
    )


def write_sentence_json(episodes: DataFrame, utterances: DataFrame, path: str) -> None:
    sentence_documents(episodes, utterances).write.mode("overwrite").json(path)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 500


def write_clean_pair(normalized: DataFrame, path: str, key: str = "doc_id") -> None:
    """Cleaned text below `clean`, its lower-case copy below `lower`.

    Normalising costs more than writing, so the cleaned text is written once and
    the copy is made from what was written. Whole texts go to Python meanwhile,
    in batches of at most `TEXT_ROWS`.
    """
    spark = normalized.sparkSession
    clean = f"{path}/clean"
    before = spark.conf.get(ARROW_ROWS)
    # zero or less is no bound
    if not 0 < int(before) <= TEXT_ROWS:
        spark.conf.set(ARROW_ROWS, str(TEXT_ROWS))
    try:
        normalized.select(key, F.col("clean").alias("text")).write.mode("overwrite").parquet(clean)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    spark.read.parquet(clean).withColumn("text", F.lower("text")).write.mode("overwrite").parquet(f"{path}/lower")


def write_questions(docs: DataFrame, questions: DataFrame, path: str, key: str = "doc_id") -> None:
    """One row per document with its questions, one per line; empty ones included."""
    in_order = F.sort_array(F.collect_list(F.struct("sentence_idx", "sentence")))
    listed = questions.groupBy(key).agg(
        F.array_join(F.transform(in_order, lambda q: q["sentence"]), "\n").alias("text"),
        F.count(F.lit(1)).alias("n_questions"),
    )
    (
        join_on(docs.select(key), listed, [key], "left")
        .select(key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_questions", F.lit(0)).alias("n_questions"))
        .write.mode("overwrite")
        .json(path)
    )


def write_errors(results: DataFrame, good_path: str, error_path: str) -> None:
    """Successful items to one table, failed ones to another beside it."""
    results.filter("ok").write.mode("overwrite").json(good_path)
    results.filter("NOT ok").write.mode("overwrite").json(error_path)


def write_batch_summary(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def append_role_summary(lines: DataFrame, segments: DataFrame, model: bool = False) -> DataFrame:
    """Body lines, a blank line, a title and footer lines per speaker.

    Returns (episode_id, section, pos, line); ordering by the first three gives
    the text. `segments` has speaker_id, speaker, role, gender and, for the model
    form, reasoning and confidence.
    """
    per = segments.groupBy("episode_id", "speaker_id").agg(
        F.min_by("speaker", "seg_idx").alias("speaker"), F.min_by("role", "seg_idx").alias("role"),
        F.min_by("gender", "seg_idx").alias("gender"),
        *([F.min_by("reasoning", "seg_idx").alias("reasoning"),
           F.min_by("confidence", "seg_idx").alias("confidence")] if model else []),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"),
    )
    tenths = F.bround(F.col("ms") / 100, 0).cast("bigint")
    seconds = F.format_string("%d.%d", F.floor(tenths / 10).cast("bigint"), F.pmod(tenths, F.lit(10)))
    if model:
        cents = F.bround(F.col("confidence") * 100, 0).cast("bigint")
        score = F.format_string("%d.%02d", F.floor(cents / 100).cast("bigint"), F.pmod(cents, F.lit(100)))
        footer = F.array(
            F.concat(F.lit("# "), "speaker", F.lit(" = "), "role", F.lit(" ("), "gender", F.lit(") - "), score, F.lit(" confidence")),
            F.concat(F.lit("#   Reason: "), "reasoning"),
            F.concat(F.lit("#   Speaking time: "), seconds, F.lit("s")),
        )
        title = "# LLM Speaker Analysis:"
    else:
        name = speaker_label("speaker_id")
        footer = F.array(
            F.concat(F.lit("# "), name, F.lit(" = "), "role", F.lit(" ("), "gender", F.lit(") - "), seconds, F.lit("s total"))
        )
        title = "# Speaker Summary:"
    body = lines.select("episode_id", F.lit(0).alias("section"), F.col("seg_idx").alias("pos"), "line")
    head = (
        segments.select("episode_id")
        .distinct()
        .select("episode_id", F.lit(1).alias("section"), F.posexplode(F.array(F.lit(""), F.lit(title))).alias("pos", "line"))
        .withColumn("pos", F.col("pos").cast("bigint"))
    )
    tail = per.select(
        "episode_id", F.lit(2).alias("section"), "speaker_id", F.posexplode(footer).alias("__p", "line")
    ).select("episode_id", "section", (F.col("speaker_id") * 4 + F.col("__p")).cast("bigint").alias("pos"), "line")
    return body.unionByName(head).unionByName(tail)
