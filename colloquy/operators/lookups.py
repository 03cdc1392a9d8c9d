"""Equality lookups: attach attributes, keep or skip rows by key.

No side is broadcast by hint. Catalyst and AQE broadcast a mapping when its
measured size is below spark.sql.autoBroadcastJoinThreshold; otherwise the join
shuffles and AQE splits a hot episode. NULL episodes and speakers match each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.labels import relabel_host_guest
from colloquy.operators.blocks import join_on

# --- fixed values: preference among audio files of the same stem --------------
MEDIA_PREFERENCE = [".wav", ".mp3", ".mp4", ".m4a", ".flac", ".ogg"]


def map_speakers(segments: DataFrame, mapping: DataFrame, default: str = "Unknown", on: str = "speaker_raw") -> DataFrame:
    """Add `mapped` from `mapping(episode_id, speaker, label)`."""
    names = mapping.select("episode_id", F.col("speaker").alias(on), F.col("label").alias("mapped"))
    return join_on(segments, names, ["episode_id", on], "left").withColumn("mapped", F.coalesce("mapped", F.lit(default)))


def apply_gender(rows: DataFrame, genders: DataFrame) -> DataFrame:
    """Add `gender` and `gender_confidence`; unknown and 0.0 where there is none."""
    side = genders.select("episode_id", "speaker", "gender", F.col("confidence").alias("gender_confidence"))
    return join_on(rows, side, ["episode_id", "speaker"], "left").fillna({"gender": "unknown", "gender_confidence": 0.0})


def apply_host(segments: DataFrame, hosts: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Relabel speakers as Host, Guest or Unknown by `hosts(episode_id, host)`.

    `carry` names further columns of `hosts` to add, such as the method.
    """
    joined = join_on(segments, hosts.select("episode_id", "host", *carry), ["episode_id"], "left")
    label = relabel_host_guest("speaker", "host")
    return (
        joined.withColumn("__l", label)
        .withColumns({"speaker_original": F.col("__l.speaker_original"), "speaker": F.col("__l.speaker")})
        .drop("__l", "host")
    )


def apply_model_labels(segments: DataFrame, replies: DataFrame) -> DataFrame:
    """Add role, reasoning and model confidence by speaker id.

    `replies(episode_id, mapping, reasoning_brief, confidence)` holds maps keyed
    by the id as text. The segment's own confidence stays as original_confidence.
    """
    key = F.col("speaker_id").cast("string")
    side = replies.select(
        "episode_id",
        F.col("mapping").alias("__m"), F.col("reasoning_brief").alias("__r"), F.col("confidence").alias("__c"),
    )
    return (
        join_on(segments.withColumnRenamed("confidence", "original_confidence"), side, ["episode_id"], "left")
        .withColumns(
            {
                "role": F.coalesce(F.try_element_at("__m", key), F.lit("UNKNOWN")),
                "reasoning": F.coalesce(F.try_element_at("__r", key), F.lit("No reasoning provided")),
                "confidence": F.coalesce(F.try_element_at("__c", key), F.lit(0.5)),
            }
        )
        .drop("__m", "__r", "__c")
    )


def keep_top_speakers(segments: DataFrame, top: DataFrame) -> DataFrame:
    return join_on(segments, top.select("episode_id", "speaker"), ["episode_id", "speaker"], "left_semi")


def skip_processed(inputs: DataFrame, outputs: DataFrame, required: int = 1, overwrite: bool = False) -> DataFrame:
    """Inputs whose stem does not yet have `required` different outputs.

    `outputs(stem, kind)` lists what exists, one row per file.
    """
    if overwrite:
        return inputs
    done = outputs.distinct().groupBy("stem").agg(F.count("kind").alias("n")).filter(F.col("n") >= required)
    return inputs.join(done, "stem", "left_anti")


def pair_media(documents: DataFrame, media: DataFrame) -> DataFrame:
    """Attach to each document stem the best media file; no match gives an error."""
    order = F.array(*[F.lit(e) for e in MEDIA_PREFERENCE])
    rank = F.array_position(order, F.col("ext"))
    best = (
        media.withColumn("__rank", rank)
        .filter(F.col("__rank") > 0)
        .groupBy("stem")
        .agg(F.min_by("path", F.struct("__rank", "path")).alias("media_path"))
    )
    return documents.join(best, "stem", "left").withColumn(
        "error", F.when(F.col("media_path").isNull(), F.lit("No matching media file"))
    )


def accept_candidate(candidates: DataFrame, samples: DataFrame) -> DataFrame:
    """Candidates (episode_id, speaker) that are among the sampled speakers."""
    sampled = samples.select("episode_id", "speaker").distinct()
    return join_on(candidates, sampled, ["episode_id", "speaker"], "left_semi")
