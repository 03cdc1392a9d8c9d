"""Top-k, sampling and ordered previews.

`row_number() <= k` is planned with a group limit before the shuffle, so a hot
episode sends at most k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.labels import render_line
from colloquy.functions.text import squash_ws, strip_ws, truncate_ellipsis
from colloquy.functions.timefmt import duration, fmt_hms
from colloquy.operators.blocks import join_on


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str | None = None) -> DataFrame:
    """The first k rows per key in the given order."""
    rank = name or "__rank"
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)
    return out if name else out.drop(rank)


def _durations(rows: DataFrame, order: str, clamp: bool = True) -> DataFrame:
    return rows.groupBy("episode_id", "speaker").agg(
        F.sum(duration("start_ms", "end_ms", clamp)).cast("bigint").alias("total_ms"),
        F.min(order).alias("first_idx"),
        F.min_by("start_ms", order).alias("first_start_ms"),
    )


def top_speakers(rows: DataFrame, k: int = 2, order: str = "seg_idx") -> DataFrame:
    """The k speakers with most time, in rank order; ties go to the first heard."""
    per = _durations(rows, order)
    return first_k(per, ["episode_id"], [F.desc("total_ms"), F.asc("first_idx")], k, "rank").select(
        "episode_id", "speaker", "total_ms", "rank"
    )


def speaker_mapping(turns: DataFrame, k: int = 2) -> DataFrame:
    """Label the top k speakers `Speaker 1..k` in order of first appearance."""
    per = _durations(turns, "turn_idx")
    top = first_k(per, ["episode_id"], [F.desc("total_ms"), F.asc("first_idx")], k, "__r")
    number = F.row_number().over(Window.partitionBy("episode_id").orderBy("first_start_ms", "__r"))
    return top.withColumn("label", F.concat(F.lit("Speaker "), number.cast("string"))).select(
        "episode_id", "speaker", "label", "total_ms"
    )


def consolidate_speakers(segments: DataFrame, k: int = 2) -> DataFrame:
    """Segments of the top k speakers, renumbered by speaking time."""
    per = _durations(segments, "seg_idx", clamp=False)
    top = first_k(per, ["episode_id"], [F.desc("total_ms"), F.asc("first_idx")], k, "__r").select(
        "episode_id", "speaker", (F.col("__r") - 1).alias("new_id")
    )
    return join_on(segments, top, ["episode_id", "speaker"]).withColumn(
        "speaker_label", F.concat(F.lit("Speaker "), (F.col("new_id") + 1).cast("string"))
    )


def first_n_per_speaker(
    segments: DataFrame, n: int = 14, from_start: int = 250, max_chars: int = 220, speaker: str = "speaker"
) -> DataFrame:
    """Early samples: the episode's first segments, at most n non-empty per speaker."""
    early = segments
    if from_start > 0:
        early = first_k(segments, ["episode_id"], [F.asc("seg_idx")], from_start)
    spoken = early.filter(strip_ws("text") != "")
    return first_k(spoken, ["episode_id", speaker], [F.asc("seg_idx")], n).withColumn(
        "sample", truncate_ellipsis(squash_ws("text"), max_chars)
    )


def first_n_per_speaker_then_m(segments: DataFrame, n: int = 10, m: int = 5) -> DataFrame:
    """First n rows per speaker, of these the first m, blank ones skipped last."""
    taken = first_k(segments, ["episode_id", "speaker"], [F.asc("seg_idx")], n)
    shown = first_k(taken, ["episode_id", "speaker"], [F.asc("seg_idx")], m)
    return shown.filter(strip_ws("text") != "")


def head_tail_sample(segments: DataFrame, max_rows: int = 240) -> DataFrame:
    """All rows of a short episode, else its first and last halves of `max_rows`."""
    head = max_rows // 2
    first = first_k(segments, ["episode_id"], [F.asc("seg_idx")], head)
    last = first_k(segments, ["episode_id"], [F.desc("seg_idx")], max_rows - head)
    return first.unionByName(last).dropDuplicates(["episode_id", "seg_idx"])


def head_mid_tail_lines(
    lines: DataFrame, edge: int = 80, middle: int = 120, max_chars: int = 12000
) -> DataFrame:
    """A text sample per episode from its beginning, middle and end.

    `line_idx` is the position in the document, from 0 without holes. The parts
    may repeat lines. Every line costs at least one character, so at
    most `max_chars` lines of a part can show; more are not gathered.
    """
    numbered = lines.withColumn("__i", F.col("line_idx"))
    sizes = lines.groupBy("episode_id").agg(F.count(F.lit(1)).alias("__n"))
    i, n = F.col("__i"), F.col("__n")
    wing = F.least(n, F.greatest(F.lit(edge), F.floor(n / 10)))
    mid_start = F.greatest(F.lit(0), F.floor(n / 2) - middle // 2)
    tail_start = n - wing
    marks = F.filter(
        F.array(
            F.when((i < wing) & (i < max_chars), F.lit(0)),
            F.when((i >= mid_start) & (i < mid_start + middle), F.lit(1)),
            F.when((i >= tail_start) & (i < tail_start + max_chars), F.lit(2)),
        ),
        lambda p: p.isNotNull(),
    )
    picked = join_on(numbered, sizes, ["episode_id"]).withColumn("__part", F.explode(marks))
    ordered = F.sort_array(F.collect_list(F.struct("__i", "line")))
    parts = picked.groupBy("episode_id").pivot("__part", [0, 1, 2]).agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    )
    sample = F.concat(
        F.lit("=== BEGINNING ===\n"), F.coalesce(F.col("0"), F.lit("")),
        F.lit("\n\n=== MIDDLE ===\n"), F.coalesce(F.col("1"), F.lit("")),
        F.lit("\n\n=== END ===\n"), F.coalesce(F.col("2"), F.lit("")), F.lit("\n"),
    )
    return parts.select("episode_id", F.left(sample, F.lit(max_chars)).alias("sample"))


def argmax_speaker(counts: DataFrame, metric: str = "n", first: str = "first_idx") -> DataFrame:
    """The speaker with the largest metric; ties go to the first heard."""
    return counts.groupBy("episode_id").agg(
        F.max_by("speaker", F.struct(F.col(metric), -F.col(first))).alias("speaker"), F.max(metric).alias(metric)
    )


def sort_by_start(segments: DataFrame) -> DataFrame:
    return segments.orderBy("episode_id", "start_ms", "seg_idx")


def sort_by_talk_time(stats: DataFrame, metric: str = "total_speech_s") -> DataFrame:
    return stats.orderBy("episode_id", F.desc(metric), "speaker")


def preview(segments: DataFrame, n: int = 5, max_chars: int = 100) -> DataFrame:
    """First n evidence segments per episode with shortened text."""
    return first_k(segments, ["episode_id"], [F.asc("seg_idx")], n).withColumn(
        "preview", F.left(strip_ws("text"), F.lit(max_chars))
    )


def prompt_text(samples: DataFrame) -> DataFrame:
    """One text per episode: speakers by name, each with its sample lines."""
    line = F.concat(
        F.lit("- ["), fmt_hms(F.col("start_ms") / 1000), F.lit("–"), fmt_hms(F.col("end_ms") / 1000),
        F.lit("] "), F.col("sample"),
    )
    in_order = F.sort_array(F.collect_list(F.struct("seg_idx", line.alias("line"))))
    blocks = samples.groupBy("episode_id", "speaker").agg(
        F.concat(
            F.col("speaker"), F.lit(" examples:\n"), F.array_join(F.transform(in_order, lambda x: x["line"]), "\n")
        ).alias("block")
    )
    by_name = F.sort_array(F.collect_list(F.struct("speaker", "block")))
    return blocks.groupBy("episode_id").agg(
        F.array_join(F.transform(by_name, lambda x: x["block"]), "\n\n").alias("prompt")
    )


def excerpt_lines(segments: DataFrame, max_rows: int = 240) -> DataFrame:
    """Rendered lines of the head-and-tail sample; blank texts drop out after the cut."""
    sample = head_tail_sample(segments, max_rows)
    return (
        sample.withColumn("line", render_line("speaker", "text", "start_ms", "end_ms"))
        .filter(F.col("line").isNotNull())
        .select("episode_id", "seg_idx", "line")
    )
