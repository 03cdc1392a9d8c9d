"""Queries for the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import intervals, lookups, ranking, sequences, stats, textops
from colloquy.plans import views as V
from colloquy.plans.joins import GENDERED, OVERLAPS, SAMPLES, feed_segments, regions
from colloquy.plans.registry import query
from colloquy.plans.scalars import IS_QUESTION, TRIMMED, cue_hits_sql, host_score_sql
from colloquy.plans.views import FEED, SEG, rr, wc

FACTS = f"""fact AS (SELECT episode_id, speaker, seg_idx, start_ms, end_ms, greatest(0, end_ms - start_ms) AS d, {wc('text')} AS w,
      regexp_matches(text, '\\?\\s*$')::BIGINT AS q, contains(text, '?')::BIGINT AS qa FROM seg)"""


def _summary(prefix: str, value: str, scale: int) -> str:
    return (
        f"count(*) AS {prefix}_count, {rr(f'sum({value})', f'count(*) * {scale}', 3)} AS {prefix}_mean, "
        f"min({value})::DOUBLE / {scale} AS {prefix}_min, max({value})::DOUBLE / {scale} AS {prefix}_max"
    )


def _speaker_sql(q: str = "q", wpm: int = 2, rate: int = 4) -> str:
    return (
        f"count(*) AS num_sentences, sum(d)::DOUBLE / 1000 AS total_speech_s, sum(w)::BIGINT AS total_words, "
        f"{rr('sum(w) * 60000', 'sum(d)', wpm)} AS wpm_est, sum({q})::BIGINT AS question_count, "
        f"{rr(f'sum({q})', 'count(*)', rate)} AS question_rate_per_sentence, "
        f"{_summary('duration', 'd', 1000)}, {_summary('words', 'w', 1)}"
    )


@query("ag01_speaker_stats", f"WITH {SEG}, {FACTS} SELECT episode_id, speaker, {_speaker_sql()} FROM fact GROUP BY 1, 2")
def ag01(spark, sf):
    return stats.speaker_stats(V.segments(spark, sf))


@query(
    "ag02_episode_stats",
    f"""WITH {SEG}, {FACTS} SELECT episode_id, count(*) AS num_utterances_total, max(end_ms)::DOUBLE / 1000 AS audio_duration_s_est,
      {_summary('duration', 'd', 1000)}, {_summary('words', 'w', 1)} FROM fact GROUP BY 1""",
)
def ag02(spark, sf):
    return stats.episode_stats(V.segments(spark, sf))


@query(
    "ag03_two_grain_stats",
    f"""WITH {SEG}, {FACTS} SELECT episode_id, speaker, CASE WHEN grouping(speaker) = 0 THEN 'speaker' ELSE 'episode' END AS grain,
      max(end_ms)::DOUBLE / 1000 AS audio_duration_s_est, {_speaker_sql()} FROM fact
    GROUP BY GROUPING SETS ((episode_id), (episode_id, speaker))""",
)
def ag03(spark, sf):
    return stats.two_grain_stats(V.segments(spark, sf))


@query(
    "ag04_summarize_median",
    f"""WITH {SEG}, {FACTS} SELECT episode_id, speaker, {_speaker_sql('qa', 1, 2)},
      list_sort(list(d))[count(*) // 2 + 1]::DOUBLE / 1000 AS duration_median,
      list_sort(list(w))[count(*) // 2 + 1]::DOUBLE AS words_median FROM fact GROUP BY 1, 2""",
)
def ag04(spark, sf):
    return stats.summarize_median(V.segments(spark, sf))


@query(
    "ag05_talk_time_turns",
    f"""WITH {FEED}, t AS (SELECT episode_id, speaker, sum(greatest(0, end_ms - start_ms))::DOUBLE / 1000 AS talk_time_s, count(*) AS turns
      FROM feed GROUP BY 1, 2)
    SELECT *, (sum(turns) OVER (PARTITION BY episode_id))::BIGINT AS num_segments FROM t""",
)
def ag05(spark, sf):
    return stats.talk_time_turns(V.feed(spark, sf))


@query(
    "ag06_speaker_gender",
    f"""WITH {FEED}, {OVERLAPS}, {GENDERED} SELECT episode_id, speaker, g AS gender, male_ms::DOUBLE / 1000 AS male_time,
      female_ms::DOUBLE / 1000 AS female_time, total::DOUBLE / 1000 AS total_gendered_time, conf AS confidence FROM gender""",
)
def ag06(spark, sf):
    return intervals.speaker_gender(intervals.gender_overlap(V.feed(spark, sf), regions(spark, sf)))


@query(
    "ag06_speaker_gender_strict",
    f"""WITH {FEED}, {OVERLAPS}, {GENDERED} SELECT episode_id, speaker,
      CASE WHEN greatest(male_ms, female_ms)::DOUBLE / total::DOUBLE > 0.6::DOUBLE THEN CASE WHEN male_ms >= female_ms THEN 'male' ELSE 'female' END
        ELSE 'unknown' END AS gender, male_ms::DOUBLE / 1000 AS male_time, female_ms::DOUBLE / 1000 AS female_time,
      total::DOUBLE / 1000 AS total_gendered_time, conf AS confidence FROM gender""",
)
def ag06_strict(spark, sf):
    return intervals.speaker_gender(intervals.gender_overlap(V.feed(spark, sf), regions(spark, sf)), strict=True)


EVEN = """num AS (SELECT *, row_number() OVER (PARTITION BY episode_id, speaker ORDER BY idx) - 1 AS i,
      count(*) OVER (PARTITION BY episode_id, speaker) AS n FROM feed),
    picked AS (SELECT * FROM num WHERE n <= 10 OR i IN (0, (n - 1) // 9, 2 * (n - 1) // 9, 3 * (n - 1) // 9, 4 * (n - 1) // 9,
      5 * (n - 1) // 9, 6 * (n - 1) // 9, 7 * (n - 1) // 9, 8 * (n - 1) // 9, n - 1))"""


@query(
    "ag07_pitch_gender",
    f"""WITH {FEED}, {EVEN}, p AS (SELECT episode_id, speaker, sum(round(median_hz * 100)::HUGEINT) AS s1,
        sum((round(median_hz * 100)::HUGEINT) * (round(median_hz * 100)::HUGEINT)) AS s2, count(median_hz) AS n FROM picked GROUP BY 1, 2),
    m AS (SELECT episode_id, speaker, n, s1::DOUBLE / (n * 100) AS mean, sqrt((n * s2 - s1 * s1)::DOUBLE) / (n * 100) AS std FROM p),
    g AS (SELECT *, CASE WHEN n = 0 THEN 'unknown' WHEN mean < 165 THEN 'male' WHEN mean > 180 THEN 'female' ELSE 'ambiguous' END AS gender FROM m)
    SELECT episode_id, speaker, gender, mean AS avg_pitch, std AS std_pitch, n AS sample_count,
      CASE gender WHEN 'unknown' THEN 0.0::DOUBLE WHEN 'ambiguous' THEN 0.3::DOUBLE
        WHEN 'male' THEN ((1.0::DOUBLE - least(std / mean, 1.0::DOUBLE)) + greatest(0.0::DOUBLE, 165 - mean) / 80) / 2
        ELSE ((1.0::DOUBLE - least(std / mean, 1.0::DOUBLE)) + greatest(0.0::DOUBLE, mean - 180) / 75) / 2 END AS confidence FROM g""",
)
def ag07(spark, sf):
    return stats.pitch_gender(sequences.even_sample(V.feed(spark, sf), order="idx"))


@query(
    "ag08_questions_by_speaker",
    f"""WITH {SEG} SELECT episode_id, speaker, count(*) AS questions FROM seg
    WHERE speaker <> 'Unknown' AND {TRIMMED} <> '' AND {IS_QUESTION} GROUP BY 1, 2""",
)
def ag08(spark, sf):
    return stats.questions_by_speaker(V.segments(spark, sf))


@query(
    "ag10_speaking_time",
    f"""WITH {SEG}, t AS (SELECT episode_id, speaker, sum(end_ms - start_ms) AS ms FROM seg WHERE speaker <> 'Unknown' GROUP BY 1, 2),
    u AS (SELECT *, sum(ms) OVER (PARTITION BY episode_id) AS total FROM t)
    SELECT episode_id, speaker, ms::DOUBLE / 1000 AS speech_s, CASE WHEN total = 0 THEN 0.0 ELSE ms::DOUBLE / total::DOUBLE END AS share FROM u""",
)
def ag10(spark, sf):
    return stats.speaking_time(V.segments(spark, sf))


@query(
    "ag11_speaker_duration_confidence",
    f"""WITH {SEG} SELECT episode_id, speaker, sum(end_ms - start_ms)::DOUBLE / 1000 AS total_time, count(*) AS utterance_count,
      {rr('sum(round(confidence * 1000000)::BIGINT)', 'count(*) * 1000000', 6)} AS avg_confidence FROM seg GROUP BY 1, 2""",
)
def ag11(spark, sf):
    return stats.speaker_duration_confidence(V.segments(spark, sf))


@query(
    "ag12_speaker_confidence",
    f"""WITH {FEED}, t AS (SELECT episode_id, speaker, sum(end_ms - start_ms) AS ms, count(*) AS n FROM feed GROUP BY 1, 2),
    u AS (SELECT *, sum(ms) OVER (PARTITION BY episode_id) AS ams, sum(n) OVER (PARTITION BY episode_id) AS an FROM t)
    SELECT episode_id, speaker, (CASE WHEN ams = 0 THEN 0.0 ELSE ms::DOUBLE / ams::DOUBLE END) * 0.6::DOUBLE
      + (n::DOUBLE / an::DOUBLE) * 0.4::DOUBLE AS confidence_score FROM u""",
)
def ag12(spark, sf):
    return stats.speaker_confidence(V.feed(spark, sf))


@query(
    "ag13_turn_stats",
    f"""WITH {SEG}, l AS (SELECT episode_id, speaker, seg_idx, {TRIMMED} AS text FROM seg),
    p AS (SELECT episode_id, speaker, count(*) AS turn_count, CASE WHEN count(nullif(text, '')) = 0 THEN 0.0
        ELSE sum(length(text))::DOUBLE / count(nullif(text, '')) END AS avg_utterance_chars, min(seg_idx) AS f FROM l GROUP BY 1, 2)
    SELECT episode_id, speaker, turn_count, avg_utterance_chars,
      first_value(speaker) OVER (PARTITION BY episode_id ORDER BY f) AS first_speaker,
      (sum(turn_count) OVER (PARTITION BY episode_id))::BIGINT AS num_turns FROM p""",
)
def ag13(spark, sf):
    from colloquy.functions.text import strip_ws

    return stats.turn_stats(V.segments(spark, sf).withColumn("text", strip_ws("text")))


@query(
    "ag13_turn_stats_drop_empty",
    f"""WITH {SEG}, l AS (SELECT episode_id, speaker, seg_idx, {TRIMMED} AS text FROM seg WHERE {TRIMMED} <> ''),
    p AS (SELECT episode_id, speaker, count(*) AS turn_count, sum(length(text))::DOUBLE / count(*) AS avg_utterance_chars,
      min(seg_idx) AS f FROM l GROUP BY 1, 2)
    SELECT episode_id, speaker, turn_count, avg_utterance_chars,
      first_value(speaker) OVER (PARTITION BY episode_id ORDER BY f) AS first_speaker,
      (sum(turn_count) OVER (PARTITION BY episode_id))::BIGINT AS num_turns FROM p""",
)
def ag13_drop_empty(spark, sf):
    from colloquy.functions.text import strip_ws

    return stats.turn_stats(V.segments(spark, sf).withColumn("text", strip_ws("text")), drop_empty=True)


@query(
    "ag14_document_stats",
    f"""SELECT 'ep' || doc_id AS episode, {wc('text')} AS word_count,
      (length(text) - length(replace(replace(replace(text, '.', ''), '?', ''), '!', '')))::BIGINT AS sentence_count FROM documents""",
)
def ag14(spark, sf):
    docs = V.documents(spark, sf).select(F.concat(F.lit("ep"), "doc_id").alias("episode"), "text")
    return stats.document_stats(docs)


@query(
    "ag15_host_score",
    f"WITH {SEG} SELECT episode_id, speaker_raw AS speaker, sum({host_score_sql('text')}) AS score FROM seg GROUP BY 1, 2",
)
def ag15(spark, sf):
    return stats.host_score(V.segments(spark, sf))


def score_sql(asr: bool) -> str:
    marks = "sum(length(sample) - length(replace(sample, '?', '')))" if asr else "0"
    return (
        f"arg_min(start_ms, seg_idx) * -0.5::DOUBLE / 1000 + sum({cue_hits_sql('sample', asr)}) * 10.0::DOUBLE "
        f"+ sum(length(sample)) * 0.01::DOUBLE + {marks} * 5.0::DOUBLE"
    )


SCORES = f"""ten AS (SELECT * FROM samples WHERE rn <= 10),
    scores AS (SELECT episode_id, speaker, {score_sql(False)} AS score, {score_sql(True)} AS score_asr,
      min(seg_idx) AS first_idx FROM ten GROUP BY 1, 2)"""


@query("ag16_heuristic_host_score", f"WITH {SEG}, {SAMPLES}, {SCORES} SELECT * FROM scores")
def ag16(spark, sf):
    samples = ranking.first_n_per_speaker(V.segments(spark, sf))
    plain = stats.heuristic_host_score(samples)
    asr = stats.heuristic_host_score(samples, asr=True).select("episode_id", "speaker", F.col("score").alias("score_asr"))
    return plain.join(asr, ["episode_id", "speaker"])


def batch_results(spark, sf):
    """One batch item per document; the item fails when its text is short."""
    return V.documents(spark, sf).select(
        F.concat(F.lit("ep"), "doc_id", F.lit(".wav")).alias("file"),
        (F.col("n_chars") >= 300).alias("ok"),
        F.when(F.col("n_chars") >= 300, 200).otherwise(400).alias("status"),
        (F.col("n_chars") * 7).alias("time_ms"),
        (F.col("lang") == "fr").alias("skipped"),
    )


BATCH = """batch AS (SELECT 'ep' || doc_id || '.wav' AS file, n_chars >= 300 AS ok, CASE WHEN n_chars >= 300 THEN 200 ELSE 400 END AS status,
      n_chars * 7 AS time_ms, lang = 'fr' AS skipped FROM documents)"""


@query(
    "ag17_batch_summary",
    f"""WITH {BATCH} SELECT count(*) AS total, count_if(ok)::BIGINT AS successful, count_if(NOT ok)::BIGINT AS failed,
      {rr('sum(time_ms)', '60000', 4)} AS total_time_minutes, {rr('sum(time_ms)', 'count(*) * 60000', 4)} AS avg_time_per_file_minutes FROM batch""",
)
def ag17(spark, sf):
    return stats.batch_summary(batch_results(spark, sf))


@query(
    "ag18_distinct_speakers",
    f"""WITH {FEED} SELECT episode_id, speaker, arg_min(gender, idx) AS gender, arg_min(event_type, idx) AS role FROM feed GROUP BY 1, 2""",
)
def ag18(spark, sf):
    return stats.distinct_speakers(feed_segments(spark, sf).withColumnRenamed("event_type", "role"))


@query(
    "ag19_last_gender_by_role",
    f"WITH {FEED} SELECT episode_id, event_type AS role, arg_max(gender, idx) AS gender FROM feed GROUP BY 1, 2",
)
def ag19(spark, sf):
    return stats.last_gender_by_role(feed_segments(spark, sf).withColumnRenamed("event_type", "role"))


@query(
    "ag20_reassemble_text",
    f"""WITH {SEG} SELECT episode_id, seg_idx // 4096 AS part, string_agg({TRIMMED}, chr(10) ORDER BY seg_idx) AS text,
      count(*) OVER (PARTITION BY episode_id) AS n_parts, sum(count(*)) OVER (PARTITION BY episode_id)::BIGINT AS n_pieces
    FROM seg WHERE {TRIMMED} <> '' GROUP BY 1, 2""",
)
def ag20(spark, sf):
    from colloquy.operators.filters import drop_empty_text

    return textops.reassemble_text(drop_empty_text(V.segments(spark, sf)))


@query(
    "ag21_category_counts",
    f"""WITH {SEG} SELECT episode_id, count_if(speaker = 'Speaker 2')::BIGINT AS host_segments,
      count_if(speaker = 'Speaker 1')::BIGINT AS guest_segments, count_if(speaker = 'Unknown')::BIGINT AS unknown_segments FROM seg GROUP BY 1""",
)
def ag21(spark, sf):
    s = V.segments(spark, sf)
    hosts = s.select("episode_id").distinct().withColumn("host", F.lit("Speaker 2"))
    return stats.category_counts(lookups.apply_host(s, hosts))
