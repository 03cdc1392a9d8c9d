"""Queries for top-k, sampling, ordering and previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import ranking, sequences, stats
from colloquy.plans import views as V
from colloquy.plans.joins import MAPPING, SAMPLES, TOP_FEED, feed_segments
from colloquy.plans.registry import query
from colloquy.plans.scalars import TRIMMED
from colloquy.plans.sequencequeries import LINE_LIST
from colloquy.plans.views import FEED, SEG, TURN, clock


@query("tk01_speaker_mapping", f"WITH {TURN}, {MAPPING} SELECT episode_id, speaker, label, total_ms FROM mapping")
def tk01(spark, sf):
    return ranking.speaker_mapping(V.turns(spark, sf))


@query(
    "tk02_consolidate_speakers",
    f"""WITH {SEG}, s AS (SELECT * FROM seg WHERE {TRIMMED} <> ''),
    d AS (SELECT episode_id, speaker, sum(end_ms - start_ms) AS ms, min(seg_idx) AS f FROM s GROUP BY 1, 2),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY ms DESC, f) AS r FROM d) x WHERE r <= 2)
    SELECT s.episode_id, s.seg_idx, 'Speaker ' || t.r AS speaker_label, s.start_ms, s.confidence
    FROM s JOIN t ON t.episode_id = s.episode_id AND t.speaker = s.speaker""",
)
def tk02(spark, sf):
    from colloquy.operators.filters import drop_empty_text

    out = ranking.consolidate_speakers(drop_empty_text(V.segments(spark, sf)))
    return ranking.sort_by_start(out).select("episode_id", "seg_idx", "speaker_label", "start_ms", "confidence")


@query("tk03_first_n_per_speaker", f"WITH {SEG}, {SAMPLES} SELECT episode_id, speaker, seg_idx, sample FROM samples")
def tk03(spark, sf):
    return ranking.first_n_per_speaker(V.segments(spark, sf)).select("episode_id", "speaker", "seg_idx", "sample")


@query(
    "tk04_first_n_per_speaker_then_m",
    f"""WITH {SEG}, a AS (SELECT *, row_number() OVER (PARTITION BY episode_id, speaker ORDER BY seg_idx) AS rn FROM seg)
    SELECT episode_id, speaker, seg_idx FROM a WHERE rn <= 5 AND {TRIMMED} <> ''""",
)
def tk04(spark, sf):
    return ranking.first_n_per_speaker_then_m(V.segments(spark, sf)).select("episode_id", "speaker", "seg_idx")


@query(
    "tk05_head_tail_sample",
    f"""WITH {FEED}, n AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY idx) AS i,
      count(*) OVER (PARTITION BY episode_id) AS n FROM feed)
    SELECT episode_id, idx AS seg_idx, speaker FROM n WHERE n <= 41 OR i <= 20 OR i > n - 21""",
)
def tk05(spark, sf):
    return ranking.head_tail_sample(feed_segments(spark, sf), 41).select("episode_id", "seg_idx", "speaker")


@query(
    "tk06_head_mid_tail_lines",
    f"""WITH l AS (SELECT doc_id, {LINE_LIST} AS x FROM documents), n AS (SELECT *, len(x) AS n, least(len(x), greatest(8, len(x) // 10)) AS w FROM l)
    SELECT doc_id AS episode_id, left('=== BEGINNING ===' || chr(10) || array_to_string(x[1:w], chr(10)) || chr(10) || chr(10) || '=== MIDDLE ===' || chr(10)
      || array_to_string(x[greatest(0, n // 2 - 6) + 1:greatest(0, n // 2 - 6) + 12], chr(10)) || chr(10) || chr(10) || '=== END ===' || chr(10)
      || array_to_string(x[n - w + 1:n], chr(10)) || chr(10), 1500) AS sample FROM n""",
)
def tk06(spark, sf):
    docs = V.documents(spark, sf).selectExpr("doc_id AS episode_id", "text")
    lines = sequences.split_lines(docs).withColumn("line_idx", F.col("line_idx").cast("bigint"))
    return ranking.head_mid_tail_lines(lines, edge=8, middle=12, max_chars=1500)


@query(
    "tk06_head_mid_tail_wide",
    f"""WITH l AS (SELECT doc_id, {LINE_LIST} AS x FROM documents), n AS (SELECT *, len(x) AS n, least(len(x), greatest(60, len(x) // 10)) AS w FROM l)
    SELECT doc_id AS episode_id, left('=== BEGINNING ===' || chr(10) || array_to_string(x[1:w], chr(10)) || chr(10) || chr(10) || '=== MIDDLE ===' || chr(10)
      || array_to_string(x[greatest(0, n // 2 - 40) + 1:greatest(0, n // 2 - 40) + 80], chr(10)) || chr(10) || chr(10) || '=== END ===' || chr(10)
      || array_to_string(x[n - w + 1:n], chr(10)) || chr(10), 12000) AS sample FROM n""",
)
def tk06_wide(spark, sf):
    docs = V.documents(spark, sf).selectExpr("doc_id AS episode_id", "text")
    lines = sequences.split_lines(docs).withColumn("line_idx", F.col("line_idx").cast("bigint"))
    return ranking.head_mid_tail_lines(lines, edge=60, middle=80)


@query(
    "tk07_argmax_speaker",
    f"""WITH {FEED}, c AS (SELECT episode_id, speaker, count(*) AS n, min(idx) AS f FROM feed GROUP BY 1, 2)
    SELECT episode_id, speaker, n FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY n DESC, f) AS r FROM c) x WHERE r = 1""",
)
def tk07(spark, sf):
    counts = V.feed(spark, sf).groupBy("episode_id", "speaker").agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx")
    )
    return ranking.argmax_speaker(counts)


@query(
    "tk08_sort_by_talk_time",
    f"""WITH {SEG} SELECT episode_id, speaker, sum(greatest(0, end_ms - start_ms))::DOUBLE / 1000 AS total_speech_s FROM seg
    GROUP BY 1, 2 ORDER BY episode_id, total_speech_s DESC""",
)
def tk08(spark, sf):
    per = stats.speaker_stats(V.segments(spark, sf)).select("episode_id", "speaker", "total_speech_s")
    return ranking.sort_by_talk_time(per)


@query(
    "tk08_sort_by_start",
    f"WITH {FEED} SELECT episode_id, idx AS seg_idx, start_ms FROM feed ORDER BY episode_id, start_ms, idx",
)
def tk08_start(spark, sf):
    return ranking.sort_by_start(feed_segments(spark, sf).select("episode_id", "seg_idx", "start_ms"))


@query(
    "tk09_preview",
    f"""WITH {SEG} SELECT episode_id, seg_idx, left({TRIMMED}, 100) AS preview FROM
      (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seg_idx) AS r FROM seg WHERE regexp_matches(lower(text), 'subscribe|sponsor')) x WHERE r <= 5""",
)
def tk09(spark, sf):
    from colloquy.functions.text import contains_keywords

    evidence = V.segments(spark, sf).filter(contains_keywords("text", ["subscribe", "sponsor"]))
    return ranking.preview(evidence).select("episode_id", "seg_idx", "preview")


_HMS = "format('{{:02d}}:{{:02d}}:{{:02d}}', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60)"


@query(
    "tk10_prompt_text",
    f"""WITH {SEG}, {SAMPLES}, b AS (SELECT episode_id, speaker, speaker || ' examples:' || chr(10) || string_agg('- [' || {_HMS.format('start_ms')}
        || chr(8211) || {_HMS.format('end_ms')} || '] ' || sample, chr(10) ORDER BY seg_idx) AS block FROM samples GROUP BY 1, 2)
    SELECT episode_id, string_agg(block, chr(10) || chr(10) ORDER BY speaker) AS prompt FROM b GROUP BY 1""",
)
def tk10(spark, sf):
    return ranking.prompt_text(ranking.first_n_per_speaker(V.segments(spark, sf)))


@query("tk11_top_speakers", f"WITH {FEED}, {TOP_FEED} SELECT episode_id, speaker, total_ms, rank::INTEGER AS rank FROM ftop")
def tk11(spark, sf):
    return ranking.top_speakers(feed_segments(spark, sf))


@query(
    "tk12_excerpt_lines",
    f"""WITH {SEG}, n AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seg_idx) AS i,
      count(*) OVER (PARTITION BY episode_id) AS n FROM seg)
    SELECT episode_id, seg_idx, '[' || {clock('start_ms')} || ' - ' || {clock('end_ms')} || '] ' || speaker || ': ' || {TRIMMED} AS line
    FROM n WHERE (n <= 12 OR i <= 6 OR i > n - 6) AND {TRIMMED} <> ''""",
)
def tk12(spark, sf):
    return ranking.excerpt_lines(V.segments(spark, sf), 12)


