"""Queries for sources, sinks and streams.

Documents are derived from whole tables, written to the shared folder as a table
of raw documents and read back through the readers; sinks are written there and
their output is read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import strip_ws, tokens
from colloquy.operators import asrstats, roles, stats, textops
from colloquy.plans import views as V
from colloquy.plans.aggregates import BATCH, FACTS, _speaker_sql, _summary, batch_results
from colloquy.plans.joins import map_replies
from colloquy.plans.registry import query
from colloquy.plans.rolequeries import cascade_sql
from colloquy.plans.scalars import NORMALIZED_SQL, TRIMMED, is_question_sentence_sql, messy
from colloquy.plans.sequencequeries import ISLANDS, LINE_LIST
from colloquy.plans.textqueries import SENTENCES, asking
from colloquy.plans.views import SEG, WORD, clock, wc
from colloquy.session import scratch_path
from colloquy.sources import readers, writers
from colloquy.streaming import live

PART = "seg_idx // 4096"


def _raw_table(rows: DataFrame, order: str, item: Column, wrap, suffix: str | Column = ".json") -> str:
    """Write rows as raw JSON documents, in bounded parts, and return the path."""
    spark = rows.sparkSession
    parts = writers.listed_parts(rows, order, item, "items")
    path = scratch_path(spark, "raw")
    end = F.lit(suffix) if isinstance(suffix, str) else suffix
    parts.select(
        F.concat(F.lit("ep"), "episode_id", end).alias("name"),
        F.col("episode_id").cast("string").alias("episode_id"),
        "offset",
        F.to_json(wrap(F.col("items"))).alias("value"),
    ).write.parquet(path)
    return path


def _seconds(name: str) -> Column:
    return F.col(f"{name}_ms") / 1000


# --- sources -------------------------------------------------------------------


@query(
    "src01_read_captions",
    f"WITH {SEG} SELECT episode_id::VARCHAR AS episode_id, seg_idx AS item_idx, {TRIMMED} AS text FROM seg WHERE {TRIMMED} <> ''",
)
def src01(spark, sf):
    item = F.struct("text", _seconds("start").alias("start"))
    path = _raw_table(V.segments(spark, sf), "seg_idx", item, lambda items: items)
    return readers.read_captions(spark, path, layout="table")


@query(
    "src02_read_aligned_segments",
    f"""WITH {SEG} SELECT episode_id::VARCHAR AS episode_id, seg_idx, start_ms, end_ms, text, speaker_raw,
      {wc('text')}::INTEGER AS n_words, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')[1] AS first_word FROM seg""",
)
def src02(spark, sf):
    words = F.transform(tokens("text"), lambda t: F.struct(t.alias("word")))
    item = F.struct(
        _seconds("start").alias("start"), _seconds("end").alias("end"), "text", words.alias("words"), "speaker_raw"
    )
    path = _raw_table(V.segments(spark, sf), "seg_idx", item, lambda items: F.struct(items.alias("segments")))
    out = readers.read_aligned_segments(spark, path, layout="table")
    return out.select(
        "episode_id", "seg_idx", "start_ms", "end_ms", "text", "speaker_raw", F.size("words").alias("n_words"),
        F.get("words", F.lit(0))["word"].alias("first_word"),
    )


def _utterance_table(spark, sf) -> str:
    """ASR responses whose utterances lack some keys."""
    item = F.struct(
        _seconds("start").alias("start"),
        F.when(F.col("turn") % 5 != 4, _seconds("end")).alias("end"),
        F.when(F.col("turn") % 6 != 1, F.col("speaker_id")).alias("speaker"),
        F.col("text").alias("transcript"),
        "confidence",
    )
    wrap = lambda items: F.struct(F.struct(items.alias("utterances")).alias("results"))
    return _raw_table(V.segments(spark, sf), "seg_idx", item, wrap, ".deepgram.json")


@query(
    "src03_read_asr_utterances",
    f"""WITH {SEG} SELECT episode_id::VARCHAR AS episode_id, seg_idx, start_ms, CASE WHEN turn % 5 = 4 THEN start_ms ELSE end_ms END AS end_ms,
      CASE WHEN turn % 6 = 1 THEN 0 ELSE speaker_id END AS speaker_id, {TRIMMED} AS text, confidence FROM seg WHERE {TRIMMED} <> ''""",
)
def src03(spark, sf):
    return readers.read_asr_utterances(spark, _utterance_table(spark, sf), layout="table")


def _word_table(words: DataFrame, suffix: str = ".deepgram.json") -> str:
    item = F.struct(
        F.lower("token").alias("word"),
        F.when(F.col("pos") % 3 != 0, F.col("token")).alias("punctuated_word"),
        _seconds("start").alias("start"), _seconds("end").alias("end"), "speaker",
    )

    def wrap(items: Column) -> Column:
        alternative = F.struct(F.lit("t").alias("transcript"), items.alias("words"))
        channel = F.struct(F.array(alternative).alias("alternatives"))
        return F.struct(F.struct(F.array(channel).alias("channels")).alias("results"))

    return _raw_table(words, "word_idx", item, wrap, suffix)


@query(
    "src04_read_asr_words",
    f"""WITH {WORD} SELECT episode_id::VARCHAR AS episode_id, word_idx, start_ms, end_ms, speaker,
      CASE WHEN pos % 3 = 0 THEN lower(token) ELSE token END AS token FROM word""",
)
def src04(spark, sf):
    return readers.read_asr_words(spark, _word_table(V.words(spark, sf)), layout="table")


@query(
    "src05_read_best_transcript",
    f"""WITH {SEG} SELECT episode_id::VARCHAR AS episode_id,
      coalesce(arg_min(text, seg_idx) FILTER (turn % 4 <> 0 AND text <> ''), '') AS transcript FROM seg GROUP BY 1""",
)
def src05(spark, sf):
    alternative = F.struct(F.array(F.struct(F.col("text").alias("transcript"))).alias("alternatives"))
    channels = F.when(F.col("turn") % 4 != 0, F.array(alternative))
    rows = V.segments(spark, sf).select(
        F.concat(F.lit("ep"), "episode_id", F.lit("_"), "seg_idx", F.lit(".json")).alias("name"),
        F.col("episode_id").cast("string").alias("episode_id"), F.col("seg_idx").alias("offset"),
        F.to_json(F.struct(F.struct(channels.alias("channels")).alias("results"))).alias("value"),
    )
    path = scratch_path(spark, "raw")
    rows.write.parquet(path)
    return readers.read_best_transcript(spark, path, layout="table")


def _sentence_item() -> Column:
    return F.struct(
        "speaker_id", F.when(F.col("turn") % 3 != 0, F.concat(F.lit("Guest "), "speaker_id")).alias("speaker_label"),
        _seconds("start").alias("start"), _seconds("end").alias("end"), F.col("text").alias("transcript"),
    )


def _sentence_wrap(items: Column) -> Column:
    return F.struct(F.lit("utterance").alias("unit"), F.size(items).alias("num_segments"), items.alias("segments"))


_SENTENCE_SPEAKER = "CASE WHEN turn % 3 = 0 THEN 'Speaker ' || (speaker_id + 1) ELSE 'Guest ' || speaker_id END"


@query(
    "src06_read_sentences",
    f"""WITH {SEG} SELECT episode_id::VARCHAR AS episode_id, seg_idx, start_ms, end_ms, text, speaker_raw,
      {_SENTENCE_SPEAKER} AS speaker FROM seg""",
)
def src06(spark, sf):
    path = _raw_table(V.segments(spark, sf), "seg_idx", _sentence_item(), _sentence_wrap, ".sentences.json")
    return readers.read_sentences(spark, path, layout="table")


@query(
    "src07_read_any",
    f"""WITH {WORD}, w AS (SELECT *, row_number() OVER (PARTITION BY episode_id, coalesce(speaker, 0) ORDER BY start_ms, word_idx) AS rn,
        coalesce(speaker, 0) AS spk FROM word), a AS (
    SELECT episode_id::VARCHAR AS episode_id, start_ms, end_ms, text, speaker_raw, {_SENTENCE_SPEAKER} AS speaker, 0 AS t1, seg_idx AS t2 FROM seg
    UNION ALL SELECT 'w' || episode_id, arg_min(start_ms, rn), arg_max(end_ms, rn),
      string_agg(CASE WHEN pos % 3 = 0 THEN lower(token) ELSE token END, ' ' ORDER BY rn), format('SPEAKER_{{:02d}}', spk), 'Speaker ' || (spk + 1),
      spk, (rn - 1) // 12
    FROM w GROUP BY episode_id, spk, (rn - 1) // 12)
    SELECT * EXCLUDE (t1, t2), row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, t1, t2) - 1 AS seg_idx FROM a""",
)
def src07(spark, sf):
    """Both document kinds in one folder, some recognised by suffix, some by structure."""
    s = V.segments(spark, sf)
    suffix = F.when(F.col("episode_id") % 2 == 0, ".sentences.json").otherwise(".json")
    spoken = _raw_table(s, "seg_idx", _sentence_item(), _sentence_wrap, suffix)
    words = V.words_of(s).withColumn("episode_id", F.concat(F.lit("w"), "episode_id"))
    heard = _word_table(words, ".json")
    raw = readers.raw_documents(spark, spoken, "table").unionByName(readers.raw_documents(spark, heard, "table"))
    return readers.any_from(raw)


@query(
    "src08_read_simple_diarized",
    f"""WITH {SEG} SELECT episode_id::VARCHAR AS episode_id, seg_idx, speaker_id, 'Speaker ' || (speaker_id + 1) AS speaker, start_ms, end_ms, text,
      CASE WHEN turn % 4 = 0 THEN 0.0::DOUBLE ELSE confidence END AS confidence, CASE WHEN turn % 2 = 0 THEN 'unknown' ELSE 'male' END AS gender FROM seg""",
)
def src08(spark, sf):
    item = F.struct(
        "speaker_id", _seconds("start").alias("start"), _seconds("end").alias("end"), "text",
        F.when(F.col("turn") % 4 != 0, F.col("confidence")).alias("confidence"),
        F.when(F.col("turn") % 2 != 0, F.lit("male")).alias("gender"),
    )
    wrap = lambda items: F.struct(F.size(items).alias("total_segments"), items.alias("segments"))
    path = _raw_table(V.segments(spark, sf), "seg_idx", item, wrap)
    return readers.read_simple_diarized(spark, path, layout="table")


def _document_table(spark, sf) -> str:
    path = scratch_path(spark, "raw")
    V.documents(spark, sf).select(
        F.concat(F.lit("ep"), "doc_id", F.lit(".txt")).alias("name"),
        F.concat(F.lit("ep"), "doc_id").alias("episode_id"),
        F.lit(0).cast("bigint").alias("offset"), F.col("text").alias("value"),
    ).write.parquet(path)
    return path


@query("src09_read_documents", "SELECT 'ep' || doc_id || '.txt' AS episode, text FROM documents")
def src09(spark, sf):
    return readers.read_documents(spark, _document_table(spark, sf), layout="table")


@query(
    "src10_read_transcript_lines",
    f"""WITH l AS (SELECT doc_id, {LINE_LIST} AS lines FROM documents)
    SELECT 'ep' || doc_id AS episode_id, (k - 1)::BIGINT AS line_idx, lines[k] AS line FROM l, range(1, len(lines) + 1) t(k)""",
)
def src10(spark, sf):
    return readers.read_transcript_lines(spark, _document_table(spark, sf), layout="table")


@query(
    "src11_read_url_list",
    """WITH n AS (SELECT row_number() OVER (ORDER BY page_id) AS number, trim(url) AS url FROM pages)
    SELECT 'pages' AS list, number, url FROM n WHERE number >= 3""",
)
def src11(spark, sf):
    """One long list with blank lines and comments, stored in bounded parts."""
    lines = F.array(
        F.when(F.col("page_id") % 5 == 0, F.lit("# note")), F.when(F.col("page_id") % 7 == 0, F.lit("  ")),
        F.concat(F.lit(" "), "url"),
    )
    rows = V.table(spark, sf, "pages").select("page_id", F.posexplode(lines).alias("i", "line")).filter("line IS NOT NULL")
    rows = rows.select(F.lit("pages").alias("episode_id"), (F.col("page_id") * 4 + F.col("i")).alias("line_idx"), "line")
    parts = writers._parts(rows, "line_idx", F.col("line"), "lines")
    path = scratch_path(spark, "raw")
    parts.select(
        F.lit("pages.txt").alias("name"), "episode_id", "offset", F.array_join("lines", "\n").alias("value")
    ).write.parquet(path)
    return readers.read_url_list(spark, path, layout="table", start=3, skip_comments=True)


# --- sinks ---------------------------------------------------------------------

_LINE = f"'[' || {clock('start_ms')} || ' - ' || {clock('end_ms')} || '] ' || speaker || ': ' || {TRIMMED}"


@query(
    "snk01_write_transcript_text",
    f"""WITH {SEG} SELECT episode_id, {PART} AS part, string_agg({_LINE}, chr(10) ORDER BY seg_idx) AS text,
      count(*) OVER (PARTITION BY episode_id) AS n_parts, sum(count(*)) OVER (PARTITION BY episode_id)::BIGINT AS n_pieces
    FROM seg WHERE {TRIMMED} <> '' GROUP BY 1, 2""",
)
def snk01(spark, sf):
    path = scratch_path(spark, "lines")
    writers.write_transcript_text(V.segments(spark, sf), path)
    return spark.read.schema("episode_id bigint, part bigint, text string, n_parts bigint, n_pieces bigint").json(path)


@query(
    "snk02_write_labeled_json",
    f"""WITH {SEG}, {cascade_sql('v5', 'keywords', 0.55, 5, True, True)}
    SELECT s.episode_id, s.start_ms::DOUBLE / 1000 AS start, CASE WHEN s.speaker = v.host THEN 'Host' WHEN s.speaker = v.guest THEN 'Guest' ELSE 'Unknown' END AS speaker,
      v.host AS host_speaker, v.confidence, v.method FROM seg s JOIN verdict v ON v.episode_id = s.episode_id""",
)
def snk02(spark, sf):
    from colloquy.operators.lookups import apply_host

    s = V.segments(spark, sf)
    hosts = roles.identify_host_keywords_first(s, "v5")
    path = scratch_path(spark, "labeled")
    writers.write_labeled_json(apply_host(s, hosts), roles.label_provenance(hosts), path)
    schema = (
        "episode_id bigint, segments array<struct<start:double,speaker:string>>, "
        "host_identification struct<host_speaker:string,confidence:double,method:string>"
    )
    docs = spark.read.schema(schema).json(path)
    return docs.select("episode_id", F.explode("segments").alias("s"), "host_identification.*").select(
        "episode_id", "s.start", "s.speaker", "host_speaker", "confidence", "method"
    )


@query(
    "snk03_write_stats_json",
    f"""WITH {SEG}, {FACTS}, sp AS (SELECT episode_id, speaker, {_speaker_sql()} FROM fact GROUP BY 1, 2),
    ep AS (SELECT episode_id, count(*) AS num_utterances_total, max(end_ms)::DOUBLE / 1000 AS audio_duration_s_est, {_summary('duration', 'd', 1000)} FROM fact GROUP BY 1)
    SELECT ep.episode_id, num_utterances_total, audio_duration_s_est, ep.duration_mean AS global_mean,
      (row_number() OVER (PARTITION BY sp.episode_id ORDER BY total_speech_s DESC, speaker) - 1)::INTEGER AS pos,
      speaker, total_speech_s, wpm_est, sp.words_mean FROM ep JOIN sp ON sp.episode_id = ep.episode_id""",
)
def snk03(spark, sf):
    path = scratch_path(spark, "stats")
    writers.write_stats_json(V.segments(spark, sf), path)
    schema = (
        "episode_id bigint, num_utterances_total bigint, audio_duration_s_est double, global_sentence_duration_s struct<mean:double>, "
        "per_speaker array<struct<speaker:string,total_speech_s:double,wpm_est:double,sentence_word_count:struct<mean:double>>>"
    )
    docs = spark.read.schema(schema).json(path)
    return docs.select(
        "episode_id", "num_utterances_total", "audio_duration_s_est", F.col("global_sentence_duration_s.mean").alias("global_mean"),
        F.posexplode("per_speaker").alias("pos", "s"),
    ).select(
        "episode_id", "num_utterances_total", "audio_duration_s_est", "global_mean", "pos", "s.speaker", "s.total_speech_s",
        "s.wpm_est", F.col("s.sentence_word_count.mean").alias("words_mean"),
    )


@query(
    "snk03_write_stats_json_fallback",
    f"""WITH {WORD}, {FACTS.replace("FROM seg", "FROM seg WHERE episode_id % 3 <> 1", 1)}, sp AS (SELECT episode_id, speaker, {_speaker_sql()} FROM fact GROUP BY 1, 2),
      lagged AS (SELECT *, lag(speaker) OVER o AS ps, lag(end_ms) OVER o AS pe FROM word WHERE speaker IS NOT NULL AND episode_id % 3 = 1
        WINDOW o AS (PARTITION BY episode_id ORDER BY word_idx)),
      marked AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> speaker OR start_ms - pe > 800 THEN 1 ELSE 0 END)
        OVER (PARTITION BY episode_id ORDER BY word_idx) AS island FROM lagged),
      built AS (SELECT episode_id, island, min(speaker) AS speaker, arg_max(end_ms, word_idx) - arg_min(start_ms, word_idx) AS d FROM marked GROUP BY 1, 2),
      brief AS (SELECT episode_id, speaker::VARCHAR AS speaker, sum(greatest(0, d))::DOUBLE / 1000 AS talk_time_s, count(*) AS turns,
        sum(count(*)) OVER (PARTITION BY episode_id)::BIGINT AS num_segments FROM built GROUP BY episode_id, speaker)
    SELECT episode_id, 'utterance (sentence-like)' AS unit, NULL::BIGINT AS num_segments,
      (row_number() OVER (PARTITION BY episode_id ORDER BY total_speech_s DESC, speaker) - 1)::INTEGER AS pos, speaker,
      total_speech_s AS seconds, NULL::BIGINT AS turns FROM sp
    UNION ALL SELECT episode_id, 'segment (fallback)', num_segments,
      (row_number() OVER (PARTITION BY episode_id ORDER BY talk_time_s DESC, speaker) - 1)::INTEGER, speaker, talk_time_s, turns FROM brief""",
)
def snk03_fallback(spark, sf):
    """Documents of both kinds: a third of the episodes has words and no utterances."""
    path = scratch_path(spark, "stats")
    s = V.segments(spark, sf)
    uttered = s.filter("episode_id % 3 <> 1")
    built = asrstats.word_segments(V.words_of(s), uttered).withColumn("speaker", F.col("speaker_id").cast("string"))
    writers.write_stats_json(uttered, path, built)
    schema = (
        "episode_id bigint, unit string, num_segments bigint, per_speaker array<struct<speaker:string,total_speech_s:double>>, "
        "speakers array<struct<speaker:string,talk_time_s:double,turns:bigint>>"
    )
    rows = spark.read.schema(schema).json(path)
    item = lambda x, seconds, turns: F.struct(x["speaker"].alias("speaker"), x[seconds].alias("seconds"), turns.alias("turns"))
    full = F.transform("per_speaker", lambda x: item(x, "total_speech_s", F.lit(None).cast("bigint")))
    brief = F.transform("speakers", lambda x: item(x, "talk_time_s", x["turns"]))
    listed = rows.select("episode_id", "unit", "num_segments", F.posexplode(F.coalesce(full, brief)).alias("pos", "s"))
    return listed.select("episode_id", "unit", "num_segments", "pos", "s.speaker", "s.seconds", "s.turns")


@query(
    "snk04_write_stats_csv",
    f"""SELECT 'ep' || doc_id AS episode, {wc('text')} AS word_count,
      (length(text) - length(replace(replace(replace(text, '.', ''), '?', ''), '!', '')))::BIGINT AS sentence_count FROM documents""",
)
def snk04(spark, sf):
    docs = V.documents(spark, sf).select(F.concat(F.lit("ep"), "doc_id").alias("episode"), "text")
    path = scratch_path(spark, "csv")
    writers.write_stats_csv(stats.document_stats(docs), path)
    return spark.read.schema("episode string, word_count bigint, sentence_count bigint").csv(path, header=True)


@query(
    "snk05_write_sentence_json",
    f"""WITH {SEG}, u AS (SELECT conv_id, turn // 4096 AS part, list({{'t': {TRIMMED}, 'l': 'Speaker ' || (speaker_id + 1)}} ORDER BY turn) AS segs
      FROM seg GROUP BY 1, 2)
    SELECT e.doc_id AS episode_id, coalesce(u.part, 0) AS part, sum(len(u.segs)) OVER (PARTITION BY e.doc_id)::BIGINT AS num_segments,
      count(u.segs) OVER (PARTITION BY e.doc_id) AS n_parts, CASE WHEN u.segs IS NULL THEN '{writers.NO_UTTERANCES}' END AS error,
      coalesce(len(u.segs), 0)::INTEGER AS listed, u.segs[1].t AS transcript, u.segs[1].l AS label
    FROM documents e LEFT JOIN u ON u.conv_id = e.doc_id""",
)
def snk05(spark, sf):
    """Each document is an episode; its utterances are the conversation of that number, if there is one."""
    s = V.segments(spark, sf).select(F.col("conv_id").alias("episode_id"), F.col("turn").alias("seg_idx"), "speaker_id", "text", "start_ms", "end_ms")
    path = scratch_path(spark, "sentences")
    writers.write_sentence_json(V.documents(spark, sf).select(F.col("doc_id").alias("episode_id")), s, path)
    schema = (
        "episode_id bigint, part bigint, num_segments bigint, n_parts bigint, error string, "
        "segments array<struct<speaker_label:string,transcript:string>>"
    )
    docs = spark.read.schema(schema).json(path)
    first = F.get("segments", F.lit(0))
    return docs.select(
        "episode_id", "part", "num_segments", "n_parts", "error", F.size("segments").alias("listed"),
        first["transcript"].alias("transcript"), first["speaker_label"].alias("label"),
    )


@query("snk06_write_clean_pair", f"WITH {NORMALIZED_SQL} SELECT doc_id, clean, lower(clean) AS lowered FROM norm")
def snk06(spark, sf):
    path = scratch_path(spark, "clean")
    writers.write_clean_pair(textops.normalize_documents(messy(spark, sf)), path)
    clean = spark.read.parquet(f"{path}/clean").withColumnRenamed("text", "clean")
    return clean.join(spark.read.parquet(f"{path}/lower").withColumnRenamed("text", "lowered"), "doc_id")


@query(
    "snk07_write_questions",
    f"""WITH {SENTENCES}, q AS (SELECT doc_id, string_agg(sentence, chr(10) ORDER BY sentence_idx) AS text, count(*) AS n
      FROM sent WHERE sentence <> '' AND {is_question_sentence_sql('sentence')} GROUP BY 1)
    SELECT d.doc_id, coalesce(q.text, '') AS text, coalesce(q.n, 0) AS n_questions FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id""",
)
def snk07(spark, sf):
    docs = asking(spark, sf)
    path = scratch_path(spark, "questions")
    writers.write_questions(docs, textops.extract_questions(docs), path)
    return spark.read.schema("doc_id bigint, text string, n_questions bigint").json(path)


@query(
    "snk08_write_errors",
    f"WITH {BATCH} SELECT file, status, CASE WHEN ok THEN 'good' ELSE 'error' END AS stored_in FROM batch",
)
def snk08(spark, sf):
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "errors")
    writers.write_errors(batch_results(spark, sf), good, bad)
    schema = "file string, status int"
    return (
        spark.read.schema(schema).json(good).withColumn("stored_in", F.lit("good"))
        .unionByName(spark.read.schema(schema).json(bad).withColumn("stored_in", F.lit("error")))
    )


@query("snk09_write_batch_summary", f"WITH {BATCH} SELECT file, ok, status, time_ms, skipped FROM batch")
def snk09(spark, sf):
    path = scratch_path(spark, "batch")
    writers.write_batch_summary(batch_results(spark, sf), path)
    return spark.read.schema("file string, ok boolean, status int, time_ms bigint, skipped boolean").json(path)


_FOOT = (
    "SELECT episode_id, speaker_id, arg_min(speaker, seg_idx) AS speaker, "
    "CASE speaker_id WHEN 0 THEN 'HOST' WHEN 1 THEN 'GUEST' ELSE 'UNKNOWN' END AS role, sum(end_ms - start_ms) AS ms FROM seg GROUP BY 1, 2"
)


@query(
    "snk10_append_role_summary",
    f"""WITH {SEG}, f AS ({_FOOT}), t AS (SELECT *, round_even(ms / 100.0, 0)::BIGINT AS tenths FROM f)
    SELECT episode_id, 0 AS section, seg_idx AS pos, {_LINE} AS line FROM seg WHERE {TRIMMED} <> ''
    UNION ALL SELECT DISTINCT episode_id, 1, 0, '' FROM seg
    UNION ALL SELECT DISTINCT episode_id, 1, 1, '# Speaker Summary:' FROM seg
    UNION ALL SELECT episode_id, 2, speaker_id * 4, '# Speaker ' || (speaker_id + 1) || ' = ' || role || ' (unknown) - '
      || (tenths // 10) || '.' || (tenths % 10) || 's total' FROM t""",
)
def snk10(spark, sf):
    s = V.segments(spark, sf)
    labelled = s.withColumns(
        {
            "role": F.expr("CASE speaker_id WHEN 0 THEN 'HOST' WHEN 1 THEN 'GUEST' ELSE 'UNKNOWN' END"),
            "gender": F.lit("unknown"),
        }
    )
    return writers.append_role_summary(writers.transcript_lines(s), labelled)


@query(
    "snk10_append_model_summary",
    f"""WITH {SEG}, f AS ({_FOOT}), t AS (SELECT *, round_even(ms / 100.0, 0)::BIGINT AS tenths, episode_id % 3 = 2 AS none FROM f)
    SELECT episode_id, 0 AS section, seg_idx AS pos, {_LINE} AS line FROM seg WHERE {TRIMMED} <> ''
    UNION ALL SELECT DISTINCT episode_id, 1, 0, '' FROM seg
    UNION ALL SELECT DISTINCT episode_id, 1, 1, '# LLM Speaker Analysis:' FROM seg
    UNION ALL SELECT episode_id, 2, speaker_id * 4, '# ' || speaker || ' = ' || CASE WHEN none THEN 'UNKNOWN' ELSE role END || ' (unknown) - '
      || CASE WHEN NOT none AND speaker_id = 1 THEN '0.75' ELSE '0.50' END || ' confidence' FROM t
    UNION ALL SELECT episode_id, 2, speaker_id * 4 + 1, '#   Reason: ' || CASE WHEN none OR speaker_id > 0 THEN 'No reasoning provided' ELSE 'asks ' || episode_id END FROM t
    UNION ALL SELECT episode_id, 2, speaker_id * 4 + 2, '#   Speaking time: ' || (tenths // 10) || '.' || (tenths % 10) || 's' FROM t""",
)
def snk10_model(spark, sf):
    from colloquy.operators.lookups import apply_model_labels

    s = V.segments(spark, sf)
    labelled = apply_model_labels(s, map_replies(spark, sf)).withColumn("gender", F.lit("unknown"))
    return writers.append_role_summary(writers.transcript_lines(s), labelled, model=True)


# --- streams -------------------------------------------------------------------


def _stream(spark, sf) -> DataFrame:
    # As a glob the path may be one file or a folder of files.
    schema = V.table(spark, sf, "conversations").schema
    return live.file_stream(spark, f"{sf}/conversations.parque[t]", schema)


def _collected(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and read what its batches wrote."""
    spark = stream.sparkSession
    path = scratch_path(spark, "stream")

    def store(batch: DataFrame, batch_id: int) -> None:
        target = path if mode == "complete" else f"{path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    live.run_available(stream, scratch_path(spark, "checkpoint"), store, mode)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(path)


@query(
    "st01_incremental_ingest",
    f"WITH {SEG} SELECT episode_id, seg_idx, CASE WHEN {TRIMMED} <> '' THEN 'good' ELSE 'error' END AS stored_in FROM seg",
)
def st01(spark, sf):
    """Two runs over the same checkpoint; the second finds nothing new."""
    good, bad, checkpoint = (scratch_path(spark, n) for n in ("good", "errors", "checkpoint"))
    for _ in range(2):
        rows = V.segments_of(_stream(spark, sf)).select("episode_id", "seg_idx", "text")
        live.incremental_ingest(rows, strip_ws("text") != "", good, bad, checkpoint)
    parts = [
        spark.read.schema("episode_id bigint, seg_idx bigint").option("recursiveFileLookup", True).parquet(path).withColumn("stored_in", F.lit(name))
        for path, name in ((good, "good"), (bad, "error"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "e1_asr_statistics",
    f"""WITH {WORD}, uttered AS (SELECT * FROM seg WHERE episode_id % 3 <> 1), fact AS (SELECT episode_id, speaker_id, greatest(0, end_ms - start_ms) AS d,
        {wc('text')} AS w, regexp_matches(text, '\\?\\s*$')::BIGINT AS q FROM uttered),
      lagged AS (SELECT *, lag(speaker) OVER o AS ps, lag(end_ms) OVER o AS pe FROM word WHERE speaker IS NOT NULL AND episode_id % 3 = 1
        WINDOW o AS (PARTITION BY episode_id ORDER BY word_idx)),
      marked AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> speaker OR start_ms - pe > 800 THEN 1 ELSE 0 END)
        OVER (PARTITION BY episode_id ORDER BY word_idx) AS island FROM lagged),
      built AS (SELECT episode_id, island, min(speaker) AS speaker, arg_max(end_ms, word_idx) - arg_min(start_ms, word_idx) AS d FROM marked GROUP BY 1, 2)
    SELECT episode_id::VARCHAR AS episode_id, speaker_id::INTEGER AS speaker_id, 'utterance (sentence-like)' AS unit, count(*) AS num_sentences,
      sum(d)::DOUBLE / 1000 AS total_speech_s, sum(w)::BIGINT AS total_words, sum(q)::BIGINT AS question_count,
      NULL::DOUBLE AS talk_time_s, NULL::BIGINT AS turns, NULL::BIGINT AS num_segments FROM fact GROUP BY 1, 2
    UNION ALL SELECT episode_id::VARCHAR, speaker::INTEGER, 'segment (fallback)', NULL, NULL, NULL, NULL, sum(greatest(0, d))::DOUBLE / 1000, count(*),
      sum(count(*)) OVER (PARTITION BY episode_id)::BIGINT FROM built GROUP BY episode_id, speaker""",
)
def e1(spark, sf):
    """Responses of which some have utterances and words, some words only and some utterances only."""
    s = V.segments(spark, sf)
    item = F.struct(
        _seconds("start").alias("start"), _seconds("end").alias("end"), F.col("speaker_id").alias("speaker"),
        F.col("text").alias("transcript"), "confidence",
    )
    wrap = lambda items: F.struct(F.struct(items.alias("utterances")).alias("results"))
    uttered = _raw_table(s.filter("episode_id % 3 <> 1"), "seg_idx", item, wrap)
    heard = _word_table(V.words_of(s.filter("episode_id % 3 <> 2")))
    raw = readers.raw_documents(spark, uttered, "table").unionByName(readers.raw_documents(spark, heard, "table"))
    found = asrstats.response_statistics(readers.asr_utterances_from(raw, keep_empty=True), readers.asr_words_from(raw))
    return found.select(
        "episode_id", "speaker_id", "unit", "num_sentences", "total_speech_s", "total_words", "question_count",
        "talk_time_s", "turns", "num_segments",
    )


@query("st02_streaming_speaker_stats", f"WITH {SEG}, {FACTS} SELECT episode_id, speaker, {_speaker_sql()} FROM fact GROUP BY 1, 2")
def st02(spark, sf):
    path = scratch_path(spark, "stream")
    live.keep_speaker_stats(V.segments_of(_stream(spark, sf)), path, scratch_path(spark, "checkpoint"))
    return live.latest_speaker_stats(spark, path)


def _live_words(spark, sf) -> DataFrame:
    words = V.words_of(V.segments_of(_stream(spark, sf))).filter("speaker IS NOT NULL")
    return words.withColumn("ts", F.timestamp_millis("start_ms"))


def _ended_words(spark, sf) -> DataFrame:
    """The word feed as a stream of files that a row without a speaker, a day after the last word, ends."""
    path = scratch_path(spark, "feed")
    words = V.words(spark, sf).select(
        "episode_id", "word_idx", F.col("speaker").cast("string").alias("speaker"), "start_ms", "end_ms", "token",
        F.timestamp_millis("start_ms").alias("ts"),
    )
    words.write.parquet(path)
    end = spark.read.parquet(path).agg(F.max("ts").alias("ts")).select(F.col("ts") + F.expr("interval 1 day"))
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in words.schema.fields[:-1]]
    end.toDF("ts").select(*nothing, "ts").where("ts is not null").write.mode("append").parquet(path)
    return live.file_stream(spark, path, words.schema)


@query(
    "st03_streaming_gap_sessions",
    f"""WITH {WORD}, l AS (SELECT *, lag(start_ms) OVER (PARTITION BY episode_id, speaker ORDER BY start_ms) AS p FROM word WHERE speaker IS NOT NULL),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR start_ms - p > 800 THEN 1 ELSE 0 END) OVER (PARTITION BY episode_id, speaker ORDER BY start_ms ROWS UNBOUNDED PRECEDING) AS i FROM l)
    SELECT episode_id, speaker, min(start_ms) AS start_ms, count(*) AS n_words, max(end_ms) AS end_ms FROM s GROUP BY episode_id, speaker, i""",
)
def st03(spark, sf):
    """Append mode: a session comes out once the watermark has passed it."""
    words = _ended_words(spark, sf).withColumn("speaker", F.col("speaker").cast("int"))
    out = _collected(live.gap_sessions(words), "append").where("speaker is not null")
    return out.select("episode_id", "speaker", F.unix_millis("session_start").alias("start_ms"), "n_words", "end_ms")


@query(
    "st03_streaming_gap_segments",
    f"""WITH {WORD}, {ISLANDS}, i AS (SELECT episode_id, island, min(word_idx) AS head_idx, min(speaker) AS speaker, arg_min(start_ms, word_idx) AS start_ms,
      arg_max(end_ms, word_idx) AS end_ms, trim(string_agg(token, ' ' ORDER BY word_idx)) AS text
      FROM marked GROUP BY episode_id, island)
    SELECT episode_id, head_idx, speaker, start_ms, end_ms, text FROM i""",
)
def st03_batches(spark, sf):
    """All segments: the closed ones, and at the end of the feed those still open."""
    path = scratch_path(spark, "stream")
    live.keep_gap_segments(_live_words(spark, sf), path, scratch_path(spark, "checkpoint"))
    return live.all_gap_segments(spark, path)


@query(
    "st03_streaming_gap_segments_live",
    f"""WITH {WORD}, lagged AS (SELECT *, lag(speaker) OVER o AS ps, lag(end_ms) OVER o AS pe FROM word WHERE speaker IS NOT NULL
        WINDOW o AS (PARTITION BY episode_id ORDER BY start_ms, word_idx)),
      marked AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> speaker OR start_ms - pe > 800 THEN 1 ELSE 0 END)
        OVER (PARTITION BY episode_id ORDER BY start_ms, word_idx ROWS UNBOUNDED PRECEDING) AS island FROM lagged),
      placed AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY start_ms, word_idx) AS place FROM marked)
    SELECT episode_id, arg_min(word_idx, place) AS head_idx, min(speaker)::VARCHAR AS speaker, min(start_ms) AS start_ms,
      arg_max(end_ms, place) AS end_ms, string_agg(token, ' ' ORDER BY place) AS text FROM placed GROUP BY episode_id, island""",
)
def st03_live(spark, sf):
    """Every segment once, when no word can follow it any more; timers close them and empty the state."""
    path = scratch_path(spark, "stream")
    stream = live.gap_segments(_ended_words(spark, sf))
    live.append_available(stream, path, scratch_path(spark, "checkpoint"))
    rows = spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(path)
    return rows.select("episode_id", "head_idx", "speaker", "start_ms", "end_ms", "text")
