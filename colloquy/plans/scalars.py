"""Queries for the projections, scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy import lexicons
from colloquy.functions import labels, numeric, replies, text, timefmt
from colloquy.operators import filters, roles
from colloquy.plans import views as V
from colloquy.plans.registry import query
from colloquy.plans.views import SEG, clock, wc

ID = ["episode_id", "seg_idx"]
SEC = "(start_ms * 10 + (conv_id * 7 + turn) % 10) / 10000.0"


def _or(phrases: list[str]) -> str:
    """RE2 alternation of literal phrases as an SQL string."""
    import re

    return "|".join(re.escape(p).replace("\\ ", " ") for p in phrases).replace("'", "''")


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


# RE2 knows only ASCII word characters; accented letters become `x` so that a
# word boundary next to them is judged as in Unicode-aware engines.
def _ascii(expr: str) -> str:
    return f"regexp_replace({expr}, '[\\x{{00C0}}-\\x{{024F}}]', 'x', 'g')"


def _variant_a(sec: str) -> str:
    whole = f"floor({sec})::BIGINT"
    return (
        f"format('{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}', {whole} // 3600, {whole} // 60 % 60, {whole} % 60, "
        f"round_even(({sec} - floor({sec})) * 1000, 0)::BIGINT)"
    )


@query(
    "fn01_fmt_hms_ms",
    f"""WITH {SEG}, s AS (SELECT *, ({SEC})::DOUBLE AS sec FROM seg),
    r AS (SELECT *, round_even(sec * 1000, 0)::BIGINT AS ms,
      round_even((sec - floor(sec / 60) * 60) * 1000, 0)::BIGINT AS within, floor(sec)::BIGINT AS whole FROM s)
    SELECT episode_id, seg_idx, {_variant_a('sec')} AS variant_a, {clock('ms')} AS variant_b,
      format('{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}', whole // 3600, whole // 60 % 60, within // 1000, within % 1000) AS variant_c,
      {_variant_a('greatest(sec - 60, 0.0)')} AS clamped
    FROM r""",
)
def fn01(spark, sf):
    s = V.segments(spark, sf).withColumn("sec", F.expr(SEC.replace("10000.0", "10000.0D")))
    return s.select(
        *ID,
        timefmt.fmt_hms_ms("sec", "A").alias("variant_a"),
        timefmt.fmt_hms_ms("sec").alias("variant_b"),
        timefmt.fmt_hms_ms("sec", "C").alias("variant_c"),
        timefmt.fmt_hms_ms(F.col("sec") - 60, "A", clamp=True).alias("clamped"),
    )


@query(
    "fn02_fmt_ms",
    f"WITH {SEG} SELECT episode_id, seg_idx, format('{{:02d}}:{{:02d}}', start_ms * 9 // 60000, start_ms * 9 // 1000 % 60) AS stamp FROM seg",
)
def fn02(spark, sf):
    return V.segments(spark, sf).select(*ID, timefmt.fmt_ms(F.col("start_ms") * 9 / 1000).alias("stamp"))


@query(
    "fn03_fmt_hms",
    f"""WITH {SEG}, s AS (SELECT *, CASE WHEN confidence < 0.2 THEN NULL ELSE end_ms * 9 END AS t FROM seg)
    SELECT episode_id, seg_idx, format('{{:02d}}:{{:02d}}:{{:02d}}', coalesce(t, 0) // 3600000,
      coalesce(t, 0) // 60000 % 60, coalesce(t, 0) // 1000 % 60) AS stamp FROM s""",
)
def fn03(spark, sf):
    t = F.when(F.col("confidence") >= 0.2, F.col("end_ms") * 9 / 1000)
    return V.segments(spark, sf).select(*ID, timefmt.fmt_hms(t).alias("stamp"))


@query(
    "fn04_speaker_label",
    f"WITH {SEG} SELECT episode_id, seg_idx, 'Speaker ' || (speaker_id + 1) AS one_based, 'Speaker ' || speaker_id AS zero_based FROM seg",
)
def fn04(spark, sf):
    return V.segments(spark, sf).select(
        *ID, labels.speaker_label("speaker_id").alias("one_based"), labels.speaker_label("speaker_id", 0).alias("zero_based")
    )


@query(
    "fn05_pretty_speaker",
    f"""WITH {SEG} SELECT episode_id, seg_idx, 'Speaker ' || (speaker_id + 1) AS numbered,
      CASE WHEN turn % 3 = 0 THEN 'Speaker Unknown' ELSE upper(role[1]) || lower(role[2:]) || ' Guest' END AS named FROM seg""",
)
def fn05(spark, sf):
    name = F.expr("CASE WHEN turn % 3 = 0 THEN '' ELSE concat(upper(role), '_gUEST') END")
    return V.segments(spark, sf).select(
        *ID, labels.pretty_speaker("speaker_raw").alias("numbered"), labels.pretty_speaker(name).alias("named")
    )


_CANDIDATES = (
    "CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE speaker END",
    "CASE WHEN turn % 2 = 0 THEN NULL ELSE speaker_raw END",
    "CASE WHEN turn % 5 = 0 THEN NULL ELSE role END",
)


@query(
    "fn06_resolve_speaker",
    f"""WITH {SEG}, s AS (SELECT *, {_CANDIDATES[0]} AS a, {_CANDIDATES[1]} AS b, {_CANDIDATES[2]} AS c FROM seg)
    SELECT episode_id, seg_idx, coalesce(a, b, c, 'UNKNOWN') AS first_set,
      coalesce(nullif(a, ''), nullif(b, ''), nullif(c, ''), 'UNKNOWN') AS first_truthy FROM s""",
)
def fn06(spark, sf):
    c = [F.expr(x) for x in _CANDIDATES]
    return V.segments(spark, sf).select(
        *ID, labels.resolve_speaker(*c).alias("first_set"), labels.resolve_speaker(*c, skip_empty=True).alias("first_truthy")
    )


@query(
    "fn07_overlap",
    f"""WITH {SEG} SELECT episode_id, seg_idx,
      greatest(0, least(end_ms, 120000) - greatest(start_ms, 50000))::BIGINT AS overlap_ms FROM seg""",
)
def fn07(spark, sf):
    o = timefmt.overlap("start_ms", "end_ms", F.lit(50000), F.lit(120000))
    return V.segments(spark, sf).select(*ID, o.cast("bigint").alias("overlap_ms"))


@query(
    "fn08_duration",
    f"""WITH {SEG} SELECT episode_id, seg_idx, greatest(0, end_ms - start_ms - 9000)::BIGINT AS clamped,
      (end_ms - start_ms - 9000)::BIGINT AS plain FROM seg""",
)
def fn08(spark, sf):
    start = F.col("start_ms") + 9000
    return V.segments(spark, sf).select(
        *ID, timefmt.duration(start, "end_ms").cast("bigint").alias("clamped"),
        timefmt.duration(start, "end_ms", clamp=False).cast("bigint").alias("plain"),
    )


@query(
    "fn09_safe_div",
    f"WITH {SEG} SELECT episode_id, seg_idx, CASE WHEN turn % 3 = 0 THEN 0.0 ELSE start_ms::DOUBLE / (turn % 3) END AS ratio FROM seg",
)
def fn09(spark, sf):
    return V.segments(spark, sf).select(*ID, numeric.safe_div("start_ms", F.col("turn") % 3).alias("ratio"))


_URL = (
    "CASE page_id % 5 WHEN 0 THEN ' https://www.youtube.com/watch?v=v' || page_id || '&t=5s ' "
    "WHEN 1 THEN 'https://youtu.be/b' || page_id || '?si=x' "
    "WHEN 2 THEN 'https://www.youtube.com/embed/e' || page_id || '?start=1' "
    "WHEN 3 THEN ' id' || page_id || ' ' ELSE url END"
)


@query(
    "fn10_video_id",
    f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'v' || page_id WHEN 1 THEN 'b' || page_id WHEN 2 THEN 'e' || page_id
      WHEN 3 THEN 'id' || page_id ELSE trim(url) END AS video_id FROM pages""",
)
def fn10(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", labels.video_id(F.expr(_URL)).alias("video_id"))


_STEM = (
    "CASE page_id % 4 WHEN 0 THEN 'Episode' || page_id || '_Some_Guest' WHEN 1 THEN 'Episode0' || page_id "
    "WHEN 2 THEN 'Trailer_' || page_id ELSE 'Episode_' || page_id END"
)


_NUMBER = f"TRY_CAST(replace(split_part({_STEM}, '_', 1), 'Episode', '') AS INTEGER)"


@query(
    "fn11_episode_number",
    f"SELECT page_id, {_NUMBER} AS number FROM pages",
)
def fn11(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", labels.episode_number(F.expr(_STEM)).alias("number"))


@query(
    "fn12_output_name",
    """SELECT doc_id, 'ep' || doc_id || '.diarized.txt' AS diarized, 'ep' || doc_id || '_cleaned.txt' AS cleaned,
      'ep' || doc_id || '_cleaned_questions_v2.txt' AS questions FROM documents""",
)
def fn12(spark, sf):
    stem = F.concat(F.lit("ep"), F.col("doc_id"))
    return V.documents(spark, sf).select(
        "doc_id",
        labels.output_name(F.concat(stem, F.lit(".deepgram.json")), "diarized").alias("diarized"),
        labels.output_name(F.concat(stem, F.lit("_raw.txt")), "cleaned").alias("cleaned"),
        labels.output_name(F.concat(stem, F.lit("_cleaned.txt")), "questions").alias("questions"),
    )


# Typographic characters to normalise, written as code points for both engines.
_MESSY = (
    "{c}(8220) || 'Hi' || {c}(8221) || {c}(160) || {c}(8211) || '  x' || {c}(9) || {c}(9) || 'y ' || {c}(13) || {c}(10) "
    "|| '   ' || {c}(13) || {c}(10) || {c}(10) || {c}(10) || {c}(8203) || 'a' || {c}(7) || 'b' || {c}(8230) || {c}(13) || text"
)

def messy(spark, sf):
    """Documents with typographic noise in front of the text."""
    codes = sorted({8220, 8221, 160, 8211, 9, 13, 10, 8203, 7, 8230})
    expr = _MESSY
    for code in codes:
        expr = expr.replace(f"{{c}}({code})", f"'\\u{code:04x}'")
    return V.documents(spark, sf).withColumn("text", F.expr(expr))


_CLEAN = "(" + _MESSY.replace("{c}", "chr") + ")"
NORMALIZED_SQL = f"""n0 AS (SELECT doc_id, replace(translate({_CLEAN},
      chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8211) || chr(8212) || chr(160), '''''""-- '), chr(8230), '...') AS t FROM documents),
    n1 AS (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
      '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{{9F}}]', '', 'g') AS t FROM n0),
    n2 AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^[ \\t]+|[ \\t]+$', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'),
      '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM n1),
    norm AS (SELECT doc_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS clean FROM n2)"""


@query("fn13_normalize_text", f"WITH {NORMALIZED_SQL} SELECT doc_id, clean FROM norm")
def fn13(spark, sf):
    return messy(spark, sf).select("doc_id", text.normalize_text("text").alias("clean"))


@query("fn14_lower_copy", "SELECT doc_id, lower(text) AS lowered FROM documents")
def fn14(spark, sf):
    return V.documents(spark, sf).select("doc_id", text.lower_copy("text").alias("lowered"))


@query(
    "fn15_squash_ws",
    "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squashed FROM documents",
)
def fn15(spark, sf):
    return V.documents(spark, sf).select("doc_id", text.squash_ws("text").alias("squashed"))


@query(
    "fn16_truncate_ellipsis",
    "SELECT doc_id, CASE WHEN length(text) > 220 THEN left(text, 219) || chr(8230) ELSE text END AS cut FROM documents",
)
def fn16(spark, sf):
    return V.documents(spark, sf).select("doc_id", text.truncate_ellipsis("text").alias("cut"))


@query("fn17_word_count", f"SELECT doc_id, {wc('text')} AS n_words FROM documents")
def fn17(spark, sf):
    return V.documents(spark, sf).select("doc_id", text.word_count("text").alias("n_words"))


@query(
    "fn18_sentence_mark_count",
    "SELECT doc_id, (length(text) - length(replace(replace(replace(text, '.', ''), '?', ''), '!', '')))::BIGINT AS n_marks FROM documents",
)
def fn18(spark, sf):
    return V.documents(spark, sf).select("doc_id", text.sentence_mark_count("text").alias("n_marks"))


@query(
    "fn19_has_devanagari",
    """SELECT doc_id, regexp_matches(CASE WHEN doc_id % 5 = 0 THEN text || chr(2344) ELSE text END,
      '[\\x{0900}-\\x{097F}]') AS devanagari FROM documents""",
)
def fn19(spark, sf):
    docs = V.documents(spark, sf)
    mixed = F.expr("CASE WHEN doc_id % 5 = 0 THEN concat(text, '\\u0928') ELSE text END")
    return docs.select("doc_id", text.has_devanagari(mixed).alias("devanagari"))


@query(
    "fn20_contains_keywords",
    f"""WITH {SEG} SELECT episode_id, seg_idx, regexp_matches(lower(text), '{_or(lexicons.CTA_BROAD)}') AS cta,
      regexp_matches(lower(text), '{_or(lexicons.SPONSOR_V2)}') AS sponsor FROM seg""",
)
def fn20(spark, sf):
    return V.segments(spark, sf).select(
        *ID, text.contains_keywords("text", lexicons.CTA_BROAD).alias("cta"),
        text.contains_keywords("text", lexicons.SPONSOR_V2).alias("sponsor"),
    )


PLAIN = "regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')"


@query(
    "fn21_contains_keywords_nopunct",
    f"""WITH {SEG} SELECT episode_id, seg_idx, regexp_matches({PLAIN}, '{_or(lexicons.HOST_V5)}') AS host,
      regexp_matches({PLAIN}, '{_or(lexicons.GUEST_V5)}') AS guest FROM seg""",
)
def fn21(spark, sf):
    return V.segments(spark, sf).select(
        *ID, text.contains_keywords_nopunct("text", lexicons.HOST_V5).alias("host"),
        text.contains_keywords_nopunct("text", lexicons.GUEST_V5).alias("guest"),
    )


STARTS = "^(" + _or(lexicons.QUESTION_STARTERS) + ")"
IS_QUESTION = f"(ends_with(trim(text), '?') OR regexp_matches(lower(trim(text)), '{STARTS}'))"


@query(
    "fn22_is_question_segment",
    f"WITH {SEG} SELECT episode_id, seg_idx, {IS_QUESTION} AS is_question FROM seg",
)
def fn22(spark, sf):
    return V.segments(spark, sf).select(*ID, text.is_question_segment("text").alias("is_question"))


QWORDS = "\\b(" + "|".join(lexicons.QUESTION_WORDS) + ")\\b"


def is_question_sentence_sql(s: str) -> str:
    low = f"trim(lower({s}))"
    return (
        f"(ends_with({low}, '?') OR regexp_matches({_ascii(f'string_split({low}, chr(32))[1]')}, '{QWORDS}') "
        f"OR (regexp_matches({_ascii(low)}, '{QWORDS}') AND length({low}) < 140))"
    )


@query(
    "fn23_is_question_sentence",
    f"""WITH {SEG}, s AS (SELECT *, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM seg)
    SELECT episode_id, seg_idx, {is_question_sentence_sql('t')} AS is_question FROM s""",
)
def fn23(spark, sf):
    s = text.squash_ws("text")
    return V.segments(spark, sf).select(*ID, text.is_question_sentence(s).alias("is_question"))


@query(
    "fn24_question_mark_flag",
    f"""WITH {SEG} SELECT episode_id, seg_idx, regexp_matches(text, '\\?\\s*$') AS final,
      contains(text, '?') AS anywhere FROM seg""",
)
def fn24(spark, sf):
    return V.segments(spark, sf).select(
        *ID, text.question_mark_flag("text").alias("final"), text.question_mark_flag("text", "any").alias("anywhere")
    )


def host_score_sql(col: str) -> str:
    t = f"trim({_ascii(f'lower({col})')}, ' ' || chr(10))"
    parts = [
        f"CASE WHEN regexp_matches({t}, '{_sql(chr(92) + '?$|' + lexicons.whole_words(lexicons.HOST_SCORE_QUESTION_CUES))}') THEN 2.0 ELSE 0.0 END",
        f"CASE WHEN ends_with({t}, '?') THEN 2.0 ELSE 0.0 END",
        *[f"CASE WHEN regexp_matches({t}, '{_sql(lexicons.whole_words([p]))}') THEN 3.0 ELSE 0.0 END" for p in lexicons.HOST_SCORE_PHRASES],
        f"CASE WHEN regexp_matches({t}, '{_sql(lexicons.HOST_SCORE_INTERJECTION)}') THEN 0.75 ELSE 0.0 END",
    ]
    return "(" + " + ".join(parts) + ")::DOUBLE"


@query("fn25_host_score_text", f"WITH {SEG} SELECT episode_id, seg_idx, {host_score_sql('text')} AS score FROM seg")
def fn25(spark, sf):
    return V.segments(spark, sf).select(*ID, text.host_score_text("text").alias("score"))


def cue_hits_sql(col: str, count_questions: bool = False) -> str:
    pattern = "(?i)" + lexicons.whole_words(lexicons.HOST_CUES) + ("|\\?" if count_questions else "")
    return f"len(regexp_extract_all({_ascii(col)}, '{_sql(pattern)}'))"


@query(
    "fn26_cue_hits",
    f"""WITH {SEG} SELECT episode_id, seg_idx, {cue_hits_sql('text')} AS hits,
      {cue_hits_sql('text', True)} AS hits_asr FROM seg""",
)
def fn26(spark, sf):
    return V.segments(spark, sf).select(
        *ID, text.cue_hits("text").alias("hits"), text.cue_hits("text", True).alias("hits_asr")
    )


TRIMMED = "trim(text, ' ' || chr(10))"
LINE = f"'[' || {clock('start_ms')} || ' - ' || {clock('end_ms')} || '] ' || speaker || ': ' || {TRIMMED}"
LINES_SQL = f"""line AS (SELECT episode_id, seg_idx, speaker, speaker_raw, turn, string_split({LINE}, chr(10)) AS parts
      FROM seg WHERE {TRIMMED} <> ''),
    lines AS (SELECT episode_id, seg_idx, speaker, turn, i - 1 AS line_idx, parts[i] AS line FROM line, range(1, len(parts) + 1) r(i))"""
STAMP = "\\[\\d{2}:\\d{2}:\\d{2}\\.\\d{3}\\s*-\\s*\\d{2}:\\d{2}:\\d{2}\\.\\d{3}\\]"
LINE_RE = f"^\\s*({STAMP})\\s*([A-Za-z0-9_ .-]{{1,64}})\\s*:\\s*(.*)$"


def rendered_lines(spark, sf):
    """Rendered transcript lines; a text with breaks gives several lines."""
    from colloquy.operators.sequences import split_lines

    s = V.segments(spark, sf)
    line = labels.render_line("speaker", "text", "start_ms", "end_ms")
    rows = s.withColumn("line", line).filter(F.col("line").isNotNull())
    return split_lines(rows.select("episode_id", "seg_idx", "speaker", "turn", "line"), "line", "line_idx", "line")


@query(
    "fn27_parse_transcript_line",
    f"""WITH {SEG}, {LINES_SQL} SELECT episode_id, seg_idx, line_idx::INTEGER AS line_idx,
      CASE WHEN regexp_matches(line, '{LINE_RE}') THEN regexp_extract(line, '{LINE_RE}', 1) END AS ts,
      CASE WHEN regexp_matches(line, '{LINE_RE}') THEN regexp_extract(line, '{LINE_RE}', 2) END AS speaker,
      CASE WHEN regexp_matches(line, '{LINE_RE}') THEN regexp_extract(line, '{LINE_RE}', 3) END AS utt FROM lines""",
)
def fn27(spark, sf):
    parsed = rendered_lines(spark, sf).withColumn("p", labels.parse_transcript_line("line"))
    return parsed.select("episode_id", "seg_idx", "line_idx", "p.ts", "p.speaker", "p.utt")


@query(
    "fn28_strip_role_tag",
    f"WITH {SEG} SELECT episode_id, seg_idx, CASE WHEN turn % 4 = 3 THEN speaker || ' (X)' ELSE speaker END AS label FROM seg",
)
def fn28(spark, sf):
    tagged = F.expr(
        "concat(speaker, CASE turn % 4 WHEN 0 THEN ' (HOST)' WHEN 1 THEN ' (co-host) ' WHEN 2 THEN '' ELSE ' (X)' END)"
    )
    return V.segments(spark, sf).select(*ID, labels.strip_role_tag(tagged).alias("label"))


_ROLE = "CASE turn % 5 WHEN 0 THEN 'Host' WHEN 1 THEN 'cohost' WHEN 2 THEN 'guest' WHEN 3 THEN 'other' END"


@query(
    "fn29_role_tag",
    f"""WITH {SEG} SELECT episode_id, seg_idx, CASE turn % 5 WHEN 0 THEN 'HOST' WHEN 1 THEN 'CO-HOST'
      WHEN 2 THEN 'GUEST' ELSE 'UNKNOWN' END AS tag FROM seg""",
)
def fn29(spark, sf):
    return V.segments(spark, sf).select(*ID, labels.role_tag(F.expr(_ROLE)).alias("tag"))


@query(
    "fn30_rewrite_line",
    f"""WITH {SEG}, {LINES_SQL}, t AS (SELECT *, CASE speaker WHEN 'Speaker 1' THEN 'HOST' WHEN 'Speaker 2' THEN 'GUEST'
      ELSE 'UNKNOWN' END AS tag, regexp_matches(line, '{LINE_RE}') AS ok FROM lines)
    SELECT episode_id, seg_idx, line_idx::INTEGER AS line_idx,
      CASE WHEN ok THEN regexp_replace(line, '{LINE_RE}', '\\1 \\2 (' || tag || '): \\3') ELSE line END AS suffixed,
      CASE WHEN ok AND tag <> 'UNKNOWN' THEN regexp_replace(line, '^(\\[.*?\\]\\s*)(Speaker\\s+\\d+)(:\\s*)(.*)$', '\\1' || tag || ' (\\2)\\3\\4')
        ELSE line END AS prefixed FROM t""",
)
def fn30(spark, sf):
    role = F.expr("CASE speaker WHEN 'Speaker 1' THEN 'host' WHEN 'Speaker 2' THEN 'guest' ELSE 'unknown' END")
    return rendered_lines(spark, sf).select(
        "episode_id", "seg_idx", "line_idx", labels.rewrite_line("line", role).alias("suffixed"),
        labels.rewrite_line("line", F.upper(role), "prefix").alias("prefixed"),
    )


_GENDER = "CASE turn % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN 'unknown' END"


@query(
    "fn31_render_line",
    f"""WITH {SEG}, g AS (SELECT *, CASE turn % 4 WHEN 0 THEN ' (male)' WHEN 1 THEN ' (female)' ELSE '' END AS g FROM seg WHERE {TRIMMED} <> '')
    SELECT episode_id, seg_idx, {LINE} AS plain,
      '[' || {clock('start_ms')} || ' - ' || {clock('end_ms')} || '] ' || speaker || g || ': ' || {TRIMMED} AS gendered,
      format('[{{:02d}}:{{:02d}}] ', start_ms // 60000, start_ms // 1000 % 60) || speaker || ': ' || {TRIMMED} AS minute,
      format('[{{:02d}}:{{:02d}}:{{:02d}}] ', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60) || 'HOST: ' || {TRIMMED} AS clock
    FROM g""",
)
def fn31(spark, sf):
    s = V.segments(spark, sf)
    plain = labels.render_line("speaker", "text", "start_ms", "end_ms")
    return s.select(
        *ID, plain.alias("plain"),
        labels.render_line("speaker", "text", "start_ms", "end_ms", F.expr(_GENDER)).alias("gendered"),
        labels.render_line("speaker", "text", "start_ms", style="minute").alias("minute"),
        labels.render_line(F.lit("HOST"), "text", "start_ms", style="clock").alias("clock"),
    ).filter(F.col("plain").isNotNull())


_ONE_LINE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(
    "fn32_append_gender_to_line",
    f"""WITH {SEG} SELECT episode_id, seg_idx, format('[{{:02d}}:{{:02d}}] ', start_ms // 60000, start_ms // 1000 % 60) || speaker ||
      CASE turn % 4 WHEN 0 THEN ' (male)' WHEN 1 THEN ' (female)' ELSE '' END || ': ' || {_ONE_LINE} AS line
    FROM seg WHERE {_ONE_LINE} <> ''""",
)
def fn32(spark, sf):
    line = labels.render_line("speaker", text.squash_ws("text"), "start_ms", style="minute")
    rows = V.segments(spark, sf).withColumn("line", line).filter(F.col("line").isNotNull())
    return rows.select(*ID, labels.append_gender_to_line("line", F.expr(_GENDER)).alias("line"))


@query(
    "fn33_relabel_host_guest",
    f"""WITH {SEG} SELECT episode_id, seg_idx,
      CASE WHEN speaker = 'Unknown' THEN 'Unknown' WHEN (episode_id % 2 = 0) = (speaker = 'Speaker 2') THEN 'Host' ELSE 'Guest' END AS speaker,
      nullif(speaker, 'Unknown') AS speaker_original FROM seg""",
)
def fn33(spark, sf):
    host = F.expr("CASE WHEN episode_id % 2 = 0 THEN 'Speaker 2' ELSE 'Speaker 1' END")
    out = V.segments(spark, sf).withColumn("r", labels.relabel_host_guest("speaker", host))
    return out.select(*ID, "r.speaker", "r.speaker_original")


@query(
    "fn34_add_role_to_words",
    f"""WITH {V.WORD} SELECT w.episode_id, w.word_idx, w.token AS word, CASE s.speaker WHEN 'Speaker 1' THEN 'HOST' ELSE 'GUEST' END AS speaker_role
    FROM word w JOIN seg s ON s.episode_id = w.episode_id AND s.seg_idx = w.word_idx // 16777216""",
)
def fn34(spark, sf):
    s = V.segments(spark, sf)
    listed = F.transform(text.tokens("text"), lambda t, i: F.struct(t.alias("word"), i.alias("pos")))
    role = F.when(F.col("speaker") == "Speaker 1", "HOST").otherwise("GUEST")
    rows = s.withColumn("words", labels.add_role_to_words(listed, role)).select(*ID, F.explode("words").alias("w"))
    return rows.select(
        "episode_id", (F.col("seg_idx") * 16777216 + F.col("w.pos")).alias("word_idx"), "w.word", "w.speaker_role"
    )


# Model replies in the forms that occur: fenced, inside prose, plain, empty, broken.
REPLY = (
    "CASE turn % 5 WHEN 0 THEN '```json' || chr(10) || {obj} || chr(10) || '```' WHEN 1 THEN 'Sure: ' || {obj} || ' Done.' "
    "WHEN 2 THEN {obj} WHEN 3 THEN '' ELSE 'no object {{here' END"
)
_OBJ = "'{\"host_speaker_raw\": \"' || speaker || '\", \"turn\": ' || turn || '}'"


@query(
    "fn35_parse_model_json",
    f"""WITH {SEG} SELECT episode_id, seg_idx, CASE WHEN turn % 5 < 3 THEN speaker END AS host,
      CASE WHEN turn % 5 < 3 THEN turn::VARCHAR END AS turn_text FROM seg""",
)
def fn35(spark, sf):
    reply = F.expr(REPLY.replace("{obj}", _OBJ).replace("{{", "{"))
    parsed = V.segments(spark, sf).withColumn("j", replies.parse_model_json(reply))
    return parsed.select(
        *ID, F.get_json_object("j", "$.host_speaker_raw").alias("host"), F.get_json_object("j", "$.turn").alias("turn_text")
    )


@query(
    "fn36_reply_content",
    f"""WITH {SEG} SELECT episode_id, seg_idx, CASE turn % 3 WHEN 0 THEN 'said ' || turn WHEN 1 THEN 'text ' || turn ELSE '' END AS content FROM seg""",
)
def fn36(spark, sf):
    response = F.expr(
        "CASE turn % 3 WHEN 0 THEN '{\"choices\":[{\"message\":{\"content\":\"said ' || turn || '\"}}]}' "
        "WHEN 1 THEN '{\"choices\":[{\"message\":{\"content\":\"\"},\"text\":\"text ' || turn || '\"}]}' "
        "ELSE '{\"choices\":[]}' END"
    )
    return V.segments(spark, sf).select(*ID, replies.reply_content(response).alias("content"))


@query(
    "fn37_normalize_assignments",
    f"""WITH {SEG}, e AS (SELECT DISTINCT episode_id FROM seg WHERE episode_id % 4 <> 3)
    SELECT episode_id, 'Speaker 1' AS speaker, CASE WHEN episode_id % 4 = 0 THEN 'host' ELSE 'unknown' END AS role,
      0.5 + (episode_id % 4) / 10.0::DOUBLE AS confidence FROM e
    UNION ALL SELECT episode_id, 'Speaker 2', 'guest', 0.0 FROM e""",
)
def fn37(spark, sf):
    episodes = V.segments(spark, sf).select("episode_id").distinct()
    reply = F.expr(
        "CASE WHEN episode_id % 4 = 3 THEN 'no json' ELSE "
        "'```json{\"assignments\":[{\"speaker\":\" Speaker 1 \",\"role\":\"guest\",\"confidence\":0.1},"
        "{\"speaker\":\"Speaker 2\",\"role\":\" Guest\",\"confidence\":\"high\"},{\"speaker\":\"\",\"role\":\"host\",\"confidence\":1},"
        "{\"speaker\":\"Speaker 1\",\"role\":\"' || CASE WHEN episode_id % 4 = 0 THEN 'HOST' ELSE 'boss' END || "
        "'\",\"confidence\":0.' || (5 + episode_id % 4) || '}]}```' END"
    )
    return roles.normalize_assignments(episodes.withColumn("reply", reply))


@query(
    "fn38_classify_pitch",
    f"""WITH {V.FEED} SELECT episode_id, idx, CASE WHEN median_hz IS NULL THEN 'unknown' WHEN median_hz < 165 THEN 'male'
      WHEN median_hz > 180 THEN 'female' ELSE 'ambiguous' END AS gender FROM feed""",
)
def fn38(spark, sf):
    return V.feed(spark, sf).select("episode_id", "idx", labels.classify_pitch("median_hz").alias("gender"))


@query(
    "fn39_api_query_params",
    """SELECT doc_id, concat_ws('&', CASE WHEN doc_id % 2 = 0 THEN 'diarize=true' END, 'language=' || lang,
      CASE WHEN doc_id % 3 = 0 THEN 'model=m' || doc_id % 4 END) AS params FROM documents""",
)
def fn39(spark, sf):
    params = labels.api_query_params(
        {
            "diarize": F.when(F.col("doc_id") % 2 == 0, F.lit(True)),
            "language": F.col("lang"),
            "model": F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("m"), F.col("doc_id") % 4)).otherwise(""),
        }
    )
    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return V.documents(spark, sf).select("doc_id", F.array_join(pairs, "&").alias("params"))


@query(
    "fn40_guess_media_type",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'audio/x-wav' WHEN 1 THEN 'audio/mpeg' WHEN 2 THEN 'application/octet-stream'
      ELSE 'video/mp4' END AS media_type FROM documents""",
)
def fn40(spark, sf):
    path = F.expr(
        "concat('/in/ep', doc_id, CASE doc_id % 4 WHEN 0 THEN '.wav' WHEN 1 THEN '.MP3' WHEN 2 THEN '.xyz' ELSE '.mp4' END)"
    )
    return V.documents(spark, sf).select("doc_id", labels.guess_media_type(path).alias("media_type"))


@query(
    "fn41_role_columns",
    f"""WITH {SEG} SELECT episode_id, seg_idx, CASE speaker_id WHEN 0 THEN 'HOST' WHEN 1 THEN 'GUEST' ELSE 'UNKNOWN' END AS role,
      CASE speaker_id WHEN 0 THEN 'HOST (Speaker 0)' WHEN 1 THEN 'GUEST (Speaker 1)' ELSE 'Speaker 2' END AS speaker_role_label FROM seg""",
)
def fn41(spark, sf):
    role = F.expr("CASE speaker_id WHEN 0 THEN 'HOST' WHEN 1 THEN 'GUEST' END")
    out = V.segments(spark, sf).withColumn("r", labels.role_columns(labels.speaker_label("speaker_id", 0), role))
    return out.select(*ID, "r.role", "r.speaker_role_label")


# --- filters -------------------------------------------------------------------


@query("fl01_drop_empty_text", f"WITH {SEG} SELECT episode_id, seg_idx, {TRIMMED} AS text FROM seg WHERE {TRIMMED} <> ''")
def fl01(spark, sf):
    return filters.drop_empty_text(V.segments(spark, sf)).select(*ID, "text")


_CONF = "CASE WHEN turn % 4 = 1 THEN NULL ELSE confidence END"


@query("fl02_min_confidence", f"WITH {SEG} SELECT episode_id, seg_idx, confidence FROM seg WHERE coalesce({_CONF}, 0) > 0.3")
def fl02(spark, sf):
    s = V.segments(spark, sf).withColumn("confidence", F.expr(_CONF))
    return filters.min_confidence(s).select(*ID, "confidence")


@query("fl03_valid_words", f"WITH {V.WORD} SELECT episode_id, word_idx, speaker FROM word WHERE speaker IS NOT NULL")
def fl03(spark, sf):
    return filters.valid_words(V.words(spark, sf)).select("episode_id", "word_idx", "speaker")


@query("fl04_voiced_gender_only", f"WITH {V.FEED} SELECT episode_id, idx, gender FROM feed WHERE gender <> 'noise'")
def fl04(spark, sf):
    return filters.voiced_gender_only(V.feed(spark, sf)).select("episode_id", "idx", "gender")


@query(
    "fl05_known_and_positive",
    f"WITH {SEG} SELECT episode_id, seg_idx, speaker FROM seg WHERE speaker <> 'Unknown' AND end_ms > start_ms",
)
def fl05(spark, sf):
    return filters.positive_length(filters.drop_unknown_speaker(V.segments(spark, sf))).select(*ID, "speaker")


@query(
    "fl06_episode_range",
    f"SELECT page_id FROM pages WHERE {_NUMBER} IS NULL OR {_NUMBER} BETWEEN 50 AND 150",
)
def fl06(spark, sf):
    numbered = V.table(spark, sf, "pages").select("page_id", labels.episode_number(F.expr(_STEM)).alias("number"))
    return filters.episode_range(numbered, "number", 50, 150).select("page_id")


_MIXED = (
    "CASE WHEN doc_id % 7 = 6 THEN ' ' || {c}(10) || ' ' WHEN doc_id % 5 = 0 THEN text || {c}(2344) ELSE text END"
)


def mixed_language(spark, sf):
    """Documents of which some are blank and some hold Devanagari."""
    expr = _MIXED.replace("{c}(10)", "'\\n'").replace("{c}(2344)", "'\\u0928'")
    return V.documents(spark, sf).withColumn("text", F.expr(expr))


MIXED_SQL = f"mixed AS (SELECT doc_id, {_MIXED.replace('{c}', 'chr')} AS text FROM documents)"
DEVANAGARI = "'[\\x{0900}-\\x{097F}]'"


@query(
    "fl07_needs_translation",
    f"""WITH {MIXED_SQL} SELECT doc_id, CASE WHEN regexp_matches(text, {DEVANAGARI}) THEN 'translate' ELSE 'copy' END AS route
    FROM mixed WHERE regexp_replace(text, '\\s+', '', 'g') <> ''""",
)
def fl07(spark, sf):
    return filters.needs_translation(mixed_language(spark, sf)).select("doc_id", "route")


_VOICE = "CASE WHEN conv_id % 3 = 0 THEN 'solo' ELSE role END"


@query(
    "fl08_min_two_speakers",
    f"""SELECT conv_id AS episode_id, count(DISTINCT {_VOICE}) AS n_speakers, count(DISTINCT {_VOICE}) >= 2 AS accepted,
      CASE WHEN count(DISTINCT {_VOICE}) < 2 THEN 'Need at least 2 speakers' END AS error
    FROM conversations GROUP BY 1""",
)
def fl08(spark, sf):
    rows = V.table(spark, sf, "conversations").selectExpr("conv_id AS episode_id", f"{_VOICE} AS speaker")
    return filters.min_two_speakers(rows)
