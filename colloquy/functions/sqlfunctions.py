"""The scalar functions for SQL users, as temporary SQL functions.

Spark inlines their bodies into the plan, so they cost nothing over the column
functions of the same meaning. Call `register_sql_functions(spark)` once per
session.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from colloquy import lexicons
from colloquy.functions.labels import ROLE_SUFFIX
from colloquy.functions.text import WS


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


_STRIPPED = f"regexp_replace(txt, {_quoted(f'(?U)^{WS}+|{WS}+$')}, '')"
_STARTERS = _quoted("^(?:" + "|".join(lexicons.QUESTION_STARTERS) + ")")

# name: (parameters, return type, body)
SQL_FUNCTIONS = {
    "ms_of": ("sec DOUBLE", "BIGINT", "CAST(bround(sec * 1000, 0) AS BIGINT)"),
    "fmt_hms_ms": (
        "sec DOUBLE", "STRING",
        "format_string('%02d:%02d:%02d.%03d', ms_of(sec) div 3600000, mod(ms_of(sec) div 60000, 60), "
        "mod(ms_of(sec) div 1000, 60), mod(ms_of(sec), 1000))",
    ),
    "fmt_ms": ("sec DOUBLE", "STRING", "format_string('%02d:%02d', floor(sec) div 60, mod(floor(sec), 60))"),
    "fmt_hms": (
        "sec DOUBLE", "STRING",
        "format_string('%02d:%02d:%02d', coalesce(floor(sec), 0) div 3600, mod(coalesce(floor(sec), 0) div 60, 60), "
        "mod(coalesce(floor(sec), 0), 60))",
    ),
    "speaker_label": ("id BIGINT", "STRING", "concat('Speaker ', CAST(id + 1 AS STRING))"),
    "other_speaker": ("label STRING", "STRING", "CASE WHEN label = 'Speaker 2' THEN 'Speaker 1' ELSE 'Speaker 2' END"),
    "interval_overlap": (
        "a0 BIGINT, a1 BIGINT, b0 BIGINT, b1 BIGINT", "BIGINT", "greatest(0, least(a1, b1) - greatest(a0, b0))",
    ),
    "clamped_duration": ("t0 BIGINT, t1 BIGINT", "BIGINT", "greatest(0, t1 - t0)"),
    "safe_div": ("a DOUBLE, b DOUBLE", "DOUBLE", "coalesce(try_divide(a, b), 0.0D)"),
    "video_id": (
        "url STRING", "STRING",
        "CASE WHEN contains(url, 'watch?v=') THEN substring_index(substring_index(btrim(url), 'watch?v=', -1), '&', 1) "
        "WHEN contains(url, 'youtu.be/') THEN substring_index(substring_index(btrim(url), 'youtu.be/', -1), '?', 1) "
        "WHEN contains(url, 'youtube.com/embed/') "
        "THEN substring_index(substring_index(btrim(url), 'youtube.com/embed/', -1), '?', 1) ELSE btrim(url) END",
    ),
    "episode_number": (
        "stem STRING", "INT", "try_cast(btrim(replace(split_part(stem, '_', 1), 'Episode', '')) AS INT)",
    ),
    "squash_ws": (
        "txt STRING", "STRING", f"btrim(regexp_replace(txt, {_quoted(f'(?U){WS}+')}, ' '))",
    ),
    "truncate_ellipsis": (
        "txt STRING, n INT", "STRING", "CASE WHEN length(txt) > n THEN concat(left(txt, n - 1), '\\u2026') ELSE txt END",
    ),
    "word_count": (
        "txt STRING", "BIGINT",
        f"CAST(size(filter(split(coalesce(txt, ''), {_quoted(f'(?U){WS}+')}), w -> w <> '')) AS BIGINT)",
    ),
    "sentence_mark_count": ("txt STRING", "BIGINT", "CAST(coalesce(regexp_count(txt, '[.?!]'), 0) AS BIGINT)"),
    "has_devanagari": ("txt STRING", "BOOLEAN", r"coalesce(txt RLIKE r'[ऀ-ॿ]', false)"),
    "is_question_segment": (
        "txt STRING", "BOOLEAN",
        f"coalesce(endswith({_STRIPPED}, '?') OR lower({_STRIPPED}) RLIKE {_STARTERS}, false)",
    ),
    "question_mark_flag": ("txt STRING", "BOOLEAN", f"coalesce(txt RLIKE {_quoted(f'(?U)[?]{WS}*$')}, false)"),
    "role_tag": (
        "role STRING", "STRING",
        "CASE lower(role) WHEN 'host' THEN 'HOST' WHEN 'cohost' THEN 'CO-HOST' WHEN 'guest' THEN 'GUEST' ELSE 'UNKNOWN' END",
    ),
    "strip_role_tag": (
        "label STRING", "STRING",
        f"CASE WHEN label RLIKE {_quoted(ROLE_SUFFIX)} THEN btrim(regexp_extract(label, {_quoted(ROLE_SUFFIX)}, 1)) ELSE label END",
    ),
    "classify_pitch": (
        "hz DOUBLE", "STRING",
        "CASE WHEN hz IS NULL THEN 'unknown' WHEN hz < 165 THEN 'male' WHEN hz > 180 THEN 'female' ELSE 'ambiguous' END",
    ),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Define the functions in the session and return their names."""
    for name, (parameters, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    return list(SQL_FUNCTIONS)
