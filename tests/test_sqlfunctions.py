"""SQL functions give what the column functions give; Python functions reach the workers."""

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from colloquy.functions import labels, numeric, text, timefmt
from colloquy.functions.sqlfunctions import register_sql_functions
from colloquy.plans import views


def test_sql_functions_equal_column_functions(spark, sf):
    names = register_sql_functions(spark)
    rows = views.segments(spark, sf).withColumns(
        {
            "sec": (F.col("start_ms") * 10 + F.col("turn")) / 10000,
            "url": F.expr("CASE turn % 3 WHEN 0 THEN ' https://x/watch?v=a&b' WHEN 1 THEN 'https://youtu.be/q?z' ELSE ' raw ' END"),
            "stem": F.expr("CASE turn % 2 WHEN 0 THEN concat('Episode0', turn, '_x') ELSE 'Trailer' END"),
            "tagged": F.concat("speaker", F.lit(" (HOST)")),
            "hz": F.when(F.col("turn") % 4 != 0, F.col("confidence") * 300),
            "other": F.col("start_ms") + 4000,
        }
    )
    pairs = {
        "ms_of(sec)": timefmt.to_ms("sec"),
        "fmt_hms_ms(sec)": timefmt.fmt_hms_ms("sec"),
        "fmt_ms(sec)": timefmt.fmt_ms("sec"),
        "fmt_hms(sec)": timefmt.fmt_hms("sec"),
        "speaker_label(speaker_id)": labels.speaker_label("speaker_id"),
        "other_speaker(speaker)": labels.other_speaker("speaker"),
        "interval_overlap(start_ms, end_ms, other, end_ms)": timefmt.overlap("start_ms", "end_ms", "other", "end_ms"),
        "clamped_duration(other, end_ms)": timefmt.duration("other", "end_ms"),
        "safe_div(sec, turn % 3)": numeric.safe_div("sec", F.col("turn") % 3),
        "video_id(url)": labels.video_id("url"),
        "episode_number(stem)": labels.episode_number("stem"),
        "squash_ws(text)": text.squash_ws("text"),
        "truncate_ellipsis(text, 20)": text.truncate_ellipsis("text", 20),
        "word_count(text)": text.word_count("text"),
        "sentence_mark_count(text)": text.sentence_mark_count("text"),
        "has_devanagari(text)": text.has_devanagari("text"),
        "is_question_segment(text)": text.is_question_segment("text"),
        "question_mark_flag(text)": text.question_mark_flag("text"),
        "role_tag(role)": labels.role_tag("role"),
        "strip_role_tag(tagged)": labels.strip_role_tag("tagged"),
        "classify_pitch(hz)": labels.classify_pitch("hz"),
    }
    assert {p.split("(")[0] for p in pairs} == set(names)
    for call, column in pairs.items():
        got = rows.select(F.expr(call).alias("a"), column.alias("b"))
        assert got.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0, call


def test_python_functions_travel_with_their_tasks(tmp_path):
    """Workers that cannot import the package still run its Python functions."""
    repo = Path(__file__).resolve().parents[1]
    code = (
        f"import sys; sys.path.insert(0, {str(repo)!r})\n"
        "from colloquy import build_session\n"
        "from __spark_entry__ import queries\n"
        "spark = build_session(master='local[2]', shuffle_partitions=2)\n"
        "names = ['seq04_smooth_turns', 'fn13_normalize_text', 'fn20_contains_keywords']\n"
        "print('rows', *[queries()[n](spark, '/root/testdata/sf0.001').count() for n in names])\n"
    )
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300,
        env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"},
    )
    counts = [int(x) for x in done.stdout.split("rows", 1)[1].split()]
    assert len(counts) == 3 and all(counts)
