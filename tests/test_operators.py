"""Operators against brute force, published values and hand-made edge rows."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from colloquy import lexicons
from colloquy.functions import labels, replies, text, timefmt
from colloquy.operators import filters, folds, intervals, lookups, ranking, roles, stats, textops

SPAN = "episode_id bigint, {} bigint, start_ms bigint, end_ms bigint, speaker string"


def _spans(rng, n, horizon=400_000):
    rows = []
    for i in range(n):
        start = rng.randint(0, horizon)
        rows.append((rng.randint(1, 2), i, start, start + rng.choice([0, 50, 100, 5000, 70_000, 300_000]), rng.choice("ABC")))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_assign_speaker_brute_force(spark, seed):
    rng = random.Random(seed)
    segs, turns = _spans(rng, 60), _spans(rng, 40)
    turns += [(1, 100 + i, *turns[0][2:4], "Z") for i in range(5)]
    got = intervals.assign_speaker(
        spark.createDataFrame(segs, SPAN.format("seg_idx")).drop("speaker"),
        spark.createDataFrame(turns, SPAN.format("turn_idx")),
    )
    got = {r.seg_idx: (r.assigned, r.overlap_ms) for r in got.collect()}
    for e, i, s0, s1, _ in segs:
        best, who = 0, "Unknown"
        for te, _, t0, t1, spk in sorted(turns, key=lambda t: t[1]):
            ov = max(0, min(s1, t1) - max(s0, t0)) if te == e else 0
            if ov > best:
                best, who = ov, spk
        assert got[i] == (who if best >= 100 else "Unknown", best)


def test_overlap_threshold_and_tie(spark):
    segs = spark.createDataFrame([(1, 1, 0, 1000, ""), (1, 2, 5000, 6000, ""), (1, 3, 9000, 9999, "")], SPAN.format("seg_idx"))
    turns = spark.createDataFrame(
        [(1, 1, 0, 500, "B"), (1, 2, 500, 1000, "A"), (1, 3, 5900, 7000, "C"), (1, 4, 9900, 12000, "D")], SPAN.format("turn_idx")
    )
    got = intervals.assign_speaker(segs.drop("speaker"), turns).orderBy("seg_idx").collect()
    # equal overlaps: first listed; exactly 100 ms is kept, 99 ms is not
    assert [r.assigned for r in got] == ["B", "C", "Unknown"]


@pytest.mark.parametrize("seed", [3, 4])
def test_gender_overlap_brute_force(spark, seed):
    rng = random.Random(seed)
    segs = _spans(rng, 60)
    regions = [(e, s, t, rng.choice(["male", "female", "noise"])) for e, _, s, t, _ in _spans(rng, 60)]
    got = intervals.gender_overlap(
        spark.createDataFrame(segs, SPAN.format("seg_idx")),
        spark.createDataFrame(regions, "episode_id bigint, start_ms bigint, end_ms bigint, gender string"),
    )
    want = {}
    for e, _, s0, s1, spk in segs:
        for re_, r0, r1, g in regions:
            ov = max(0, min(s1, r1) - max(s0, r0)) if re_ == e and g != "noise" else 0
            if ov:
                cell = want.setdefault((e, spk), {"male": 0, "female": 0})
                cell[g] += ov
    assert {(r.episode_id, r.speaker): {"male": r.male_ms, "female": r.female_ms} for r in got.collect()} == want


def test_gender_from_overlaps(spark):
    rows = [(1, "a", 600, 400), (1, "b", 599, 401), (1, "c", 44450, 2396), (1, "d", 63, 4904)]
    df = spark.createDataFrame(rows, "episode_id bigint, speaker string, male_ms bigint, female_ms bigint")
    soft = {r.speaker: r.gender for r in intervals.speaker_gender(df).collect()}
    strict = {r.speaker: r.gender for r in intervals.speaker_gender(df, strict=True).collect()}
    assert soft == {"a": "male", "b": "unknown", "c": "male", "d": "female"}
    assert strict["a"] == "unknown"


def test_pitch_published_values(spark):
    df = spark.createDataFrame([(440.04, 53.10), (170.0, 5.0), (None, None)], "m double, s double")
    gender, confidence = stats.pitch_verdict(F.col("m"), F.col("s"))
    got = [tuple(r) for r in df.select(gender, F.round(confidence, 3)).collect()]
    assert got == [("female", 2.173), ("ambiguous", 0.3), ("unknown", 0.0)]


def test_speaker_stats_rounding(spark):
    # 17 utterances, 65.875 s, 226 words: the published pace is 205.84 words a minute
    rows = [(1, "Speaker 1", i, 0, 3875, "w " * 13 + "?" * (i == 0)) for i in range(16)] + [(1, "Speaker 1", 16, 0, 3875, "w " * 18)]
    df = spark.createDataFrame(rows, "episode_id bigint, speaker string, seg_idx bigint, start_ms bigint, end_ms bigint, text string")
    r = stats.speaker_stats(df).collect()[0]
    assert (r.num_sentences, r.total_speech_s, r.question_count) == (17, 65.875, 1)
    assert r.wpm_est == round(r.total_words / (65.875 / 60), 2)


def test_timestamps(spark):
    df = spark.createDataFrame([(59.9999,), (3599.9999,), (0.0005,), (75.25,)], "s double")
    got = df.select(
        timefmt.fmt_hms_ms("s"), timefmt.fmt_hms_ms("s", "A"), timefmt.fmt_hms_ms("s", "C"), timefmt.fmt_ms("s"), timefmt.fmt_hms("s")
    ).collect()
    assert tuple(got[0]) == ("00:01:00.000", "00:00:59.1000", "00:00:60.000", "00:59", "00:00:59")
    assert tuple(got[1])[:2] == ("01:00:00.000", "00:59:59.1000")
    assert tuple(got[3]) == ("00:01:15.250", "00:01:15.250", "00:01:15.250", "01:15", "00:01:15")


def _clean_model(s):
    s = unicodedata.normalize("NFKC", s)
    s = s.translate({ord(a): b for a, b in zip(text.PUNCT_FROM, text.PUNCT_TO)})
    s = s.translate({ord(c): None for c in text.DROPPED}).replace("\r\n", "\n").replace("\r", "\n")
    s = "".join(c for c in s if c in "\n\t" or unicodedata.category(c) != "Cc")
    s = "\n".join(line.strip() for line in s.split("\n"))
    import re

    s = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", s))
    return s.strip()


def test_normalize_text(spark):
    rng = random.Random(8)
    alphabet = list("ab \t\n\r") + ["\r\n", "​", "﻿", " ", " ", "　", " ", " ", "ﬁ", "“", "’",
                                    "—", "…", "−", "\x07", "\x85", "½", "न", "é", "‑"]
    samples = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", "plain text"]
    df = spark.createDataFrame(list(enumerate(samples)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", text.normalize_text("t").alias("c")).collect()}
    for i, s in enumerate(samples):
        assert got[i] == _clean_model(s), repr(s)


def test_white_space_and_words(spark):
    samples = ["", "  ", "a", "a b", " x　 y\x1fz ", "one two\nthree\t\tfour", "\x85q "]
    df = spark.createDataFrame(list(enumerate(samples)), "i int, t string")
    cols = [text.word_count("t"), text.squash_ws("t"), text.strip_ws("t"), text.line_list("t")]
    for row, s in zip(df.select("i", *cols).orderBy("i").collect(), samples):
        assert tuple(row)[1:4] == (len(s.split()), " ".join(s.split()), s.strip())
        assert row[4] == s.splitlines()


def test_keywords_match_like_contains(spark):
    rng = random.Random(9)
    phrases = lexicons.HOST_V5 + lexicons.SPONSOR_V4
    bits = " ".join(phrases).split() + ["%", "off", "subscribed"]
    samples = [" ".join(rng.choice(bits) for _ in range(12)) for _ in range(300)] + [p + "ed" for p in phrases]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r[1] for r in df.select("t", text.contains_keywords("t", phrases)).collect()]
    assert got == [any(p in s.lower() for p in phrases) for s in samples]


def test_keywords_without_punctuation(spark):
    df = spark.createDataFrame([("In today's episode, hi",), ("It's 20% off",), ("I subscribed!",)], "t string")
    got = df.select(
        text.contains_keywords_nopunct("t", lexicons.HOST_V5), text.contains_keywords_nopunct("t", ["% off"]),
        text.contains_keywords("t", lexicons.CTA_BROAD), text.contains_keywords("t", ["% off"]),
    ).collect()
    assert [tuple(r) for r in got] == [(True, False, False, False), (False, False, False, True), (False, False, True, False)]


def test_question_rules(spark):
    long_tail = " x" * 80
    samples = ["", "whatever it takes", "Really?", "i know what you mean", "i know what" + long_tail, "What" + long_tail, "somewhat odd"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = df.select(text.is_question_segment("t"), text.is_question_sentence("t")).collect()
    assert [r[0] for r in got] == [False, True, True, False, False, True, False]
    assert [r[1] for r in got] == [False, False, True, True, False, True, False]


def test_labels_and_lines(spark):
    df = spark.createDataFrame([("SPEAKER_07",), ("",), (None,), ("mr_o'neil",), ("SPEAKER_x",)], "l string")
    got = [r[0] for r in df.select(labels.pretty_speaker("l")).collect()]
    assert got == ["Speaker 8", "Speaker Unknown", "Speaker Unknown", "Mr O'Neil", "Speaker X"]
    line = "[00:00:01.000 - 00:00:02.500] Speaker 1: hi: there"
    df = spark.createDataFrame([(line,), ("[00:00:01.000 - 00:00:02.500] Speaker 1 (HOST): hi",), ("noise",)], "l string")
    got = df.select(labels.rewrite_line("l", F.lit("host")), labels.rewrite_line("l", F.lit("HOST"), "prefix")).collect()
    assert got[0][0] == line.replace("Speaker 1", "Speaker 1 (HOST)")
    assert got[0][1] == line.replace("Speaker 1", "HOST (Speaker 1)")
    # an already tagged line is outside the grammar and passes through
    assert got[1][0] == "[00:00:01.000 - 00:00:02.500] Speaker 1 (HOST): hi" and got[2][0] == "noise"


def test_render_parse_round_trip(spark, sf):
    from colloquy.plans import views

    segs = views.segments(spark, sf).withColumn("text", text.squash_ws("text")).filter("text <> ''")
    line = labels.render_line("speaker", "text", "start_ms", "end_ms")
    back = segs.select("speaker", "text", "start_ms", labels.parse_transcript_line(line).alias("p"))
    bad = back.filter(
        (F.col("p.speaker") != F.col("speaker")) | (F.col("p.utt") != F.col("text"))
        | ~F.col("p.ts").startswith(F.concat(F.lit("["), timefmt.fmt_hms_ms_from_ms("start_ms"))) | F.col("p").isNull()
    )
    assert segs.count() > 0 and bad.count() == 0


def test_model_replies(spark):
    rows = ["```json\n{\"a\": 1}\n```", "text {\"a\": {\"b\": 2}} more", "", "no", "{\"a\": ", None, "```{\"a\": 3}```"]
    df = spark.createDataFrame([(r,) for r in rows], "r string")
    got = [r[0] for r in df.select(replies.parse_model_json("r")).collect()]
    assert got == ["{\"a\": 1}", "{\"a\": {\"b\": 2}}", None, None, None, None, "{\"a\": 3}"]


def _chunks_model(body, limit):
    out, held, size = [], [], 0
    for line in body.splitlines():
        line = line.rstrip()
        if len(line) > limit:
            if held:
                out.append("\n".join(held))
            held, size = [], 0
            out += [line[i:i + limit] for i in range(0, len(line), limit)]
        elif size + len(line) + 1 <= limit:
            held.append(line)
            size += len(line) + 1
        else:
            if held:
                out.append("\n".join(held))
            held, size = [line], len(line) + 1
    return out + (["\n".join(held)] if held else [])


def test_chunk_lines(spark):
    rng = random.Random(10)
    docs = ["\n".join("x" * rng.choice([0, 1, 9, 10, 11, 25]) + rng.choice(["", "  "]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    docs += ["", "\n\n", "a" * 9, "a" * 10, "a" * 21]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    got = {}
    for r in folds.chunk_lines(df, 10).orderBy("doc_id", "chunk_idx").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {i: c for i, d in enumerate(docs) if (c := _chunks_model(d, 10))}


def test_translation_keeps_failed_chunks(spark):
    docs = spark.createDataFrame([(1, "न one\n" * 3), (2, "english"), (3, "  ")], "doc_id bigint, text string")

    def shouting():
        return lambda chunks: chunks.str.upper()

    def broken():
        def fail(chunks):
            raise RuntimeError("no service")
        return fail

    loud = {r.doc_id: (r.text, r.n_fallback) for r in textops.translate_documents(docs, shouting).collect()}
    assert loud == {1: ("न ONE\nन ONE\nन ONE", 0), 2: ("english", 0)}
    kept = {r.doc_id: (r.text, r.n_fallback) for r in textops.translate_documents(docs, broken).collect()}
    assert kept[1] == ("न one\nन one\nन one", 1)


def test_sentences_keep_abbreviations(spark):
    df = spark.createDataFrame([(1, "Dr. Rao came. Why?\nI do, e.g. now... Fine! ok")], "doc_id bigint, text string")
    got = [r.sentence for r in textops.split_sentences(df).orderBy("sentence_idx").collect()]
    assert got == ["Dr. Rao came.", "Why?", "I do, e.g. now...", "Fine!", "ok"]


SEGMENT = "episode_id bigint, seg_idx bigint, start_ms bigint, end_ms bigint, speaker string, text string"


def _talk(spark, rows):
    """rows of (speaker, text, seconds) in one episode."""
    return spark.createDataFrame([(1, i, i * 10_000, i * 10_000 + int(sec * 1000), s, t) for i, (s, t, sec) in enumerate(rows)], SEGMENT)


def _verdict(df):
    r = df.collect()[0]
    return r.host, r.guest, round(r.confidence, 4), r.method, r.detection_type


def test_rule_cascade(spark):
    one, two, unk = "Speaker 1", "Speaker 2", "Unknown"
    ask = [(one, "why?", 1)] * 6 + [(two, "because?", 1)]
    # position rules look past Unknown rows
    assert _verdict(roles.identify_host_keywords_first(_talk(spark, [(unk, "x", 1), (two, "y", 1), (one, "z", 1), (two, "q", 1)]))) == (
        two, one, 0.7, "speaks_first_and_last", "fallback")
    assert _verdict(roles.identify_host_keywords_first(_talk(spark, [(two, "y", 1), (one, "z", 1)])))[2:4] == (0.5, "speaks_first")
    # the lead must be five: 6 of 7 against 1
    assert _verdict(roles.identify_host_keywords_first(_talk(spark, ask))) == (one, two, round(6 / 7, 4), "questions (6 vs 1, 85.7%)", "questions")
    assert _verdict(roles.identify_host_keywords_first(_talk(spark, ask + [(two, "no?", 1)])))[4] == "fallback"
    # guest phrases point at the other speaker
    guest = [(one, "a", 1), (two, "thanks for having me", 1)]
    assert _verdict(roles.identify_host_keywords_first(_talk(spark, guest))) == (one, two, 0.9, "guest_phrases (1 phrases, inverted)", "guest_phrases")
    # hits by Unknown only fall through
    assert _verdict(roles.identify_host_keywords_first(_talk(spark, [(unk, "like and subscribe", 1), (one, "a", 1)])))[4] == "fallback"
    cta = [(two, "please subscribe", 1), (one, "a", 1)]
    assert _verdict(roles.identify_host_questions_first(_talk(spark, cta), "combined", True)) == (two, one, 0.95, "youtube_cta (1 mentions)", "youtube_cta")
    # questions first: the asker is the guest unless it is an interview
    assert _verdict(roles.identify_host_questions_first(_talk(spark, ask), "v2"))[:2] == (two, one)
    assert _verdict(roles.identify_host_questions_first(_talk(spark, ask), "v2", True))[3] == "questions (6 asked, 85.7%)"
    long_two = [(one, "a", 1), (two, "b", 9), (one, "c", 1), (two, "d", 9)]
    assert _verdict(roles.identify_host_dominance(_talk(spark, long_two)))[3] == "dominant_speaker (90.0%)"
    assert _verdict(roles.identify_host_keywords_first(_talk(spark, ask), force_host=two)) == (two, one, 1.0, "manual_override", "manual")


def test_question_lead_is_against_first_other_asker(spark):
    rows = [("A", "why?", 1)] * 7 + [("B", "so?", 1)] + [("C", "eh?", 1)] * 3
    got = _verdict(roles.identify_host_keywords_first(_talk(spark, rows)))
    assert got[0] == "A" and got[3] == "questions (7 vs 1, 63.6%)"


def test_top_speakers_ties_and_mapping(spark):
    rows = [(1, 0, 50, 150, "B"), (1, 1, 0, 100, "A"), (1, 2, 0, 10, "C"), (2, 0, 0, 1, "Z")]
    turns = spark.createDataFrame(rows, SPAN.format("turn_idx"))
    top = ranking.top_speakers(turns, 2, "turn_idx").orderBy("episode_id", "rank").collect()
    assert [(r.episode_id, r.speaker) for r in top] == [(1, "B"), (1, "A"), (2, "Z")]
    mapping = {(r.episode_id, r.speaker): r.label for r in ranking.speaker_mapping(turns).collect()}
    assert mapping == {(1, "A"): "Speaker 1", (1, "B"): "Speaker 2", (2, "Z"): "Speaker 1"}
    alone = roles.map_roles(turns.filter("episode_id = 2"), _talk(spark, [("Z", "hi", 1)]).withColumn("speaker_raw", F.lit("Z")), "time")
    assert [r.label for r in alone.collect()] == ["Host"]


def test_head_mid_tail_repeats_lines(spark):
    df = spark.createDataFrame([(1, i, f"l{i}") for i in range(5)], "episode_id bigint, line_idx bigint, line string")
    got = ranking.head_mid_tail_lines(df).collect()[0].sample
    body = "\n".join(f"l{i}" for i in range(5))
    assert got == f"=== BEGINNING ===\n{body}\n\n=== MIDDLE ===\n{body}\n\n=== END ===\n{body}\n"
    assert ranking.head_mid_tail_lines(df, max_chars=30).collect()[0].sample == got[:30]


def test_filters_and_lookups(spark):
    df = spark.createDataFrame([(1, 0.3), (2, 0.31), (3, None)], "i int, confidence double")
    assert [r.i for r in filters.min_confidence(df).collect()] == [2]
    numbers = spark.createDataFrame([(1,), (5,), (None,)], "n int")
    assert sorted(r.n or 0 for r in filters.episode_range(numbers, "n", start=2).collect()) == [0, 5]
    inputs = spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")
    outputs = spark.createDataFrame([("a", "txt"), ("b", "txt"), ("b", "json")], "stem string, kind string")
    assert sorted(r.stem for r in lookups.skip_processed(inputs, outputs).collect()) == ["c"]
    assert sorted(r.stem for r in lookups.skip_processed(inputs, outputs, 2).collect()) == ["a", "c"]
    assert lookups.skip_processed(inputs, outputs, overwrite=True).count() == 3
