"""Readers on files as they come, writers in the one-folder-per-episode layout, plans and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from colloquy.operators import asrstats, stats, textops
from colloquy.plans import views
from colloquy.sources import readers, writers
from colloquy.streaming import live


def _write(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    body = content if isinstance(content, (bytes, str)) else json.dumps(content)
    (folder / name).write_bytes(body if isinstance(body, bytes) else body.encode())


def test_captions(spark, tmp_path):
    _write(tmp_path, "ep001_raw.json", [{"text": " a "}, {"text": ""}, {"start": 1.0}, {"text": "b", "duration": 2}])
    _write(tmp_path, "ep002_raw.json", "not json")
    _write(tmp_path, "ep 3 + 50%_raw.json", [{"text": "c"}])
    got = readers.read_captions(spark, str(tmp_path)).orderBy("episode_id", "item_idx").collect()
    assert [tuple(r) for r in got] == [("ep 3 + 50%", 0, "c"), ("ep001", 0, "a"), ("ep001", 3, "b")]


def test_asr_documents(spark, tmp_path):
    words = [{"word": "hi", "punctuated_word": "Hi,", "start": 0.1, "end": 0.3, "speaker": 1}, {"word": "x", "start": 0.5}]
    doc = {
        "results": {
            "utterances": [{"start": 1.5, "transcript": " hey ", "speaker": 1}, {"transcript": ""}, {"transcript": "t", "end": 2}],
            "channels": [{"alternatives": [{"transcript": "hey t", "words": words}]}],
        }
    }
    _write(tmp_path, "e1.deepgram.json", doc)
    _write(tmp_path, "e2.deepgram.json", {"results": {"channels": []}})
    path = str(tmp_path)
    utterances = readers.read_asr_utterances(spark, path).orderBy("seg_idx").collect()
    assert [(r.episode_id, r.seg_idx, r.start_ms, r.end_ms, r.speaker_id, r.text) for r in utterances] == [
        ("e1", 0, 1500, 1500, 1, "hey"), ("e1", 2, 0, 2000, 0, "t"),
    ]
    assert readers.read_asr_utterances(spark, path, keep_empty=True).count() == 3
    tokens = readers.read_asr_words(spark, path).orderBy("word_idx").collect()
    assert [(r.word_idx, r.start_ms, r.end_ms, r.speaker, r.token) for r in tokens] == [(0, 100, 300, 1, "Hi,"), (1, 500, None, None, "x")]
    best = {r.episode_id: r.transcript for r in readers.read_best_transcript(spark, path).collect()}
    assert best == {"e1": "hey t", "e2": ""}


def test_any_document(spark, tmp_path):
    sentence = {"segments": [{"speaker_id": 0, "start": 1, "end": 2, "transcript": "s"}]}
    words = [{"word": f"w{i}", "start": i, "end": i + 1, "speaker": 0} for i in range(14)]
    asr = {"results": {"channels": [{"alternatives": [{"words": words}]}]}}
    _write(tmp_path, "a.sentences.json", sentence)
    _write(tmp_path, "b.deepgram.json", asr)
    _write(tmp_path, "c.json", asr)
    _write(tmp_path, "d.json", {"other": 1})
    got = readers.read_any(spark, str(tmp_path)).groupBy("episode_id").count().collect()
    assert {r.episode_id: r["count"] for r in got} == {"a": 1, "b": 2, "c": 2}
    raw = readers.raw_documents(spark, str(tmp_path))
    assert [r.name for r in readers.unreadable_from(raw).collect()] == ["d.json"]


def test_text_and_lists(spark, tmp_path):
    _write(tmp_path / "t", "a.txt", b"one\r\n\xff two\n\nthree")
    _write(tmp_path / "t", "skip.json", "{}")
    docs = readers.read_documents(spark, str(tmp_path / "t")).collect()
    assert [r.episode for r in docs] == ["a.txt"] and "� two" in docs[0].text
    lines = readers.read_transcript_lines(spark, str(tmp_path / "t")).orderBy("line_idx").collect()
    assert [r.line for r in lines] == ["one", "� two", "", "three"]
    _write(tmp_path / "u", "list.txt", "# c\nu1\n\n u2 \nu3\n")
    urls = readers.read_url_list(spark, str(tmp_path / "u"), start=2, end=2, skip_comments=True).collect()
    assert [(r.number, r.url) for r in urls] == [(2, "u2")]


def test_list_media(spark, tmp_path):
    for name in ("x/b.WAV", "a.mp3", "c.txt"):
        _write((tmp_path / name).parent, (tmp_path / name).name, "data")
    got = [(r.stem, r.ext, r.length) for r in readers.list_media(spark, str(tmp_path)).collect()]
    assert got == [("a", ".mp3", 4), ("b", ".wav", 4)]
    assert readers.list_media(spark, str(tmp_path), recursive=False).count() == 1


def test_transcript_files(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "PART_BITS", 1)
    segments = views.segments(spark, sf)
    writers.write_transcript_text(segments, str(tmp_path / "out"), layout="files")
    back = (
        spark.read.text(str(tmp_path / "out"), wholetext=True)
        .groupBy("episode_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "value"))), lambda x: x["value"]), "").alias("t"))
    )
    got = {r.episode_id: r.t for r in back.collect()}
    want = {}
    for r in writers.transcript_lines(segments).orderBy("episode_id", "seg_idx").collect():
        want[r.episode_id] = want.get(r.episode_id, "") + r.line + "\n"
    assert got == want


def test_parts_keep_positions(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 2, "c\nd"), (1, 0, 0, "a\nb")], "episode_id bigint, x int, offset bigint, value string")
    raw = rows.selectExpr("'f' AS name", "CAST(episode_id AS string) episode_id", "offset", "value")
    raw.write.parquet(str(tmp_path / "raw"))
    got = readers.read_transcript_lines(spark, str(tmp_path / "raw"), layout="table").orderBy("line_idx").collect()
    assert [(r.line_idx, r.line) for r in got] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_stream_equals_batch_over_several_batches(spark, sf, tmp_path):
    words = views.words(spark, sf).filter("speaker IS NOT NULL").select("episode_id", "word_idx", "speaker", "start_ms", "end_ms", "token")
    feed = str(tmp_path / "feed")
    # three files in word order, so that segments stay open between batches
    bounds = words.selectExpr("percentile_approx(word_idx, array(0.33, 0.66))").first()[0]
    cuts = [f"word_idx <= {bounds[0]}", f"word_idx > {bounds[0]} AND word_idx <= {bounds[1]}", f"word_idx > {bounds[1]}"]
    for cut in cuts:
        words.filter(cut).coalesce(1).write.mode("append").parquet(feed)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    live.keep_gap_segments(live.file_stream(spark, feed, words.schema, max_files=1), out, checkpoint)
    assert len(list((tmp_path / "out" / "closed").glob("batch=*"))) == 3
    from colloquy.operators.sequences import words_to_segments

    got = live.all_gap_segments(spark, out)
    want = words_to_segments(words).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 0


def test_stream_of_words_with_speaker_names(spark, tmp_path):
    schema = "episode_id bigint, word_idx bigint, speaker string, start_ms bigint, end_ms bigint, token string"
    rows = [(1, 0, "A", 0, 100, "a"), (1, 1, "A", 200, 300, "b"), (1, 2, "B", 300, 400, "c")]
    feed = str(tmp_path / "feed")
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(feed)
    words = spark.read.parquet(feed).schema
    live.keep_gap_segments(live.file_stream(spark, feed, words, max_files=1), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = live.all_gap_segments(spark, str(tmp_path / "out")).orderBy("head_idx").collect()
    assert [(r.speaker, r.text) for r in got] == [("A", "a b"), ("B", "c")]


def test_statistics_of_a_stream_in_batches(spark, sf, tmp_path):
    segments = views.segments(spark, sf)
    feed = str(tmp_path / "feed")
    for k in range(2):
        segments.filter(f"seg_idx % 2 = {k}").coalesce(1).write.mode("append").parquet(feed)
    out = str(tmp_path / "out")
    live.keep_speaker_stats(live.file_stream(spark, feed, segments.schema, max_files=1), out, str(tmp_path / "cp"))
    want = stats.speaker_stats(segments)
    got = live.latest_speaker_stats(spark, out).select(want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_speaker_stats_without_state(spark, tmp_path):
    """Eleven batches of the same speakers: merged in threes, run again after a lost commit, equal to one batch."""
    rng = random.Random(8)
    schema = "episode_id bigint, speaker string, start_ms bigint, end_ms bigint, text string"
    rows = [
        (rng.choice([1, 2, None]), rng.choice(["a", "b", None]), at, rng.choice([None, at - 5, at + rng.randint(0, 9999)]), rng.choice(["", None, "so be it?", "yes no"]))
        for at in range(0, 220_000, 1000)
    ]
    feed, out, checkpoint = (str(tmp_path / n) for n in ("feed", "out", "cp"))

    def run():
        return live.keep_speaker_stats(live.file_stream(spark, feed, schema, max_files=1), out, checkpoint, fan=3)

    def check(held, folders):
        want = stats.speaker_stats(spark.createDataFrame(held, schema))
        got = live.latest_speaker_stats(spark, out).select(want.columns)
        assert got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        assert live._ranges(spark, out) == folders

    with pytest.raises(FileNotFoundError):
        live.latest_speaker_stats(spark, out)
    for i in range(10):
        spark.createDataFrame(rows[20 * i : 20 * i + 20], schema).coalesce(1).write.mode("append").parquet(feed)
    query = run()
    assert not query.recentProgress[-1].stateOperators
    check(rows[:200], [(0, 8), (9, 9)])
    for name in ("9", ".9.crc"):
        (tmp_path / "cp" / "commits" / name).unlink()
    run()
    check(rows[:200], [(0, 8), (9, 9)])
    spark.createDataFrame(rows[200:], schema).coalesce(1).write.mode("append").parquet(feed)
    run()
    check(rows, [(0, 8), (9, 9), (10, 10)])


def test_long_episodes_are_counted_whole(spark, tmp_path):
    rows = spark.range(5000).selectExpr("1L episode_id", "id seg_idx", "0 speaker_id", "id start_ms", "id + 1 end_ms", "'x' text")
    writers.write_sentence_json(rows, rows, str(tmp_path / "docs"))
    docs = spark.read.json(str(tmp_path / "docs")).collect()
    assert sorted((r.part, r.num_segments, r.n_parts, len(r.segments)) for r in docs) == [(0, 5000, 2, 4096), (1, 5000, 2, 904)]


def test_failing_chunks_cost_no_others(spark):
    docs = spark.createDataFrame([(i, f"अ {'bad' if i == 3 else 'good'} {i}") for i in range(8)], "doc_id bigint, text string")

    def provider():
        def translate(chunks):
            if chunks.str.contains("bad").any():
                raise ValueError("no")
            return chunks.str.upper()

        return translate

    got = {r.doc_id: r for r in textops.translate_documents(docs.coalesce(1), provider).collect()}
    assert [got[i].n_fallback for i in range(8)] == [0, 0, 0, 1, 0, 0, 0, 0]
    assert got[3].errors == ["ValueError: no"] and got[3].text == "अ bad 3" and got[4].text == "अ GOOD 4"


def test_response_without_any_list_has_no_segments(spark):
    raw = spark.createDataFrame(
        [("ep1", "1", 0, '{"results": {}}'), ("ep2", "2", 0, '{"results": {"utterances": [{"start": 0, "end": 1, "transcript": " "}]}}')],
        "name string, episode_id string, offset bigint, value string",
    )
    uttered, words = readers.asr_utterances_from(raw, keep_empty=True), readers.asr_words_from(raw)
    assert asrstats.response_segments(uttered, words).count() == 0
    found = asrstats.response_statistics(uttered, words).collect()
    assert [(r.episode_id, r.num_sentences, r.total_words) for r in found] == [("2", 1, 0)]


@pytest.mark.parametrize("name", ["j01_assign_speaker", "j02_gender_overlap", "seq01_words_to_segments", "rl11_labeled_transcript"])
def test_no_nested_loop_or_cross_join(spark, sf, name):
    plan = queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_one_exchange_for_speaker_stats(spark, sf):
    plan = queries()["ag01_speaker_stats"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_top_k_is_limited_before_the_shuffle(spark, sf):
    plan = queries()["tk04_first_n_per_speaker_then_m"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def _spoken_words(rng, episode, n):
    """Words of an episode in order of their start, with pauses about the gap."""
    rows, at = [], 1_700_000_000_000
    for i in range(n):
        at += rng.choice([0, 200, 700, 799, 800, 801, 900, 3000])
        rows.append((episode, i, rng.choice(["0", "0", "1"]), at, at + rng.choice([0, 100, 300]), f"w{i}"))
    return rows


def _plain_segments(rows, gap=800):
    out = []
    for e, i, speaker, start, end, token in sorted(rows, key=lambda r: (repr(r[0]), r[3], r[1])):
        last = out[-1] if out else None
        if last and last[0] == e and last[2] == speaker and start - last[4] <= gap:
            out[-1] = (*last[:4], end, last[5] + " " + token)
        else:
            out.append((e, i, speaker, start, end, token))
    return sorted(out, key=repr)


def test_late_words_and_an_empty_state(spark, tmp_path):
    """Words up to a minute late, three batches and the end of the feed: every segment once, and no state left."""
    rng = random.Random(5)
    rows = [(*r[:1], r[1] + 2**60, *r[2:]) for e in (1, 2, 3, 4, 5, None) for r in _spoken_words(rng, e, 120)]
    schema = "episode_id bigint, word_idx bigint, speaker string, start_ms bigint, end_ms bigint, token string"
    order = sorted(rows, key=lambda r: r[3] + rng.randint(0, 50_000))
    feed, out, checkpoint = (str(tmp_path / n) for n in ("feed", "out", "cp"))
    cut = len(order) // 3
    batches = [order[:cut], order[cut : 2 * cut], order[2 * cut :], [(None, None, None, 1_900_000_000_000, None, None)]]
    sizes = []
    for i, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, schema).withColumn("ts", F.timestamp_millis("start_ms"))
        frame.coalesce(1).write.mode("append").parquet(feed)
        words = live.file_stream(spark, feed, frame.schema, max_files=1)
        query = live.append_available(live.gap_segments(words), out, checkpoint)
        sizes.append(query.recentProgress[-1].stateOperators[0].numRowsTotal)
    got = spark.read.option("recursiveFileLookup", True).parquet(out)
    assert sorted((tuple(r[c] for c in ("episode_id", "head_idx", "speaker", "start_ms", "end_ms", "text")) for r in got.collect()), key=repr) == _plain_segments(rows)
    assert sizes[0] > 0 and sizes[-1] == 0
