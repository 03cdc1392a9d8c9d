"""NULL keys and labels at every size, and interval joins whose cost has a bound."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from colloquy.operators import asrstats, blocks, folds, intervals, lookups, ranking, roles, sequences, setops, stats
from colloquy.sources import writers

SCHEMA = "episode_id bigint, idx bigint, speaker string, start_ms bigint, end_ms bigint"
LABELS = ["A", "B", None]


def _rows(seed, size=150):
    rng = random.Random(seed)
    return [(e, i, rng.choice(LABELS), i * 10, i * 10 + rng.randint(1, 30)) for e in (1, 2, None) for i in range(rng.randint(2, size))]


@pytest.mark.parametrize("bits", [(2,), (1, 2), (16,)])
def test_running_values_of_null_keys(spark, bits):
    rows = _rows(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = blocks.with_row_number(df, ["episode_id", "speaker"], "idx", "rn", bits).collect()
    want = []
    for r in rows:
        want.append((*r, sum(1 for x in rows if x[0] == r[0] and x[2] == r[2] and x[1] <= r[1])))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def _smooth(labels, k=3, share=0.75):
    done = list(labels)
    for i in range(1, len(done) - 1):
        near = [done[j] for j in range(max(0, i - k), min(len(done), i + k + 1)) if j != i]
        best = max(dict.fromkeys(near), key=near.count)
        if best != done[i] and near.count(best) >= len(near) * share:
            done[i] = best
    return done


def _unflicker(labels):
    done = list(labels)
    for i in range(2, len(done)):
        if done[i] == done[i - 2] and done[i] != done[i - 1]:
            done[i] = done[i - 1]
    return done


@pytest.mark.parametrize("block", [4, 7, 64, 65536])
@pytest.mark.parametrize(
    "operator, model, order", [(folds.smooth_turns, _smooth, "turn_idx"), (folds.fix_flicker, _unflicker, "seg_idx")]
)
def test_folds_with_null_labels(spark, operator, model, order, block):
    rows = _rows(2)
    df = spark.createDataFrame(rows, SCHEMA.replace("idx", order, 1))
    got = operator(df, out="new", block=block).collect()
    assert len(got) == len(rows)
    for e in (1, 2, None):
        new = [r["new"] for r in sorted((r for r in got if r.episode_id == e), key=lambda r: r[order])]
        assert new == model([r[2] for r in sorted(x for x in rows if x[0] == e) if r[0] == e] if e else [r[2] for r in rows if r[0] is None])


def test_samples_and_medians_keep_null_speakers(spark):
    rows = _rows(3)
    df = spark.createDataFrame(rows, SCHEMA.replace("idx", "seg_idx", 1)).withColumn("text", F.lit("a b"))
    groups = {(r[0], r[2]) for r in rows}
    picked = sequences.even_sample(df, 4).groupBy("episode_id", "speaker").count().collect()
    assert {(r.episode_id, r.speaker): r["count"] for r in picked} == {
        g: min(4, sum(1 for r in rows if (r[0], r[2]) == g)) for g in groups
    }
    assert {(r.episode_id, r.speaker) for r in stats.summarize_median(df).collect()} == groups


def test_words_of_a_null_episode_join_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(sequences, "WORD_BITS", (1,))
    rows = [(None, i, "A", i * 100, i * 100 + 50) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA.replace("idx", "word_idx", 1)).withColumn("token", F.lit("t"))
    assert [r.n_tokens for r in sequences.words_to_segments(df).collect()] == [9]


def _spoken(spark):
    """Eight segments of two speakers in episode 1 and in the NULL episode."""
    texts = ["Welcome back to the show.", "Thanks for having me.", "What do you think?", "I think so."] * 2
    rows = [
        (e, i, f"Speaker {i % 2 + 1}", i % 2, f"S{i % 2}", text, i * 1000, i * 1000 + 900 - 300 * (i % 2), 0.5, f"line {i}")
        for e in (1, None) for i, text in enumerate(texts)
    ]
    return spark.createDataFrame(
        rows, "episode_id bigint, seg_idx bigint, speaker string, speaker_id int, speaker_raw string, text string, start_ms bigint, "
        "end_ms bigint, confidence double, line string",
    )


def _hosts(df):
    return df.select("episode_id").distinct().withColumns({"host": F.lit("Speaker 1"), "method": F.lit("m")})


def _reply(text):
    return lambda s: s.select("episode_id").distinct().withColumn("reply", F.lit(text))


MODEL = '{"choices": [{"message": {"content": "{\\"host_speaker_raw\\": \\"Speaker 2\\"}"}}]}'
PAIR = '{"host_speaker": "Speaker 2", "guest_speaker": "Speaker 1"}'
# What each operator gives for the NULL episode has to be what it gives for episode 1.
OF_EPISODES = {
    "RL01": roles.classify_segments,
    "RL02": roles.identify_host_keywords_first,
    "RL03": roles.identify_host_questions_first,
    "RL04": roles.identify_host_dominance,
    "RL05": lambda s: roles.map_roles(s.withColumn("turn_idx", F.col("seg_idx")), s),
    "RL06": roles.host_by_time,
    "RL07": roles.host_by_score,
    "RL08": lambda s: roles.resolve_roles(s.select("episode_id").distinct().withColumn("response", F.lit(MODEL)), s),
    "RL09": lambda s: roles.roles_from_pair_reply(_reply(PAIR)(s), s),
    "RL10": lambda s: roles.label_provenance(roles.identify_host_dominance(s)),
    "TK01": lambda s: ranking.speaker_mapping(s.withColumn("turn_idx", F.col("seg_idx"))),
    "TK02": ranking.consolidate_speakers,
    "TK03": ranking.first_n_per_speaker,
    "TK05": lambda s: ranking.head_tail_sample(s, 4),
    "TK06": lambda s: ranking.head_mid_tail_lines(s.withColumn("line_idx", F.col("seg_idx"))),
    "TK11": ranking.top_speakers,
    "J04": lambda s: lookups.map_speakers(
        s, s.select("episode_id", F.col("speaker_raw").alias("speaker"), F.lit("named").alias("label")).distinct()
    ),
    "J05": lambda s: lookups.apply_gender(
        s.drop("confidence"), s.select("episode_id", "speaker", F.lit("female").alias("gender"), F.lit(0.5).alias("confidence")).distinct()
    ),
    "J06": lambda s: lookups.apply_host(s, _hosts(s), ["method"]),
    "J07": lambda s: lookups.apply_model_labels(
        s, s.select("episode_id").distinct().selectExpr("*", "map('0', 'HOST') mapping", "map('0', 'r') reasoning_brief", "map('0', 0.9D) confidence")
    ),
    "J08": lambda s: lookups.keep_top_speakers(s, ranking.top_speakers(s, 1)),
    "J11": lambda s: lookups.accept_candidate(s.select("episode_id", "speaker").distinct(), s),
    "SET05": lambda s: setops.intersection(s, s, ["episode_id", "speaker"]),
    "AG01": stats.speaker_stats,
    "AG03": stats.two_grain_stats,
    "SNK02": lambda s: writers.labeled_documents(
        s.withColumn("speaker_original", F.col("speaker")), roles.label_provenance(roles.identify_host_dominance(s))
    ),
    "SNK03": writers.stats_documents,
    "SNK05": lambda s: writers.sentence_documents(s, s),
}


@pytest.mark.parametrize("name", sorted(OF_EPISODES))
def test_the_null_episode_is_an_episode(spark, name):
    rows = [r.asDict(True) for r in OF_EPISODES[name](_spoken(spark)).collect()]
    found = {e: sorted(repr({k: v for k, v in r.items() if k != "episode_id"}) for r in rows if r["episode_id"] == e) for e in (1, None)}
    assert found[1] and found[1] == found[None]


def test_null_keys_are_equal_in_set_operations(spark):
    s = _spoken(spark)
    assert setops.difference(s, s, ["episode_id", "speaker"]).count() == 0
    words = s.select("episode_id", F.col("seg_idx").alias("word_idx"), "speaker", "start_ms", "end_ms", F.col("text").alias("token"))
    assert asrstats.word_segments(words, s).count() == 0
    assert asrstats.word_segments(words, s.filter("episode_id = 1")).select("episode_id").distinct().collect()[0][0] is None


def _intervals(spark, seed, n, index, far=60_000, longest=9000):
    rng = np.random.default_rng(seed)
    start = rng.integers(0, far, n)
    end = start + rng.integers(1, longest, n)
    rows = [(1 if i % 5 else None, i, f"S{rng.integers(4)}", int(a), int(b)) for i, (a, b) in enumerate(zip(start, end))]
    return rows, spark.createDataFrame(rows, SCHEMA.replace("idx", index, 1))


def _best_turn(segment, turns):
    found = [(min(segment[4], t[4]) - max(segment[3], t[3]), -t[1], t[2]) for t in turns if t[0] == segment[0]]
    found = [f for f in found if f[0] > 0]
    return max(found)[::2] if found else (0, None)


def _best_speaker(word, turns):
    sums, first = {}, {}
    for t in turns:
        ov = min(word[4], t[4]) - max(word[3], t[3])
        if t[0] == word[0] and ov > 0:
            sums[t[2]] = sums.get(t[2], 0) + ov
            first.setdefault(t[2], t[1])
    best = max(sums, key=lambda s: (sums[s], -first[s]), default=None)
    return (sums.get(best, 0), best)


def _small_stretches(monkeypatch, rows, bits=18, far=64):
    for name, value in (("STRETCH", rows), ("AT_ONCE", 3 * rows), ("BIN_BITS", bits), ("FAR", far)):
        monkeypatch.setattr(intervals, name, value)


@pytest.mark.parametrize("rows, bits, far", [(1 << 16, 18, 64), (5, 18, 64), (5, 10, 3)])
@pytest.mark.parametrize("longest", [9000, 10_000_000])
def test_sweeps_equal_pairs(spark, monkeypatch, rows, bits, far, longest):
    _small_stretches(monkeypatch, rows, bits, far)
    probes, left = _intervals(spark, 1, 150, "seg_idx", 200_000)
    turns, right = _intervals(spark, 2, 120, "turn_idx", 200_000, longest)
    got = {r.seg_idx: (r.overlap_ms, r.assigned) for r in intervals.assign_speaker(left, right, 0).collect()}
    want = {p[1]: _best_turn(p, turns) for p in probes}
    assert got == {k: (ov, spk or "Unknown") for k, (ov, spk) in want.items()}
    words = left.withColumnRenamed("seg_idx", "word_idx")
    got = {r.word_idx: (r.overlap_ms, r.assigned) for r in intervals.assign_word_speakers(words, right).collect()}
    want = {p[1]: _best_speaker(p, turns) for p in probes}
    assert got == {k: (ov, spk or "Unknown") for k, (ov, spk) in want.items()}


def test_a_crowded_minute_takes_seconds(spark):
    _, left = _intervals(spark, 3, 8000, "seg_idx")
    _, right = _intervals(spark, 4, 8000, "turn_idx")
    begin = time.perf_counter()
    assert intervals.assign_speaker(left, right).count() == 8000
    words = left.withColumnRenamed("seg_idx", "word_idx")
    assert intervals.assign_word_speakers(words, right).count() == 8000
    assert time.perf_counter() - begin < 60


def test_a_turn_without_a_sane_end_is_one_interval(spark):
    segments = spark.createDataFrame([(1, 0, "x", 5000, 6000), (1, 1, "x", 10**14, 10**14 + 500)], SCHEMA.replace("idx", "seg_idx", 1))
    turns = spark.createDataFrame([(1, 0, "A", 0, 10**15), (1, 1, "B", 5500, 7000)], SCHEMA.replace("idx", "turn_idx", 1))
    got = intervals.assign_speaker(segments, turns).orderBy("seg_idx").collect()
    assert [(r.assigned, r.overlap_ms) for r in got] == [("A", 1000), ("A", 500)]


def _both_joins(spark, left, right):
    words = left.withColumnRenamed("seg_idx", "word_idx")
    best = {r.seg_idx: (r.overlap_ms, r.assigned) for r in intervals.assign_speaker(left, right, 0).collect()}
    return best, {r.word_idx: (r.overlap_ms, r.assigned) for r in intervals.assign_word_speakers(words, right).collect()}


def _want(probes, turns):
    found = ({p[1]: of(p, turns) for p in probes} for of in (_best_turn, _best_speaker))
    return tuple({k: (ov, spk or "Unknown") for k, (ov, spk) in f.items()} for f in found)


def test_a_sweep_carries_only_what_is_open(spark, monkeypatch):
    """A crowded bin is walked in stretches; a task never holds the bin."""
    made = intervals._Stretch

    class Bounded(made):
        def __init__(self, rows, carried):
            assert len(rows) < 300, "a stretch holds a whole bin"
            super().__init__(rows, carried)

    _small_stretches(monkeypatch, 50)
    monkeypatch.setattr(intervals, "_Stretch", Bounded)
    probes, left = _intervals(spark, 5, 500, "seg_idx", 50_000, 2000)
    turns, right = _intervals(spark, 6, 400, "turn_idx", 50_000, 2000)
    with_rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert _both_joins(spark, left, right) == _want(probes, turns)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_rows)


@pytest.mark.parametrize("side", ["turn", "segment"])
def test_one_long_interval_goes_only_where_others_begin(spark, monkeypatch, side):
    probes, _ = _intervals(spark, 7, 300, "seg_idx", 20_000_000)
    turns, _ = _intervals(spark, 8, 300, "turn_idx", 20_000_000)
    # episode 2 has a segment and a turn, one of them without a sane end
    probes.append((2, 300, "S0", 5, 10**15 if side == "segment" else 900))
    turns.append((2, 300, "S1", 7, 10**15 if side == "turn" else 800))
    if side == "turn":
        turns.append((1, 301, "S2", 3, 10**15))
    left = spark.createDataFrame(probes, SCHEMA.replace("idx", "seg_idx", 1))
    right = spark.createDataFrame(turns, SCHEMA.replace("idx", "turn_idx", 1))
    assert _both_joins(spark, left, right) == _want(probes, turns)
    named = right.select("episode_id", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"), "speaker")
    others = left.select("episode_id", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    assert intervals._cells(named, others).count() < 3 * len(turns)


@pytest.mark.parametrize("rows", [1 << 16, 5])
def test_joins_of_intervals_of_all_lengths(spark, monkeypatch, rows):
    _small_stretches(monkeypatch, rows, far=8)
    rng = np.random.default_rng(9)
    rows = []
    for n, offset in ((130, 0), (110, 1)):
        start = rng.integers(-(10**7), 10**8, n)
        end = start + 2 ** rng.integers(4 + offset, 40, n)
        rows.append([(1 if i % 5 else None, i, f"S{rng.integers(4)}", int(a), int(b)) for i, (a, b) in enumerate(zip(start, end))])
    left, right = (spark.createDataFrame(r, SCHEMA.replace("idx", x, 1)) for r, x in zip(rows, ("seg_idx", "turn_idx")))
    assert _both_joins(spark, left, right) == _want(*rows)


# Two for each input; the last four read their input once more for totals.
SCANS = {
    "ag04_summarize_median": 2, "seq03_chunk_words": 2, "rl01_classify_segments_v5": 2, "rl11_labeled_transcript": 2,
    "rl12_diarized_to_roles": 2, "j02_gender_overlap": 4, "j03_assign_word_speakers": 3, "j01_assign_speaker": 3,
    "seq07_adaptive_gap": 3, "seq04_smooth_turns": 4,
}


@pytest.mark.parametrize("name", sorted(SCANS))
def test_scans_of_the_inputs(spark, sf, name):
    """As run: adaptive execution reuses the exchanges that plan branches share."""
    df = queries()[name](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") <= SCANS[name]
