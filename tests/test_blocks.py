"""Block-wise ordered operators against plain windows and row-by-row models, with tiny blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import blocks, folds, sequences
from colloquy.operators import sequences as seq_module

LABELS = ["A", "B", "C"]


def _episodes(seed, episodes=3, size=60, labels=2):
    rng = random.Random(seed)
    rows = []
    for e in range(episodes):
        idx = 0
        clock = 0
        for _ in range(rng.randint(1, size)):
            idx += rng.choice([1, 1, 1, 5, 40])
            clock += rng.choice([0, 100, 700, 800, 801, 2000])
            end = clock + rng.choice([0, 100, 400, 1500])
            rows.append((e, idx, rng.choice(LABELS[:labels]), clock, end))
            clock = max(0, end + rng.choice([-200, 0, 800, 801]))
    return rows


def _frame(spark, rows, order="idx"):
    return spark.createDataFrame(rows, f"episode_id bigint, {order} bigint, speaker string, start_ms bigint, end_ms bigint")


@pytest.mark.parametrize("bits", [(1,), (3,), (2, 2), (1, 1, 1), (16,)])
def test_running_equals_plain_window(spark, bits):
    df = _frame(spark, _episodes(1))
    runs = [
        blocks.Run("total", "sum", F.col("start_ms")),
        blocks.Run("before", "sum", F.lit(1), True),
        blocks.Run("high", "max", F.col("end_ms")),
        blocks.Run("low", "min", F.col("end_ms"), True),
    ]
    got = blocks.with_running(df, ["episode_id"], "idx", runs, bits)
    w = Window.partitionBy("episode_id").orderBy("idx")
    upto, below = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumns(
        {
            "total": F.sum("start_ms").over(upto), "before": F.coalesce(F.sum(F.lit(1)).over(below), F.lit(0)),
            "high": F.max("end_ms").over(upto), "low": F.min("end_ms").over(below),
        }
    )
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("bits", [(1,), (3,), (16,)])
def test_previous_and_row_number(spark, bits):
    df = _frame(spark, _episodes(2))
    w = Window.partitionBy("episode_id").orderBy("idx")
    got = blocks.with_previous(df, ["episode_id"], "idx", ["speaker", "end_ms"], "p", bits)
    got = blocks.with_row_number(got, ["episode_id"], "idx", "rn", bits).select("episode_id", "idx", "p.speaker", "p.end_ms", "rn")
    want = df.select(
        "episode_id", "idx", F.lag("speaker").over(w).alias("speaker"), F.lag("end_ms").over(w).alias("end_ms"),
        F.row_number().over(w).alias("rn"),
    )
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_rank_with_crowded_value(spark):
    rng = random.Random(3)
    rows = [(1, i, "A", 0 if rng.random() < 0.5 else rng.randint(0, 50), 0) for i in range(200)]
    df = _frame(spark, rows)
    got = blocks.with_rank(df, ["episode_id"], "start_ms", "idx", "rn", (2,), (3,)).select("idx", "rn")
    order = sorted(rows, key=lambda r: (r[3], r[1]))
    assert sorted(map(tuple, got.collect())) == sorted((r[1], i + 1) for i, r in enumerate(order))


def test_order_statistics(spark):
    rng = random.Random(4)
    values = {k: [rng.randint(-9, 9) for _ in range(n)] for k, n in ((1, 1), (2, 2), (3, 4), (4, 33))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k bigint, v bigint")
    n = F.col("n")
    at = {"lo": F.floor(n / 4).cast("bigint"), "mid": F.floor(n / 2).cast("bigint"), "hi": F.floor(n * 3 / 4).cast("bigint")}
    got = blocks.order_statistics(df, ["k"], "v", at, (2,)).select("k", "n", "lo", "mid", "hi").collect()
    want = []
    for k, vs in values.items():
        s, c = sorted(vs), len(vs)
        want.append((k, c, s[c // 4], s[c // 2], s[3 * c // 4]))
    assert sorted(map(tuple, got)) == want


def _segments_model(words, gap=800):
    out = []
    for e in sorted({w[0] for w in words}):
        open_segment, last_end = None, None
        for _, idx, spk, start, end in sorted(w for w in words if w[0] == e):
            if open_segment and spk == open_segment[1] and start - last_end <= gap:
                open_segment[3] = end
                open_segment[4].append(f"t{idx}")
            else:
                if open_segment:
                    out.append((e, *open_segment))
                open_segment = [idx, spk, start, end, [f"t{idx}"]]
            last_end = end
        if open_segment:
            out.append((e, *open_segment))
    return sorted((e, i, s, a, b, " ".join(t)) for e, i, s, a, b, t in out)


@pytest.mark.parametrize("bits", [(1,), (2,), (4,), (38,)])
@pytest.mark.parametrize("seed", [5, 6, 7])
def test_words_to_segments(spark, monkeypatch, bits, seed):
    monkeypatch.setattr(seq_module, "WORD_BITS", bits)
    rows = _episodes(seed, labels=2)
    df = _frame(spark, rows, "word_idx").withColumn("token", F.concat(F.lit("t"), "word_idx"))
    got = sequences.words_to_segments(df).select("episode_id", "head_idx", "speaker", "start_ms", "end_ms", "text")
    assert sorted(map(tuple, got.collect())) == _segments_model(rows)


def test_words_without_keys_do_not_break_the_chain(spark):
    rows = [(1, 1, "A", 0, 100), (1, 2, None, 200, 300), (1, 3, "A", 900, 1000), (1, 4, "A", 1801, 1900)]
    df = _frame(spark, rows, "word_idx").withColumn("token", F.concat(F.lit("t"), "word_idx"))
    got = sequences.words_to_segments(df).select("head_idx", "text").orderBy("head_idx").collect()
    # the pause of exactly 800 ms stays together, 801 ms splits
    assert [tuple(r) for r in got] == [(1, "t1 t3"), (4, "t4")]


def test_merge_short_turns(spark):
    rows = [(1, 1, "A", 0, 100), (1, 2, "B", 100, 250), (1, 3, "B", 300, 900), (1, 4, "A", 900, 950), (1, 5, "B", 940, 945)]
    got = sequences.merge_short_turns(_frame(spark, rows, "turn_idx"), 300).orderBy("turn_idx").collect()
    assert [(r.turn_idx, r.speaker, r.start_ms, r.end_ms, r.n_merged) for r in got] == [
        (1, "A", 0, 250, 2), (3, "B", 300, 945, 3),
    ]


def _smooth_model(labels, k=3, share=0.75):
    done = list(labels)
    for i in range(1, len(done) - 1):
        near = [done[j] for j in range(max(0, i - k), min(len(done), i + k + 1)) if j != i]
        best = max(dict.fromkeys(near), key=near.count)
        if best != done[i] and near.count(best) >= len(near) * share:
            done[i] = best
    return done


def _flicker_model(labels):
    done = []
    for i, label in enumerate(labels):
        if i > 1 and label != done[-1] and done[-1] != done[-2] and label == done[-2]:
            label = done[-1]
        done.append(label)
    return done


@pytest.mark.parametrize("labels", [2, 3])
@pytest.mark.parametrize("block", [4, 7, 64, 65536])
@pytest.mark.parametrize(
    "operator, model, order",
    [(folds.smooth_turns, _smooth_model, "turn_idx"), (folds.fix_flicker, _flicker_model, "seg_idx")],
)
def test_folds(spark, operator, model, order, block, labels):
    rows = _episodes(11 + labels, episodes=6, size=120, labels=labels)
    # an alternating episode never settles early
    rows += [(99, i, LABELS[i % 2], i, i + 1) for i in range(50)]
    got = operator(_frame(spark, rows, order), out="new", block=block).collect()
    for e in {r[0] for r in rows}:
        raw = [r[2] for r in sorted(x for x in rows if x[0] == e)]
        new = [r["new"] for r in sorted((x for x in got if x.episode_id == e), key=lambda x: x[order])]
        assert new == model(raw)


def test_rules_skip_only_rows_that_cannot_change():
    """Both rules over many short episodes at once, of every degree of unrest, against the plain loops."""
    rng = random.Random(1)
    for _ in range(400):
        k, share, calm = rng.randint(1, 4), rng.choice([0.4, 0.5, 0.6, 0.75, 1.0]), rng.random()
        episodes = []
        for _ in range(rng.randint(1, 4)):
            raw = [0]
            for _ in range(rng.randint(0, 30)):
                raw.append(raw[-1] if rng.random() < calm else rng.randrange(4))
            episodes.append(raw)
        sizes = [len(e) for e in episodes]
        rows = folds._Rows(
            np.concatenate(episodes), np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes]),
            np.repeat(sizes, sizes), np.zeros(sum(sizes), bool),
        )
        assert folds._smooth(rows, k, share).tolist() == sum((_smooth_model(e, k, share) for e in episodes), [])
        assert folds._unflicker(rows).tolist() == sum((_flicker_model(e) for e in episodes), [])


def test_labels_may_hold_any_text(spark):
    """Separators and control characters inside labels, across blocks, are no special values."""
    names = ["\x1f", "a\x1fb", "\x00", None, '"', "a", "b"]
    rng = random.Random(4)
    rows = [(e, i, rng.choice(names[e : e + 3]), i, i + 1) for e in range(5) for i in range(60)]
    for operator, model, order in ((folds.smooth_turns, _smooth_model, "turn_idx"), (folds.fix_flicker, _flicker_model, "seg_idx")):
        got = operator(_frame(spark, rows, order), out="new", block=4).collect()
        for e in range(5):
            new = [r["new"] for r in sorted((x for x in got if x.episode_id == e), key=lambda x: x[order])]
            assert new == model([r[2] for r in rows if r[0] == e])


def test_flicker_example(spark):
    rows = [(1, i, s, i, i + 1) for i, s in enumerate("ABAA")]
    got = folds.fix_flicker(_frame(spark, rows, "seg_idx"), out="new").orderBy("seg_idx").collect()
    assert "".join(r["new"] for r in got) == "ABBA"


def test_even_sample_and_adaptive_gap(spark):
    rows = [(1, i, "A", i * 1000, i * 1000 + 100 * (i % 4)) for i in range(25)] + [(2, 0, "A", 0, 5)]
    df = _frame(spark, rows, "seg_idx")
    picked = sorted(r.seg_idx for r in sequences.even_sample(df, 10).filter("episode_id = 1").collect())
    assert picked == [int(i * 24 / 9) for i in range(10)]
    gaps = sorted(rows[i][3] - rows[i - 1][4] for i in range(1, 25))
    n = len(gaps)
    want = max(300, gaps[n // 2] + 0.5 * (gaps[3 * n // 4] - gaps[n // 4])) / 1000
    got = {r.episode_id: r.gap_s for r in sequences.adaptive_gap(df).collect()}
    assert got == {1: want, 2: 0.8}
