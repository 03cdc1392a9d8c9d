"""Quality rules against brute force and held-out labels."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import quality
from colloquy.llm.queries import QUERIES
from tests.llm.conftest import ODD_TEXTS


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), failed,
    )


def base(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_query(spark, sf, texts):
    rows = QUERIES["op1_quality_rules"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert base(r) == plain_base(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.probability >= 0.5)


def test_odd_rows_without_a_model(odd, empty):
    rows = quality.apply_rules(odd, None, keep=["lang", "kept"]).collect()
    want = sorted(((i, *plain_base(t)) for i, t in ODD_TEXTS), key=repr)
    assert sorted(((r.doc_id, *base(r)) for r in rows), key=repr) == want
    assert all(r.kept == (not r.base_failed) and r.probability is None and r.in_kept == "clash" for r in rows)
    assert quality.apply_rules(empty, None).count() == 0


@pytest.mark.parametrize("block", [1, 50, 1000])
def test_blocks_give_what_whole_texts_give(monkeypatch, texts, block):
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=2 * quality.BUCKETS), 0.1, 1.0, 0.0)
    every = [*texts.values(), "a b " * 500, "x" * 3000, "", " ", " a  bc d ", "\n\n" * 40 + "end"]
    every = every[-60:] if block == 1 else every
    want = list(quality.judged(every, model))
    shares = [quality.shares(t) for t in every]
    monkeypatch.setattr(quality, "BLOCK", block)
    got = list(quality.judged(every, model))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for text, g, w, (where, share) in zip(every, got, want, shares):
        assert g[2] == pytest.approx(w[2], abs=1e-9)
        now = quality.shares(text)
        assert np.array_equal(now[0], where) and np.array_equal(now[1], share)


def test_scores_are_means_of_weights(texts):
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=2 * quality.BUCKETS), 0.3, 2.0, 1.0)
    for text, (_, _, score) in zip(texts.values(), quality.judged(list(texts.values()), model)):
        where, share = quality.shares(text)
        assert score == pytest.approx(0.3 + float(model.weights[where] @ share), abs=1e-5)


def test_sample_has_its_bound_and_the_worst_label(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i}") for i in range(500)] + [(8, "x" * 99)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 9, i % 2) for i in range(50)] + [(None, 1)], "doc_id long, quality int")
    sample = quality.labelled_sample(docs, labels, 20, 50, "doc_id", "text", "quality").collect()
    assert len(sample) == 20 and {r.label for r in sample} == {0} and max(len(r.text) for r in sample) <= 50


def test_held_out_accuracy_and_calibration(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, max_rows=1500)
    seen = labels.selectExpr("doc_id").orderBy("doc_id").sample(0.3, 1)
    rows = quality.apply_rules(docs.join(seen, "doc_id"), model).join(labels.select("doc_id", "quality"), "doc_id").collect()
    right = sum(r.kept == (r.quality == 1) for r in rows) / len(rows)
    judged = [r for r in rows if not r.base_failed]
    assert right >= 0.97
    # the classifier by itself: next to no good text lost, next to no poor one kept
    assert sum(r.kept != (r.quality == 1) for r in judged) <= 0.005 * len(judged)


def test_without_both_classes_there_is_no_model(spark, docs):
    assert quality.train(docs, spark.createDataFrame([], "doc_id long, quality int")) is None
    ones = docs.selectExpr("doc_id", "1 AS quality")
    assert quality.train(docs, ones) is None


def test_fit_separates_and_calibrates():
    rnd = random.Random(1)
    texts, labels = [], []
    for _ in range(500):
        good = rnd.random() < 0.7
        texts.append(" ".join(rnd.choice(["tree", "river", "stone"] if good else ["win$$$", "cash!!!", "now***"]) for _ in range(20)))
        labels.append(int(good if rnd.random() < 0.95 else not good))
    model = quality.fit(np.array(labels[:400]), [quality.shares(t) for t in texts[:400]])
    p = np.array([model.probability(np.float64(s[2])) for s in quality.judged(texts[400:], model)])
    good = np.array(["$" not in t and "!" not in t and "*" not in t for t in texts[400:]])
    assert ((p >= 0.5) == good).mean() >= 0.95
    assert abs(p.mean() - np.mean(labels[400:])) < 0.1


def test_calibration_of_scores_that_separate_the_classes():
    rng = np.random.default_rng(1)
    for gap in (0.1, 1.0, 8.0, 100.0):
        y = (rng.random(900) < 0.88).astype(float)
        score = np.where(y > 0, gap, -gap) + rng.normal(0, gap / 20, 900) + 3
        slope, offset = quality.calibrated(score, y)
        p = 1 / (1 + np.exp(-(slope * score + offset)))
        assert slope > 0 and ((p >= 0.5) == (y == 1)).all()
        assert p[y == 1].min() > 0.9 and p[y == 0].max() < 0.1
    score = rng.normal(0, 1, 5000)
    y = (rng.random(5000) < 1 / (1 + np.exp(-(1.5 * score - 0.5)))).astype(float)
    slope, offset = quality.calibrated(score, y)
    assert abs(slope - 1.5) < 0.2 and abs(offset + 0.5) < 0.2
