"""Abbreviations learned from texts alone."""

import math
import re
from collections import Counter

from colloquy.operators import textops

PLANTED = ["Dr. Rao met Mr. Sen.", "We met Dr. Rao, e.g. at noon.", "Mr. Sen sat. Dr. Rao stood.", "Ask Mr. Sen e.g. now!"]
TEXTS = PLANTED * 12 + ["The men met at noon and sat. Now we ask the men who stood and sat at noon.", None, "", "Ok... now"] * 6


def brute_force(texts):
    """The same test, word by word."""
    dotted, plain = Counter(), Counter()
    for word in " ".join(t for t in texts if t).split():
        match = re.fullmatch(r"[^a-z]*([a-z]+(?:\.[a-z]+)*)(\.|[^a-z.]*)", word.lower())
        if match:
            (dotted if match[2] == "." else plain)[match[1]] += 1
    p = (sum(dotted.values()) + 1) / (sum(dotted.values()) + sum(plain.values()) + 2)
    found = set()
    for word, k in dotted.items():
        m, size = plain[word], len(word.replace(".", ""))
        ratio = 2 * (k * math.log(0.99) + m * math.log(0.01) - k * math.log(p) - m * math.log(1 - p))
        if ratio * math.exp(-size) * (1 + word.count(".")) * size**-m >= 0.3:
            found.add((word, k, m))
    return found


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_planted_abbreviations_are_found(spark):
    got = {tuple(r) for r in textops.learn_abbreviations(table(spark, TEXTS)).collect()}
    assert got == brute_force(TEXTS)
    found = {word for word, _, _ in got}
    assert {"dr", "mr", "e.g"} <= found and not {"sat", "noon", "stood", "ok"} & found


def test_sentences_by_learned_abbreviations(spark):
    docs = table(spark, TEXTS)
    got = textops.split_sentences(docs, abbreviations=textops.learn_abbreviations(docs))
    rows = {i: [r.sentence for r in got.where(f"doc_id = {i}").orderBy("sentence_idx").collect()] for i in (0, 2, 3, 49, 50, 51)}
    assert rows == {
        0: ["Dr. Rao met Mr. Sen."], 2: ["Mr. Sen sat.", "Dr. Rao stood."], 3: ["Ask Mr. Sen e.g. now!"],
        49: [], 50: [], 51: ["Ok...", "now"],
    }


def test_nothing_to_learn(spark):
    for texts in ([None, ""], ["no period at all"]):
        docs = table(spark, texts)
        learned = textops.learn_abbreviations(docs)
        assert learned.count() == 0
        want = [t for t in texts if t]
        assert [r.sentence for r in textops.split_sentences(docs, abbreviations=learned).collect()] == want
    empty = table(spark, TEXTS).limit(0)
    assert textops.split_sentences(empty, abbreviations=textops.learn_abbreviations(empty)).count() == 0
