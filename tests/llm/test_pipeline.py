"""The pipeline's stages against brute-force versions of their operators."""

import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from colloquy.llm import bpe, mixing, passages, quality
from colloquy.llm.runtime import ARROW_ROWS, written
from tests.llm.test_dedup import plain_components, plain_cut, plain_fingerprint
from tests.llm.test_joins import plain_join
from tests.llm.test_quality import plain_base


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_follow_their_operators(spark, sf, docs):
    kept = written(stage("quality")(spark, docs, sf), "q")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    before = rows_of(docs)
    verdicts = {}
    for key, (r, score) in zip(before, zip(before.values(), quality.judged([r.text for r in before.values()], model))):
        verdicts[key] = not plain_base(r.text)[-1] and model.probability(np.float64(score[2])) >= 0.5
    after = rows_of(kept)
    assert set(after) == {k for k, good in verdicts.items() if good}
    assert all(tuple(after[k]) == tuple(before[k]) for k in after) and kept.columns == docs.columns

    unique = written(stage("near_duplicates")(spark, kept, sf), "n")
    found = [(k, plain_fingerprint(r.text)) for k, r in after.items()]
    of_bits = [(k, after[k].text) for k in plain_components(found)]
    left = rows_of(unique)
    assert set(left) == {component for _, _, component in plain_join(of_bits)} and all(left[k] == after[k] for k in left)
    # no two that stay share 80 in a hundred of their shingles, and some went that the fingerprints kept
    assert all(k == component for k, _, component in plain_join([(k, r.text) for k, r in left.items()])) and len(left) < len(of_bits)

    cut = written(stage("passages")(spark, unique, sf), "p")
    order = sorted(left)
    texts = [left[k].text.encode() for k in order]
    got = rows_of(cut)
    assert set(got) == set(order)
    for key, text, (n, removed, _, kept_bytes) in zip(order, texts, plain_cut(texts)):
        # whole characters only: at most three bytes stay at each end of a removed span
        new = got[key].text
        assert got[key].n_chars == len(new) and (got[key].lang, got[key].source) == (left[key].lang, left[key].source)
        if not removed:
            assert new.encode() == text
        else:
            assert 0 <= len(new.encode()) - len(kept_bytes) <= 6 * plain_spans(text, kept_bytes, n)

    mix = written(stage("mix")(spark, cut, sf), "m")
    plain = mixing.mixed(cut).groupBy("doc_id").count()
    assert {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()} == {r.doc_id: r["count"] for r in plain.collect()}
    assert {r.doc_id for r in mix.collect()} == set(got) and mix.columns == corpus_pipeline.COLUMNS

    ids = stage("token_ids")(spark, mix, sf).collect()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert len(ids) == mix.count()
    for r in ids:
        want = enc.encode_ordinary(got[r.doc_id].text)
        assert (r.n_tokens, bytes(r.ids)) == (len(want), np.array(want, "<u4").tobytes())


def plain_spans(text, kept, n):
    return max(1, n // passages.WINDOW)


def test_run_applies_all_stages(spark, sf):
    first, second = ({(r.doc_id, hashlib.sha256(r.ids).hexdigest()) for r in corpus_pipeline.run(spark, sf).collect()} for _ in range(2))
    assert first == second and first


def test_empty_documents(spark, sf, docs):
    none = docs.limit(0)
    for name, fn in corpus_pipeline.STAGES:
        none = written(fn(spark, none, sf), name)
        assert none.count() == 0


def test_odd_documents(spark, sf, odd):
    """Nulls, empty and long texts, ties, repeated rows and columns with the stages' own names."""
    texts = [r.text for r in odd.select("text").collect()]
    kept = written(stage("quality")(spark, odd, sf), "q")
    want = sorted((t for t in texts if not plain_base(t)[-1]), key=repr)
    assert sorted((r.text for r in kept.collect()), key=repr) == want and kept.columns == corpus_pipeline.COLUMNS

    near = written(stage("near_duplicates")(spark, odd, sf), "n").collect()
    # copies once, texts without words once
    assert sorted(((r.doc_id, r.text) for r in near), key=repr) == sorted(
        [(i, t) for i, t in dict((t, (i, t)) for i, t in reversed(rows_with_words(odd))).values()] + [(1, None)], key=repr
    )
    cut = written(stage("passages")(spark, odd, sf), "p").collect()
    assert len(cut) == len(texts) and sum(r.text == "" for r in cut) == 5
    mix = written(stage("mix")(spark, odd, sf), "m")
    assert {r.doc_id for r in mix.collect()} == {r.doc_id for r in odd.collect()} and mix.columns == corpus_pipeline.COLUMNS
    ids = stage("token_ids")(spark, odd, sf).collect()
    assert len(ids) == len(texts) and sum(r.n_tokens == 0 for r in ids) == 3


def test_token_ids_take_small_batches(spark, docs, tmp_path, monkeypatch):
    """The encoder gets at most TEXT_ROWS texts at a time, and the session's own bound is as before."""
    cut = bpe.grouped

    def seen(part, *most):
        (tmp_path / f"{part.num_rows}").touch()
        return cut(part, *most)

    monkeypatch.setattr(bpe, "grouped", seen)
    before = spark.conf.get(ARROW_ROWS)
    many = docs.crossJoin(spark.range(8).select()).coalesce(1)
    ids = written(stage("token_ids")(spark, many, ""), "t")
    assert ids.count() == many.count() > corpus_pipeline.TEXT_ROWS
    assert max(int(f.name) for f in tmp_path.iterdir()) <= corpus_pipeline.TEXT_ROWS
    assert spark.conf.get(ARROW_ROWS) == before


def rows_with_words(odd):
    """Ids and texts with words, the smallest id of a text first and nulls last."""
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if (r.text or "").strip(" \t\n\x0b\x0c\r")]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
