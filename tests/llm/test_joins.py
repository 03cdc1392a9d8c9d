"""The n-gram join, importance resampling and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import ngramjoin, queries, resampling, vectorcodes


def plain_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def plain_join(rows, percent=80):
    """(doc_id, n_shingles, component_id) by comparing all pairs that share a shingle."""
    sets = [plain_set(t) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if sets[i]:
            old = least.get(find(i))
            least[find(i)] = key if old is None else old if key is None else min(key, old)
    return sorted(
        ((key, len(sets[i]), least[find(i)] if sets[i] else key) for i, (key, _) in enumerate(rows)), key=repr
    )


def got_join(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_join_of_all_documents(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got_join(queries.QUERIES["op13_ngram_join"](spark, sf)) == plain_join(rows)


def near_copies(n, words, seed, edits):
    """Copies of one text with some words replaced, so that some links are direct and some through others."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    texts = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(words)] = f"e{rng.randrange(1000)}"
        texts.append(" ".join(copy))
        if rng.random() < 0.2:
            base = copy
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_join_of_large_groups(spark, monkeypatch, small):
    if small:
        for name, value in (("PER_BUCKET", 500), ("PER_BATCH", 2000), ("MOST_SETS", 7), ("BLOCK", 50), ("PER_CHUNK", 900)):
            monkeypatch.setattr(ngramjoin, name, value)
    texts = near_copies(120, 90, 1, 6) + near_copies(60, 25, 2, 4) + ["all of one text"] * 40 + near_copies(30, 4, 3, 2)
    passage = " ".join(f"p{i}" for i in range(60))
    rng = random.Random(4)
    texts += [passage + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(4, 30))) for _ in range(80)]
    rng.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_join(ngramjoin.similar_documents(df)) == plain_join(rows)


def test_join_of_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert got_join(ngramjoin.similar_documents(odd)) == plain_join(rows)
    assert ngramjoin.similar_documents(empty).collect() == []


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_buckets(text, n=10_000):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resampling(rows, target, percent=5, least=20):
    s, t = np.zeros(10_000, np.int64), np.zeros(10_000, np.int64)
    for _, text in rows:
        np.add.at(s, plain_buckets(text), 1)
    for text in target:
        np.add.at(t, plain_buckets(text), 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s.tolist(), t.tolist())]
    out = []
    for key, text in rows:
        found = plain_buckets(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long_enough = [r for r, (_, text) in zip(out, rows) if len(plain_words(text)) >= least]
    long_enough.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(long_enough[: percent * len(long_enough) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=repr)


NUMBERS = ("doc_id", "n_features", "weight", "score", "rank")


def got_resampling(df):
    return sorted((tuple(r[n] for n in NUMBERS) for r in df.collect()), key=repr)


def test_resampling_of_all_documents(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got_resampling(queries.QUERIES["op11_importance_resampling"](spark, sf)) == plain_resampling(rows, target)


def test_resampling_of_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()] * 5
    many = odd.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(4)
    target = spark.createDataFrame([("one two three same text",), (None,), ("",)], "text string")
    assert got_resampling(resampling.resampled(many, target, percent=50)) == plain_resampling(
        rows, ["one two three same text"], percent=50
    )
    assert got_resampling(resampling.resampled(odd, target.limit(0))) == plain_resampling(rows[: len(rows) // 5], [])
    assert resampling.resampled(empty, target).collect() == []
    drawn = resampling.resampled(many, target, percent=50, keep=["text"]).where("rank is not null")
    assert {(r.doc_id, r.in_text) for r in drawn.collect()} <= set(rows)


@pytest.mark.parametrize("block", [1, 2, 7, 100])
def test_runs_cross_blocks(block):
    text = "One, two; dreiä 4 five-six seven EIGHT  nine\nten " * 3
    whole = plain_buckets(text, 1 << 32)
    found = [c for _, part in resampling.features(text.encode(), 3, block) for c in part]
    assert sorted(found) == sorted(whole)
    assert sum(n for n, _ in resampling.features(text.encode(), 3, block)) == len(plain_words(text))


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, digest) with Python's whole numbers."""
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for c in cut:
                mine.setdefault(best(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(v) // len(v) for v in zip(*mine[i])) if i in mine else e for i, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out, of_label = [], {}
    for (i, lab, _), c in zip(kept, cut):
        found = [best(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, lab))
        of_label[lab] = of_label.get(lab, 0) + error
    return sorted(((i, code, error, of_label[lab], digest) for i, code, error, lab in out), key=repr)


def got_codes(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


def test_codes_of_all_vectors(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got_codes(queries.QUERIES["op12_vector_codes"](spark, sf)) == plain_codes(rows)


@pytest.mark.parametrize("dims, group", [(16, 32768), (32, 50), (160, 333)])
def test_codes_of_odd_vectors(spark, monkeypatch, dims, group):
    monkeypatch.setattr(vectorcodes, "GROUP", group)
    rng = random.Random(dims)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dims)], f"l{i % 3}" if i % 4 else None) for i in range(400)]
    rows += [(i + 1000, rows[7][1], "l1") for i in range(300)]
    rows += [(5, rows[5][1], "l2"), (None, rows[6][1], None), (3, None, "l1"), (-1, [], "l0")]
    rows += [(-2, [float("nan")] * dims, "l0"), (-3, [1.0] * (dims - 1) + [None], "l0"), (-4, [float("inf")] + [0.0] * (dims - 1), "l0")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumns(
        {c: F.lit("clash") for c in ("code", "error", "p", "ids")}
    )
    want = plain_codes(rows)
    assert got_codes(vectorcodes.compressed(df.repartition(3))) == want
    assert vectorcodes.compressed(df.limit(0)).collect() == [] == vectorcodes.compressed(df.where("vec_id < -1")).collect()


def test_blocks_give_the_nearest_entries():
    spread = np.random.default_rng(1).integers(-200, 200, (5000, 4))
    entries = spread[:64]
    layout = vectorcodes.Layout.of(spread)
    code, distance = vectorcodes.nearest(layout, entries, False)
    every = ((layout.points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert np.array_equal(code, every.argmin(axis=1)) and np.array_equal(distance, every.min(axis=1))
    listed = vectorcodes.shortlists(layout, entries)
    assert listed.mean() < 0.7 and listed[np.arange(5000) // vectorcodes.BLOCK, code].all()


def test_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(16)] * 3, indexing="ij"), -1).reshape(-1, 3)
    path = grid[np.argsort(vectorcodes.hilbert_keys(grid * 64))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
