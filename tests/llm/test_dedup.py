"""Near-duplicate groups and repeated passages against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from colloquy.llm import components, passages, simhash
from colloquy.llm.queries import QUERIES
from tests.llm.conftest import ODD_TEXTS


KEY_MASKS = simhash.key_masks


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Smallest id of each row's component; rows are (id, fingerprint)."""
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 4:
                label[root(i)] = root(j)
    ids = {}
    for i, (key, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(key)
    return [min((k for k in ids[root(i)] if k is not None), default=None) for i in range(len(rows))]


def test_simhash_query(spark, sf, texts):
    rows = [(i, plain_fingerprint(t)) for i, t in texts.items()]
    want = {i: (f"{f:016x}", c) for (i, f), c in zip(rows, plain_components(rows))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash"](spark, sf).collect()}
    assert got == want


def test_simhash_odd_rows(odd):
    rows = [(i, plain_fingerprint(t)) for i, t in ODD_TEXTS]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(rows, plain_components(rows))), key=repr)
    assert sorted((tuple(r) for r in simhash.near_duplicates(odd).collect()), key=repr) == want


def test_one_row_of_each_group_stays(odd):
    left = simhash.representatives(odd, keep=["doc_id", "text", "bits", "label"])
    assert left.columns == ["doc_id", "text", "bits", "label"]
    assert sorted(map(repr, (r.doc_id for r in left.collect()))) == sorted(
        map(repr, {c for c in plain_components([(i, plain_fingerprint(t)) for i, t in ODD_TEXTS])})
    )


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.representatives(empty, keep=["doc_id"]).count() == 0


def clustered(n, seed):
    """Fingerprints in chains and dense clusters, and some alone."""
    rnd, out = random.Random(seed), set()
    while len(out) < n:
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 5, 60])):
            out.add(x)
            for _ in range(rnd.randrange(1, 6)):
                x ^= 1 << rnd.randrange(64)
    return np.array(sorted(out), np.uint64)


def labels_of(values, a, b):
    member, low = components.stars(a, b)
    return {**{int(v): int(v) for v in values}, **dict(zip(member.tolist(), low.tolist()))}


def all_links(values):
    near = [(i, j) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4) + i + 1]
    i, j = np.array(near).T
    return values[i], values[j]


def test_runs_of_any_length_connect_the_same(monkeypatch):
    values = clustered(700, 2)
    want = labels_of(values, *all_links(values))
    for short in (1, 10_000):
        monkeypatch.setattr(simhash, "SHORT_RUN", short)
        assert labels_of(values, *simhash.run_links(np.zeros(len(values), np.int64), values)) == want


def test_links_by_any_number_of_blocks(spark, monkeypatch):
    values = clustered(400, 3)
    signed = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "bits long")
    want = labels_of(values.view(np.int64), *(x.view(np.int64) for x in all_links(values)))
    for together, crowd in ((64, 50_000), (0, 50_000), (64, 7)):
        monkeypatch.setattr(simhash, "MOST_TOGETHER", crowd)
        monkeypatch.setattr(simhash, "key_masks", lambda n, d, t=together: KEY_MASKS(n, d, t))
        rows = simhash.links(signed).collect()
        a, b = (np.array([r[k] for r in rows], np.int64) for k in "ab")
        assert labels_of(values.view(np.int64), a, b) == want


def test_masks_leave_no_pair_out():
    rnd = random.Random(1)
    for n in (10, 10**6, 10**10):
        masks = simhash.key_masks(n)
        for _ in range(300):
            gone = sum(1 << b for b in rnd.sample(range(64), 4))
            assert any(m & gone == 0 for m in masks)


def test_long_chains_become_one_component(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    other = spark.createDataFrame([(1000, 1001), (1001, 1000), (2000, 2000)], "a long, b long")
    got = {r.node: r.label for r in components.connected(links.union(other)).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def plain_cut(rows, window=100):
    """(n_bytes, n_removed, n_spans, kept) of texts in order."""
    seen, out = set(), []
    for text in rows:
        gone = bytearray(len(text))
        for s in range(len(text) - window + 1):
            part = text[s : s + window]
            if part in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(part)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(text), sum(gone), spans, bytes(b for b, g in zip(text, gone) if not g)))
    return out


def test_passage_query(spark, sf, texts):
    keys = sorted(texts)
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op8_repeated_passages"](spark, sf).collect()}
    for key, (n, removed, spans, kept) in zip(keys, plain_cut([texts[k].encode() for k in keys])):
        assert got[key] == (n, removed, spans, hashlib.sha256(kept).hexdigest())


def planted(seed):
    """Texts of few letters with passages in common at odd places, edited copies and periodic parts."""
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcdeé ") for _ in range(n))
    common = [word(rnd.randrange(90, 400)) for _ in range(6)]
    out = []
    for _ in range(120):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            text = rnd.choice(common) if rnd.random() < 0.6 else word(rnd.randrange(300))
            if rnd.random() < 0.4 and text:
                at = rnd.randrange(len(text))
                text = text[:at] + "#" + text[at + 1 :]
            parts.append(text[rnd.randrange(30) :])
        out.append("".join(parts) + rnd.choice(["", "a" * 250, "ab" * 90]))
    return out


def test_passages_in_batches_and_slices(spark, monkeypatch):
    monkeypatch.setattr(passages, "BATCH", 3000)
    monkeypatch.setattr(passages, "BUFFER", 400)
    texts = planted(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in passages.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == plain_cut([t.encode() for t in texts])
    whole = passages.remove_repeats(docs, characters=True).select("doc_id", F.col("kept").cast("string").alias("text"))
    for r in whole.collect():
        assert "�" not in r.text and set(r.text) <= set("abcdeé #")


def test_more_text_makes_more_scan_tasks(spark, docs, texts, monkeypatch):
    scan, asked = passages.family_scan, []
    monkeypatch.setattr(passages, "TASK_BYTES", 20_000, raising=False)
    monkeypatch.setattr(passages, "family_scan", lambda parcels, buckets, partial: asked.append(buckets) or scan(parcels, buckets, partial))
    keys = sorted(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in passages.remove_repeats(docs).collect()}
    assert got == dict(zip(keys, plain_cut([texts[k].encode() for k in keys])))
    total = sum(len(t.encode()) for t in texts.values())
    assert len(asked) == 2 and all(n // passages.BUCKETS_PER_TASK >= total / 20_000 > 4 for n in asked)


def test_family_levels_grow_geometrically():
    rng = np.random.default_rng(1)
    family, seen, repeated = passages.IndexFamily(), {}, 0
    for batch in range(40):
        keys = rng.integers(0, 500, 30)
        zero = np.zeros(30, np.int64)
        claims = passages.Claims(
            keys.astype(np.uint64), keys.astype(np.uint64), (keys % 3).astype(np.uint64), zero + 40 - batch, zero, zero, np.arange(30), zero
        )
        first, again = passages.suffix_array(claims)
        repeated += len(again) + sum(map(len, family.add(first)))
        for k, s in zip(keys.tolist(), range(30)):
            seen[k] = min(seen.get(k, (99, 0)), (40 - batch, s))
        sizes = [len(level) for level in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    left = family.all()
    assert repeated == 40 * 30 - len(seen)
    assert {int(h): (int(d), int(s)) for h, d, s in zip(left.high, left.doc, left.start)} == seen


def test_packed_columns():
    rng = np.random.default_rng(2)
    columns = [
        rng.integers(0, 2**63, 9).astype(np.uint64), np.array([0, 2**63 - 1] + [5] * 7), np.array([-(2**63), 2**63 - 1] + [0] * 7),
        np.arange(9), np.full(9, 300) * np.arange(9),
    ]
    for got, want in zip(passages.unpack(passages.pack(*columns)), columns):
        assert got.dtype == want.dtype and (got == want).all()
    assert [len(c) for c in passages.unpack(passages.pack(*(c[:0] for c in columns)))] == [0] * 5


def test_passages_odd_rows(odd, empty):
    got = passages.remove_repeats(odd, keep=["lang", "part"]).collect()
    assert len(got) == len(ODD_TEXTS) and {r.in_part for r in got} == {"clash"}
    order = sorted(ODD_TEXTS, key=lambda r: (r[0] is None, r[0] or 0))
    named = [(i, c) for (i, _), c in zip(order, plain_cut([(t or "").encode() for _, t in order])) if i is not None]
    assert sorted((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in got if r.doc_id is not None) == sorted(named)
    assert passages.remove_repeats(empty).count() == 0
