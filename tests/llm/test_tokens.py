"""Encoding, counting and token files against the libraries themselves."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from colloquy.llm import bpe, segments, tokencounts, tokenfiles, wordtable
from colloquy.llm.queries import QUERIES
from colloquy.llm.runtime import batches
from tests.llm.conftest import ODD_TEXTS

PIECES = [
    "a", "b", "The", "ing", " ", "  ", "\n", "\t", "'s", "'re", "'l", "'", "é", "日本", "́", "\x1c", "\x85", " ",
    "　", "1", "23", "²", "½", "<|endoftext|>", "<|endof", "!!", "​", "🙂", "Ⅷ", "ʰ", "\x00", "İ", "Σ", "ẞ", "が", ".",
]


def odd_strings(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(14))) for _ in range(n)]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def codec(ranks):
    return bpe.Codec(ranks, P.PATTERN)


@pytest.fixture(scope="module")
def counter():
    return tokencounts.TokenCounter(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tik(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_no_texts(codec, counter):
    assert codec.encode([]) == [] and counter.counts([]).tolist() == [] and codec.encode([""]) == [b""]


def test_every_token_is_reachable(codec):
    assert all(codec.rules.reachable(i) for i in codec.rules.ids.values())


def test_units_join_to_the_text():
    for text in odd_strings(2000, 7):
        assert "".join(segments.units(text)) == text


def test_codec_equals_library(codec, tik, texts):
    every = [*odd_strings(3000), *texts.values()]
    for text, ids in zip(every, codec.encode(every)):
        assert ids == packed(tik.encode_ordinary(text))
        assert codec.decode(ids) == text.encode()


def test_memos_that_overflow(ranks, tik, texts, monkeypatch):
    monkeypatch.setattr(wordtable, "MOST_WORDS", 50)
    monkeypatch.setattr(wordtable, "MOST_LONGER", 5)
    monkeypatch.setattr(wordtable, "POOL", 64)
    small = bpe.Codec(ranks, P.PATTERN)
    small.pieces.most = 50
    for text in [*list(texts.values())[:30], "x" * 500 + " " + "y" * 90]:
        assert small.encode([text, "", text]) == [packed(tik.encode_ordinary(t)) for t in (text, "", text)]


def test_prefix_table_appends_and_edits(codec, tik):
    rnd = random.Random(3)
    for _ in range(200):
        data = bytes(rnd.choice(b"theingation ") for _ in range(rnd.randrange(1, 30)))
        table = bpe.PrefixTable(codec.columns, data[:5])
        table.append(data[5:])
        assert table.tokens() == bpe.PrefixTable(codec.columns, data).tokens()
        a = rnd.randrange(len(data) + 1)
        b = rnd.randrange(a, len(data) + 1)
        assert table.edit(a, b, b"xy").tokens() == bpe.PrefixTable(codec.columns, data[:a] + b"xy" + data[b:]).tokens()


def test_editable_text(codec, tik):
    rnd = random.Random(5)
    text = " ".join(odd_strings(40, 9))
    edited = bpe.EditableText(codec, text)
    for _ in range(200):
        a = rnd.randrange(len(text) + 1)
        b = min(len(text), a + rnd.randrange(6))
        new = rnd.choice(PIECES)
        text = text[:a] + new + text[b:]
        edited.edit(a, b, new)
        assert edited.text == text
    edited.append(" and more")
    assert edited.encoded() == packed(tik.encode_ordinary(text + " and more"))


def test_counter_equals_library(counter, byte_library, texts):
    every = [*odd_strings(3000, 2), *texts.values()]
    want = [len(byte_library.encode(text, add_special_tokens=False).ids) for text in every]
    assert [counter.count(text) for text in every] == want
    assert counter.counts(every).tolist() == want


def by_chunks(counter, text):
    chunks = list(counter.chunks(text))
    assert "".join(c for _, c in chunks) == text
    maps = counter.chunk_maps([(counter.live(before, i == 0), c) for i, (before, c) in enumerate(chunks)])
    return [tokencounts.unpacked(tokencounts.packed(m)) for m in maps]


MARKED = ["<|endoftext|>", "'", "'r", "'re", "'ll ", " 'v", "'s", "  ", "\n", "\u3000", " a", "b'", "1", "é", "!", "語", " <|endoftext|> "]


@pytest.mark.parametrize("size, before", [(1, 0), (3, 2), (7, 512)])
def test_chunk_maps_compose(counter, byte_library, texts, monkeypatch, size, before):
    monkeypatch.setattr(tokencounts, "CHUNK", size)
    monkeypatch.setattr(tokencounts, "BEFORE", before)
    rnd = random.Random(size)
    marked = ["".join(rnd.choices(MARKED, k=rnd.randrange(1, 12))) for _ in range(800)]
    for text in [*odd_strings(300, 4), *marked, *[t[:1500] for t in list(texts.values())[:10]], "x" * 100, "the" * 60]:
        if not text:
            continue
        want = len(byte_library.encode(text, add_special_tokens=False).ids)
        maps = by_chunks(counter, text)
        left = maps[0]
        for m in maps[1:]:
            left = counter.compose(left, m)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = counter.compose(m, right)
        tree = maps
        while len(tree) > 1:
            tree = [counter.compose(*tree[i : i + 2]) if i + 1 < len(tree) else tree[i] for i in range(0, len(tree), 2)]
        found = [counter.applied(m, tokencounts.CLOSED) for m in (left, right, tree[0])]
        assert found[0][1] == want, text
        assert found[0] == found[1] == found[2]


def test_state_missing_from_a_table_is_read(counter):
    whole, part = counter.read(tokencounts.CLOSED, "internat"), "ionalization of"
    blind, = counter.chunk_maps([({tokencounts.CLOSED}, part)])
    seen, = counter.chunk_maps([({whole[0]}, part)])
    assert whole[0] not in blind.table
    assert counter.applied(blind, whole[0]) == counter.applied(seen, whole[0])
    assert whole[1] + counter.applied(seen, whole[0])[1] == counter.count("internat" + part)


def test_chunks_of_long_texts_in_several_tasks(spark, byte_library, texts):
    """Copies, repeated ids, null ids, texts without blanks and special strings across the cuts."""
    rnd = random.Random(8)
    words = [w for t in list(texts.values())[:40] for w in t.split(" ")]
    far = [" ".join(rnd.choices(words, k=9000)), "語" * 40000, "ab" * 20000, " " * 33000, "<|endoftext|>" * 3000, "x " + "'ll" * 12000]
    rows = [(i, t) for i, t in enumerate(far)] + [(0, far[0]), (0, far[1]), (None, far[0]), (7, "short"), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = tokencounts.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()
    want = [(i, len((t or "").encode()), len(byte_library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=key) == sorted(want, key=key)


def test_transducer_that_starts_anew(counter, byte_library, monkeypatch):
    monkeypatch.setattr(tokencounts, "MOST_TRANSITIONS", 20)
    for word in ["international", "thononouinwh", "stationery"] * 3:
        assert counter.transducer.count(word.encode()) == len(byte_library.encode(word).ids)


def test_word_codec_equals_library(word_library, texts, monkeypatch):
    codec = wordtable.WordCodec(P.path("word_bpe_49k.json"))
    every = [*odd_strings(3000, 6), *list(texts.values()), "x" * 5000, "", " "]
    for at in range(0, len(every), 50):
        if at == 1000:
            monkeypatch.setattr(wordtable, "MOST_WORDS", 10)
        part = every[at : at + 50]
        ids, n = codec.encode(part)
        assert np.split(ids, np.cumsum(n))[-1].size == 0
        for text, got in zip(part, np.split(ids, np.cumsum(n))):
            assert got.tolist() == word_library.encode(text, add_special_tokens=False).ids


def test_addressable_codes_give_any_token():
    ids = np.random.default_rng(1).integers(0, 49408, 3000).astype("<u4")
    ids[::7] %= 256
    ids[100], ids[2000] = 70_000, 2**31
    data = tokenfiles.encoded(ids, [5, None, 7], np.array([0, 1000, 1000, 3000]))
    asked = []

    def read(offset, length):
        asked.append(length)
        return data[offset : offset + length]

    file = tokenfiles.TokenFile(read)
    assert file.documents() == [(5, 0, 1000), (None, 1000, 0), (7, 1000, 2000)]
    asked.clear()
    assert [file[i] for i in range(len(file))] == ids.tolist()
    assert max(asked) <= tokenfiles.BLOCK_BITS // 8
    for a, b in [(0, 3000), (1000, 1000), (513, 2999), (2999, 3000)]:
        assert file.tokens(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        file[3000]


def test_encoder_memory(ranks, tik):
    """What the encoder works with, besides what it remembers, follows its group of texts and stays small."""
    draw = random.Random(3)
    words = ["".join(draw.choices("aeiounrstlhd", k=draw.randint(2, 6))) for _ in range(3000)]
    texts = [" ".join(draw.choices(words, k=1000)) for _ in range(300)]
    part = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    codec, got = bpe.Codec(ranks, P.PATTERN), []
    codec.encode([" ".join(words)])
    tracemalloc.start()
    try:
        for _, group in bpe.grouped(part, bpe.GROUP):
            got.append(codec.encode(group)[::40])
            peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert peak < 24
    assert len(got) > 3 and got[1][0] in {packed(tik.encode_ordinary(t)) for t in texts}


def test_encoder_tables_memory(ranks, tik):
    """What the encoder remembers, its table of units and what it hands back stay small, as two encoders share an executor."""
    draw = random.Random(4)
    texts = [" ".join("".join(draw.choices("aeiounrstlhd     ", k=20_000)).split()) for _ in range(60)]
    part = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    read = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    tracemalloc.start()
    try:
        codec = bpe.Codec(read, P.PATTERN)
        made = [ids for _, group in bpe.grouped(part, bpe.GROUP) for ids in codec.encode(group)]
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert peak < 140
    assert made[::20] == [packed(tik.encode_ordinary(t)) for t in texts[::20]]
    out = batches(((ids,) for ids in made), pa.schema([("ids", pa.binary())]), sized=0, most=bpe.OUT_BYTES)
    assert max(b.nbytes for b in out) < 1.1 * (1 << 20)


@pytest.mark.parametrize("repeats", [1, 3])
def test_more_words_than_the_table_takes(ranks, tik, monkeypatch, repeats):
    """A text with more distinct words than the table has slots is encoded all the same, and so is what follows."""
    monkeypatch.setattr(bpe, "TABLE_BITS", 8)
    long = " ".join(f"w{i}x" for i in range(1000))
    texts = [long, "a few words", long + " and more", "a few words"] * repeats
    codec = bpe.Codec(ranks, P.PATTERN)
    assert codec.table.table.shape[0] == 256
    for group in (texts[:1], texts[1:2], texts):
        assert codec.encode(group) == [packed(tik.encode_ordinary(t)) for t in group]
    assert codec.table.words <= 256


def test_output_batches_are_bounded():
    schema = pa.schema([("ids", pa.binary())])
    made = list(batches(((bytes(1000),) for _ in range(10_000)), schema, sized=0, most=1 << 20))
    assert sum(b.num_rows for b in made) == 10_000 and max(b.nbytes for b in made) < 1.1 * (1 << 20)


def test_bpe_query(spark, sf, texts, tik):
    for r in QUERIES["op6_byte_bpe"](spark, sf).collect():
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_count_query(spark, sf, texts, byte_library):
    rows = QUERIES["op9_token_counts"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        n = len(byte_library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_token_file_query(spark, sf, texts, word_library):
    got = {r.doc_id: r for r in QUERIES["op5_token_files"](spark, sf).collect()}
    start = 0
    for key in sorted(texts):
        ids = [*word_library.encode(texts[key], add_special_tokens=False).ids, 1]
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)


def test_several_files_per_task(docs, texts, word_library, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FILE_IDS", 500)
    monkeypatch.setattr(wordtable, "GROUP", 2000)
    got = sorted(tokenfiles.stored_tokens(docs, P.path("word_bpe_49k.json")).collect())
    start = 0
    for r in got:
        ids = [*word_library.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, bytes(r.ids)) == (start, packed(ids))
        start += len(ids)


def test_odd_rows(odd, tik, byte_library, word_library):
    want = sorted((-1 if i is None else i, packed(tik.encode_ordinary(t or ""))) for i, t in ODD_TEXTS)
    coded = bpe.encode_documents(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, decode=True).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in coded) == want
    counted = tokencounts.count_tokens(odd, P.path("byte_bpe_50k.json")).collect()
    want = sorted((-1 if i is None else i, len(byte_library.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD_TEXTS)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in counted) == want
    stored = tokenfiles.stored_tokens(odd, P.path("word_bpe_49k.json")).collect()
    want = sorted((-1 if i is None else i, packed([*word_library.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in ODD_TEXTS)
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in stored) == want
    ordered = sorted(stored, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in stored), key=lambda i: (i is not None, i))


def test_empty_tables(empty):
    assert bpe.encode_documents(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert tokencounts.count_tokens(empty, P.path("byte_bpe_50k.json")).count() == 0
    assert tokenfiles.stored_tokens(empty, P.path("word_bpe_49k.json")).count() == 0
