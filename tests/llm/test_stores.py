"""Media shards, WARC archives, URL rules and the mix."""

import hashlib
import random
import tarfile
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import media, mixing, urlrules, warc
from colloquy.llm.queries import QUERIES, URL_LIST
from colloquy.llm.runtime import shared_folder
from tests.llm.conftest import ODD_TEXTS


def padded(text):
    data = (text or "").encode()
    return data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))


def check_media(row, text):
    data = padded(text)
    stored = media.png(data)
    assert media.png_payload(stored) == data
    assert row.n_bytes == len((text or "").encode()) and row.payload_bytes == len(data)
    assert row.payload_sha256 == hashlib.sha256(data).hexdigest()
    assert row.tail_crc32 == zlib.crc32(data[-16:])
    assert (row.media_bytes, row.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert row.feature == media.feature(data)
    assert (row.width, row.height, row.bit_depth) == (192, len(data) // 192, 8)


def test_media_query(spark, sf, texts):
    rows = QUERIES["op2_media_columns"](spark, sf).collect()
    assert len(rows) == len(texts)
    for row in rows:
        check_media(row, texts[row.doc_id])


def test_media_odd_rows_and_shards(spark, odd, empty, monkeypatch):
    folder = shared_folder(spark, "shards")
    rows = media.media_columns(odd, folder).collect()
    assert len(rows) == len(ODD_TEXTS)
    known = {i: t for i, t in ODD_TEXTS if i is not None}
    for row in rows:
        if row.doc_id is not None:
            check_media(row, known[row.doc_id])
        # the reference leads to the payload: a tar member named by its digest
        path = Path(folder.removeprefix("file://")) / row.shard
        data = path.read_bytes()[row.offset : row.offset + row.length]
        assert hashlib.sha256(data).hexdigest() == row.media_sha256
        with tarfile.open(path) as shard:
            assert shard.extractfile(f"{row.payload_sha256}.png").read() == data
    assert media.media_columns(empty).count() == 0


def test_copies_of_many_tasks_have_one_address(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("text")).repartition(6)
    rows = media.media_columns(docs).collect()
    assert len(rows) == 60 and len({(r.shard, r.offset) for r in rows}) == 3


def test_png_is_read_by_structure():
    data = padded("x" * 1000)
    stored = media.png(data)
    assert media.png_header(stored[: media.HEAD]) == (192, len(data) // 192, 8, 0)
    with pytest.raises(ValueError):
        media.png_payload(stored[:60] + bytes([stored[60] ^ 1]) + stored[61:])


PAGES = [
    (1, "http://a.example/x", "p" * 1000), (2, "http://b.example/y", "p" * 1000), (3, None, "p" * 1000),
    (4, "http://c.example/\r\nWARC-Type: evil", "short"), (5, "", "short"), (6, "http://d.example", None), (7, "u", ""),
    (8, "u", "é" * 500), (9, "u", "é" * 500), (9, "u", "é" * 500), (None, "u", "q" * 2000), (None, "v", "q" * 2000), (10, "w", "q" * 2000),
]


def plain_revisits(rows):
    out = []
    for i, (key, _, html) in enumerate(rows):
        data = (html or "").encode()
        same = [(k is not None, k or 0, -j) for j, (k, _, h) in enumerate(rows) if (h or "").encode() == data]
        first = max(same)
        revisit = len(data) >= 1000 and -first[2] != i
        out.append((key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", rows[-first[2]][0] if revisit else None))
    return sorted(out, key=repr)


def test_warc_odd_rows(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    clash = pages.select("*", *(F.lit("clash").alias(c) for c in ("digest", "record_id", "file", "offset", "row_id", "refers_to")))
    got = warc.deduplicated(clash, f"file://{tmp_path}").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_revisits(PAGES)
    # every archive is a chain of gzip members that hold whole records; urls cannot add fields
    kinds = Counter()
    for path in tmp_path.glob("*.warc.gz"):
        data = path.read_bytes()
        while data:
            reader = zlib.decompressobj(31)
            text = reader.decompress(data)
            fields, http, payload = warc.parsed(data[: len(data) - len(reader.unused_data)])
            assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and fields["WARC-Type"] != "evil"
            assert len(payload) == (int(http["Content-Length"]) if fields["WARC-Type"] == "response" else 0)
            kinds[fields["WARC-Type"]] += 1
            data = reader.unused_data
    assert kinds == {"response": 7, "revisit": 6}


def test_warc_of_an_empty_table(spark):
    assert warc.deduplicated(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_list(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in URL_LIST if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


ODD_URLS = [
    None, "", "nonsense", "http://X.NET/a", "http://net/", "http://net", "ftp://a.example.net/en/x?y=1#z", "http://example.net/english",
    "http://notexample.com/de/", "http://sub.EXAMPLE.com/de/1.html", "https://a.org/fr/?q", "https://a.org?fr/", "a://b://c.net/x", "http://Ä.net/é",
    "http://bad.example.info/en/5?spam=1&x", "http://bad.example.info/en/6", "http://good.example.info/en/6?spam=1", "://", "x://\n.net/\n",
]


def test_url_list_and_mined_rules(spark):
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(ODD_URLS)] + [(None, "http://y.net/", "c")] * 2, "page_id long, url string, tokens string")
    labelled = spark.createDataFrame(
        [(["h:bad", "q:spam"], True)] * 12 + [(["h:bad"], False)] * 30 + [(["q:spam"], False)] * 30, "tokens array<string>, blocked boolean"
    )
    rules = urlrules.mine_rules(labelled)
    assert [(sorted(r["items"]), r["count"], r.confidence) for r in rules.collect()] == [(["h:bad", "q:spam"], 12, 1.0)]
    got = {r.page_id: r for r in urlrules.judge_urls(pages, rules, URL_LIST).collect() if r.page_id is not None}
    for i, url in enumerate(ODD_URLS):
        host, path, rule = plain_list(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[0])
        assert got[i].verdict == (rule[1] if rule else "block" if i == 14 else "allow")
    assert urlrules.judge_urls(pages, rules, URL_LIST).count() == len(ODD_URLS) + 2


def test_mined_rules_equal_counting(spark):
    rnd = random.Random(4)
    rows = [(sorted(rnd.sample("abcdefg", rnd.randrange(1, 6))), rnd.random() < 0.5) for _ in range(400)]
    rows = [(t, b or "c" in t and "e" in t) for t, b in rows]
    got = urlrules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 20, 0.0, 0.7, 2).collect()
    from itertools import combinations

    want = {}
    for size in (1, 2):
        for items in combinations("abcdefg", size):
            having = [b for t, b in rows if set(items) <= set(t)]
            if sum(having) >= 20 and sum(having) / len(having) >= 0.7:
                want[items] = (sum(having), sum(having) / len(having))
    assert {tuple(r["items"]): (r["count"], r.confidence) for r in got} == want and want
    single = Counter(t for tokens, _ in rows for t in tokens)
    assert all(r.anchor == min(r["items"], key=lambda t: (single[t], t)) for r in got)


def test_rules_of_any_length(spark):
    """Four tokens together block; each three of them do not."""
    from itertools import combinations

    four = ["h:bad", "h:info", "p:x", "q:spam"]
    rows = [(four, True)] * 12 + [(list(three), False) for three in combinations(four, 3)] * 12
    rules = urlrules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"))
    want = {}
    for size in range(1, 5):
        for items in combinations(four, size):
            having = [b for t, b in rows if set(items) <= set(t)]
            if sum(having) >= 10 and sum(having) / len(having) >= 0.6:
                want[items] = (sum(having), sum(having) / len(having))
    assert {tuple(r["items"]): (r["count"], r.confidence) for r in rules.collect()} == want == {tuple(four): (12, 1.0)}
    pages = spark.createDataFrame([(1, "http://bad.info/x?spam=1"), (2, "http://bad.info/x")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urlrules.judge_urls(pages, rules, []).collect()} == {1: "block", 2: "allow"}


def test_tokens_that_always_come_together_are_one_item(spark):
    """Forty such tokens, of which any one stands for all; beside them single tokens that need company."""
    many = [f"q:k{i:02}" for i in range(40)]
    rows = [([*many, "h:bad"], True)] * 12 + [(["h:bad", "p:x"], False)] * 30 + [(["p:x"], True)] * 11 + [(["p:x", None], None), (None, True), ([], False)]
    rules = urlrules.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"))
    got = {tuple(r["items"]): (r["count"], r.confidence, r.anchor, r["members"]) for r in rules.collect()}
    assert got == {
        ("q:k00",): (12, 1.0, "q:k00", [many]),
        ("h:bad", "q:k00"): (12, 1.0, "q:k00", [["h:bad"], many]),
    }
    urls = ["http://a/?k07=1", "http://bad/x", "http://a/x", "http://a/?k39", "http://a/?k40", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in urlrules.judge_urls(pages, rules, []).collect()}
    # what a plain list of all combinations gives: each of the forty alone is one
    assert verdicts == {0: "block", 1: "allow", 2: "allow", 3: "block", 4: "allow", 5: "allow"}


def test_no_labels_no_rules(spark, sf):
    none = spark.createDataFrame([], "tokens array<string>, blocked boolean")
    rules = urlrules.mine_rules(none)
    assert rules.count() == 0
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert urlrules.judge_urls(pages, rules, URL_LIST).count() == pages.count()
    assert urlrules.judge_urls(pages.limit(0), rules, URL_LIST).count() == 0


def sources(spark, seed=1):
    rnd = random.Random(seed)
    rows = [(i, " ".join("w" * rnd.randrange(30)), rnd.choice(["big"] * 6 + ["mid", "mid", "low", None])) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_reaches_its_targets(spark):
    rows, docs = sources(spark)
    tokens = Counter()
    for _, text, source in rows:
        tokens[source] += len(text.split())
    light = mixing.token_table(docs).cache()
    # the least exponent within the limit, by trying all
    share = np.array(sorted(tokens.values())) / sum(tokens.values())
    within = [k for k in range(mixing.GRID + 1) if max((share.max() / share) ** (1 - k / mixing.GRID)) <= 1.5]
    used = mixing.mixed(docs, max_epochs=1.5).collect()
    exponent = min(within) / mixing.GRID
    taken = Counter()
    for r in used:
        taken[r.source] += r.n_tokens
    for source, n in tokens.items():
        quota = round(n * (max(tokens.values()) / n) ** (1 - exponent))
        assert quota - 30 < taken[source] <= quota
    assert {r.doc_id for r in used} == {r[0] for r in rows}
    # entropy: the largest exponent that still has the share of the highest entropy
    totals = mixing.token_shares(light).withColumn("most", F.lit(max(tokens.values())))
    found = mixing.bisected(totals, 0.9, None, None)

    def entropy(a):
        w = share**a / (share**a).sum()
        return -(w * np.log(w)).sum() / np.log(len(w))

    assert entropy(found) >= 0.9 > entropy(found + 1 / mixing.GRID)
    # a budget bounds the tokens in all
    budget = sum(tokens.values()) // 3
    small = mixing.mixed(docs, entropy=0.9, max_epochs=None, budget=budget).collect()
    assert budget - 30 * len(tokens) < sum(r.n_tokens for r in small) <= budget + len(tokens)


def test_passes_take_blocks_in_permutations_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 10)
    rows, docs = sources(spark, 2)
    used = [r for r in mixing.mixed(docs, max_epochs=3.0).collect() if r.source == "low"]
    orders = {}
    for r in used:
        orders.setdefault(r.epoch, set()).add((r.pass_key, r.block))
    assert len(orders) >= 2
    first, second = ([b for _, b in sorted(orders[e])] for e in (0, 1))
    assert len(first) > 3 and [b for b in first if b in second] != [b for b in second if b in first]


def test_mix_odd_rows(odd, empty):
    got = mixing.mixed(odd).collect()
    ids = Counter(r.doc_id for r in got)
    assert set(ids) == {i for i, _ in ODD_TEXTS}
    assert mixing.mixed(empty).count() == 0


def test_many_sources_are_joined_by_a_shuffle(spark, monkeypatch):
    rows, docs = sources(spark, 3)
    want = sorted((tuple(r) for r in mixing.mixed(docs).collect()), key=repr)
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 1)
    assert sorted((tuple(r) for r in mixing.mixed(docs).collect()), key=repr) == want


@pytest.mark.parametrize("name", ["op3_source_mix", "op4_url_rules"])
def test_native_queries_run_no_python(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian"))


