"""SimHash near-duplicates: fingerprints, pivot distance tables, components.

Candidates share some whole blocks of bits: of 4 + k blocks, fingerprints that
differ in four bits or fewer share at least k. Among the fingerprints of one
block value, a table of Hamming distances to reference fingerprints, the
pivots, discards most pairs: by the triangle inequality linked fingerprints
have distances to every pivot that differ by four at most. The survivors are
verified on the fingerprints themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.components import connected, stars
from colloquy.llm.runtime import forget, picked, written

SHINGLE = 4
DISTANCE = 4
PIVOTS = 16
# Fingerprints of one block value that a task compares at a time.
MOST_TOGETHER = 50_000
# Runs up to this length are compared by shifting all runs at once.
SHORT_RUN = 128
# Hashes whose bits are counted at a time.
HASHES = 1 << 16


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's shingles; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -SHINGLE].tolist()]
    hash_of, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    for at in range(0, n, HASHES):
        hashes = np.array(
            [hash_of(joined[s:e], 42) for s, e in zip(starts[at : at + HASHES], stops[at : at + HASHES])], "<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `mark` (a hash of the text) and `bits`, the fingerprint of every whole text as a signed number."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("bits", pa.int64())])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in parts:
            found = np.array([fingerprint(t.as_py()) for t in part.column(2)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(found)], schema=schema)

    source = picked(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return source.mapInArrow(run, "doc_id long, mark long, bits long")


def block_masks(blocks: int) -> list[int]:
    """64 bits cut into blocks of nearly equal width."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]


def key_masks(n: int, distance: int = DISTANCE, together: int = 64) -> list[int]:
    """Masks such that fingerprints within `distance` agree under one of them at least.

    The more fingerprints, the more blocks must agree, so that few of them share
    a value by chance. The choice changes the work, not the result.
    """
    for shared in range(1, 5):
        found = [sum(c) for c in combinations(block_masks(distance + shared), shared)]
        if n <= together << min(m.bit_count() for m in found):
            break
    return found


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, from a hash of their numbers."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42) for i in range(n)], np.uint64)


def distance_table(found: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each pivot."""
    return np.stack([np.bitwise_count(found ^ p) for p in references], 1).astype(np.int8)


def run_links(keys: np.ndarray, found: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, among fingerprints with equal keys (sorted), all that differ in `distance` bits or fewer."""
    table = distance_table(found, pivots())
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(edges)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    short = np.repeat(sizes <= SHORT_RUN, sizes)
    number = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(short)
    shift = 1
    while len(at):
        at = at[at + shift < len(keys)]
        at = at[number[at] == number[np.minimum(at + shift, len(keys) - 1)]]
        near = at[np.abs(table[at] - table[at + shift]).max(axis=1, initial=0) <= distance]
        near = near[np.bitwise_count(found[near] ^ found[near + shift]) <= distance]
        a.append(found[near])
        b.append(found[near + shift])
        shift += 1
    for k in np.flatnonzero(sizes > SHORT_RUN):
        run = slice(edges[k], edges[k + 1])
        x, y = _grown(found[run], table[run], distance)
        a.append(x)
        b.append(y)
    return np.concatenate(a) if a else found[:0], np.concatenate(b) if b else found[:0]


def _grown(found: np.ndarray, table: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a long run: components grow from their members over what no component has yet."""
    order = np.argsort(table[:, 0], kind="stable")
    found, table = found[order], table[order]
    left = np.arange(len(found))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    waiting: list[int] = []
    while len(left):
        if waiting:
            x = waiting.pop()
        else:
            x, left = int(left[0]), left[1:]
        # rows of the table are in order of their distance to the first pivot
        lo, hi = np.searchsorted(table[left, 0], (table[x, 0] - distance, table[x, 0] + distance + 1))
        near = left[lo:hi]
        for c in range(1, table.shape[1]):
            near = near[np.abs(table[near, c] - table[x, c]) <= distance]
            if len(near) < 16:
                break
        near = near[np.bitwise_count(found[near] ^ found[x]) <= distance]
        if len(near):
            a.append(found[near])
            b.append(np.full(len(near), found[x]))
            waiting += near.tolist()
            left = left[~np.isin(left, near)]
    return np.concatenate(a) if a else found[:0], np.concatenate(b) if b else found[:0]


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect all `bits` within `distance`; `distinct` has each value once.

    A block value that very many fingerprints share is cut into chunks, and
    every two chunks meet in a task of their own, so a task's memory is bounded.
    """
    n = distinct.count()
    masks = key_masks(n, distance)
    keyed = distinct.select("bits", F.posexplode(F.array(*(F.col("bits").bitwiseAND(F.lit(_signed(m))) for m in masks))))
    keyed = keyed.select("bits", F.struct(F.col("pos"), F.col("col")).alias("key"))
    crowded = keyed.groupBy("key").count().where(F.col("count") > MOST_TOGETHER)
    chunks = F.ceil(F.col("count") / F.lit(MOST_TOGETHER)).cast("int")
    dealt = (
        keyed.join(crowded, "key", "left")
        .withColumn("chunks", F.coalesce(chunks, F.lit(1)))
        .withColumn("chunk", F.pmod(F.xxhash64("bits"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "bits")
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            keys, found = (np.concatenate(x) for x in zip(*held))
            a, b = stars(*run_links(keys, found.view(np.uint64), distance))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for part in parts:
            keys, found = (c.to_numpy(zero_copy_only=False) for c in part.columns)
            # what is held may be compared once the key that it ends with has ended
            new = np.flatnonzero(keys != (held[-1][0][-1] if held else keys[:1]))
            if size >= MOST_TOGETHER and len(new):
                cut = int(new[0])
                yield made([*held, (keys[:cut], found[:cut])])
                held, size, keys, found = [], 0, keys[cut:], found[cut:]
            if len(keys):
                held.append((keys, found))
                size += len(keys)
        if held:
            yield made(held)

    number = F.xxhash64("key", "lo", "hi")
    return (
        dealt.select(number.alias("number"), "bits")
        .repartition("number")
        .sortWithinPartitions("number", "bits")
        .mapInArrow(run, "a long, b long")
    )


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _grouped(rows: DataFrame, distance: int) -> DataFrame:
    """`bits` and `label`, the least fingerprint (as a signed number) of its component; each fingerprint once."""
    distinct = written(rows.select("bits").distinct(), "distinct")
    labels = connected(links(distinct, distance))
    return distinct.join(labels, distinct["bits"] == labels["node"], "left").select(
        "bits", F.coalesce("label", "bits").alias("label")
    )


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `fingerprint` (16 hex digits), `component_id`: the smallest id linked to the row, directly or through others.

    One output row per input row; repeated rows and exact copies have one
    fingerprint and are compared once. Null and empty texts have fingerprint
    zero, which is linked like any other; null ids take part and count as larger
    than all others (a component of null ids alone has none). Other columns are
    left out; an empty table gives an empty result.
    """
    rows = written(fingerprints(docs, id_col, text_col).drop("mark"), "fingerprints", 1000)
    placed = written(_grouped(rows, distance), "placed")
    first = rows.groupBy("bits").agg(F.min("doc_id").alias("first"))
    # written first: adaptive execution splits a large component only if the join's stage does not aggregate by it
    lowest = written(placed.join(first, "bits").groupBy("label").agg(F.min("first").alias("component_id")), "lowest")
    component = placed.join(lowest, "label").select("bits", "component_id")
    return rows.join(component, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


# What names a row: whether it has no id, its id or 0, and a hash of its text. In this order the first row stays.
PLACE = ["unnamed", "id", "mark"]


def kept_rows(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`unnamed`, `id`, `mark` of one row of each component: that with the smallest id, then the least text hash.

    Null ids come after all others; repeated rows are one.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints", 1000)
    best = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")
    of_bits = rows.groupBy("bits").agg(F.min(best).alias("best"))
    stays = of_bits.join(_grouped(rows, distance), "bits").groupBy("label").agg(F.min("best").alias("best"))
    return stays.select("best.*")


def take_rows(docs: DataFrame, kept: DataFrame, keep: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns `keep` of the rows that `kept` names, repeated rows once; texts are shuffled once."""
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    marked = picked(
        docs, id=F.coalesce(key.cast("long"), F.lit(0)), unnamed=key.isNull(), mark=F.xxhash64(text),
        **{f"in_{i}": c for i, c in enumerate(keep)},
    )
    # repeated rows go before the shuffle, where each task sees them
    return marked.dropDuplicates(PLACE).join(kept, PLACE, "left_semi").drop(*PLACE).toDF(*keep)


def representatives(
    docs: DataFrame, keep: Sequence[str], distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The columns `keep` of the rows of `kept_rows`. Only ids and hashes are grouped."""
    return take_rows(docs, kept_rows(docs, distance, id_col, text_col), keep, id_col, text_col)
