"""Vector codes: each part of a vector becomes the number of its nearest codebook entry.

Tasks lay the vectors out once: per part position, in the order of a Hilbert
curve through the part's space, cut into flat blocks with the smallest box
around their points and the sum of them. A round compares codebook entries with
boxes: an entry whose least distance to a box is beyond another one's greatest
cannot be nearest for any point in it. Blocks with one entry left are done by
their sums; the others compare their points with their short list in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from colloquy.llm.runtime import forget, picked, written
from colloquy.operators.blocks import join_on

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
# Vectors that are laid out together, and points of a block.
GROUP = 1 << 15
BLOCK = 32
# Point-entry distances computed at a time.
AT_ONCE = 1 << 20
# Largest size of an integer component; squares of differences then fit into 64 bits.
LARGEST = 1 << 28


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Places of integer points on a Hilbert curve through their bounding box, as many bits as fit into a key.

    Bits of the axes are rotated and reflected level by level, from the coarsest,
    then interleaved. The order only gathers near points; results don't depend on it.
    """
    n, dims = points.shape
    dims = min(dims, 60)
    bits = max(1, min(10, 60 // dims))
    axes = points[:, :dims]
    low = axes.min(axis=0, initial=LARGEST)
    wide = np.maximum(axes.max(axis=0, initial=-LARGEST) - low, 1)
    x = ((axes - low) * ((1 << bits) - 1) // wide).T.copy()
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for i in range(dims):
            high = (x[i] & level) != 0
            x[0] = np.where(high, x[0] ^ below, x[0])
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= swap
            x[i] ^= swap
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(n, np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        flip = np.where((x[dims - 1] & level) != 0, flip ^ (level - 1), flip)
        level >>= 1
    x ^= flip
    key = np.zeros(n, np.int64)
    for bit in reversed(range(bits)):
        for i in range(dims):
            key = key << 1 | (x[i] >> bit) & 1
    return key


@dataclass
class Layout:
    """One part position of a group: points in curve order, where each came from, and box and sum of every block."""

    points: np.ndarray
    origin: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @staticmethod
    def of(points: np.ndarray, block: int = BLOCK) -> Layout:
        origin = np.argsort(hilbert_keys(points), kind="stable")
        laid = points[origin]
        starts = np.arange(0, len(laid), block)
        found = [f.reduceat(laid, starts, axis=0) for f in (np.minimum, np.maximum, np.add)]
        return Layout(laid, origin, *found)

    def sizes(self, block: int = BLOCK) -> np.ndarray:
        return np.minimum(block, len(self.points) - block * np.arange(len(self.low)))


def shortlists(layout: Layout, entries: np.ndarray) -> np.ndarray:
    """Block by entry, whether the entry can be nearest to a point of the block."""
    low, high, e = layout.low[:, None], layout.high[:, None], entries[None]
    least = (np.maximum(np.maximum(low - e, e - high), 0) ** 2).sum(axis=2)
    most = (np.maximum(np.abs(e - low), np.abs(e - high)) ** 2).sum(axis=2)
    return least <= most.min(axis=1, keepdims=True)


def nearest(layout: Layout, entries: np.ndarray, only_open: bool, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of each point, in curve order; the lower number wins ties.

    With `only_open`, points of blocks with one possible entry get that entry and no distance.
    """
    n, dims = layout.points.shape
    listed = shortlists(layout, entries)
    length = listed.sum(axis=1)
    sizes = layout.sizes(block)
    code, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if only_open:
        sure = length == 1
        code[:] = np.repeat(np.where(sure, listed.argmax(axis=1), 0), sizes)
    for s in np.unique(length):
        # blocks with lists of one length are compared together; the last one may be short
        every = np.flatnonzero((length == s) & (sizes == block))
        each = max(1, AT_ONCE // (block * int(s)))
        groups = [every[i : i + each] for i in range(0, len(every), each)]
        if sizes[-1] < block and length[-1] == s:
            groups.append(np.array([len(sizes) - 1]))
        if only_open and s == 1:
            continue
        for g in groups:
            rows = (g[:, None] * block + np.arange(sizes[g[0]])).ravel()
            lists = np.nonzero(listed[g])[1].reshape(len(g), s)
            points = layout.points[rows].reshape(len(g), -1, 1, dims)
            found = ((points - entries[lists][:, None]) ** 2).sum(axis=3)
            best = found.argmin(axis=2)
            code[rows] = np.take_along_axis(lists, best, axis=1).ravel()
            distance[rows] = np.take_along_axis(found, best[:, :, None], axis=2).ravel()
    return code, distance


def tallies(layout: Layout, entries: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """How many points each entry is nearest to, and their sums."""
    k, dims = entries.shape
    listed = shortlists(layout, entries)
    sure = listed.sum(axis=1) == 1
    sizes, owner = layout.sizes(block), listed.argmax(axis=1)
    count = np.bincount(owner[sure], weights=sizes[sure], minlength=k)
    total = [np.bincount(owner[sure], weights=layout.sums[sure, d], minlength=k) for d in range(dims)]
    if not sure.all():
        code, _ = nearest(layout, entries, True, block)
        rows = np.flatnonzero(np.repeat(~sure, sizes))
        count += np.bincount(code[rows], minlength=k)
        total = [t + np.bincount(code[rows], weights=layout.points[rows, d], minlength=k) for d, t in enumerate(total)]
    # a group's sums stay below 2**53, where these are exact
    return count.astype(np.int64), np.stack(total, 1).astype(np.int64)


LAID = "dims int, ids array<long>, labels array<{label}>, points binary, origin binary, low binary, high binary, sums binary"


def packed(layouts: list[Layout]) -> list[bytes]:
    kinds = {"points": "<i4", "origin": "<i4", "low": "<i4", "high": "<i4", "sums": "<i8"}
    return [b"".join(getattr(x, name).astype(t).tobytes() for x in layouts) for name, t in kinds.items()]


def unpacked(n: int, dims: int, parts: int, found: list[bytes], block: int = BLOCK) -> list[Layout]:
    points, origin, low, high, sums = (
        np.frombuffer(b, t).astype(np.int64) for b, t in zip(found, ["<i4", "<i4", "<i4", "<i4", "<i8"])
    )
    m, d = -(-n // block), dims // parts
    shaped = [points.reshape(parts, n, d), origin.reshape(parts, n), *(a.reshape(parts, m, d) for a in (low, high, sums))]
    return [Layout(*(a[p] for a in shaped)) for p in range(parts)]


def usable(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows with `dims` finite components each, and these vectors."""
    length = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(length == dims)
    flat = pc.list_flatten(vectors.take(pa.array(rows))).cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, dims) if len(rows) else np.zeros((0, dims))
    fine = np.isfinite(values).all(axis=1)
    return rows[fine], values[fine]


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    found = np.floor(scale * values)
    if found.size and np.abs(found).max() >= LARGEST:
        raise ValueError(f"a component beyond {LARGEST // scale} cannot be coded")
    return found.astype(np.int64)


def first_vectors(rows: DataFrame, entries: int, parts: int) -> list[Row]:
    """The usable vectors with the smallest ids, at most `entries`; equal ids in the order of the vectors."""
    fine = F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % parts == 0)
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = rows.where(fine).where(~odd).orderBy(F.asc_nulls_last("vec_id"), "vector").select("vec_id", "vector")
    return found.limit(entries).collect()


def laid_out(rows: DataFrame, dims: int, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """Groups of usable vectors with their blocks, part position by part position."""
    kind = rows.schema["label"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[tuple[pa.Array, pa.Array, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            points = np.concatenate([h[2] for h in held]).reshape(-1, parts, dims // parts)
            columns = [pa.concat_arrays([h[i] for h in held]) for i in (0, 1)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            blocks = packed([Layout.of(points[:, p]) for p in range(parts)])
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([dims], pa.int32()), *lists, *(pa.array([b], pa.binary()) for b in blocks)],
                names=["dims", "ids", "labels", "points", "origin", "low", "high", "sums"],
            )

        for batch in batches:
            found, values = usable(batch.column(2), dims)
            for at in range(0, len(found), GROUP):
                some = pa.array(found[at : at + GROUP])
                held.append((batch.column(0).take(some), batch.column(1).take(some), whole_numbers(values[at : at + GROUP], scale)))
                if sum(len(h[0]) for h in held) >= GROUP:
                    yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(run, LAID.format(label=kind.simpleString()))


def _layouts(batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.Scalar, pa.Scalar, list[Layout]]]:
    forget()
    for batch in batches:
        for i in range(batch.num_rows):
            dims, ids, labels, *found = (c[i] for c in batch.columns)
            yield ids, labels, unpacked(len(ids.values), dims.as_py(), parts, [f.as_py() for f in found])


def next_codebooks(groups: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry moved to the floored mean of the parts nearest to it; entries without any stay.

    A task sends one row per entry and component; as many come to the driver as the codebooks have numbers.
    """
    parts, k, d = books.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, d), np.int64)
        for _, _, layouts in _layouts(batches, parts):
            for p, layout in enumerate(layouts):
                n, sums = tallies(layout, books[p])
                count[p] += n
                total[p] += sums
        p, e, at = (a.ravel() for a in np.indices(books.shape))
        used = count[p, e] > 0
        columns = [p[used], e[used], at[used], count[p, e][used], total.ravel()[used]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["p", "e", "at", "n", "total"])

    found = groups.mapInArrow(run, "p long, e long, at long, n long, total long")
    exact = F.sum(F.col("total").cast("decimal(38,0)"))
    new = books.copy()
    for r in found.groupBy("p", "e", "at").agg(F.sum("n").alias("n"), exact.alias("total")).collect():
        new[r.p, r.e, r.at] = int(r.total) // r.n
    return new


def coded(groups: DataFrame, books: np.ndarray, label_type: str) -> DataFrame:
    """`vec_id`, `label`, `code` (two hex digits a part) and `error` of every vector."""
    parts = len(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, layouts in _layouts(batches, parts):
            n = len(ids.values)
            codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            for p, layout in enumerate(layouts):
                code, distance = nearest(layout, books[p], False)
                codes[layout.origin, p] = code
                error[layout.origin] += distance
            text = codes.tobytes().hex()
            width = 2 * parts
            yield pa.RecordBatch.from_arrays(
                [ids.values, labels.values, pa.array([text[i * width : (i + 1) * width] for i in range(n)]), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    return groups.mapInArrow(run, f"vec_id long, label {label_type}, code string, error long")


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codebooks(groups: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The entries after `rounds` rounds: an array part, entry, component."""
    books = start
    for _ in range(rounds):
        books = next_codebooks(groups, books)
    return books


def compressed(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """`vec_id`, `label`, `code`, `error`, `label_error` and `codebooks_sha256` of every usable vector.

    Null vectors, and vectors with null or non-finite components, are dropped; so
    are those whose length differs from that of the usable vector with the
    smallest id, or is no multiple of `parts`. Components must be below
    2**28 / `scale` in size, else the job ends with an error. `entries` is at most
    256. Repeated ids and rows are coded one by one; null ids come last where
    the first entries are chosen. Equal labels, nulls together, share their sum of
    errors. An empty table gives an empty result; other columns are left out.
    """
    rows = picked(vectors, vec_id=F.col(f"`{id_col}`").cast("long"), label=label_col, vector=vector_col)
    label_type = rows.schema["label"].dataType.simpleString()
    first = first_vectors(rows, entries, parts)
    dims = len(first[0].vector) if first else parts
    first = [r.vector for r in first if len(r.vector) == dims]
    groups = written(laid_out(rows, dims, parts, scale), "laid")
    start = whole_numbers(np.array(first, np.float64).reshape(-1, parts, dims // parts), scale).transpose(1, 0, 2)
    books = codebooks(groups, np.ascontiguousarray(start), rounds)
    codes = written(coded(groups, books, label_type), "codes")
    by_label = written(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    return join_on(codes, by_label, ["label"], "left").withColumn("codebooks_sha256", F.lit(codebooks_digest(books)))
