"""Exact removal of repeated passages by a logarithmic family of sparse suffix arrays.

Wanted are all bytes covered by a 100-byte string that also starts earlier. Not
every suffix is indexed: of the 50-byte strings in each window of 100 bytes the
one with the least hash is its anchor, and neighbouring windows with one anchor
form a run. Windows with equal bytes have the same anchor at the same place, so
a suffix per run, taken as long as its windows reach (its context), is enough:

1. Every batch of texts gets its suffix array: the contexts of its runs in order
   of their fingerprint, each with its first place. Repeats inside the batch are
   settled there, so a passage that most texts share leaves a batch once.
2. The arrays go, by anchor, to index families. A new array is scanned against
   the levels of the family for equal contexts, the later place of two is
   repeated; what is new becomes a level, and levels of like size merge.
3. Where one anchor has several contexts, some windows of a run may be repeated
   and others not. Only for those runs the windows themselves, as suffixes of 100
   bytes, go through the same two steps.

Order is (id, part, row, position). Contexts and windows are compared by 96 bits
of a 128-bit fingerprint.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.runtime import batches, forget, once_per_process, open_store, picked, written
from colloquy.session import scratch_path

WINDOW = 100
ANCHOR = 50
# Bytes that are hashed at a time, and bytes of texts that form a batch.
BUFFER = 1 << 20
BATCH = 8 << 20
BUCKETS_PER_TASK = 4
# Bytes of text whose claims one task takes in, about; more text makes more tasks.
TASK_BYTES = 64 << 20
LAST = np.iinfo(np.int64).max

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MIX = _U(0xD6E8FEB86659FD93)

DUPLICATE, PARTIAL, CLAIM = 0, 1, 2


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as planes of bytes, without the leading bytes that are zero in all rows.

    Signed numbers are stored as differences from the least one. Planes of like
    bytes also compress well on their way to other tasks.
    """
    n = len(columns[0])
    out = [struct.pack("<IB", n, len(columns))]
    for c in columns:
        hashes = c.dtype == _U
        base = 0 if hashes or not n else int(c.min())
        plain = np.ascontiguousarray(c if hashes else (c - np.int64(base)).view(_U))
        width = (int(plain.max()).bit_length() + 7) // 8 if n else 0
        out.append(struct.pack("<?qB", hashes, base, width))
        out.append(plain.view(np.uint8).reshape(n, 8)[:, :width].T.tobytes())
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    """The columns of `pack`: hashes as unsigned, all others as signed 64-bit numbers."""
    n, many = struct.unpack_from("<IB", data)
    at, out = 5, []
    for _ in range(many):
        hashes, base, width = struct.unpack_from("<?qB", data, at)
        plain = np.zeros((n, 8), np.uint8)
        plain[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 10).reshape(width, n).T
        found = plain.view(_U)[:, 0]
        out.append(found if hashes else found.view(np.int64) + np.int64(base))
        at += 10 + n * width
    return out


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte, powers of the base and of its inverse."""
    n = BUFFER + WINDOW + 1

    def powers(base: int) -> np.ndarray:
        out = np.full(n, _U(base))
        out[0] = 1
        return np.multiply.accumulate(out)

    letters = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], _U)
    return letters, powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def runs(buffer: np.ndarray, starts: np.ndarray, stops: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts laid end to end at starts..stops.

    Text number, first window, number of windows after it, hash of the anchor.
    """
    letters, powers, inverse = once_per_process(("passage tables", BUFFER), _tables)
    n = len(buffer)
    whole = np.flatnonzero(stops - starts >= window)
    none = np.zeros(0, np.int64)
    if not len(whole):
        return none, none, none, none.astype(_U)
    sums = np.zeros(n + 1, _U)
    np.cumsum(letters[buffer] * powers[:n], out=sums[1:])
    hashes = (sums[anchor:] - sums[:-anchor]) * inverse[: n - anchor + 1]
    hashes ^= hashes >> _U(31)
    hashes *= _MIX
    # least hash, then leftmost: the place fills the low bits
    least = (hashes & ~_U(0xFFFFFF)) | np.arange(len(hashes), dtype=_U)
    width, have = window - anchor + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: have - width], least[width - have :])
    place = (least & _U(0xFFFFFF)).astype(np.int64)
    sizes = stops[whole] - starts[whole] - window + 1
    text = np.repeat(whole, sizes)
    at = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[text]
    own = place[at]
    first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (text[1:] != text[:-1]))))
    length = np.diff(np.concatenate((first, [len(text)])))
    return text[first], at[first], length - 1, hashes[own[first]]


@dataclass
class Claims:
    """Suffixes of one batch: 40 bits of the anchor's hash, fingerprint (64 and 32 bits), and place."""

    anchor: np.ndarray
    high: np.ndarray
    low: np.ndarray
    doc: np.ndarray
    part: np.ndarray
    row: np.ndarray
    start: np.ndarray
    more: np.ndarray

    def take(self, which: np.ndarray) -> Claims:
        return Claims(*(c[which] for c in self.columns()))

    def columns(self) -> list[np.ndarray]:
        return [self.anchor, self.high, self.low, self.doc, self.part, self.row, self.start, self.more]

    def __len__(self) -> int:
        return len(self.high)

    @staticmethod
    def joined(parts: list[Claims]) -> Claims:
        return Claims(*(np.concatenate(c) for c in zip(*(p.columns() for p in parts))))


def earlier(a: Claims, i: np.ndarray, b: Claims, j: np.ndarray) -> np.ndarray:
    """Whether places a[i] come before places b[j]."""
    out = np.zeros(len(i), bool)
    same = np.ones(len(i), bool)
    for x, y in ((a.doc, b.doc), (a.part, b.part), (a.row, b.row), (a.start, b.start)):
        out |= same & (x[i] < y[j])
        same &= x[i] == y[j]
    return out


def suffix_array(found: Claims) -> tuple[Claims, Claims]:
    """Claims that come in order of their place: those first of their fingerprint, in its order; and all others."""
    order = np.argsort(found.high, kind="stable")
    found = found.take(order)
    if not len(found):
        return found, found
    same = found.high[1:] == found.high[:-1]
    if (same & (found.low[1:] != found.low[:-1])).any():
        found = found.take(np.lexsort((found.start, found.row, found.part, found.doc, found.low, found.high)))
        same = (found.high[1:] == found.high[:-1]) & (found.low[1:] == found.low[:-1])
    first = np.concatenate(([True], ~same))
    return found.take(first), found.take(~first)


class IndexFamily:
    """Suffix arrays of geometrically growing size; a fingerprint is in one of them, at its first place."""

    def __init__(self):
        self.levels: list[Claims] = []

    def add(self, new: Claims) -> list[Claims]:
        """Scan a suffix array against all levels and take it in; the claims that turn out to repeat."""
        repeated = []
        for level in self.levels:
            i, j = self._equal(new, level)
            if not len(i):
                continue
            newer_first = earlier(new, i, level, j)
            # the level keeps the first place, the other one is repeated
            repeated += [level.take(j[newer_first]), new.take(i[~newer_first])]
            for old, fresh in zip(level.columns()[3:], new.columns()[3:]):
                old[j[newer_first]] = fresh[i[newer_first]]
            rest = np.ones(len(new), bool)
            rest[i] = False
            new = new.take(rest)
        if len(new):
            self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            merged = Claims.joined([self.levels.pop(), self.levels.pop()])
            self.levels.append(merged.take(np.lexsort((merged.low, merged.high))))
        return repeated

    @staticmethod
    def _equal(new: Claims, level: Claims) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places with equal fingerprints, by a scan along both orders."""
        at = np.searchsorted(level.high, new.high)
        waiting = np.arange(len(new))
        found_i, found_j = [], []
        while len(waiting):
            inside = at[waiting] < len(level)
            waiting = waiting[inside]
            waiting = waiting[level.high[at[waiting]] == new.high[waiting]]
            hit = level.low[at[waiting]] == new.low[waiting]
            found_i.append(waiting[hit])
            found_j.append(at[waiting[hit]])
            waiting = waiting[~hit]
            at[waiting] += 1
        return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (at[:0], at[:0])

    def all(self) -> Claims | None:
        return Claims.joined(self.levels) if self.levels else None


def shared_anchor(found: Claims) -> np.ndarray:
    """Which claims share their anchor with another claim."""
    order = np.argsort(found.anchor, kind="stable")
    key = found.anchor[order]
    same = key[1:] == key[:-1]
    out = np.zeros(len(key), bool)
    out[order] = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(key) else out
    return out


def two_per_anchor(found: Claims, among: np.ndarray) -> np.ndarray:
    """All claims outside `among`, and the first two of each anchor inside."""
    order = np.argsort(found.anchor, kind="stable")
    key = found.anchor[order]
    third = np.zeros(len(key), bool)
    third[2:] = (key[2:] == key[1:-1]) & (key[1:-1] == key[:-2])
    out = np.ones(len(key), bool)
    out[order[third]] = False
    return out | ~among


class _Texts:
    """The rows of one written part, in batches of bounded size, each in order of id and row."""

    def __init__(self, file: str, columns: list[str]):
        files, path = open_store(file)
        self.source, self.columns = files.open_input_file(path), columns

    def __iter__(self) -> Iterator[list[tuple]]:
        held, size, row = [], 0, 0
        for part in pq.ParquetFile(self.source).iter_batches(batch_size=256, columns=self.columns):
            for values in zip(part.column(0).to_pylist(), part.column(1), *(part.columns[2:])):
                text = (values[1].as_py() or "").encode()
                held.append((LAST if values[0] is None else values[0], row, text, *values[2:]))
                size += len(text)
                row += 1
                if size >= BATCH:
                    yield sorted(held, key=itemgetter(0, 1))
                    held, size = [], 0
        if held:
            yield sorted(held, key=itemgetter(0, 1))
        self.source.close()


def _pieces(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Buffers of (text number, offset, bytes); a text over the buffer's size comes in overlapping slices."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), BUFFER - window):
            piece = text[at : at + BUFFER - 1]
            if held and size + len(piece) > BUFFER:
                yield held
                held, size = [], 0
            held.append((k, at, piece))
            size += len(piece)
    if held:
        yield held


def _fingerprints(slices: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, slices)), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1] >> _U(32)


def context_claims(part: int, rows: list[tuple], window: int, anchor: int) -> Claims | None:
    """A claim for the context of every run in a batch of (doc, row, text, ...)."""
    made = []
    texts = [r[2] for r in rows]
    doc, row = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    for pieces in _pieces(texts, window):
        data = b"".join(p[2] for p in pieces)
        stops = np.cumsum([len(p[2]) for p in pieces])
        starts = stops - [len(p[2]) for p in pieces]
        piece, first, more, key = runs(np.frombuffer(data, np.uint8), starts, stops, window, anchor)
        if not len(piece):
            continue
        high, low = _fingerprints(data[a:b] for a, b in zip(first.tolist(), (first + more + window).tolist()))
        number = np.array([p[0] for p in pieces])[piece]
        start = first - starts[piece] + np.array([p[1] for p in pieces])[piece]
        key = key >> _U(24)
        made.append(Claims(key, high, low, doc[number], np.full(len(key), part), row[number], start, more))
    return Claims.joined(made) if made else None


def window_claims(part: int, rows: list[tuple], wanted: dict[int, list[tuple[int, int]]], window: int) -> Claims | None:
    """A claim for every window of the wanted runs, by row: (first window, windows after it)."""
    made = []
    for doc, row, text, *_ in rows:
        for first, more in wanted.get(row, ()):
            made.append((doc, row, first, more, text))
    if not made:
        return None
    high, low = _fingerprints(t[i : i + window] for _, _, a, m, t in made for i in range(a, a + m + 1))
    doc, row, first, more = (np.array([m[i] for m in made], np.int64) for i in range(4))
    times = more + 1
    start = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - first, times)
    zero = np.zeros(len(start), np.int64)
    return Claims(zero.view(_U), high, low, np.repeat(doc, times), zero + part, np.repeat(row, times), start, zero)


# What tasks hand on: `to` is a part (places settled there) or a bucket (claims).
PARCEL = pa.schema([("kind", pa.int32()), ("to", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])
PARCEL_DDL = "kind int, to long, part long, data binary"


def _settled(kind: int, part: int, found: Claims) -> tuple:
    return kind, part, part, pack(found.row, found.start, found.more)


def _sent(part: int, found: Claims, buckets: int) -> Iterator[tuple]:
    """Claims of one batch, a parcel for each bucket: by anchor, or by fingerprint where there is none."""
    bucket = ((found.anchor if found.anchor.any() else found.high) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, bucket = found.take(order), bucket[order]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        c = found.take(slice(a, b))
        yield CLAIM, int(bucket[a]), part, pack(c.anchor, c.high, c.low, c.doc, c.row, c.start, c.more)


def _received(part: int, data: bytes) -> Claims:
    """A bucket's share of a suffix array; still in order."""
    anchor, high, low, doc, row, start, more = unpack(data)
    return Claims(anchor, high.copy(), low.copy(), doc, np.full(len(high), part), row, start, more)


def _by_part(kind: int, found: Claims) -> Iterator[tuple]:
    order = np.argsort(found.part, kind="stable")
    found = found.take(order)
    edges = np.flatnonzero(np.concatenate(([True], found.part[1:] != found.part[:-1], [True]))) if len(found) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield _settled(kind, int(found.part[a]), found.take(slice(a, b)))


def family_scan(parcels: DataFrame, buckets: int, partial: bool) -> DataFrame:
    """Take in all claims bucket by bucket; parcels with the repeated places, and with runs of shared anchors if `partial`.

    Parcels of places that are settled already are passed on.
    """

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()

        def rows() -> Iterator[tuple]:
            family, repeated = IndexFamily(), []
            for part in parts:
                for kind, to, sender, data in zip(*(c.to_pylist() for c in part.columns)):
                    if kind != CLAIM:
                        yield kind, to, sender, data
                        continue
                    repeated += [r for r in family.add(_received(sender, data)) if len(r)]
                    if sum(map(len, repeated)) > 200_000:
                        yield from _by_part(DUPLICATE, Claims.joined(repeated))
                        repeated = []
            if repeated:
                yield from _by_part(DUPLICATE, Claims.joined(repeated))
            left = family.all() if partial else None
            if left is not None:
                yield from _by_part(PARTIAL, left.take(shared_anchor(left)))

        yield from batches(rows(), PARCEL, sized=3)

    tasks = max(1, buckets // BUCKETS_PER_TASK)
    return parcels.repartition(tasks, "to").mapInArrow(run, PARCEL_DDL)


def _per_part(files: DataFrame, parcels: DataFrame, n_parts: int, work, schema: pa.Schema, ddl: str, sized: int) -> DataFrame:
    """Run `work(part, file, parcels of the part)` where each part and its parcels meet."""
    asked = files.select(F.lit(-1).alias("kind"), F.col("part").alias("to"), F.col("file").cast("binary").alias("data"))
    both = asked.union(parcels.select("kind", "to", "data"))

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            part, file, held = None, None, []
            for rows_in in parts:
                for kind, to, data in zip(*(c.to_pylist() for c in rows_in.columns)):
                    if kind == -1:
                        if file is not None:
                            yield from work(part, file, held)
                        part, file, held = to, data.decode(), []
                    else:
                        held.append((kind, data))
            if file is not None:
                yield from work(part, file, held)

        yield from batches(rows(), schema, sized=sized)

    # a task takes one part after the other; more tasks than that would only add shuffle blocks
    tasks = min(n_parts, 8 * files.sparkSession.sparkContext.defaultParallelism)
    return both.repartitionByRange(tasks, "to").sortWithinPartitions("to", "kind").mapInArrow(run, ddl)


def _places(held: list[tuple[int, bytes]], kind: int) -> dict[int, list[tuple[int, int]]]:
    out: dict[int, list[tuple[int, int]]] = {}
    for k, data in held:
        if k == kind:
            for row, start, more in zip(*(c.tolist() for c in unpack(data))):
                out.setdefault(row, []).append((start, more))
    return out


def spans(places: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by runs of windows (first window, windows after it)."""
    out: list[list[int]] = []
    for first, more in sorted(places):
        end = first + more + window
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def whole_characters(text: bytes, a: int, b: int) -> tuple[int, int]:
    """The part of bytes a..b that holds whole UTF-8 characters."""
    while a < b and text[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Iterable[str] = (),
    characters: bool = False,
) -> DataFrame:
    """Every text without the bytes covered by a `window`-byte string that also starts earlier.

    Earlier means a smaller id, or an earlier start in the same text; strings are
    judged on the input. Returns `doc_id`, `n_bytes`, `n_removed`, `n_spans` (maximal
    removed ranges), `kept` (remaining bytes) and the columns named in `keep` as
    `in_<name>`; others are left out. One output row per input row. Of rows with
    one id the order is fixed within the run; null ids come last; a null text has
    no bytes; texts shorter than `window` stay whole; an empty table gives an
    empty result. With `characters` a character goes only if all its bytes do, so
    that what is left is text.
    """
    spark, anchor, kept = docs.sparkSession, window // 2, list(keep)
    source = picked(docs, doc_id=id_col, text=text_col, **{f"in_{c}": c for c in kept})
    copy = scratch_path(spark, "passage-texts")
    source.write.option("compression", "zstd").parquet(copy)
    found = spark.read.schema(source.schema).parquet(copy).groupBy(F.input_file_name().alias("file"))
    found = found.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n_bytes"))
    files = written(found.select(F.xxhash64("file").alias("part"), "file", "n_bytes"), "passage-parts")
    n_parts = max(1, files.count())
    total = files.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = BUCKETS_PER_TASK * max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    nothing = spark.createDataFrame([], PARCEL_DDL)

    def index_part(part: int, file: str, _: list) -> Iterator[tuple]:
        for rows in _Texts(file, ["doc_id", "text"]):
            made = context_claims(part, rows, window, anchor)
            if made is None:
                continue
            first, again = suffix_array(made)
            several = shared_anchor(first)
            yield _settled(DUPLICATE, part, again)
            yield _settled(PARTIAL, part, first.take(several))
            yield from _sent(part, first.take(two_per_anchor(first, several)), buckets)

    def index_windows(part: int, file: str, held: list) -> Iterator[tuple]:
        wanted = {row: sorted(set(places)) for row, places in _places(held, PARTIAL).items()}
        for rows in _Texts(file, ["doc_id", "text"]) if wanted else ():
            made = window_claims(part, rows, wanted, window)
            if made is None:
                continue
            first, again = suffix_array(made)
            yield _settled(DUPLICATE, part, again)
            yield from _sent(part, first, buckets)

    names = [f.name for f in source.schema]
    arrow = {f.name: pa.field(f.name, _arrow(f.dataType.simpleString())) for f in source.schema if f.name not in ("doc_id", "text")}
    out = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
        + list(arrow.values())
    )
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary" + "".join(
        f", {f.name} {f.dataType.simpleString()}" for f in source.schema if f.name in arrow
    )

    def cut_part(part: int, file: str, held: list) -> Iterator[tuple]:
        repeated = _places(held, DUPLICATE)
        for rows in _Texts(file, names):
            for doc, row, text, *others in rows:
                gone = spans(repeated.get(row, []), window)
                if characters:
                    gone = [(a, b) for a, b in (whole_characters(text, *span) for span in gone) if a < b]
                at, left = 0, []
                for a, b in gone:
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                removed = sum(b - a for a, b in gone)
                yield (None if doc == LAST else doc, len(text), removed, len(gone), b"".join(left), *(o.as_py() for o in others))

    def parcels(asked: DataFrame, work) -> DataFrame:
        return _per_part(files, asked, n_parts, work, PARCEL, PARCEL_DDL, 3)

    settled = written(family_scan(parcels(nothing, index_part), buckets, partial=True), "passage-runs")
    asked = settled.where(F.col("kind") == PARTIAL)
    windows = written(family_scan(parcels(asked, index_windows), buckets, partial=False), "passage-windows")
    repeated = settled.union(windows).where(F.col("kind") == DUPLICATE)
    return _per_part(files, repeated, n_parts, cut_part, out, ddl, 4)


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))
