"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits, the lowest first. Level k holds the k-th
chunk of every id that has one, a bitmap telling whether the id goes on in the
next level, and a rank directory: the number of set bits before each block of
512. The place of an id's next chunk is the rank of its bit, so any token can be
read without decoding those before it.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.runtime import batches, once_per_process, open_store, picked, shared_folder, written
from colloquy.llm.wordtable import WordCodec, grouped

MAGIC = b"DAC1"
BLOCK_BITS = 512
# Ids after which a task closes its file and starts another.
FILE_IDS = 2_000_000

Read = Callable[[int, int], bytes]


def encoded(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray) -> bytes:
    """One file: header, document index and levels."""
    parts: list[bytes] = []
    levels = []
    at = 0

    def add(data: bytes) -> int:
        nonlocal at
        parts.append(data)
        at += len(data)
        return at - len(data)

    known = np.array([i is not None for i in doc_ids], bool)
    docs = {
        "count": len(doc_ids),
        "ids": add(np.array([i or 0 for i in doc_ids], "<i8").tobytes()),
        "known": add(np.packbits(known, bitorder="little").tobytes()),
        "starts": add(starts.astype("<i8").tobytes()),
    }
    rest = ids
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), BLOCK_BITS // 8), dtype=np.int64) if len(bits) else bits
        ranks = np.concatenate(([0], np.cumsum(blocks, dtype=np.int64)))
        levels.append(
            {
                "count": len(rest), "chunks": add(rest.astype(np.uint8).tobytes()),
                "bits": add(bits.tobytes()), "ranks": add(ranks.astype("<i8").tobytes()),
            }
        )
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    head = json.dumps({"docs": docs, "levels": levels}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


class TokenFile:
    """Random access to a file through `read(offset, length)`."""

    def __init__(self, read: Read):
        magic, size = struct.unpack("<4sI", read(0, 8))
        if magic != MAGIC:
            raise ValueError("not a token file")
        head = json.loads(read(8, size))
        self.base, self.docs, self.levels = 8 + size, head["docs"], head["levels"]
        self._read = read

    def _bytes(self, offset: int, length: int) -> bytes:
        return self._read(self.base + offset, length)

    def __len__(self) -> int:
        return self.levels[0]["count"]

    def documents(self) -> list[tuple[int | None, int, int]]:
        """Id, start and number of tokens of each document, in file order."""
        n = self.docs["count"]
        ids = np.frombuffer(self._bytes(self.docs["ids"], 8 * n), "<i8").tolist()
        known = np.unpackbits(
            np.frombuffer(self._bytes(self.docs["known"], -(-n // 8)), np.uint8), count=n, bitorder="little"
        ).tolist()
        starts = np.frombuffer(self._bytes(self.docs["starts"], 8 * (n + 1)), "<i8").tolist()
        return [(i if k else None, s, e - s) for i, k, s, e in zip(ids, known, starts, starts[1:])]

    def _rank(self, level: dict, i: int) -> int:
        """Set bits of a level before position i."""
        block = i // BLOCK_BITS
        (rank,) = struct.unpack("<q", self._bytes(level["ranks"] + 8 * block, 8))
        bits = self._bits(level, block * BLOCK_BITS, i)
        return rank + int(bits.sum())

    def _bits(self, level: dict, start: int, stop: int) -> np.ndarray:
        first = start // 8
        data = np.frombuffer(self._bytes(level["bits"] + first, -(-stop // 8) - first), np.uint8)
        return np.unpackbits(data, bitorder="little")[start - 8 * first : stop - 8 * first]

    def __getitem__(self, i: int) -> int:
        """Token i, from one chunk, one bit and one rank per level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for level in self.levels:
            value |= self._bytes(level["chunks"] + i, 1)[0] << shift
            if not self._bits(level, i, i + 1)[0]:
                break
            i, shift = self._rank(level, i), shift + 8
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Tokens start..stop; only the first needs a rank, those after it follow."""
        out = np.zeros(stop - start, np.uint32)
        where = None
        for k, level in enumerate(self.levels):
            if start >= stop:
                break
            chunk = np.frombuffer(self._bytes(level["chunks"] + start, stop - start), np.uint8).astype(np.uint32) << np.uint32(8 * k)
            more = self._bits(level, start, stop).astype(bool)
            if where is None:
                out[:] = chunk
                where = np.flatnonzero(more)
            else:
                out[where] |= chunk
                where = where[more]
            start = self._rank(level, start)
            stop = start + len(where)
        return out.astype("<u4")


MANIFEST = "part int, seq int, file string, n_docs long, n_ids long, size long"


def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the ids of all texts, each followed by `end_id`, in ascending id order; the manifest of the files.

    Rows are dealt out by ranges of the id and sorted inside a range; each task
    writes its files under names of its own attempt and hands back one manifest
    row for each. Null ids come first, rows of one id in the order of their text's
    hash; a null text counts as empty.
    """
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string())] + [(n, pa.int64()) for n in ("n_docs", "n_ids", "size")])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once_per_process(("words", tokenizer), lambda: WordCodec(tokenizer))
        files, path = open_store(folder)
        place, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = seq = 0

        def close() -> tuple:
            starts = np.concatenate(([0], *counts)).cumsum()
            data = encoded(np.concatenate(held), keys, starts)
            name = f"tokens-{attempt}-{seq:05d}.dac"
            with files.open_output_stream(f"{path}/{name}", compression=None) as sink:
                sink.write(data)
            return place, seq, name, len(keys), int(starts[-1]), len(data)

        for part in parts:
            for doc_ids, texts in grouped(part):
                ids, n = codec.encode(texts)
                keys += doc_ids
                held.append(np.insert(ids, np.cumsum(n), end_id))
                counts.append(n + 1)
                size += len(held[-1])
                if size >= FILE_IDS:
                    yield from batches([close()], schema)
                    keys, held, counts, size, seq = [], [], [], 0, seq + 1
        if keys:
            yield from batches([close()], schema)

    ordered = picked(docs, doc_id=id_col, text=text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(ordered.mapInArrow(run, MANIFEST), "token-manifest", 1000)


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds `first`, the number of ids in all files before; running sums over tasks, then over a task's files."""
    tasks = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # one row per writing task
    before = tasks.withColumn("before", F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).drop("ids")
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return manifest.withColumn("inside", inside).join(before, "part").withColumn("first", F.col("before") + F.col("inside"))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents as the files hold them: `doc_id`, `start` (ids of all documents before), `n_tokens`, `ids`.

    `ids` are little-endian unsigned 32-bit integers, read by random access.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_store(folder)

        def rows() -> Iterator[tuple]:
            for part in parts:
                for name, first, size in zip(*(c.to_pylist() for c in part.columns)):
                    with files.open_input_file(f"{path}/{name}") as source:
                        # all documents of the file are wanted: one read, then access in memory
                        data = source.read_at(size, 0)
                    found = TokenFile(lambda offset, length, data=data: data[offset : offset + length])
                    for key, start, n in found.documents():
                        yield key, first + start, n, found.tokens(start, start + n).tobytes()

        yield from batches(rows(), schema, sized=3)

    n_files = max(1, manifest.count())
    wide = with_starts(manifest).select("file", "first", "size").repartitionByRange(n_files, "first")
    return wide.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def stored_tokens(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the token files of `docs` and read them back; see `write_tokens` and `read_tokens`.

    One output row per input row, repeated rows included; other columns are left
    out; an empty table gives no file and no row. `folder` must be reachable by
    all executors; by default a new one in the shared scratch folder.
    """
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, tokenizer, folder, end_id, id_col, text_col), folder)


