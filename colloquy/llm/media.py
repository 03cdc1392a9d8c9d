"""Media columns: payloads in tar shards, addressed by their content.

A payload is stored as a grey 8-bit PNG of 192 samples a row, in a tar member
named by the payload's SHA-256. Rows carry digest, shard, offset and
length; a range read of a member's first bytes fills the metadata columns
without touching the samples.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.runtime import batches, forget, open_store, picked, shared_folder, written

ROW = 192
# Bytes of a PNG's signature and header chunk.
HEAD = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Bytes after which a task starts another shard.
SHARD_BYTES = 256 << 20
# Media bytes that one task reads back.
TASK_BYTES = 16 << 20


def payload_of(text: Column) -> Column:
    """UTF-8 bytes of a text, filled with blanks to a positive multiple of 192; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    size = F.octet_length(text)
    full = F.greatest(F.ceil(size / ROW), F.lit(1)) * ROW
    return F.concat(text, F.repeat(F.lit(" "), (full - size).cast("int"))).cast("binary")


def digest_of(payload: str | Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def png(payload: bytes) -> bytes:
    """The payload as a grey 8-bit image of 192 samples a row."""
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 9)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from an image's first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", head[16:26])


def png_payload(media: bytes) -> bytes:
    """The samples of an image written by `png`."""
    width, height, depth, colour = png_header(media[:HEAD])
    data, at = [], 8
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or rows[:, 0].any():
        raise ValueError("only unfiltered grey 8-bit images are read")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Size, mean sample in thousandths and a histogram of 16 bins."""
    samples = np.frombuffer(payload, np.uint8)
    bins = np.bincount(samples >> 4, minlength=16)
    return f"{ROW}x{len(samples) // ROW} mean={int(samples.sum(dtype=np.int64)) * 1000 // len(samples)} hist=" + ",".join(
        map(str, bins.tolist())
    )


class _Shard:
    """A tar file of one task's attempt, under a name of its own."""

    def __init__(self, folder: str):
        self.files, path = open_store(folder)
        self.name, self.at = f"shard-{uuid.uuid4().hex}.tar", 0
        self.sink = self.files.open_output_stream(f"{path}/{self.name}", compression=None)

    def add(self, digest: bytes, media: bytes) -> tuple[str, int, int]:
        member = tarfile.TarInfo(f"{digest.hex()}.png")
        member.size = len(media)
        head = member.tobuf(tarfile.GNU_FORMAT)
        self.sink.write(head + media + bytes(-len(media) % 512))
        place = self.name, self.at + len(head), len(media)
        self.at += len(head) + len(media) + -len(media) % 512
        return place

    def close(self) -> None:
        self.sink.write(bytes(1024))
        self.sink.close()


def store_media(docs: DataFrame, folder: str, text_col: str = "text") -> DataFrame:
    """Write the payloads to tar shards; the index: `digest` (SHA-256), `shard`, `offset`, `length`, one row per digest.

    Payloads are written by the task that reads them, each once per task, and
    never shuffled; of the places where a digest lies the index names one, found
    by a combined minimum over the small index rows. Copies that other tasks wrote
    are left without a reference. A shard is named anew by each attempt of a task,
    and the written index names only shards of attempts that succeeded.
    """
    entry = pa.schema([("digest", pa.binary()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[bytes] = set()
        shard = None
        for part in parts:
            found = []
            for digest, payload in zip(part.column(0).to_pylist(), part.column(1)):
                if digest in seen:
                    continue
                seen.add(digest)
                media = png(payload.as_py())
                if shard and shard.at >= SHARD_BYTES:
                    shard.close()
                    shard = None
                shard = shard or _Shard(folder)
                found.append((digest, *shard.add(digest, media)))
            yield from batches(found, entry)
        if shard:
            shard.close()

    payload = picked(docs, text=text_col).select(payload_of(F.col("text")).alias("payload"))
    ddl = "digest binary, shard string, offset long, length long"
    index = written(payload.select(digest_of("payload").alias("digest"), "payload").mapInArrow(run, ddl), "media-index", 1000)
    place = F.min(F.struct("shard", "offset", "length")).alias("place")
    return index.groupBy("digest").agg(place).select("digest", "place.*")


def spread_by_bytes(index: DataFrame, file: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Index rows dealt out in file order to as many tasks as the stored bytes call for."""
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    return index.repartitionByRange(tasks, file, "offset").sortWithinPartitions(file, "offset")


def ranges(part: pd.DataFrame, folder: str, file: str, limit: int | None = None) -> Iterator[bytes]:
    """The stored bytes of each row, or the first `limit` of them, by range reads."""
    files, path = open_store(folder)
    name, source = None, None
    for row_name, offset, length in zip(part[file], part["offset"], part["length"]):
        if row_name != name:
            if source:
                source.close()
            name, source = row_name, files.open_input_file(f"{path}/{row_name}")
        yield source.read_at(min(length, limit or length), offset)
    if source:
        source.close()


HEADERS = ("width", "height", "bit_depth")
FEATURES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
KINDS = dict.fromkeys(HEADERS, "int") | dict(zip(FEATURES, ("long", "binary", "long", "long", "binary", "string")))


def _headers(part: pd.DataFrame, folder: str) -> dict[str, list]:
    heads = [png_header(head) for head in ranges(part, folder, "shard", HEAD)]
    return {name: [head[i] for head in heads] for i, name in enumerate(HEADERS)}


def _features(part: pd.DataFrame, folder: str) -> dict[str, list]:
    found = []
    for media in ranges(part, folder, "shard"):
        payload = png_payload(media)
        found.append(
            (
                len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-16:]), len(media),
                hashlib.sha256(media).digest(), feature(payload),
            )
        )
    return {name: [f[i] for f in found] for i, name in enumerate(FEATURES)}


def with_metadata(index: DataFrame, folder: str, features: bool = True) -> DataFrame:
    """Metadata columns from reads of each member's first 33 bytes: `width`, `height`, `bit_depth`.

    With `features` the members are also read in full, and what they hold is
    added: size and SHA-256 of payload and stored form, tail checksum, feature.
    """
    names = [*HEADERS, *(FEATURES if features else ())]
    source = index.drop(*names)

    def read(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for at in range(0, len(whole), 1024):
                part = whole.iloc[at : at + 1024]
                yield part.assign(**_headers(part, folder), **(_features(part, folder) if features else {}))

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema] + [f"{n} {KINDS[n]}" for n in names]
    return source.mapInPandas(read, ", ".join(kinds))


def media_columns(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a media payload and return each row's reference, metadata and features.

    One output row per input row; repeated rows and equal texts share a member
    and have equal values; a null text counts as empty (one row of blanks); other
    columns are left out. An empty table gives an empty result. `folder` must be
    reachable by all executors; by default a new one in the shared scratch folder.
    """
    folder = folder or shared_folder(docs.sparkSession, "media")
    index = spread_by_bytes(store_media(docs, folder, text_col), "shard")
    stored = written(with_metadata(index, folder), "media-features")
    rows = picked(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        digest_of(payload_of(F.col("text"))).alias("digest"),
    )
    joined = rows.join(stored, "digest", "left")
    return joined.withColumns({c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")})
