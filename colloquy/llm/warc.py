"""WARC archives: writing, reading, and replacing repeated payloads by revisit records.

Records are gzip members of their own, so that one can be read by its offset
and length. Resolving revisits shuffles record headers by payload digest, never
payloads; the deduplicated archives are then written anew from the old ones.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.media import ranges, spread_by_bytes
from colloquy.llm.runtime import batches, forget, open_store, picked, shared_folder, written

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# The row a record comes from, kept in a field of its own.
ROW_ID = "X-Row-ID"
LEVEL = 1

INDEX = "row_id long, uri string, digest string, payload_bytes long, record_id string, file string, offset long, length long"


def now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _lines(fields: Iterable[tuple[str, object]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None)


def _uri(value: str | None) -> str | None:
    """A URI without the characters that would end a header line."""
    return None if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def record(
    kind: str, record_id: str, row_id: int | None, uri: str | None, digest: str, size: int, date: str,
    payload: bytes | None = None, refers_to: str | None = None,
) -> bytes:
    """One record as a gzip member; a revisit has the HTTP header of the response, but no payload."""
    http = b"HTTP/1.1 200 OK\r\n" + _lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)]) + b"\r\n"
    block = http + (payload or b"")
    head = VERSION + b"\r\n" + _lines(
        [
            ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{record_id}>"), ("WARC-Date", date),
            ("WARC-Target-URI", _uri(uri)), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
            ("WARC-Profile", PROFILE if kind == "revisit" else None),
            ("WARC-Refers-To", f"<urn:uuid:{refers_to}>" if refers_to else None), (ROW_ID, row_id),
            ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block)),
        ]
    )
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record fields, HTTP fields and payload of a gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(line.decode().split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.decode().split(": ", 1) for line in http.split(b"\r\n")[1:]), payload


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def _uuid(field: str | None) -> str | None:
    return field and field[len("<urn:uuid:") : -1]


class _Archive:
    """An archive of one task's attempt: a name of its own, so that attempts never write to one file."""

    def __init__(self, folder: str):
        self.files, self.path = open_store(folder)
        self.name, self.sink, self.at = f"part-{uuid.uuid4().hex}.warc.gz", None, 0

    def add(self, member: bytes) -> tuple[str, int, int]:
        self.sink = self.sink or self.files.open_output_stream(f"{self.path}/{self.name}", compression=None)
        self.sink.write(member)
        self.at += len(member)
        return self.name, self.at - len(member), len(member)

    def close(self) -> None:
        if self.sink:
            self.sink.close()


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None
) -> DataFrame:
    """A response record for every row, written where the row is read; the index of record headers."""
    date = date or now()
    schema = pa.schema(
        [("row_id", pa.int64()), ("uri", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64())]
        + [("record_id", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    )

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        archive = _Archive(folder)
        for part in parts:
            found = []
            for row_id, uri, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                payload = (html.as_py() or "").encode()
                digest, record_id = hashlib.sha1(payload).hexdigest(), str(uuid.uuid4())
                place = archive.add(record("response", record_id, row_id, uri, digest, len(payload), date, payload))
                found.append((row_id, uri, digest, len(payload), record_id, *place))
            yield from batches(found, schema)
        archive.close()

    return written(picked(pages, row_id=id_col, uri=url_col, html=html_col).mapInArrow(run, INDEX), "warc-index", 1000)


def resolve_revisits(index: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Which records repeat a payload: adds `refers_to`, the record id of the response, null for responses.

    Of records with equal payloads of `min_bytes` or more the one with the
    largest row id stays a response; of several with that id, one. The original
    of a digest is found by a combined maximum, then joined back, so many copies
    of one payload meet in no task (adaptive execution splits their rows).
    """
    originals = (
        index.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.max(F.struct("row_id", "record_id")).alias("original"))
        .select("digest", F.col("original.record_id").alias("refers_to"))
    )
    # written first: adaptive execution splits a large key only between two plain exchanges
    return index.join(written(originals, "warc-originals"), "digest", "left").withColumn(
        "refers_to", F.when(F.col("refers_to") != F.col("record_id"), F.col("refers_to"))
    )


def rewrite(resolved: DataFrame, source: str, folder: str, date: str | None = None) -> DataFrame:
    """Deduplicated archives with fresh headers; the index of where each record lies.

    Payloads of responses are copied by range reads from the archives in `source`;
    those of revisits are not read. Record ids stay, so references hold.
    """
    date = date or now()

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive = _Archive(folder)
        for part in parts:
            places: dict[int, tuple[str, int, int]] = {}
            part = part.reset_index(drop=True)
            again = part["refers_to"].notna()
            for i, member in zip(part.index[~again], ranges(part[~again], source, "file")):
                fields, _, payload = parsed(member)
                places[i] = archive.add(
                    record(
                        "response", _uuid(fields["WARC-Record-ID"]), fields.get(ROW_ID), fields.get("WARC-Target-URI"),
                        _hex(fields["WARC-Payload-Digest"]), len(payload), date, payload,
                    )
                )
            for i, row in zip(part.index[again], part[again].itertuples(index=False)):
                row_id = None if pd.isna(row.row_id) else int(row.row_id)
                uri = None if pd.isna(row.uri) else row.uri
                places[i] = archive.add(
                    record("revisit", row.record_id, row_id, uri, row.digest, row.payload_bytes, date, refers_to=row.refers_to)
                )
            yield pd.DataFrame([places[i] for i in part.index], columns=["file", "offset", "length"])
        archive.close()

    return written(spread_by_bytes(resolved, "file").mapInPandas(run, "file string, offset long, length long"), "warc-final")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Records as the archives hold them; payloads are checked against their digests.

    `row_id`, `record_id`, `record_type`, `payload_bytes`, `payload_digest` (hex)
    and `refers_to` (record id). For revisits size and digest are those of the
    full payload, from the record's header.
    """
    columns = ["row_id", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for member in ranges(part, folder, "file"):
                fields, http, payload = parsed(member)
                digest, size = _hex(fields["WARC-Payload-Digest"]), int(http["Content-Length"])
                kind = fields["WARC-Type"]
                if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
                row_id = fields.get(ROW_ID)
                rows.append(
                    (row_id and int(row_id), _uuid(fields["WARC-Record-ID"]), kind, size, digest, _uuid(fields.get("WARC-Refers-To")))
                )
            yield pd.DataFrame(rows, columns=columns).astype({"row_id": "Int64"})

    return spread_by_bytes(index, "file").mapInPandas(
        run, "row_id long, record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string"
    )


def deduplicated(
    pages: DataFrame, folder: str | None = None, min_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write pages as WARC, replace repeated payloads by revisits, and read the archives back.

    One row per input row: `row_id`, `payload_bytes`, `payload_digest`,
    `record_type`, `refers_to` (row id of the response). A null payload counts as
    empty; null ids rank below all others; a null or odd URL is no error; other
    columns are left out; an empty table gives no record. Of repeated rows one is
    the response, the others revisit it. `folder` must be reachable by all
    executors; by default a new one in the shared scratch folder.
    """
    spark = pages.sparkSession
    first, final = shared_folder(spark, "warc-all"), folder or shared_folder(spark, "warc")
    index = write_archives(pages, first, id_col, url_col, html_col)
    records = written(read_archives(rewrite(resolve_revisits(index, min_bytes), first, final), final), "warc-records")
    responses = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("row_id").alias("response_id")
    )
    return records.join(responses, "refers_to", "left").select(
        "row_id", "payload_bytes", "payload_digest", "record_type", F.col("response_id").alias("refers_to")
    )
