"""Incremental forms on Structured Streaming."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from colloquy.operators.blocks import join_on
from colloquy.operators.sequences import words_to_segments
from colloquy.operators.stats import merged_parts, speaker_parts, stats_of_parts

RANGE = re.compile(r"\d+-\d+")


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str) -> StreamingQuery:
    """Process what is there now; a later call with the same checkpoint takes only new input. The ended query."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(handle)
        .start()
    )
    query.awaitTermination()
    return query


def incremental_ingest(
    stream: DataFrame, is_good, good_path: str, error_path: str, checkpoint: str
) -> None:
    """Append new rows to the good table, failing ones to the error table.

    Each batch writes to its own folder and overwrites it, so a batch that is
    run again after a failure adds nothing twice.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        for condition, path in ((is_good, good_path), (~is_good, error_path)):
            batch.filter(F.coalesce(condition, F.lit(False))).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_available(stream, checkpoint, handle, "append")


def _file_system(spark: SparkSession, path: str):
    """The file system of `path` as Spark's own writers see it, and the path in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _ranges(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Fewest folders `first-last` that hold every batch written so far, each once."""
    files, root = _file_system(spark, path)
    if not files.exists(root):
        return []
    names = (status.getPath().getName() for status in files.listStatus(root))
    found = sorted((tuple(map(int, n.split("-"))) for n in names if RANGE.fullmatch(n)), key=lambda r: (r[0], -r[1]))
    chosen, following = [], 0
    for first, last in found:
        if first == following and files.exists(_file_system(spark, f"{path}/{first}-{last}/_SUCCESS")[1]):
            chosen.append((first, last))
            following = last + 1
    return chosen


def keep_speaker_stats(utterances: DataFrame, path: str, checkpoint: str, fan: int = 8) -> StreamingQuery:
    """Speaker statistics kept up to date as utterances arrive, however late. The ended query.

    The stream keeps no state. A batch writes partial rows of its own utterances to
    a folder `first-last` named after the batches in it; `fan` folders of one
    length are merged into one when the next batch comes, so a row is
    written again only once per power of `fan`, and `latest_speaker_stats` reads at
    most `fan` folders for each of these. A batch that is run again overwrites the same folders
    with the same rows. Folders that a longer one replaces stay for readers that
    began before; they may be removed at any time. The median form is batch only.
    """
    if fan < 2:
        raise ValueError("fan must be 2 or more")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, length = batch.sparkSession, 1
        while batch_id and batch_id % (length * fan) == 0:
            first = batch_id - length * fan
            steps = [f"{path}/{at}-{at + length - 1}" for at in range(first, batch_id, length)]
            merged_parts(spark.read.parquet(*steps)).write.mode("overwrite").parquet(f"{path}/{first}-{batch_id - 1}")
            length *= fan
        speaker_parts(batch).write.mode("overwrite").parquet(f"{path}/{batch_id}-{batch_id}")

    return run_available(utterances, checkpoint, handle, "append")


def latest_speaker_stats(spark: SparkSession, path: str) -> DataFrame:
    """Speaker statistics over all batches written so far, by the batch operator's own expressions."""
    chosen = _ranges(spark, path)
    if not chosen:
        raise FileNotFoundError(f"no batch has been written below {path}")
    return stats_of_parts(spark.read.parquet(*(f"{path}/{first}-{last}" for first, last in chosen)))


def gap_sessions(words: DataFrame, gap: str = "800 milliseconds", lateness: str = "1 minute") -> DataFrame:
    """Speech sessions per (episode, speaker) of a live word feed with event time `ts`.

    Spark's session window measures from start to start and other speakers do
    not end a session; `keep_gap_segments` is the exact rule.
    """
    return (
        words.withWatermark("ts", lateness)
        .groupBy("episode_id", "speaker", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_words"), F.max("end_ms").alias("end_ms"))
        .select("episode_id", "speaker", F.col("w.start").alias("session_start"), "n_words", "end_ms")
    )


WAITING = pa.schema(
    [("word_idx", pa.int64()), ("speaker", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("token", pa.string())]
)
PACKED_ROWS = 1 << 15
OPEN = "head_idx long, speaker string, start_ms long, end_ms long, text string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(words: pd.DataFrame) -> list[tuple]:
    """Words as Arrow bytes, one value for at most `PACKED_ROWS` of them."""
    pieces = []
    for at in range(0, len(words), PACKED_ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, WAITING) as out:
            out.write_batch(pa.RecordBatch.from_pandas(words.iloc[at : at + PACKED_ROWS], WAITING, preserve_index=False))
        pieces.append((sink.getvalue().to_pybytes(),))
    return pieces


def _unpacked(pieces: Iterator[tuple]) -> pd.DataFrame:
    """The words of all pieces, in their order."""
    tables = [pa.ipc.open_stream(piece).read_all() for (piece,) in pieces]
    return (pa.concat_tables(tables) if tables else WAITING.empty_table()).to_pandas()


class _GapSegments(StatefulProcessor):
    """Segments of one episode: words wait until none before them can come, a segment closes when none can follow.

    Each value of the state costs a call to the JVM, so the words of a frame wait as one.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "words binary")
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = frame[frame["whole"]]
            if len(frame):
                self.waiting.appendList(_packed(frame[WAITING.names]))
                self.handle.registerTimer(int(frame["start_ms"].max()) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        words = _unpacked(self.waiting.get())
        done = []
        due = words[words["start_ms"] < now].sort_values(["start_ms", "word_idx"], ignore_index=True)
        if len(due):
            later = words[words["start_ms"] >= now]
            if len(later):
                self.waiting.put(_packed(later))
            else:
                self.waiting.clear()
            done = self._joined(due)
            self.open.update(done.pop())
        if self.open.exists():
            last = tuple(self.open.get())
            if last[3] + self.gap_ms < now:
                done.append(last)
                self.open.clear()
            else:
                self.handle.registerTimer(int(last[3]) + self.gap_ms + 1)
        if done:
            columns = [f.split()[0] for f in OPEN.split(", ")]
            episode = None if key[0] else key[1]
            yield pd.DataFrame(done, columns=columns).assign(episode_id=episode)[["episode_id", *columns]]

    def _joined(self, due: pd.DataFrame) -> list[tuple]:
        """The open segment and the words in order, as segments; only the last one may go on."""
        if self.open.exists():
            head, *held = tuple(self.open.get())
            before = pd.DataFrame([(head, *held)], columns=due.columns)
            due = pd.concat([before, due], ignore_index=True)
        start, end, speaker = due["start_ms"].to_numpy(), due["end_ms"].to_numpy(), due["speaker"].to_numpy()
        cut = np.concatenate(([True], (speaker[1:] != speaker[:-1]) | (start[1:] - end[:-1] > self.gap_ms)))
        heads = np.flatnonzero(cut)
        stops = np.append(heads[1:], len(due))
        idx, token = due["word_idx"].to_numpy(), due["token"].tolist()
        return [
            (int(idx[a]), str(speaker[a]), int(start[a]), int(end[b - 1]), " ".join(token[a:b])) for a, b in zip(heads, stops)
        ]

    def close(self) -> None:
        pass


def gap_segments(words: DataFrame, gap_ms: int = 800, lateness: str = "1 minute") -> DataFrame:
    """Segments of a live word feed by the exact rule, each given out once when it is complete.

    `words(episode_id, word_idx, speaker, start_ms, end_ms, token, ts)`, `ts` being the
    time of `start_ms`. Words may come `lateness` out of order; they are joined in
    the order of their start. A word waits until the watermark has passed it, and a
    segment closes by a timer once the watermark is over the gap after its end, so
    the state holds what is in flight only and is empty after a pause. Words
    without speaker, start or end are left out; any such row with a later `ts` moves the
    feed on, and one far in the future ends it.
    """
    kind = words.schema["episode_id"].dataType.simpleString()
    whole = F.col("speaker").isNotNull() & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    # no NULL gets to pandas, which would make its whole column floating point
    unset = F.lit("" if kind == "string" else 0).cast(kind)
    rows = words.select(
        F.col("episode_id").isNull().alias("no_episode"), F.coalesce("episode_id", unset).alias("episode"), whole.alias("whole"),
        *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("word_idx", "start_ms", "end_ms")),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("speaker", "token")), "ts",
    )
    return rows.withWatermark("ts", lateness).groupBy("no_episode", "episode").transformWithStateInPandas(
        _GapSegments(gap_ms), f"episode_id {kind}, {OPEN}", "Append", "EventTime"
    )


def append_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now below `path`, a folder per batch, with the state in RocksDB. The ended query."""
    spark = stream.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    before = spark.conf.get(STATE_STORE)
    # a query copies the settings when it starts
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        return run_available(stream, checkpoint, handle, "append")
    finally:
        spark.conf.set(STATE_STORE, before)


FIELDS = ["episode_id", "head_idx", "speaker", "start_ms", "end_ms", "text"]


def keep_gap_segments(words: DataFrame, path: str, checkpoint: str, gap_ms: int = 800) -> None:
    """Segments of a word stream by the exact batch rule, below `path`.

    What is open at the end of a batch, one segment per episode, goes to a table
    of its own; the next batch takes it in as if it were a word. So a batch is cut
    by the batch operator, which splits long episodes, and the state has one row
    per episode. Words of an episode arrive in order from batch to batch. Batches
    overwrite their own folders, so one that is run again adds nothing.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select("episode_id", "word_idx", "speaker", "start_ms", "end_ms", "token")
        if batch_id:
            held = spark.read.parquet(f"{path}/open/batch={batch_id - 1}")
            new = new.unionByName(held.withColumnsRenamed({"head_idx": "word_idx", "text": "token"}))
        found = f"{path}/found/batch={batch_id}"
        words_to_segments(new, gap_ms).select(*FIELDS).write.mode("overwrite").parquet(found)
        rows = spark.read.parquet(found)
        last = rows.groupBy("episode_id").agg(F.max("head_idx").alias("head_idx")).withColumn("__open", F.lit(True))
        marked = join_on(rows, last, ["episode_id", "head_idx"], "left")
        for is_open, name in ((False, "closed"), (True, "open")):
            kept = marked.filter(F.col("__open").isNotNull() == is_open).drop("__open")
            kept.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

    run_available(words, checkpoint, handle, "append")


def all_gap_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments closed so far, and those open after the last batch: the end of the feed closes them."""
    still_open = spark.read.parquet(f"{path}/open")
    newest = still_open.agg(F.max("batch").alias("batch"))
    last = still_open.join(newest, "batch", "left_semi")
    return spark.read.parquet(f"{path}/closed").select(*FIELDS).unionByName(last.select(*FIELDS))
