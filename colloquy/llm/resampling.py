"""Importance resampling towards a target: documents drawn by how much their n-grams look like the target's.

A byte table lower-cases A to Z and blanks every separator of the UTF-8 text, so
`bytes.split` yields the words. The checksum of a run of words seeds that of the
run that is one word longer, so each n-gram costs one call. Counters of hash
buckets are reduced in the tasks and then by Spark; only one number per bucket
comes to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.runtime import forget, picked, written

LONGEST = 3
BUCKETS = 10_000
SEED = 42
MIN_WORDS = 20
PERCENT = 5
# Bytes of a text that are cut into words at a time, about.
BLOCK = 1 << 20
# Rows of a batch that goes to Python, so that whole texts stay few at a time.
TEXT_ROWS = 1000

# Letters in lower case, digits and bytes of characters beyond ASCII stay; all else separates words.
KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def blocks(text: bytes, size: int | None = None) -> Iterator[list[bytes]]:
    """The words of a text, block by block; a block ends at a separator only."""
    clean, size = text.translate(KEPT), size or BLOCK
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + size)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def features(text: bytes, longest: int = LONGEST, size: int | None = None) -> Iterator[tuple[int, list[int]]]:
    """Per block: number of its words, and the checksums of all runs of 1 to `longest` words that end in it."""
    open_runs: list[int] = []  # checksums of the runs that end with the block before, the shortest first
    for words in blocks(text, size):
        if not words:
            continue
        spaced = [b" " + w for w in words]
        runs, found, last = list(map(crc32, words)), [], []
        found += runs
        last.append(runs[-1])
        for k in range(1, longest):
            # a run of k words before each word; the first word may follow one of the block before
            seeds = open_runs[k - 1 : k] + runs[:-1]
            skip = len(spaced) - len(seeds)
            runs = list(map(crc32, spaced[skip:], seeds))
            found += runs
            if not runs:
                break
            last.append(runs[-1])
        open_runs = last
        yield len(words), found


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """`bucket`, `n`: how many n-grams of all texts fall into each bucket; a task sends one row per bucket at most."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total: Counter[int] = Counter()
        for part in parts:
            for text in part.column(0):
                for _, found in features(text.as_py() or b"", longest):
                    total.update([c % buckets for c in found])
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["bucket", "n"]
            )

    rows = picked(texts, text=F.col(f"`{text_col}`").cast("binary")).mapInArrow(run, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(
    docs: DataFrame, target: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS
) -> list[int]:
    """Thousandths of the log ratio of smoothed shares, target to documents, of every bucket; `buckets` numbers."""
    none = F.lit(0).cast("long")
    sides = bucket_counts(docs, text_col, longest, buckets).select("bucket", F.col("n").alias("s"), none.alias("t")).unionByName(
        bucket_counts(target, text_col, longest, buckets).select("bucket", none.alias("s"), F.col("n").alias("t"))
    )
    # one row per bucket at most, whatever the size of the tables
    found = {r.bucket: (r.s, r.t) for r in sides.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()}
    all_s, all_t = (float(sum(v[i] for v in found.values())) for i in (0, 1))

    def gain(s: int, t: int) -> int:
        return math.floor(1000 * math.log((t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets))))

    return [gain(*found.get(b, (0, 0))) for b in range(buckets)]


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel variate that depends on the id only."""
    place = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((place + 0.5) / 4294967296)))


def scored(
    docs: DataFrame, gains: Sequence[int], keep: Sequence[str] = (), longest: int = LONGEST, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """`doc_id`, `n_words`, `n_features`, `weight`, `score` of every whole text, and `keep` as `in_<name>`."""
    source = picked(
        docs, doc_id=F.col(f"`{id_col}`").cast("long"), text=F.col(f"`{text_col}`").cast("binary"), **{f"in_{c}": c for c in keep}
    )
    numbers = ["n_words", "n_features", "weight", "score"]
    gain, buckets = list(gains), len(gains)

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for part in parts:
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                words = n = weight = 0
                for more, found in features(text.as_py() or b"", longest):
                    words, n = words + more, n + len(found)
                    weight += sum([gain[c % buckets] for c in found])
                rows.append((words, n, weight, weight + noise(doc_id, seed)))
            columns = zip(*rows) if rows else [()] * len(numbers)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, pa.int64()) for c in columns), *part.columns[2:]],
                names=["doc_id", *numbers, *part.schema.names[2:]],
            )

    kept = [f"`in_{c}` {source.schema[f'in_{c}'].dataType.simpleString()}" for c in keep]
    return source.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} long" for n in numbers), *kept]))


def ranked(rows: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Add `rank` to a written table of scores: 1, 2, 3 ... for the highest scores, null for rows that are not drawn.

    No task sees the whole order: rows are sorted in ranges, and the rows before a
    range are known from the ranges' sizes.
    """
    long_enough = F.col("n_words") >= min_words
    # the row number ends all ties, so that repeated rows cannot crowd one range
    numbered = rows.where(long_enough).withColumn("_row", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    n = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranges = written(
        numbered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
        .withColumns({"_range": F.shiftright("_at", 33), "_place": n}).drop("_row", "_at"),
        "ranked",
    )
    # one row per range, so the driver holds as many numbers as there are partitions
    sizes = sorted((r[0], r[1]) for r in ranges.groupBy("_range").agg(F.max("_place")).collect())
    before, total = [], 0
    for number, size in sizes:
        before.append((number, total))
        total += size
    spark = rows.sparkSession
    starts = F.broadcast(spark.createDataFrame(before, "_range long, _before long"))
    rank = F.col("_before") + F.col("_place")
    drawn = percent * total // 100
    placed = ranges.join(starts, "_range").withColumn("rank", F.when(rank <= drawn, rank))
    others = rows.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(others.columns).unionByName(others)


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, longest: int = LONGEST,
    buckets: int = BUCKETS, seed: int = SEED, keep: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every document with `n_words`, `n_features`, `weight`, `score` and its `rank` among those drawn, else null.

    Of the documents with `min_words` words or more, `percent` in a hundred are
    drawn without replacement, by the sum of their n-grams' gains and a Gumbel
    variate of the id; equal scores go to the smaller id. `where("rank is not
    null")` is the sample; `keep` names input columns to pass on as `in_<name>`.

    Null and empty texts have no words, weight 0 and no rank. A null id has the
    variate of an empty id and comes after all others of its score. Repeated rows
    count and are ranked one by one. Texts of any length are cut into words in
    blocks, with runs carried over the cuts. Empty documents give an empty
    result; an empty target has equal shares in all buckets. Other columns are
    left out, so their names cannot clash.
    """
    gains = bucket_gains(docs, target, text_col, longest, buckets)
    rows = written(scored(docs, gains, keep, longest, seed, id_col, text_col), "scored", TEXT_ROWS)
    return ranked(rows, percent, min_words)
