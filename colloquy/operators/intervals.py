"""Interval joins between segments, turns and audio regions of an episode.

Two plans cover the need:

* the best or the total partner per interval is a plane sweep. Intervals and
  turns go, as one table, to time bins of an episode and are sorted by where they
  begin. A task walks along them, some thousand rows at a time, and carries only
  what is still open; whatever overlaps in a stretch is compared in arrays, and one
  row per interval (and speaker) leaves the task. Equal intervals are merged first,
  so copies cost nothing. The few intervals that cross very many bins go only to
  bins in which something of the other side begins.
* a total overlap per group needs no pairs at all. With C(t) the covered time
  of all regions up to t, a segment's overlap is C(end) - C(start), and C comes
  from running sums over the region edges.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.numeric import round_ratio
from colloquy.operators.blocks import TIME_BITS, Run, join_on, with_running
from colloquy.operators.filters import drop_unknown_speaker, positive_length, voiced_gender_only

BIN_BITS = 18  # about four minutes
# Bins from which an interval goes only where something of the other side begins.
FAR = 64
# Rows of a stretch of the sweep, and pairs that are compared at a time.
STRETCH = 1 << 16
AT_ONCE = 1 << 20

ROW = ["episode_id", "bin", "at", "a", "b", "__idx", "__spk", "__copies"]


def _bin(at: Column) -> Column:
    return F.shiftright(at, BIN_BITS)


def _cells(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows for each bin that an interval (a, b) crosses; for the far ones, its first bin and those where others begin."""
    first, last = _bin(F.col("a")), _bin(F.col("b") - 1)
    is_far = last - first >= FAR
    near = df.withColumn("bin", F.explode(F.sequence(first, F.when(is_far, first).otherwise(last))))
    begins = other.select(F.col("episode_id").alias("__ep"), _bin(F.col("a")).alias("bin")).distinct()
    crossed = F.col("episode_id").eqNullSafe(F.col("__ep")) & (F.col("bin") > first) & (F.col("bin") <= last)
    return near.unionByName(df.filter(is_far).join(begins, crossed).drop("__ep"))


class _Stretch:
    """Sorted rows of the sweep as arrays; `fresh` tells rows from those carried over."""

    def __init__(self, rows: pa.Table, carried: int):
        self.rows = rows
        codes = rows["episode_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        bins, at, a, b, copies = (rows[c].to_numpy() for c in ("bin", "at", "a", "b", "__copies"))
        new = np.concatenate(([True], (codes[1:] != codes[:-1]) | (bins[1:] != bins[:-1])))
        self.group = np.cumsum(new) - 1
        base = bins << BIN_BITS
        # places inside the bin, group after group on one axis
        axis = self.group << (BIN_BITS + 1)
        self.begin, self.end = axis + at - base, axis + np.minimum(b - base, 1 << BIN_BITS)
        self.a, self.b, self.base, self.copies = a, b, base, copies
        self.fresh = np.arange(len(a)) >= carried
        self.probes, self.turns = np.flatnonzero(copies == 0), np.flatnonzero(copies > 0)

    def open_rows(self) -> pa.Array:
        """Rows that reach beyond the last one's begin."""
        return pa.array(np.flatnonzero((self.group == self.group[-1]) & (self.end > self.begin[-1])))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Overlapping rows (probe, turn, overlap), all of a probe together.

        A pair belongs to the bin where the later of the two begins, and to the
        stretch that first has both.
        """
        p, t = self.probes, self.turns
        if not len(p) or not len(t):
            return
        furthest = np.maximum.accumulate(self.end[t])
        lo = np.searchsorted(furthest, self.begin[p], side="right")
        hi = np.searchsorted(self.begin[t], self.end[p], side="left")
        n = np.maximum(hi - lo, 0)
        upto = np.cumsum(n)
        at = 0
        while at < len(p):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, side="right")))
            size = n[at:stop]
            i = np.repeat(p[at:stop], size)
            within = np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
            j = t[np.repeat(lo[at:stop], size) + within]
            later = np.maximum(self.a[i], self.a[j])
            ov = np.minimum(self.b[i], self.b[j]) - later
            keep = (ov > 0) & (later >= self.base[i]) & (self.fresh[i] | self.fresh[j])
            yield i[keep], j[keep], ov[keep]
            at = stop


def _heads(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else values


def _best_turns(s: _Stretch, i: np.ndarray, j: np.ndarray, ov: np.ndarray, idx: np.ndarray, _) -> tuple:
    """The turn that overlaps most, by probe; of equal ones that with the smaller index."""
    order = np.lexsort((idx[j], -ov, i))
    first = order[_heads(i[order])]
    return i[first], j[first], idx[j[first]], ov[first]


def _speaker_sums(s: _Stretch, i: np.ndarray, j: np.ndarray, ov: np.ndarray, idx: np.ndarray, code: np.ndarray) -> tuple:
    """The summed overlap and the smallest index, by probe and speaker."""
    order = np.lexsort((idx[j], code[j], i))
    i, j, ov = i[order], j[order], (ov * s.copies[j])[order]
    heads = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (code[j[1:]] != code[j[:-1]]))))
    return i[heads], j[heads], idx[j[heads]], np.add.reduceat(ov, heads)


def _sweep(found, out: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        carried, size = None, 0

        def walk() -> Iterator[pa.RecordBatch]:
            nonlocal carried
            parts = [pa.Table.from_batches(held)]
            if carried is not None:
                parts.insert(0, carried)
            rows = pa.concat_tables(parts).combine_chunks()
            s = _Stretch(rows, len(rows) - sum(len(h) for h in held))
            idx = rows["__idx"].to_numpy()
            code = rows["__spk"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for i, j, ov in s.pairs():
                if len(i):
                    probe, turn, first, total = found(s, i, j, ov, idx, code)
                    take = pa.array(probe)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(rows[c].combine_chunks().take(take) for c in ("episode_id", "a", "b")),
                            rows["__spk"].combine_chunks().take(pa.array(turn)), pa.array(first), pa.array(total),
                        ],
                        names=out,
                    )
            carried = rows.take(s.open_rows())

        for batch in batches:
            if len(batch):
                held.append(batch)
                size += len(batch)
            if size >= STRETCH:
                yield from walk()
                held.clear()
                size = 0
        if held:
            yield from walk()

    return run


def overlapping(probes: DataFrame, turns: DataFrame, per_speaker: bool) -> DataFrame:
    """Overlaps of `probes(episode_id, a, b)` with `turns(episode_id, a, b, __spk, __idx, __copies)`.

    Rows (episode_id, s0, s1, __spk, __idx, ov): an interval's best turn, or its sum
    for each speaker, in every bin and stretch where it has one. Intervals have
    positive length.
    """
    kind = turns.schema["__spk"].dataType.simpleString()
    none = F.lit(0).cast("bigint")
    asked = probes.select("*", none.alias("__idx"), F.lit(None).cast(kind).alias("__spk"), none.alias("__copies"))
    cells = _cells(asked, turns).unionByName(_cells(turns, probes))
    rows = cells.withColumn("at", F.greatest("a", F.shiftleft("bin", BIN_BITS))).select(*ROW)
    out = ["episode_id", "s0", "s1", "__spk", "__idx", "ov"]
    episode = turns.schema["episode_id"].dataType.simpleString()
    return (
        rows.repartition("episode_id", "bin")
        .sortWithinPartitions("episode_id", "bin", "at")
        .mapInArrow(
            _sweep(_speaker_sums if per_speaker else _best_turns, out),
            f"episode_id {episode}, s0 long, s1 long, __spk {kind}, __idx long, ov long",
        )
    )


def _distinct_intervals(df: DataFrame) -> DataFrame:
    return (
        positive_length(df)
        .select("episode_id", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
        .distinct()
    )


def _attach(df: DataFrame, best: DataFrame) -> DataFrame:
    keyed = best.withColumnsRenamed({"s0": "start_ms", "s1": "end_ms"})
    return join_on(df, keyed, ["episode_id", "start_ms", "end_ms"], "left", ["start_ms", "end_ms"])


def assign_speaker(segments: DataFrame, turns: DataFrame, min_overlap_ms: int = 100) -> DataFrame:
    """Add `assigned`: the speaker of the single turn that overlaps most.

    Of equal overlaps the earlier listed turn wins. Below the minimum the
    speaker is `Unknown`.
    """
    builds = (
        positive_length(turns)
        .groupBy("episode_id", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
        .agg(F.min_by("speaker", "turn_idx").alias("__spk"), F.min("turn_idx").alias("__idx"))
        .withColumn("__copies", F.lit(1).cast("bigint"))
    )
    pairs = overlapping(_distinct_intervals(segments), builds, per_speaker=False)
    best = pairs.groupBy("episode_id", "s0", "s1").agg(
        F.max_by("__spk", F.struct(F.col("ov"), -F.col("__idx"))).alias("__best"),
        F.max("ov").alias("overlap_ms"),
    )
    return (
        _attach(segments, best)
        .withColumn(
            "assigned",
            F.when(F.col("overlap_ms") >= min_overlap_ms, F.col("__best")).otherwise("Unknown"),
        )
        .withColumn("overlap_ms", F.coalesce("overlap_ms", F.lit(0)).cast("bigint"))
        .drop("__best")
    )


def assign_word_speakers(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Add `assigned`: the speaker with the largest summed overlap, else `Unknown`.

    Equal sums go to the speaker listed first.
    """
    builds = (
        positive_length(turns)
        .groupBy("episode_id", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"), F.col("speaker").alias("__spk"))
        .agg(F.min("turn_idx").alias("__idx"), F.count(F.lit(1)).alias("__copies"))
    )
    pairs = overlapping(_distinct_intervals(words), builds, per_speaker=True)
    best = (
        pairs.groupBy("episode_id", "s0", "s1", "__spk")
        .agg(F.sum("ov").alias("__ov"), F.min("__idx").alias("__idx"))
        .groupBy("episode_id", "s0", "s1")
        .agg(
            F.max_by("__spk", F.struct(F.col("__ov"), -F.col("__idx"))).alias("__best"),
            F.max("__ov").alias("overlap_ms"),
        )
    )
    return (
        _attach(words, best)
        .withColumn("assigned", F.coalesce("__best", F.lit("Unknown")))
        .withColumn("overlap_ms", F.coalesce("overlap_ms", F.lit(0)).cast("bigint"))
        .drop("__best")
    )


def _marks(df: DataFrame, sign: int, *columns: Column) -> DataFrame:
    """Both ends of each interval as (episode_id, t, w): `sign` at the start, the opposite at the end."""
    ends = F.array(
        *[
            F.struct(F.col(at).alias("t"), F.lit(w).cast("bigint").alias("w"))
            for at, w in (("start_ms", sign), ("end_ms", -sign))
        ]
    )
    return df.select("episode_id", *columns, F.explode(ends).alias("m")).select(
        "episode_id", *df.select(*columns).columns, "m.t", "m.w"
    )


def gender_overlap(segments: DataFrame, regions: DataFrame, speaker: str = "speaker") -> DataFrame:
    """Overlap in ms per (episode, speaker) with male and with female regions.

    Speakers without any overlap are absent. At time t the covered time is
    open * t - origin, with `open` the regions open at t and `origin` the sum of
    their edges; an edge at t itself adds nothing, so the order within one
    millisecond does not matter.
    """
    genders = ["male", "female"]
    voiced = positive_length(voiced_gender_only(regions))
    spoken = positive_length(drop_unknown_speaker(segments, speaker))
    none = F.lit(0).cast("bigint")

    edges = _marks(voiced, 1, F.col("gender"))
    edges = edges.groupBy("episode_id", "t").agg(
        *[F.sum(F.when(F.col("gender") == g, F.col("w")).otherwise(0)).cast("bigint").alias(f"d_{g}") for g in genders]
    )
    points = _marks(spoken, -1, F.col(speaker).alias("speaker"))
    points = points.groupBy("episode_id", "t", "speaker").agg(F.sum("w").alias("weight"))
    # unique order at one t: the edge first, then the speakers by name
    steps = edges.select(
        "episode_id", "t", F.lit(None).cast("string").alias("speaker"), none.alias("weight"), "d_male", "d_female"
    ).unionByName(points.select("episode_id", "t", "speaker", "weight", none.alias("d_male"), none.alias("d_female")))
    runs = [Run(f"open_{g}", "sum", F.col(f"d_{g}")) for g in genders]
    runs += [Run(f"origin_{g}", "sum", F.col(f"d_{g}") * F.col("t")) for g in genders]
    covered = with_running(steps, ["episode_id"], ["t", "speaker"], runs, TIME_BITS)
    return (
        covered.filter(F.col("speaker").isNotNull())
        .groupBy("episode_id", "speaker")
        .agg(
            *[
                F.sum(F.col("weight") * (F.col(f"open_{g}") * F.col("t") - F.col(f"origin_{g}"))).cast("bigint").alias(f"{g}_ms")
                for g in genders
            ]
        )
        .filter((F.col("male_ms") > 0) | (F.col("female_ms") > 0))
    )


def speaker_gender(overlaps: DataFrame, min_ratio: float = 0.60, strict: bool = False) -> DataFrame:
    """Gender per speaker from `gender_overlap`; `strict` asks for more than the ratio."""
    male, female = F.col("male_ms"), F.col("female_ms")
    total = male + female
    winner = F.greatest(male, female)
    ratio: Column = winner / total
    enough = ratio > min_ratio if strict else ratio >= min_ratio
    label = F.when(male >= female, "male").otherwise("female")
    return overlaps.select(
        "episode_id",
        "speaker",
        F.when(enough, label).otherwise("unknown").alias("gender"),
        (male / 1000).alias("male_time"),
        (female / 1000).alias("female_time"),
        (total / 1000).alias("total_gendered_time"),
        round_ratio(winner, total, 4).alias("confidence"),
    )
