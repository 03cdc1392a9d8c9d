"""Label rules that read their own earlier output.

The smoothed label of a row depends on smoothed labels before it, so a window
cannot express the rule. Yet the dependence is narrow: a row keeps its raw label
or takes one of a few labels near it. An episode is cut into blocks; every block
but the last is run once for each possible labelling of the rows just before it,
which gives a small table "labels before -> labels at the end". Following that
table from block to block yields the true labels before every block, and a
second run per block writes the result. No task ever sees more than a block.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import all_lines, line_list
from colloquy.operators.blocks import join_on, with_islands, with_row_number

# Rounds in which rows that cannot change are told from the others before the rule runs over the rest.
ROUNDS = 3


@dataclass(frozen=True)
class _Rows:
    """Rows of one or more blocks in order; labels are small integers, equal where the labels are."""

    label: np.ndarray
    block: np.ndarray
    place: np.ndarray
    total: np.ndarray
    fixed: np.ndarray

    def shifted(self, by: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value `by` rows on, and whether that row is of the same block."""
        moved, same = np.roll(values, -by), np.roll(self.block, -by) == self.block
        if by > 0:
            same[-by:] = False
        else:
            same[:-by] = False
        return moved, same


Rule = Callable[[_Rows], np.ndarray]


def _smooth(rows: _Rows, k: int, share: float) -> np.ndarray:
    """Labels after smoothing; the right neighbours of a block's last rows may follow it."""
    label = rows.label
    size = len(label)
    right = [rows.shifted(b, label) for b in range(1, min(k, size - 1) + 1)]
    n_left = np.minimum(k, rows.place)
    n_right = np.zeros(size, dtype=np.int64)
    for _, there in right:
        n_right += there
    needed = (n_left + n_right) * share
    open_rows = ~rows.fixed & (rows.place > 0) & (rows.place < rows.total - 1)
    # A row changes only to a label with `needed` votes. The votes of the right are
    # known; a row on the left votes for its raw label, or for any if it may change.
    votes = [sum(((there & (value == want)).astype(np.int64) for value, there in right), np.zeros(size, np.int64)) for want, _ in right]
    may = open_rows
    for _ in range(ROUNDS):
        found = open_rows & (n_left >= needed)
        left = [(*rows.shifted(-b, label), rows.shifted(-b, may)[0]) for b in range(1, min(k, size - 1) + 1)]
        for (want, there), vote in zip(right, votes):
            possible = vote.copy()
            for value, same, loose in left:
                possible += same & (loose | (value == want))
            found = found | (open_rows & there & (want != label) & (possible >= needed))
        may = found
    out = label.tolist()
    for j, before, after in zip(np.flatnonzero(may).tolist(), n_left[may].tolist(), n_right[may].tolist()):
        near = out[j - before:j] + out[j + 1:j + 1 + after]
        top = max(near, key=near.count)
        if top != out[j] and near.count(top) >= len(near) * share:
            out[j] = top
    return np.array(out, dtype=np.int64)


def _smooth_options(context: list[int], j: int, k: int, share: float) -> set[int]:
    """Labels row j can end up with, whatever came before it."""
    options = {context[j]}
    right = context[j + 1:j + 1 + k]
    for label in set(right):
        # the rows on the left can add at most k votes
        if right.count(label) + k >= (len(right) + k) * share:
            options.add(label)
    return options


def _unflicker(rows: _Rows) -> np.ndarray:
    """Third of a run A, B, A becomes B."""
    label = rows.label
    one, two, three = (rows.shifted(-b, label) if len(label) > b else (label, np.zeros(len(label), bool)) for b in (1, 2, 3))
    # Equal to its raw predecessor, a row stays as it is; so after three equal raw labels the next one stays too.
    steady = two[1] & three[1] & (one[0] == two[0]) & (two[0] == three[0])
    may = ~rows.fixed & (rows.place > 1) & (label != one[0]) & ~steady
    out = label.tolist()
    for j in np.flatnonzero(may).tolist():
        if out[j] == out[j - 2] and out[j] != out[j - 1]:
            out[j] = out[j - 1]
    return np.array(out, dtype=np.int64)


_BLOCK_COLUMNS = ["__ep", "__b", "__pos", "__raw", "__n", "__state", "__key"]


def _whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of whole blocks, from a partition that is sorted by episode, block and position."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        ids = batch[["__ep", "__b"]]
        start = int((ids == ids.iloc[-1]).all(axis=1).to_numpy().argmax())
        if start or (held and tuple(held[0][["__ep", "__b"]].iloc[0]) != tuple(ids.iloc[0])):
            yield pd.concat([*held, batch[:start]], ignore_index=True)
            held = []
        held.append(batch[start:])
    if held:
        yield pd.concat(held, ignore_index=True)


@dataclass(frozen=True)
class _Block:
    """One block of an episode: integer labels of the rows around and in it, and what they stand for."""

    begin: int
    own: int
    total: int
    context: list[int]
    body: np.ndarray
    names: list

    def run(self, rule: Rule, before: list[int], rows: int | None = None) -> np.ndarray:
        """New labels of the body, or its first `rows`, given the labels just before it."""
        body = self.body[:rows]
        size = len(before) + len(body)
        label = np.concatenate((np.array(before, dtype=np.int64), body))
        place = np.arange(self.begin - len(before), self.begin + len(body))
        done = rule(_Rows(label, np.zeros(size, np.int64), place, np.full(size, self.total), np.arange(size) < len(before)))
        return done[len(before):]


def _one_block(frame: pd.DataFrame, size: int) -> _Block:
    label, names = _coded(frame["__raw"])
    number, total = int(frame["__b"].iat[0]), int(frame["__n"].iat[0])
    begin = number * size
    cut = int(np.searchsorted(frame["__pos"].to_numpy(), begin))
    return _Block(begin, min(size, total - begin), total, label[:cut].tolist(), label[cut:], names)


def _coded(labels: pd.Series) -> tuple[np.ndarray, list]:
    """Labels as integers and the list they index; a NULL label is one like any other."""
    codes, names = pd.factorize(labels.to_numpy(dtype=object), use_na_sentinel=False)
    return codes.astype(np.int64), [None if pd.isna(name) else name for name in names]


def _per_block(spread: DataFrame, work, schema: T.StructType) -> DataFrame:
    """Apply `work` to the blocks; many small episodes share one call."""
    return (
        spread.repartition("__ep", "__b")
        .sortWithinPartitions("__ep", "__b", "__pos")
        .select(*_BLOCK_COLUMNS)
        .mapInPandas(work, schema)
    )


def _fold(
    df: DataFrame,
    order: str,
    label: str,
    out: str,
    block: int,
    memory: int,
    lookahead: int,
    rule: Rule,
    options: Callable[[list[int], int], set[int]],
) -> DataFrame:
    """Run a label rule with `memory` rows of its own output and `lookahead` raw rows.

    `options(context, j)` lists every label row j may end up with; one raw row
    before `memory` rows is available as context. Labels before and at the end of a
    block travel as JSON lists, so that any text can be a label.
    """
    if block < memory:
        raise ValueError(f"a block needs {memory} rows or more")
    left = memory + 1
    # a NULL episode is one of its own
    name = F.coalesce(F.concat(F.lit("="), F.col("episode_id").cast("string")), F.lit(""))
    rows = df.withColumn("__ep", name)
    numbered = with_row_number(rows, ["__ep"], order, "__rn").withColumn("__pos", F.col("__rn") - 1).drop("__rn")
    sizes = rows.groupBy("__ep").agg(F.count(F.lit(1)).alias("__n"))
    slim = numbered.select("__ep", "__pos", F.col(label).cast("string").alias("__raw"), F.col(order).alias("__key"))
    slim = slim.join(sizes, "__ep")

    home = F.floor(F.col("__pos") / block).cast("bigint")
    inside = F.pmod(F.col("__pos"), F.lit(block))
    last_block = F.floor((F.col("__n") - 1) / block).cast("bigint")
    targets = F.filter(
        F.array(
            home,
            F.when((inside >= block - left) & (home < last_block), home + 1),
            F.when((inside < lookahead) & (home > 0), home - 1),
        ),
        lambda b: b.isNotNull(),
    )
    copies = slim.withColumn("__last", last_block).withColumn("__b", F.explode(targets))
    id_field = T.StructField("__ep", T.StringType())

    def ends(b: _Block, start: list[int], own: int, rows: int | None = None) -> list[int]:
        return (start + b.run(rule, start, rows)[:own].tolist())[-memory:]

    def pairs(b: _Block) -> dict[str, str]:
        """Labels before the block to labels at its end, for every possible start."""
        whole = b.context + b.body[:lookahead + 1].tolist()
        near = range(max(0, len(b.context) - memory), len(b.context))
        starts = [list(s) for s in product(*[sorted(options(whole, j)) for j in near])]
        lead = starts[0]
        found = {tuple(lead): ends(b, lead, b.own)}
        for start in starts[1:]:
            # Two runs whose last labels agree somewhere agree from there on.
            reach, met = 64, False
            while reach < b.own and not met:
                met = ends(b, start, reach, reach + lookahead) == ends(b, lead, reach, reach + lookahead)
                reach *= 4
            found[tuple(start)] = found[tuple(lead)] if met else ends(b, start, b.own)
        text = lambda codes: json.dumps([b.names[c] for c in codes])
        return {text(start): text(end) for start, end in found.items()}

    def tabulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_blocks(batches):
            for (episode, number), members in frame.groupby(["__ep", "__b"], sort=False):
                found = pairs(_one_block(members, block))
                yield pd.DataFrame({"__ep": [episode], "__b": [number], "frm": [list(found)], "to": [list(found.values())]})

    labels_type = T.ArrayType(T.StringType())
    table_schema = T.StructType(
        [id_field, T.StructField("__b", T.LongType()), T.StructField("frm", labels_type), T.StructField("to", labels_type)]
    )
    unfinished = copies.filter(F.col("__b") < F.col("__last")).withColumn("__state", F.lit(None).cast("string"))
    tables = _per_block(unfinished, tabulate, table_schema)

    # Most tables end in the same labels from every start, so what precedes such
    # a block does not matter: a chain runs only from one of these to the next.
    # With one row per block left, a plain window over an episode's blocks will do.
    settled = F.size(F.array_distinct("to")) == 1
    tables = tables.withColumn("settled", settled)
    chained = with_islands(tables, ["__ep"], "__b", F.col("settled"), "chain", bits=())
    follow = F.aggregate(
        F.col("steps"),
        F.array().cast("array<string>"),
        lambda seen, s: F.array_append(
            seen,
            F.when(s["settled"], F.get(s["to"], F.lit(0))).otherwise(
                F.get(s["to"], (F.array_position(s["frm"], F.element_at(seen, -1)) - 1).cast("int"))
            ),
        ),
    )
    states = (
        chained.groupBy("__ep", "chain")
        .agg(F.sort_array(F.collect_list(F.struct("__b", "settled", "frm", "to"))).alias("steps"))
        .select("__ep", "chain", F.posexplode(follow).alias("__p", "__state"))
        .select("__ep", (F.col("chain") + F.col("__p") + 1).cast("bigint").alias("__b"), "__state")
    )

    def first_blocks(frame: pd.DataFrame) -> np.ndarray:
        """New labels of all rows of blocks that begin their episode, in one run of the rule."""
        codes, names = _coded(frame["__raw"])
        number = frame.groupby("__ep", sort=False).ngroup().to_numpy()
        place, total = frame["__pos"].to_numpy(), frame["__n"].to_numpy()
        done = rule(_Rows(codes, number, place, total, np.zeros(len(frame), bool)))
        return np.array(names, dtype=object)[done]

    def later_block(frame: pd.DataFrame) -> np.ndarray:
        b = _one_block(frame, block)
        names = list(b.names)
        before = []
        for name in json.loads(frame["__state"].iat[0]):
            if name not in names:
                names.append(name)
            before.append(names.index(name))
        done = np.concatenate((np.zeros(len(b.context), np.int64), b.run(rule, before)))
        return np.array(names, dtype=object)[done]

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_blocks(batches):
            parts = [frame[frame["__b"] == 0]]
            parts += [part for _, part in frame[frame["__b"] > 0].groupby(["__ep", "__b"], sort=False)]
            for part in parts:
                if len(part):
                    new = later_block(part) if part["__b"].iat[0] else first_blocks(part)
                    own = part["__pos"].floordiv(block) == part["__b"]
                    done = pd.DataFrame({"__ep": part["__ep"], order: part["__key"], out: pd.Series(new, part.index, dtype=object)})
                    yield done[own]

    done_schema = T.StructType([id_field, T.StructField(order, T.LongType()), T.StructField(out, T.StringType())])
    labelled = _per_block(copies.join(states, ["__ep", "__b"], "left"), finish, done_schema)
    return rows.join(labelled, ["__ep", order]).select(*df.columns, out)


def smooth_turns(
    turns: DataFrame, k: int = 3, share: float = 0.75, out: str = "smoothed", block: int = 65536
) -> DataFrame:
    """Give an isolated turn the label that holds `share` of its k neighbours each side.

    Neighbours on the left count with their smoothed label. The first and the
    last turn of an episode never change.
    """
    return _fold(
        turns, "turn_idx", "speaker", out, block, k, k,
        lambda rows: _smooth(rows, k, share),
        lambda context, j: _smooth_options(context, j, k, share),
    )


def fix_flicker(segments: DataFrame, out: str = "fixed", block: int = 65536) -> DataFrame:
    """In a run A, B, A the third label becomes B, judged on labels already fixed."""
    return _fold(
        segments, "seg_idx", "speaker", out, block, 2, 0, _unflicker,
        lambda context, j: {context[j], context[max(0, j - 1)]},
    )


def pack_lines(lengths: list[int], max_len: int, size: int = 0) -> list[tuple[int, int, int]]:
    """Chunks of lines as (first line, number of lines, offset in the line); hard cuts have 0 lines.

    `size` is what a chunk that is open before the first line holds already.
    """
    chunks, first = [], 0
    for i, length in enumerate(lengths):
        if length > max_len or size + length + 1 > max_len:
            if i > first:
                chunks.append((first, i - first, 0))
            first, size = i, 0
        if length > max_len:
            chunks += [(i, 0, at) for at in range(0, length, max_len)]
            first = i + 1
        else:
            size += length + 1
    if len(lengths) > first:
        chunks.append((first, len(lengths) - first, 0))
    return chunks


def _without_trail(line: Column) -> Column:
    return F.regexp_replace(line, "(?U)[\\s\\x1c-\\x1f]+$", "")


def chunk_lines(docs: DataFrame, max_len: int = 1200, text: str = "text") -> DataFrame:
    """Pack the lines of a text greedily into chunks of at most `max_len` characters.

    A line costs its length plus one. A longer line is cut hard, after what was
    collected so far. The fold sees the lengths of a text's lines only and takes
    one step per line; it needs no shuffle.
    """
    lines = F.transform(line_list(text), _without_trail)

    @F.arrow_udf("array<struct<first:int,n:int,at:int>>")
    def pack(lengths: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("at", pa.int32())]))
        rows = (None if row is None else pack_lines(row, max_len) for row in lengths.to_pylist())
        return pa.array([row and [dict(zip(("first", "n", "at"), c)) for c in row] for row in rows], type=kind)

    held = docs.withColumn("__lines", lines)
    cut = held.withColumn("__cuts", pack(F.transform("__lines", F.length)))
    chunk = F.transform(
        "__cuts",
        lambda c: F.when(c["n"] == 0, F.substr(F.get("__lines", c["first"]), c["at"] + 1, F.lit(max_len))).otherwise(
            F.array_join(F.slice("__lines", c["first"] + 1, c["n"]), "\n")
        ),
    )
    others = [c for c in docs.columns if c != text]
    return cut.select(*others, F.posexplode(chunk).alias("chunk_idx", "chunk"))


def carry_table(lengths: list[int], max_len: int) -> list[tuple[int, int, int]]:
    """What lines do to the chunk that is open before them, as (least size, size after, chunks begun).

    An entry holds for sizes from its own to the next one's; 0 means that no
    chunk is open. A size after of -1 stands for lines that all join the open
    chunk. Each line points to the line at which the next chunk would begin if
    one began at it; the pointers are doubled until they reach the last chunk.
    """
    n = len(lengths)
    if not n:
        return [(0, -1, 0)]
    length = np.asarray(lengths, np.int64)
    upto = np.concatenate(([0], np.cumsum(length + 1)))
    line = np.arange(n)
    far = length > max_len
    next_far = np.minimum.accumulate(np.where(far, line, n)[::-1])[::-1]
    follow = np.minimum(np.searchsorted(upto, upto[:-1] + max_len, "right") - 1, next_far)
    follow = np.where(far, line + 1, np.maximum(follow, line + 1))
    begun = np.where(far, -(-length // max_len), 1)
    # the last chunk points to itself and adds nothing
    jump = np.where(follow < n, follow, line)
    before = np.where(follow < n, begun, 0)
    while (jump[jump] != jump).any():
        before = before + before[jump]
        jump = jump[jump]
    after = np.where(far[jump], 0, upto[n] - upto[jump])
    total = before + begun[jump]
    # sizes of an open chunk from 1 to that of a line that fills one alone
    stop = np.searchsorted(upto, max_len - np.arange(1, max_len + 2), "right") - 1
    stop = np.minimum(np.maximum(stop, 0), next_far[0])
    at = np.minimum(stop, n - 1)
    out = np.where(stop < n, after[at], -1)
    made = np.where(stop < n, total[at], 0)
    new = np.concatenate(([True], (out[1:] != out[:-1]) | (made[1:] != made[:-1])))
    sizes = np.flatnonzero(new)
    table = [(0, int(after[0]), int(total[0]))]
    return table + [(int(i) + 1, int(out[i]), int(made[i])) for i in sizes]


def chunk_parts(
    parts: DataFrame, key: str = "doc_id", order: str = "offset", max_len: int = 1200, text: str = "text"
) -> DataFrame:
    """The chunks of `chunk_lines` for documents that come in parts: (`key`, chunk_idx, chunk).

    The texts of a key in order of the bigint `order`, unique within it, joined
    by newlines are the document. Every part yields a small table "size of the
    chunk open before it -> size after it, chunks begun"; one task follows the
    tables of a document, never its text. Then each part is cut on its own, and
    only a chunk's pieces, at most `max_len` characters, meet again. NULL keys are
    one document, a NULL text has no lines, other columns are left out.
    """
    lines = F.coalesce(all_lines(text), F.array().cast("array<string>"))
    # a break at a part's end is followed by one more, empty line unless the document ends there
    held = parts.select(
        key, F.col(order).cast("bigint").alias("__o"), F.transform(lines, _without_trail).alias("__lines"),
        F.coalesce(F.element_at(lines, -1) == "", F.lit(False)).alias("__ended"),
    )
    entry = T.StructType([T.StructField(c, T.LongType()) for c in ("size", "after", "begun")])

    @F.arrow_udf(T.ArrayType(entry))
    def table(lengths: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("size", pa.int64()), ("after", pa.int64()), ("begun", pa.int64())]))
        rows = [[dict(zip(("size", "after", "begun"), e)) for e in carry_table(row, max_len)] for row in lengths.to_pylist()]
        return pa.array(rows, type=kind)

    id_field = parts.schema[key]
    carried = T.StructType(
        [id_field, *(T.StructField(c, T.LongType()) for c in ("__o", "__size", "__begun")), T.StructField("__last", T.BooleanType())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, begun = None, 0, 0
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            kind = pa.schema([(f.name, f.type) for f in batch.schema if f.name != "table"])
            kind = kind.append(pa.field("__size", pa.int64())).append(pa.field("__begun", pa.int64()))
            kind = kind.append(pa.field("__last", pa.bool_()))
            for row in batch.to_pylist():
                if held is None or held != (row[key],):
                    held, size, begun = (row[key],), 0, 0
                for column, value in zip(columns, (row[key], row["__o"], size, begun, row["__o"] == row["__end"])):
                    column.append(value)
                e = [e for e in row["table"] if e["size"] <= size][-1]
                size = size + row["__sum"] if e["after"] < 0 else e["after"]
                begun += e["begun"]
            kind = pa.schema([f for f in kind if f.name not in ("__sum", "__end")])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

    lengths = F.transform("__lines", F.length)
    cost = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda total, n: total + n + 1)
    steps = held.select(key, "__o", table(lengths).alias("table"), cost.alias("__sum"))
    ends = parts.groupBy(key).agg(F.max(F.col(order).cast("bigint")).alias("__end"))
    steps = join_on(steps, ends, [key]).repartition(key).sortWithinPartitions(key, "__o")
    states = steps.select(key, "__o", "table", "__sum", "__end").mapInArrow(scan, carried)

    @F.arrow_udf("array<struct<first:int,n:int,at:int>>")
    def pack(lengths: pa.Array, sizes: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("at", pa.int32())]))
        rows = [pack_lines(row, max_len, size) for row, size in zip(lengths.to_pylist(), sizes.to_pylist())]
        return pa.array([[dict(zip(("first", "n", "at"), c)) for c in row] for row in rows], type=kind)

    cut = join_on(held, states, [key, "__o"], never_null=["__o"]).withColumn(
        "__lines", F.when(F.col("__last") & F.col("__ended"), F.slice("__lines", F.lit(1), F.size("__lines") - 1))
        .otherwise(F.col("__lines")),
    )
    cut = cut.withColumn("__cuts", pack(F.transform("__lines", F.length), "__size"))
    piece = F.transform(
        "__cuts",
        lambda c: F.when(c["n"] == 0, F.substr(F.get("__lines", c["first"]), c["at"] + 1, F.lit(max_len))).otherwise(
            F.array_join(F.slice("__lines", c["first"] + 1, c["n"]), "\n")
        ),
    )
    # lines before the first break belong to the chunk that is open
    first = F.get("__cuts", F.lit(0))
    joins = (F.col("__size") > 0) & (first["n"] > 0) & (first["first"] == 0) & (
        F.col("__size") + F.length(F.get("__lines", F.lit(0))) + 1 <= max_len
    )
    pieces = cut.select(key, "__o", "__begun", joins.alias("__joins"), F.posexplode(piece).alias("__k", "__piece")).select(
        key, "__o", "__piece",
        (F.col("__begun") + F.col("__k") - F.when(F.col("__joins"), 1).otherwise(0)).cast("int").alias("chunk_idx"),
    )
    in_order = F.sort_array(F.collect_list(F.struct("__o", "__piece")))
    return pieces.groupBy(key, "chunk_idx").agg(
        F.array_join(F.transform(in_order, lambda p: p["__piece"]), "\n").alias("chunk")
    )
