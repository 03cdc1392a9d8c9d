"""Ordered computations over an episode without putting the episode in one task.

A plain `Window.partitionBy("episode_id").orderBy("seg_idx")` sends a whole
episode to one task, so one very long episode decides the job's run time. The
functions here cut each episode into blocks of the order column, run the window
inside a block, and carry one small row per block forward:

    rows    --window by (episode, block)-->  running value inside the block
    blocks  --window by (episode)------->    running value before the block
    result = carry combined with the value inside the block

`bits` are the block widths as powers of two, from fine to coarse. A dense list
position needs one level: a block then holds at most 2**16 rows and an episode
of n rows has n / 2**16 carry rows. A second width adds a second level, for
orders that are both long and sparse.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POSITION_BITS = (16,)
# Word positions are `segment position * 2**24 + word`: 2**12 segments a block.
WORD_BITS = (36,)
# Millisecond times: blocks of about a minute, deduplicated per millisecond.
TIME_BITS = (16,)


@dataclass(frozen=True)
class Run:
    """One running value: `op` is sum, max or min over the rows so far."""

    name: str
    op: str
    value: Column
    exclusive: bool = False


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(op: str, carry: Column, local: Column) -> Column:
    if op == "sum":
        return F.coalesce(carry + local, carry, local, F.lit(0))
    return F.greatest(carry, local) if op == "max" else F.least(carry, local)


def join_on(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", never_null: Sequence[str] = ()
) -> DataFrame:
    """Join on columns that may be NULL: NULL keys match each other, as they do in a groupBy.

    Keys in `never_null` are compared plainly, which is cheaper.
    """
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = [
        F.col(k) == F.col(f"__r_{k}") if k in never_null else F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys
    ]
    return left.join(other, same, how).drop(*[f"__r_{k}" for k in keys])


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    runs: Sequence[Run],
    bits: Sequence[int] = POSITION_BITS,
) -> DataFrame:
    """Add one column per run: its value over the rows of the same `keys` up to here.

    `order` names bigint columns that are unique per key; blocks are cut on the
    first. A NULL key is a key of its own.
    """
    keys = list(keys)
    orders = [order] if isinstance(order, str) else list(order)
    if not bits:
        frame = Window.partitionBy(*keys).orderBy(*orders)
        return df.withColumns(
            {
                r.name: _AGG[r.op](r.value).over(
                    frame.rowsBetween(Window.unboundedPreceding, -1 if r.exclusive else 0)
                )
                for r in runs
            }
        )
    block = f"__block{len(bits)}"
    rows = df.withColumn(block, F.shiftright(F.col(orders[0]), bits[0]))
    per_block = rows.groupBy(*keys, block).agg(*[_AGG[r.op](r.value).alias(f"__t_{r.name}") for r in runs])
    carry_runs = [Run(f"__c{len(bits)}_{r.name}", r.op, F.col(f"__t_{r.name}"), True) for r in runs]
    carries = with_running(per_block, keys, block, carry_runs, bits[1:]).select(
        *keys, block, *[c.name for c in carry_runs]
    )
    frame = Window.partitionBy(*keys, block).orderBy(*orders)
    local = rows.withColumns(
        {
            f"__l_{r.name}": _AGG[r.op](r.value).over(
                frame.rowsBetween(Window.unboundedPreceding, -1 if r.exclusive else 0)
            )
            for r in runs
        }
    )
    joined = join_on(local, carries, [*keys, block], "left")
    out = joined.withColumns(
        {
            r.name: _combine(r.op, F.col(c.name), F.col(f"__l_{r.name}"))
            for r, c in zip(runs, carry_runs)
        }
    )
    return out.select(*df.columns, *[r.name for r in runs])


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    cols: Sequence[str],
    name: str = "prev",
    bits: Sequence[int] = POSITION_BITS,
) -> DataFrame:
    """Add struct `name` with `cols` of the previous row, NULL on the first row."""
    last_seen = F.struct(F.col(order).alias("__o"), *[F.col(c) for c in cols])
    return with_running(df, keys, order, [Run(name, "max", last_seen, True)], bits)


def with_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str = "rn",
    bits: Sequence[int] = POSITION_BITS,
) -> DataFrame:
    """1-based position by a unique `order` within `keys`."""
    return with_running(df, keys, order, [Run(name, "sum", F.lit(1).cast("bigint"))], bits)


def with_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: str,
    name: str = "rn",
    value_bits: Sequence[int] = TIME_BITS,
    tie_bits: Sequence[int] = POSITION_BITS,
) -> DataFrame:
    """1-based position by (`value`, `tie`), safe when many rows share one value.

    Rows are counted per (value, tie block) first. The window over these counts
    gives how many rows come before such a cell, the window inside the cell the
    rest. So neither a crowded key nor a crowded value forms one large window.
    """
    keys = list(keys)
    cell = [*keys, value, "__tie_block"]
    rows = df.withColumn("__tie_block", F.shiftright(F.col(tie), tie_bits[0]))
    counts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    before = with_running(
        counts, keys, [value, "__tie_block"], [Run("__before", "sum", F.col("__n"), True)], value_bits
    ).drop("__n")
    within = F.row_number().over(Window.partitionBy(*cell).orderBy(tie))
    return (
        join_on(rows.withColumn("__within", within), before, cell)
        .withColumn(name, F.col("__before") + F.col("__within"))
        .select(*df.columns, name)
    )


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    positions: dict[str, Column],
    value_bits: Sequence[int] = TIME_BITS,
) -> DataFrame:
    """Values at 0-based positions of each group's sorted list, without the list.

    `positions` maps an output name to a position that may use column `n`, the
    group's row count. The sort works on distinct values with counts.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    cumulative = with_running(counts, keys, value, [Run("__upto", "sum", F.col("__n"))], value_bits)
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("n"))
    return (
        join_on(cumulative, totals, list(keys))
        .groupBy(*keys)
        .agg(
            F.max("n").alias("n"),
            *[
                F.min(F.when(F.col("__upto") > position, F.col(value))).alias(name)
                for name, position in positions.items()
            ],
        )
    )


def with_islands(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    is_head: Column,
    name: str = "island",
    bits: Sequence[int] = POSITION_BITS,
) -> DataFrame:
    """Label runs of rows with the order value of the head that opened the run."""
    return with_running(df, keys, order, [Run(name, "max", F.when(is_head, F.col(order)))], bits)
