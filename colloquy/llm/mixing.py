"""Mixing sources to target weights by temperature, with DataFrame operations only.

Weights are the sources' token shares raised to an exponent and normalised. The
exponent is bisected to the value nearest to 1 that reaches a wanted entropy, or
to the least that keeps the most repeated source within a limit. A source's
weight gives it a quota of tokens: some whole passes over its documents, and part
of a further pass. Documents lie in blocks by a hash of their id; every pass takes
the blocks in a permutation of its own, and the last one stops at the quota. So a
pass is described by one cut per source, and no source is ever sorted as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.runtime import picked, written

WORDS = r"[^\x20\x09-\x0D]+"
# The exponent is a multiple of 1/GRID.
GRID = 4096
# Documents a block has at most on average; blocks are prefixes of a hexadecimal hash.
BLOCK_DOCS = 1024
# Sources up to which their table is broadcast; beyond, rows are joined by a shuffle.
MOST_BROADCAST = 10_000
SEED = "mix"


def word_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _doc_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("-")).cast("binary"))


def _pass_key(epoch: Column, source: Column, block: Column) -> Column:
    """Where a block comes in a pass: blocks in order of this are a permutation."""
    name = F.concat_ws(":", F.lit(SEED), epoch.cast("string"), F.coalesce(source, F.lit("-")), block)
    return F.md5(name.cast("binary"))


def token_shares(docs: DataFrame) -> DataFrame:
    """`source`, `docs`, `tokens` and `digits` (length of a block's name) of a table (doc_id, source, n_tokens)."""
    digits = sum(F.when(F.col("docs") > BLOCK_DOCS * 16**i, 1).otherwise(0) for i in range(12))
    totals = docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    return totals.withColumn("digits", digits.cast("int"))


def _weight(exponent: float) -> Column:
    """The unnormalised weight of a source against that of the largest, whose total is in `most`."""
    return F.pow(F.col("tokens") / F.col("most"), F.lit(exponent))


def entropy_of(sources: DataFrame, exponent: float) -> float:
    """Entropy (nats) of the normalised weights: log of their sum, less the weighted mean of their logs."""
    w = _weight(exponent)
    total, mixed = sources.agg(F.sum(w), F.sum(w * F.log(w))).first()
    return math.log(total) - mixed / total


def most_repeated(sources: DataFrame, exponent: float, budget: int | None) -> float:
    """The largest number of passes over a source, at a token budget or at the least one that uses every source in full."""
    if budget is None:
        return sources.agg(F.max(F.pow(F.col("most") / F.col("tokens"), F.lit(1 - exponent)))).first()[0]
    w = _weight(exponent)
    total, top = sources.agg(F.sum(w), F.max(w / F.col("tokens"))).first()
    return budget * top / total


def bisected(sources: DataFrame, entropy: float | None, max_epochs: float | None, budget: int | None) -> float:
    """The exponent, a multiple of 1/GRID from 0 (equal weights) to 1 (weights as they are).

    With `entropy`: the largest that still has this share of the highest possible
    entropy. With `max_epochs`: the least whose most repeated source stays within
    the limit. Either is monotone, so the interval is halved until it is one step.
    1 if no exponent meets the limit.
    """
    n = sources.count()
    if n < 2:
        return 1.0
    if entropy is not None:
        good, bad = 0, GRID + 1
        while bad - good > 1:
            middle = (good + bad) // 2
            if entropy_of(sources, middle / GRID) >= entropy * math.log(n):
                good = middle
            else:
                bad = middle
        return min(good, GRID) / GRID
    bad, good = -1, GRID
    while good - bad > 1:
        middle = (good + bad) // 2
        if most_repeated(sources, middle / GRID, budget) <= max_epochs:
            good = middle
        else:
            bad = middle
    return good / GRID


def mixing_plan(
    docs: DataFrame, entropy: float | None = None, max_epochs: float | None = 1.5, budget: int | None = None
) -> DataFrame:
    """One row per source: `whole` passes, and the cut of the pass after them.

    `docs` has doc_id, source and n_tokens, and should be cheap to read again.
    That pass takes blocks whose key lies before `cut_key`, and of the block at
    `cut_key` documents up to the key `cut_doc`. `budget` is the number of tokens
    wanted in all; without it the least one that uses every source in full.
    Sources without tokens are taken once.
    """
    totals = written(token_shares(docs), "mix-sources")
    most = totals.agg(F.max("tokens")).first()[0]
    sources = totals.where("tokens > 0").withColumn("most", F.lit(most).cast("long"))
    exponent = bisected(sources, entropy, max_epochs, budget)
    if budget is None:
        passes = F.pow(F.col("most") / F.col("tokens"), F.lit(1 - exponent))
        quota = F.floor(F.col("tokens") * passes + 0.5)
    else:
        norm = sources.agg(F.sum(_weight(exponent))).first()[0] or 1.0
        quota = F.floor(F.lit(budget) * _weight(exponent) / F.lit(norm) + 0.5)
    quotas = written(
        totals.withColumn("most", F.lit(most).cast("long"))
        .withColumn("quota", F.when(F.col("tokens") > 0, quota).otherwise(0).cast("long"))
        .withColumn("whole", F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(1))
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") % F.col("tokens")).otherwise(0))
        .select("source", "digits", "whole", "rest"),
        "mix-quotas",
    )
    # Blocks in the order of their pass; sums over groups of keys, then inside a group.
    placed = with_sources(docs, quotas.where("rest > 0"), "inner")
    block = _doc_key(F.col("doc_id")).substr(F.lit(1), F.col("digits"))
    blocks = placed.groupBy("source", "whole", "rest", block.alias("block")).agg(F.sum("n_tokens").alias("size"))
    blocks = blocks.withColumn("key", _pass_key(F.col("whole"), F.col("source"), F.col("block")))
    blocks = blocks.withColumn("group", F.substring("key", 1, 3))
    groups = blocks.groupBy("source", "group").agg(F.sum("size").alias("group_size"))
    before_group = F.sum("group_size").over(Window.partitionBy("source").orderBy("group")) - F.col("group_size")
    groups = groups.select(F.col("source").alias("of"), F.col("group").alias("in_group"), before_group.alias("before_group"))
    inside = F.sum("size").over(Window.partitionBy("source", "group").orderBy("key")) - F.col("size")
    cuts = (
        blocks.withColumn("inside", inside)
        .join(groups, F.col("source").eqNullSafe(F.col("of")) & (F.col("group") == F.col("in_group")))
        .withColumn("before", F.col("before_group") + F.col("inside"))
        .where("before <= rest and rest < before + size")
        .select(F.col("source").alias("of"), F.col("block").alias("cut_block"), F.col("key").alias("cut_key"), (F.col("rest") - F.col("before")).alias("room"))
    )
    # of several empty blocks at the cut none is needed: a block at the cut has tokens
    cuts = written(cuts, "mix-cuts")
    near = with_sources(docs, quotas.join(cuts, F.col("source").eqNullSafe(F.col("of"))).drop("of"), "inner")
    near = near.withColumn("doc_key", _doc_key(F.col("doc_id"))).where(
        F.col("doc_key").substr(F.lit(1), F.col("digits")) == F.col("cut_block")
    )
    keys = near.groupBy("source", "room", "doc_key").agg(F.sum("n_tokens").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("doc_key"))
    last = keys.withColumn("upto", upto).where("upto <= room").groupBy("source").agg(F.max("doc_key").alias("cut_doc"))
    last = last.withColumnRenamed("source", "last_of")
    plan = quotas.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").join(
        last, F.col("source").eqNullSafe(F.col("last_of")), "left"
    )
    return written(plan.select("source", "digits", "whole", "cut_key", "cut_doc"), "mix-plan")


def with_sources(rows: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the columns of their source; `sources` has one row per source.

    The table of sources is broadcast if a count shows it to be small. Otherwise
    the join shuffles by source, where adaptive execution splits a large one.
    """
    other = sources.withColumnRenamed("source", "_source")
    few = sources.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return rows.join(
        F.broadcast(other) if few else other, rows["source"].eqNullSafe(other["_source"]), how
    ).drop("_source")


def realised(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """A row for every time a document is used: adds `epoch`, `block` and `pass_key`, the place of its block in the pass.

    `rows` has doc_id and source beside any other columns.
    """
    key = _doc_key(F.col("doc_id"))
    block = key.substr(F.lit(1), F.col("digits"))
    in_cut = (_pass_key(F.col("whole"), F.col("source"), block) < F.col("cut_key")) | (
        (_pass_key(F.col("whole"), F.col("source"), block) == F.col("cut_key")) & (key <= F.col("cut_doc"))
    )
    times = F.col("whole") + F.when(in_cut, 1).otherwise(0)
    used = with_sources(rows, plan).withColumn("times", times.cast("int")).where("times > 0")
    used = used.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).withColumn("block", block)
    used = used.withColumn("pass_key", _pass_key(F.col("epoch"), F.col("source"), F.col("block")))
    return used.drop("digits", "whole", "cut_key", "cut_doc", "times")


def token_table(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """`doc_id`, `source`, `n_tokens` of every row, written once since the plan reads it several times."""
    light = picked(docs, doc_id=id_col, source=source_col, text=text_col)
    return written(light.select("doc_id", "source", word_tokens(F.col("text")).alias("n_tokens")), "mix-tokens")


def mixed(docs: DataFrame, entropy: float | None = None, max_epochs: float | None = 1.5, budget: int | None = None, **columns: str) -> DataFrame:
    """The mix of `docs`: doc_id, source, n_tokens (words), epoch, block, pass_key for each use of a document.

    Null sources are a source, null ids an id, of their own; a null or empty text
    has no tokens and costs none of the quota; rows with one id are used or left
    together; other columns are left out; an empty table gives an empty mix.
    """
    light = token_table(docs, **columns)
    return realised(light, mixing_plan(light, entropy, max_epochs, budget))
