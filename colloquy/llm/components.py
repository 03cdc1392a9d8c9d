"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.runtime import written


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member) that connect the same values as the links (a, b)."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    member = label != np.arange(len(nodes))
    return nodes[member], nodes[label[member]]


def connected(links: DataFrame) -> DataFrame:
    """`node`, `label` (smallest node of its component) for the nodes of links (a, b).

    Each round hangs larger neighbours of a node on the smallest one, then the
    smaller ones, with a combined minimum and a join; no neighbourhood is ever
    collected. The minima are written before the join, so that the join of a node
    with very many neighbours can be split. The number of rounds grows with the logarithm of the longest
    chain. Rounds are written to shared storage; nodes without links are absent,
    loops and repeated links do no harm.
    """
    now = written(_both(links.where("a <> b")).distinct(), "links")
    before = None
    while True:
        now = written(_small(_large(now)), "links")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            return now.where("a > b").select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = mark


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(both: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of node and neighbours."""
    lowest = written(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "lowest")
    made = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return made.where("a <> b").distinct()


def _small(down: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; both directions."""
    lowest = written(down.groupBy("a").agg(F.min("b").alias("low")), "lowest")
    hung = down.join(lowest, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return _both(hung.union(lowest.select("a", F.col("low").alias("b")))).distinct()
