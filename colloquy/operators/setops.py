"""Set operations on segment tables and their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.blocks import join_on


def union_formats(*frames: DataFrame) -> DataFrame:
    """One table from sources that may lack some columns."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `left` whose keys `right` lacks; NULL keys equal each other."""
    return join_on(left, right.select(*keys), keys, "left_anti")


def intersection(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that both have, once each; NULL keys equal each other."""
    return join_on(left, right.select(*keys), keys, "left_semi").select(*keys).distinct()


def route(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.filter(F.col(column) == value)
