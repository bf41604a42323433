"""Order, pages and unions of matched documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, number: int = 0, size: int = 20, order: str | list[str] = "_id") -> DataFrame:
    """Page ``number`` (from 0) of ``size`` documents in order of their ids. Early pages become a top-k, not a sort of all."""
    ordered = df.orderBy(order)
    return ordered.limit((number + 1) * size).offset(number * size) if number else ordered.limit(size)


def window(df: DataFrame, start: int = 0, size: int = 10, order: str = "_id") -> DataFrame:
    """``size`` documents from position ``start``."""
    ordered = df.orderBy(order)
    return ordered.limit(start + size).offset(start) if start else ordered.limit(size)


def union_of(datasets: dict[str, DataFrame]) -> DataFrame:
    """All datasets as one, each row tagged with its dataset's name; fields that one lacks are null there."""
    tagged = [df.withColumn("_index", F.lit(name)) for name, df in datasets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
