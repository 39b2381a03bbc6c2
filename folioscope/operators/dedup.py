"""Duplicates, ranking and renumbering. Ties end with a sequence column, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column], drop_blank: str | None = None) -> DataFrame:
    """The first row of each key. ``drop_blank``: a column whose NULL and blank rows are left out."""
    if drop_blank:
        df = df.where(F.col(drop_blank).rlike(r"\S"))
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def first_by_label(units: DataFrame, book: str = "_doc_id", seq: str = "unit_id") -> DataFrame:
    return keep_first(units, [book, "label"], [F.col(seq)])


def longest_by_label(units: DataFrame, book: str = "_doc_id", seq: str = "unit_id", drop_blank: bool = False) -> DataFrame:
    """The record with the longest content per label, the first of equals; an empty label is a label like any other."""
    size = F.length(F.coalesce("content", F.lit("")))
    return keep_first(units, [book, "label"], [size.desc(), F.col(seq)], "label" if drop_blank else None)


def reindex(units: DataFrame, book: str = "_doc_id", seq: str = "unit_id") -> DataFrame:
    """Units numbered from 1 per book in the order of their number components; missing ones come as [0]."""
    numbers = F.when(F.coalesce(F.size("number_components"), F.lit(0)) <= 0, F.array(F.lit(0))).otherwise(F.col("number_components"))
    return units.withColumn("new_index", F.row_number().over(Window.partitionBy(book).orderBy(numbers, seq)))


def best_confidence(units: DataFrame, keys: list[str], score: str, seq: str) -> DataFrame:
    return keep_first(units, keys, [F.col(score).desc(), F.col(seq)])


def worst(df: DataFrame, measure: Column, k: int, descending: bool = False, seq: str = "unit_id") -> DataFrame:
    """The ``k`` rows with the least (or largest) measure: a report of that size, not a cap on data."""
    return df.orderBy(measure.desc() if descending else measure.asc(), seq).limit(k)
