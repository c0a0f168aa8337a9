"""Deduplication by key: first or last seen, best by priority, and marking what is covered.

First, last and best rows are minima and maxima of a struct, which combine
before the shuffle, so a key that a third of all rows have sends one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import holding_each_other


def _one(df: DataFrame, keys: list[Column], picked: Column, *more: Column) -> DataFrame:
    """One row a key: the struct picked, unfolded."""
    return df.groupBy(*[k.alias(f"_key{i}") for i, k in enumerate(keys)]).agg(picked.alias("_row"), *more)


def _columns(keys: list[Column | str]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def first_seen(df: DataFrame, keys: list[Column | str], *order: Column | str) -> DataFrame:
    """The first row of each key by order, ascending."""
    return _one(df, _columns(keys), F.min_by(F.struct(*df.columns), F.struct(*order))).select("_row.*")


def last_seen(df: DataFrame, keys: list[Column | str], *order: Column | str) -> DataFrame:
    """The last row of each key by order."""
    return _one(df, _columns(keys), F.max_by(F.struct(*df.columns), F.struct(*order))).select("_row.*")


def best_by_priority(df: DataFrame, key: Column, priority: Column, seq: str) -> DataFrame:
    """Of each key the row of the highest priority, the first of equals; position is where the key was first seen.

    Keys may be whole texts, so rows meet by a digest of the key (SHA-256).
    """
    best = F.min_by(F.struct(*df.columns), F.struct((-priority).alias("p"), F.col(seq)))
    return _one(df, [F.sha2(key, 256)], best, F.min(seq).alias("position")).select("_row.*", "position")


def uncovered(texts: DataFrame, text: str, covering: DataFrame, cover: str, least: int = 35) -> DataFrame:
    """Rows whose text no covering text equals or contains, and that contain none; containment counts from least characters.

    Equality is an anti-join; containment either way goes through words as keys (joins.holding_each_other()), so
    no text is compared with every other. Rows equal in all columns are judged as one and come back as often as they were.
    """
    c = covering.select(F.col(cover).alias("_cover")).filter("_cover <> ''").distinct()
    rest = texts.filter(F.col(text) != "").join(c, F.col(text) == F.col("_cover"), "left_anti")
    each = rest.select(F.col(text).alias("_text")).distinct()
    hits = holding_each_other(each, "_text", c, "_cover")
    long = F.when(F.contains("_text", "_cover"), F.length("_cover")).otherwise(F.length("_text")) >= least
    return rest.join(hits.filter(long).select("_text").distinct(), F.col(text) == F.col("_text"), "left_anti")
