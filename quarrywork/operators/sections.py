"""Ordered computations as windows: sections under headings, runs, questions with answers, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], order: str, kind: Column) -> DataFrame:
    """run: the number of the run of equal kinds that a row is in, from 1 within its keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = F.when(F.lag(kind).over(w).eqNullSafe(kind) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def heading_levels(blocks: DataFrame, keys: list[str], order: str, is_heading: Column, known_level: Column) -> DataFrame:
    """level of heading rows (null for others): known, else 2 right behind another heading under some level-1 heading, else 1.

    An unknown heading is of level 1 whenever none came before, so "some
    level-1 heading" is any heading before that isn't of known level 2.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    marked = blocks.withColumn("_h", is_heading).withColumn("_k", F.when(is_heading, known_level))
    before = F.max(F.when(F.col("_h") & F.coalesce(F.col("_k") != 2, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.coalesce(F.lag("_h").over(w), F.lit(False))
    level = F.when(F.col("_h"), F.coalesce("_k", F.when(behind & (before == 1), 2).otherwise(1)))
    return marked.withColumn("level", level).drop("_h", "_k")


def under_headings(leveled: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """section, h1 and h2 of each row: a heading begins a section; a level-1 heading clears h2."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = leveled.withColumn("section", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(w))
    out = out.withColumn("h1", F.last(F.when(F.col("level") == 1, F.col(text)), ignorenulls=True).over(w))
    last = F.last(F.when(F.col("level").isNotNull(), F.struct("level", F.col(text).alias("t"))), ignorenulls=True).over(w)
    out = out.withColumn("_last", last)
    # a level-2 heading stays until the next heading of either level
    return out.withColumn("h2", F.when(F.col("_last.level") == 2, F.col("_last.t"))).drop("_last")


def joined_in_order(items: Column, order: Column, joint: str) -> Column:
    """Aggregate: texts joined in their order; nulls and empty texts left out."""
    rows = F.array_sort(F.collect_list(F.when(F.coalesce(items, F.lit("")) != "", F.struct(order.alias("o"), items.alias("t")))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), joint)


def answered(turns: DataFrame, keys: list[str], order: str, is_question: Column, *texts: str, lines: int = 1) -> DataFrame:
    """Question rows with the texts of the next lines (next_1, next_2, ...) as columns."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = turns
    for n in range(1, lines + 1):
        for t in texts:
            out = out.withColumn(f"next_{n}" if len(texts) == 1 else f"{t}_{n}", F.lead(t, n).over(w))
    return out.filter(is_question)


def conversation_context(messages: DataFrame, key: str, order: str, role: str, text: str, last: int = 6, characters: int = 6000) -> DataFrame:
    """(key, context): the last messages, role and text, cut to the last characters."""
    recent = messages.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).filter(F.col("_n") <= last)
    line = F.concat(F.col(role), F.lit(": "), F.coalesce(text, F.lit("")))
    whole = joined_in_order(line, F.col(order), "\n\n")
    return recent.groupBy(key).agg(whole.alias("context")).withColumn("context", F.expr(f"right(context, {int(characters)})"))
