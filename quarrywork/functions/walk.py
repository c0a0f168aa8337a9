"""Walking JSON of any shape: every leaf with its path, by repeated explosion of VARIANT values in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leaves(rows: DataFrame, column: str) -> DataFrame:
    """Input columns but column, with path (keys and [positions] joined by dots) and value, one row per leaf.

    There are as many steps as the deepest value has levels: each asks first whether anything is nested deeper.
    Text that isn't JSON gives no rows; empty objects and arrays are leaves without a value.
    """
    others = [c for c in rows.columns if c != column]
    level = rows.select(*others, F.lit("").alias("path"), F.try_parse_json(F.col(column)).alias("v")).filter("v IS NOT NULL")
    out = None
    while True:
        kind = F.expr("schema_of_variant(v)")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        texts = level.filter(~nested).select(*others, "path", F.coalesce(F.expr("try_variant_get(v, '$', 'string')"), F.to_json("v")).alias("value"))
        out = texts if out is None else out.union(texts)
        if level.filter(nested).isEmpty():
            return out
        exploded = level.filter(nested).lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()))
        step = F.coalesce(F.col("key"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = exploded.select(*others, F.concat_ws(".", F.nullif("path", F.lit("")), step).alias("path"), F.col("value").alias("v"))
