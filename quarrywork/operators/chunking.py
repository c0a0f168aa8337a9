"""Documents to child chunks with what an index needs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.splitting import LIMIT, OVERLAP, WHOLE, chunks
from ..functions.text import before, numbered

#: A batch of texts to as many vectors.
Model = Callable[[list[str]], list[list[float]]]
OPTIONAL = ("url", "page", "topic", "content_role", "source_file", "section_number", "country")


def children(documents: DataFrame, whole: int = WHOLE, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk of canonical documents: chunk_id, text to embed, its place among its parent's, and optional columns as text."""
    body = documents.withColumn("_body", before(F.col("content"), "\n\nReferences:"))
    parts = body.withColumn("_parts", chunks(F.col("_body"), whole, limit, overlap)).withColumn("chunk_count", F.size("_parts"))
    rows = parts.select("*", F.posexplode("_parts").alias("chunk_index", "_part"))
    title = F.when(~F.contains(F.lower(F.coalesce("heading_path", F.lit(""))), F.lower("title")), F.col("title"))
    text = F.concat_ws("\n\n", F.nullif("heading_path", F.lit("")), title, "_part")
    optional = [F.col(c).cast("string").alias(c) if c in documents.columns else F.lit(None).cast("string").alias(c) for c in OPTIONAL]
    return rows.select(
        numbered(F.col("doc_id"), "::child-", F.col("chunk_index"), 3).alias("chunk_id"),
        F.col("doc_id").alias("parent_doc_id"), "source", "source_type", "title", "heading_path",
        F.col("_part").alias("content"), text.alias("text"), "chunk_index", "chunk_count", (F.col("chunk_count") > 1).alias("is_split"), *optional,
    )


def summary(rows: DataFrame) -> DataFrame:
    """(parents, split_parents, whole_parents, chunks)"""
    first = F.col("chunk_index") == 0
    return rows.agg(F.count_if(first).alias("parents"), F.count_if(first & F.col("is_split")).alias("split_parents"), F.count_if(first & ~F.col("is_split")).alias("whole_parents"), F.count("*").alias("chunks"))


def embed(rows: DataFrame, text: str = "text", size: int = 256, model: Model | None = None) -> DataFrame:
    """embedding: what model makes of a batch of texts, of unit length; a null or empty text is the empty string.

    Without a model, a hashed bag of words of size numbers, a stand-in that needs no files. model goes to the tasks as it
    is, so it should load what it needs when it is first called. A result of another number of rows is an error.
    """
    import numpy as np

    if model is not None:

        @F.pandas_udf("array<float>")
        def modelled(texts: pd.Series) -> pd.Series:
            out = []
            for at in range(0, len(texts), 64):
                part = texts.iloc[at : at + 64].fillna("").tolist()
                made = np.asarray(model(part), np.float32)
                if made.ndim != 2 or len(made) != len(part):
                    raise ValueError(f"the model gave {made.shape} for {len(part)} texts")
                length = np.linalg.norm(made, axis=1, keepdims=True)
                out += (made / np.where(length > 0, length, 1)).tolist()
            return pd.Series(out, index=texts.index)

        return rows.withColumn("embedding", modelled(text))

    @F.pandas_udf("array<float>")
    def hashed(texts: pd.Series) -> pd.Series:
        from zlib import crc32

        def one(t: str | None):
            v = np.zeros(size, np.float32)
            for w in (t or "").lower().split():
                h = crc32(w.encode())
                v[h % size] += 1 if h & 1 << 31 else -1
            n = float(np.linalg.norm(v))
            return (v / n if n else v).tolist()

        return texts.map(one)

    return rows.withColumn("embedding", hashed(text))
