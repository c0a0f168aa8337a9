"""A training-corpus pipeline: quality rules, near-dedup, substring dedup, mixing and packing of documents.

Each stage gets what the one before has kept, read again from Parquet, and
works on all of it. What a stage writes for itself goes to the shared folder
and is deleted when the next stage begins. Columns of documents may have any
names, also those that the operators use inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywork.llm import common, debruijn, jaccard, mixing, packing, weak
from quarrywork.llm.queries import tokenizer_path

SCOPE = "pipeline"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-supervision posterior keeps."""
    common.release(spark, SCOPE)
    return weak.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    common.release(spark, SCOPE)
    return jaccard.keep_first(docs, SCOPE)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that a document with a smaller id has; a document all of whose words go stays, empty."""
    common.release(spark, SCOPE)
    return debruijn.without_repeats(docs, SCOPE)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; a document without words isn't taken."""
    common.release(spark, SCOPE)
    return mixing.sample(docs, scope=SCOPE)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    common.release(spark, SCOPE)
    return packing.pack_documents(docs, tokenizer_path(), scope=SCOPE)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("mixing to target weights", mixture), ("best-fit packing", best_fit)]

#: Weak supervision, SimHash and packing have no SQL; tests compare with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again as the next one's input, and deleted after that."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = common.saved(stage(spark, docs, sf_dir), f"pipeline-result-{i}")
        common.release(spark, f"pipeline-result-{i - 1}")
    packed = STAGES[-1][1](spark, docs, sf_dir)
    # what the result reads stays until the process ends, also when the stages run again
    common.moved(f"pipeline-result-{len(STAGES) - 2}", "pipeline-packed")
    common.moved(SCOPE, "pipeline-packed")
    return packed
