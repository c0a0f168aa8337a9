"""Keeping an index up to date from a folder where canonical documents land. An extension; batches are the engine's way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import chunking


def maintain_index(spark: SparkSession, landing: str, index: str, checkpoint: str) -> StreamingQuery:
    """Chunks and embeds new files; each micro-batch writes a folder of its own number, so a batch run again replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        chunking.embed(chunking.children(batch)).write.mode("overwrite").parquet(f"{index}/batch={number}")

    arriving = spark.readStream.schema(schemas.CANONICAL).json(landing)
    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
