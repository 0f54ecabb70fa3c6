"""The incremental ingestion as a stream of landed batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.change import insert_missing


def land(spark: SparkSession, folder: str, schema: str, checkpoint: str, save: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each landed batch of JSON rows goes to save with its number; ends when all that has landed is done."""
    rows = spark.readStream.schema(schema).json(folder)
    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshots(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Appends to target the rows whose keys it lacks. A batch that is done again finds its rows there already."""

    def save(batch: DataFrame, _: int) -> None:
        try:
            old = spark.read.schema(batch.schema).parquet(target)
            new = batch.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            new = insert_missing(batch.limit(0), batch, keys)
        new.write.mode("append").parquet(target)

    return land(spark, folder, schema, checkpoint, save)
