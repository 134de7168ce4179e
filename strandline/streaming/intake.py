"""Scene intake: each new scene once, across batches and restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.catalog import unprocessed
from strandline.sources.tables import path_exists


def scene_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet scene lists that arrive in a folder, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def take_in(stream: DataFrame, table: str, checkpoint: str, key: str = "scene_id", overwrite: bool = False) -> None:
    """Append the scenes of all files that are there and not yet in the table, then stop.

    The table itself is the memory of what was done, so nothing expires and no scene
    comes twice. A batch writes its own folder in overwrite mode: one that is run again
    after a failure replaces what it left behind.
    """
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy(key).agg(F.min(F.struct(*[c for c in batch.columns if c != key])).alias("s")).select(key, "s.*")
        if path_exists(spark, table):
            done = spark.read.parquet(table)
            if "batch" in done.columns:
                done = done.where(F.col("batch") != batch_id)
            fresh = unprocessed(fresh, done, key, overwrite)
        fresh.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
