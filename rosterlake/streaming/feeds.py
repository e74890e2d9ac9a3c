"""The append-only feeds as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rosterlake.sources import files


def watch_drops(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """New files as they arrive."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return (spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true").load(path)
            .select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content", "modificationTime"))


def stage_drops(drops: DataFrame, lake: str, checkpoint: str) -> StreamingQuery:
    """Stage each content once (S1). A replayed micro-batch overwrites its own folder, so a retry adds nothing."""
    spark = drops.sparkSession

    def stage(frame: DataFrame, epoch: int) -> None:
        registry = _table(spark, f"{lake}/import_batches", "batch_id bigint, file_sha256 string, epoch bigint")
        others = registry.where(F.col("epoch") != epoch)
        batches, rows = files.ingest(files.fingerprinted(frame), F.current_timestamp(), others)
        rows.write.mode("overwrite").parquet(f"{lake}/staging_rows/epoch={epoch}")
        batches.write.mode("overwrite").parquet(f"{lake}/import_batches/epoch={epoch}")

    return (drops.writeStream.foreachBatch(stage).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _table(spark: SparkSession, path: str, empty_schema: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as missing:  # nothing was staged yet
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        return spark.createDataFrame([], empty_schema)


def current_stats(snapshots: DataFrame) -> DataFrame:
    """Newest observation per account (S2). State is one row per account, ordered by event time, so a late row never
    wins and no watermark is needed."""
    return snapshots.groupBy("account_id").agg(
        F.max_by(F.struct("fetched_at", "source", "followers"), F.struct("fetched_at", "snapshot_id")).alias("now")).select(
        "account_id", "now.*")


def daily_views(metrics: DataFrame) -> DataFrame:
    """Highest views per post and day (S3). State is one number per post and day, so rows may come however late and no
    watermark drops them; a late row updates its day."""
    return metrics.groupBy("cc_id", F.to_date("recorded_at").alias("day")).agg(F.max("views").alias("views"))


def land_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what changed in each micro-batch to its own folder under ``path``. A replayed batch overwrites its folder;
    readers take the newest row per key."""
    def land(frame: DataFrame, epoch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (stream.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
