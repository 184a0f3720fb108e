"""Structured Streaming jobs: feature ingest with resume, and step status by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.features import feature_histograms
from ..sources.readers import FEATURES, project_features

#: How long a step's row may come after later ones, and the windows that are counted.
LATE, HOUR = "10 minutes", "1 hour"


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """New files of function records to parquet by version and arch; the checkpoint remembers what is done."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)
    rows = rows.filter("size >= 16").withColumn("n_tokens", F.size("tokens"))
    return rows.writeStream.format("parquet").partitionBy("version", "arch").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feature_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, files: str = "*.json", at_once: int = 64) -> StreamingQuery:
    """New files of function features (JSON lines in folders by version) to two tables, records and histograms, in the folders
    batch=N of `target`.

    A batch overwrites its own folders. If it ended between its writes and its commit, the next run has the same files under the
    same number and writes the same folders again, so that no row stands there twice; files of committed batches aren't read again.
    """
    raw = spark.readStream.schema(FEATURES).option("recursiveFileLookup", True).option("pathGlobFilter", files).option("maxFilesPerTrigger", at_once).json(source)
    rows = project_features(raw)

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.select("version", "arch", "function_id", "address", "size", "stats.*", F.size("tokens").cast("long").alias("n_tokens"), "token_truncated")
        kept.write.mode("overwrite").parquet(f"{target}/records/batch={number}")
        feature_histograms(batch, "version", "arch").write.mode("overwrite").parquet(f"{target}/histograms/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def step_status(events: DataFrame, late: str = LATE, window: str = HOUR) -> DataFrame:
    """Counts and durations per step, status and window of an event stream; late rows are let in up to the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "step", "status").agg(F.count(F.lit(1)).alias("n"), F.avg("duration_sec").alias("mean_sec"), F.max("duration_sec").alias("max_sec")).select(F.col("w.start").alias("window_start"), "step", "status", "n", "mean_sec", "max_sec")


def closed_status(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, late: str = LATE, window: str = HOUR) -> StreamingQuery:
    """What has arrived below `source` since the last run, into windows; a window is appended to `target` once the watermark has
    passed its end, and never changes. Rows of a window that was closed before their run are dropped. State, watermark and the
    list of read files are in the checkpoint, so that a run goes on where the last one ended."""
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(source)
    out = step_status(rows, late, window)
    return out.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
