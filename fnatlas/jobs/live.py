"""Registered queries of the streaming jobs: each writes files from the tables, runs its stream over them and reads what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import bindings as b
from ..sources.scratch import place, written
from ..streaming import streams
from . import dumps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Arrivals of events; every LATE_ID-th event comes 1 + (its number mod 3) arrivals after its time.
ARRIVALS, LATE_ID = 4, 13


def query(f):
    QUERIES[f.__name__] = f
    return f


def arrivals(events: DataFrame) -> DataFrame:
    """events with `arrival`: a share of the days each in the order of time, some rows later than their time."""
    days = events.agg(F.min("day"), F.datediff(F.max("day"), F.min("day")) + 1).first()
    at = F.floor(F.datediff("day", F.lit(days[0])) * ARRIVALS / F.lit(days[1] or 1)).cast("int")
    late = F.when(F.col("event_id") % LATE_ID == 0, 1 + F.col("event_id") % 3).otherwise(0)
    return events.withColumn("arrival", (at + late).cast("int"))


@query
def stream_step_status(spark, d):
    """Closed hours by step and status of events that arrive in order of time, but for some that come a run or more later. Each arrival
    is a run of its own, which goes on from the checkpoint of the last."""
    e = written(arrivals(b.status(spark, d)), "events")
    inbox, target, checkpoint = (place(spark, tag) for tag in ("inbox", "closed", "checkpoint"))
    kept = e.drop("arrival", "day", "bucket")
    schema = ", ".join(f"{k} {v}" for k, v in kept.dtypes)
    for k in range(ARRIVALS + 3):  # a fixed number of runs, however many events there are
        e.filter(F.col("arrival") == k).select(kept.columns).write.parquet(f"{inbox}/{k}")
        streams.closed_status(spark, inbox, schema, target, checkpoint).awaitTermination()
    out = spark.read.schema("window_start timestamp, step string, status string, n bigint, mean_sec double, max_sec double").parquet(target)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "step", "status", "n", *[F.round(c, 6).alias(c) for c in ("mean_sec", "max_sec")])


@query
def stream_feature_ingest(spark, d):
    """Feature dumps through the stream in several batches: histogram entries of every binary, with how many functions it has."""
    source, target, checkpoint = dumps.feature_dump(spark, d, "gzip"), place(spark, "ingested"), place(spark, "checkpoint")
    streams.feature_ingest(spark, source, target, checkpoint, "*.json.gz", at_once=8).awaitTermination()
    records, entries = (spark.read.parquet(f"{target}/{name}") for name in ("records", "histograms"))
    n = records.groupBy("version", "arch").agg(F.count(F.lit(1)).alias("functions"), F.sum("instruction_count").alias("instructions"))
    return entries.groupBy("version", "arch", "kind", "key").agg(F.sum("n").alias("n")).join(F.broadcast(n), ["version", "arch"])  # a row a binary


# Rows of a window that ends before the watermark of the runs before theirs are dropped; a window is closed by the last watermark.
_STATUS = f"""WITH e AS (SELECT event_id, epoch_ms(ts) AS ms, event_type AS step, CASE WHEN value < 5 THEN 'failed' ELSE 'completed' END AS status, value, CAST(ts AS DATE) AS day FROM events),
b AS (SELECT min(day) AS lo, date_diff('day', min(day), max(day)) + 1 AS days FROM e),
a AS (SELECT e.*, CAST(floor(date_diff('day', lo, day) * {ARRIVALS} / days::DOUBLE) AS INT) + CASE WHEN event_id % {LATE_ID} = 0 THEN 1 + event_id % 3 ELSE 0 END AS arrival, ms // 3600000 * 3600000 + 3600000 AS done FROM e, b),
r AS (SELECT k, (SELECT max(ms) FROM a WHERE arrival < k) - 600000 AS mark FROM range({ARRIVALS + 4}) t(k)),
f AS (SELECT a.* FROM a JOIN r ON k = arrival WHERE mark IS NULL OR done > mark)
SELECT strftime(make_timestamp((done - 3600000) * 1000), '%Y-%m-%d %H') AS hour, step, status, count(*) AS n, round(avg(value), 6) AS mean_sec, round(max(value), 6) AS max_sec
FROM f WHERE done <= (SELECT max(mark) FROM r) GROUP BY ALL"""
SQL = {
    "stream_step_status": _STATUS,
    "stream_feature_ingest": f"SELECT h.version, h.arch, h.kind, h.key, h.n, r.functions, r.instructions FROM ({dumps.SQL['feature_histograms']}) h JOIN (SELECT version, arch, count(*) AS functions, CAST(sum(instruction_count) AS BIGINT) AS instructions FROM ({dumps.SQL['features_read']}) GROUP BY ALL) r ON r.version = h.version AND r.arch = h.arch",
}
