"""Shape features of functions inside their binary, and per-binary statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import SHAPE
from ..sources.bindings import ORDER
from ..sources.scratch import written
from . import cells, ranges

BINARY = ("version", "arch")


def shape_features(rows: DataFrame, task_rows: int | None = None, place: bool = False) -> DataFrame:
    """rows with log_size, addr_pos, order_pos, local_mean, local_diff (and place, if asked for). Bounds and counts of the binaries are aggregated first. Where no binary
    has more than `task_rows` rows (ranges.MOST_ROWS), a window a binary gives the rest; else ranges of the order do, in one
    shuffle: pass only the columns that are needed."""
    bounds = written(rows.groupBy(*BINARY).agg(F.count(F.lit(1)).alias("n"), F.min("address").alias("low"), F.max(F.col("address") + F.col("size")).alias("high")), "binaries")
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1))
    log_size, large = F.log(F.lit(1.0) + F.col("size")), ranges.parts(bounds, task_rows)
    if large:
        out = cells.with_neighbours(rows, list(BINARY), list(ORDER), log_size, 2, "local_mean", large).withColumn("log_size", log_size)
    else:
        out = ranges.running(rows.withColumn("log_size", log_size), list(BINARY), list(ORDER), F.lit(1), "place", 0).withColumn("place", F.col("place") - 1)
        out = out.withColumn("local_mean", F.avg("log_size").over(Window.partitionBy(*BINARY).orderBy(*ORDER).rowsBetween(-2, 2)))
    out = out.join(F.broadcast(bounds), list(BINARY))  # a row a binary
    out = out.withColumn("addr_pos", (F.col("address") - F.col("low")) / span)
    out = out.withColumn("order_pos", F.col("place") / F.greatest(F.col("n") - 1, F.lit(1)))
    return out.withColumn("local_diff", F.col("log_size") - F.col("local_mean")).select(*rows.columns, *SHAPE, *(["place"] if place else []))


def before(shaped: DataFrame, columns: list[str], block: int | None = None) -> DataFrame:
    """shaped (with place) with p_...: the columns of the row before it in its binary; first rows are left out. Places are cut into blocks; a block's
    last row is copied to the next one, where it is only seen."""
    size = F.lit(ranges.BLOCK if block is None else block)
    own = F.floor(F.col("place") / size)
    spread = shaped.withColumn("_block", F.explode(F.array_distinct(F.array(own, F.floor((F.col("place") + 1) / size)))))
    order = Window.partitionBy(*BINARY, "_block").orderBy("place")
    out = spread.withColumns({f"p_{c}": F.lag(c).over(order) for c in columns} | {"_behind": F.lag("place").over(order)})
    return out.filter((F.col("_block") == own) & F.col("_behind").isNotNull()).drop("_block", "_behind")


def binary_shape_stats(shaped: DataFrame) -> DataFrame:
    """Mean and deviation of each feature per binary; a deviation under 1e-9 counts as 1."""
    aggs = []
    for c in SHAPE:
        aggs.append(F.avg(c).alias(f"{c}_mean"))
        aggs.append(F.when(F.stddev_pop(c) <= 1e-9, 1.0).otherwise(F.stddev_pop(c)).alias(f"{c}_std"))
    return shaped.groupBy(*BINARY).agg(*aggs)


def calibrated(queries: DataFrame, stats: DataFrame, features: tuple[str, ...] = SHAPE) -> DataFrame:
    """queries (version, src_arch, dst_arch, features) with their features moved from the source binary's
    distribution to the destination's. stats has a row a binary: it is broadcast."""
    sides = []
    for side in ("src", "dst"):
        named = [F.col("version").alias(f"{side}_v"), F.col("arch").alias(f"{side}_a")] + [F.col(f"{c}_{k}").alias(f"{side}_{c}_{k}") for c in features for k in ("mean", "std")]
        sides.append(stats.select(*named))
    out = queries.join(sides[0], (F.col("version") == F.col("src_v")) & (F.col("src_arch") == F.col("src_a"))).join(sides[1], (F.col("version") == F.col("dst_v")) & (F.col("dst_arch") == F.col("dst_a")))
    moved = [(F.col(f"dst_{c}_mean") + (F.col(c) - F.col(f"src_{c}_mean")) / F.col(f"src_{c}_std") * F.col(f"dst_{c}_std")).alias(c) for c in features]
    return out.select(*[c for c in queries.columns if c not in features], *moved)
