"""Queries across architectures, retrieval metrics and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("hit_at_1", "hit_at_5", "hit_at_10", "mrr_at_10", "mean_inspected_at_10")


def arch_pairs(binaries: DataFrame) -> DataFrame:
    """Directed pairs of architectures of one version. binaries: distinct (version, arch)."""
    src, dst = binaries.select("version", F.col("arch").alias("src_arch")), binaries.select("version", F.col("arch").alias("dst_arch"))
    return src.join(dst, "version").filter("src_arch != dst_arch")


def relevant_queries(rows: DataFrame) -> DataFrame:
    """Functions of each binary as queries into every other binary of the version that has their name."""
    there = rows.groupBy("version", "norm_name").agg(F.collect_set("arch").alias("_arches"))  # architectures are few
    asked = rows.withColumnRenamed("arch", "src_arch").join(there, ["version", "norm_name"])  # before a row is spelt out for each destination
    return asked.withColumn("dst_arch", F.explode(F.array_remove("_arches", F.col("src_arch")))).drop("_arches")


def systematic_sample(queries: DataFrame, most: int, order: tuple[str, ...] = ("address", "size", "norm_name", "function_id")) -> DataFrame:
    """Of n queries a pair, rows floor(i * (n / most)) for i < most if n > most, else all."""
    part = Window.partitionBy("version", "src_arch", "dst_arch")
    out = queries.withColumn("at", (F.row_number().over(part.orderBy(*order)) - 1).cast("double")).withColumn("n", F.count(F.lit(1)).over(part).cast("double"))
    step = F.col("n") / F.lit(float(most))
    # row r is picked if some i has floor(i * step) = r: the least i with i * step >= r
    i = F.ceil(F.col("at") / step).cast("double")
    near = [F.greatest(F.lit(0.0), i + d) for d in (-1.0, 0.0)]
    picked = F.lit(False)
    for c in near:
        picked = picked | ((c < most) & (F.floor(c * step) == F.col("at")))
    return out.filter((F.col("n") <= most) | picked).drop("at", "n")


def rank_metrics(firsts: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """Metrics a pair (and what else is in by). firsts: by, first (a row a query; null if not found). counts: version, dst_arch, candidates."""
    hit = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    out = firsts.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), hit(1).alias("hit_at_1"), hit(5).alias("hit_at_5"), hit(10).alias("hit_at_10"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr_at_10"), F.avg(F.coalesce(F.col("first"), F.lit(11)).cast("double")).alias("mean_inspected_at_10"))
    return out.join(F.broadcast(counts), ["version", "dst_arch"])  # a row a binary


def tally_metrics(tallies: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """As rank_metrics, from tallies: by, first (0 if not found), n (queries with it)."""
    total, first = F.sum("n"), F.col("first")
    mean = lambda value: F.sum(F.col("n") * value) / total
    hit = lambda k: mean(F.when(first.between(1, k), 1.0).otherwise(0.0))
    out = tallies.groupBy(*by).agg(total.alias("queries"), hit(1).alias("hit_at_1"), hit(5).alias("hit_at_5"), hit(10).alias("hit_at_10"), mean(F.when(first > 0, 1.0 / first).otherwise(0.0)).alias("mrr_at_10"), mean(F.when(first > 0, first).otherwise(11).cast("double")).alias("mean_inspected_at_10"))
    return out.join(F.broadcast(counts), ["version", "dst_arch"])  # a row a binary


def random_expectation(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Hits that a random order is expected to give, a pair."""
    names = rows.groupBy("version", F.col("arch").alias("dst_arch"), "norm_name").agg(F.count(F.lit(1)).alias("relevant"))
    sizes = rows.groupBy("version", F.col("arch").alias("dst_arch")).agg(F.count(F.lit(1)).alias("candidates"))
    out = queries.join(names, ["version", "dst_arch", "norm_name"]).join(F.broadcast(sizes), ["version", "dst_arch"])
    chance = lambda k: F.avg(F.least(F.lit(1.0), F.lit(float(k)) * F.col("relevant") / F.col("candidates")))
    return out.groupBy("version", "src_arch", "dst_arch").agg(F.count(F.lit(1)).alias("queries"), *[chance(k).alias(f"random_hit_at_{k}") for k in (1, 5, 10)])


def summary(pairs: DataFrame, *by: str) -> DataFrame:
    """Macro and query-weighted means of the metrics; each pair's metrics are rounded first, and added up as decimals: a mean can lie on a half
    of its last digit, and must not depend on the order of the pairs."""
    r = lambda m: F.round(m, 6).cast("decimal(20,6)")
    added = lambda c: F.sum(c).cast("double")
    aggs = [F.count(F.lit(1)).alias("pairs"), F.sum("queries").alias("queries")]
    for m in METRICS:
        aggs += [(added(r(m)) / F.count(m)).alias(f"macro_{m}"), (added(r(m) * F.col("queries").cast("decimal(18,0)")) / F.greatest(F.sum("queries"), F.lit(1))).alias(f"weighted_{m}")]
    return pairs.groupBy(*by).agg(*aggs)


def ranking(summaries: DataFrame, *by: str) -> DataFrame:
    """Rank of the methods: hits at 1 and 10 and reciprocal rank down, inspected up, then the method."""
    order = [F.round(F.col(f"weighted_{m}"), 6).desc() for m in ("hit_at_1", "hit_at_10", "mrr_at_10")] + [F.round("weighted_mean_inspected_at_10", 6), "method"]
    return summaries.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
