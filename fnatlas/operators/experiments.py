"""Significance of differences between methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import stable_hash


def paired_methods(pairs: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    """Differences a - b of a metric on the same (version, src_arch, dst_arch)."""
    key = ["version", "src_arch", "dst_arch"]
    of = lambda m, name: pairs.filter(F.col("method") == m).select(*key, F.col(metric).alias(name), F.col("queries").alias(f"q_{name}"))
    return of(a, "x").join(of(b, "y"), key).select(*key, F.col("q_x").alias("queries"), (F.col("x") - F.col("y")).alias("difference"))


#: Up to so many untied differences the p is exact.
EXACT = 50


def exact_p(n: Column, w: Column) -> Column:
    """Two-sided p of the signed-rank statistic w of n untied differences: of the 2^n sets of ranks, twice the share whose sum is at most w.
    The numbers of sets by their sum are built up rank by rank; up to n = 50 they are whole doubles."""
    add = lambda c, k: F.zip_with(F.concat(c, F.array_repeat(F.lit(0.0), k)), F.concat(F.array_repeat(F.lit(0.0), k), c), lambda x, y: x + y)
    sets = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1.0)), add)
    low = F.aggregate(F.slice(sets, F.lit(1), F.floor(w).cast("int") + 1), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), F.lit(2.0) * low / F.pow(F.lit(2.0), n))


def wilcoxon(differences: DataFrame, *by: str) -> DataFrame:
    """Two-sided signed-rank test (of each group), zeros dropped: the normal approximation with tie correction (z, p), and p_value, which is
    exact for at most EXACT untied differences and p beyond. Ranks are running counts over distinct sizes of differences: of metrics between
    0 and 1 rounded to six digits there are a million at most."""
    x = F.col("difference")
    d = differences.filter("difference != 0").groupBy(*by, F.round(F.abs("difference"), 12).alias("size"))
    d = d.agg(F.count(F.lit(1)).cast("double").alias("ties"), F.count_if(x > 0).alias("above"), F.count_if(x < 0).alias("below"))
    rank = F.sum("ties").over(Window.partitionBy(*by).orderBy("size")) - (F.col("ties") - 1) / 2.0
    d = d.withColumn("rank", rank)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    out = d.groupBy(*by).agg(total(F.col("ties")).alias("n"), total(F.col("above") * F.col("rank")).alias("plus"), total(F.col("below") * F.col("rank")).alias("minus"), total(F.col("ties") * (F.col("ties") * F.col("ties") - 1.0)).alias("tied"))
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24.0 - F.col("tied") / 48.0
    z = (F.least("plus", "minus") - F.col("n") * (F.col("n") + 1) / 4.0) / F.sqrt(var)
    # two-sided p of the normal approximation: erfc(-z / sqrt 2), by a rational approximation (Abramowitz and Stegun 7.1.26, to 1.5e-7)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    p = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    exact = (F.col("n") <= EXACT) & (F.col("tied") == 0) & (F.col("n") > 0)
    w = F.least("plus", "minus")
    return out.select(*by, F.col("n").cast("long").alias("n"), w.alias("w"), z.alias("z"), p.alias("p"), F.when(exact, exact_p(F.col("n"), w)).otherwise(p).alias("p_value"), exact.alias("exact"))


def weighted_difference(differences: DataFrame, *by: str) -> DataFrame:
    return differences.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs"), (F.sum(F.col("difference") * F.col("queries")) / F.greatest(F.sum("queries"), F.lit(1))).alias("weighted_difference"))


def block_bootstrap(differences: DataFrame, iterations: int = 20_000, seed: int = 7) -> DataFrame:
    """Mean and 2.5 % and 97.5 % quantiles of the weighted difference over resampled version blocks. Draws
    come from a stable hash, so reruns and other engines agree. Blocks (a row a version) are broadcast."""
    blocks = differences.groupBy("version").agg(F.sum(F.col("difference") * F.col("queries")).alias("s"), F.sum("queries").alias("q"))
    blocks = blocks.withColumn("k", F.row_number().over(Window.orderBy("version")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    size = blocks.select("n").limit(1)
    draws = differences.sparkSession.range(iterations).withColumnRenamed("id", "iteration").join(F.broadcast(size)).withColumn("draw", F.explode(F.expr("sequence(0L, n - 1)")))
    draws = draws.withColumn("k", stable_hash(F.concat_ws("-", F.lit(str(seed)), F.col("iteration").cast("string"), F.col("draw").cast("string"))) % F.col("n"))
    means = draws.join(F.broadcast(blocks.select(F.col("k").cast("long").alias("k"), "s", "q")), "k").groupBy("iteration").agg((F.sum("s") / F.greatest(F.sum("q"), F.lit(1))).alias("mean"))
    return means.agg(F.avg("mean").alias("mean"), F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
