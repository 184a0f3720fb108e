"""Inventories and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import version_key


def symbol_stats(rows: DataFrame) -> DataFrame:
    """Counts and exact percentiles of sizes per binary."""
    p = F.percentile("size", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return rows.groupBy("version", "arch").agg(F.count(F.lit(1)).alias("functions"), F.avg("size").alias("mean"), p.alias("p")).select("version", "arch", "functions", "mean", F.col("p")[0].alias("median"), F.col("p")[1].alias("p90"), F.col("p")[2].alias("p99"))


PERCENTILES = (0.5, 0.9, 0.99)


def size_sketches(rows: DataFrame, *by: str, k: int = 400) -> DataFrame:
    """(by, functions, sketch): a quantile sketch of the sizes of each group, of a size that doesn't grow with the group. Sketches of
    parts are merged by kll_merge_agg_bigint, without the rows."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("functions"), F.kll_sketch_agg_bigint("size", F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return sketches.groupBy(*by).agg(F.sum("functions").alias("functions"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def sketched_percentiles(sketches: DataFrame, *by: str) -> DataFrame:
    """(by, functions, p, size): the sketches' estimates."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias("size")) for p in PERCENTILES]))
    return sketches.select(*by, "functions", each.alias("e")).select(*by, "functions", "e.p", "e.size")


def rank_errors(rows: DataFrame, estimates: DataFrame, *by: str) -> DataFrame:
    """estimates with rank_error: how far the share of rows up to the estimated size is from p (0 if p is between the shares below and up to
    it). Estimates are a few rows a group."""
    sizes = rows.groupBy(*by, "size").agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed("size", "seen")  # counted before they meet the estimates
    met = sizes.join(F.broadcast(estimates), list(by)) if by else sizes.join(F.broadcast(estimates))
    share = lambda test: F.sum(F.when(test, F.col("rows")).otherwise(0)) / F.first("functions")
    out = met.groupBy(*by, "p", "size").agg(F.first("functions").alias("functions"), share(F.col("seen") < F.col("size")).alias("below"), share(F.col("seen") <= F.col("size")).alias("upto"))
    return out.withColumn("rank_error", F.greatest(F.lit(0.0), F.col("below") - F.col("p"), F.col("p") - F.col("upto"))).drop("below", "upto")


def pair_artifacts(stripped: DataFrame, unstripped: DataFrame) -> DataFrame:
    """Stripped binaries with their labelled counterpart, if there is one."""
    has = unstripped.select("version", "arch", F.lit(1).alias("has_label"))
    return stripped.join(has, ["version", "arch"], "left").withColumn("has_label", F.coalesce("has_label", F.lit(0))).withColumn("label_status", F.when(F.col("has_label") == 1, "paired").otherwise("stripped_only"))


def reattach(features: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """Features with the columns of a saved alignment (a row a key). An alignment row without its features is an error, found by an
    anti join before the result is made."""
    if lost := saved.join(features.select(*keys), keys, "left_anti").count():
        raise ValueError(f"{lost} rows of the saved alignment have no features")
    return features.join(saved, keys)


def dataset_summary(rows: DataFrame) -> DataFrame:
    """Totals (arch null) and per architecture, in one pass."""
    key = version_key(F.col("version"))
    return rows.rollup("arch").agg(F.count(F.lit(1)).alias("functions"), F.count_distinct("version").alias("versions"), F.sum("size").alias("bytes"), F.min_by("version", key).alias("first_version"), F.max_by("version", key).alias("last_version"))


def manifest_summary(pairs: DataFrame) -> DataFrame:
    """Binaries that have a labelled counterpart and those that don't, over all (arch null) and per architecture. pairs: as pair_artifacts gives them."""
    key, of = version_key(F.col("version")), lambda s: F.count_if(F.col("label_status") == s)
    return pairs.rollup("arch").agg(F.count(F.lit(1)).alias("binaries"), of("paired").alias("paired"), of("stripped_only").alias("stripped_only"), F.min_by("version", key).alias("first_version"), F.max_by("version", key).alias("last_version"))


def shared_names(rows: DataFrame) -> DataFrame:
    """Names that all architectures of a version have, and names that any has."""
    names = rows.groupBy("version", "norm_name").agg(F.count_distinct("arch").alias("arches"))
    tallies = names.groupBy("version", "arches").agg(F.count(F.lit(1)).alias("names"))  # a row a version and number of architectures
    every = rows.groupBy("version").agg(F.count_distinct("arch").alias("all_arches"))
    out = tallies.join(F.broadcast(every), "version")
    return out.groupBy("version").agg(F.sum(F.when(F.col("arches") == F.col("all_arches"), F.col("names")).otherwise(0)).alias("in_all"), F.sum("names").alias("in_any"))


def coverage(rows: DataFrame, arches: int) -> DataFrame:
    """Architectures and functions per version, and whether all architectures are there."""
    return rows.groupBy("version").agg(F.count_distinct("arch").alias("completed"), F.count(F.lit(1)).alias("functions")).withColumn("is_complete", (F.col("completed") >= arches).cast("int"))


def build_grid(found: DataFrame) -> DataFrame:
    """The grid of all versions and architectures: OK, FAIL or MISSING. found: version, arch, status."""
    v, a = found.select("version").distinct(), found.select("arch").distinct()
    state = found.groupBy("version", "arch").agg(F.max(F.when(F.col("status") == "completed", 1).otherwise(0)).alias("ok"))
    return F.broadcast(v).crossJoin(F.broadcast(a)).join(state, ["version", "arch"], "left").select("version", "arch", F.when(F.col("ok") == 1, "OK").when(F.col("ok") == 0, "FAIL").otherwise("MISSING").alias("result"))


def pair_matrix(pairs: DataFrame, metric: str, arches: list[str]) -> DataFrame:
    """Mean of a metric, source by destination."""
    return pairs.groupBy("src_arch").pivot("dst_arch", arches).agg(F.round(F.avg(metric), 6))


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    return rows.groupBy(F.width_bucket(F.col(column).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def even_bins(rows: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n): counts in bins of one width between the least and the greatest value, which belongs to the last bin. Equal
    values lie in the middle of a range of 1. Only the two ends come to the driver."""
    low, high = rows.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is not None and low == high:
        low, high = low - 0.5, high + 0.5
    at = F.floor((F.col(column) - F.lit(low)) / (F.lit(high) - F.lit(low)) * F.lit(bins))
    return rows.filter(F.col(column).isNotNull()).groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def select_binaries(binaries: DataFrame, versions: list[str] | None = None, arches: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Binaries of the versions (whole or without their prefix) and architectures asked for, in order of version and architecture; the first `most` of them if a limit is set."""
    out = binaries
    if versions:
        out = out.filter(F.col("version").isin(versions) | F.substring_index("version", "-", -1).isin(versions))
    if arches:
        out = out.filter(F.col("arch").isin(arches))
    out = out.orderBy(version_key(F.col("version")), "version", "arch")
    return out if most is None else out.limit(most)


# The versions that stand for all others.
REPRESENTATIVE = ("1.11.0", "1.14.0", "1.21.0", "1.28.4", "1.30.1", "1.33.1", "1.34.0", "1.37.0")


def choose_versions(binaries: DataFrame, named: tuple[str, ...] = REPRESENTATIVE, parts: int = 8) -> DataFrame:
    """(version, place): the named versions (without their prefix) that there are; if there is none of them, every n div parts-th version in order.
    place: among all versions, from 0; a row a version, so one window is small."""
    v = binaries.select("version").distinct()
    v = v.withColumn("place", F.row_number().over(Window.orderBy(version_key(F.col("version")), "version")) - 1)
    v = v.withColumn("named", F.substring_index("version", "-", -1).isin(*named))
    every = Window.partitionBy()
    v = v.withColumn("found", F.max("named").over(every)).withColumn("n", F.count(F.lit(1)).over(every))
    return v.filter(f"CASE WHEN found THEN named ELSE place % greatest(1, n div {parts}) = 0 END").select("version", F.col("place").cast("long").alias("place"))


def completed_versions(status: DataFrame, arches: int) -> DataFrame:
    """(version, completed) of the versions with as many completed binaries as there are architectures. status: version, arch, status; only
    'completed' counts, not 'exists'."""
    done = status.filter("status = 'completed'").groupBy("version").agg(F.count(F.lit(1)).alias("completed"))
    return done.filter(F.col("completed") >= arches)


def leave_one_arch(counts: DataFrame) -> DataFrame:
    """For each architecture (a row each: arch, functions) as the test: those to train on, in order, and the functions of both sides."""
    every = Window.partitionBy()  # a row an architecture
    others = F.array_remove(F.array_sort(F.collect_set("arch").over(every)), F.col("arch"))
    return counts.select(F.col("arch").alias("test_arch"), F.array_join(others, ",").alias("train_arches"), F.col("functions").alias("test_functions"), (F.sum("functions").over(every) - F.col("functions")).alias("train_functions"))


def step_counts(events: DataFrame) -> DataFrame:
    """Events, failures and durations per step and status."""
    return events.groupBy("step", "status").agg(F.count(F.lit(1)).alias("n"), F.avg("duration_sec").alias("mean_sec"), F.max("duration_sec").alias("max_sec"))


def matching_summary(matches: DataFrame, labels: DataFrame, stripped: DataFrame) -> DataFrame:
    """Matches per binary against both sides' sizes; binaries that both sides have, without matches too."""
    count = lambda d, n: d.groupBy("version", "arch").agg(F.count(F.lit(1)).alias(n))
    m = matches.groupBy("version", "arch").agg(F.count(F.lit(1)).alias("matches"), F.percentile("match_dist", F.lit(0.5)).alias("median_dist"), F.percentile("match_dist", F.lit(0.9)).alias("p90_dist"))
    out = count(labels, "labels").join(count(stripped, "stripped"), ["version", "arch"]).join(m, ["version", "arch"], "left")
    out = out.withColumn("matches", F.coalesce("matches", F.lit(0)).cast("long"))
    return out.withColumn("label_ratio", F.col("matches") / F.col("labels")).withColumn("stripped_ratio", F.col("matches") / F.col("stripped"))
