"""Registered queries: exact tests, inventories of files, resumed work, sketches, quality of one large group, the chain from matches to scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import SHAPE, SHAPE_SCALES
from ..operators import evolution, experiments, meeting, reports, shape
from ..sources import bindings as b
from ..sources import readers
from ..sources.scratch import place, written
from . import sql
from .catalog import _two_methods, method_summary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Rank error that a sketch of size 400 keeps to, with room.
SKETCH_ERROR = 0.02
#: Rows of one task in global_transfer_quality, so that its one group is cut into ranges at any scale.
GROUP_ROWS = 50_000


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def wilcoxon_by_version(spark, d):
    """The signed-rank test of reciprocal ranks for every version, and over all (null): exact where differences are few and untied."""
    x = experiments.paired_methods(_two_methods(spark, d), "shape", "size", "mrr_at_10").withColumn("difference", F.round("difference", 6))
    x = written(x, "differences")
    out = experiments.wilcoxon(x, "version").unionByName(experiments.wilcoxon(x).withColumn("version", F.lit(None).cast("string")))
    return out.select("version", "n", F.round("w", 6).alias("w"), F.round("p_value", 5).alias("p_value"), "exact")


@query
def binary_inventory(spark, d):
    """Files written from the tables, a file a binary, through the binary reader: version and architecture from the path, bytes, SHA-256."""
    path = place(spark, "binaries")
    f = b.functions(spark, d).groupBy("version", "arch").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("norm_name").alias("first"))
    body = F.repeat(F.concat_ws(" ", "version", "arch", F.col("n").cast("string"), F.col("bytes").cast("string"), "first"), F.lit(50))
    f.select("version", "arch", body.alias("value")).write.partitionBy("version", "arch").text(path)
    return readers.file_inventory(spark, path, r"/version=([^/]+)/arch=([^/]+)/[^/]+$", "*.txt").select("version", "arch", "size_bytes", "sha256")


@query
def resumed_features(spark, d):
    """Two runs: the first writes some binaries and ends before the others; the second finds what is missing and writes only that. What each
    binary has, and the run that wrote it."""
    f, path = b.stripped(spark, d).select("version", "arch", "function_id", "size"), place(spark, "resumed")
    n = written(f.groupBy("version", "arch").agg(F.count(F.lit(1)).alias("functions")), "binaries")
    none = n.select("version", "arch", F.lit("pending").alias("status"))
    early = f.join(F.broadcast(n.filter("functions % 3 != 0").select("version", "arch")), ["version", "arch"], "left_semi")  # a row a binary
    first = written(readers.write_missing(early.withColumn("run", F.lit(1)), none, path), "status")
    second = written(readers.write_missing(f.withColumn("run", F.lit(2)), first, path), "status")
    rows = spark.read.schema("function_id string, size bigint, run int, version string, arch string").parquet(path)
    state = first.unionByName(second).select("version", "arch", "status")
    out = rows.groupBy("version", "arch").agg(F.count(F.lit(1)).alias("functions"), F.sum("size").alias("bytes"), F.min("run").alias("first_run"), F.max("run").alias("last_run"))
    return out.join(F.broadcast(state), ["version", "arch"])  # a row a binary


@query
def symbol_stats_sketch(spark, d):
    """Percentiles of sizes by sketches beside the exact ones, by binary, by version (arch null) and over all (both null), the coarser from merged
    sketches; and whether the estimates' ranks are near enough."""
    rows = written(b.functions(spark, d).select("version", "arch", "size"), "sizes")
    fine = written(reports.size_sketches(rows, "version", "arch"), "sketches")
    parts = []
    for by in (["version", "arch"], ["version"], []):
        sketches = fine if len(by) == 2 else reports.merged_sketches(fine, *by)
        errors = reports.rank_errors(rows, reports.sketched_percentiles(sketches, *by), *by)
        exact = rows.groupBy(*by).agg(F.percentile("size", F.lit(list(reports.PERCENTILES))).alias("x"))
        told = errors.groupBy(*by).agg(F.first("functions").alias("functions"), F.max("rank_error").alias("error"))
        both = told.join(exact, by) if by else told.join(F.broadcast(exact))  # one row
        for c in ("version", "arch"):
            both = both if c in by else both.withColumn(c, F.lit(None).cast("string"))
        parts.append(both.select("version", "arch", "functions", *[F.round(F.col("x")[i], 6).alias(c) for i, c in enumerate(("median", "p90", "p99"))], (F.col("error") <= SKETCH_ERROR).alias("sketch_is_near")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def global_transfer_quality(spark, d):
    """How well changes on one architecture rank changes on another, all steps and pairs as one group, which ranges spread over tasks."""
    changes = evolution.version_change(evolution.size_map(b.functions(spark, d))).withColumn("rel_change", F.round("rel_change", 9))
    pairs = evolution.change_transfer_pairs(changes).withColumn("name", F.concat_ws("/", "norm_name", "old", "new", "src_arch", "dst_arch"))
    out = evolution.ranked_quality(pairs, [], "name", GROUP_ROWS)
    return out.select("n", "positives", F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("average_precision"))


@query
def version_choices(spark, d):
    """Versions by rule: the representative ones that there are, every n div 8-th where no named one is, and those whose binaries are all completed."""
    n = written(b.functions(spark, d).groupBy("version", "arch").agg(F.count(F.lit(1)).alias("n")), "binaries")
    state = F.when(F.col("n") % 17 == 0, "failed").when(F.col("n") % 11 == 0, "exists").otherwise("completed")
    rules = {
        "representative": reports.choose_versions(n),
        "stepped": reports.choose_versions(n, ("0.0.0",)),
        "stepped by three": reports.choose_versions(n, ("0.0.0",), 3),
        "completed": reports.completed_versions(n.withColumn("status", state), 5).select("version", F.col("completed").alias("place")),
    }
    out = [v.select(F.lit(rule).alias("rule"), "version", "place") for rule, v in rules.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query
def matched_scores(spark, d):
    """The whole chain: shapes of the stripped and the label side, mutual matches, features attached to the saved alignment, and all thirteen
    scorers over the matched functions under their labels' names, ties by match confidence: a row a method."""
    rows = written(b.method_records(spark, d), "records")
    stripped = written(shape.shape_features(rows.filter("address % 7 <> 0").withColumn("size", F.col("size") + F.col("address") % 3)), "stripped")
    named = written(rows.filter("address % 10 <> 0").select("version", "arch", "function_id", "address", "size", "norm_name"), "named")
    nine = ["version", "arch", "function_id", "address", *[F.round(c, 9).alias(c) for c in SHAPE]]
    matches = meeting.mutual_matches(stripped.select(*nine), shape.shape_features(named).select(*nine), SHAPE, SHAPE_SCALES)
    saved = matches.join(named.select("version", "arch", F.col("function_id").alias("label_id"), "norm_name"), ["version", "arch", "label_id"])
    saved = written(saved.select("version", "arch", "function_id", "norm_name", F.round("match_confidence", 6).alias("match_confidence")), "alignment")
    found = reports.reattach(stripped.drop("norm_name"), saved, ["version", "arch", "function_id"])
    return method_summary(found.withColumn("fitted", F.lit(True)))


_DIFF = f"{sql.TWO}, df AS (SELECT a.version, round(a.mrr_at_10 - c.mrr_at_10, 6) AS d FROM two a JOIN two c USING (version, src_arch, dst_arch) WHERE a.method = 'shape' AND c.method = 'size')"
_WILCOXON = f"""{_DIFF}, g AS (SELECT version, d FROM df WHERE d <> 0 UNION ALL SELECT NULL, d FROM df WHERE d <> 0),
k AS (SELECT version, d, rank() OVER (PARTITION BY version ORDER BY abs(d)) + (count(*) OVER (PARTITION BY version, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY version, abs(d)) AS t FROM g),
a AS (SELECT version, count(*) AS n, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, max(t) = 1 AND count(*) <= 50 AS exact, sum(t * t - 1)::DOUBLE AS tied FROM k GROUP BY version),
dp AS (SELECT n, c FROM (WITH RECURSIVE r(n, c) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT n + 1, list_transform(range(1, len(c) + n + 2), lambda i: coalesce(c[i], 0.0::DOUBLE) + CASE WHEN i > n + 1 THEN coalesce(c[i - n - 1], 0.0::DOUBLE) ELSE 0.0::DOUBLE END) FROM r WHERE n < 50) SELECT * FROM r)),
u AS (SELECT a.*, dp.c, abs(w - a.n * (a.n + 1) / 4.0::DOUBLE) / sqrt(a.n * (a.n + 1) * (2 * a.n + 1) / 24.0::DOUBLE - tied / 48) AS z FROM a LEFT JOIN dp ON dp.n = a.n),
e AS (SELECT *, (SELECT 2 / sqrt(pi()) * sum(exp(-1 * pow((i + 0.5) / 20000 * z / sqrt(2), 2))) * z / sqrt(2) / 20000 FROM range(20000) t(i)) AS erf_z FROM u)
SELECT version, n, round(w, 6) AS w, round(CASE WHEN exact THEN least(1.0::DOUBLE, 2 * list_sum(c[1:CAST(floor(w) AS INT) + 1]) / pow(2, n)) ELSE 1 - erf_z END, 5) AS p_value, exact FROM e"""
_BODY = "repeat(concat_ws(' ', version, arch, CAST(count(*) AS VARCHAR), CAST(CAST(sum(size) AS BIGINT) AS VARCHAR), min(norm_name)), 50) || chr(10)"
SQL = {
    "matched_scores": f"{sql.methods('true', 'true', True)} SELECT method, count(*) AS pairs, CAST(sum(queries) AS BIGINT) AS queries, {sql.AGGS} FROM m GROUP BY method",
    "version_choices": f"""WITH {sql.FX}, v AS (SELECT version, row_number() OVER (ORDER BY {sql.KEY3}) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT version FROM fx)), b AS (SELECT version, arch, count(*) AS n FROM fx GROUP BY ALL),
r AS (SELECT * FROM v WHERE replace(version, 'rel-', '') IN ('1.11.0', '1.14.0', '1.21.0', '1.28.4', '1.30.1', '1.33.1', '1.34.0', '1.37.0'))
SELECT 'representative' AS rule, version, place FROM r UNION ALL SELECT 'representative', version, place FROM v WHERE NOT EXISTS (SELECT 1 FROM r) AND place % greatest(1, n // 8) = 0 UNION ALL SELECT 'stepped', version, place FROM v WHERE place % greatest(1, n // 8) = 0
UNION ALL SELECT 'stepped by three', version, place FROM v WHERE place % greatest(1, n // 3) = 0 UNION ALL SELECT 'completed', version, count(*) FILTER (n % 17 <> 0 AND n % 11 <> 0) FROM b GROUP BY version HAVING count(*) FILTER (n % 17 <> 0 AND n % 11 <> 0) >= 5""",
    "wilcoxon_by_version": _WILCOXON,
    "binary_inventory": f"WITH {sql.FX}, t AS (SELECT version, arch, {_BODY} AS body FROM fx GROUP BY version, arch) SELECT version, arch, CAST(strlen(body) AS BIGINT) AS size_bytes, sha256(body) AS sha256 FROM t",
    "resumed_features": f"WITH {sql.FX}, {sql.STR} SELECT version, arch, count(*) AS functions, CAST(sum(size) AS BIGINT) AS bytes, CASE WHEN count(*) % 3 <> 0 THEN 1 ELSE 2 END AS first_run, CASE WHEN count(*) % 3 <> 0 THEN 1 ELSE 2 END AS last_run, 'completed' AS status FROM strip GROUP BY ALL",
    "symbol_stats_sketch": f"WITH {sql.FX} SELECT version, arch, count(*) AS functions, round(quantile_cont(size, 0.5), 6) AS median, round(quantile_cont(size, 0.9), 6) AS p90, round(quantile_cont(size, 0.99), 6) AS p99, true AS sketch_is_near FROM fx GROUP BY GROUPING SETS ((version, arch), (version), ())",
    "global_transfer_quality": f"""{sql.CHANGE}, cr AS (SELECT * REPLACE (round(rel_change, 9) AS rel_change) FROM ch), p AS (SELECT concat_ws('/', a.norm_name, a.old, a.new, a.arch, c.arch) AS name, a.rel_change AS score, CAST(c.rel_change >= 0.05 AND c.abs_change >= 16 AS INT) AS label FROM cr a JOIN cr c ON a.old = c.old AND a.new = c.new AND a.norm_name = c.norm_name AND a.arch <> c.arch),
 k AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS ar, row_number() OVER (ORDER BY score DESC, name) AS pl, sum(label) OVER (ORDER BY score DESC, name ROWS UNBOUNDED PRECEDING) AS fo FROM p),
 g AS (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, sum(ar) FILTER (label = 1) AS rs, sum(fo::DOUBLE / pl) FILTER (label = 1) AS ps FROM k)
 SELECT n, positives, round((rs - positives::DOUBLE * (positives + 1) / 2) / (positives::DOUBLE * (n - positives)), 6) AS auc, round(ps / positives, 6) AS average_precision FROM g""",
}
