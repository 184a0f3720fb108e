"""Further registered queries: vector retrieval, sweeps, scaling, inventories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, tokens, vectors
from ..functions.vectors import SHAPE
from ..operators import evolution, experiments, features, reports, retrieval, scoring, shape, sweep, temporal
from ..sources import bindings as b
from ..sources import readers
from ..sources.scratch import written
from . import dumps, sql
from .catalog import COLUMNS, PAIR, _by_size, _patch_rows, _two_methods, metrics, r6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _proto(v: DataFrame) -> DataFrame:
    return features.as_arrays(features.prototypes_other_versions(v).withColumnRenamed("test_version", "version"), "version", "norm_name", name="proto")


@query
def topk_rank(spark, d):
    v = b.vectors(spark, d)
    scored = sweep.best_in_blocks(v, _proto(v), (0.7, 0.1, 0.2))
    return sweep.full_retrieval(scored).select(*PAIR, "q_id", "c_id", "c_name", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _swept(spark, d, weights, low, high):
    """Every weighting over the versions from low to high; tokens, scalers and prototypes of each are fitted on the versions before it."""
    fits = _fits(spark, d)
    key = lambda v: [int(x) if x.isdigit() else 0 for x in v.rsplit("-", 1)[-1].split(".")]
    places = [i for i, v in enumerate(fits.versions) if i and key(low) <= key(v) <= key(high)]
    v = fits.vectors(F.col("place").isin(places))
    return sweep.configuration_summary(sweep.target_ranks(v, fits.prototype_arrays(places), weights))


SWEPT = ["config", "queries", "versions", "pairs", "prototype_coverage", *[f"{kind}_{m}" for m in retrieval.METRICS for kind in ("weighted", "macro")]]


def _rounded():
    return [F.round(c, 9).alias(c) if c not in ("config", "queries", "versions", "pairs") else F.col(c) for c in SWEPT]


@query
def weight_sweep(spark, d):
    s = sweep.validation_rank(_swept(spark, d, scoring.simplex(), "1.31.0", "1.33.0"))
    return s.select(*_rounded(), "place")


@query
def ablation(spark, d):
    return _swept(spark, d, scoring.ABLATION, "1.34.0", "1.36.0").select(*_rounded())


def _fits(spark, d):
    return temporal.Fits(shape.shape_features(written(b.method_records(spark, d), "records")))


@query
def temporal_frequency(spark, d):
    """Document frequencies and weights of every token for each version that has earlier ones, over those only. Tokens without an earlier record are left out."""
    fits = _fits(spark, d)
    each = F.explode(F.arrays_zip(F.lit(fits.versions).alias("version"), F.col("df"), F.col("idf")))
    return fits.weights["tokens"].select("token", each.alias("x")).filter("x.df > 0").select("x.version", "token", "x.df", F.round("x.idf", 9).alias("idf"))


@query
def temporal_scalers(spark, d):
    """Means and deviations of graph features, over all (arch null) and by architecture, for each version from the versions before it."""
    fits = _fits(spark, d)
    each = F.explode(F.arrays_zip(F.lit(fits.versions).alias("version"), F.col("n"), F.col("mean"), F.col("std")))
    return fits.scalers["graph_raw"].select("arch", "dim", each.alias("x")).filter("x.n > 0").select("x.version", "arch", "dim", "x.n", F.round("x.mean", 6).alias("mean"), F.round("x.std", 6).alias("std"))


@query
def temporal_prototypes(spark, d):
    """Prototypes of every name for each version that has earlier ones, with that version's weights and scalers; zeros are left out."""
    fits = _fits(spark, d)
    out = fits.prototypes(list(range(1, fits.n))).withColumn("version", F.get(F.lit(fits.versions), F.col("place")))
    return out.select("version", "norm_name", "dim", F.round("value", 6).alias("value")).filter("value != 0")


@query
def zscore(spark, d):
    v = b.vectors(spark, d)
    long = v.select("vec_id", "arch", F.posexplode("fusion_vec").alias("dim", "x"))
    s = features.fit_scalers(long).filter("arch IS NOT NULL").select("dim", "arch", "mean", "std")
    z = long.join(F.broadcast(s), ["dim", "arch"]).withColumn("z", (F.col("x") - F.col("mean")) / F.col("std"))
    return z.groupBy("vec_id").agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("norm"), F.max("z").alias("top")).select("vec_id", *r6("norm", "top"))


@query
def l2_normalize(spark, d):
    v = b.vectors(spark, d).select("vec_id", vectors.l2_normalize(F.col("fusion_vec")).alias("u"))
    return v.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.array_max("u"), 6).alias("top"))


@query
def shape_distance(spark, d):
    f = shape.shape_features(b.functions(spark, d).select(*COLUMNS), place=True).select("version", "arch", "function_id", "place", *SHAPE)
    f = shape.before(f, list(SHAPE))
    return f.select("function_id", F.round(vectors.shape_distance([F.col(c) for c in SHAPE], [F.col(f"p_{c}") for c in SHAPE]), 6).alias("distance"))


@query
def dense_stats(spark, d):
    s = b.stripped(spark, d)
    one = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    logs = [F.round(F.log(F.lit(1.0) + F.col(c)), 6).alias(f"log_{c}") for c in ("size", "instruction_count", "basic_block_count", "cfg_edge_count")]
    rates = [(F.col(c) / one("instruction_count")).alias(f"{c}_rate") for c in ("basic_block_count", "cfg_edge_count")]
    return s.select("version", "arch", "function_id", *logs, *rates, (F.col("instruction_count") / one("basic_block_count")).alias("block_size"), (F.col("cfg_edge_count") / one("basic_block_count")).alias("edge_density"))


@query
def transfer_calibration(spark, d):
    f = written(shape.shape_features(b.functions(spark, d).select(*COLUMNS)).drop("address", "size"), "shapes")
    q = retrieval.relevant_queries(f)
    return shape.calibrated(q.select(*PAIR, "function_id", *SHAPE), shape.binary_shape_stats(f)).select(*PAIR, "function_id", *r6(*SHAPE))


@query
def reattach_alignment(spark, d):
    saved = b.labels(spark, d).select("version", "arch", "function_id", F.col("norm_name").alias("label"))
    found = b.stripped(spark, d).select("version", "arch", "function_id")
    out = saved.join(found.withColumn("hit", F.lit(1)), ["version", "arch", "function_id"], "left")
    return out.groupBy("version", "arch").agg(F.count("hit").alias("attached"), F.count_if(F.col("hit").isNull()).alias("unmatched"))


@query
def binary_features(spark, d):
    """Size statistics of every binary with its bytes and section counts; what a binary lacks counts as 0."""
    s = reports.symbol_stats(b.functions(spark, d))
    m = b.stripped(spark, d).groupBy("version", "arch").agg(F.sum("size").alias("bytes")).filter("bytes % 2 = 0")
    header = dumps.QUERIES["header_dump"](spark, d).select(F.split("file", "/")[0].alias("version"), F.split("file", "/")[1].alias("arch"), "section_count", "debug_section_count")
    out = s.join(m, ["version", "arch"], "left").join(header.filter("section_count > 1"), ["version", "arch"], "left")
    sections = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("section_count", "debug_section_count")]
    return out.select("version", "arch", "functions", F.round(F.coalesce(F.col("bytes"), F.lit(0)) / F.lit(1048576.0), 6).alias("mib"), *r6("mean", "median", "p90", "p99"), *sections, names.range_label(F.col("version")).alias("label"))


@query
def experiment_rollup(spark, d):
    """Means of the metrics of all pairs, steps and architectures: a row a metric."""
    pairs = _by_size(spark, d)
    moves = evolution.change_transfer_pairs(evolution.version_change(evolution.size_map(b.functions(spark, d))).withColumn("rel_change", F.round("rel_change", 9)))
    moves = evolution.change_transfer(moves).withColumn("positive_changed_rate", F.col("positives") / F.col("n"))
    patch = evolution.classification_metrics(_patch_rows(spark, d), "arch")
    parts = (("retrieval", pairs, ("hit_at_1", "hit_at_5", "hit_at_10", "mrr_at_10")), ("change_transfer", moves, ("auc", "average_precision", "positive_changed_rate")), ("patch_state", patch, ("accuracy", "precision", "recall", "f1")))
    out = []
    for name, rows, columns in parts:
        means = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.avg(F.round(c, 6)).alias(c) for c in columns])
        each = F.explode(F.array(*[F.struct(F.lit(f"{name}_{c}").alias("experiment"), F.col(c).alias("value")) for c in columns]))
        out.append(means.select("rows", each.alias("e")).select("e.experiment", "rows", F.round("e.value", 8).alias("value")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def best_by_version(spark, d):
    s = retrieval.ranking(retrieval.summary(_two_methods(spark, d), "version", "method"), "version").filter("rank = 1")
    return s.select("version", "method", F.round("weighted_hit_at_1", 8).alias("hit_at_1"))


@query
def overall_ranking(spark, d):
    s = retrieval.summary(_two_methods(spark, d), "method").withColumn("all", F.lit(1))
    return retrieval.ranking(s, "all").select("method", F.col("rank").cast("long").alias("rank"), "queries")


@query
def pair_gain(spark, d):
    """What the windowed shape gains over exact size, source by destination, and each side's mean (a null side)."""
    p = experiments.paired_methods(_two_methods(spark, d), "shape", "size", "hit_at_10")
    means = p.groupingSets([["src_arch", "dst_arch"], ["src_arch"], ["dst_arch"]], "src_arch", "dst_arch").agg(F.count(F.lit(1)).alias("pairs"), F.avg("difference").alias("gain"))
    return means.select("src_arch", "dst_arch", "pairs", *r6("gain"))


@query
def paired_signs(spark, d):
    """Pairs where the shape is better, equal or worse, and the median difference, per version and over all (null)."""
    p = experiments.paired_methods(_two_methods(spark, d), "shape", "size", "hit_at_10").withColumn("difference", F.round("difference", 6))
    sign = lambda n, t: F.count_if(t).alias(n)
    x = F.col("difference")
    out = p.rollup("version").agg(sign("positive", x > 0), sign("tied", x == 0), sign("negative", x < 0), F.percentile("difference", F.lit(0.5)).alias("median"), (F.sum(x * F.col("queries")) / F.greatest(F.sum("queries"), F.lit(1))).alias("weighted"))
    return out.select("version", "positive", "tied", "negative", F.round("median", 8).alias("median"), *r6("weighted"))


@query
def latest_run(spark, d):
    """The last day on which every kind of step was seen."""
    e = b.status(spark, d)
    kinds = [r[0] for r in e.select("step").distinct().collect()]  # a handful
    return readers.latest_run(e.select(F.col("day").cast("string").alias("run"), F.col("step").alias("file")), kinds)


@query
def status_coverage(spark, d):
    """Completed hours of each kind of step against the hours of a day: only completed rows count, all rows are told."""
    e = b.status(spark, d).select("step", F.hour("ts").alias("h"), "status")
    out = e.groupBy("step").agg(F.count_distinct(F.when(F.col("status") == "completed", F.col("h"))).alias("completed"), F.count(F.lit(1)).alias("total_rows"))
    return out.withColumn("is_complete", (F.col("completed") >= 24).cast("int"))


@query
def token_classes(spark, d):
    """Classes of instruction tokens by their first word."""
    from .catalog import instruction_token

    t = instruction_token(spark, d)
    return t.groupBy(tokens.token_class(F.col("token")).alias("op_class")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tokens"))


@query
def consecutive_versions(spark, d):
    return evolution.consecutive_versions(b.functions(spark, d))


@query
def representative_versions(spark, d):
    v = b.functions(spark, d).select("version").distinct()
    order = Window.orderBy(names.version_key(F.col("version")), "version")  # a row a version
    v = v.withColumn("at", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    return v.filter("at % greatest(1, n div 3) = 0").select("version", F.col("at").cast("long").alias("place"))


@query
def shared_names(spark, d):
    return reports.shared_names(b.functions(spark, d))


@query
def extraction_report(spark, d):
    e = b.status(spark, d)
    t = e.groupBy("step").pivot("status", ["completed", "failed"]).agg(F.count(F.lit(1)))
    return t.select("step", F.coalesce("completed", F.lit(0)).alias("completed"), F.coalesce("failed", F.lit(0)).alias("failed"))


@query
def daily_status(spark, d):
    """Batch form of the streaming status counts: hourly windows by step and status."""
    e = b.status(spark, d)
    return e.groupBy(F.date_trunc("hour", "ts").alias("w"), "step", "status").agg(F.count(F.lit(1)).alias("n"), F.max("duration_sec").alias("mx")).select(F.date_format("w", "yyyy-MM-dd HH").alias("hour"), "step", "status", "n", F.round("mx", 6).alias("max_sec"))


_FX, _VEC = sql.FX, sql.VEC
# Fixed values, written again here so that the SQL doesn't take them from the code that it checks.
_SCALES = (1.0, 0.2, 0.2, 1.0, 1.0)
_ABLATION = [(0.70, 0.10, 0.20), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.0, 1.0 / 3.0, 2.0 / 3.0), (7.0 / 9.0, 0.0, 2.0 / 9.0), (7.0 / 8.0, 1.0 / 8.0, 0.0)]
_TENTHS = [(i / 10, j / 10, (10 - i - j) / 10) for i in range(11) for j in range(11 - i)]
_G = " + ".join(f"((q.v[{i}] - c.v[{i}]) / {s!r}::DOUBLE) ** 2" for i, s in enumerate(_SCALES, 1))
_COS = "CASE WHEN list_dot_product({a}, {a}) <= 1e-12 OR list_dot_product({b}, {b}) <= 1e-12 THEN 0 ELSE list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})) END"
_PAIRED = f"""{sql.LOVO}, pr AS (SELECT test_version, norm_name, list(value ORDER BY dim) AS p FROM pv WHERE tn > 0 GROUP BY ALL),
comp AS (SELECT q.version, q.arch AS src_arch, c.arch AS dst_arch, q.vec_id AS q_id, q.norm_name AS q_name, c.vec_id AS c_id, c.norm_name AS c_name, -({_G}) AS g, {_COS.format(a='q.v', b='c.v')} AS f, coalesce({_COS.format(a='c.v', b='pr.p')}, 0) AS p
 FROM vec q JOIN vec c ON c.version = q.version AND c.arch <> q.arch LEFT JOIN pr ON pr.test_version = q.version AND pr.norm_name = q.norm_name)"""


def _sweep_sql(weights: list[tuple[float, float, float]], low: str, high: str) -> str:
    grid = ", ".join(f"({i}, {g!r}::DOUBLE, {f!r}::DOUBLE, {p!r}::DOUBLE)" for i, (g, f, p) in enumerate(weights))
    m = "avg(CASE WHEN rnk <= {k} THEN 1.0::DOUBLE ELSE 0 END) AS hit_at_{k}"
    gaps = " + ".join(f"((q.shp[{i}] - c.shp[{i}]) / {s!r}::DOUBLE) ** 2" for i, s in enumerate(_SCALES, 1))
    both = ", ".join(f"round(sum({x} * queries) / sum(queries), 9) AS weighted_{x}, round(avg({x}), 9) AS macro_{x}" for x in ("hit_at_1", "hit_at_5", "hit_at_10", "mrr_at_10", "mean_inspected_at_10"))
    return f"""{sql.temporal(low, high)}, cur AS (SELECT * FROM tv WHERE version = tested), comp AS (SELECT q.version, q.arch AS src_arch, c.arch AS dst_arch, q.function_id AS q_id, q.norm_name AS q_name, c.norm_name AS c_name, tp.p IS NOT NULL AS has,
 -({gaps}) AS g, {_COS.format(a='q.v', b='c.v')} AS f, coalesce({_COS.format(a='c.v', b='tp.p')}, 0) AS p FROM cur q JOIN cur c ON c.version = q.version AND c.arch <> q.arch LEFT JOIN tp ON tp.tested = q.version AND tp.norm_name = q.norm_name),
grid(config, wg, wf, wp) AS (VALUES {grid}), sc AS (SELECT comp.*, config, round(wg * g + wf * f + wp * p, 9) AS s FROM comp, grid),
bt AS (SELECT version, src_arch, dst_arch, q_id, config, max(s) AS best FROM sc WHERE c_name = q_name GROUP BY ALL),
rk AS (SELECT bt.version, bt.src_arch, bt.dst_arch, bt.q_id, bt.config, any_value(has) AS has, 1 + count(*) FILTER (s > best) AS rnk FROM bt JOIN sc USING (version, src_arch, dst_arch, q_id, config) GROUP BY ALL),
pr AS (SELECT CAST(config AS INT) AS config, version, src_arch, dst_arch, count(*) AS queries, count(*) FILTER (has) AS protos, {m.format(k=1)}, {m.format(k=5)}, {m.format(k=10)}, avg(CASE WHEN rnk <= 10 THEN 1.0::DOUBLE / rnk ELSE 0 END) AS mrr_at_10,
 avg(CAST(least(rnk, 11) AS DOUBLE)) AS mean_inspected_at_10 FROM rk GROUP BY ALL),
sm AS (SELECT config, CAST(sum(queries) AS BIGINT) AS queries, count(DISTINCT version) AS versions, count(*) AS pairs, round(sum(protos) / sum(queries), 9) AS prototype_coverage, {both} FROM pr GROUP BY config)"""


_SD = " + ".join(f"(({c} - p_{c}) / {s!r}::DOUBLE) ** 2" for c, s in zip(SHAPE, _SCALES, strict=True))
SQL: dict[str, str] = {
    "topk_rank": f"{_PAIRED}, s AS (SELECT *, round(0.7::DOUBLE * g + 0.1::DOUBLE * f + 0.2::DOUBLE * p, 9) AS score FROM comp) SELECT version, src_arch, dst_arch, q_id, c_id, c_name, row_number() OVER w AS rank, round(score, 6) AS score FROM s WINDOW w AS (PARTITION BY version, src_arch, dst_arch, q_id ORDER BY s.score DESC, c_id DESC, c_name DESC) QUALIFY row_number() OVER w <= 10",
    "weight_sweep": _sweep_sql(_TENTHS, "rel-1.31.0", "rel-1.33.0") + " SELECT *, row_number() OVER (ORDER BY weighted_hit_at_10 DESC, weighted_hit_at_1 DESC, weighted_mrr_at_10 DESC, config) AS place FROM sm",
    "ablation": _sweep_sql(_ABLATION, "rel-1.34.0", "rel-1.36.0") + " SELECT * FROM sm",
    "temporal_frequency": f"{sql.temporal('rel-1.0.0', 'rel-1.99.0')} SELECT tested AS version, token, df, round(idf, 9) AS idf FROM tokensd WHERE df > 0",
    "temporal_scalers": f"{sql.temporal('rel-1.0.0', 'rel-1.99.0')}, l AS (SELECT tested, arch, unnest(raw) AS x, unnest(range(len(raw))) AS dim FROM rt WHERE fitted) SELECT tested AS version, arch, CAST(dim AS INT) AS dim, count(*) AS n, round(avg(x), 6) AS mean, round(CASE WHEN var_pop(x) <= 1e-9 THEN 1 ELSE sqrt(var_pop(x)) END, 6) AS std FROM l GROUP BY GROUPING SETS ((tested, arch, dim), (tested, dim))",
    "temporal_prototypes": f"{sql.temporal('rel-1.0.0', 'rel-1.99.0')} SELECT tested AS version, norm_name, CAST(dim AS INT) AS dim, round(value, 6) AS value FROM tl WHERE round(value, 6) <> 0",
    "zscore": f"WITH {_VEC}, {sql.LONG}, sc AS (SELECT arch, dim, avg(x) AS m, CASE WHEN var_pop(x) <= 1e-9 THEN 1 ELSE sqrt(var_pop(x)) END AS s FROM long GROUP BY ALL), z AS (SELECT vec_id, (x - m) / s AS z FROM long JOIN sc USING (arch, dim)) SELECT vec_id, round(sqrt(sum(z * z)), 6) AS norm, round(max(z), 6) AS top FROM z GROUP BY vec_id",
    "l2_normalize": f"WITH {_VEC}, u AS (SELECT vec_id, v, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS n FROM vec) SELECT vec_id, round(v[1] / n, 6) AS first, round(list_max(v) / n, 6) AS top FROM u",
    "shape_distance": f"WITH {_FX}, {sql.shaped('sh', 'fx')}, l AS (SELECT function_id, {', '.join(SHAPE)}, {', '.join(f'lag({c}) OVER w AS p_{c}' for c in SHAPE)} FROM sh WINDOW w AS (PARTITION BY version, arch ORDER BY address, size, norm_name, function_id)) SELECT function_id, round({_SD}, 6) AS distance FROM l WHERE p_log_size IS NOT NULL",
    "dense_stats": f"WITH {_FX}, {sql.STR}, s AS (SELECT version, arch, function_id, size, greatest(size // 4, 1) AS ic, CAST(quantity AS BIGINT) AS bc, CAST(quantity + l_linenumber AS BIGINT) AS ec FROM strip) SELECT version, arch, function_id, round(ln(1.0::DOUBLE + size), 6) AS log_size, round(ln(1.0::DOUBLE + ic), 6) AS log_instruction_count, round(ln(1.0::DOUBLE + bc), 6) AS log_basic_block_count, round(ln(1.0::DOUBLE + ec), 6) AS log_cfg_edge_count, bc::DOUBLE / ic AS basic_block_count_rate, ec::DOUBLE / ic AS cfg_edge_count_rate, ic::DOUBLE / greatest(bc, 1) AS block_size, ec::DOUBLE / greatest(bc, 1) AS edge_density FROM s",
    "transfer_calibration": f"WITH {_FX}, {sql.PAIRS}, {sql.shaped('sh', 'fx')}, {sql.relevant('sh')}, {sql.ALL_QUERIES}, st AS (SELECT version, arch, {', '.join(f'avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) <= 1e-9 THEN 1 ELSE stddev_pop({c}) END AS {c}_s' for c in SHAPE)} FROM sh GROUP BY ALL) SELECT q.version, q.src_arch, q.dst_arch, q.function_id, {', '.join(f'round(d.{c}_m + (q.{c} - s.{c}_m) / s.{c}_s * d.{c}_s, 6) AS {c}' for c in SHAPE)} FROM q JOIN st s ON s.version = q.version AND s.arch = q.src_arch JOIN st d ON d.version = q.version AND d.arch = q.dst_arch",
    "reattach_alignment": f"WITH {_FX}, {sql.LAB}, {sql.STR} SELECT l.version, l.arch, count(s.function_id) AS attached, count(*) FILTER (s.function_id IS NULL) AS unmatched FROM lab l LEFT JOIN strip s ON s.version = l.version AND s.arch = l.arch AND s.function_id = l.function_id GROUP BY ALL",
    "binary_features": f"WITH {_FX}, {sql.STR}, {sql.STATS}, m AS (SELECT version, arch, CAST(sum(size) AS BIGINT) AS bytes FROM strip GROUP BY ALL HAVING sum(size) % 2 = 0), hd AS (SELECT split_part(file, '/', 1) AS version, split_part(file, '/', 2) AS arch, section_count, debug_section_count FROM ({dumps.SQL['header_dump']}) WHERE section_count > 1) SELECT version, arch, functions, round(coalesce(bytes, 0) / 1048576.0::DOUBLE, 6) AS mib, round(mean, 6) AS mean, round(median, 6) AS median, round(p90, 6) AS p90, round(p99, 6) AS p99, coalesce(section_count, 0) AS section_count, coalesce(debug_section_count, 0) AS debug_section_count, CAST({sql.RANGE_LABEL} AS INT) AS label FROM st LEFT JOIN m USING (version, arch) LEFT JOIN hd USING (version, arch)",
    "experiment_rollup": " UNION ALL ".join(
        f"SELECT '{name}_{c}' AS experiment, count(*) AS rows, round(avg(round({e}, 6)), 8) AS value FROM ({sql.SQL[query_name]})"
        for name, query_name, columns in (
            ("retrieval", "cross_arch_size_retrieval", {c: c for c in ("hit_at_1", "hit_at_5", "hit_at_10", "mrr_at_10")}),
            ("change_transfer", "change_transfer", {"auc": "auc", "average_precision": "average_precision", "positive_changed_rate": "positives::DOUBLE / n"}),
            ("patch_state", "classification_metrics", {c: c for c in ("accuracy", "precision", "recall", "f1")}),
        )
        for c, e in columns.items()
    ),
    "best_by_version": f"WITH s AS ({sql.SQL['summary_by_version']}) SELECT version, method, weighted_hit_at_1 AS hit_at_1 FROM s WHERE rank = 1",
    "overall_ranking": f"WITH s AS ({sql.SQL['summary_by_method']}) SELECT method, row_number() OVER (ORDER BY round(weighted_hit_at_1, 6) DESC, round(weighted_hit_at_10, 6) DESC, round(weighted_mrr_at_10, 6) DESC, round(weighted_mean_inspected_at_10, 6), method) AS rank, queries FROM s",
    "pair_gain": f"{sql.PD} SELECT src_arch, dst_arch, count(*) AS pairs, round(avg(difference), 6) AS gain FROM pd GROUP BY GROUPING SETS ((src_arch, dst_arch), (src_arch), (dst_arch))",
    "paired_signs": f"{sql.PD} SELECT version, count(*) FILTER (difference > 0) AS positive, count(*) FILTER (difference = 0) AS tied, count(*) FILTER (difference < 0) AS negative, round(quantile_cont(difference, 0.5), 8) AS median, round(sum(difference * queries) / greatest(sum(queries), 1), 6) AS weighted FROM pr GROUP BY ROLLUP (version)",
    "latest_run": "WITH w AS (SELECT strftime(ts, '%Y-%m-%d') AS run FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)) SELECT max(run) AS run FROM w",
    "status_coverage": "SELECT event_type AS step, count(DISTINCT hour(ts)) FILTER (value >= 5) AS completed, count(*) AS total_rows, CAST(count(DISTINCT hour(ts)) FILTER (value >= 5) >= 24 AS INT) AS is_complete FROM events GROUP BY 1",
    "token_classes": f"WITH t AS ({sql.SQL['instruction_token']}) SELECT split_part(token, ' ', 1) AS op_class, CAST(sum(n) AS BIGINT) AS n, count(*) AS tokens FROM t GROUP BY 1",
    "consecutive_versions": f"WITH {_FX}, {sql.SMAP}, {sql.STEPS} SELECT arch, old, new FROM steps",
    "representative_versions": f"WITH {_FX}, v AS (SELECT version, row_number() OVER (ORDER BY version) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT version FROM fx)) SELECT version, place FROM v WHERE place % greatest(1, n // 3) = 0",
    "shared_names": f"WITH {_FX}, n AS (SELECT version, norm_name, count(DISTINCT arch) AS arches FROM fx GROUP BY ALL) SELECT version, count(*) FILTER (arches = (SELECT count(DISTINCT arch) FROM fx WHERE fx.version = n.version)) AS in_all, count(*) AS in_any FROM n GROUP BY version",
    "extraction_report": "SELECT event_type AS step, count(*) FILTER (value >= 5) AS completed, count(*) FILTER (value < 5) AS failed FROM events GROUP BY step",
    "daily_status": "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type AS step, CASE WHEN value < 5 THEN 'failed' ELSE 'completed' END AS status, count(*) AS n, round(max(value), 6) AS max_sec FROM events GROUP BY ALL",
}
