"""Registered queries over dumps and report tables. Dumps are text, CSV and JSON that Spark writes from the tables; the readers read them again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components, evolution, experiments, features, reports
from ..sources import bindings as b
from ..sources import readers
from ..sources.scratch import place
from . import sql
from .catalog import ARCHES, _two_methods, matching_summary, r6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# dumps


@query
def symbol_dump(spark, d):
    """Symbol tables' text to function symbols."""
    f, path = b.functions(spark, d), place(spark, "symbol-text")
    kind = F.when(F.col("l_suppkey") % 3 == 0, "OBJECT").otherwise("FUNC")
    line = F.format_string("%6d: %08x %5d %s GLOBAL DEFAULT %4d %s", "l_linenumber", "address", "size", kind, "quantity", "name")
    f.select("version", "arch", line.alias("value")).write.partitionBy("version", "arch").text(path)
    rows = readers.parse_symbol_dump(spark.read.text(path))
    return rows.select("version", "arch", "address", F.col("size").cast("long").alias("size"), "bind", "section_index", "name")


@query
def header_dump(spark, d):
    """Headers' text, a file a binary, to fields and section facts."""
    path = place(spark, "header-text")
    n = b.functions(spark, d).groupBy("version", "arch").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    lines = F.array(
        F.lit("  Class:                             ELF32"),
        F.lit("  Data:                              2's complement, little endian"),
        F.concat(F.lit("  Machine:                           "), F.col("arch")),
        F.concat(F.lit("  Entry point address:               0x"), F.lower(F.hex("bytes"))),
        F.lit("  [ 0]                   NULL             00000000"),
        F.lit("  [ 1] .text             PROGBITS         00000000"),
        F.when(F.col("n") % 2 == 0, "  [ 2] .symtab           SYMTAB           00000000"),
        F.when(F.col("n") % 3 == 0, "  [ 3] .debug_info       PROGBITS         00000000"),
        F.when(F.col("n") % 3 == 0, "  [ 4] .debug_line       PROGBITS         00000000"),
    )
    rows = n.select(F.concat_ws("/", "version", "arch").alias("file"), F.explode(F.array_compact(lines)).alias("value"))
    rows.write.partitionBy("file").text(path)
    return readers.parse_header_dump(spark.read.text(path)).select("file", "elf_class", "endian", "machine", "entry", "section_count", "has_symtab", "has_strtab", "has_debug", "debug_section_count")


SYMBOL_FIELDS = [c.split()[0] for c in readers.SYMBOLS.split(", ")]


@query
def symbols_read(spark, d):
    """A zipped symbol CSV, written with fixed columns and read back: rows that don't cast, without a name or too small go."""
    f, path = b.functions(spark, d), place(spark, "symbols")
    text = lambda x: F.lit(x)
    made = {
        "binary_name": F.concat_ws("-", "version", "arch"), "size": F.when(F.col("l_suppkey") % 11 == 0, "n/a").otherwise(F.col("size").cast("string")),
        "type": text("FUNC"), "bind": text("GLOBAL"), "visibility": text("DEFAULT"), "section_index": F.col("quantity").cast("string"),
        "norm_name": F.when(F.col("l_partkey") % 13 == 0, "").otherwise(F.col("norm_name")), "analysis_func": (F.col("l_linenumber") % 4 != 0).cast("int"),
    }
    readers.write_results(f.withColumns(made), path, SYMBOL_FIELDS, compression="gzip")
    return readers.read_symbols(spark, path, min_size=16).select("version", "arch", "address", F.col("size").cast("long").alias("size"), "name", "norm_name")


def _dumped_features(spark, d):
    """Function features as JSON lines in folders by version, and read back."""
    return readers.read_features(spark, feature_dump(spark, d, "gzip"), files="*.json.gz")


def feature_dump(spark, d, compression=None):
    """The folder to which function features were written, as .json, or as .json.gz by gzip."""
    s, path = b.stripped(spark, d), place(spark, "features")
    entry = lambda name, value, n: F.array(F.struct(value.alias(name), n.cast("long").alias("count")))
    edges = F.transform(F.sequence(F.lit(1), F.col("l_linenumber").cast("int")), lambda i: F.array(i.cast("string"), (i + 1).cast("string"), F.when(i % 2 == 0, "FALL_THROUGH").otherwise("CONDITIONAL_JUMP")))
    stats = F.struct("instruction_count", "basic_block_count", "cfg_edge_count", *[F.expr(f"cast({e} as bigint)").alias(c) for c, e in (("call_count", "l_suppkey % 5"), ("branch_count", "l_linenumber"), ("ret_count", "1"), ("string_ref_count", "quantity % 4"), ("constant_count", "l_partkey % 6"))])
    rows = s.select(
        "version", "arch", "function_id", "size", stats.alias("stats"),
        F.concat_ws("/", "version", "arch").alias("binary_id"),
        F.concat(F.lit("0x"), F.lower(F.hex("address"))).alias("start_addr"),
        F.array(F.lit("MOVE REG"), F.when(F.col("l_partkey") % 2 == 0, "LOAD MEM").otherwise("CALL ADDR"), F.lit("RET")).alias("tokens"),
        F.lit(0).alias("token_truncated"), edges.alias("cfg_edges"),
        F.array(F.struct(F.when(F.col("l_suppkey") % 2 == 0, "external").otherwise("internal").alias("kind"))).alias("call_refs"),
        entry("category", F.concat(F.lit("path_like:"), (F.col("l_suppkey") % 3).cast("string")), F.col("quantity") % 4).alias("string_refs"),
        entry("bucket", F.when(F.col("l_partkey") % 3 == 0, "IMM_ZERO").otherwise("IMM_SMALL"), F.col("l_partkey") % 6).alias("constant_buckets"),
        F.when(F.col("l_partkey") % 17 == 0, F.struct(F.lit("no body").alias("error"))).alias("extract_error"),
    )
    rows.write.option("compression", compression or "none").partitionBy("version").json(path)
    return path


@query
def features_read(spark, d):
    f = _dumped_features(spark, d)
    counts = [F.col(f"stats.{c}").alias(c) for c in components.STATS]
    return f.select("version", "arch", "function_id", "address", "size", *counts, F.size("tokens").cast("long").alias("tokens"), F.array_join("edge_types", " ").alias("edge_types"))


@query
def feature_histograms(spark, d):
    """Operation classes, edge types and contexts of every binary's functions."""
    return features.feature_histograms(_dumped_features(spark, d), "version", "arch")


@query
def merged_features(spark, d):
    """Features of the binaries whose extraction ended well, as one table by version and architecture."""
    f, path = _dumped_features(spark, d), place(spark, "merged")
    n = b.functions(spark, d).groupBy("version", "arch").agg(F.count(F.lit(1)).alias("n"))
    status = n.select(F.concat_ws("/", "version", "arch").alias("binary_id"), F.expr("element_at(array('failed', 'completed', 'exists'), cast(n % 3 + 1 as int))").alias("status"))
    readers.write_merged(f.select("version", "arch", "binary_id", "function_id", "size"), status, path)
    schema = "binary_id string, function_id string, size bigint, version string, arch string"
    return spark.read.schema(schema).parquet(path).groupBy("version", "arch").agg(F.count(F.lit(1)).alias("functions"), F.sum("size").alias("bytes"))


@query
def summaries_read(spark, d):
    """Small JSON files of function counts, a list a version."""
    path = place(spark, "summaries")
    n = b.functions(spark, d).groupBy("version", "arch").agg(F.count(F.lit(1)).alias("function_count"), F.max("quantity").cast("double").alias("duration_sec"))
    one = F.struct(F.concat_ws("/", "version", "arch").alias("binary_id"), "version", "arch", F.lit("completed").alias("status"), "function_count", "duration_sec")
    n.groupBy("version").agg(F.to_json(F.collect_list(one), {"pretty": "true"}).alias("value")).write.partitionBy("version").text(path)
    return readers.read_summaries(spark, path, files="*.txt").select("binary_id", "version", "arch", "status", "function_count", "duration_sec")


@query
def result_tables(spark, d):
    """A result table written as CSV and read back by its columns' names."""
    path = place(spark, "results")
    s = reports.symbol_stats(b.functions(spark, d))
    readers.write_results(s, path, ["p99", "arch", "functions", "version", "mean"])
    return readers.read_result_tables(spark, path, "version string, arch string, functions bigint, mean double, p99 double").select("version", "arch", "functions", *r6("mean", "p99"))


# report tables


@query
def binary_manifest(spark, d):
    """The first ten binaries of three architectures in order of version and architecture."""
    n = b.functions(spark, d).groupBy("version", "arch").agg(F.count(F.lit(1)).alias("functions"))
    return reports.select_binaries(n, arches=ARCHES[:3], most=10)


@query
def leave_one_arch(spark, d):
    return reports.leave_one_arch(b.functions(spark, d).groupBy("arch").agg(F.count(F.lit(1)).alias("functions")))


@query
def manifest_summary(spark, d):
    """Paired and stripped-only binaries, over all and by architecture."""
    s = b.stripped(spark, d).select("version", "arch").distinct()
    u = b.labels(spark, d).filter("quantity > 10 AND version < 'rel-1.35.0'").select("version", "arch").distinct()
    return reports.manifest_summary(reports.pair_artifacts(s, u))


@query
def attached_alignment(spark, d):
    """Stripped functions with the labels of a saved alignment, of which every row must be found."""
    keys = ["version", "arch", "function_id"]
    found = b.stripped(spark, d).select(*keys, "size", "basic_block_count")
    saved = b.labels(spark, d).filter("l_orderkey % 7 != 0").select(*keys, F.col("norm_name").alias("label"))
    return reports.reattach(found, saved, keys)


@query
def graph_vectors(spark, d):
    """The 36 numbers of a record's graph vector, in long form."""
    v = b.method_records(spark, d).select("function_id", F.posexplode(components.graph_vector()).alias("dim", "x"))
    return v.select("function_id", "dim", F.round("x", 6).alias("value"))


@query
def version_trend(spark, d):
    """Hits in ten of both methods, a row a version."""
    t = _two_methods(spark, d).groupBy("version").pivot("method", ["size", "shape"]).agg(F.round(F.avg(F.round("hit_at_10", 6)), 8))
    return t.select("version", F.col("size").alias("size_hit_at_10"), F.col("shape").alias("shape_hit_at_10"))


@query
def difference_bins(spark, d):
    """The differences of the two methods in 31 bins."""
    p = experiments.paired_methods(_two_methods(spark, d), "shape", "size", "hit_at_10").withColumn("difference", F.round("difference", 6))
    return reports.even_bins(p, "difference", 31)


@query
def recovered_bins(spark, d):
    """Functions recovered of a binary in 18 bins."""
    n = b.stripped(spark, d).groupBy("version", "arch").agg(F.count(F.lit(1)).alias("n"))
    return reports.even_bins(n.withColumn("n", F.col("n").cast("double")), "n", 18)


@query
def match_ratios(spark, d):
    """Mean shares of labels and of stripped functions that are matched, by architecture."""
    m = matching_summary(spark, d).groupBy("arch").agg(F.avg("label_ratio").alias("labels"), F.avg("stripped_ratio").alias("stripped"))
    return m.select("arch", F.round("labels", 8).alias("labels"), F.round("stripped", 8).alias("stripped"))


@query
def patch_deltas(spark, d):
    """Changes of size of the probed names, a column an architecture."""
    p = evolution.patch_probe(evolution.size_map(b.functions(spark, d)), "rel-1.31.0", "rel-1.32.0", "fn_1")
    t = p.filter("state != 'unchanged'").groupBy("norm_name").pivot("arch", ARCHES).agg(F.sum("delta"))
    return t.select("norm_name", *[F.col(f"`{a}`").alias(f"to_{i}") for i, a in enumerate(ARCHES, 1)])


_BY_BINARY = f"WITH {sql.FX}, n AS (SELECT version, arch, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, max(quantity) AS q FROM fx GROUP BY ALL)"
_FEATURES = f"""WITH {sql.FX}, {sql.STR}, ft AS (SELECT *, size // 4 AS ic, quantity + l_linenumber AS ec, list_transform(range(1, l_linenumber + 1), lambda i: CASE WHEN i % 2 = 0 THEN 'FALL_THROUGH' ELSE 'CONDITIONAL_JUMP' END) AS edges
 FROM strip WHERE size >= 16 AND l_partkey % 17 <> 0)"""


def _even_bins(x: str, bins: int, source: str) -> str:
    return f"""e AS (SELECT CAST(min({x}) AS DOUBLE) AS l0, CAST(max({x}) AS DOUBLE) AS h0 FROM {source}), ends AS (SELECT CASE WHEN l0 = h0 THEN l0 - 0.5 ELSE l0 END AS low, CASE WHEN l0 = h0 THEN h0 + 0.5 ELSE h0 END AS high FROM e)
SELECT CAST(least(floor(({x} - low) / (high - low) * {bins}), {bins - 1}) AS INT) AS bin, count(*) AS n FROM {source}, ends GROUP BY 1"""


_KEY = sql.KEY3
SQL: dict[str, str] = {
    "symbol_dump": f"WITH {sql.FX} SELECT version, arch, address, size, 'GLOBAL' AS bind, CAST(quantity AS VARCHAR) AS section_index, name FROM fx WHERE l_suppkey % 3 <> 0",
    "header_dump": f"""{_BY_BINARY} SELECT concat(version, '/', arch) AS file, 'ELF32' AS elf_class, '2''s complement, little endian' AS endian, arch AS machine, '0x' || lower(to_hex(bytes)) AS entry,
 CAST(1 + CAST(n % 2 = 0 AS INT) + 2 * CAST(n % 3 = 0 AS INT) AS BIGINT) AS section_count, CAST(n % 2 = 0 AS INT) AS has_symtab, 0 AS has_strtab, CAST(n % 3 = 0 AS INT) AS has_debug, CAST(2 * CAST(n % 3 = 0 AS INT) AS BIGINT) AS debug_section_count FROM n""",
    "symbols_read": f"WITH {sql.FX} SELECT version, arch, address, size, name, norm_name FROM fx WHERE l_suppkey % 11 <> 0 AND l_partkey % 13 <> 0 AND l_linenumber % 4 <> 0 AND size >= 16",
    "features_read": f"""{_FEATURES} SELECT version, arch, function_id, address, size, ic AS instruction_count, CAST(quantity AS BIGINT) AS basic_block_count, CAST(ec AS BIGINT) AS cfg_edge_count, CAST(l_suppkey % 5 AS BIGINT) AS call_count, CAST(l_linenumber AS BIGINT) AS branch_count,
 CAST(1 AS BIGINT) AS ret_count, CAST(quantity % 4 AS BIGINT) AS string_ref_count, CAST(l_partkey % 6 AS BIGINT) AS constant_count, CAST(3 AS BIGINT) AS tokens, array_to_string(edges, ' ') AS edge_types FROM ft""",
    "feature_histograms": f"""{_FEATURES}, every AS (
 SELECT version, arch, 'op' AS kind, 'MOVE' AS key, 1 AS n FROM ft UNION ALL SELECT version, arch, 'op', CASE WHEN l_partkey % 2 = 0 THEN 'LOAD' ELSE 'CALL' END, 1 FROM ft UNION ALL SELECT version, arch, 'op', 'RET', 1 FROM ft
 UNION ALL SELECT version, arch, 'edge', unnest(edges), 1 FROM ft
 UNION ALL SELECT version, arch, 'ctx', 'str:path_like:' || CAST(l_suppkey % 3 AS VARCHAR), quantity % 4 FROM ft
 UNION ALL SELECT version, arch, 'ctx', CASE WHEN l_partkey % 3 = 0 THEN 'const:IMM_ZERO' ELSE 'const:IMM_SMALL' END, l_partkey % 6 FROM ft
 UNION ALL SELECT version, arch, 'ctx', CASE WHEN l_suppkey % 2 = 0 THEN 'call:external' ELSE 'call:internal' END, 1 FROM ft)
SELECT version, arch, kind, key, CAST(sum(n) AS BIGINT) AS n FROM every GROUP BY ALL""",
    "merged_features": f"""{_FEATURES}, st AS (SELECT version, arch, count(*) AS n FROM fx GROUP BY ALL HAVING count(*) % 3 > 0) SELECT ft.version, ft.arch, count(*) AS functions, CAST(sum(size) AS BIGINT) AS bytes FROM ft JOIN st USING (version, arch) GROUP BY ALL""",
    "summaries_read": f"{_BY_BINARY} SELECT concat(version, '/', arch) AS binary_id, version, arch, 'completed' AS status, n AS function_count, CAST(q AS DOUBLE) AS duration_sec FROM n",
    "result_tables": f"WITH {sql.FX}, {sql.STATS} SELECT version, arch, functions, round(mean, 6) AS mean, round(p99, 6) AS p99 FROM st",
    "binary_manifest": f"{_BY_BINARY} SELECT version, arch, n AS functions FROM n WHERE arch IN ('1-URGENT', '2-HIGH', '3-MEDIUM') ORDER BY {_KEY}, version, arch LIMIT 10",
    "leave_one_arch": f"{_BY_BINARY}, a AS (SELECT arch, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY arch) SELECT t.arch AS test_arch, string_agg(o.arch, ',' ORDER BY o.arch) AS train_arches, t.n AS test_functions, CAST(sum(o.n) AS BIGINT) AS train_functions FROM a t JOIN a o ON o.arch <> t.arch GROUP BY ALL",
    "manifest_summary": f"""WITH {sql.FX}, {sql.STR}, {sql.LAB}, s AS (SELECT DISTINCT version, arch FROM strip), u AS (SELECT DISTINCT version, arch, 1 AS has FROM lab WHERE quantity > 10 AND version < 'rel-1.35.0'), p AS (SELECT version, arch, has FROM s LEFT JOIN u USING (version, arch))
 SELECT arch, count(*) AS binaries, count(has) AS paired, count(*) - count(has) AS stripped_only, arg_min(version, {_KEY}) AS first_version, arg_max(version, {_KEY}) AS last_version FROM p GROUP BY ROLLUP (arch)""",
    "attached_alignment": f"WITH {sql.FX}, {sql.STR}, {sql.LAB} SELECT version, arch, function_id, s.size, CAST(s.quantity AS BIGINT) AS basic_block_count, l.norm_name AS label FROM strip s JOIN lab l USING (version, arch, function_id)",
    "graph_vectors": f"{sql.methods('true', 'true')} SELECT function_id, CAST(unnest(range(len(raw))) AS INT) AS dim, round(unnest(raw), 6) AS value FROM base",
    "version_trend": f"WITH s AS ({sql.SQL['summary_by_version']}) SELECT version, max(macro_hit_at_10) FILTER (method = 'size') AS size_hit_at_10, max(macro_hit_at_10) FILTER (method = 'shape') AS shape_hit_at_10 FROM s GROUP BY version",
    "difference_bins": f"{sql.PD}, {_even_bins('difference', 31, 'pr')}",
    "recovered_bins": f"WITH {sql.FX}, {sql.STR}, c AS (SELECT version, arch, CAST(count(*) AS DOUBLE) AS x FROM strip GROUP BY ALL), {_even_bins('x', 18, 'c')}",
    "match_ratios": f"WITH m AS ({sql.SQL['matching_summary']}) SELECT arch, round(avg(label_ratio), 8) AS labels, round(avg(stripped_ratio), 8) AS stripped FROM m GROUP BY arch",
    "patch_deltas": f"WITH p AS ({sql.SQL['patch_probe']}) SELECT norm_name, " + ", ".join(f"CAST(sum(delta) FILTER (arch = '{a}') AS BIGINT) AS to_{i}" for i, a in enumerate(ARCHES, 1)) + " FROM p WHERE state <> 'unchanged' GROUP BY norm_name",
}
