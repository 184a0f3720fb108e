"""Readers of symbol and feature dumps, and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = "version string, arch string, binary_name string, address string, size string, type string, bind string, visibility string, section_index string, name string, norm_name string, analysis_func string"
FEATURES = """function_id string, binary_id string, version string, arch string, start_addr string, size bigint, tokens array<string>, token_truncated int,
 cfg_edges array<array<string>>, call_refs array<struct<kind:string>>, string_refs array<struct<category:string,count:bigint>>,
 constant_buckets array<struct<bucket:string,count:bigint>>, stats struct<instruction_count:bigint,basic_block_count:bigint,cfg_edge_count:bigint,
  call_count:bigint,branch_count:bigint,ret_count:bigint,string_ref_count:bigint,constant_count:bigint>,
 extract_error struct<error:string>"""


def read_symbols(spark: SparkSession, path: str, min_size: int = 1) -> DataFrame:
    """Analysis functions of a symbol CSV; rows that don't cast, have no name or are too small go. A gz file is
    read by one task, so its rows are dealt out by binary at once."""
    rows = spark.read.schema(SYMBOLS).csv(path, header=True)
    rows = rows.withColumn("address", F.col("address").try_cast("long")).withColumn("size", F.col("size").try_cast("int")).withColumn("analysis_func", F.col("analysis_func").try_cast("int"))
    return rows.filter(f"analysis_func = 1 AND size >= {min_size} AND address IS NOT NULL AND norm_name != ''").repartition("version", "arch")


def project_features(raw: DataFrame, min_size: int = 16, min_instructions: int = 4) -> DataFrame:
    """Function features from rows of FEATURES, read from files (at once or as a stream) in folders named by version (or version=...);
    failed and small rows go."""
    rows = raw.withColumn("version", F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), "^version=", ""))
    rows = rows.filter(f"extract_error IS NULL AND size >= {min_size} AND stats.instruction_count >= {min_instructions}")
    return rows.withColumn("edge_types", F.transform("cfg_edges", lambda e: F.get(e, F.lit(2)))).withColumn("address", F.conv(F.regexp_replace("start_addr", "^0[xX]", ""), 16, 10).cast("long")).drop("cfg_edges", "extract_error")


def read_features(spark: SparkSession, path: str, min_size: int = 16, min_instructions: int = 4, files: str = "*.jsonl") -> DataFrame:
    """Function features of JSON lines below a folder. Only needed leaves are read."""
    raw = spark.read.schema(FEATURES).option("recursiveFileLookup", True).option("pathGlobFilter", files).json(path)
    return project_features(raw, min_size, min_instructions)


def read_summaries(spark: SparkSession, path: str, files: str = "*.summary.json") -> DataFrame:
    """Function counts from many small JSON files, each an object or a list of them."""
    schema = "binary_id string, version string, arch string, status string, function_count bigint, duration_sec double"
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", files).option("recursiveFileLookup", True).json(path)


#: The columns of a line of a symbol table, in order; the name is the rest of the line.
SYMBOL_COLUMNS = ("number", "address", "size", "type", "bind", "visibility", "section_index", "name")


def parse_symbol_dump(lines: DataFrame) -> DataFrame:
    """Function symbols of a symbol table's text. lines: value, as spark.read.text gives them."""
    kept = [c for c in lines.columns if c != "value"]
    words = F.split(F.trim("value"), r"\s+", len(SYMBOL_COLUMNS))
    rows = lines.select(*kept, *[F.get(words, F.lit(i)).alias(c) for i, c in enumerate(SYMBOL_COLUMNS)])
    rows = rows.filter(F.col("number").endswith(":") & (F.col("type") == "FUNC") & F.col("name").isNotNull())
    rows = rows.withColumn("address", F.conv("address", 16, 10).cast("long")).withColumn("size", F.col("size").try_cast("int"))
    return rows.filter("address IS NOT NULL AND size IS NOT NULL").drop("number")


# Labels of header lines, and the fields that they fill.
HEADER_LABELS = {"Class": "elf_class", "Data": "endian", "Type": "elf_type", "Machine": "machine", "Entry point address": "entry"}


def parse_header_dump(lines: DataFrame, key: str = "file") -> DataFrame:
    """Header fields and section facts per file. lines: key, value. Sections without a name don't count."""
    label, rest = F.trim(F.substring_index("value", ":", 1)), F.trim(F.expr("substring(value, instr(value, ':') + 1)"))
    fields = [F.max(F.when(label == text, rest)).alias(name) for text, name in HEADER_LABELS.items()]
    after = F.trim(F.substring_index("value", "]", -1))
    section = F.when(F.trim("value").startswith("[") & after.startswith("."), F.split(after, r"\s+")[0])
    has = lambda n: F.coalesce(F.max((section == n).cast("int")), F.lit(0))
    debug = F.count_if(section.startswith(".debug"))
    return lines.groupBy(key).agg(*fields, F.count(section).alias("section_count"), has(".symtab").alias("has_symtab"), has(".strtab").alias("has_strtab"), (debug > 0).cast("int").alias("has_debug"), debug.alias("debug_section_count"))


def read_result_tables(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result and status tables of CSV with a header, with a given schema; columns are found by name. Values that don't cast are null."""
    names = [c.split()[0] for c in schema.split(", ")]
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return raw.select(*[F.col(c).try_cast(schema.split(", ")[i].split()[1]).alias(c) for i, c in enumerate(names)])


def latest_run(listing: DataFrame, needed: list[str]) -> DataFrame:
    """The last run (by name) that has all needed files: one row, run. listing: run, file."""
    whole = listing.filter(F.col("file").isin(needed)).groupBy("run").agg(F.count_distinct("file").alias("files")).filter(F.col("files") == len(set(needed)))
    return whole.agg(F.max("run").alias("run"))


#: Version and architecture in the path of a binary.
BINARY_PATH = r"([^/]+)/(?:[^/]*-)?([^/-]+)-unstripped$"


def file_inventory(spark: SparkSession, path: str, pattern: str = BINARY_PATH, files: str = "*") -> DataFrame:
    """Binaries below a folder: version and arch from the path by the pattern's two groups, size, SHA-256. Only files whose path has the
    pattern are read; contents only if the hash is asked for. Spark's reader passes over files without a byte."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", files).load(path)
    where = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    rows = rows.withColumn("path", where).filter(F.col("path").rlike(pattern))
    part = lambda i: F.regexp_extract("path", pattern, i)
    return rows.select("path", part(1).alias("version"), part(2).alias("arch"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def merge_features(features: DataFrame, status: DataFrame) -> DataFrame:
    """Features of binaries whose extraction has ended well."""
    return features.join(status.filter("status IN ('completed', 'exists')").select("binary_id").distinct(), "binary_id", "left_semi")


def write_merged(features: DataFrame, status: DataFrame, path: str) -> None:
    """Features of finished binaries as one table in folders by version and arch; a binary's rows are written by one task."""
    merge_features(features, status).repartition("version", "arch").write.mode("overwrite").partitionBy("version", "arch").parquet(path)


def finished(status: DataFrame) -> DataFrame:
    """(version, arch) of the binaries whose work has ended well."""
    return status.filter("status IN ('completed', 'exists')").select("version", "arch").distinct()


def write_missing(features: DataFrame, status: DataFrame, path: str) -> DataFrame:
    """Writes the binaries of `features` that `status` (version, arch, status) doesn't tell as finished, and only their folders: what was
    complete isn't read beyond its keys, and isn't touched. Half-written folders of an earlier run are replaced. Returns the new status
    rows (version, arch, status, functions); a row a binary."""
    done = finished(status)
    todo = features.join(F.broadcast(done), ["version", "arch"], "left_anti")  # a row a binary
    todo.repartition("version", "arch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "arch").parquet(path)
    return todo.groupBy("version", "arch").agg(F.lit("completed").alias("status"), F.count(F.lit(1)).alias("functions"))


def write_results(rows: DataFrame, path: str, columns: list[str], kind: str = "csv", compression: str | None = None) -> None:
    """A result table with a fixed list of columns, as CSV (gzip or not) or JSON lines."""
    out = rows.select(*columns).write.mode("overwrite")
    if compression:
        out = out.option("compression", compression)
    out.csv(path, header=True) if kind == "csv" else out.json(path)
