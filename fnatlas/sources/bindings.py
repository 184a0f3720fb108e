"""Function records derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import EDGE_TYPES, OP_CLASSES, mnemonic_class

#: The total order of the functions of a binary.
ORDER = ("address", "size", "norm_name", "function_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of 35 binaries (version, arch)."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    fn = F.concat(F.lit("fn_"), F.col("l_partkey").cast("string"))
    suffix = F.expr("CASE l_linenumber % 4 WHEN 1 THEN '.part.0' WHEN 2 THEN '.constprop.1.isra.0' WHEN 3 THEN '@GLIBC_2.4' ELSE '' END")
    return rows.select(
        F.concat(F.lit("rel-1."), (F.year("o_orderdate") - 1965).cast("string"), F.lit(".0")).alias("version"),
        F.col("o_orderpriority").alias("arch"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.col("l_quantity").cast("int").cast("string")).alias("function_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("address"),
        F.floor((F.col("p_retailprice") - 880) * (1 + F.col("l_quantity"))).cast("long").alias("size"),
        F.concat(fn, suffix).alias("name"),
        fn.alias("norm_name"),
        "l_partkey",
        "l_suppkey",
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").cast("int").alias("quantity"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label side: named functions."""
    return functions(spark, sf_dir).filter("l_partkey % 10 <> 0")


def stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stripped side: sizes a little off, counts of its graph."""
    rows = functions(spark, sf_dir).filter("l_orderkey % 7 <> 0").withColumn("size", F.col("size") + F.col("l_suppkey") % 3)
    return rows.withColumn("instruction_count", F.greatest(F.expr("size div 4"), F.lit(1))).withColumn("basic_block_count", F.col("quantity").cast("long")).withColumn("cfg_edge_count", (F.col("quantity") + F.col("l_linenumber")).cast("long"))


def docs(spark: SparkSession, sf_dir: str, max_tokens: int | None = None) -> DataFrame:
    """Token features: one record a document, of its first max_tokens words or all."""
    tokens = F.filter(F.split(F.lower("text"), "[ \\t\\n\\r\\f]+"), lambda w: w != "")
    tokens = tokens if max_tokens is None else F.slice(tokens, 1, max_tokens)
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("rel-1."), (30 + number % 7).cast("string"), F.lit(".0")).alias("version"),
        F.col("lang").alias("arch"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("function_id"),
        F.col("doc_id").alias("address"),
        F.col("n_chars").alias("size"),
        F.concat(F.lit("fn_"), (F.col("doc_id") % 40).cast("string")).alias("norm_name"),
        tokens.alias("tokens"),
    )


def method_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with all that the scorers compare: a document's words are its tokens, their lengths its contexts and edges."""
    rows = docs(spark, sf_dir)
    word, n = F.col("word"), F.length("word")
    long = rows.select("function_id", F.explode("tokens").alias("word")).withColumn("op", mnemonic_class(word))
    sums = {
        "basic_block_count": n == 3,
        "cfg_edge_count": n.isin(3, 4),
        "call_count": F.col("op") == "CALL",
        "branch_count": F.col("op").startswith("BRANCH"),
        "ret_count": F.col("op") == "RET",
        "string_ref_count": n > 8,
        "constant_count": word.rlike("^[0-9]+$"),
    }
    of = lambda tests: F.array(*[F.count_if(t) for t in tests])
    counts = long.groupBy("function_id").agg(
        *[F.count_if(test).alias(name) for name, test in sums.items()],
        of([F.col("op") == k for k in OP_CLASSES]).alias("op_counts"),
        of([n % len(EDGE_TYPES) == i for i in range(len(EDGE_TYPES))]).alias("edge_counts"),
    )
    out = rows.join(counts, "function_id", "left").withColumn("instruction_count", F.size("tokens"))
    out = out.fillna(0, [*sums]).withColumn("contexts", F.transform("tokens", lambda t: F.concat(F.lit("len_"), F.least(F.length(t), F.lit(12)).cast("string"))))
    for name, listed in (("op_counts", OP_CLASSES), ("edge_counts", EDGE_TYPES)):
        out = out.withColumn(name, F.coalesce(name, F.array_repeat(F.lit(0).cast("long"), len(listed))))
    return out.withColumn("basic_block_count", F.col("basic_block_count") + 1).withColumn("cfg_edge_count", F.col("cfg_edge_count") + 1)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector features: one fused vector a record."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("rel-1."), (30 + v % 7).cast("string"), F.lit(".0")).alias("version"),
        F.concat(F.lit("a"), F.expr("(vec_id div 7) % 5").cast("string")).alias("arch"),
        v.alias("vec_id"),
        F.concat(F.lit("fn_"), F.col("label").cast("string")).alias("norm_name"),
        F.col("embedding").cast("array<double>").alias("fusion_vec"),
    )


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step events."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("event_type").alias("step"),
        F.when(F.col("value") < 5, "failed").otherwise("completed").alias("status"),
        F.col("value").alias("duration_sec"),
        F.to_date("ts").alias("day"),
        F.get_json_object("props", "$.k").alias("bucket"),
    )
