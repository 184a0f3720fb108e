"""Token features: frequencies, weights, hashed and dense vectors, scalers, prototypes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import version_key
from ..functions.tokens import immediate_bucket, mnemonic_class, string_category, token_class
from ..functions.vectors import hashed_slot

#: A vocabulary of at most so many tokens is broadcast to its occurrences; a larger one is joined by shuffle.
BROADCAST_TOKENS = 500_000


def token_counts(records: DataFrame, key: str = "function_id") -> DataFrame:
    """(key, token, n, total): counts are made before any shuffle by token."""
    long = records.select(key, F.size("tokens").alias("total"), F.explode("tokens").alias("token"))
    return long.groupBy(key, "token", "total").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(counts: DataFrame, fitted: int) -> DataFrame:
    """(token, df, idf) over `fitted` records."""
    df = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log(F.lit(1.0 + fitted) / (F.lit(1.0) + F.col("df"))) + 1.0)


def tfidf(counts: DataFrame, idf: DataFrame, key: str = "function_id") -> DataFrame:
    """(key, token, weight), and what else idf (token, idf) has."""
    side = F.broadcast(idf) if idf.count() <= BROADCAST_TOKENS else idf
    more = [c for c in idf.columns if c not in ("token", "df", "idf")]
    return counts.join(side.select("token", "idf", *more), "token").select(key, "token", *more, (F.col("n") / F.col("total") * F.col("idf")).alias("weight"))


def with_slots(idf: DataFrame, dims: int = 256, prefix: str = "tok:") -> DataFrame:
    """idf with each token's slot and sign, hashed once a token of the vocabulary."""
    slot, sign = hashed_slot(F.concat(F.lit(prefix), F.col("token")), dims)
    return idf.withColumn("slot", slot).withColumn("sign", sign)


def hashed(weights: DataFrame, key: str = "function_id") -> DataFrame:
    """(key, slot, value): signed feature hashing in long form; collisions add up. weights: key, slot, sign, weight."""
    return weights.groupBy(key, "slot").agg(F.sum(F.col("sign") * F.col("weight")).alias("value"))


def cosine_pairs(weights: DataFrame, pairs: DataFrame, key: str = "function_id") -> DataFrame:
    """Cosines of sparse vectors for given pairs (a, b): products meet on the token."""
    a = pairs.join(weights.select(F.col(key).alias("a"), "token", F.col("weight").alias("wa")), "a")
    both = a.join(weights.select(F.col(key).alias("b"), "token", F.col("weight").alias("wb")), ["b", "token"])
    norms = weights.groupBy(key).agg(F.sum(F.col("weight") * F.col("weight")).alias("q"))
    dots = both.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("d"))
    out = pairs.join(dots, ["a", "b"], "left").join(norms.select(F.col(key).alias("a"), F.col("q").alias("qa")), "a", "left").join(norms.select(F.col(key).alias("b"), F.col("q").alias("qb")), "b", "left")
    good = (F.col("qa") > 1e-12) & (F.col("qb") > 1e-12)
    return out.select("a", "b", F.when(good, F.coalesce("d", F.lit(0.0)) / F.sqrt(F.col("qa") * F.col("qb"))).otherwise(0.0).alias("cosine"))


def class_histogram(records: DataFrame, key: str = "function_id") -> DataFrame:
    """(key, op_class, n): classes of each record's tokens."""
    return records.select(key, F.explode("tokens").alias("token")).groupBy(key, mnemonic_class(F.col("token")).alias("op_class")).agg(F.count(F.lit(1)).alias("n"))


def feature_histograms(records: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind, key, n): classes of tokens (op), edge types (edge) and contexts (ctx: str:, const:, call:), counted. Records are as
    read_features gives them; null lists count as empty. A record's entries are exploded once and counted before the shuffle."""
    entry = "array<struct<kind:string,key:string,n:bigint>>"

    def entries(kind: str, listed: str, key: Callable[[Column], Column], n: Callable[[Column], Column] = lambda x: F.lit(1)) -> Column:
        made = F.transform(listed, lambda x: F.struct(F.lit(kind).alias("kind"), key(x).alias("key"), n(x).cast("long").alias("n")))
        return F.coalesce(made, F.array().cast(entry))

    every = F.concat(
        entries("op", "tokens", token_class),
        entries("edge", "edge_types", lambda x: x),
        entries("ctx", "string_refs", lambda x: F.concat(F.lit("str:"), x["category"]), lambda x: x["count"]),
        entries("ctx", "constant_buckets", lambda x: F.concat(F.lit("const:"), x["bucket"]), lambda x: x["count"]),
        entries("ctx", "call_refs", lambda x: F.concat(F.lit("call:"), x["kind"])),
    )
    return records.select(*keys, F.explode(every).alias("e")).groupBy(*keys, "e.kind", "e.key").agg(F.sum("e.n").alias("n"))


def fit_scalers(long: DataFrame) -> DataFrame:
    """Mean and deviation of each column over all (arch null) and per arch. long: arch, dim, x."""
    both = long.groupBy("dim", "arch").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    every = long.groupBy("dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    out = both.unionByName(every.withColumn("arch", F.lit(None).cast("string")))
    return out.withColumn("std", F.when(F.col("var") <= 1e-9, 1.0).otherwise(F.sqrt("var"))).drop("var")


def _long(records: DataFrame, *keys: str) -> DataFrame:
    return records.select(*keys, F.posexplode("fusion_vec").alias("dim", "x"))


def left_out(own: DataFrame) -> DataFrame:
    """(version, norm_name, dim, value): the mean over all other versions, as total minus own. own: version, norm_name, dim, s (sum), n."""
    every = Window.partitionBy("norm_name", "dim")  # a row a version
    out = own.withColumn("ts", F.sum("s").over(every) - F.col("s")).withColumn("tn", F.sum("n").over(every) - F.col("n"))
    return out.filter("tn > 0").select("version", "norm_name", "dim", (F.col("ts") / F.col("tn")).alias("value"))


def as_arrays(long: DataFrame, *keys: str, name: str) -> DataFrame:
    """(keys, name): the values (dim, value) of each key as one array."""
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias(name))


def prototypes_other_versions(records: DataFrame) -> DataFrame:
    """(test_version, norm_name, dim, value): means over all other versions, in one pass."""
    own = _long(records, "version", "norm_name").groupBy("version", "norm_name", "dim").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    return left_out(own).withColumnRenamed("version", "test_version")


def prototypes_earlier_versions(records: DataFrame) -> DataFrame:
    """The same over strictly earlier versions: a running sum over versions."""
    own = _long(records, "version", "norm_name").groupBy("version", "norm_name", "dim").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("norm_name", "dim").orderBy(version_key(F.col("version")), "version").rowsBetween(Window.unboundedPreceding, -1)
    out = own.withColumn("ts", F.sum("s").over(before)).withColumn("tn", F.sum("n").over(before))
    return out.filter("tn > 0").select(F.col("version").alias("test_version"), "norm_name", "dim", (F.col("ts") / F.col("tn")).alias("value"))


def function_records(instructions: DataFrame, max_tokens: int = 4096) -> DataFrame:
    """Instruction rows (function_id, seq, token, op_class, and the string and the number that it refers to, or null) to a record a function: its
    first tokens in order, counts, and histograms of string categories and constant buckets (arrays of (key, count) by key)."""
    first = instructions.filter(F.col("seq") < max_tokens)
    tokens = first.groupBy("function_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "token"))), lambda x: x["token"]).alias("tokens"))
    counts = instructions.groupBy("function_id").agg(
        F.count(F.lit(1)).alias("instruction_count"), *[F.count_if(F.col("op_class") == c).alias(f"{n}_count") for c, n in (("CALL", "call"), ("RET", "ret"))],
        F.count_if(F.col("op_class").startswith("BRANCH")).alias("branch_count"), F.count("string").alias("string_ref_count"), F.count("constant").alias("constant_count"),
    )
    out = counts.join(tokens, "function_id", "left")
    for column, key, name in (("string", string_category(F.col("string")), "string_refs"), ("constant", immediate_bucket(F.col("constant")), "constant_buckets")):
        n = instructions.filter(F.col(column).isNotNull()).groupBy("function_id", key.alias("key")).agg(F.count(F.lit(1)).alias("count"))
        held = n.groupBy("function_id").agg(F.array_sort(F.collect_list(F.struct("key", "count"))).alias(name))
        out = out.join(held, "function_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<struct<key:string,count:bigint>>")))
    return out.withColumn("token_truncated", (F.col("instruction_count") > max_tokens).cast("int"))
