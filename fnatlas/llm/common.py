"""What the operators share: scratch tables, size-checked and salted joins, reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A table of at most so many narrow rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Parts into which rows of a hot key are dealt by a salted join.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    if found := spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-scratch-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here, and
    the loss of an executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_dimension(big: DataFrame, dim: DataFrame, key: str, how: str = "left", rows: int | None = None, spread: Column | None = None) -> DataFrame:
    """Join a dimension (one row a key) to rows of which one key may hold a third.

    Up to BROADCAST_ROWS rows of dim, counted first, are broadcast. Beyond that
    both sides are salted, so that no key's rows meet in one task. Null keys match.
    """
    n = dim.count() if rows is None else rows
    k = F.col(key)
    dim = dim.withColumnRenamed(key, "_dim_key")
    if n <= BROADCAST_ROWS:
        return big.join(F.broadcast(dim), k.eqNullSafe(F.col("_dim_key")), how).drop("_dim_key")
    salt = F.pmod(spread if spread is not None else F.xxhash64(*[c for c in big.columns if c != key]), F.lit(SALTS))
    salted = dim.withColumn("_dim_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        big.withColumn("_salt", salt.cast("int"))
        .join(salted, k.eqNullSafe(F.col("_dim_key")) & (F.col("_salt") == F.col("_dim_salt")), how)
        .drop("_dim_key", "_dim_salt", "_salt")
    )


def without(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows whose key is not among ids (a written table of distinct keys): up to BROADCAST_ROWS ids are broadcast, so
    that the rows stay where they are; more are joined by shuffle."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, key, "left_anti")


def sha256_hex(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


#: A key is frequent if it holds over 1 / FREQUENT of the rows; there are fewer than FREQUENT such keys.
FREQUENT = 10_000


def join_counted(big: DataFrame, dim: DataFrame, keys: list[str], count: str, total: int, rows: str = "left") -> DataFrame:
    """Join dim (one row a key, `count` of its rows in big) to big without gathering a
    frequent key's rows: keys with over total / FREQUENT rows, of which there are fewer
    than FREQUENT, are broadcast and their rows leave before the rest is shuffled."""
    frequent = F.col(count) > F.lit(max(total / FREQUENT, 1.0))
    few, rest = F.broadcast(dim.filter(frequent)), dim.filter(~frequent)
    return big.join(few, keys).unionByName(big.join(few.select(*keys), keys, "left_anti").join(rest, keys, rows))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node.

    Alternating large-star and small-star rounds: each round is two aggregations and
    two joins on the edges left, O(log^2 n) rounds in all; only a count and a checksum
    come to the driver. Nodes with very many edges are aggregated before the shuffle.
    """
    e = materialize(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        seen = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state or not seen[0]:
            break
        state = seen
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.filter("m < a").select("a", F.col("m").alias("b")))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = materialize(small.distinct(), "edges")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
