"""Nearest neighbours by a sorted key as position joins: no query meets a whole binary.

Candidates are numbered inside their binary by the key; a query's position is the number of
candidates with a smaller key, from one running count over both; the window of places around it is
an equi-join on (binary, place). A binary with more than task_rows candidates (ranges.MOST_ROWS) is numbered in ranges, so that no
task sorts it whole.

Where only each query's best places are asked for, the window isn't spelt out row by row: places are cut into blocks
of BLOCK, each with as many places of the next as a window is wide; queries go to the block where their window begins, in
chunks of about CHUNK, and a chunk meets its block in one task as arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import ranges

BINARY = ("version", "arch")
#: Places of a block, and queries that meet it at once.
BLOCK = 4096
CHUNK = 8192


def indexed(candidates: DataFrame, key: str, ties: tuple[str, ...], large: int = 0) -> DataFrame:
    """candidates with idx (from 0) inside their binary. large: into how many ranges rows are dealt, or 0."""
    placed = ranges.running(candidates, list(BINARY), [key, *ties], F.lit(1), "idx", large)
    return placed.withColumn("idx", F.col("idx") - 1)


def positions(queries: DataFrame, candidates: DataFrame, key: str, query_id: list[str], large: int = 0) -> DataFrame:
    """queries (version, arch = where to look, key, query_id) with pos = candidates there with a smaller key."""
    both = queries.select(*BINARY, key, *query_id, F.lit(0).alias("side")).unionByName(candidates.select(*BINARY, key, *[F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in query_id], F.lit(1).alias("side")))
    return ranges.running(both, list(BINARY), [key, "side"], F.col("side"), "pos", large).filter("side = 0").drop("side")


def _index(candidates: DataFrame, key: str, ties: tuple[str, ...], keep: list[str], task_rows: int | None) -> tuple[DataFrame, DataFrame, int]:
    """The written index (version, arch, idx, keep), the binaries' counts n (a row a binary, to be broadcast), and how many ranges are needed."""
    held = written(candidates.select(*dict.fromkeys((*BINARY, key, *ties, *keep))), "candidates")
    n = ranges.sizes(held, *BINARY)
    large = ranges.parts(n, task_rows)
    index = written(indexed(held, key, ties, large).select(*BINARY, "idx", *dict.fromkeys((key, *keep))), "index")
    return index, F.broadcast(n), large


def around(placed: DataFrame, low: str, high: str) -> DataFrame:
    """A row for each place from low to high (SQL expressions)."""
    return placed.filter(f"{high} >= {low}").withColumn("idx", F.explode(F.expr(f"sequence({low}, {high})")))


def nearest_by_size(queries: DataFrame, candidates: DataFrame, query_id: list[str], k: int = 10, task_rows: int | None = None) -> DataFrame:
    """The k candidates nearest in size, ranked. Ties: the left side first, on the left the later place,
    on the right the earlier one; ranks are by distance, then place."""
    index, _, large = _index(candidates, "size", ("norm_name", "address", "function_id"), ["norm_name", "function_id"], task_rows)
    placed = positions(queries, index, "size", query_id, large)
    wide = around(placed, f"greatest(0, pos - {k})", f"pos + {k - 1}").withColumnRenamed("size", "q_size")
    met = wide.join(index.select(*BINARY, "idx", F.col("size").alias("c_size"), F.col("norm_name").alias("c_name"), F.col("function_id").alias("c_id")), [*BINARY, "idx"])
    met = met.withColumn("distance", F.abs(F.col("c_size") - F.col("q_size"))).withColumn("left", F.col("idx") < F.col("pos"))
    one = Window.partitionBy(*BINARY, *query_id)
    met = met.withColumn("taken", F.row_number().over(one.orderBy("distance", F.col("left").desc(), F.when(F.col("left"), -F.col("idx")).otherwise(F.col("idx"))))).filter(F.col("taken") <= k)
    return met.withColumn("rank", F.row_number().over(one.orderBy("distance", "idx"))).drop("taken", "left")


def window_candidates(queries: DataFrame, candidates: DataFrame, key: str, query_id: list[str], ties: tuple[str, ...], reach: int, keep: list[str], task_rows: int | None = None) -> DataFrame:
    """Candidates inside a fixed-width window around each query's position: min(n, 2 * reach + 1) of them."""
    index, n, large = _index(candidates, key, ties, keep, task_rows)
    placed = positions(queries, index, key, query_id, large).join(n, list(BINARY))
    width = f"least(n, {2 * reach + 1})"
    wide = around(placed, f"greatest(0, least(pos - {reach}, n - {width}))", f"greatest(0, least(pos - {reach}, n - {width})) + {width} - 1")
    return wide.drop(key, "n").join(index.select(*BINARY, "idx", *[F.col(c).alias(f"c_{c}") for c in keep]), [*BINARY, "idx"])


def in_blocks(placed: DataFrame, index: DataFrame, wide: int, run: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """run(queries, candidates, at, there) for each chunk of queries: at[q] are the positions in candidates of the window's places
    and there[q] tells which of them are inside it. placed: binary, lo and count (of the window, at most wide); index: binary, idx."""
    placed = written(placed.withColumn("block", F.expr(f"lo div {BLOCK}")), "placed")
    chunks = placed.groupBy(*BINARY, "block").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(CHUNK))).cast("int").alias("chunks"))
    chunks = written(chunks, "chunks")
    key = [*BINARY, "block", "chunk"]
    asked = placed.join(chunks, [*BINARY, "block"]).withColumn("chunk", F.pmod(F.xxhash64(*placed.columns), "chunks").cast("int")).drop("chunks")
    here = F.expr(f"idx div {BLOCK}")
    blocks = F.filter(F.array(here, F.when(F.col("idx") % BLOCK < wide, here - 1)), lambda b: b >= 0)
    held = index.withColumn("block", F.explode(blocks)).join(chunks, [*BINARY, "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({x.split()[0]: [] for x in schema.split(", ")}, dtype=object)
        c = c.sort_values("idx", ignore_index=True)
        at = (q["lo"].to_numpy() - c["idx"].iloc[0])[:, None] + np.arange(wide)
        there = np.arange(wide) < q["count"].to_numpy()[:, None]
        return run(q, c, np.minimum(at, len(c) - 1), there)

    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(meet, schema)


def _first_named(best: np.ndarray, found: np.ndarray, q: pd.DataFrame, c: pd.DataFrame) -> np.ndarray:
    """The rank (from 1) of the first of each query's best candidates that has its name; 0 if none. found: which are candidates."""
    same = (c["norm_name"].to_numpy()[best] == q["norm_name"].to_numpy()[:, None]) & found
    return np.where(same.any(axis=1), same.argmax(axis=1) + 1, 0)


FAR = np.iinfo(np.int64).max


def first_by_size(queries: DataFrame, candidates: DataFrame, query_id: list[str], k: int = 10, task_rows: int | None = None) -> DataFrame:
    """version, arch, query_id, first: the rank of the first candidate with the query's norm_name among the k nearest in size (null
    if none). Ties are as in nearest_by_size. query_id must hold norm_name."""
    index, counts, large = _index(candidates, "size", ("norm_name", "address", "function_id"), ["norm_name"], task_rows)
    placed = positions(queries, index, "size", query_id, large).join(counts, list(BINARY))
    placed = placed.withColumn("lo", F.greatest(F.lit(0), F.col("pos") - k)).withColumn("count", F.least("n", F.col("pos") + k) - F.col("lo")).drop("n")

    def run(q: pd.DataFrame, c: pd.DataFrame, at: np.ndarray, there: np.ndarray) -> pd.DataFrame:
        gap = np.abs(c["c_size"].to_numpy()[at] - q["size"].to_numpy()[:, None])
        step = (q["lo"] - q["pos"]).to_numpy()[:, None] + np.arange(at.shape[1])  # below 0: on the left
        key = np.where(there, gap * (2 * k) + np.where(step < 0, -1 - step, k + step), FAR)
        taken = np.sort(np.argpartition(key, k - 1, axis=1)[:, :k], axis=1) if key.shape[1] > k else np.tile(np.arange(key.shape[1]), (len(q), 1))
        row = np.arange(len(q))[:, None]
        order = np.argsort(np.where(there, gap, FAR)[row, taken], axis=1, kind="stable")  # by distance, then place
        best = np.take_along_axis(taken, order, axis=1)
        return q[[*BINARY, *query_id]].assign(first=_first_named(at[row, best], there[row, best], q, c))

    kinds = dict(queries.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*BINARY, *query_id)) + ", first long"
    out = in_blocks(placed, index.withColumnRenamed("size", "c_size"), 2 * k, run, schema)
    return out.withColumn("first", F.expr("nullif(first, 0)"))


def first_by_window(queries: DataFrame, candidates: DataFrame, query_id: list[str], features: tuple[str, ...], scales: tuple[float, ...], dims: dict[str, int], ties: tuple[str, ...], reach: int, k: int = 10, task_rows: int | None = None) -> DataFrame:
    """version, arch, query_id, method, first: as first_by_size, among the k nearest by the scaled distance over the first dims[method]
    features (to nine digits; ties by address, name, id) inside the window of `reach` places around the query by the first feature."""
    key = features[0]
    index, counts, large = _index(candidates, key, ties, [*features, "address", "norm_name", "function_id"], task_rows)
    width = F.least(F.col("n"), F.lit(2 * reach + 1))
    placed = positions(queries, index, key, [*query_id, *features[1:]], large).join(counts, list(BINARY))
    placed = placed.withColumn("lo", F.greatest(F.lit(0), F.least(F.col("pos") - reach, F.col("n") - width))).withColumn("count", width).drop("n")

    def run(q: pd.DataFrame, c: pd.DataFrame, at: np.ndarray, there: np.ndarray) -> pd.DataFrame:
        order = np.lexsort(tuple(c[x].to_numpy() for x in ("function_id", "norm_name", "address")))
        tie = np.empty(len(c), np.int64)
        tie[order] = np.arange(len(c))
        gap, out = np.zeros(at.shape), []
        wanted = {n: m for m, n in dims.items()}
        for n, (x, scale) in enumerate(zip(features, scales, strict=True), 1):
            d = (q[x].to_numpy()[:, None] - c[x].to_numpy()[at]) / scale
            gap = gap + d * d
            if n in wanted:
                nine = np.where(there, np.rint(gap * 1e9), np.inf)
                if np.where(there, nine, 0.0).max() < FAR // (4 * BLOCK) - 1:  # distance and tie fit in one number
                    code = np.where(there, np.where(there, nine, 0.0).astype(np.int64) * (4 * BLOCK) + tie[at], FAR)
                    code = np.sort(np.partition(code, k - 1, axis=1)[:, :k] if code.shape[1] > k else code, axis=1)
                    first = _first_named(order[np.where(code == FAR, 0, code % (4 * BLOCK))], code != FAR, q, c)
                else:
                    best, row = np.lexsort((tie[at], nine), axis=1)[:, :k], np.arange(len(q))[:, None]
                    first = _first_named(at[row, best], there[row, best], q, c)
                out.append(q[[*BINARY, *query_id]].assign(method=wanted[n], first=first))
        return pd.concat(out)

    kinds = dict(queries.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*BINARY, *query_id)) + ", method string, first long"
    found = in_blocks(placed, index, 2 * reach + 1, run, schema)
    return found.withColumn("first", F.expr("nullif(first, 0)"))


def _best(of: DataFrame, among: DataFrame, features: tuple[str, ...], scales: tuple[float, ...], reach: int, task_rows: int | None) -> DataFrame:
    """version, arch, q_id, c_id, distance: each row's nearest inside its window; ties go to the earlier place."""
    index, counts, large = _index(among, features[0], ("address", "function_id"), [*features, "function_id"], task_rows)
    width = F.least(F.col("n"), F.lit(2 * reach + 1))
    asked = of.select(*BINARY, *features, F.col("function_id").alias("q_id"))
    placed = positions(asked, index, features[0], ["q_id", *features[1:]], large).join(counts, list(BINARY))
    placed = placed.withColumn("lo", F.greatest(F.lit(0), F.least(F.col("pos") - reach, F.col("n") - width))).withColumn("count", width).drop("n")

    def run(q: pd.DataFrame, c: pd.DataFrame, at: np.ndarray, there: np.ndarray) -> pd.DataFrame:
        gap = np.zeros(at.shape)
        for x, scale in zip(features, scales, strict=True):
            d = (q[x].to_numpy()[:, None] - c[x].to_numpy()[at]) / scale
            gap = gap + d * d
        gap = np.where(there, gap, np.inf)
        best, row = gap.argmin(axis=1), np.arange(len(q))
        return q[[*BINARY, "q_id"]].assign(c_id=c["function_id"].to_numpy()[at[row, best]], distance=gap[row, best])

    return in_blocks(placed, index, 2 * reach + 1, run, "version string, arch string, q_id string, c_id string, distance double")


def mutual_matches(stripped: DataFrame, labels: DataFrame, features: tuple[str, ...], scales: tuple[float, ...], reach: int = 96, most: float = 0.20, task_rows: int | None = None) -> DataFrame:
    """Pairs that are each other's nearest inside the window of their binary, at most `most` apart."""
    a = _best(labels, stripped, features, scales, reach, task_rows).select(*BINARY, F.col("q_id").alias("label_id"), F.col("c_id").alias("function_id"), F.col("distance").alias("match_dist"))
    b = _best(stripped, labels, features, scales, reach, task_rows).select(*BINARY, F.col("q_id").alias("function_id"), F.col("c_id").alias("label_id"))
    both = a.join(b, [*BINARY, "label_id", "function_id"]).filter(F.col("match_dist") <= most)
    return both.withColumn("match_confidence", 1.0 / (1.0 + F.col("match_dist")))
