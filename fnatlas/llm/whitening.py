"""Whitening of embeddings by a one-sided Jacobi SVD of their QR factor.

Every entry c becomes the integer x = floor(64 c) + 1,000,000. Counts and sums of a dimension are exact. Rows are centred
before anything is multiplied: (n x - S) / n, whose numerator is exact. Each block of centred rows is reduced to its
triangular factor R (dimensions x dimensions), the factors of FAN_IN blocks at a time are stacked and reduced again until one
is left, and plane rotations then make R's columns orthogonal. The product of the rotations holds the components, the lengths of the
columns are sqrt(n e), so that small eigenvalues keep their digits: the covariance is never formed. A last pass projects every
row and merges blockwise covariances of what it gives, which tells how far they are from the identity.

Only factors of bounded size (dimensions squared, no matter how many rows) come to the driver.

Left out are rows whose vector is null, holds a null or a non-finite entry, has an entry so large that x isn't a whole number in 64
bits (2^57 or more), or has another length than most vectors have (of equally frequent lengths, the longest). Components without
variance (an eigenvalue under 1e-13 of their sum, such as those beyond the number of rows) can't be whitened and are left out;
with one row, or equal rows only, the result is empty. Repeated rows count each, null ids are kept. A deviation over 2^63 - 1 is null.
Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
#: Factors that are stacked in one task.
FAN_IN = 16
#: Rotations end when no pair of columns has a larger cosine.
TOLERANCE = 1e-15
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
MOST = (1 << 63) - 1


def usable(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, x) of the rows that are whitened."""
    good = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**57)))
    good = good.filter(F.col("v").isNotNull() & finite)
    # no rows of a length leave their task: a count a length
    length = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    x = F.transform("v", lambda c: F.floor(c * F.lit(SCALE)).cast("long") + F.lit(SHIFT))
    return materialize(good.filter(F.size("v") == (length["d"] if length else 0)).select("vec_id", x.alias("x")), "whitening")


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix of integers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the exact sums S of the dimensions, of which there are few; sums of a block in a task, then of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = _matrix(batch.column("x"))
            top = int(np.abs(x).max(initial=0)) * len(x)
            part = x.sum(axis=0) if top <= MOST else x.astype(object).sum(axis=0)
            part = [int(v) for v in part]
            total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n] * len(total), "dim": pa.array(range(len(total)), pa.int32()), "s": [str(v) for v in total]})

    found = rows.select("x").mapInArrow(run, "n long, dim int, s string").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()  # a row a dimension
    return (int(found[0]["n"]), [int(r["s"]) for r in found]) if found else (0, [])


def _numerators(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n x - S, exact: in 64 bits where they suffice, else in whole numbers of any size."""
    room = max(int(np.abs(x).max(initial=0)) * n, max((abs(v) for v in s), default=0)) * 2
    return x * n - np.array(s, np.int64) if room <= MOST else x.astype(object) * n - np.array(s, object)


def _deviations(top: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact."""
    most = int(np.abs(top).max(initial=0))
    if most * most * top.shape[1] <= MOST:
        return (top * top).sum(axis=1).tolist()
    whole = top.astype(object)
    return [v if v <= MOST else None for v in (whole * whole).sum(axis=1)]


def _factor(rows: DataFrame, n: int, s: list[int]) -> np.ndarray:
    """R of all centred rows: blocks are reduced in their tasks, then FAN_IN factors at a time."""
    d = len(s)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            r = np.linalg.qr(np.vstack((r, _numerators(_matrix(batch.column("x")), n, s).astype(float) / n)), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"r": [r.ravel().tolist()]})

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        stacked = np.vstack([np.asarray(r).reshape(-1, d) for r in group["r"]])
        return pd.DataFrame({"block": [key[0]], "r": [np.linalg.qr(stacked, mode="r").ravel()]})

    blocks = materialize(rows.select("x").mapInArrow(reduce, "r array<double>").withColumn("block", F.spark_partition_id().cast("long")), "factors")
    last = blocks.agg(F.max("block")).first()[0]
    while last:
        blocks = materialize(blocks.groupBy(F.floor(F.col("block") / FAN_IN).alias("block")).applyInPandas(merge, "block long, r array<double>"), "factors")
        last //= FAN_IN
    return np.asarray(blocks.first()["r"]).reshape(-1, d)


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors (columns) of r. Each sweep rotates every pair of columns, half of the
    columns against the other half at once, until all are orthogonal; the vectors are the rotations' product."""
    a, d = r.astype(float).copy(), r.shape[1]
    if d % 2:
        a = np.hstack((a, np.zeros((len(a), 1))))
    size = a.shape[1]
    v, turn = np.eye(size), np.arange(size)
    for _ in range(60):
        worst = 0.0
        for _ in range(max(1, size - 1)):
            p, q = turn[: size // 2], turn[: size // 2 - 1 : -1]
            x, y = a[:, p], a[:, q]
            aa, bb, ab = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            cosine = np.abs(ab) / np.maximum(np.sqrt(aa) * np.sqrt(bb), 1e-300)
            worst = max(worst, float(cosine.max(initial=0.0)))
            need = cosine > TOLERANCE
            zeta = np.where(need, (bb - aa) / np.where(need, 2 * ab, 1.0), 0.0)
            t = np.where(need, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.sqrt(1 + t * t)
            for m in (a, v):
                left, right = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * left - c * t * right, c * t * left + c * right
            turn = np.concatenate((turn[:1], turn[-1:], turn[1:-1]))  # the first stays, the others go round
        if worst <= TOLERANCE * 10:
            break
    sigma = np.sqrt((a * a).sum(0))
    order = np.argsort(-sigma, kind="stable")[:d]
    # the column that was added has no length and comes last
    return sigma[order], v[:d, order]


def fit(rows: DataFrame, most: int = COMPONENTS) -> dict | None:
    """n, sums, components (columns), eigenvalues and their shares of the trace. None without rows or variance."""
    n, s = _sums(rows)
    if not n or not s:
        return None
    sigma, v = jacobi(_factor(rows, n, s))
    e = sigma * sigma / n
    trace = float(e.sum())
    k = int((e[:most] > 1e-13 * trace).sum()) if trace > 0 else 0
    return {"n": n, "s": s, "v": v[:, :k], "e": e[:k], "explained": e[:k] / trace} if k else None


def _projected(batch: pa.RecordBatch, model: dict) -> tuple[np.ndarray, np.ndarray]:
    top = _numerators(_matrix(batch.column("x")), model["n"], model["s"])
    return top, (top.astype(float) / model["n"]) @ (model["v"] / np.sqrt(model["e"]))


def _joined(n: int, mean: np.ndarray, m: np.ndarray, other: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred products of two blocks together."""
    k, mu, p = other
    gap, both = mu - mean, n + k
    return both, mean + gap * (k / both), m + p + np.outer(gap, gap) * (n * k / both)


def identity_error(rows: DataFrame, model: dict) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, blocks centred by their own means and merged."""
    k = len(model["e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (0, np.zeros(k), np.zeros((k, k)))
        for batch in batches:
            if batch.num_rows:
                _, w = _projected(batch, model)
                mean = w.mean(axis=0)
                state = _joined(*state, (len(w), mean, (w - mean).T @ (w - mean)))
        if state[0]:
            yield pa.RecordBatch.from_pydict({"n": [state[0]], "mean": [state[1].tolist()], "m": [state[2].ravel().tolist()]})

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        state = (0, np.zeros(k), np.zeros((k, k)))
        for n, mean, m in zip(group["n"], group["mean"], group["m"], strict=True):
            state = _joined(*state, (int(n), np.asarray(mean), np.asarray(m).reshape(k, k)))
        return pd.DataFrame({"block": [key[0]], "n": [state[0]], "mean": [state[1]], "m": [state[2].ravel()]})

    blocks = materialize(rows.select("x").mapInArrow(run, "n long, mean array<double>, m array<double>").withColumn("block", F.spark_partition_id().cast("long")), "covariances")
    last = blocks.agg(F.max("block")).first()[0]
    while last:
        blocks = materialize(blocks.groupBy(F.floor(F.col("block") / FAN_IN).alias("block")).applyInPandas(merge, "block long, n long, mean array<double>, m array<double>"), "covariances")
        last //= FAN_IN
    one = blocks.first()
    return float(np.abs(np.asarray(one["m"]).reshape(k, k) / one["n"] - np.eye(k)).max())


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    x = usable(rows, vector, key)
    model = fit(x, most)
    if model is None:
        return x.sparkSession.createDataFrame([], SCHEMA)
    error, k = identity_error(x, model), len(model["e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top, w = _projected(batch, model)
            n = len(w)
            each = pa.array(np.repeat(np.arange(n), k))
            figures = [
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model["n"], np.int64)),
                pa.array(_deviations(top), pa.int64()).take(each), pa.array(w.ravel()), pa.array(np.tile(model["explained"], n)), pa.array(np.full(n * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(figures, [c.split()[0] for c in SCHEMA.split(", ")])

    return x.mapInArrow(run, SCHEMA)
