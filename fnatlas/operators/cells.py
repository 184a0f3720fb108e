"""Rows in one total order, cut into cells, for groups of any size.

Rows are dealt into ranges of the order by one shuffle and written with their rank among the rows of their binary in the range: their
cell. Counts of cells, of which there are few, come to the driver; a row's place in its binary is its cell's start and its rank. No group
is put into one task and no row is copied for its place; only rows beside a cell's end are seen by other cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..sources.scratch import written


def ranked(rows: DataFrame, order: list[str | Column], by: list[str], keep: list[str], ranges: int, tag: str) -> DataFrame:
    """The columns keep of rows, written in order, with cell (the number of their range) and rank (from 0 among the rows of `by` in the cell)."""
    keys = [StructField("cell", LongType()), StructField("rank", LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            yield _extended(batch.select(keep), cell=np.full(batch.num_rows, cell), rank=_ranks(batch, by, seen))

    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(run, StructType([*[rows.schema[c] for c in keep], *keys])), tag)


def _extended(batch: pa.RecordBatch, **columns: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(x) for x in columns.values()]
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *columns])


def _ranks(batch: pa.RecordBatch, by: list[str], seen: dict[tuple, int]) -> np.ndarray:
    """The rank of each row among those of its group so far. seen: rows of each group before the batch; it is brought up to date."""
    groups = batch.select(by).to_pandas().groupby(by, sort=False, dropna=False)
    code = groups.ngroup().to_numpy()
    rank, names = groups.cumcount().to_numpy().astype(np.int64), list(groups.size().items())
    names = [(name if isinstance(name, tuple) else (name,), n) for name, n in names]
    starts = np.array([seen.get(name, 0) for name, _ in names], np.int64)
    for name, n in names:
        seen[name] = seen.get(name, 0) + n
    return rank + starts[code]


def starts(held: DataFrame, by: list[str]) -> DataFrame:
    """(by, cell, cell_rows, cell_start): rows of each cell, and how many of its group are in earlier cells; a row a cell, written."""
    counts = held.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("cell_rows"))
    before = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return written(counts.withColumn("cell_start", F.coalesce(F.sum("cell_rows").over(before), F.lit(0))), "cells")


def with_neighbours(rows: DataFrame, by: list[str], order: list[str], value: Column, reach: int, name: str, ranges: int) -> DataFrame:
    """rows with place (from 0 in the group `by`, in order) and name: the mean of value (a double) over the rows at most `reach` places away."""
    keys = [StructField("cell", LongType()), StructField("rank", LongType()), StructField(name, DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, seen = TaskContext.get().partitionId(), {}
        wait, told = None, 0  # rows that are not told yet, behind `told` ones that are and still are near
        for batch in batches:
            if not batch.num_rows:
                continue
            more = pa.Table.from_batches([_extended(batch, cell=np.full(batch.num_rows, cell), rank=_ranks(batch, by, seen))])
            wait = more if wait is None else pa.concat_tables([wait, more])
            upto = wait.num_rows - reach
            if upto > told:
                yield from near(wait, told, upto)
                first = max(0, upto - reach)
                wait, told = wait.slice(first), upto - first
        if wait is not None and wait.num_rows > told:
            yield from near(wait, told, wait.num_rows)

    def near(table: pa.Table, a: int, b: int) -> Iterator[pa.RecordBatch]:
        x, group = table.column("_value").to_numpy(), np.cumsum(table.column("rank").to_numpy() == 0)  # groups follow each other
        total, n, at = np.zeros(b - a), np.zeros(b - a), np.arange(a, b)
        for d in range(-reach, reach + 1):
            there = (at + d >= 0) & (at + d < len(x))
            i = np.where(there, at + d, 0)
            there &= group[i] == group[at]
            total, n = np.where(there, total + x[i], total), n + there
        yield from table.slice(a, b - a).drop_columns(["_value"]).append_column(name, pa.array(total / n)).combine_chunks().to_batches()

    dealt = rows.withColumn("_value", value).repartitionByRange(ranges, *by, *order).sortWithinPartitions(*by, *order)
    held = written(dealt.mapInArrow(run, StructType([*rows.schema.fields, *keys])), "places")
    at = F.broadcast(starts(held, by))
    # rows beside a cell's end, a few a cell, are taken again with their neighbours in other cells
    beside = held.withColumn("_value", value).join(at, [*by, "cell"]).filter(f"rank < {2 * reach} OR rank >= cell_rows - {2 * reach}")
    place = F.col("cell_start") + F.col("rank")
    mean = F.avg("_value").over(Window.partitionBy(*by).orderBy(place).rangeBetween(-reach, reach))
    fixed = beside.select(*by, "cell", "rank", "cell_rows", mean.alias("_fixed")).filter(f"rank < {reach} OR rank >= cell_rows - {reach}").drop("cell_rows")
    out = held.join(at, [*by, "cell"]).join(F.broadcast(written(fixed, "beside")), [*by, "cell", "rank"], "left")
    return out.withColumn("place", place).withColumn(name, F.coalesce("_fixed", name)).drop("cell", "rank", "cell_rows", "cell_start", "_fixed")
