"""Running sums, row numbers and neighbours inside groups of any size.

A window puts a group into one task. Where a group has more than MOST_ROWS rows, rows are dealt into ranges of the order instead, a
task each; a range's own running sums are moved by the sums of the ranges before it, of which there are few. Rows next to a
range's end are seen from both sides by a halo of copies. Results are those of the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows of a group that one task may hold.
MOST_ROWS = 1_000_000
#: Places of a block where neighbours meet.
BLOCK = 100_000


def sizes(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): a row a group, written."""
    return written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "sizes")


def parts(counted: DataFrame, most: int | None = None) -> int:
    """Into how many ranges rows are to be dealt: 0 if no group has more rows than one task may hold. counted: n, a row a group."""
    most = MOST_ROWS if most is None else most
    largest, total = counted.agg(F.max("n"), F.sum("n")).first()
    return -(-2 * total // most) if (largest or 0) > most else 0


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, ranges: int) -> DataFrame:
    """rows with name: the sum of value (whole numbers) over the rows of its group up to itself, in order. The order must be total as far
    as value depends on it. ranges: into how many all rows are dealt, or 0."""
    upto = lambda *by: F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if not ranges:
        return rows.withColumn(name, upto(*keys).cast("long"))
    dealt = written(rows.repartitionByRange(ranges, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    starts = sums.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    out = dealt.withColumn(name, upto(*keys, "_range")).join(starts, [*keys, "_range"])
    return out.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_before")


def neighbour_mean(rows: DataFrame, keys: list[str], place: str, value: str, reach: int, name: str, block: int | None = None) -> DataFrame:
    """rows with name: the mean of value over the rows at most `reach` places away in the group. place: from 0, without gaps. Places are cut into
    blocks; rows near a block's end are copied to the next one, where they are only seen."""
    block = BLOCK if block is None else block
    at, far = F.col(place), F.lit(reach)
    own = F.floor(at / block)
    blocks = F.array_distinct(F.array(own, F.floor(F.greatest(at - far, F.lit(0)) / block), F.floor((at + far) / block)))
    spread = rows.withColumn("_block", F.explode(blocks))
    near = Window.partitionBy(*keys, "_block").orderBy(place).rowsBetween(-reach, reach)
    return spread.withColumn(name, F.avg(value).over(near)).filter(F.col("_block") == own).drop("_block")
