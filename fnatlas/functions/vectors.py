"""Vectors, hashing and scaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE_SCALES = (1.0, 0.2, 0.2, 1.0, 1.0)
SHAPE = ("log_size", "addr_pos", "order_pos", "local_mean", "local_diff")
TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a side's squared norm is tiny."""
    aa, bb = dot(a, a), dot(b, b)
    return F.when((aa <= TINY) | (bb <= TINY), 0.0).otherwise(dot(a, b) / F.sqrt(aa * bb))


def l2_normalize(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(TINY))
    return F.transform(v, lambda x: x / norm)


def stable_hash(key: Column) -> Column:
    """32 bits of the key's md5 as a long."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def hashed_slot(key: Column, dims: int) -> tuple[Column, Column]:
    """Slot and sign of signed feature hashing."""
    h = stable_hash(key)
    return (h % dims).cast("int"), F.when(F.shiftright(h, 8).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)


def shape_distance(a: list[Column], b: list[Column]) -> Column:
    return sum((((x - y) / F.lit(s)) * ((x - y) / F.lit(s)) for x, y, s in zip(a, b, SHAPE_SCALES, strict=True)), F.lit(0.0))
