"""Meetings in cells against the operators that place every query, with cells smaller than a window, keys that fill cells, and lone binaries."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fnatlas.functions.vectors import SHAPE, SHAPE_SCALES
from fnatlas.operators import meeting, nearest, retrieval, shape
from fnatlas.sources import scratch

ORDER = ("address", "size", "norm_name", "function_id")
ARCHES = ["a", "b", "c", "few"]


def functions(spark, n=700, sizes=12):
    r = random.Random(3)
    rows = [(f"v{i % 2}", "few" if i % 97 == 0 else "abc"[r.randrange(3)], 5 if i % 3 == 0 else r.randrange(sizes), f"n{r.randrange(60)}" if i % 50 else None, r.randrange(5000), f"f{i}") for i in range(n)]
    return spark.createDataFrame(rows, "version string, arch string, size long, norm_name string, address long, function_id string").repartition(3)


def asked(f):
    return retrieval.relevant_queries(f).withColumnRenamed("dst_arch", "arch")


def counted(firsts, method):
    return Counter((x["version"], x["src_arch"], x["arch"], method or x["method"], x["first"] or 0) for x in firsts.collect())


def told(tallies):
    return Counter({(x["version"], x["src_arch"], x["dst_arch"], x["method"], x["first"]): x["n"] for x in tallies.collect()})


@pytest.mark.parametrize("rows_a_cell", [9, 40, 10_000])
def test_sizes(spark, rows_a_cell):
    f = functions(spark)
    want = counted(nearest.first_by_size(asked(f).select("version", "arch", "size", "src_arch", "function_id", "norm_name"), f, ["src_arch", "function_id", "norm_name"]), "size")
    got = told(meeting.size_firsts(f, ARCHES, rows_a_cell=rows_a_cell))
    assert sum(want.values()) > 500 and want == got


@pytest.mark.parametrize("rows_a_cell", [15, 10_000])
def test_windows(spark, rows_a_cell):
    f = scratch.written(shape.shape_features(functions(spark, 500, 300).fillna("x", ["norm_name"])), "shapes")
    ids, stats = ["src_arch", "function_id", "norm_name"], shape.binary_shape_stats(f)
    q = retrieval.relevant_queries(f).select("version", "src_arch", "dst_arch", "function_id", "norm_name", *SHAPE)
    moved = shape.calibrated(q, stats).withColumn("log_size", F.round("log_size", 9))
    firsts = lambda q, dims: counted(nearest.first_by_window(q.withColumnRenamed("dst_arch", "arch"), f, ids, SHAPE, SHAPE_SCALES, dims, ORDER, 9), None)
    want = firsts(q, {"one": 1, "five": 5}) + firsts(moved, {"moved": 5})
    given = {(x["version"], x["arch"]): ([x[f"{c}_mean"] for c in SHAPE], [x[f"{c}_std"] for c in SHAPE]) for x in stats.collect()}
    got = told(meeting.window_firsts(f, ARCHES, SHAPE, SHAPE_SCALES, {"one": 1, "five": 5}, ("moved", given), ORDER, 9, rows_a_cell=rows_a_cell))
    assert sum(want.values()) > 1000 and want == got


@pytest.mark.parametrize("rows_a_cell", [25, 10_000])
def test_mutual(spark, rows_a_cell):
    """Pairs inside a cell and across cells' ends, ties, and binaries that one side lacks."""
    f = scratch.written(shape.shape_features(functions(spark, 600, 40).fillna("x", ["norm_name"])), "shapes")
    s, u = f.filter("address % 3 != 0"), f.filter("address % 4 != 0 AND NOT (version = 'v1' AND arch = 'c')")
    rows = lambda d: sorted(map(str, d.select("version", "arch", "label_id", "function_id", F.round("match_dist", 9), "match_confidence").collect()))
    want = rows(nearest.mutual_matches(s, u, SHAPE, SHAPE_SCALES, 9, 5.0))
    assert len(want) > 50 and want == rows(meeting.mutual_matches(s, u, SHAPE, SHAPE_SCALES, 9, 5.0, rows_a_cell))


def test_rows_before(spark):
    """The row before, over the ends of blocks too."""
    f = shape.shape_features(functions(spark, 200), place=True)
    rows = lambda d: sorted(map(str, d.select("function_id", "p_local_mean", "p_place").collect()))
    assert rows(shape.before(f, ["local_mean", "place"], 7)) == rows(shape.before(f, ["local_mean", "place"]))
    out = shape.before(f, ["place"], 7)
    assert out.filter("p_place != place - 1").count() == 0 and out.count() == 200 - f.select("version", "arch").distinct().count()


def test_many_sides(spark):
    """More architectures than one column has bits for."""
    rows = [("v", f"a{i:03}", 1, "n" if i in (0, 61, 62, 130) else f"m{i}", i, f"f{i}") for i in range(131)]
    f = spark.createDataFrame(rows, "version string, arch string, size long, norm_name string, address long, function_id string")
    got = told(meeting.size_firsts(f, sorted(x[1] for x in rows), rows_a_cell=50))
    four = [f"a{i:03}" for i in (0, 61, 62, 130)]
    assert got == Counter({("v", a, c, "size", 1): 1 for a in four for c in four if a != c})


def test_shuffle_files_go(spark):
    """What a written table shuffled is removed at the end of its write, and the session's setting is as before."""
    import os

    spark.conf.unset(scratch.CLEANUP)
    before = spark.conf.get(scratch.CLEANUP, None)
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in local for _, _, names in os.walk(str(d)) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    held = files()
    scratch.written(spark.range(100_000).repartition(3, "id"), "t")
    assert files() <= held and spark.conf.get(scratch.CLEANUP, None) == before
