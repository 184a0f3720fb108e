"""Position joins against plain searches."""

import bisect
import random

from pyspark.sql import functions as F

from fnatlas.functions.vectors import SHAPE, SHAPE_SCALES
from fnatlas.operators import evolution, features, nearest, ranges, shape

SCHEMA = "version string, arch string, size long, norm_name string, address long, function_id string"


def plain_nearest(cands, size, k):
    """Two pointers from the insertion point; the left side wins ties."""
    c = sorted(cands, key=lambda r: (r[2], r[3], r[4], r[5]))
    pos = bisect.bisect_left([r[2] for r in c], size)
    left, right, out = pos - 1, pos, []
    while len(out) < k and (left >= 0 or right < len(c)):
        dl = size - c[left][2] if left >= 0 else None
        dr = c[right][2] - size if right < len(c) else None
        if dr is None or dl is not None and dl <= dr:
            out.append((dl, left))
            left -= 1
        else:
            out.append((dr, right))
            right += 1
    return [c[i][5] for _, i in sorted(out)]


def test_nearest_by_size(spark):
    r = random.Random(0)
    cands = [("v", a, r.randrange(40), f"n{r.randrange(9)}", i, f"{a}{i}") for a in "xy" for i in range(60)] + [("v", "z", 5, "a", 1, "z1"), ("v", "z", 5, "b", 2, "z2"), ("v", "z", 5, "c", 3, "z3"), ("v", "z", 10, "d", 4, "z4")]
    asked = [("v", a, s, f"q{s}") for a in "xyz" for s in range(-2, 45, 3)]
    q = spark.createDataFrame(asked, "version string, arch string, size long, q string")
    for k in (1, 2, 10):
        out = {}
        for row in nearest.nearest_by_size(q, spark.createDataFrame(cands, SCHEMA), ["q"], k).orderBy("rank").collect():
            out.setdefault((row["arch"], row["q"]), []).append(row["c_id"])
        for _, a, s, name in asked:
            assert out[a, name] == plain_nearest([c for c in cands if c[1] == a], s, k), (a, s, k)


def test_windows(spark):
    for n, w, pos, want in ((5, 1, 0, [0, 1, 2]), (5, 1, 5, [2, 3, 4]), (2, 3, 1, [0, 1])):
        c = spark.createDataFrame([("v", "a", float(i), "n", i, str(i)) for i in range(n)], "version string, arch string, x double, norm_name string, address long, function_id string")
        q = spark.createDataFrame([("v", "a", pos - 0.5, "q")], "version string, arch string, x double, q string")
        out = nearest.window_candidates(q, c, "x", ["q"], ("address",), w, ["address"])
        assert sorted(r["c_address"] for r in out.collect()) == want


def test_mutual_matches_are_one_to_one(spark):
    r = random.Random(4)
    make = lambda p: spark.createDataFrame([("v", "a", f"{p}{i}", i, r.random(), r.random()) for i in range(80)], "version string, arch string, function_id string, address long, x double, y double")
    out = nearest.mutual_matches(make("s"), make("l"), ("x", "y"), (1.0, 1.0), reach=200, most=9.0).collect()
    assert out and len({x["function_id"] for x in out}) == len({x["label_id"] for x in out}) == len(out)


def test_ranked_quality(spark):
    d = spark.createDataFrame([("g", 0.5, 1, "a"), ("g", 0.5, 0, "b"), ("g", 0.5, 1, "c"), ("h", 1.0, 1, "a"), ("i", 0.9, 1, "a"), ("i", 0.1, 0, "b")], "g string, score double, label int, name string")
    out = {r["g"]: (r["auc"], r["average_precision"]) for r in evolution.ranked_quality(d, ["g"], "name").collect()}
    assert out["g"][0] == 0.5 and out["h"][0] == 0.0 and out["i"] == (1.0, 1.0)


def test_prototypes_by_subtraction(spark):
    r = random.Random(6)
    rows = [(f"1.{i % 3}", f"n{i % 4}", [r.random(), r.random()]) for i in range(40)]
    out = features.prototypes_other_versions(spark.createDataFrame(rows, "version string, norm_name string, fusion_vec array<double>"))
    for x in out.collect():
        own = [v[x["dim"]] for a, n, v in rows if a != x["test_version"] and n == x["norm_name"]]
        assert abs(x["value"] - sum(own) / len(own)) < 1e-9
    assert out.filter(F.col("value").isNull()).count() == 0


def lopsided(spark, n, seed):
    """One binary with 90 % of the rows, many ties."""
    r = random.Random(seed)
    rows = [("v", "big" if i % 10 else "small", r.randrange(60), f"n{r.randrange(40)}", r.randrange(200), f"f{i}") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_large_binaries_in_ranges(spark, monkeypatch):
    """Ranges, halos and moved sums give what one window a binary gives."""
    monkeypatch.setattr(ranges, "BLOCK", 7)
    d = lopsided(spark, 600, 1)
    rows = lambda df: sorted(tuple(f"{x:.9f}" if isinstance(x, float) else str(x) for x in r) for r in df.collect())
    one, many = (shape.shape_features(d, n) for n in (None, 20))
    assert one.columns == many.columns and rows(one) == rows(many)
    n = ranges.parts(ranges.sizes(d, "version", "arch"), 20)
    assert n == 60 and ranges.parts(ranges.sizes(d, "version", "arch"), 540) == 0
    held = ranges.written(d.repartitionByRange(n, "version", "arch", "address").withColumn("p", F.spark_partition_id()), "spread")
    assert held.filter("arch = 'big'").groupBy("p").count().agg(F.max("count")).first()[0] < 40  # 540 rows, over many tasks
    q = d.select("version", F.when(F.col("arch") == "big", "small").otherwise("big").alias("arch"), "size", F.col("function_id").alias("q"), "norm_name")
    for k in (1, 10):
        assert rows(nearest.nearest_by_size(q.drop("norm_name"), d, ["q"], k)) == rows(nearest.nearest_by_size(q.drop("norm_name"), d, ["q"], k, 20))
        assert rows(nearest.first_by_size(q, d, ["q", "norm_name"], k)) == rows(nearest.first_by_size(q, d, ["q", "norm_name"], k, 20))
    asked = one.select("version", "arch", F.col("function_id").alias("q"), "norm_name", *SHAPE)
    ties = ("address", "size", "norm_name", "function_id")
    windowed = lambda n: nearest.first_by_window(asked, one, ["q", "norm_name"], SHAPE, SHAPE_SCALES, {"a": 1, "b": 5}, ties, 9, task_rows=n)
    assert rows(windowed(None)) == rows(windowed(20))
    matched = lambda n: nearest.mutual_matches(one.filter("address % 3 != 0"), one.filter("address % 4 != 0"), SHAPE, SHAPE_SCALES, 9, 5.0, n)
    assert matched(None).count() > 50 and rows(matched(None)) == rows(matched(20))


def test_windows_of_far_candidates(spark):
    """Distances that don't fit beside a tie in 64 bits are still in order."""
    c = spark.createDataFrame([("v", "a", float(i) * 1e6, f"n{i}", i, str(i)) for i in range(8)], "version string, arch string, x double, norm_name string, address long, function_id string")
    q = spark.createDataFrame([("v", "a", 3.2e6, f"q{i}", f"n{i}") for i in range(8)], "version string, arch string, x double, q string, norm_name string")
    out = nearest.first_by_window(q, c, ["q", "norm_name"], ("x",), (1.0,), {"m": 1}, ("address",), 10)
    assert {r["norm_name"]: r["first"] for r in out.collect()} == {"n3": 1, "n4": 2, "n2": 3, "n5": 4, "n1": 5, "n6": 6, "n0": 7, "n7": 8}
