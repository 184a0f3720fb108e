"""Report tables and significance on small rows."""

import pytest

from fnatlas.operators import evolution, experiments, features, reports


def test_even_bins(spark):
    x = lambda *v: spark.createDataFrame([(i,) for i in v], "x double")
    rows = lambda d: sorted(tuple(r) for r in reports.even_bins(d, "x", 4).collect())
    assert rows(x(0.0, 0.9, 1.0, 3.9, 4.0, None)) == [(0, 2), (1, 1), (3, 2)]
    assert rows(x(2.0, 2.0)) == [(2, 2)] and rows(x()) == [] and rows(x(None)) == []


def test_reattach_fails_on_lost_rows(spark):
    f = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    saved = spark.createDataFrame([("a", "f")], "k string, label string")
    assert [tuple(r) for r in reports.reattach(f, saved, ["k"]).collect()] == [("a", 1, "f")]
    with pytest.raises(ValueError, match="1 rows"):
        reports.reattach(f, saved.union(spark.createDataFrame([("z", "g")], saved.schema)), ["k"])


def test_select_binaries(spark):
    rows = spark.createDataFrame([("rel-1.10.0", "a"), ("rel-1.9.0", "b"), ("rel-1.9.0", "a"), ("rel-2.0.0", "c")], "version string, arch string")
    got = lambda **k: [tuple(r) for r in reports.select_binaries(rows, **k).collect()]
    assert got(most=3) == [("rel-1.9.0", "a"), ("rel-1.9.0", "b"), ("rel-1.10.0", "a")]
    assert got(versions=["1.10.0", "rel-2.0.0"], arches=["a"]) == [("rel-1.10.0", "a")]


def test_centroids_need_two_labels(spark):
    rows = spark.createDataFrame([("1", "a", 0, 1.0), ("2", "a", 1, 9.0), ("1", "b", 0, 1.5), ("3", "b", None, 2.0)], "version string, arch string, label int, x double")
    assert [tuple(r) for r in evolution.nearest_centroid(rows, ["x"]).collect()] == [("1", "b", 0, 0)]  # a's others have one label


def test_wilcoxon_ranks(spark):
    values = [0.3, -0.1, 0.2, 0.2, 0.0, -0.4, 0.1, 0.5]
    ds = sorted((x for x in values if x), key=abs)
    sizes = [abs(x) for x in ds]
    rank = {s: sum(i + 1 for i, t in enumerate(sizes) if t == s) / sizes.count(s) for s in sizes}
    plus, minus = sum(rank[abs(x)] for x in ds if x > 0), sum(rank[abs(x)] for x in ds if x < 0)
    n, tied = len(ds), sum(sizes.count(s) ** 3 - sizes.count(s) for s in set(sizes))
    z = (min(plus, minus) - n * (n + 1) / 4) / (n * (n + 1) * (2 * n + 1) / 24 - tied / 48) ** 0.5
    row = experiments.wilcoxon(spark.createDataFrame([(x,) for x in values], "difference double")).first()
    assert row["n"] == n and row["w"] == min(plus, minus) and abs(row["z"] - z) < 1e-9


def test_histograms_of_null_lists(spark):
    schema = "id string, tokens array<string>, edge_types array<string>, string_refs array<struct<category:string,count:bigint>>, constant_buckets array<struct<bucket:string,count:bigint>>, call_refs array<struct<kind:string>>"
    rows = spark.createDataFrame([("x", ["MOVE REG", "MOVE"], None, [("num", 3)], None, [("ext",), ("ext",)]), ("y", None, None, None, None, None)], schema)
    got = sorted(tuple(r) for r in features.feature_histograms(rows, "id").collect())
    assert got == [("x", "ctx", "call:ext", 2), ("x", "ctx", "str:num", 3), ("x", "op", "MOVE", 2)]
