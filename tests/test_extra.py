"""Exact tests, sketches, resumed work, file inventories and the quality of large groups."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from fnatlas.operators import evolution, experiments, reports
from fnatlas.sources import readers


def test_exact_signed_ranks(spark):
    """Against all 2^n sets of ranks."""
    r = random.Random(2)
    rows, want = [], {}
    for n in range(1, 13):
        d = [(i + r.random() * 0.9) * r.choice([-1, 1]) for i in range(1, n + 1)]
        ranks = {x: k for k, x in enumerate(sorted(d, key=abs), 1)}
        plus = sum(k for x, k in ranks.items() if x > 0)
        w = min(plus, n * (n + 1) // 2 - plus)
        sums = [sum(c) for m in range(n + 1) for c in itertools.combinations(range(1, n + 1), m)]
        want[f"g{n}"] = (n, w, min(1.0, 2 * sum(s <= w for s in sums) / 2**n))
        rows += [(f"g{n}", x) for x in [*d, 0.0]]
    rows += [("tied", x) for x in (0.1, 0.1, -0.2)] + [("long", float((i + 1) * (-1) ** (i % 3))) for i in range(51)]
    out = {x["g"]: x for x in experiments.wilcoxon(spark.createDataFrame(rows, "g string, difference double"), "g").collect()}
    for g, (n, w, p) in want.items():
        assert (out[g]["n"], out[g]["w"], out[g]["exact"]) == (n, w, True) and out[g]["p_value"] == pytest.approx(p, abs=1e-12)
    assert not out["tied"]["exact"] and not out["long"]["exact"] and out["long"]["p_value"] == out["long"]["p"]
    fifty = [(("x", float(i * (-1 if i % 4 == 0 else 1)))) for i in range(1, 51)]
    x = experiments.wilcoxon(spark.createDataFrame(fifty, "g string, difference double"), "g").first()
    assert x["exact"] and x["p_value"] == pytest.approx(x["p"], rel=0.3)


def test_quality_of_one_large_group(spark):
    """Ranges give what one window gives, ties over range borders too."""
    r = random.Random(5)
    rows = [("g" if i % 9 else "h", r.randrange(12) / 10, r.randrange(2), f"n{i}") for i in range(700)] + [("none", 0.5, 0, "a")]
    d = spark.createDataFrame(rows, "g string, score double, label int, name string").repartition(4)
    one, many = ({x["g"]: x.asDict() for x in evolution.ranked_quality(d, ["g"], "name", n).collect()} for n in (None, 30))
    assert set(one) == set(many) == {"g", "h", "none"}
    for g, x in one.items():
        assert all(x[c] == pytest.approx(many[g][c], abs=1e-12) if isinstance(x[c], float) else x[c] == many[g][c] for c in x)
        mine = [(s, y, n) for k, s, y, n in rows if k == g]
        pairs = [(a, b) for a in mine for b in mine if a[1] == 1 and b[1] == 0]
        auc = sum((a[0] > b[0]) + 0.5 * (a[0] == b[0]) for a, b in pairs) / len(pairs) if pairs else 0.0
        assert x["auc"] == pytest.approx(auc)
    assert evolution.ranked_quality(d, [], "name", 30).first()["n"] == 701


def test_sketches_merge(spark):
    r = random.Random(1)
    rows = [(f"v{i % 3}", f"a{i % 2}", r.randrange(100_000)) for i in range(30_000)]
    d = spark.createDataFrame(rows, "version string, arch string, size long").repartition(6)
    fine = reports.size_sketches(d, "version", "arch")
    for by in (["version", "arch"], ["version"], []):
        sketches = fine if len(by) == 2 else reports.merged_sketches(fine, *by)
        out = reports.rank_errors(d, reports.sketched_percentiles(sketches, *by), *by).collect()
        assert len(out) == 3 * {2: 6, 1: 3, 0: 1}[len(by)] and all(x["rank_error"] <= 0.02 for x in out)


def test_finished_folders_are_not_touched(spark, tmp_path):
    path = f"{tmp_path}/t"
    d = spark.createDataFrame([(f"v{i % 3}", f"a{i % 2}", i) for i in range(60)], "version string, arch string, x long")
    nothing = spark.createDataFrame([], "version string, arch string, status string")
    first = readers.write_missing(d.filter("version = 'v0' OR (version = 'v1' AND x < 30)"), nothing, path)
    status = first.filter("version = 'v0'").select("version", "arch", "status").unionByName(spark.createDataFrame([("v1", "a0", "failed"), ("v1", "a1", "running")], "version string, arch string, status string"))
    status = spark.createDataFrame(status.collect(), status.schema)  # v1 was half written
    files = lambda v: sorted((os.path.join(a, f), os.stat(os.path.join(a, f)).st_mtime_ns) for a, _, fs in os.walk(f"{path}/version={v}") for f in fs)
    before = files("v0")
    again = readers.write_missing(d, status, path).collect()
    assert before and files("v0") == before and {(x["version"], x["arch"]) for x in again} == {(v, a) for v in ("v1", "v2") for a in ("a0", "a1")}
    assert sorted(r["x"] for r in spark.read.parquet(path).collect()) == list(range(60))
    done = spark.createDataFrame([(v, a, "exists") for v in ("v0", "v1", "v2") for a in ("a0", "a1")], "version string, arch string, status string")
    every = [files(v) for v in ("v0", "v1", "v2")]
    assert readers.write_missing(d, done, path).count() == 0 and [files(v) for v in ("v0", "v1", "v2")] == every


def test_binary_files(spark, tmp_path):
    import hashlib

    for version, arch, body in (("1.2", "arm", b"\x00\xffELF"), ("1.2", "mips", b"\n"), ("1.3", "x86+64 b", b"z" * 3_000_000)):
        os.makedirs(f"{tmp_path}/{version}", exist_ok=True)
        with open(f"{tmp_path}/{version}/{arch}-unstripped", "wb") as f:
            f.write(body)
    open(f"{tmp_path}/1.2/notes.txt", "w").close()
    out = {(x["version"], x["arch"]): (x["size_bytes"], x["sha256"]) for x in readers.file_inventory(spark, str(tmp_path)).collect()}
    assert out == {("1.2", "arm"): (5, hashlib.sha256(b"\x00\xffELF").hexdigest()), ("1.2", "mips"): (1, hashlib.sha256(b"\n").hexdigest()), ("1.3", "x86+64 b"): (3_000_000, hashlib.sha256(b"z" * 3_000_000).hexdigest())}
    assert readers.file_inventory(spark, str(tmp_path)).select(F.sum("size_bytes")).first()[0] == 3_000_006


def test_json_results(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, None), ("b", 2, 0.5)], "k string, n long, x double")
    readers.write_results(d, f"{tmp_path}/j", ["k", "x"], kind="json")
    back = spark.read.schema("k string, x double, n long").json(f"{tmp_path}/j")
    assert sorted(map(tuple, back.collect())) == [("a", None, None), ("b", 0.5, None)]
