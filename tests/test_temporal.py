"""Prototypes that leave versions out, temporal fits, target ranks in blocks, and the streams' restarts."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fnatlas.jobs import live
from fnatlas.operators import components, scoring, sweep
from fnatlas.sources import bindings, readers
from fnatlas.streaming import streams
from tests.test_catalog import SF


def _vectors(spark, rows):
    """rows: version, arch, function_id, norm_name, fitted, number that fills the vectors."""
    wide = lambda n, x: F.array_repeat(F.col(x), n)
    d = spark.createDataFrame(rows, "version string, arch string, function_id string, norm_name string, fitted boolean, x double")
    return d.select("version", "arch", "function_id", "norm_name", "fitted", wide(256, "x").alias("token"), wide(36, "x").alias("graph_arch"), wide(64, "x").alias("context"), wide(5, "x").alias("shape_arch"))


def test_prototypes_leave_the_own_version_out(spark):
    rows = [("1.0", "a", "1", "f", True, 1.0), ("1.0", "b", "2", "f", True, 3.0), ("1.1", "a", "3", "f", True, 5.0), ("1.1", "a", "4", "only", True, 7.0), ("1.2", "a", "5", "f", False, 9.0), ("1.2", "b", "6", "only", False, 1.0)]
    got = {(r["version"], r["norm_name"]): r["proto"] for r in components.prototypes(_vectors(spark, rows)).collect()}
    assert set(got) == {("1.0", "f"), ("1.1", "f"), ("1.2", "f"), ("1.2", "only")}  # no other version has "only" for 1.1
    assert {k: v[0] for k, v in got.items()} == {("1.0", "f"): 5.0, ("1.1", "f"): 2.0, ("1.2", "f"): 3.0, ("1.2", "only"): 7.0} and all(len(v) == 361 and len(set(v)) == 1 for v in got.values())


@pytest.mark.parametrize("block", [1024, 7])
def test_target_ranks_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(sweep, "ROWS", block)
    monkeypatch.setattr(sweep, "QUERIES", 5)
    r = np.random.default_rng(3)
    rows = [("1.0", f"a{i % 3}", f"id{i}", f"n{i % 11}", r.normal(size=5).tolist(), r.normal(size=8).tolist()) for i in range(90)]
    protos = {f"n{i}": r.normal(size=8) for i in range(6)}
    d = spark.createDataFrame(rows, "version string, arch string, function_id string, norm_name string, shape array<double>, fused array<double>").repartition(3)
    p = spark.createDataFrame([("1.0", n, v.tolist()) for n, v in protos.items()], "version string, norm_name string, proto array<double>")
    weights = scoring.ABLATION
    got = {(x["src_arch"], x["dst_arch"], x["function_id"], x["config"]): (x["rank"], x["has_proto"]) for x in sweep.target_ranks(d, p, weights).collect()}
    unit = lambda v: v / np.linalg.norm(v)
    want = {}
    for _, arch, i, name, shape, fused in rows:
        for dst in {f"a{k}" for k in range(3)} - {arch}:
            c = [x for x in rows if x[1] == dst]
            for k, (g, f, w) in enumerate(weights):
                s = [round(-g * sum(((a - b) / q) ** 2 for a, b, q in zip(shape, x[4], (1, 0.2, 0.2, 1, 1), strict=True)) + f * unit(fused) @ unit(x[5]) + w * (unit(protos[name]) @ unit(x[5]) if name in protos else 0), 9) for x in c]
                if own := [v for v, x in zip(s, c, strict=True) if x[3] == name]:
                    want[arch, dst, i, k] = (1 + sum(v > max(own) for v in s), name in protos)
    assert got == want
    one = {x["config"]: x for x in sweep.configuration_summary(sweep.target_ranks(d, p, weights)).collect()}[0]
    assert one["queries"] == len([k for k in want if k[3] == 0]) and one["prototype_coverage"] == pytest.approx(np.mean([v[1] for k, v in want.items() if k[3] == 0]))


def test_status_stream_drops_late_rows_and_goes_on(spark, tmp_path):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = sorted(c.execute(live.SQL["stream_step_status"]).fetchall())
    total = c.execute("SELECT count(*) FROM events").fetchone()[0]
    df = live.QUERIES["stream_step_status"](spark, SF)
    got = sorted(tuple(r) for r in df.select("hour", "step", "status", "n", "mean_sec", "max_sec").collect())
    assert [r[:4] for r in got] == [r[:4] for r in want] and 0 < sum(r[3] for r in got) < total  # late rows are missing
    e = live.arrivals(bindings.status(spark, SF)).cache()
    kept = e.drop("arrival", "day", "bucket")
    schema = ", ".join(f"{k} {v}" for k, v in kept.dtypes)
    run = lambda: streams.closed_status(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    rows = lambda: sorted(tuple(map(str, r)) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    for k in range(2):
        e.filter(F.col("arrival") == k).select(kept.columns).write.parquet(f"{tmp_path}/in/{k}")
        run()
    before = rows()
    run()  # nothing has arrived: the same table
    assert before and rows() == before


def test_ingest_stream_after_a_crash(spark, tmp_path):
    """A batch whose write is done but whose commit isn't is written again, over itself."""
    from fnatlas.jobs import dumps

    source = dumps.feature_dump(spark, SF)
    run = lambda: streams.feature_ingest(spark, source, f"{tmp_path}/out", f"{tmp_path}/check", at_once=2).awaitTermination()
    run()
    tables = lambda: [sorted(tuple(map(str, r)) for r in spark.read.parquet(f"{tmp_path}/out/{t}").collect()) for t in ("records", "histograms")]
    before = tables()
    assert len(before[0]) == readers.read_features(spark, source, files="*.json").count()
    commits = sorted((f for f in glob.glob(f"{tmp_path}/check/commits/*") if os.path.basename(f).isdigit()), key=lambda f: int(os.path.basename(f)))
    assert len(commits) > 2
    os.remove(commits[-1])
    for crc in glob.glob(f"{tmp_path}/check/commits/.{os.path.basename(commits[-1])}.crc"):
        os.remove(crc)
    run()
    assert tables() == before and os.path.exists(commits[-1])
    run()
    assert tables() == before
