"""Registered queries against their SQL on the smallest tables, and the streaming jobs."""

import duckdb
import pytest

from fnatlas.jobs import catalog, dumps, extra, live, more
from fnatlas.sources import bindings
from fnatlas.streaming import streams

SF = "/root/testdata/sf0.001"
CHECKED = ["method_retrieval", "method_retrieval_temporal", "method_scores", "topk_rank", "pair_gain", "paired_signs", "latest_run", "status_coverage", "token_classes", "wilcoxon", "windowed_retrieval", "symbol_stats", "systematic_sample", "cross_arch_size_retrieval", "mutual_match", "change_transfer", "nearest_centroid", "feature_hashing", "shape_features", "prototypes_earlier_versions", "instruction_token", "classify_mnemonic", "string_category", "shared_names", "experiment_rollup", "weight_sweep", "ablation", "classification_metrics", "shape_distance", "coverage", "class_histogram", "temporal_frequency", "temporal_scalers", "temporal_prototypes", *dumps.QUERIES, *live.QUERIES, *extra.QUERIES, "function_record", "binary_features"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(catalog.oracle_sql()) == set(catalog.queries()) and set(more.SQL) == set(more.QUERIES) and set(dumps.SQL) == set(dumps.QUERIES) and set(live.SQL) == set(live.QUERIES) and set(extra.SQL) == set(extra.QUERIES)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, name):
    df = {**catalog.queries(), **more.QUERIES, **dumps.QUERIES, **live.QUERIES, **extra.QUERIES}[name](spark, SF)
    got = df.select(*sorted(df.columns)).collect()
    cur = duck.execute({**catalog.oracle_sql(), **more.SQL, **dumps.SQL, **live.SQL, **extra.SQL}[name])
    cols = [c[0] for c in cur.description]
    want = [tuple(r[cols.index(c)] for c in sorted(cols)) for r in cur.fetchall()]
    text = lambda r: tuple(f"{x + 0.0:.6f}" if isinstance(x, float) else str(x) for x in r)
    assert sorted(df.columns) == sorted(cols) and sorted(map(text, got)) == sorted(map(text, want))


def test_metrics_are_ordered(spark):
    for r in catalog.queries()["cross_arch_size_retrieval"](spark, SF).collect():
        assert r["hit_at_1"] <= r["hit_at_5"] <= r["hit_at_10"] and 1 <= r["mean_inspected_at_10"] <= 11


def test_streams(spark, tmp_path):
    d = bindings.docs(spark, SF)
    d.repartition(3).write.parquet(f"{tmp_path}/in")
    schema = ", ".join(f"{k} {v}" for k, v in d.dtypes)
    for _ in range(2):  # the second run finds nothing new
        streams.ingest(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == d.filter("size >= 16").count()
    e = bindings.status(spark, SF)
    e.repartition(2).write.parquet(f"{tmp_path}/events")
    live = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/events")
    q = streams.step_status(live).writeStream.outputMode("complete").format("memory").queryName("steps").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("steps").groupBy().sum("n").first()[0] == e.count()
