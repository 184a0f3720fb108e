"""Queries over tables larger than the samples and cuts that they once had."""

import bisect

import pytest
from pyspark.sql import functions as F

from fnatlas.jobs import catalog, more
from fnatlas.sources import bindings

SF = "/root/testdata/sf0.01"


@pytest.fixture
def two_binaries(spark, monkeypatch):
    """Two binaries of one version, with over 300 queries each way."""
    every = bindings.functions
    monkeypatch.setattr(bindings, "functions", lambda s, d: every(s, d).filter("version = 'rel-1.30.0' AND arch IN ('1-URGENT', '5-LOW')"))
    return bindings.functions(spark, SF).select("arch", "function_id", "address", "size", "norm_name").collect()


def nearest(size, rows):
    """The ten nearest of the sorted rows: the left side first on ties, ranked by distance, then place."""
    right = bisect.bisect_left(rows, (size,))
    left = right - 1
    out = []
    while len(out) < 10 and (left >= 0 or right < len(rows)):
        if right >= len(rows) or left >= 0 and size - rows[left][0] <= rows[right][0] - size:
            out.append(left)
            left -= 1
        else:
            out.append(right)
            right += 1
    return [rows[i][1] for i in sorted(out, key=lambda i: (abs(rows[i][0] - size), i))]


def test_all_relevant_queries(spark, two_binaries):
    want = {}
    for src in ("1-URGENT", "5-LOW"):
        there = sorted((r["size"], r["norm_name"], r["address"], r["function_id"]) for r in two_binaries if r["arch"] != src)
        names = {r[1] for r in there}
        found = [nearest(r["size"], there) for r in two_binaries if r["arch"] == src and r["norm_name"] in names]
        asked = [r["norm_name"] for r in two_binaries if r["arch"] == src and r["norm_name"] in names]
        want[src] = (len(asked), *[sum(n in f[:k] for n, f in zip(asked, found, strict=True)) / len(asked) for k in (1, 5, 10)])
    assert min(w[0] for w in want.values()) > 300
    got = {r["src_arch"]: r for r in catalog.queries()["cross_arch_size_retrieval"](spark, SF).collect()}
    for src, (n, *hits) in want.items():
        assert got[src]["queries"] == n and [got[src][f"hit_at_{k}"] for k in (1, 5, 10)] == pytest.approx(hits, abs=1e-8)
    windowed = catalog.queries()["windowed_retrieval"](spark, SF).collect()
    assert len(windowed) == 6 and all(r["queries"] == want[r["src_arch"]][0] for r in windowed)
    assert more.QUERIES["transfer_calibration"](spark, SF).count() == sum(w[0] for w in want.values())


def test_whole_texts(spark, tmp_path):
    texts = ["a " * 5000 + "last " + "b " * 1000, "a short last"]
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path))
    assert {r["token"]: r["df"] for r in run("doc_frequency").collect()} == {"a": 2, "last": 2, "b": 1, "short": 1}
    assert {r["function_id"]: r["n"] for r in run("class_histogram").groupBy("function_id").agg(F.sum("n").alias("n")).collect()} == {"doc-0": 6001, "doc-1": 3}
    assert {r["function_id"]: r["tokens"] for r in run("tfidf_norms").collect()} == {"doc-0": 3, "doc-1": 3}
    record = {r["function_id"]: r for r in run("function_record").collect()}
    assert record["doc-0"]["instruction_count"] == 6001 and record["doc-0"]["token_truncated"] == 1 and len(record["doc-0"]["tokens"].split()) == 4096
    assert record["doc-1"]["tokens"] == "a short last" and record["doc-1"]["token_truncated"] == 0
