import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import DOC, texts


def test_stages(spark, tmp_path):
    rows = texts(80, 9)
    item = "one leaked question of the benchmark with quite enough plain words in it to be found again"
    rows.append((500, " ".join(f"v{i}" for i in range(60)) + " " + item))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {i: t for i, t in rows if (f := brute.figures(t))[0] >= 50 and 100 * f[4] <= 50 * f[0]}
    first = brute.components(list(good.items()), 5, 80)
    for (_, stage), want in zip(corpus_pipeline.STAGES[:4], (set(good), set(first.values()), set(first.values()) - {500}, set(first.values()) - {500}), strict=True):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{stage.__name__}")
        assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{stage.__name__}")
        assert {r["doc_id"] for r in docs.collect()} == want
    assert not any(brute.spans(r["text"]) for r in docs.collect())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and {r["doc_id"] for r in out} <= {r["doc_id"] for r in docs.collect()} and all(1 <= r["copies"] <= 2 for r in out)
