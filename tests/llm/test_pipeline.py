import corpus_pipeline
from tests.llm.conftest import PASSAGE, some, texts


def test_stages(spark, tmp_path):
    """Each stage takes what the one before kept, keeps the columns, and leaves clean rows alone."""
    rows = [(100 + i, some(100 + i, 60) + (" you stupid moron" if i % 4 == 0 else "")) for i in range(200)]
    rows += texts()
    docs = spark.createDataFrame([(i, t, ["a", "b", None][n % 3], "en", len(t or ""), 0.5, "x") for n, (i, t) in enumerate(rows)], "doc_id long, text string, source string, lang string, n_chars long, score double, size string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "mixing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {k: [r["doc_id"] for r in v.select("doc_id").collect()] for k, v in kept.items()}
    assert {i for i in ids["toxicity"] if i and i >= 100} == {100 + i for i in range(200) if i % 4} and 24 not in ids["toxicity"]
    assert 1 in ids["near_dedup"] and not {2, 3} & set(ids["near_dedup"]) and ids["near_dedup"].count(None) == 2
    assert set(ids["near_dedup"]) - set(ids["decontamination"]) == {12, 13}
    assert sorted(map(str, ids["pii"])) == sorted(map(str, ids["decontamination"]))
    assert "[EMAIL]" in kept["pii"].filter("doc_id = 20").first()["text"]
    assert kept["mixing"].filter("words > size OR words < 1").count() == 0


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
