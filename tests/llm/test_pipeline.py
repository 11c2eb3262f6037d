import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_on_a_small_table(spark, tmp_path):
    clean = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", "s", 10) for i in range(40)]
    passage = " ".join(f"passage{j}" for j in range(60))
    own = lambda x: "".join(f"{x}{j} " for j in range(200))
    rows = clean + [(100, clean[0][1], "en", "s", 10), (101, clean[1][1] + " more", "en", "s", 10), (102, own("a") + passage, "en", "s", 1), (103, own("b") + passage, None, None, None), (104, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        left[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns[:5] == corpus_pipeline.COLUMNS
    assert set(left["toxicity"]) == {r[0] for r in rows}
    assert set(left["minhash_near_dedup"]) == {r[0] for r in rows} - {100, 101}
    cut = left["suffix_array_dedup"]
    assert "passage30" not in cut[102] + cut[103] and all(cut[i] == clean[i][1] for i in range(40)) and cut[104] is None
    assert set(left["mixing"]) <= set(cut) and len(left["mixing"]) > 25
    assert all(r.decodes for r in docs.collect()) and docs.where("doc_id = 104").select("n_tokens").collect() == [(0,)]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
