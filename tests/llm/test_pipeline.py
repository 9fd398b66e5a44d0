import duckdb

import corpus_pipeline
from stratalake.llm import ngram_join, quality, secrets
from stratalake.llm.common import table

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect_and_pieces_cover_what_is_kept(spark, tmp_path):
    docs, kept = table(spark, DATA, "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert out.columns == docs.columns
        kept.append({r["doc_id"] for r in out.select("doc_id").collect()})
        docs = out
    first = table(spark, DATA, "documents")
    w = quality.fit(first, table(spark, DATA, "labels"))
    good = {r["doc_id"] for r in quality.quality_scores(first, w).where("predicted = 1").collect()}
    assert kept[0] == good
    from tests.llm.test_ngram_join import brute

    texts = dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())
    groups = brute([(k, texts[k]) for k in sorted(good)], 5, 8, 10)
    assert kept[1] == {g[2] for g in groups} == kept[2] == kept[3]
    clean = spark.read.parquet(f"{tmp_path}/2")
    assert all(not secrets.base_spans(r["text"]) for r in clean.collect())
    same = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert all(same[k] == texts[k] for k in same if not secrets.base_spans(texts[k]))
    whole = corpus_pipeline.run(spark, DATA)
    assert whole.columns == docs.columns and {r["doc_id"] for r in whole.collect()} == kept[3]
    assert ngram_join.one_of_each(clean, 5, 8, 10).count() >= 1


ODD = [(1, 'token = "abcdef123456" ' + "some words of a text that goes on " * 6, 5, 7, "x"), (1, 'token = "abcdef123456" ' + "some words of a text that goes on " * 6, 5, 7, "x"), (1, "another text under the same id, which must not be lost", 5, 7, "x"),
       (2, None, 0, 7, "x"), (3, "", 0, 7, "x"), (None, "a row without an id but with its own words", 9, 7, "x"), (4, "word " * 200_000, 1_000_000, 7, "x"), (5, "z" * 1_000_000, 1_000_000, 7, "x"), (6, " \n", 2, 7, "x")]


def test_every_stage_on_odd_rows_and_empty_tables(spark, tmp_path, monkeypatch):
    import numpy as np

    df = spark.createDataFrame(ODD, "doc_id long, text string, n_chars long, node int, row_id string").repartition(3)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    high = np.append(np.zeros(quality.DIMENSIONS), 9.0)
    assert corpus_pipeline.quality_stage(spark, df, str(tmp_path)).count() == 0  # no label, no score above a half
    monkeypatch.setattr(quality, "fit", lambda docs, labels: high)
    want = {"quality": 9, "near_duplicates": 8, "secrets": 9}
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["text"] is None)
    for name, stage in corpus_pipeline.STAGES[:3]:
        for docs, n in ((df, want[name]), (df.limit(0), 0)):
            out = stage(spark, docs, str(tmp_path))
            assert out.schema == docs.schema
            found = sorted(out.collect(), key=key)
            assert len(found) == n
            if n and name == "near_duplicates":
                assert [(r["doc_id"], r["text"]) for r in found] == sorted({(r[0], r[1]) for r in ODD}, key=lambda r: key({"doc_id": r[0], "text": r[1]}))
            if n and name == "secrets":
                assert sum(r["text"] is None for r in found) == 1 and all("abcdef123456" not in (r["text"] or "") for r in found)
                assert sorted(len(r["text"] or "") for r in found)[-2:] == [1_000_000] * 2
    pieces = corpus_pipeline.packing_stage(spark, df, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {r[0] for r in ODD} and sum(r["length"] for r in pieces if r["doc_id"] in (2, 3, 6)) == 3
    assert corpus_pipeline.packing_stage(spark, df.limit(0), str(tmp_path)).count() == 0
