"""The pipeline against a plain version of its stages."""

import brute
import corpus_pipeline


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = [i for i in sorted(rows) if brute.good(rows[i]["text"])]
    texts = brute.without_boilerplate([(i, rows[i]["source"], rows[i]["text"]) for i in kept])
    groups = brute.near_groups(list(texts.items()), 5, 80)
    wanted = {i for i, c in groups.items() if i == c}
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.settle(stage(spark, docs, folder), name)
        frames[name] = out
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    assert {r["doc_id"] for r in frames["quality_rules"].collect()} == set(kept)
    assert {r["doc_id"]: r["text"] for r in frames["line_dedup"].collect()} == texts
    assert {r["doc_id"] for r in frames["near_dedup"].collect()} == wanted
    assert {r["doc_id"]: r["text"] for r in frames["source_mix"].collect()} == {i: texts[i] for i in wanted}
    assert {r["doc_id"] for r in frames["packing"].collect()} == wanted
    assert corpus_pipeline.run(spark, folder).count() == frames["packing"].count()


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, "/root/testdata/sf0.001"), name)
    assert docs.count() == 0
