import corpus_pipeline
from barloom.llm import registry
from test_ngramjoin import brute as brute_components

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if k < 3:
            assert all(after[d] == before[d] for d in after)
        before = after
    # the whole pipeline packs what is left
    whole = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in whole.select("doc_id").distinct().collect()} == set(before)
    assert whole.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 1024


def test_near_copies_stage_is_exact(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies_stage(spark, docs, DATA).collect()}
    rows = [(r["doc_id"], r["text"], 0, "") for r in docs.collect()]
    assert kept == {c for _, _, c in brute_components(rows)}


def test_every_query_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 11)) and set(registry.SQL) <= set(registry.QUERIES)
