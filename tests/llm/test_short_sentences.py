"""Passages of short sentences inside longer lines."""

import duckdb

from barloom.llm import linededup as D
from barloom.llm import registry

PASSAGE = "One two three four five. Six seven eight nine ten eleven. Twelve and thirteen and so on. Until it is long enough for a run of them."


def test_pipeline_removes_passages_of_short_sentences(spark):
    rows = [(1, "Here is how it begins at first. " + PASSAGE), (2, "Something else stands before it there. " + PASSAGE + " A tail.")]
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in rows], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in D.keep_first_lines(docs).collect()}
    assert got[1]["text"] == rows[0][1]
    assert got[2]["text"] == "Something else stands before it there. A tail." and got[2]["n_chars"] == len(got[2]["text"])


def test_query_like_duckdb(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    df = registry.QUERIES["substring_dedup_every_unit"](spark, data)
    rel = con.sql(registry.SQL["substring_dedup_every_unit"])
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
