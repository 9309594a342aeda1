import re

from pyspark.sql import functions as F

from barloom.llm import linededup as D

from skew import final_plan, skewed

SCHEMA = "doc_id long, text string, n_chars long, removed string"
FULL = "one two three four five six seven eight nine ten and the same again and again until there are more than enough of them."
LONG = "one two three four five six seven eight nine ten."
ROWS = [
    (2, "First line of some words here\nshort one\nsecond line of other words there", 0, "x"),
    (1, "SECOND  line of other words there\n" + "Alpha. " + LONG + " Omega.", 0, "x"),
    (3, "first line of some words here\nfirst line of some words here\nshort one", 0, "x"),
    (4, "A tail before it. " + LONG + " And so it goes on to the very end of it.", 0, "x"),
    (5, None, 0, "x"),
    (6, "", 0, "x"),
    (7, "\n\n", 0, "x"),
    (8, LONG, 0, "x"),
    (8, "another text under one id here", 0, "x"),
    (8, LONG, 0, "x"),
    (None, LONG, 0, None),
]


def brute(rows):
    seen, out = {}, {}
    order = sorted(set((r[0], r[1]) for r in rows), key=lambda r: (r[0] if r[0] is not None else -(2**63)))
    first = {}
    for doc, text in order:
        for begin, stop, digest in D.split_units(text or ""):
            place = (doc if doc is not None else -(2**63), begin)
            first[digest] = min(first.get(digest, place), place)
    for doc, text in order:
        if text is None:
            out[doc, text] = None
            continue
        gone = [(b, s) for b, s, g in D.split_units(text) if (doc if doc is not None else -(2**63), b) > first[g]]
        out[doc, text] = D.without_spans(text, gone)
        seen[doc, text] = gone
    return out, seen


def test_like_brute_force(spark):
    want, spans = brute(ROWS)
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = D.dedup_table(df, min_run=0)
    assert out.columns == [*df.columns, "removed_"]
    got = out.drop("removed").withColumnRenamed("removed_", "removed").collect()
    assert len(got) == len(ROWS)
    left = sorted((r["doc_id"], r["text"]) for r in got if r["doc_id"] is not None and r["text"] is not None)
    assert left == sorted((r[0], want[r[0], r[1]]) for r in ROWS if r[0] is not None and r[1] is not None)
    by = {r["doc_id"]: r for r in got}
    assert [(s["begin"], s["stop"], s["first_doc_id"]) for s in by[1]["removed"]] == [(41, 90, None)]
    assert by[2]["text"] == "First line of some words here\nshort one"
    assert by[3]["text"] == "short one" and len(by[3]["removed"]) == 2
    assert by[4]["text"] == "A tail before it. And so it goes on to the very end of it."
    assert by[5]["text"] is None and by[6]["text"] == "" and by[7]["text"] == "\n\n"
    original = {r[0]: r[1] for r in ROWS}
    assert {re.sub(" +", " ", original[1][s["begin"] : s["stop"]]) for s in by[1]["removed"]} == {LONG}


def test_stage_keeps_columns_and_drops_emptied_texts(spark):
    df = spark.createDataFrame([(1, LONG, 49, "a"), (2, LONG, 49, "b"), (3, "", 0, "c"), (4, "x " + LONG, 51, "d")], "doc_id long, text string, n_chars int, lang string")
    df = df.withColumn("text", F.regexp_replace("text", LONG, FULL)).withColumn("n_chars", F.length("text"))
    got = D.keep_first_lines(df)
    assert got.schema == df.schema
    assert sorted(map(tuple, got.collect())) == [(1, FULL, len(FULL), "a"), (3, "", 0, "c"), (4, "x " + FULL, len(FULL) + 2, "d")]


def test_empty_table(spark):
    assert D.dedup_table(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_and_paragraphs(spark):
    text = "\n".join(f"line {i} with a few more words" for i in range(5000))
    rows = [(1, text), (2, text + "\nand one line of its own here")]
    got = {r["doc_id"]: r["text"] for r in D.dedup_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: text, 2: "and one line of its own here"}
    rows = [(1, "a b c d e\nf g\n\nh i j k l"), (2, "h i j k l\n\nx y z")]
    got = {r["doc_id"]: r["text"] for r in D.dedup_table(spark.createDataFrame(rows, "doc_id long, text string"), separator="\n\n", min_run=0).collect()}
    assert got == {1: rows[0][1], 2: "x y z"}


def test_only_long_runs_go():
    def span(a, b):
        return {"begin": a, "stop": b, "first_doc_id": 1}

    near = [span(0, 60), span(60 + D.GAP, 120 + D.GAP)]
    assert D.long_runs(near, 120 + D.GAP) == near and D.long_runs(near, 121 + D.GAP) == []
    apart = [span(0, 60), span(61 + D.GAP, 170 + D.GAP)]
    assert D.long_runs(apart, 100) == apart[1:]
    nested = [span(0, 200), span(0, 30), span(150, 170), span(235, 240)]
    assert D.long_runs(nested, 240) == nested and D.long_runs([], 0) == []


def test_hot_line_is_split(spark):
    """70 % of all documents hold one line: its occurrences are dealt to several tasks."""
    line = "the one line that most of these documents hold in common"
    rows = [(i, f"{line}\nown line number {i} of the document {i}" if i % 10 < 7 else f"own line number {i} of the document {i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    with skewed(spark):
        spans = D.later_spans(docs)
        rows, plan = final_plan(spans)
        assert len(rows) == 2799 and "skew=true" in plan
