import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from barloom.llm import langid as L

EN = "the quick brown fox jumps over the lazy dog and then the other thing that was there"
DE = "der schnelle braune fuchs springt über den faulen hund und dann das andere ding"
SCHEMA = "doc_id long, text string, lang string, source string, score string"


def docs(spark):
    rows = [(i, (EN if i % 2 else DE) + f" {i}", "en" if i % 2 else "de", "s", "clash") for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA)


def test_learns_and_predicts(spark):
    profiles = L.learn(docs(spark))
    assert sorted(profiles) == ["de", "en"] and all(len(p) <= L.PROFILE for p in profiles.values())
    rows = [(1, "the dog and the fox"), (2, "und der hund über"), (3, None), (4, ""), (5, " 12 !? \n"), (6, "THE" * 50_000), (6, "THE" * 50_000)]
    got = L.predict(spark.createDataFrame(rows, "doc_id long, text string"), profiles).collect()
    assert [r["lang_pred"] for r in got] == ["en", "de", "und", "und", "und", "en", "en"]
    assert all(0 <= r["score"] <= 1 for r in got) and got[2]["score"] == 0


def test_nothing_learned_and_empty(spark):
    none = docs(spark).limit(0)
    assert L.learn(none) == {}
    assert L.predict(docs(spark).select("doc_id", "text").limit(3), {}).select("lang_pred").distinct().collect() == [("und",)]
    assert L.predict(none.select("text"), {}).count() == 0
    untold = spark.createDataFrame([(1, EN, None, "s", "x"), (2, None, "en", "s", "x")], SCHEMA)
    assert L.learn(untold) == {}


def test_ranking_and_distance():
    fold = L.Folder()
    assert fold("aB1ß").tolist() == [ord("a"), ord("b"), 0, ord("ß")]
    codes = L.grams(fold("ab  ab"))
    top = L.ranked(codes, 3)
    counts = dict(zip(*np.unique(codes, return_counts=True)))
    assert [counts[c] for c in top] == sorted(counts.values(), reverse=True)[:3]
    assert list(top) == sorted(counts, key=lambda c: (-counts[c], c))[:3]
    # identical rankings are at distance 0
    assert L.Profiles({"x": top, "y": top[::-1].copy()}, 3).nearest(top) == ("x", 1.0)
    # ties go to the first name
    assert L.Profiles({"b": top, "a": top}, 3).nearest(top)[0] == "a"


def test_held_out_is_crc32(spark):
    import zlib

    got = spark.range(200).select("id", L.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_keep_identified_keeps_columns(spark):
    df = docs(spark).select("doc_id", "text", "lang", "source")
    more = df.unionByName(spark.createDataFrame([(99, "1234 5678", "en", "s")], df.schema))
    kept = L.keep_identified(more)
    assert kept.columns == df.columns and kept.count() == 60


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, EN, "a", 2.0)], "doc_id long, text string, lang_pred string, Score double")
    got = L.predict(df, L.learn(docs(spark)))
    assert got.columns == ["doc_id", "text", "lang_pred", "Score", "lang_pred_", "score_"]
    assert got.first()["lang_pred_"] == "en"


def profile_of(texts, size):
    """Ranking of letter n-grams straight from the definition."""
    n = Counter()
    for t in texts:
        for word in re.findall("[^\\W\\d_]+", t):
            w = word.lower() if len(word.lower()) == len(word) else "".join(c.lower()[0] for c in word)
            n.update(w)
            padded = f" {w} "
            n.update(padded[i : i + 2] for i in range(len(padded) - 1))
            n.update(padded[i : i + 3] for i in range(len(padded) - 2))

    def code(g):
        value = 0
        for c in g:
            value = value << 16 | (0 if c == " " else ord(c))
        return value | (len(g) - 1) << 60

    return sorted(n, key=lambda g: (-n[g], code(g)))[:size]


def test_query_like_brute_force(spark):
    import duckdb

    rows = duckdb.sql("SELECT doc_id, text, lang FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    import zlib

    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 and r[2] is not None and r[1] is not None]
    profiles = {lang: {g: i for i, g in enumerate(profile_of([r[1] for r in train if r[2] == lang], L.PROFILE))} for lang in sorted({r[2] for r in train})}
    want = {}
    for doc, text, _ in rows:
        own = profile_of([text or ""], L.PROFILE)
        sums = {lang: sum(abs(p[g] - i) if g in p else L.PROFILE for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sums, key=lambda k: (sums[k], k))
        want[doc] = (best, max(0.0, 1 - sums[best] / (L.PROFILE * len(own)))) if own else ("und", 0.0)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.op3_language_id(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == want.keys()
    assert [k for k in got if got[k][0] != want[k][0] or abs(got[k][1] - want[k][1]) > 1e-12] == []
