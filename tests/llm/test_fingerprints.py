import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from barloom.llm import fingerprints as P

SCHEMA = "doc_id long, text string, n_chars long, fingerprint string"


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def sketch(text, k=P.K):
    words = [w for w in re.split(r"[ \t\n\x0B\f\r]+", text.lower()) if w]
    hashed = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]

    def chain(hs):
        seed = 42
        for h in hs:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        return signed(seed)

    return sorted({chain(hashed[i : i + 5]) for i in range(max(1, len(hashed) - 4))} if hashed else set())[:k]


def likeness(a, b, k=P.K):
    union = sorted(set(a) | set(b))[:k]
    return 1.0 if not union else len(set(union) & set(a) & set(b)) / len(union)


def brute(rows):
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: -(r[0] if r[0] is not None else -(2**63)))
    out = []
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        a, b = sketch(text), sketch(edited)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(a), written(b), likeness(a, b), likeness(a, sketch(after))))
    return sorted(out, key=repr)


ROWS = [(i * 3, " ".join(f"word{(i * j) % 17}É" for j in range(i * 5)), 0, "x") for i in range(40)] + [(200, None, 0, "x"), (201, "", 0, "x"), (202, "🙂é漢" * 40, 0, "x"), (203, "a b", 0, "x"), (204, "a b", 0, "x"), (None, "last one here", 0, None)]


def written(sketch):
    return "".join(f"{h % (1 << 64):016x}" for h in sketch)


def rows_of(df):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in df.collect()), key=repr)


def test_like_brute_force(spark):
    assert rows_of(P.fingerprint_edits(spark, spark.createDataFrame(ROWS, SCHEMA))) == brute(ROWS)


def test_text_of_a_sketch_is_read_back(spark):
    df = spark.createDataFrame([([-(2**63), -1, 0, 5, 2**63 - 1],), ([],)], "s array<bigint>")
    got = df.select("s", P.as_text(F.col("s")).alias("t")).select("s", "t", P.from_text(F.col("t")).alias("back")).collect()
    assert all(list(r["s"]) == list(r["back"]) and r["t"] == written(r["s"]) for r in got)


def test_single_row_and_empty(spark):
    assert rows_of(P.fingerprint_edits(spark, spark.createDataFrame(ROWS[9:10], SCHEMA))) == brute(ROWS[9:10])
    assert P.fingerprint_edits(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows_follow_each_other(spark):
    rows = [ROWS[5], ROWS[5], ROWS[9]]
    got = P.fingerprint_edits(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3 and sum(r["near_next"] == 1.0 and r["doc_id"] == ROWS[5][0] for r in got) == 1


def test_merge_estimates_and_plan(spark):
    a, b = " ".join(f"a{i}" for i in range(600)), " ".join(f"a{i}" for i in range(300, 900))
    df = spark.createDataFrame([(1, a, b)], "id int, a string, b string")
    df = P.with_sketch(P.with_sketch(df, "a", "sa"), "b", "sb")
    r = df.select(P.resemblance(F.col("sa"), F.col("sb")).alias("r"), P.containment(F.col("sa"), F.col("sb")).alias("c"), P.distinct_shingles(F.col("sa")).alias("d"), P.merge(F.col("sa"), F.col("sb")).alias("m")).first()
    assert abs(r["r"] - 296 / 896) < 0.15 and abs(r["c"] - 296 / 596) < 0.2 and abs(r["d"] / 596 - 1) < 0.3
    assert list(r["m"]) == sorted(set(sketch(a, 10**9)) | set(sketch(b, 10**9)))[: P.K]
    plan = P.fingerprint_edits(spark, spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_sketch_of_a_group_is_the_sketch_of_its_texts(spark):
    df = P.with_sketch(spark.createDataFrame([(1, "a b c d e f g"), (1, "c d e f g h i"), (2, "x y")], "g int, text string"), "text", "s", k=4)
    got = {r["g"]: list(r["s"]) for r in P.merge_all(df, ["g"], "s", k=4).collect()}
    assert got[1] == sorted(set(sketch("a b c d e f g")) | set(sketch("c d e f g h i")))[:4] and got[2] == sketch("x y")
