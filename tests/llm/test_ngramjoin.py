import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import ngramjoin as J

SCHEMA = "doc_id long, text string, key long, c string"


def shingle_set(text, k=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, percent=80):
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            first[find(i)] = min(first.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), first.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=repr)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for _ in range(n):
        text = [rnd.choice(words) for _ in range(rnd.choice([3, 6, 9, 14, 30, 80, 200]))]
        for _ in range(rnd.choice([1, 1, 2, 6])):
            edited = list(text)
            for _ in range(rnd.choice([0, 1, 2, 5])):
                edited[rnd.randrange(len(edited))] = rnd.choice(words).upper()
            rows.append((len(rows) + 1, " ".join(edited), 0, "x"))
    return rows


@pytest.mark.parametrize("boundary", [None, 0, 60])
def test_like_brute_force(spark, monkeypatch, boundary):
    monkeypatch.setattr(J, "HEAVY_DOCS", 4)
    if boundary is not None:
        monkeypatch.setattr(J, "choose_boundary", lambda *a, **k: boundary)
    rows = corpus(3) + [(1001, None, 0, "x"), (1002, "", 0, "x"), (1003, " \n\t ", 0, "x"), (1004, "One two", 0, "x"), (1005, "one\n\vTWO", 0, "x"), (1006, "É é", 0, "x"), (1007, "é é", 0, "x"), (5, corpus(3)[4][1], 1, "y"), (None, corpus(3)[0][1], 1, None), (None, None, None, None)]
    got = J.join_components(spark, spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_chain_is_one_component(spark):
    words = [f"a{k}" for k in range(200)]
    rows = [(i + 1, " ".join(words[2 * i : 2 * i + 100]), 0, "") for i in range(12)]
    got = J.join_components(spark, spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()
    assert {r["component_id"] for r in got} == {1}
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_empty_table(spark):
    assert J.join_components(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = corpus(5, 20)
    rows += [rows[0], rows[0], (None, None, 1, None), (None, None, 1, None)]
    kept = J.keep_one_of_each(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert kept[0].__fields__ == ["doc_id", "text", "key", "c"]
    want = sorted({c for d, _, c in brute(rows) if d is not None})
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == want


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300), st.integers(0, 200))
def test_sketch_never_exceeds_the_difference(a, b, shared):
    b = b | set(sorted(a)[:shared])
    if not b:
        return
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert J.sketch_difference(J.parity_sketch(x), J.parity_sketch(y)) <= len(a ^ b)


def test_words_and_parts_agree():
    texts = ["a  B\tc\x0bd\x0ce\rf", None, "", "x" * 3000, "É b c d e f g", "a  B\tc\x0bd\x0ce\rf"]
    found = dict(J.shingle_sets(pa.array(texts)))
    assert (found[0] == found[5]).all() and set(found) == {0, 3, 4, 5}
    assert [len(found[i]) for i in (0, 3, 4)] == [2, 1, 3]
    alone = dict(J.shingle_sets(pa.array(texts[4:5])))
    assert (alone[0] == found[4]).all()
    # the non-breaking space is part of a word
    assert len(dict(J.shingle_sets(pa.array(["a b c d e f g"])))[0]) == 2


def test_boundary_follows_cost():
    assert J.choose_boundary({10: 100}, entries=1e6) >= 10
    assert J.choose_boundary({100: 100}, entries=0.0) < 100


def test_info_fields(spark):
    info = J.packed(146, np.array([0, 5, 2**25]), np.array([True, False, True]), 1000)
    got = spark.createDataFrame([(int(i),) for i in info], "info long").select(*(c.alias(k) for k, c in J.info_fields().items())).collect()
    assert [tuple(r) for r in got] == [(146, 0, 1000, True), (146, 5, 1000, False), (146, 0, 1000, True)]


def test_collisions_of_digests_are_told_apart(spark):
    rows = corpus(5, 40)
    got = J.join_components(spark, spark.createDataFrame(rows, SCHEMA), class_bits=4).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_query_enumerates_subsets_at_its_own_boundary(spark, monkeypatch):
    """Short texts of few common words: the boundary that the costs choose is well above 4, and 2-subsets make the result."""
    rnd = random.Random(8)
    rows = []
    for k in range(60):
        text = [f"w{rnd.randrange(60)}" for _ in range(24)]
        for _ in range(20):
            edited = list(text)
            edited[rnd.choice([0, -1])] = f"x{rnd.randrange(4)}"
            rows.append((len(rows) + 1, " ".join(edited), 0, "x"))
    seen = []
    choose = J.choose_boundary
    monkeypatch.setattr(J, "choose_boundary", lambda *a, **k: seen.append(choose(*a, **k)) or seen[-1])
    got = J.join_components(spark, spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert seen[0] > 20 and max(len(shingle_set(r[1])) for r in rows) <= seen[0]


def test_shared_template_without_links_makes_no_pairs(spark):
    """Documents that share 82 % of their shingles don't link, and aren't paired either."""
    base = " ".join(f"t{i}" for i in range(200))
    rows = [(k, base + " " + " ".join(f"d{k}n{i}" for i in range(40)), 0, "x") for k in range(300)]
    got = J.join_components(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)
    rest = spark.createDataFrame([(1, 0, k, k, 236, 40) for k in range(300)], "key long, most long, c long, g long, n int, at int")
    assert J.across(rest).count() == 0


def test_pairs_across_components_like_all_pairs(spark):
    rnd = random.Random(3)
    members = [(rnd.randrange(3), 1, c, rnd.randrange(40), n := rnd.randrange(4, 60), rnd.randrange(0, 1 + n // 5)) for c in range(150)]
    got = J.ordered_pairs(J.across(spark.createDataFrame(members, "key long, most long, c long, g long, n int, at int")), "ca", "cb").collect()
    want = set()
    for ka, most, ca, ga, na, ata in members:
        for kb, _, cb, gb, nb, atb in members:
            if ka == kb and ca < cb and ga != gb and 100 * min(na, nb) >= 80 * max(na, nb) and 180 * min(na - ata, nb - atb) >= 80 * (na + nb):
                want.add((ca, cb))
    assert {tuple(r) for r in got} == want and want


def test_one_very_long_text(spark):
    """Texts beyond a block of the hash, one of them a single word, are whole."""
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long, 0, "x"), (2, long + " tail", 0, "x"), (3, "x" * 1_500_000, 0, "x"), (4, "X" * 1_500_000, 0, "x"), (5, "x" * 1_500_001, 0, "x")]
    got = J.join_components(spark, spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == [(1, 199_996, 1), (2, 199_997, 1), (3, 1, 3), (4, 1, 3), (5, 1, 5)]
