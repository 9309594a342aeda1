import random

from skew import final_plan, skewed

from barloom.llm._common import Scratch
from barloom.llm.components import components, joined_least


def test_random_graph(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(500, 500)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"), "c").collect()
    want = {i: find(i) for a, b in links if a != b for i in (a, b)}
    assert {r["id"]: r["component"] for r in got} == want and len(got) == len(want)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), "none").count() == 0


def test_hub_is_split(spark):
    """One node with most of the links: its star's join is split."""
    links = [(0, i) for i in range(1, 3000)] + [(4000 + 2 * i, 4001 + 2 * i) for i in range(1000)]
    with skewed(spark):
        edges = spark.createDataFrame([(b, a) for a, b in links], "u long, v long").repartition(8)
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        joined, _ = joined_least(both, Scratch(spark, "test"), "least")
        rows, plan = final_plan(joined)
        assert len(rows) == 2 * len(links) and "skew=true" in plan
        got = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"), "hub")
        assert got.filter("component = 0").count() == 3000
