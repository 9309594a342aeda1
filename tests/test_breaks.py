"""Break tests that go through every end and start point give what refitting gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import breaks
from barloom.operators.stationarity import _fit
from barloom.plans import catalog

DATA = "/root/testdata/sf0.001"
LONGER = "/root/testdata/sf0.01"
VALUES = 500 + np.cumsum(np.random.default_rng(5).normal(size=140))


@pytest.fixture(scope="module")
def walk(spark):
    return spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(VALUES)], "symbol string, seq long, close double").withColumn("ts", F.timestamp_seconds("seq"))


def refit(x, lags):
    return breaks._adf_t(x, lags)


def trend(y, kind, penalty):
    t = np.arange(1, len(y) + 1, dtype=float)
    x = {"poly1": [t, t * t], "poly2": [t, t * t], "exp": [t], "power": [np.log(t)]}[kind]
    b, se, _ = _fit(y if kind == "poly1" else np.log(y), np.stack([np.ones(len(t)), *x], 1))
    return abs(b[-1]) / (se[-1] * len(y) ** penalty)


@pytest.mark.parametrize("lags", [0, 1, 3])
def test_adf_of_every_start(spark, walk, lags):
    sup = {r["seq"]: r["sadf"] for r in breaks.supremum_adf(walk, first=90, shortest=40, lags=lags, ends=32).collect()}
    tail = {r["seq"]: r for r in breaks.quantile_adf(walk, first=90, shortest=40, lags=lags, ends=32).collect()}
    assert sorted(sup) == sorted(tail) == list(range(90, 140))
    for end in sup:
        found = np.array([refit(VALUES[s : end + 1], lags) for s in range(end + 1 - 40 + 1)])
        assert sup[end] == pytest.approx(found.max(), abs=1e-8)
        top = found[found >= np.quantile(found, 0.95)]
        assert [tail[end][c] for c in ("qadf", "cadf", "cadf_std")] == pytest.approx([np.quantile(found, 0.95), top.mean(), top.std()], abs=1e-8)


@pytest.mark.parametrize("kind", ["poly1", "poly2", "exp", "power"])
def test_trends_of_every_start(walk, kind):
    got = {r["seq"]: r["smt"] for r in breaks.martingale_test(walk, kind=kind, penalty=0.5, first=90, step=1, start_step=1, ends=32).collect()}
    assert sorted(got) == list(range(90, 140))
    for end in got:
        assert got[end] == pytest.approx(max(trend(VALUES[s : end + 1], kind, 0.5) for s in range(end + 1 - 50 + 1)), abs=1e-8)


def test_values_without_logarithm_or_variation():
    y = np.concatenate([[3.0, -1.0], VALUES[:60]])
    assert len(breaks._trend_starts(y, "exp", 0.5, 50)) == 11
    assert len(breaks._adf_starts(np.full(60, 2.0), 1, 20)) == 0
    assert len(breaks._adf_starts(VALUES[:10], 1, 20)) == 0


@pytest.mark.parametrize("name,first", [("expanding_adf", 1000), ("supremum_adf", 200), ("quantile_adf", 400)])
def test_queries_go_through_every_end(spark, name, first):
    days = catalog.QUERIES["ar1_design"](spark, DATA).count() + 2
    assert catalog.QUERIES[name](spark, DATA).count() == days - first


def test_martingale_query_goes_through_every_end(spark):
    days = catalog.QUERIES["ar1_design"](spark, DATA).count() + 2
    rows = catalog.QUERIES["martingale_tests"](spark, DATA).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in rows} == dict.fromkeys(("poly1", "poly2", "exp", "power"), days - 400)


def csw_brute(v, window, least):
    out = {}
    for t in range(window, len(v)):
        past = v[t - window : t]
        found = [(past[-1] - past[n]) / (np.std(np.diff(past[n:]), ddof=1) * np.sqrt(len(past) - n)) for n in range(window - least)]
        out[t] = max(found)
    return out


@pytest.mark.parametrize("window,block", [(60, 16), (100, 500)])
def test_csw_like_the_definition(walk, window, block):
    got = {r["seq"]: r["csw"] for r in breaks.csw_statistic(walk, window, 20, block=block).collect()}
    assert got == pytest.approx(csw_brute(VALUES, window, 20), abs=1e-8)


def test_csw_query_over_2000_rows(spark):
    values = catalog.QUERIES["csw_test_2000"](spark, LONGER).collect()
    days = catalog.QUERIES["ar1_design"](spark, LONGER).count() + 2
    assert len(values) == days - 2000
    short = {r["seq"]: r["csw"] for r in catalog.QUERIES["csw_test"](spark, LONGER).collect()}
    assert all(r["csw"] >= short[r["seq"]] for r in values) and any(r["csw"] > short[r["seq"]] for r in values)
    critical = catalog.QUERIES["csw_critical_value_2000"](spark, LONGER).first()["critical"]
    assert critical == pytest.approx(np.quantile([r["csw"] for r in values], 0.99), abs=2e-6)


def test_rules_see_100_000_paths(spark):
    assert {r["n"] for r in catalog.QUERIES["trading_rule_grid"](spark, DATA).collect()} == {100_000}
