"""Hand-made cases, published values and properties."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.columns import sample_kurtosis, sample_skew
from barloom.functions.normal import norm_cdf, norm_ppf
from barloom.operators import backtest, bars, breaks, cv, entropy, fracdiff, joins, labels, models, sampling, simulation, sizing, stationarity, weights
from barloom.sources import synthetic, trades


def series(spark, values, symbol="A", name="close"):
    rows = [(symbol, i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"symbol string, seq long, {name} double").withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))


def at(spark, minutes):
    return F.timestamp_seconds(F.lit(minutes * 60))


def test_volume_bars_drop_the_excess_and_the_open_bar(spark):
    t = series(spark, [10.0] * 5, name="price").withColumn("quantity", F.lit(4.0))
    got = bars.volume_bars(t, 5.0).orderBy("bar_id").collect()
    assert [(r["bar_id"], r["num_ticks"], r["volume"]) for r in got] == [(0, 2, 8.0), (1, 2, 8.0)]
    ids = bars.threshold_bar_ids(t, F.col("quantity"), 5.0)
    closed = ids.groupBy("bar_id").agg(F.sum("quantity").alias("v"), F.sum(F.when(~F.col("closes"), F.col("quantity"))).alias("before"), F.max("closes").alias("c")).filter("c").collect()
    assert all(r["v"] >= 5 and (r["before"] or 0) < 5 for r in closed)


def test_cusum_resets_one_side(spark):
    got = sampling.cusum_events(series(spark, [0, 2, 4, -1]).withColumn("h", F.lit(3.0))).orderBy("seq").collect()
    assert [(r["seq"], r["direction"]) for r in got] == [(2, 1), (3, -1)]


def test_barriers_are_strict(spark):
    b = series(spark, [100, 112.5, 87.5, 100])
    e = spark.createDataFrame([("A", 0.125, 1), ("A", 0.05, 1)], "symbol string, trgt double, side int").withColumn("t0", at(spark, 0)).withColumn("t1", at(spark, 3))
    exact = labels.triple_barrier(b, e.filter("trgt > 0.1")).first()
    assert exact["pt"] is None and exact["sl"] is None and exact["first_touch"] == exact["t1"]
    hit = labels.triple_barrier(b, e.filter("trgt < 0.1")).first()
    assert hit["pt"] < hit["sl"] and hit["first_touch"] == hit["pt"]
    off = labels.triple_barrier(b, e.filter("trgt < 0.1"), profit=0.0).first()
    assert off["pt"] is None and off["sl"] is not None


def test_concurrency_closed_and_open(spark):
    b = series(spark, range(1, 6)).withColumn("ts", F.timestamp_seconds(F.col("close")))
    e = spark.createDataFrame([("A", 1, 3, 1.0), ("A", 2, 2, 1.0), ("A", 3, 5, 1.0)], "symbol string, a long, z long, v double").select("symbol", F.timestamp_seconds("a").alias("t0"), F.timestamp_seconds("z").alias("t1"), "v")
    assert [r["n"] for r in joins.concurrency(b, e).orderBy("seq").collect()] == [1, 2, 2, 1, 1]
    assert [(r["ts"].second, r["n"]) for r in joins.sweep(e, ["v"]).orderBy("ts").collect()] == [(1, 1), (2, 1), (3, 1), (5, 0)]
    tw = weights.average_uniqueness(b, e).orderBy("t0", "t1").collect()
    assert [round(r["tw"], 6) for r in tw] == [round(2 / 3, 6), 0.5, round(2.5 / 3, 6)]


def test_rolling_window_leaves_its_left_end_out(spark):
    rows = [("A", 0, 1.0, 0), ("A", 1, 2.0, 12), ("A", 2, 6.0, 24), ("A", 3, 30.0, 30)]
    df = spark.createDataFrame(rows, "symbol string, seq long, close double, h int").withColumn("ts", F.timestamp_seconds(F.col("h") * 3600))
    got = [r["trgt"] for r in sampling.rolling_volatility(df).orderBy("seq").collect()]
    assert got[:2] == [None, None] and got[2] == pytest.approx(np.std([1, 2], ddof=1)) and got[3] == pytest.approx(np.std([1, 2, 4], ddof=1))


def test_ffd_lengths_and_identities(spark):
    assert [len(fracdiff.ffd_weights(d)) for d in (0.0, 0.5, 0.69, 0.95, 1.0)] == [1, 927, 390, 79, 2]
    x = np.random.default_rng(0).normal(size=399).cumsum()
    df = series(spark, x)
    assert fracdiff.ffd(df, "close", 0.95).filter("ffd IS NOT NULL").count() == 321
    one = [r["ffd"] for r in fracdiff.ffd(df, "close", 1.0).orderBy("seq").collect()]
    assert one[0] is None and np.allclose(one[1:], np.diff(x))
    assert np.allclose([r["ffd"] for r in fracdiff.ffd(df, "close", 0.0).orderBy("seq").collect()], x)
    gaps = series(spark, [None, 1, None, 4, 8])
    assert [r["ffd"] for r in fracdiff.ffd(gaps, "close", 1.0).orderBy("seq").collect()] == [None, None, None, 3.0, 4.0]


def test_fold_carries_state_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = series(spark, np.arange(200.0)).unionByName(series(spark, np.arange(50.0), "B"))
        got = fracdiff.ffd(df, "close", 1.0)
        assert got.filter("ffd = 1").count() == 248 and got.filter("ffd IS NULL").count() == 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_normal_functions(spark):
    p = [1e-12, 1e-6, 0.001, 0.02, 0.3, 0.5, 0.7, 0.99, 1 - 1e-9]
    df = spark.createDataFrame([(v,) for v in p], "p double").withColumn("z", norm_ppf(F.col("p"))).withColumn("back", norm_cdf(F.col("z")))
    for r in df.collect():
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-12, abs=1e-12) and r["back"] == pytest.approx(r["p"], rel=1e-8)
    assert spark.range(1).select(norm_ppf(F.lit(0.0)).alias("z")).first()["z"] is None


def test_corrected_moments(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 8.0, 16.0)], "x double")
    r = df.agg(sample_skew("x").alias("s"), sample_kurtosis("x").alias("k")).first()
    x, n = np.array([1.0, 2.0, 4.0, 8.0, 16.0]), 5
    z = (x - x.mean()) / x.std(ddof=1)
    assert r["s"] == pytest.approx(n / ((n - 1) * (n - 2)) * (z**3).sum())
    assert r["k"] == pytest.approx(n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * (z**4).sum() - 3 * (n - 1) ** 2 / ((n - 2) * (n - 3)))


def test_published_values():
    assert backtest.symmetric_sharpe(0.6, 52) == pytest.approx(1.4720, abs=1e-3)
    assert backtest.implied_precision(2, 52) == pytest.approx(0.63363, abs=1e-4)
    assert backtest.implied_frequency(2, 0.6) == pytest.approx(96, abs=0.01)
    assert backtest.implied_precision(2.5, 252) == pytest.approx(0.57778, abs=1e-4)
    win = backtest.implied_win(1.4, 0.7, 12, -0.05)
    assert backtest.asymmetric_sharpe(0.7, 12, win, -0.05) == pytest.approx(1.4)
    assert backtest.asymmetric_sharpe(backtest.implied_precision_asymmetric(1.4, 12, 0.02, -0.01), 12, 0.02, -0.01) == pytest.approx(1.4)
    assert cv.path_count(13, 7) == 924 and cv.path_count(15, 5) == 1001 and cv.path_count(15, 11) == 1001
    assert backtest.annual_sharpe(3.6, 0.079, 12) == pytest.approx((45.57, 157.87), abs=0.02)
    assert stationarity.mackinnon_p(-2.9412, 2) == pytest.approx(0.12485, abs=1e-4)
    assert stationarity.mackinnon_p(-2.86) == pytest.approx(0.05, abs=1e-3)
    assert len(models.grid_nodes(range(5), range(5))) == 25
    m, v, _, k = backtest.mixture_moments([(1.0, 0.1, 0.2)])
    assert (m, v, k) == pytest.approx((0.1, 0.04, 3.0))


def test_paths_use_every_group_once():
    for groups, tests in ((6, 2), (7, 3)):
        paths = cv.backtest_paths(groups, tests)
        assert {p for p, _, _ in paths} == set(range(cv.path_count(groups, tests)))
        assert all(sorted(g for q, g, _ in paths if q == p) == list(range(groups)) for p, _, _ in paths)


def test_purged_train_never_overlaps(spark):
    s = spark.range(60).select(F.lit("S").alias("symbol"), F.col("id").alias("row_id"), F.timestamp_seconds(F.col("id") * 86400).alias("t0"), F.timestamp_seconds((F.col("id") + F.col("id") % 7) * 86400).alias("t1"))
    splits = cv.purged_k_fold(s, 4, 0.05).join(s, "row_id").collect()
    for fold in range(4):
        test = [r for r in splits if r["fold"] == fold and r["role"] == "test"]
        for r in splits:
            if r["fold"] == fold and r["role"] == "train":
                assert all(r["t1"] <= t["t0"] or r["t0"] >= t["t1"] for t in test)
    with pytest.raises(ValueError):
        cv.score(s, "f1")


def test_sizes(spark):
    r = spark.range(1).select(
        sizing.sigmoid_width(F.lit(10.0), F.lit(0.95)).alias("w"),
        sizing.sigmoid_target(sizing.sigmoid_width(F.lit(10.0), F.lit(0.95)), F.lit(115.0), F.lit(100.0), 100).alias("t"),
        sizing.discretise(F.lit(0.025), 0.01).alias("d"),
        sizing.discretise(F.lit(3.0), 0.1).alias("clip"),
        sizing.power_limit(F.lit(3), F.lit(3), F.lit(115.0), F.lit(10.0), 2.0, 100).alias("same"),
        sizing.power_width(F.lit(10.0), F.lit(0.0), 2.0).alias("inf"),
        sizing.size_from_probability(F.lit(1.0)).alias("one"),
    ).first()
    assert r["w"] == pytest.approx(10.8033, abs=1e-4) and r["t"] == 97 and r["d"] == 0.02 and r["clip"] == 1.0
    assert r["same"] == 115.0 and r["inf"] == math.inf and r["one"] is None
    with pytest.raises(ValueError):
        sizing.power_size(F.lit(1.0), F.lit(1.0), 0)


def test_break_tests_like_the_plain_formulas(spark):
    x = np.random.default_rng(3).normal(size=300).cumsum() + 100
    df = series(spark, x)
    design = breaks.ar1_design(df)
    got = {r["seq"]: r["error"] for r in breaks.recursive_cusum(design, 50).collect()}
    r = np.diff(np.log(x))
    ys, xs = r[1:], r[:-1]
    for k in (50, 120, 250):
        a = np.stack([xs[:k], np.ones(k)], 1)
        b, sse, *_ = np.linalg.lstsq(a, ys[:k], rcond=None)
        new = np.array([xs[k], 1.0])
        want = (ys[k] - new @ b) / math.sqrt(sse[0] / (k - 2) * (1 + new @ np.linalg.inv(a.T @ a) @ new))
        assert got[k + 2] == pytest.approx(want, rel=1e-6)
    csw = {r["seq"]: r["csw"] for r in breaks.csw_statistic(df, 60, 10, block=37).collect()}
    assert set(csw) == set(range(60, 300))
    for t in (60, 155, 299):
        window, best = x[t - 60 : t], -math.inf
        for n in range(50):
            best = max(best, (window[-1] - window[n]) / (np.std(np.diff(window[n:]), ddof=1) * math.sqrt(60 - n)))
        assert csw[t] == pytest.approx(best, rel=1e-9)


def test_adf_and_ou(spark):
    rng = np.random.default_rng(5)
    noise, walk = rng.normal(size=500), rng.normal(size=500).cumsum()
    assert stationarity.adf_test(noise)["p_value"] < 0.01 < 0.05 < stationarity.adf_test(walk)["p_value"]
    x = [0.0]
    for _ in range(4000):
        x.append(0.9 * x[-1] + 0.5 + rng.normal() * 0.2)
    r = simulation.estimate_ou(series(spark, x)).first()
    assert r["phi"] == pytest.approx(0.9, abs=0.02) and r["mean"] == pytest.approx(5, abs=0.15) and r["sigma"] == pytest.approx(0.2, abs=0.01)
    assert simulation.estimate_ou(series(spark, x[:10])).first()["phi"] is None


def test_simulated_rules_like_a_loop(spark):
    got = {(r["pt"], r["sl"]): r for r in simulation.simulate_rules(spark, 0.0, 5.0, 1.0, [0.5, 2.0], [1.0, 3.0], paths=300, longest=20, seed=4, block=100).collect()}
    phi = 2 ** (-1 / 5)
    for pt, sl in got:
        out = []
        for block in range(3):
            rng = np.random.default_rng([4, block])
            steps = [rng.standard_normal(100) for _ in range(21)]
            for i in range(100):
                p = 0.0
                for hp, e in enumerate(steps):
                    p = phi * p + e[i]
                    if p > pt or p < -sl or hp >= 20:
                        break
                out.append(p)
        assert got[pt, sl]["mean"] == pytest.approx(np.mean(out)) and got[pt, sl]["deviation"] == pytest.approx(np.std(out))


def test_sequential_bootstrap_prefers_unique_events(spark):
    rows = [("A", i, i + 1) for i in range(8)] + [("A", 100, 101)]
    e = spark.createDataFrame(rows, "symbol string, a long, z long").select("symbol", F.timestamp_seconds("a").alias("t0"), F.timestamp_seconds("z").alias("t1"))
    drawn = weights.sequential_bootstrap(e, 40, seed=1)
    assert drawn.count() == 40 and drawn.select("t0").distinct().count() >= 7


def test_entropy_bounds_and_phrases(spark):
    assert entropy.phrase_count("0010110") == 3 and entropy.phrase_count("") == 0 and entropy.phrase_count("00") == 1
    df = series(spark, [1, 1, 1, 1]).withColumn("code", F.lit(1))
    assert entropy.plug_in_entropy(df).first()["entropy"] == 0.0
    df = df.withColumn("code", F.col("seq") % 4)
    assert entropy.plug_in_entropy(df).first()["entropy"] == pytest.approx(entropy.max_entropy(4))


def test_rare_labels(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)] * 60 + [(-1,)] * 60, "bin int")
    assert {r["bin"] for r in labels.drop_rare_labels(df).collect()} == {1, -1}
    two = spark.createDataFrame([(0,)] * 1 + [(1,)] * 99, "bin int")
    assert labels.drop_rare_labels(two).count() == 100


def test_flat_series_give_nulls_not_errors(spark):
    flat = series(spark, [5.0] * 30)
    assert backtest.psr(flat.withColumn("ret", F.lit(0.0))).first()["sr"] is None
    assert backtest.sharpe(flat.withColumn("ret", F.lit(0.0))).first()["sharpe"] == 0.0
    assert backtest.sharpe(flat.withColumn("ret", F.lit(0.1))).first()["sharpe"] == math.inf
    assert weights.ar1(flat, "close").first()["slope_t"] is None
    assert bars.return_statistics(flat).first()["autocorr"] is None
    assert stationarity.adf(flat).first()["stat"] is None


def test_csv_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,timestamp,side,volume,price\n1,1000,buy,2,10.5\n2,2000,Buy,3,10.0\n3,oops,sell,1,1\n")
    (tmp_path / "in" / "b.csv").write_text("timestamp,side,volume,price\n1500,sell,1.5,11\n")
    got = trades.read_trade_files(spark, f"file://{tmp_path}/in/*.csv", symbol="X").filter("ts IS NOT NULL").orderBy("ts").collect()
    assert [(r["price"], r["quantity"], r["sign"]) for r in got] == [(10.5, 2.0, 1), (11.0, 1.5, -1), (10.0, 3.0, -1)]
    (tmp_path / "bars.csv").write_text(",timestamp,open,high,low,close,VWAP,volume\n0,2024-01-01 00:00:00,1,2,0.5,1.5,1.2,10\n")
    r = trades.read_bars(spark, f"file://{tmp_path}/bars.csv", "X").first()
    assert (r["close"], r["vwap"], r["seq"]) == (1.5, 1.2, 1)
    trades.write_csv(trades.read_bars(spark, f"file://{tmp_path}/bars.csv", "X"), f"file://{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").count() == 1


def test_partitioned_table_prunes(spark, tmp_path):
    df = series(spark, range(3000), name="price").withColumn("quantity", F.lit(1.0))
    trades.write_table(df.unionByName(df.withColumn("symbol", F.lit("B"))), f"file://{tmp_path}/t")
    got = trades.read_table(spark, f"file://{tmp_path}/t", ["B"], "1970-01-02 00:00:00", "1970-01-02 12:00:00")
    assert got.count() == 720
    assert "PartitionFilters: [isnotnull(symbol" in got._jdf.queryExecution().executedPlan().toString() or "symbol" in got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


def test_generators_are_reproducible(spark):
    a, b = (synthetic.classification(spark, 200, seed=3).orderBy("row_id").collect() for _ in range(2))
    assert a == b and sum(r["bin"] for r in a) > 50 and all(r["t0"].weekday() < 5 for r in a)
    assert len({r["t0"] for r in a}) == 200
    z = [r["z"] for r in spark.range(4000).select(synthetic.gaussian(1, "id").alias("z")).collect()]
    assert abs(np.mean(z)) < 0.05 and np.std(z) == pytest.approx(1, abs=0.05)


def test_kernel_features_estimate_the_kernel(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.5), (2, -1.0, 2.0)], "row_id long, a double, b double")
    out, names = models.kernel_features(df, ["a", "b"], 0.3, size=2000)
    rows = out.orderBy("row_id").collect()
    x = np.array([[r[n] for n in names] for r in rows])
    raw = np.array([[r["a"], r["b"]] for r in rows])
    z = (raw - raw.mean(0)) / raw.std(0)
    want = np.exp(-0.3 * ((z[:, None] - z[None]) ** 2).sum(2))
    assert np.abs(x @ x.T - want).max() < 0.1
