"""Queries: concurrency, uniqueness, bootstrap, regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import pct_change, q6, us
from ..operators import weights as W
from ..sources import fixtures as X
from ..sources.fixtures import sql_q6 as Q
from .labels import CLOSES, closes
from .registry import query

EV = "ev AS (SELECT symbol, ts AS t0, ts + INTERVAL 3 DAYS AS t1, seq FROM c WHERE seq % 4 = 0)"
CONC = "conc AS (SELECT c.symbol, c.ts, c.seq, c.rn, count(ev.t0) AS n FROM c LEFT JOIN ev ON ev.symbol = c.symbol AND c.ts BETWEEN ev.t0 AND ev.t1 GROUP BY ALL)"
SPAN = "span AS (SELECT symbol, min(t0) AS a, max(t1) AS z FROM ev GROUP BY symbol)"


# the queries named _all, and those without SQL, take every close as an event; the others the quarter that their SQL states
EV_ALL = EV.replace(" WHERE seq % 4 = 0", "")


def spans(c):
    return c.select("symbol", F.col("ts").alias("t0"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("t1"))


def events(spark, sf):
    return spans(closes(spark, sf).filter("seq % 4 = 0"))


def all_events(spark, sf):
    return spans(closes(spark, sf))


def _concurrent_sql(ev: str) -> str:
    return f"WITH {CLOSES}, {ev}, {CONC}, {SPAN} SELECT conc.symbol, seq, n FROM conc JOIN span USING (symbol) WHERE ts BETWEEN a AND z"


@query(_concurrent_sql(EV))
def concurrent_labels(spark, sf):
    return W.concurrent_labels(closes(spark, sf), events(spark, sf)).select("symbol", "seq", "n")


@query(_concurrent_sql(EV_ALL))
def concurrent_labels_all(spark, sf):
    return W.concurrent_labels(closes(spark, sf), all_events(spark, sf)).select("symbol", "seq", "n")


def _uniqueness_sql(ev: str) -> str:
    return f"WITH {CLOSES}, {ev}, {CONC} SELECT ev.symbol, ev.seq, {Q('avg(1.0::DOUBLE / conc.n)')} AS tw FROM ev JOIN conc ON conc.symbol = ev.symbol AND conc.ts BETWEEN ev.t0 AND ev.t1 GROUP BY ev.symbol, ev.seq"


@query(_uniqueness_sql(EV))
def average_uniqueness(spark, sf):
    c = closes(spark, sf)
    out = W.average_uniqueness(c, events(spark, sf)).join(c.select("symbol", F.col("ts").alias("t0"), "seq"), ["symbol", "t0"])
    return out.select("symbol", "seq", q6("tw").alias("tw"))


@query(_uniqueness_sql(EV_ALL))
def average_uniqueness_all(spark, sf):
    c = closes(spark, sf)
    out = W.average_uniqueness(c, spans(c).distinct()).join(c.select("symbol", F.col("ts").alias("t0"), "seq"), ["symbol", "t0"])
    return out.select("symbol", "seq", q6("tw").alias("tw"))


EWM = """r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS ret FROM c),
ew AS (SELECT a.symbol, a.seq, a.rn, a.ts, sum(pow(1 - 2.0 / 21, a.rn - b.rn)) AS s0, sum(pow(1 - 2.0 / 21, 2 * (a.rn - b.rn))) AS s1, sum(pow(1 - 2.0 / 21, a.rn - b.rn) * b.ret) AS sx,
             sum(pow(1 - 2.0 / 21, a.rn - b.rn) * b.ret * b.ret) AS sxx, count(b.ret) AS k
      FROM r a LEFT JOIN r b ON a.symbol = b.symbol AND b.rn <= a.rn AND b.ret IS NOT NULL GROUP BY ALL),
sd AS (SELECT symbol, seq, ts, CASE WHEN k > 1 THEN sqrt(greatest(0, (sxx / s0 - pow(sx / s0, 2))) * s0 * s0 / (s0 * s0 - s1)) END AS sd FROM ew)"""


@query(f"WITH {CLOSES}, {EWM} SELECT symbol, seq, {Q('sd')} AS ewm_std FROM sd")
def ewm_volatility(spark, sf):
    return W.ewm_std(closes(spark, sf).withColumn("r", pct_change("close")), "r", 20.0).select("symbol", "seq", q6("ewm_std").alias("ewm_std"))


def _volatility_sql(ev: str) -> str:
    return f"WITH {CLOSES}, {ev}, {CONC}, {SPAN}, {EWM} SELECT conc.symbol, {X.sql_us('conc.ts')} AS ts_us, n, {Q('sd')} AS ewm_std FROM conc JOIN span USING (symbol) JOIN sd USING (symbol, seq) WHERE conc.ts BETWEEN a AND z AND sd IS NOT NULL"


@query(_volatility_sql(EV))
def concurrency_volatility(spark, sf):
    return W.concurrency_volatility(closes(spark, sf), events(spark, sf), 20.0).select("symbol", us("ts").alias("ts_us"), "n", q6("ewm_std").alias("ewm_std"))


@query(_volatility_sql(EV_ALL))
def concurrency_volatility_all(spark, sf):
    return W.concurrency_volatility(closes(spark, sf), all_events(spark, sf), 20.0).select("symbol", us("ts").alias("ts_us"), "n", q6("ewm_std").alias("ewm_std"))


OLS_SQL = f"""m AS (SELECT symbol, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx FROM xy WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY symbol),
e AS (SELECT *, (syy - sxy * sxy / sxx) AS sse FROM m), s AS (SELECT *, sqrt(sse / (n - 2) / sxx) AS seb, sqrt(sse / (n - 2) * (1.0 / n + mx * mx / sxx)) AS sea FROM e)
SELECT symbol, n, {Q("b")} AS slope, {Q("a")} AS intercept, {Q("b / seb")} AS slope_t, {Q("a / sea")} AS intercept_t, {Q("1 - sse / syy")} AS r2 FROM s"""


def ols_columns(df):
    return df.select("symbol", "n", *(q6(c).alias(c) for c in ("slope", "intercept", "slope_t", "intercept_t", "r2")))


@query(f"WITH {CLOSES}, xy AS (SELECT symbol, close AS y, lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS x FROM c), {OLS_SQL}")
def ar1_regression(spark, sf):
    return ols_columns(W.ar1(closes(spark, sf), "close"))


@query(f"WITH {X.SQL_SAMPLES}, c AS (SELECT bin, count(*) AS n FROM samples GROUP BY bin) SELECT row_id, bin, {Q('(SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n)')} AS class_weight FROM samples JOIN c USING (bin)")
def class_weights(spark, sf):
    return W.class_weights(X.samples(spark, sf, 1)).select("row_id", "bin", q6("class_weight").alias("class_weight"))


@query(f"WITH {X.SQL_SAMPLES} SELECT bin, count(*) AS n FROM samples GROUP BY bin")
def label_distribution(spark, sf):
    return W.label_counts(X.samples(spark, sf, 1))


@query()
def uniqueness_bootstrap(spark, sf):
    c = closes(spark, sf)
    tw = W.average_uniqueness(c, all_events(spark, sf))
    return W.gather(W.uniqueness_bootstrap(tw, 20, seed=3), tw).select("symbol", "draw", us("t0").alias("t0_us"), q6("tw").alias("tw"))


@query()
def sequential_bootstrap(spark, sf):
    return W.sequential_bootstrap(all_events(spark, sf), 20, seed=3).select("symbol", "draw", us("t0").alias("t0_us"))

