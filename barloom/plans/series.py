"""Queries: fractional differencing, stationarity, structural breaks, entropy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import pct_change, q6, us
from ..operators import breaks as R
from ..operators import entropy as N
from ..operators import fracdiff as D
from ..operators import stationarity as S
from ..sources import fixtures as X
from ..sources import synthetic
from ..sources.fixtures import sql_q6 as Q
from .labels import LONG, closes
from .registry import query

SERIES = X.SQL_SERIES + ", c AS (SELECT symbol, ts, seq, close / 1e7 AS close, row_number() OVER (ORDER BY ts) AS rn FROM series)"


def daily(spark, sf):
    return X.daily_series(spark, sf).withColumn("close", F.col("close") / 1e7)


def _ffd_sql(d: float, least: float, source: str, part: str = "PARTITION BY symbol ") -> str:
    w = D.ffd_weights(d, least)[::-1]
    terms = " + ".join(f"{float(x)!r}::DOUBLE * lag(close, {k}) OVER o" for k, x in enumerate(w))
    return f"WITH {source} SELECT symbol, seq, {Q(f'CASE WHEN rn >= {len(w)} THEN {terms} END')} AS ffd FROM c WINDOW o AS ({part}ORDER BY rn)"


@query(f"SELECT unnest(range(0, {len(D.ffd_weights(0.5, 1e-3))}))::BIGINT AS k, floor(unnest({[float(x) for x in D.ffd_weights(0.5, 1e-3)][::-1]}::DOUBLE[]) * 1e6 + 0.5) / 1e6 AS weight")
def ffd_weight_table(spark, sf):
    w = D.ffd_weights(0.5, 1e-3)[::-1]
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(w)], "k long, weight double").select("k", q6("weight").alias("weight"))


@query(_ffd_sql(0.4, 1e-2, LONG))
def ffd_transform(spark, sf):
    return D.ffd(closes(spark, sf, "event_type"), "close", 0.4, 1e-2).select("symbol", "seq", q6("ffd").alias("ffd"))


@query(_ffd_sql(0.6, 1e-2, LONG))
def ffd_transform_native(spark, sf):
    return D.ffd_native(closes(spark, sf, "event_type"), "close", 0.6, 1e-2).select("symbol", "seq", q6("ffd").alias("ffd"))


@query(_ffd_sql(0.95, 1e-3, SERIES))
def ffd_daily(spark, sf):
    return D.ffd(daily(spark, sf), "close", 0.95, 1e-3).select("symbol", "seq", q6("ffd").alias("ffd"))


@query(f"SELECT f.symbol, {Q('corr(ffd, close)')} AS corr FROM ({_ffd_sql(0.95, 1e-3, SERIES)}) f JOIN (WITH {SERIES} SELECT * FROM c) c USING (symbol, seq) WHERE ffd IS NOT NULL GROUP BY f.symbol")
def ffd_correlation(spark, sf):
    return D.correlation(D.ffd(daily(spark, sf), "close", 0.95, 1e-3).withColumn("ffd", q6("ffd")), "ffd", "close").select("symbol", q6("corr").alias("corr"))


@query(
    f"""WITH {LONG}, r AS (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS x FROM c), s AS (SELECT symbol, avg(x) AS m FROM r GROUP BY symbol),
    k AS (SELECT r.symbol, count(x) AS n, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4 FROM r JOIN s USING (symbol) WHERE x IS NOT NULL GROUP BY r.symbol)
    SELECT symbol, n, floor(n / 6.0 * (m3 * m3 / pow(m2, 3) + pow(m4 / (m2 * m2) - 3, 2) / 4) * 10 + 0.5) / 10 AS stat FROM k"""
)
def jarque_bera(spark, sf):
    out = S.jarque_bera(closes(spark, sf, "event_type").withColumn("r", pct_change("close")), "r")
    return out.select("symbol", "n", (F.floor(F.col("stat") * 10 + 0.5).cast("double") / 10).alias("stat"))


@query(
    f"""WITH {LONG}, d AS (SELECT symbol, close - lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS y, lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS x FROM c),
    m AS (SELECT symbol, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM d WHERE x IS NOT NULL GROUP BY symbol)
    SELECT symbol, n, {Q("b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx)")} AS stat FROM m"""
)
def dickey_fuller(spark, sf):
    return S.adf(closes(spark, sf, "event_type"), lags=0, choose=False).select("symbol", "n", q6("stat").alias("stat"))


@query()
def augmented_dickey_fuller(spark, sf):
    return S.adf(daily(spark, sf)).select("symbol", "n", "lags", q6("stat").alias("stat"), q6("p_value").alias("p_value"))


@query()
def engle_granger(spark, sf):
    both = D.ffd(daily(spark, sf), "close", 0.95, 1e-3).filter("ffd IS NOT NULL")
    return S.cointegration(both, "close", "ffd").select("symbol", "n", "lags", q6("stat").alias("stat"), q6("p_value").alias("p_value"))


@query()
def order_scan(spark, sf):
    out = S.scan_orders(spark, daily(spark, sf))
    return out.select("symbol", "d", "n", *(q6(c).alias(c) for c in ("stat", "p_value", "corr")))


@query()
def least_stationary_order(spark, sf):
    walk = synthetic.test_series(spark, 500).withColumnRenamed("value", "close").withColumn("ts", F.timestamp_seconds("seq"))
    return S.least_order(S.scan_orders(spark, walk))


@query()
def sine_fit_sweep(spark, sf):
    return S.best_order(S.sine_sweep(spark, synthetic.test_series(spark, 500).filter("symbol IN ('sine', 'shifted')"))).select("symbol", "d", q6("r2").alias("r2"))


@query("SELECT 'sine' AS symbol, i::BIGINT AS seq, floor(sin(2 * 3.141592653589793 * i / 50) * 1e6 + 0.5) / 1e6 AS value FROM range(500) t(i)")
def sine_series(spark, sf):
    return synthetic.test_series(spark, 500).filter("symbol = 'sine'").select("symbol", "seq", q6("value").alias("value"))


# structural breaks

DESIGN = """r AS (SELECT symbol, ts, seq, rn, ln(close / lag(close) OVER (ORDER BY rn)) AS y FROM c), xy0 AS (SELECT *, lag(y) OVER (ORDER BY rn) AS x FROM r),
xy AS (SELECT *, row_number() OVER (ORDER BY rn) AS i FROM xy0 WHERE x IS NOT NULL AND y IS NOT NULL)"""


@query(f"WITH {SERIES}, {DESIGN} SELECT symbol, seq, {Q('y')} AS y, {Q('x')} AS x FROM xy")
def ar1_design(spark, sf):
    return R.ar1_design(daily(spark, sf)).select("symbol", "seq", q6("y").alias("y"), q6("x").alias("x"))


@query(
    f"""WITH {SERIES}, {DESIGN}, m AS (SELECT avg(y) AS my, avg(x) AS mx FROM xy), z AS (SELECT symbol, seq, i, y - my AS y, x - mx AS x FROM xy, m),
    p AS (SELECT *, i - 1 AS n, avg(x) OVER o AS ax, avg(y) OVER o AS ay, sum(x) OVER o AS sx, sum(y) OVER o AS sy, sum(x * x) OVER o AS sxx, sum(x * y) OVER o AS sxy, sum(y * y) OVER o AS syy
          FROM z WINDOW o AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    b AS (SELECT *, sxx - sx * ax AS cxx, sxy - sx * ay AS cxy, syy - sy * ay AS cyy FROM p WHERE n >= 1000),
    e AS (SELECT *, (y - ay - cxy / cxx * (x - ax)) / sqrt((cyy - cxy * cxy / cxx) / (n - 2) * (1 + 1.0 / n + (x - ax) * (x - ax) / cxx)) AS err FROM b)
    SELECT symbol, seq, {Q("err")} AS error, {Q("sum(err) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) / stddev_samp(err) OVER ()")} AS cusum FROM e"""
)
def recursive_cusum(spark, sf):
    return R.recursive_cusum(R.ar1_design(daily(spark, sf)), 1000).select("symbol", "seq", q6("error").alias("error"), q6("cusum").alias("cusum"))


CSW_W, CSW_LEAST = 200, 20
CSW = f"""WITH {SERIES}, d AS (SELECT *, close - lag(close) OVER (ORDER BY rn) AS d FROM c),
s AS (SELECT rn, symbol, seq, close, coalesce(sum(d) OVER o, 0) AS s1, coalesce(sum(d * d) OVER o, 0) AS s2 FROM d WINDOW o AS (ORDER BY rn ROWS UNBOUNDED PRECEDING)),
pairs AS (SELECT t.symbol, t.seq, l.rn - n.rn AS m, l.close - n.close AS dy, l.s1 - n.s1 AS a, l.s2 - n.s2 AS b
          FROM s t JOIN s l ON l.rn = t.rn - 1 JOIN s n ON n.rn BETWEEN t.rn - {CSW_W} AND t.rn - {CSW_LEAST} - 1 WHERE t.rn > {CSW_W})
SELECT symbol, seq, {Q("max(dy / sqrt((b - a * a / m) / (m - 1) * (m + 1)))")} AS csw FROM pairs GROUP BY symbol, seq"""


def csw(spark, sf):
    return R.csw_statistic(daily(spark, sf), CSW_W, CSW_LEAST, block=500)


def csw_full(spark, sf):
    return R.csw_statistic(daily(spark, sf), block=500)


@query(CSW)
def csw_test(spark, sf):
    return csw(spark, sf).select("symbol", "seq", q6("csw").alias("csw"))


@query(f"SELECT symbol, {Q('quantile_cont(csw, 0.99)')} AS critical FROM ({CSW}) GROUP BY symbol")
def csw_critical_value(spark, sf):
    return R.critical_value(csw(spark, sf).withColumn("csw", q6("csw")), "csw").select("symbol", q6("critical").alias("critical"))


# the two above keep the window of their SQL; these test every departure of the last 2,000 rows, too many pairs for it
@query()
def csw_test_2000(spark, sf):
    return csw_full(spark, sf).select("symbol", "seq", q6("csw").alias("csw"))


@query()
def csw_critical_value_2000(spark, sf):
    return R.critical_value(csw_full(spark, sf).withColumn("csw", q6("csw")), "csw").select("symbol", q6("critical").alias("critical"))


SDFC = f"""{SERIES}, d AS (SELECT symbol, seq, ts, rn, close - lag(close) OVER (ORDER BY rn) AS y, lag(close) OVER (ORDER BY rn) AS x FROM c),
z AS (SELECT *, row_number() OVER (ORDER BY rn) - 1 AS i, count(*) OVER () AS n, sum(y * y) OVER () AS syy, sum(x * x) OVER o AS sxx, sum(x * y) OVER o AS sxy FROM d WHERE x IS NOT NULL WINDOW o AS (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT symbol, seq, ts, sxy / sxx AS delta, sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (n - 1) / sxx) AS sdfc FROM z WHERE i >= floor(n * 0.15) AND i < ceil(n * (1 - 0.15::DOUBLE)))"""


@query(f"WITH {SDFC} SELECT symbol, seq, {Q('delta')} AS delta, {Q('sdfc')} AS sdfc FROM t")
def chow_dickey_fuller(spark, sf):
    return R.chow_dickey_fuller(daily(spark, sf)).select("symbol", "seq", q6("delta").alias("delta"), q6("sdfc").alias("sdfc"))


@query(f"WITH {SDFC} SELECT symbol, {Q('max(sdfc)')} AS sup, {X.sql_us('arg_max(ts, sdfc)')} AS at_us FROM t GROUP BY symbol")
def supremum_break(spark, sf):
    return R.supremum(R.chow_dickey_fuller(daily(spark, sf)), "sdfc").select("symbol", q6("sup").alias("sup"), us("at").alias("at_us"))


@query()
def expanding_adf(spark, sf):
    return R.expanding_adf(daily(spark, sf), first=1000, ends=160).select("symbol", "seq", q6("adf").alias("adf"))


@query()
def supremum_adf(spark, sf):
    return R.supremum_adf(daily(spark, sf), first=200, shortest=200, ends=160).select("symbol", "seq", q6("sadf").alias("sadf"))


@query()
def quantile_adf(spark, sf):
    out = R.quantile_adf(daily(spark, sf), first=400, shortest=200, ends=160)
    return out.select("symbol", "seq", *(q6(c).alias(c) for c in ("qadf", "cadf", "cadf_std")))


@query()
def martingale_tests(spark, sf):
    parts = [R.martingale_test(daily(spark, sf), kind=k, penalty=0.5, first=400, step=1, start_step=1, ends=160).withColumn("kind", F.lit(k)) for k in ("poly1", "poly2", "exp", "power")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("kind", "symbol", "seq", q6("smt").alias("smt"))


@query(f"WITH {SDFC}, q AS (SELECT symbol, quantile_cont(sdfc, 0.95) AS cut FROM t GROUP BY symbol) SELECT symbol, {Q('cut')} AS cut, {Q('avg(sdfc) FILTER (sdfc > cut)')} AS tail_mean, {Q('stddev_samp(sdfc) FILTER (sdfc > cut)')} AS tail_std FROM t JOIN q USING (symbol) GROUP BY symbol, cut")
def tail_of_scores(spark, sf):
    return R.tail_of_scores(R.chow_dickey_fuller(daily(spark, sf)), "sdfc").select("symbol", *(q6(c).alias(c) for c in ("cut", "tail_mean", "tail_std")))


# entropy

RET = LONG + ", r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS ret FROM c)"
BINARY = f"{RET}, e AS (SELECT *, (ret > 0)::INTEGER AS code FROM r WHERE ret IS NOT NULL)"
ENTROPY = f"k AS (SELECT symbol, code, count(*) AS c FROM e GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY symbol) AS p FROM k) SELECT symbol, {Q('CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) ELSE 0 END')} AS entropy, sum(c)::BIGINT AS n FROM p GROUP BY symbol"


def rets(spark, sf, symbol="event_type"):
    return N.returns(closes(spark, sf, symbol))


@query(f"WITH {BINARY} SELECT symbol, code, count(*) AS n FROM e GROUP BY symbol, code")
def binary_code_counts(spark, sf):
    return N.value_counts(N.encode_binary(rets(spark, sf)))


@query(f"WITH {BINARY}, {ENTROPY}")
def binary_entropy(spark, sf):
    return N.plug_in_entropy(N.encode_binary(rets(spark, sf))).select("symbol", q6("entropy").alias("entropy"), "n")


DECILES = f"{RET}, q AS (SELECT symbol, list_sort(list_distinct(quantile_cont(ret, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS q FROM r GROUP BY symbol), e AS (SELECT r.symbol, seq, len(list_filter(q[2:len(q) - 1], lambda x: x < ret))::INTEGER AS code FROM r JOIN q USING (symbol) WHERE ret IS NOT NULL)"


@query(f"WITH {DECILES} SELECT symbol, code, count(*) AS n FROM e GROUP BY ALL")
def quantile_code_counts(spark, sf):
    return N.value_counts(N.encode_quantiles(rets(spark, sf)))


@query(f"WITH {DECILES}, {ENTROPY}")
def quantile_entropy(spark, sf):
    return N.plug_in_entropy(N.encode_quantiles(rets(spark, sf))).select("symbol", q6("entropy").alias("entropy"), "n")


SIGMA = f"{RET}, s AS (SELECT symbol, stddev_samp(ret) AS s FROM r GROUP BY symbol), e AS (SELECT r.symbol, seq, ((ret >= -2 * s)::INTEGER + (ret >= -s)::INTEGER + (ret >= 0)::INTEGER + (ret >= s)::INTEGER + (ret >= 2 * s)::INTEGER) AS code FROM r JOIN s USING (symbol) WHERE ret IS NOT NULL)"


@query(f"WITH {SIGMA} SELECT symbol, seq, code FROM e")
def sigma_codes(spark, sf):
    return N.encode_sigma(rets(spark, sf)).select("symbol", "seq", "code")


@query(f"WITH {RET}, m AS (SELECT symbol, seq, ret * lag(ret) OVER (PARTITION BY symbol ORDER BY rn) AS m FROM r WHERE ret IS NOT NULL) SELECT symbol, seq, (m >= 0)::INTEGER AS code FROM m WHERE m IS NOT NULL")
def momentum_codes(spark, sf):
    return N.encode_momentum(rets(spark, sf)).select("symbol", "seq", "code")


SUBSETS = f"{BINARY}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) - 1 AS k, least(count(*) OVER (PARTITION BY symbol) // 100, 100) AS n FROM e), t AS (SELECT symbol, seq, code, (n - 1 - k // 100)::INTEGER AS subset, (99 - k % 100)::INTEGER AS pos FROM b WHERE k < n * 100)"


@query(f"WITH {SUBSETS} SELECT symbol, seq, code, subset, pos FROM t")
def tail_subsets(spark, sf):
    return N.tail_subsets(N.encode_binary(rets(spark, sf))).select("symbol", "seq", "code", "subset", "pos")


@query(f"WITH {SUBSETS}, e2 AS (SELECT symbol, subset, code, count(*) / 100.0::DOUBLE AS p FROM t GROUP BY ALL) SELECT symbol, subset, {Q('CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) ELSE 0 END')} AS entropy FROM e2 GROUP BY symbol, subset")
def subset_entropy(spark, sf):
    subsets = N.tail_subsets(N.encode_binary(rets(spark, sf)))
    return N.plug_in_entropy(subsets, keys=("symbol", "subset")).select("symbol", "subset", q6("entropy").alias("entropy"))


PHRASES = f"""WITH RECURSIVE {SUBSETS}, s AS (SELECT symbol, subset, string_agg(code::VARCHAR, '' ORDER BY pos) AS s FROM t GROUP BY ALL),
lz AS (
  SELECT symbol, subset, s, 1 AS p, 1 AS b, []::VARCHAR[] AS seen FROM s
  UNION ALL
  SELECT symbol, subset, s, p + 1, CASE WHEN list_contains(seen, s[b:p]) THEN b ELSE p + 1 END, CASE WHEN list_contains(seen, s[b:p]) THEN seen ELSE list_append(seen, s[b:p]) END
  FROM lz WHERE p <= len(s)
), done AS (SELECT symbol, subset, len(s)::BIGINT AS n, len(seen)::BIGINT AS phrases FROM lz WHERE p = len(s) + 1)
SELECT symbol, subset, n, phrases, {Q("phrases / n * log2(n)")} AS rate FROM done"""


def lz(spark, sf):
    return N.lempel_ziv(N.tail_subsets(N.encode_binary(rets(spark, sf))), keys=("symbol", "subset"))


@query(PHRASES)
def lempel_ziv(spark, sf):
    return lz(spark, sf).select("symbol", "subset", "n", "phrases", q6("rate").alias("rate"))


@query(
    f"""WITH e AS (WITH {SUBSETS}, k AS (SELECT symbol, subset, code, count(*) / 100.0::DOUBLE AS p FROM t GROUP BY ALL) SELECT symbol, subset, CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) ELSE 0 END AS entropy FROM k GROUP BY symbol, subset),
    z AS ({PHRASES}) SELECT symbol, {Q("corr(entropy, phrases / n * log2(n))")} AS corr FROM e JOIN z USING (symbol, subset) GROUP BY symbol"""
)
def entropy_correlation(spark, sf):
    plug_in = N.plug_in_entropy(N.tail_subsets(N.encode_binary(rets(spark, sf))), keys=("symbol", "subset"))
    both = plug_in.join(lz(spark, sf).drop("n"), ["symbol", "subset"])
    return D.correlation(both, "entropy", "rate").select("symbol", q6("corr").alias("corr"))

