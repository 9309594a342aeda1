"""Queries: bet sizing, microstructure, backtest statistics, simulated rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import diff, pct_change, q6, us, whole
from ..functions.normal import norm_cdf_sql as PHI
from ..operators import backtest as K
from ..operators import bars as B
from ..operators import micro as M
from ..operators import simulation as O
from ..operators import sizing as Z
from ..sources import fixtures as X
from ..sources.fixtures import sql_q6 as Q
from .bars import sql_threshold_bars
from .labels import CLOSES, LONG, closes
from .registry import query
from .series import SERIES, daily
from .weights import OLS_SQL, ols_columns

# sizing

PREDS = X.SQL_PREDICTIONS
SIZE = f"2 * {PHI('z')} - 1"


@query(f"WITH {PREDS}, z AS (SELECT row_id, p, (p - 0.5::DOUBLE) / sqrt(p * (1 - p)) AS z FROM preds WHERE p > 0 AND p < 1) SELECT row_id, {Q(SIZE)} AS size FROM z")
def size_from_probability(spark, sf):
    return X.predictions(spark, sf).select("row_id", q6(Z.size_from_probability(F.col("p"))).alias("size"))


@query(
    f"""WITH g AS (SELECT k::INTEGER AS classes, i / 100::DOUBLE AS p FROM range(2, 11) a(k), range(1, 100) b(i)), z AS (SELECT *, (p - 1.0::DOUBLE / classes) / sqrt(p * (1 - p)) AS z FROM g WHERE p > 1.0::DOUBLE / classes + 1e-6)
    SELECT classes, {Q("p")} AS p, {Q(SIZE)} AS size FROM z"""
)
def size_curves(spark, sf):
    return Z.size_curves(spark).select("classes", q6("p").alias("p"), q6("size").alias("size"))


AVERAGE = f"""WITH {X.SQL_INTERVALS}, p AS (SELECT DISTINCT t AS ts FROM (SELECT t0 AS t FROM intervals UNION ALL SELECT t1 FROM intervals)),
a AS (SELECT p.ts, count(i.seq) AS n, sum(i.signal) AS s, count(i.seq) FILTER (i.side > 0) AS l, count(i.seq) FILTER (i.side < 0) AS sh, sum(i.side) AS sd
      FROM p LEFT JOIN intervals i ON i.t0 <= p.ts AND p.ts < i.t1 GROUP BY p.ts)"""


@query(f"{AVERAGE} SELECT {X.sql_us('ts')} AS ts_us, n, {Q('coalesce(s / nullif(n, 0), 0)')} AS signal FROM a")
def average_active_signals(spark, sf):
    return Z.average_active(X.intervals(spark, sf)).select(us("ts").alias("ts_us"), "n", q6("signal").alias("signal"))


@query(f"{AVERAGE} SELECT {X.sql_us('ts')} AS ts_us, {Q('coalesce(sd / nullif(n, 0)::DOUBLE, 0)')} AS average, n AS total, l AS long, sh AS short FROM a")
def active_bet_counts(spark, sf):
    return Z.active_counts(X.intervals(spark, sf), "side").select(us("ts").alias("ts_us"), q6("average").alias("average"), "total", "long", "short")


@query(f"{AVERAGE} SELECT {X.sql_us('ts')} AS ts_us, {Q('l / (max(l) OVER ())::DOUBLE - sh / (max(sh) OVER ())::DOUBLE')} AS budget, l - sh AS net FROM a")
def budget_sizes(spark, sf):
    return Z.budget_size(Z.active_counts(X.intervals(spark, sf), "side")).select(us("ts").alias("ts_us"), q6("budget").alias("budget"), "net")


@query("WITH g AS (SELECT i AS k, (i - 1000) / 400.0::DOUBLE AS x FROM range(2001) t(i)) SELECT k, greatest(-1.0, least(1.0, floor(round_even(x / 0.25, 0) * 0.25 * 1e6 + 0.5) / 1e6)) AS size FROM g")
def discrete_sizes(spark, sf):
    x = (F.col("id") - 1000) / 400.0
    return spark.range(2001).select(F.col("id").alias("k"), q6(Z.discretise(x, 0.25)).alias("size"))


GET_SIGNAL = f"""WITH {X.SQL_INTERVALS}, b AS (SELECT *, (seq % 89 + 5) / 99.0::DOUBLE AS prob FROM intervals), z0 AS (SELECT *, (prob - 0.5::DOUBLE) / sqrt(prob * (1 - prob)) AS z FROM b),
v AS (SELECT t0, t1, side * ({SIZE}) AS v FROM z0), p AS (SELECT DISTINCT t AS ts FROM (SELECT t0 AS t FROM v UNION ALL SELECT t1 FROM v)),
a AS (SELECT p.ts, coalesce(avg(v.v), 0) AS s FROM p LEFT JOIN v ON v.t0 <= p.ts AND p.ts < v.t1 GROUP BY p.ts)
SELECT {X.sql_us("ts")} AS ts_us, {Q("greatest(-1, least(1, round_even(s / 0.1::DOUBLE, 0) * 0.1::DOUBLE))")} AS signal FROM a"""


@query(GET_SIGNAL)
def signal_pipeline(spark, sf):
    i = X.intervals(spark, sf).withColumn("prob", (F.col("seq") % 89 + 5) / 99).withColumn("pred", F.lit(1))
    return Z.get_signal(i).select(us("ts").alias("ts_us"), q6("signal").alias("signal"))


@query()
def mixture_sizes(spark, sf):
    counts = Z.budget_size(Z.active_counts(X.intervals(spark, sf), "side"))
    mixture = Z.fit_mixture(counts, "net")
    return counts.select(us("ts").alias("ts_us"), "net", q6(Z.mixture_size(F.col("net").cast("double"), mixture)).alias("size"))


MIX = [(0.4, -3.0, 2.0), (0.6, 4.0, 3.0)]
MIX_F = " + ".join(f"{w}::DOUBLE * {PHI(f'((x - {m}) / {s})')}" for w, m, s in MIX)
MIX_F0 = " + ".join(f"{w}::DOUBLE * {PHI(f'((0.0 - {m}) / {s})')}" for w, m, s in MIX)


@query(f"WITH g AS (SELECT i AS k, (i - 100) / 8.0::DOUBLE AS x FROM range(201) t(i)), f AS (SELECT k, x, {MIX_F} AS f, {MIX_F0} AS f0 FROM g) SELECT k, {Q('CASE WHEN x >= 0 THEN (f - f0) / (1 - f0) ELSE (f - f0) / f0 END')} AS size FROM f")
def mixture_size_curve(spark, sf):
    x = (F.col("id") - 100) / 8.0
    return spark.range(201).select(F.col("id").alias("k"), q6(Z.mixture_size(x, MIX)).alias("size"))


@query(
    f"""WITH {CLOSES}, f AS (SELECT symbol, seq, close, 115.0::DOUBLE AS forecast, 100.0::DOUBLE * (1 / pow(0.95::DOUBLE, 2) - 1) AS w FROM c), t AS (SELECT *, (forecast - close) / sqrt(w + pow(forecast - close, 2)) AS size FROM f)
    SELECT symbol, seq, {Q("size")} AS size, trunc(size * 100)::INTEGER AS target, {Q("forecast - 0.5::DOUBLE * sqrt(w / (1 - 0.25::DOUBLE))")} AS half_price FROM t"""
)
def sigmoid_sizes(spark, sf):
    f, w = F.lit(115.0), Z.sigmoid_width(F.lit(10.0), F.lit(0.95))
    out = closes(spark, sf).withColumn("_w", w)
    return out.select("symbol", "seq", q6(Z.sigmoid_size(F.col("_w"), f - F.col("close"))).alias("size"), Z.sigmoid_target(F.col("_w"), f, F.col("close"), 100).alias("target"), q6(Z.sigmoid_inverse(f, F.col("_w"), F.lit(0.5))).alias("half_price"))


@query(
    f"""WITH g AS (SELECT i::INTEGER AS position, j::INTEGER AS target FROM range(-90, 91, 15) a(i), range(-97, 98, 10) b(j)), w AS (SELECT 100.0::DOUBLE * (1 / pow(0.95::DOUBLE, 2) - 1) AS w),
    u AS (SELECT position, target, unnest(CASE WHEN target > position THEN range(position + 1, target + 1) WHEN target < position THEN range(target, position) ELSE [] END) AS j FROM g),
    m AS (SELECT position, target, avg(115.0::DOUBLE - (j / 100.0::DOUBLE) * sqrt(w / (1 - pow(j / 100.0::DOUBLE, 2)))) AS price FROM u, w GROUP BY ALL)
    SELECT position, target, {Q("price")} AS price FROM g LEFT JOIN m USING (position, target)"""
)
def sigmoid_limit_prices(spark, sf):
    g = spark.range(-90, 91, 15).select(F.col("id").cast("int").alias("position")).crossJoin(F.broadcast(spark.range(-97, 98, 10).select(F.col("id").cast("int").alias("target"))))
    price = Z.sigmoid_limit(F.col("target"), F.col("position"), F.lit(115.0), Z.sigmoid_width(F.lit(10.0), F.lit(0.95)), 100)
    return g.select("position", "target", q6(price).alias("price"))


@query(
    f"""WITH {CLOSES}, f AS (SELECT symbol, seq, 115.0::DOUBLE - close AS x, 10.0::DOUBLE / pow(0.95::DOUBLE, 0.5) AS k FROM c), t AS (SELECT *, sign(x) * least(1, pow(abs(x) / k, 2)) AS size FROM f)
    SELECT symbol, seq, {Q("size")} AS size, trunc(size * 100)::INTEGER AS target, {Q("115.0::DOUBLE - sign(size) * k * pow(abs(size), 0.5)")} AS price FROM t"""
)
def power_sizes(spark, sf):
    k = Z.power_width(F.lit(10.0), F.lit(0.95), 2.0)
    out = closes(spark, sf).withColumn("_s", Z.power_size(F.lit(115.0) - F.col("close"), k, 2.0))
    return out.select("symbol", "seq", q6("_s").alias("size"), Z.power_target(F.lit(115.0) - F.col("close"), k, 2.0, 100).alias("target"), q6(Z.power_inverse(F.lit(115.0), F.col("_s"), k, 2.0)).alias("price"))


@query(
    f"""WITH g AS (SELECT i::INTEGER AS position, j::INTEGER AS target FROM range(-90, 91, 15) a(i), range(-100, 101, 10) b(j)), w AS (SELECT 10.0::DOUBLE / pow(0.95::DOUBLE, 0.5) AS k),
    u AS (SELECT position, target, unnest(CASE WHEN target > position THEN range(position + 1, target + 1) WHEN target < position THEN range(target, position) ELSE [] END) AS j FROM g),
    m AS (SELECT position, target, avg(115.0::DOUBLE - sign(j) * k * pow(abs(j / 100.0::DOUBLE), 0.5)) AS price FROM u, w GROUP BY ALL)
    SELECT position, target, {Q("coalesce(price, 115.0)")} AS price FROM g LEFT JOIN m USING (position, target)"""
)
def power_limit_prices(spark, sf):
    g = spark.range(-90, 91, 15).select(F.col("id").cast("int").alias("position")).crossJoin(F.broadcast(spark.range(-100, 101, 10).select(F.col("id").cast("int").alias("target"))))
    return g.select("position", "target", q6(Z.power_limit(F.col("target"), F.col("position"), F.lit(115.0), Z.power_width(F.lit(10.0), F.lit(0.95), 2.0), 2.0, 100)).alias("price"))


# microstructure

TICKS = "b AS (SELECT *, CASE WHEN price > lag(price) OVER w THEN 1 WHEN price < lag(price) OVER w THEN -1 END AS m FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)), t AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 1) AS tick FROM b)"


@query(f"WITH {X.SQL_TRADES}, {TICKS} SELECT symbol, count(*) AS n, {Q('avg((tick = sign)::INTEGER)')} AS accuracy FROM t GROUP BY symbol")
def tick_rule_accuracy(spark, sf):
    return M.agreement(B.tick_rule(X.trades(spark, sf)), "tick_sign", "sign", ("symbol",)).select("symbol", "n", q6("accuracy").alias("accuracy"))


ROLL = f"""WITH {X.SQL_LONG_TRADES}, d AS (SELECT symbol, ts, seq, price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq) AS d FROM trades), l AS (SELECT symbol, d, lag(d) OVER (PARTITION BY symbol ORDER BY ts, seq) AS l FROM d WHERE d IS NOT NULL),
g AS (SELECT symbol, GAMMA AS g, var_samp(d) AS v FROM l GROUP BY symbol)
SELECT symbol, {Q("g")} AS gamma, {Q("CASE WHEN g < 0 THEN sqrt(-g) END")} AS half_spread, {Q("CASE WHEN g < 0 THEN v + 2 * g END")} AS variance FROM g"""


def _roll(out):
    return out.select("symbol", *(q6(c).alias(c) for c in ("gamma", "half_spread", "variance")))


@query(ROLL.replace("GAMMA", "covar_samp(d, l)"))
def roll_model(spark, sf):
    return _roll(M.roll_model(X.trades(spark, sf, "event_type")))


@query(ROLL.replace("GAMMA", "covar_samp(d, l) / (stddev_samp(CASE WHEN l IS NOT NULL THEN d END) * stddev_samp(l))"))
def roll_model_autocorr(spark, sf):
    return _roll(M.roll_model(X.trades(spark, sf, "event_type"), autocorr=True))


DOLLARS = 20000.005
BARS = (
    sql_threshold_bars("price * quantity", DOLLARS, X.SQL_TRADES)
    + """, bar AS (SELECT symbol, bar_id, min(ts) AS ts, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(price * quantity) / sum(quantity) AS vwap, sum(quantity) AS volume, sum(sign * quantity) AS ofi
  FROM ids GROUP BY symbol, bar_id HAVING bool_or(closes))"""
)


def micro_bars(spark, sf):
    t = X.trades(spark, sf)
    return B.micro_features(B.threshold_bar_ids(t, F.col("price") * F.col("quantity"), DOLLARS))


def _over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY bar_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


VOL_RATIO = f"""{BARS}, r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_id)) AS r, ln(high / low) / sqrt(4 * ln(2.0::DOUBLE)) AS pk FROM bar),
v AS (SELECT symbol, bar_id, CASE WHEN count(pk) {_over(5)} >= 5 THEN avg(pk) {_over(5)} END AS hl, CASE WHEN count(r) {_over(5)} >= 2 THEN stddev_samp(r) {_over(5)} END AS cc FROM r)"""


def vol_ratio(spark, sf):
    return M.volatility_ratio(micro_bars(spark, sf), 5)


@query(f"{VOL_RATIO} SELECT symbol, bar_id, {Q('hl')} AS hl_vol, {Q('cc')} AS c2c_vol, {Q('cc / (hl + 1e-12::DOUBLE)')} AS vol_ratio FROM v")
def volatility_ratio(spark, sf):
    return vol_ratio(spark, sf).select("symbol", "bar_id", *(q6(c).alias(c) for c in ("hl_vol", "c2c_vol", "vol_ratio")))


@query(f"{VOL_RATIO}, q AS (SELECT symbol, {Q('cc / (hl + 1e-12::DOUBLE)')} AS x FROM v) SELECT symbol, {Q('quantile_cont(x, 0.99)')} AS quantile FROM q GROUP BY symbol")
def volatility_ratio_quantile(spark, sf):
    return M.quantile(vol_ratio(spark, sf).withColumn("x", q6("vol_ratio")), "x", 0.99).select("symbol", q6("quantile").alias("quantile"))


def _regression(xy: str) -> str:
    return BARS + f", xy AS ({xy}), " + OLS_SQL.replace("WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY symbol", "WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY symbol HAVING count(*) > 3 AND regr_sxx(y, x) > 0")


@query(_regression("SELECT symbol, close - lag(close) OVER (PARTITION BY symbol ORDER BY bar_id) AS y, ofi AS x FROM bar"))
def kyle_lambda(spark, sf):
    return ols_columns(M.kyle_lambda(micro_bars(spark, sf)).filter("n > 3 AND slope IS NOT NULL"))


@query(_regression("SELECT symbol, abs(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_id))) AS y, vwap * volume / 1e4::DOUBLE AS x FROM bar"))
def amihud_lambda(spark, sf):
    bars_ = micro_bars(spark, sf).withColumn("volume", F.col("volume") / 1e4)
    return ols_columns(M.amihud_lambda(bars_).filter("n > 3 AND slope IS NOT NULL"))


@query(f"{BARS} SELECT symbol, bar_id, {Q(f'CASE WHEN count(*) {_over(5)} >= 5 THEN sum(abs(ofi)) {_over(5)} / sum(volume) {_over(5)} END')} AS vpin FROM bar")
def vpin(spark, sf):
    return M.vpin(micro_bars(spark, sf), 5).select("symbol", "bar_id", q6("vpin").alias("vpin"))


# backtest statistics

RETS = f"{LONG}, r AS (SELECT *, (close / lag(close) OVER (PARTITION BY symbol ORDER BY rn) - 1) / 1000::DOUBLE AS ret FROM c), x AS (SELECT * FROM r WHERE ret IS NOT NULL)"


def rets(spark, sf):
    return closes(spark, sf, "event_type").withColumn("ret", pct_change("close") / 1000).filter("ret IS NOT NULL")


def _hhi(x: str, f: str) -> str:
    return Q(f"(sum({x} * {x}) FILTER ({f}) / pow(sum({x}) FILTER ({f}), 2) - 1.0 / count(*) FILTER ({f})) / (1 - 1.0 / count(*) FILTER ({f}))")


@query(f"WITH {RETS} SELECT symbol, {_hhi('ret', 'ret >= 0')} AS hhi_positive, {_hhi('ret', 'ret < 0')} AS hhi_negative FROM x GROUP BY symbol")
def return_concentration(spark, sf):
    return K.concentration(rets(spark, sf)).select("symbol", q6("hhi_positive").alias("hhi_positive"), q6("hhi_negative").alias("hhi_negative"))


TIME_HHI = f"WITH {CLOSES}, d AS (SELECT symbol, ts::DATE AS day, count(*)::DOUBLE AS n FROM c GROUP BY ALL)"


@query(f"{TIME_HHI}, cal AS (SELECT symbol, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY symbol), a AS (SELECT symbol, coalesce(n, 0) AS n FROM cal LEFT JOIN d USING (symbol, day)) SELECT symbol, {_hhi('n', 'true')} AS hhi_time FROM a GROUP BY symbol")
def time_concentration(spark, sf):
    return K.time_concentration(closes(spark, sf)).select("symbol", q6("hhi_time").alias("hhi_time"))


@query(f"{TIME_HHI} SELECT symbol, {_hhi('n', 'true')} AS hhi_time FROM d GROUP BY symbol")
def active_day_concentration(spark, sf):
    return K.time_concentration(closes(spark, sf), with_empty_days=False).select("symbol", q6("hhi_time").alias("hhi_time"))


EQUITY = f"{RETS}, e AS (SELECT *, floor(exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY rn)) * 1e9::DOUBLE + 0.5) / 1e9::DOUBLE AS equity FROM x)"


def equity(spark, sf):
    return K.equity(rets(spark, sf)).withColumn("equity", whole(F.col("equity") * 1e9 + 0.5) / 1e9)


@query(f"WITH {EQUITY} SELECT symbol, seq, {Q('equity')} AS equity, {Q('1 - equity / max(equity) OVER (PARTITION BY symbol ORDER BY rn)')} AS drawdown FROM e")
def equity_drawdowns(spark, sf):
    return K.drawdowns(equity(spark, sf)).select("symbol", "seq", q6("equity").alias("equity"), q6("drawdown").alias("drawdown"))


HWM = f"{EQUITY}, h AS (SELECT symbol, ts, equity, max(equity) OVER (PARTITION BY symbol ORDER BY rn) AS hwm FROM e), m AS (SELECT symbol, hwm, min(equity) AS low, min(ts) AS start FROM h GROUP BY symbol, hwm HAVING hwm > min(equity))"


@query(f"WITH {HWM} SELECT symbol, {X.sql_us('start')} AS start_us, {Q('1 - low / hwm')} AS drawdown, {Q('(epoch_us(lead(start) OVER (PARTITION BY symbol ORDER BY start)) - epoch_us(start)) / 86400e6::DOUBLE')} AS days_under_water FROM m")
def high_water_drawdowns(spark, sf):
    return K.high_water_drawdowns(equity(spark, sf)).select("symbol", us("start").alias("start_us"), q6("drawdown").alias("drawdown"), q6("days_under_water").alias("days_under_water"))


@query(f"WITH {HWM} SELECT symbol, {X.sql_us('start')} AS start_us, {Q('hwm - low')} AS drawdown FROM m")
def high_water_drawdowns_dollars(spark, sf):
    return K.high_water_drawdowns(equity(spark, sf), dollars=True).select("symbol", us("start").alias("start_us"), q6("drawdown").alias("drawdown"))


RUNS = f"""{EQUITY}, d AS (SELECT symbol, rn, ts, 1 - equity / max(equity) OVER (PARTITION BY symbol ORDER BY rn) AS dd FROM e), f AS (SELECT *, (dd > 0 AND coalesce(lag(dd) OVER (PARTITION BY symbol ORDER BY rn), 0) <= 0)::INTEGER AS new FROM d),
g AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY rn)::BIGINT AS run FROM f), u AS (SELECT symbol, run, min(ts) AS start, count(*) AS length, max(dd) AS depth FROM g WHERE dd > 0 GROUP BY symbol, run)"""


@query(f"WITH {RUNS} SELECT symbol, run, {X.sql_us('start')} AS start_us, length, {Q('depth')} AS depth FROM u")
def under_water_runs(spark, sf):
    return K.under_water_runs(K.drawdowns(equity(spark, sf))).select("symbol", "run", us("start").alias("start_us"), "length", q6("depth").alias("depth"))


@query(f"WITH {RUNS} SELECT symbol, {Q('quantile_cont(length, 0.95)')} AS length_quantile FROM u GROUP BY symbol")
def under_water_quantile(spark, sf):
    return K.quantile_of(K.under_water_runs(K.drawdowns(equity(spark, sf))), "length").select("symbol", q6("length_quantile").alias("length_quantile"))


PERF = """SELECT symbol, count(*) AS n, count(*) / DAYS * 365 AS p, avg(ret) AS m, stddev_samp(ret) AS s, avg(ret - und) AS em, stddev_samp(ret - und) AS es, avg((ret > 0)::INTEGER) AS hit, avg(ret) FILTER (ret > 0) AS mh, avg(ret) FILTER (ret < 0) AS mm
FROM (SELECT *, ret * (CASE WHEN seq % 3 = 0 THEN 0.5 ELSE 1 END) - 0.0001 AS und FROM x) GROUP BY symbol"""
PERF_OUT = f"SELECT symbol, n, {Q('p')} AS periods, {Q('ln(1 + (pow(1 + m, p) - 1))')} AS annual_log_return, {Q('m / s * sqrt(p)')} AS sharpe, {Q('em / es * sqrt(p)')} AS information_ratio, {Q('hit')} AS hit_ratio, {Q('mh')} AS mean_hit, {Q('mm')} AS mean_miss FROM g"


def _performance(spark, sf, calendar):
    r = rets(spark, sf).withColumn("und", F.col("ret") * F.when(F.col("seq") % 3 == 0, 0.5).otherwise(1.0) - 0.0001)
    out = K.performance(r, underlying="und", calendar_days=calendar)
    return out.select("symbol", "n", q6("periods").alias("periods"), q6(F.ln(1 + F.col("annual_return"))).alias("annual_log_return"), *(q6(c).alias(c) for c in ("sharpe", "information_ratio", "hit_ratio", "mean_hit", "mean_miss")))


@query(f"WITH {RETS}, g AS ({PERF.replace('DAYS', '(datediff(chr(100) || chr(97) || chr(121), min(ts)::DATE, max(ts)::DATE) + 1)::DOUBLE')}) {PERF_OUT}".replace("chr(100) || chr(97) || chr(121)", "'day'"))
def performance_calendar_days(spark, sf):
    return _performance(spark, sf, True)


@query(f"WITH {RETS}, g AS ({PERF.replace('DAYS', 'count(DISTINCT ts::DATE)::DOUBLE')}) {PERF_OUT}")
def performance_active_days(spark, sf):
    return _performance(spark, sf, False)


@query(f"WITH {RETS} SELECT symbol, {Q('avg(ret) / stddev_samp(ret) * sqrt(252::DOUBLE)')} AS sharpe FROM x GROUP BY symbol")
def sharpe_ratio(spark, sf):
    return K.sharpe(rets(spark, sf)).select("symbol", q6("sharpe").alias("sharpe"))


MOMENTS = f"""{RETS}, a AS (SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS sd, count(*) AS n FROM x GROUP BY symbol),
mo AS (SELECT x.symbol, any_value(n) AS n, any_value(m / sd) AS sr, avg(pow(ret - m, 3)) / pow(avg(pow(ret - m, 2)), 1.5) AS sk, avg(pow(ret - m, 4)) / pow(avg(pow(ret - m, 2)), 2) AS ku FROM x JOIN a USING (symbol) GROUP BY x.symbol)"""


def _psr(benchmark: float) -> str:
    return PHI(f"((sr - {benchmark!r}::DOUBLE) * sqrt((n - 1)::DOUBLE) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr))")


def _psr_out(df, name="psr"):
    return df.select("symbol", "n", q6("sr").alias("sr"), q6("skew").alias("skew"), q6("kurtosis").alias("kurtosis"), q6(name).alias(name))


@query(f"WITH {MOMENTS} SELECT symbol, n, {Q('sr')} AS sr, {Q('sk')} AS skew, {Q('ku')} AS kurtosis, {Q(_psr(0.02))} AS psr FROM mo")
def probabilistic_sharpe(spark, sf):
    return _psr_out(K.psr(rets(spark, sf), benchmark=0.02))


@query(f"WITH {MOMENTS} SELECT symbol, n, {Q('sr')} AS sr, {Q('sk')} AS skew, {Q('ku')} AS kurtosis, {Q(_psr(0.5 / 252**0.5))} AS psr FROM mo")
def probabilistic_sharpe_annualised(spark, sf):
    return _psr_out(K.psr_annualised(rets(spark, sf), annual_benchmark=0.5))


@query(f"WITH {MOMENTS} SELECT symbol, n, {Q('sr')} AS sr, {Q('sk')} AS skew, {Q('ku')} AS kurtosis, {Q(_psr(K.expected_best_sharpe(0.0002, 20)))} AS dsr FROM mo")
def deflated_sharpe(spark, sf):
    return _psr_out(K.deflated_sharpe(rets(spark, sf), 20, 0.0002), "dsr")


@query(f"WITH {MOMENTS} SELECT symbol, n, {Q('sr')} AS sr, {Q('sk')} AS skew, {Q('ku')} AS kurtosis, {Q(PHI(f'((sr - {K.expected_best_sharpe(0.0002, 20)!r}::DOUBLE) / {0.0002**0.5!r}::DOUBLE)'))} AS dsr FROM mo")
def deflated_sharpe_compat(spark, sf):
    return _psr_out(K.deflated_sharpe(rets(spark, sf), 20, 0.0002, compat=True), "dsr")


@query(f"WITH {RETS}, s AS (SELECT *, ret * (CASE WHEN day(ts) % 2 = 0 THEN 1 ELSE -1 END) + seq % 7 * 0.0001::DOUBLE AS st FROM x) SELECT symbol, {Q('corr(st, ret)')} AS overall, {Q('corr(st, ret) FILTER (day(ts) % 2 = 0)')} AS even_days, {Q('corr(st, ret) FILTER (day(ts) % 2 = 1)')} AS odd_days FROM s GROUP BY symbol")
def strategy_correlation(spark, sf):
    s = rets(spark, sf).withColumn("st", F.col("ret") * F.when(F.dayofmonth("ts") % 2 == 0, 1).otherwise(-1) + F.col("seq") % 7 * 0.0001)
    return K.strategy_correlation(s, "st", "ret").select("symbol", *(q6(c).alias(c) for c in ("overall", "even_days", "odd_days")))


@query(
    f"""WITH g AS (SELECT i AS k, 0.505::DOUBLE + i * 0.005::DOUBLE AS p, 10 + i * 5 AS n FROM range(60) t(i)), s AS (SELECT *, (2 * p - 1) / (2 * sqrt(p * (1 - p))) * sqrt(n::DOUBLE) AS sr FROM g)
    SELECT k, {Q("sr")} AS sharpe, {Q("0.5::DOUBLE * (1 + sqrt(sr * sr / (sr * sr + n)))")} AS precision, {Q("sr * sr * 4 * p * (1 - p) / pow(2 * p - 1, 2)")} AS frequency,
           {Q("((0.02::DOUBLE + 0.01) * p - 0.01) / ((0.02::DOUBLE + 0.01) * sqrt(p * (1 - p))) * sqrt(n::DOUBLE)")} AS asymmetric FROM s"""
)
def strategy_risk(spark, sf):
    p, n = F.lit(0.505) + F.col("id") * 0.005, F.lit(10) + F.col("id") * 5
    g = spark.range(60).select(F.col("id").alias("k"), p.alias("p"), n.cast("double").alias("n"))
    g = g.withColumn("sr", (2 * F.col("p") - 1) / (2 * F.sqrt(F.col("p") * (1 - F.col("p")))) * F.sqrt("n"))
    sr, p, n = F.col("sr"), F.col("p"), F.col("n")
    return g.select("k", q6(K.symmetric_sharpe(p, n)).alias("sharpe"), q6(K.implied_precision(sr, n)).alias("precision"), q6(K.implied_frequency(sr, p)).alias("frequency"), q6(K.asymmetric_sharpe(p, n, 0.02, -0.01)).alias("asymmetric"))


CHARACTER = f"""WITH {CLOSES}, p AS (SELECT *, sin(seq / 7.0::DOUBLE) AS position, lag(close) OVER w AS before FROM c WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
v AS (SELECT *, coalesce(lag(position) OVER w, 0) AS held FROM p WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
b AS (SELECT symbol, min(ts) AS first, max(ts) AS last, avg(abs(position * close)) AS mean_value, max(abs(position * close)) / nullif(avg(abs(position * close)), 0) AS leverage, avg((position > 0)::INTEGER) AS longs,
      sum(abs(position - held) * close) AS traded, sum(held * (close - before)) AS pnl, sum(0.001::DOUBLE * (abs(position - held) * close)) AS cost FROM v GROUP BY symbol),
n AS (SELECT *, (sign(position) <> coalesce(lag(sign(position)) OVER w, 0))::INTEGER AS new FROM v WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
g AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY rn) AS bet FROM n),
s AS (SELECT symbol, bet, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6 AS days FROM g WHERE position <> 0 GROUP BY symbol, bet), h AS (SELECT symbol, count(*) AS n_bets, avg(days) AS days FROM s GROUP BY symbol),
y AS (SELECT *, (epoch_us(last) - epoch_us(first)) / (365.25::DOUBLE * 86400e6) AS years FROM b LEFT JOIN h USING (symbol))
SELECT symbol, {X.sql_us("first")} AS first_us, {X.sql_us("last")} AS last_us, coalesce(n_bets, 0)::BIGINT AS n_bets, {Q("mean_value")} AS mean_value, {Q("leverage")} AS leverage, {Q("longs")} AS ratio_of_longs, {Q("days")} AS holding_days,
       {Q("coalesce(n_bets, 0) / nullif(years, 0)")} AS bets_a_year, {Q("traded / nullif(mean_value, 0) / nullif(years, 0)")} AS annual_turnover, {Q("pnl")} AS pnl, {Q("pnl / nullif(cost, 0)")} AS return_on_execution_costs FROM y"""


@query(CHARACTER)
def strategy_characteristics(spark, sf):
    c = closes(spark, sf).withColumn("price", F.col("close")).withColumn("position", F.sin(F.col("seq") / 7.0).cast("double")).withColumn("ret", pct_change("close")).withColumn("cost", F.lit(0.001))
    out = K.characteristics(c)
    return out.select("symbol", us("first").alias("first_us"), us("last").alias("last_us"), "n_bets", *(q6(x).alias(x) for x in ("mean_value", "leverage", "ratio_of_longs", "holding_days", "bets_a_year", "annual_turnover", "pnl", "return_on_execution_costs")))


BETS = f"""WITH {CLOSES}, p AS (SELECT symbol, rn, ts, CASE WHEN seq % 5 = 0 THEN 0 WHEN seq % 11 < 6 THEN 1 ELSE -1 END AS s FROM c), n AS (SELECT *, (s <> coalesce(lag(s) OVER (PARTITION BY symbol ORDER BY rn), 0))::INTEGER AS new FROM p),
g AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY rn)::BIGINT AS bet FROM n)
SELECT symbol, bet, any_value(s)::INTEGER AS side, {X.sql_us("min(ts)")} AS t0_us, {X.sql_us("max(ts)")} AS t1_us, count(*) AS rows FROM g WHERE s <> 0 GROUP BY symbol, bet"""


@query(BETS)
def bet_spans(spark, sf):
    side = F.when(F.col("seq") % 5 == 0, 0).when(F.col("seq") % 11 < 6, 1).otherwise(-1)
    return K.bets(closes(spark, sf).withColumn("position", side)).select("symbol", "bet", "side", us("t0").alias("t0_us"), us("t1").alias("t1_us"), "rows")


@query(f"WITH {X.SQL_TRADES}, p AS (SELECT symbol, side, sum(price)::DOUBLE AS pnl FROM trades GROUP BY ALL) SELECT symbol, side, {Q('pnl')} AS pnl, {Q('pnl / sum(pnl) OVER (PARTITION BY symbol)')} AS share FROM p")
def attribution(spark, sf):
    return K.attribution(X.trades(spark, sf).withColumn("pnl", F.col("price")), "side").select("symbol", "side", q6("pnl").alias("pnl"), q6("share").alias("share"))


GRID = "g AS (SELECT i AS k, 0.52::DOUBLE + i * 0.01::DOUBLE AS p, 50.0::DOUBLE + i * 10 AS n, 0.02::DOUBLE AS w, -0.015::DOUBLE - i * 0.0005::DOUBLE AS l FROM range(30) t(i)), d AS (SELECT *, sqrt(p * (1 - p)) AS q, w - l AS span FROM g)"


def _fourth(x: str) -> str:
    return f"floor(({x}) * 1e4 + 0.5) / 1e4"


@query(
    f"""WITH {GRID} SELECT k, {_fourth("sqrt(n) * (1 / q - (span * p + l) * (1 - 2 * p) / (2 * span * q * q * q))")} AS by_p, {_fourth("(span * p + l) / (span * q) / (2 * sqrt(n))")} AS by_n,
    {_fourth("-sqrt(n) * l / (span * span * q)")} AS by_win, {_fourth("sqrt(n) * w / (span * span * q)")} AS by_lose FROM d"""
)
def sharpe_sensitivities(spark, sf):
    """The derivatives of the asymmetric Sharpe ratio by precision, frequency and either payout."""
    rows = []
    for k in range(30):
        got = K.sharpe_sensitivities(0.52 + k * 0.01, 50.0 + k * 10, 0.02, -0.015 - k * 0.0005)
        rows.append((k, *(got[x] for x in ("p", "n", "win", "lose"))))
    df = spark.createDataFrame(rows, "k long, by_p double, by_n double, by_win double, by_lose double")
    return df.select("k", *((F.floor(F.col(c) * 1e4 + 0.5) / 1e4).alias(c) for c in df.columns[1:]))


MIXED = """g AS (SELECT i AS k, 0.1::DOUBLE + i * 0.02::DOUBLE AS a, -0.02::DOUBLE AS m1, 0.03::DOUBLE AS s1, 0.01::DOUBLE + i * 0.0005::DOUBLE AS m2, 0.015::DOUBLE AS s2, 24 + i AS n FROM range(30) t(i)),
m AS (SELECT *, a * m1 + (1 - a) * m2 AS mu FROM g),
c AS (SELECT *, a * (s1 * s1 + pow(m1 - mu, 2)) + (1 - a) * (s2 * s2 + pow(m2 - mu, 2)) AS c2, a * (pow(m1 - mu, 3) + 3 * (m1 - mu) * s1 * s1) + (1 - a) * (pow(m2 - mu, 3) + 3 * (m2 - mu) * s2 * s2) AS c3,
      a * (pow(m1 - mu, 4) + 6 * pow(m1 - mu, 2) * s1 * s1 + 3 * pow(s1, 4)) + (1 - a) * (pow(m2 - mu, 4) + 6 * pow(m2 - mu, 2) * s2 * s2 + 3 * pow(s2, 4)) AS c4 FROM m),
z AS (SELECT *, mu / sqrt(c2) AS sr, c3 / pow(c2, 1.5) AS sk, c4 / (c2 * c2) AS ku FROM c),
t AS (SELECT *, (sr - 0.05::DOUBLE) * sqrt(n - 1::DOUBLE) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) AS z FROM z)"""


@query(f"WITH {MIXED} SELECT k, {_fourth('sr')} AS sharpe, {_fourth('sk')} AS skew, {_fourth('ku')} AS kurtosis, {_fourth(PHI('z'))} AS psr FROM t")
def mixture_psr(spark, sf):
    """Probabilistic Sharpe ratio of returns that are a mixture of two normals."""
    rows = []
    for k in range(30):
        parts = [(0.1 + k * 0.02, -0.02, 0.03), (1 - (0.1 + k * 0.02), 0.01 + k * 0.0005, 0.015)]
        mean, var, skew, kurtosis = K.mixture_moments(parts)
        rows.append((k, mean / var**0.5, skew, kurtosis, K.mixture_psr(parts, 24 + k, 0.05)))
    df = spark.createDataFrame(rows, "k long, sharpe double, skew double, kurtosis double, psr double")
    return df.select("k", *((F.floor(F.col(c) * 1e4 + 0.5) / 1e4).alias(c) for c in df.columns[1:]))


@query(f"SELECT k, {Q('m / d')} AS monthly, {Q('m / d * sqrt(12::DOUBLE)')} AS annual FROM (SELECT i AS k, 0.001::DOUBLE * (i + 1) AS m, 0.02::DOUBLE + 0.001::DOUBLE * i AS d FROM range(20) t(i))")
def annual_sharpe(spark, sf):
    rows = [(k, *K.annual_sharpe(0.001 * (k + 1), 0.02 + 0.001 * k, 12)) for k in range(20)]
    return spark.createDataFrame(rows, "k long, monthly double, annual double").select("k", q6("monthly").alias("monthly"), q6("annual").alias("annual"))


# simulated rules

OU = f"""{SERIES}, d AS (SELECT symbol, close - lag(close) OVER (ORDER BY rn) AS y, lag(close) OVER (ORDER BY rn) AS x FROM c),
s AS (SELECT symbol, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM d WHERE x IS NOT NULL GROUP BY symbol)"""


@query(f"WITH {OU} SELECT symbol, n, {Q('1 + b')} AS phi, {Q('-a / b')} AS mean, {Q('sqrt((syy - b * sxy) / n)')} AS sigma FROM s")
def ou_estimates(spark, sf):
    return O.estimate_ou(daily(spark, sf)).select("symbol", "n", *(q6(c).alias(c) for c in ("phi", "mean", "sigma")))


@query(
    f"""WITH {OU}, m AS (SELECT symbol, avg(close) AS m, stddev_samp(d) AS sd FROM (SELECT *, close - lag(close) OVER (ORDER BY rn) AS d FROM c) GROUP BY symbol)
    SELECT symbol, n, {Q("CASE WHEN n >= 20 AND b <> 0 THEN -a / b ELSE m END")} AS mean, {Q("CASE WHEN n >= 20 THEN sqrt(greatest(syy - b * sxy, 0) / n) ELSE sd END")} AS sigma,
           {Q("CASE WHEN n >= 20 AND 1 + b > 0 AND 1 + b < 1 THEN -ln(2::DOUBLE) / ln(1 + b) ELSE 50 END")} AS half_life FROM s JOIN m USING (symbol)"""
)
def ou_with_fallback(spark, sf):
    d = daily(spark, sf)
    return O.with_fallback(O.estimate_ou(d), d).select("symbol", "n", *(q6(c).alias(c) for c in ("mean", "sigma", "half_life")))


def _rules(spark, short=False):
    grid = O.rule_grid(1.0)
    return O.simulate_rules(spark, 0.0, 10.0, 1.0, grid, grid, paths=100_000, longest=200, start=0.5, seed=7, short=short)


@query()
def trading_rule_grid(spark, sf):
    return _rules(spark).select(q6("pt").alias("pt"), q6("sl").alias("sl"), "n", *(q6(c).alias(c) for c in ("mean", "deviation", "sharpe")))


@query()
def trading_rule_heat_map(spark, sf):
    return O.heat_map(_rules(spark), O.rule_grid(1.0))


@query()
def best_trading_rule(spark, sf):
    return O.best_rule(_rules(spark))


@query()
def best_rule_with_fixed_stop(spark, sf):
    return O.best_rule(_rules(spark, short=True), stop=O.rule_grid(1.0)[4])


@query(f"WITH {CLOSES} SELECT symbol, seq, {Q('close - lag(close) OVER (PARTITION BY symbol ORDER BY rn)')} AS change FROM c")
def price_changes(spark, sf):
    return closes(spark, sf).select("symbol", "seq", q6(diff("close")).alias("change"))
