"""Queries: trades, bars and what is counted in bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import q6, us
from ..operators import bars as B
from ..sources import fixtures as X
from ..sources import trades as T
from ..sources.fixtures import sql_q6 as Q
from .registry import query

DOLLARS, VOLUME, TICKS = 20000.005, 150.0, 10

NUMBERED = "numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS rn FROM trades)"


def sql_threshold_bars(weight: str, threshold: float, trades: str = X.SQL_TRADES) -> str:
    """CTEs up to ``ids``: every trade with its bar and whether it closes it."""
    return f"""WITH RECURSIVE {trades}, {NUMBERED},
fold AS (
  SELECT symbol, rn, {weight} AS acc, 0::BIGINT AS bar_id FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.rn, CASE WHEN f.acc >= {threshold} THEN 0.0 ELSE f.acc END + {weight.replace("price", "n.price").replace("quantity", "n.quantity")},
         f.bar_id + CASE WHEN f.acc >= {threshold} THEN 1 ELSE 0 END
  FROM fold f JOIN numbered n ON n.symbol = f.symbol AND n.rn = f.rn + 1
),
ids AS (SELECT n.*, f.bar_id, f.acc >= {threshold} AS closes FROM numbered n JOIN fold f USING (symbol, rn))"""


SQL_OHLCV = f"""
SELECT symbol, bar_id, {X.sql_us("min(ts)")} AS ts_us, {X.sql_us("max(ts)")} AS ts_end_us, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, seq) AS close, {Q("sum(price * quantity) / sum(quantity)")} AS vwap, sum(quantity) AS volume, count(*) AS num_ticks
FROM ids GROUP BY symbol, bar_id"""


def _bars(df):
    return df.select("symbol", "bar_id", us("ts").alias("ts_us"), us("ts_end").alias("ts_end_us"), "open", "high", "low", "close", q6("vwap").alias("vwap"), "volume", "num_ticks")


@query(f"WITH {X.SQL_TRADES} SELECT symbol, {X.sql_us('ts')} AS ts_us, seq, price, quantity, side, sign FROM trades")
def trades_scan(spark, sf):
    return X.trades(spark, sf).select("symbol", us("ts").alias("ts_us"), "seq", "price", "quantity", "side", "sign")


@query(
    f"""WITH {X.SQL_TRADES} SELECT symbol, {X.sql_us("ts")} // 1000 * 1000 AS ts_us,
        strftime(make_timestamp({X.sql_us("ts")} // 1000 * 1000), '%Y-%m-%d %H:%M:%S.%f') AS utc,
        row_number() OVER (PARTITION BY symbol ORDER BY {X.sql_us("ts")} // 1000, seq) AS seq, price, quantity, sign FROM trades"""
)
def normalised_trades(spark, sf):
    raw = X.trades(spark, sf).select("symbol", F.unix_millis("ts").alias("timestamp"), F.col("seq").alias("id"), "price", F.col("quantity").alias("volume"), "side")
    out = T.normalise_trades(raw)
    return out.select("symbol", us("ts").alias("ts_us"), T.utc_string(F.unix_millis("ts")).alias("utc"), "seq", "price", "quantity", "sign")


@query(sql_threshold_bars("price * quantity", DOLLARS) + SQL_OHLCV + " HAVING bool_or(closes)")
def dollar_bars(spark, sf):
    return _bars(B.dollar_bars(X.trades(spark, sf), DOLLARS))


@query(sql_threshold_bars("quantity", VOLUME) + SQL_OHLCV + " HAVING bool_or(closes)")
def volume_bars(spark, sf):
    return _bars(B.volume_bars(X.trades(spark, sf), VOLUME))


@query(f"WITH {X.SQL_TRADES}, {NUMBERED}, ids AS (SELECT *, (rn - 1) // {TICKS} AS bar_id FROM numbered)" + SQL_OHLCV + f" HAVING count(*) = {TICKS}")
def tick_bars(spark, sf):
    return _bars(B.tick_bars(X.trades(spark, sf), TICKS))


def sql_time_bars(width: str, source: str = "trades", o: str = "price", h: str = "price", low: str = "price", c: str = "price", v: str = "quantity") -> str:
    return f"""SELECT symbol, {X.sql_us(f"time_bucket(INTERVAL '{width}', ts)")} AS ts_us, arg_min({o}, seq) AS open, max({h}) AS high, min({low}) AS low,
       arg_max({c}, seq) AS close, sum({v}) AS volume FROM {source} GROUP BY symbol, time_bucket(INTERVAL '{width}', ts)"""


@query(f"WITH {X.SQL_LONG_TRADES} {sql_time_bars('5 minutes')}")
def time_bars(spark, sf):
    return B.time_bars(X.trades(spark, sf, "event_type"), "5 minutes").select("symbol", us("ts").alias("ts_us"), "open", "high", "low", "close", "volume")


@query(
    f"""WITH {X.SQL_LONG_TRADES}, {NUMBERED}, ids AS (SELECT *, (rn - 1) // {TICKS} AS bar_id FROM numbered),
    b AS (SELECT symbol, min(ts) AS ts, min(seq) AS seq, arg_min(price, seq) AS o, max(price) AS h, min(price) AS l, arg_max(price, seq) AS c, sum(quantity) AS v
          FROM ids GROUP BY symbol, bar_id HAVING count(*) = {TICKS})
    {sql_time_bars("1 hour", "b", "o", "h", "l", "c", "v")}"""
)
def hourly_rebucket(spark, sf):
    out = B.rebucket(B.tick_bars(X.trades(spark, sf, "event_type"), TICKS), "1 hour")
    return out.select("symbol", us("ts").alias("ts_us"), "open", "high", "low", "close", "volume")


def _counts_sql(unit: str, step: str, end: str) -> str:
    return f"""WITH {X.SQL_TRADES}, c AS (SELECT symbol, date_trunc('{unit}', ts)::TIMESTAMP AS period, count(*) AS n FROM trades GROUP BY ALL),
    cal AS (SELECT symbol, unnest(generate_series(min(period), max(period), INTERVAL '{step}')) AS period FROM c GROUP BY symbol)
    SELECT symbol, {X.sql_us("period")} AS period_us, coalesce(n, 0)::BIGINT AS n, strftime({end}, '%Y-%m-%d') AS period_end FROM cal LEFT JOIN c USING (symbol, period)"""


def _counts(spark, sf, period):
    return B.count_per_period(X.trades(spark, sf), period).select("symbol", us("period").alias("period_us"), "n", F.date_format("period_end", "yyyy-MM-dd").alias("period_end"))


@query(_counts_sql("week", "7 days", "period::DATE + 6"))
def counts_per_week(spark, sf):
    return _counts(spark, sf, "weekly")


@query(_counts_sql("hour", "1 hour", "period::DATE"))
def counts_per_hour(spark, sf):
    return _counts(spark, sf, "hourly")


@query(_counts_sql("month", "1 month", "last_day(period)"))
def counts_per_month(spark, sf):
    return _counts(spark, sf, "monthly")


FLOW, EXPECTED, ALPHA = 0.5, 10.0, 0.1

SQL_IMBALANCE = f"""WITH RECURSIVE {X.SQL_TRADES}, {NUMBERED},
moves AS (SELECT *, CASE WHEN price > lag(price) OVER w THEN 1 WHEN price < lag(price) OVER w THEN -1 END AS m FROM numbered WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
signs AS (SELECT symbol, rn, seq, price, quantity, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING), 1) AS b FROM moves),
fold AS (
  SELECT symbol, 1::BIGINT AS rn, 0::BIGINT AS bar_id, 0.0::DOUBLE AS t, 0.0::DOUBLE AS theta, {FLOW}::DOUBLE AS eb, {EXPECTED}::DOUBLE AS et, {FLOW * EXPECTED}::DOUBLE AS thr, false AS closes
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, bar_id, t, theta, eb, CASE WHEN closes THEN {ALPHA} * t + (1 - {ALPHA}) * et ELSE et END,
         CASE WHEN closes THEN ({ALPHA} * t + (1 - {ALPHA}) * et) * abs(eb) ELSE thr END, closes
  FROM (SELECT symbol, rn, bar_id, t, theta, eb, et, thr, abs(theta) >= thr AS closes FROM (
    SELECT s.symbol, s.rn, f.bar_id + CASE WHEN f.closes THEN 1 ELSE 0 END AS bar_id, CASE WHEN f.closes THEN 0 ELSE f.t END + 1 AS t,
           CASE WHEN f.closes THEN 0 ELSE f.theta END + s.b AS theta, {ALPHA} * s.b + (1 - {ALPHA}) * f.eb AS eb, f.et, f.thr
    FROM fold f JOIN signs s ON s.symbol = f.symbol AND s.rn = f.rn + 1))
)"""


@query(SQL_IMBALANCE + " SELECT f.symbol, s.seq, CASE WHEN rn > 1 THEN bar_id END AS bar_id, CASE WHEN rn > 1 THEN b END::INTEGER AS tick_sign FROM fold f JOIN signs s USING (symbol, rn)")
def tick_imbalance_ids(spark, sf):
    return B.imbalance_bar_ids(X.trades(spark, sf), alpha_ticks=ALPHA, alpha_flow=ALPHA, expected_flow=FLOW, expected_ticks=EXPECTED).select("symbol", "seq", "bar_id", "tick_sign")


SIGNS = """moves AS (SELECT *, CASE WHEN price > lag(price) OVER w THEN 1 WHEN price < lag(price) OVER w THEN -1 END AS m FROM numbered WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
signs AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING), 1) AS b FROM moves)"""


def sql_signed_bars(weight: str, flow: float, run: bool) -> str:
    """Imbalance or run bars as a recursion over the trades of a symbol; the weight is a column expression over ``s``."""
    share, rest = f"{ALPHA}::DOUBLE", f"{1 - ALPHA}::DOUBLE"
    bought = "s.b > 0"
    if run:
        state = {"buys": "0.0", "sells": "0.0", "share": "0.5", "buy": f"{flow}", "sell": f"{flow}"}
        step = {
            "buys": f"CASE WHEN f.closes THEN 0 ELSE f.buys END + CASE WHEN {bought} THEN {weight} ELSE 0 END",
            "sells": f"CASE WHEN f.closes THEN 0 ELSE f.sells END + CASE WHEN {bought} THEN 0 ELSE {weight} END",
            "share": f"{share} * ({bought})::INTEGER + {rest} * f.share",
            "buy": f"CASE WHEN {bought} THEN {share} * {weight} + {rest} * f.buy ELSE f.buy END",
            "sell": f"CASE WHEN {bought} THEN f.sell ELSE {share} * {weight} + {rest} * f.sell END",
        }
        closes, expected = "greatest(buys, sells) >= thr", "greatest(share * buy, (1 - share) * sell)"
    else:
        state = {"theta": "0.0", "flow": f"{flow}"}
        step = {"theta": f"CASE WHEN f.closes THEN 0 ELSE f.theta END + s.b * {weight}", "flow": f"{share} * (s.b * {weight}) + {rest} * f.flow"}
        closes, expected = "abs(theta) >= thr", "abs(flow)"
    names = ", ".join(state)
    ticks = f"({share} * t + {rest} * et)"
    return f"""WITH RECURSIVE {X.SQL_TRADES}, {NUMBERED}, {SIGNS},
fold AS (
  SELECT symbol, 1::BIGINT AS rn, 0::BIGINT AS bar_id, 0.0::DOUBLE AS t, {", ".join(f"{v}::DOUBLE AS {k}" for k, v in state.items())}, {EXPECTED}::DOUBLE AS et, {EXPECTED * flow}::DOUBLE AS thr, false AS closes
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, bar_id, t, {names}, CASE WHEN closes THEN {ticks} ELSE et END, CASE WHEN closes THEN {ticks} * {expected} ELSE thr END, closes
  FROM (SELECT *, {closes} AS closes FROM (
    SELECT s.symbol, s.rn, f.bar_id + f.closes::INTEGER AS bar_id, CASE WHEN f.closes THEN 0 ELSE f.t END + 1 AS t, {", ".join(f"{v} AS {k}" for k, v in step.items())}, f.et, f.thr
    FROM fold f JOIN signs s ON s.symbol = f.symbol AND s.rn = f.rn + 1))
),
ids AS (SELECT n.*, f.bar_id, f.closes FROM numbered n JOIN fold f USING (symbol, rn) WHERE rn > 1)""" + SQL_OHLCV + " HAVING bool_or(closes)"


@query(sql_signed_bars("s.quantity", 25.0, False))
def volume_imbalance_bars(spark, sf):
    return _bars(B.imbalance_bars(X.trades(spark, sf), kind="volume", expected_flow=25.0))


@query(sql_signed_bars("(s.price * s.quantity)", 2500.0, False))
def dollar_imbalance_bars(spark, sf):
    return _bars(B.imbalance_bars(X.trades(spark, sf), kind="dollar", expected_flow=2500.0))


@query(sql_signed_bars("1.0::DOUBLE", 1.0, True))
def tick_run_bars(spark, sf):
    return _bars(B.imbalance_bars(X.trades(spark, sf), kind="tick", run=True, expected_flow=1.0))


@query(sql_signed_bars("s.quantity", 50.0, True))
def volume_run_bars(spark, sf):
    return _bars(B.imbalance_bars(X.trades(spark, sf), kind="volume", run=True, expected_flow=50.0))


@query(sql_signed_bars("(s.price * s.quantity)", 5000.0, True))
def dollar_run_bars(spark, sf):
    return _bars(B.imbalance_bars(X.trades(spark, sf), kind="dollar", run=True, expected_flow=5000.0))


def _raw(spark, sf):
    t = X.trades(spark, sf)
    return t.select(F.col("symbol").cast("string").alias("symbol"), F.unix_millis("ts").alias("timestamp"), F.col("seq").alias("id"), "price", F.col("quantity").alias("volume"), "side")


@query(
    f"""WITH {X.SQL_TRADES} SELECT symbol::VARCHAR AS symbol, {X.sql_us("ts")} // 1000 * 1000 AS ts_us, seq AS id, row_number() OVER (ORDER BY {X.sql_us("ts")} // 1000, symbol::VARCHAR, seq) AS place, price, quantity, sign FROM trades"""
)
def csv_files_combined(spark, sf):
    """Two CSV files of different column orders, written, read by a glob, combined and sorted by time."""
    folder = T.scratch_folder(spark, "csv")
    raw = _raw(spark, sf)
    T.write_csv(raw.filter("id % 2 = 0"), f"{folder}/even")
    T.write_csv(raw.filter("id % 2 = 1").select("side", "volume", "price", "id", "timestamp", "symbol"), f"{folder}/odd")
    kinds = "symbol string, timestamp long, id long, price double, volume double, side string"
    parts = [T.read_csv(spark, f"{folder}/{name}", kinds) for name in ("even", "odd")]
    both = T.concat(*parts).select("symbol", F.timestamp_millis("timestamp").alias("ts"), F.col("id").alias("seq"), "price", F.col("volume").alias("quantity"), T.side_sign("side").alias("sign"))
    placed = T.with_place(T.sorted_trades(both), ["ts", "symbol", "seq"])
    return placed.select("symbol", us("ts").alias("ts_us"), F.col("seq").alias("id"), "place", "price", "quantity", "sign")


@query(f"WITH b AS ({sql_threshold_bars('quantity', VOLUME) + SQL_OHLCV + ' HAVING bool_or(closes)'}) SELECT symbol::VARCHAR AS symbol, ts_us, open, high, low, close, vwap, volume FROM b")
def csv_bars_read_back(spark, sf):
    """Bars to a CSV sink and back, one symbol's file layout."""
    folder = T.scratch_folder(spark, "bars")
    b = B.volume_bars(X.trades(spark, sf), VOLUME)
    T.write_csv(b.select(F.col("symbol").cast("string").alias("symbol"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "open", "high", "low", "close", "vwap", "volume"), folder)
    rows = T.read_csv(spark, folder, "symbol string, timestamp string, open double, high double, low double, close double, vwap double, volume double")
    rows = rows.withColumn("ts", F.to_timestamp("timestamp"))
    return rows.select("symbol", us("ts").alias("ts_us"), "open", "high", "low", "close", q6("vwap").alias("vwap"), "volume")


@query(
    f"""WITH RECURSIVE {X.SQL_TRADES}, {NUMBERED}, fold AS (
      SELECT symbol, rn, 0.2 * price + 0.8 * 100.0 AS e FROM numbered WHERE rn = 1
      UNION ALL SELECT n.symbol, n.rn, 0.2 * n.price + 0.8 * f.e FROM fold f JOIN numbered n ON n.symbol = f.symbol AND n.rn = f.rn + 1)
    SELECT symbol, seq, {Q("e")} AS ewma FROM fold JOIN numbered USING (symbol, rn)"""
)
def ewma_recurrence(spark, sf):
    return B.ewma(X.trades(spark, sf), "price", 0.2, 100.0).select("symbol", "seq", q6("ewma").alias("ewma"))


SQL_MICRO = (
    sql_threshold_bars("price * quantity", 80000.005)
    + """,
spans AS (SELECT *, sign * quantity AS sv, epoch_us(ts) AS t, min(epoch_us(ts)) OVER w AS ta, max(epoch_us(ts)) OVER w AS tz FROM ids WINDOW w AS (PARTITION BY symbol, bar_id)),
lagged AS (SELECT *, lag(sv) OVER (PARTITION BY symbol, bar_id ORDER BY rn) AS lv FROM spans),
f AS (
  SELECT symbol, bar_id, count(*) AS num_ticks, sum(sv) AS ofi, avg(quantity) AS m, stddev_samp(quantity) AS sd, CASE WHEN count(*) > 2 THEN skewness(quantity) END AS sk,
         CASE WHEN count(*) > 3 THEN kurtosis(quantity) END AS ku, max(quantity) AS mx, sum(quantity * quantity) / pow(sum(quantity), 2) AS hh,
         sum(quantity) FILTER (t <= ta + 0.25 * (tz - ta)) / sum(quantity) AS fr, max(tz - ta) AS span,
         covar_samp(sv, lv) / nullif(stddev_samp(CASE WHEN lv IS NOT NULL THEN sv END) * stddev_samp(lv), 0) AS ac
  FROM lagged GROUP BY symbol, bar_id HAVING bool_or(closes)
)"""
    + f"""
SELECT symbol, bar_id, num_ticks, {Q("round_even(ofi, 8)")} AS ofi, {Q("round_even(m, 8)")} AS mean_trade_size, {Q("round_even(coalesce(sd, 0), 8)")} AS std_trade_size,
       {Q("round_even(coalesce(CASE WHEN isfinite(sk) THEN sk END, 0), 8)")} AS skew_trade_size, {Q("round_even(coalesce(CASE WHEN isfinite(ku) THEN ku END, 0), 8)")} AS kurt_trade_size, mx AS max_trade_size,
       {Q("round_even(hh, 8)")} AS volume_concentration, CASE WHEN num_ticks > 1 THEN round_even(CASE WHEN span = 0 THEN 1.0 ELSE fr END, 2) END AS front_loaded_vol_pct,
       {Q("round_even(coalesce(ac, 0), 8)")} AS signed_vol_autocorr
FROM f"""
)


@query(SQL_MICRO)
def micro_feature_bars(spark, sf):
    t = X.trades(spark, sf)
    out = B.micro_features(B.threshold_bar_ids(t, F.col("price") * F.col("quantity"), 80000.005))
    six = ("ofi", "mean_trade_size", "std_trade_size", "skew_trade_size", "kurt_trade_size", "volume_concentration", "signed_vol_autocorr")
    return out.select("symbol", "bar_id", "num_ticks", *(q6(c).alias(c) for c in six), "max_trade_size", "front_loaded_vol_pct")


SQL_RETURNS = f"""WITH {X.SQL_LONG_TRADES}, {NUMBERED}, ids AS (SELECT *, (rn - 1) // {TICKS} AS bar_id FROM numbered),
b AS (SELECT symbol, bar_id, arg_max(price, seq) AS c FROM ids GROUP BY ALL HAVING count(*) = {TICKS}),
r AS (SELECT symbol, bar_id, c / lag(c) OVER (PARTITION BY symbol ORDER BY bar_id) - 1 AS ret FROM b),
l AS (SELECT *, lag(ret) OVER (PARTITION BY symbol ORDER BY bar_id) AS lr FROM r WHERE ret IS NOT NULL),
s AS (SELECT symbol, count(*) AS n, var_samp(ret) AS v, covar_samp(ret, lr) / (stddev_samp(CASE WHEN lr IS NOT NULL THEN ret END) * stddev_samp(lr)) AS ac, avg(ret) AS m FROM l GROUP BY symbol),
k AS (SELECT l.symbol, avg(pow(ret - m, 2)) AS m2, avg(pow(ret - m, 3)) AS m3, avg(pow(ret - m, 4)) AS m4 FROM l JOIN s USING (symbol) GROUP BY l.symbol)
SELECT symbol, n, {Q("v")} AS variance, {Q("ac")} AS autocorr, {Q("n / 6.0 * (m3 * m3 / pow(m2, 3) + pow(m4 / (m2 * m2) - 3, 2) / 4)")} AS jarque_bera FROM s JOIN k USING (symbol)"""


@query(SQL_RETURNS)
def bar_return_statistics(spark, sf):
    out = B.return_statistics(B.tick_bars(X.trades(spark, sf, "event_type"), TICKS))
    return out.select("symbol", "n", *(q6(c).alias(c) for c in ("variance", "autocorr", "jarque_bera")))


@query(
    f"""WITH {X.SQL_TRADES}, m AS (SELECT *, CASE WHEN price > lag(price) OVER w THEN 1 WHEN price < lag(price) OVER w THEN -1 END AS s FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq))
    SELECT symbol, seq, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 1)::INTEGER AS tick_sign FROM m"""
)
def tick_rule(spark, sf):
    return B.tick_rule(X.trades(spark, sf)).select("symbol", "seq", "tick_sign")
