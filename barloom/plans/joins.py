"""Queries: the join kit, alignment and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import diff, q6, us
from ..operators import joins as J
from ..sources import fixtures as X
from ..sources.fixtures import sql_q6 as Q
from .registry import query

BUYS = "l AS (SELECT * FROM trades WHERE side = 'buy'), r AS (SELECT * FROM trades WHERE side = 'sell')"


def _sides(spark, sf):
    t = X.trades(spark, sf)
    return t.filter("side = 'buy'").select("symbol", "ts", "seq"), t.filter("side = 'sell'").select("symbol", "ts", "price")


def _asof_sql(op: str, shift: str = "") -> str:
    return f"""WITH {X.SQL_TRADES}, {BUYS}
    SELECT l.symbol, l.seq, r.price AS price, {X.sql_us("r.ts")} AS match_us FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.ts{shift} {op} r.ts"""


@query(_asof_sql(">="))
def asof_backward(spark, sf):
    a, b = _sides(spark, sf)
    return J.asof_backward(a, b, ["price"]).select("symbol", "seq", "price", us("match_ts").alias("match_us"))


@query(_asof_sql("<="))
def asof_forward(spark, sf):
    a, b = _sides(spark, sf)
    return J.asof_forward(a, b, ["price"]).select("symbol", "seq", "price", us("match_ts").alias("match_us"))


@query(_asof_sql("<=", " + INTERVAL 60 MINUTES"))
def asof_forward_offset(spark, sf):
    a, b = _sides(spark, sf)
    out = J.asof_forward(a.withColumn("at", F.col("ts") + F.expr("INTERVAL 60 MINUTES")), b, ["price"], at="at")
    return out.select("symbol", "seq", "price", us("match_ts").alias("match_us"))


def _interval_sql(which: str = "") -> str:
    return f"""WITH {X.SQL_TRADES}, i AS (SELECT symbol, seq, ts AS t0, ts + INTERVAL 2 DAYS AS t1 FROM trades{which})
    SELECT i.symbol, i.seq, count(*) AS n, max(t.price) AS high, {X.sql_us("max(t.ts)")} AS last_us FROM i JOIN trades t ON t.symbol = i.symbol AND t.ts BETWEEN i.t0 AND i.t1 GROUP BY i.symbol, i.seq"""


def _points_inside(t, starts):
    i = starts.select("symbol", F.col("seq").alias("event"), F.col("ts").alias("t0"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("t1"))
    out = J.interval_join(i, t.select("symbol", "ts", "price"), bucket_seconds=2 * 86400)
    return out.groupBy("symbol", F.col("event").alias("seq")).agg(F.count("*").alias("n"), F.max("price").alias("high"), us(F.max("ts")).alias("last_us"))


@query(_interval_sql(" WHERE seq % 3 = 0"))
def interval_join(spark, sf):
    t = X.trades(spark, sf)
    return _points_inside(t, t.filter("seq % 3 = 0"))


@query(_interval_sql())
def interval_join_all(spark, sf):
    t = X.trades(spark, sf)
    return _points_inside(t, t)


@query(
    f"""WITH {X.SQL_INTERVALS}, p AS (SELECT DISTINCT symbol, t AS ts FROM (SELECT symbol, t0 AS t FROM intervals UNION ALL SELECT symbol, t1 FROM intervals))
    SELECT p.symbol, {X.sql_us("p.ts")} AS ts_us, count(i.seq) AS n, {Q("coalesce(sum(i.signal), 0)")} AS signal
    FROM p LEFT JOIN intervals i ON i.symbol = p.symbol AND i.t0 <= p.ts AND p.ts < i.t1 GROUP BY p.symbol, p.ts"""
)
def open_intervals(spark, sf):
    return J.sweep(X.intervals(spark, sf), ["signal"]).select("symbol", us("ts").alias("ts_us"), "n", q6("signal").alias("signal"))


@query(
    f"""WITH {X.SQL_INTERVALS}, {X.SQL_SERIES}
    SELECT s.symbol, {X.sql_us("s.ts")} AS ts_us, count(i.seq) AS n FROM series s LEFT JOIN intervals i ON i.symbol = s.symbol AND s.ts BETWEEN i.t0 AND i.t1 GROUP BY s.symbol, s.ts"""
)
def concurrent_intervals(spark, sf):
    return J.concurrency(X.daily_series(spark, sf), X.intervals(spark, sf)).select("symbol", us("ts").alias("ts_us"), "n")


@query(
    f"""WITH {X.SQL_INTERVALS}, {X.SQL_SERIES}
    SELECT i.seq, {Q("avg(floor(s.close))")} AS mean_close FROM intervals i LEFT JOIN series s ON i.symbol = s.symbol AND s.ts BETWEEN i.t0 AND i.t1 GROUP BY i.seq"""
)
def prefix_average(spark, sf):
    return J.prefix_average(X.daily_series(spark, sf).withColumn("close", F.floor("close").cast("double")), "close", X.intervals(spark, sf), "m").select("seq", q6("m").alias("mean_close"))


@query(
    f"""WITH {X.SQL_INTERVALS}, test AS (SELECT * FROM intervals WHERE seq % 50 = 0)
    SELECT seq FROM intervals i WHERE NOT EXISTS (SELECT 1 FROM test t WHERE i.t0 <= t.t1 AND i.t1 >= t.t0)"""
)
def purge_overlaps(spark, sf):
    i = X.intervals(spark, sf)
    return J.without_overlap(i, i.filter("seq % 50 = 0").select("symbol", "t0", "t1")).select("seq")


@query(
    f"""WITH {X.SQL_TRADES}, a AS (SELECT symbol, ts, price FROM trades WHERE seq % 2 = 0), b AS (SELECT symbol, ts, quantity FROM trades WHERE seq % 3 = 0)
    SELECT symbol, {X.sql_us("ts")} AS ts_us, price, quantity FROM a JOIN b USING (symbol, ts)"""
)
def inner_time_join(spark, sf):
    t = X.trades(spark, sf)
    return t.filter("seq % 2 = 0").select("symbol", "ts", "price").join(t.filter("seq % 3 = 0").select("symbol", "ts", "quantity"), ["symbol", "ts"]).select("symbol", us("ts").alias("ts_us"), "price", "quantity")


@query(
    f"""WITH {X.SQL_TRADES}, b AS (SELECT symbol, ts, quantity FROM trades WHERE seq % 3 = 0)
    SELECT symbol, {X.sql_us("ts")} AS ts_us, price, b.quantity AS quantity FROM (SELECT symbol, ts, price FROM trades) a LEFT JOIN b USING (symbol, ts)"""
)
def reindexed(spark, sf):
    t = X.trades(spark, sf)
    return t.select("symbol", "ts", "price").join(t.filter("seq % 3 = 0").select("symbol", "ts", "quantity"), ["symbol", "ts"], "left").select("symbol", us("ts").alias("ts_us"), "price", "quantity")


@query(
    f"""WITH {X.SQL_TRADES}, a AS (SELECT symbol, ts, price FROM trades WHERE seq % 2 = 0), b AS (SELECT symbol, ts, price FROM trades WHERE seq % 3 = 0)
    SELECT symbol, {X.sql_us("ts")} AS ts_us, a.price AS price, b.price AS b_price FROM a FULL JOIN b USING (symbol, ts)"""
)
def feature_union(spark, sf):
    t = X.trades(spark, sf).select("symbol", "ts", "price", "seq")
    return J.union_features(t.filter("seq % 2 = 0").drop("seq"), t.filter("seq % 3 = 0").drop("seq"), "b_").select("symbol", us("ts").alias("ts_us"), "price", "b_price")


@query("SELECT x::DOUBLE AS pt, y::DOUBLE AS sl FROM (SELECT unnest([0.5, 1.0, 1.5, 2.0, 2.5, 3.0]) AS x) CROSS JOIN (SELECT unnest([0.5, 1.0, 1.5, 2.0, 2.5, 3.0]) AS y)")
def rule_grid(spark, sf):
    from ..sources.synthetic import grid

    return grid(spark, pt=(0.5, 3.0, 6), sl=(0.5, 3.0, 6))


@query(f"WITH {X.SQL_DAY_TRADES} SELECT symbol, seq, {X.sql_us('ts')} + row_number() OVER (PARTITION BY symbol, ts ORDER BY seq) - 1 AS ts_us FROM trades")
def unique_times(spark, sf):
    return J.unique_times(X.day_trades(spark, sf)).select("symbol", "seq", us("ts").alias("ts_us"))


@query(f"WITH {X.SQL_DAY_TRADES}, c AS (SELECT symbol, count(*) OVER (PARTITION BY symbol, ts) > 1 AS again FROM trades) SELECT symbol, count(*) AS n_rows, count(*) FILTER (again) AS n_repeated FROM c GROUP BY symbol")
def repeated_times(spark, sf):
    return J.repeated_times(X.day_trades(spark, sf))


@query(
    f"""WITH {X.SQL_TRADES}, r AS (SELECT symbol, seq, side, price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq) AS d FROM trades)
    SELECT symbol, seq, {Q("d")} AS change, CASE side WHEN 'buy' THEN 1 WHEN 'sell' THEN 0 END AS bought FROM r WHERE d IS NOT NULL AND abs(d) > 50"""
)
def cleaned_changes(spark, sf):
    side = F.element_at(F.create_map(F.lit("buy"), F.lit(1), F.lit("sell"), F.lit(0)), F.col("side"))
    out = X.trades(spark, sf).withColumn("change", diff("price")).na.drop(subset=["change"]).filter(F.abs("change") > 50)
    return out.select("symbol", "seq", q6("change").alias("change"), side.alias("bought"))


@query(
    f"""WITH {X.SQL_INTERVALS}, {X.SQL_SERIES}, last AS (SELECT max(ts) AS z FROM series)
    SELECT seq, {X.sql_us("coalesce(CASE WHEN seq % 10 <> 0 THEN t1 END, z)")} AS t1_us FROM intervals, last"""
)
def open_ends_filled(spark, sf):
    i = X.intervals(spark, sf).withColumn("t1", F.when(F.col("seq") % 10 != 0, F.col("t1")))
    last = X.daily_series(spark, sf).groupBy("symbol").agg(F.max("ts").alias("z"))
    return i.join(last, "symbol").select("seq", us(F.coalesce("t1", "z")).alias("t1_us"))


@query(
    f"""WITH {X.SQL_TRADES}, s AS (SELECT avg(price) AS m, stddev_pop(price) AS d FROM trades)
    SELECT symbol, seq, {Q("(price - m) / d")} AS z FROM trades, s"""
)
def standardised(spark, sf):
    t = X.trades(spark, sf)
    s = t.agg(F.avg("price").alias("m"), F.stddev_pop("price").alias("d"))
    return t.crossJoin(F.broadcast(s)).select("symbol", "seq", q6((F.col("price") - F.col("m")) / F.col("d")).alias("z"))


@query(f"WITH {X.SQL_TRADES} SELECT symbol, seq, CASE WHEN day(ts) % 2 = 0 THEN 1 ELSE -1 END AS side FROM trades")
def alternate_day_side(spark, sf):
    from ..sources.synthetic import alternate_days

    return alternate_days(X.trades(spark, sf)).select("symbol", "seq", "side")
