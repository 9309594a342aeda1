"""Bars from trades: time, tick, volume, dollar, imbalance and run bars, and what is counted in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, ORDER, diff, pct_change, ratio, sample_kurtosis, sample_skew, series
from .fold import fold

AT = F.struct


def tick_bar_ids(trades: DataFrame, size: int) -> DataFrame:
    """``bar_id`` of every ``size`` consecutive trades; null in the last, incomplete bar."""
    w = series()
    n = F.count("*").over(Window.partitionBy(*KEYS))
    bar = F.floor((F.row_number().over(w) - 1) / size)
    return trades.withColumn("bar_id", F.when(bar < F.floor(n / size), bar).cast("long"))


def _accumulate(threshold: float):
    """A bar closes with the trade that brings its sum to the threshold; the excess is dropped."""

    def machine():
        total, bar = 0.0, 0

        def step(weights):
            nonlocal total, bar
            ids, closes = [], []
            for w in weights:
                total += w if w is not None else 0.0
                ids.append(bar)
                done = total >= threshold
                closes.append(done)
                if done:
                    total, bar = 0.0, bar + 1
            return ids, closes

        return step

    return machine


def threshold_bar_ids(trades: DataFrame, weight: Column, threshold: float) -> DataFrame:
    """``bar_id`` and ``closes`` for bars that accumulate ``weight``."""
    return fold(trades.withColumn("_weight", weight), _accumulate(threshold), ["_weight"], {"bar_id": "long", "closes": "boolean"}).drop("_weight")


def ohlcv(ids: DataFrame) -> DataFrame:
    """One row for each bar: first, highest, lowest and last price, volume-weighted price, volume and number of trades."""
    at = F.struct("ts", "seq")
    return ids.filter("bar_id IS NOT NULL").groupBy(*KEYS, "bar_id").agg(
        F.min("ts").alias("ts"),
        F.max("ts").alias("ts_end"),
        F.min("seq").alias("seq"),
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.try_divide(F.sum(F.col("price") * F.col("quantity")), F.nullif(F.sum("quantity"), F.lit(0.0))).alias("vwap"),
        F.sum("quantity").alias("volume"),
        F.count("*").alias("num_ticks"),
        *([F.max("closes").alias("closes")] if "closes" in ids.columns else []),
    )


def _closed(bars: DataFrame) -> DataFrame:
    return bars.filter("closes").drop("closes")


def tick_bars(trades: DataFrame, size: int) -> DataFrame:
    return ohlcv(tick_bar_ids(trades, size))


def volume_bars(trades: DataFrame, volume: float) -> DataFrame:
    return _closed(ohlcv(threshold_bar_ids(trades, F.col("quantity"), volume)))


def dollar_bars(trades: DataFrame, dollars: float) -> DataFrame:
    return _closed(ohlcv(threshold_bar_ids(trades, F.col("price") * F.col("quantity"), dollars)))


def time_bars(trades: DataFrame, every: str = "5 minutes") -> DataFrame:
    """Left-closed buckets labelled by their start; empty ones don't appear."""
    at = F.struct("ts", "seq")
    return trades.groupBy(*KEYS, F.window("ts", every).alias("_w")).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("quantity").alias("volume"),
    ).select(*KEYS, F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def rebucket(bars: DataFrame, every: str = "1 hour") -> DataFrame:
    """Bars of bars."""
    at = F.struct("ts", "seq")
    return bars.groupBy(*KEYS, F.window("ts", every).alias("_w")).agg(
        F.min_by("open", at).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", at).alias("close"),
        F.sum("volume").alias("volume"),
    ).select(*KEYS, F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


#: Calendar steps and, for the labels, where a period ends.
PERIODS = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month"}


def count_per_period(rows: DataFrame, period: str = "weekly") -> DataFrame:
    """Rows in each calendar period of each symbol's own range, empty ones as 0; labelled by the start
    (weeks begin on Monday), with ``period_end``, the last day of the period, for weeks and months."""
    unit = PERIODS.get(period, period)
    step = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}[unit]
    counted = rows.groupBy(*KEYS, F.date_trunc(unit, "ts").alias("period")).agg(F.count("*").alias("n"))
    span = counted.groupBy(*KEYS).agg(F.min("period").alias("a"), F.max("period").alias("b"))
    calendar = span.select(*KEYS, F.explode(F.sequence("a", "b", F.expr(step))).alias("period"))
    out = calendar.join(counted, [*KEYS, "period"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    last = {"week": F.date_add(F.to_date("period"), 6), "month": F.last_day("period")}.get(unit, F.to_date("period"))
    return out.withColumn("period_end", last)


class _Imbalance:
    """The state of imbalance and run bars (one key)."""

    def __init__(self, alpha_ticks, alpha_flow, flow, ticks, kind, run):
        self.alpha_ticks, self.alpha_flow, self.kind, self.run = alpha_ticks, alpha_flow, kind, run
        self.ticks, self.flow = ticks, flow
        self.threshold = ticks * flow
        self.buy_share, self.buy, self.sell = 0.5, abs(flow), abs(flow)
        self.bar, self.count, self.theta, self.runs = 0, 0, 0.0, [0.0, 0.0]
        self.last, self.sign = None, 1

    def __call__(self, prices, quantities):
        ids, signs, closes = [], [], []
        for p, q in zip(prices, quantities, strict=True):
            if self.last is None:
                ids.append(None), signs.append(None), closes.append(False)
                self.last = p
                continue
            if p != self.last:
                self.sign = 1 if p > self.last else -1
            self.last = p
            w = {"tick": 1.0, "volume": q, "dollar": p * q}[self.kind]
            self.count += 1
            ids.append(self.bar)
            signs.append(self.sign)
            done = self._run(w) if self.run else self._imbalance(w)
            closes.append(done)
            if done:
                self.ticks = self.alpha_ticks * self.count + (1 - self.alpha_ticks) * self.ticks
                self.threshold = self.ticks * self._expected()
                self.bar, self.count, self.theta, self.runs = self.bar + 1, 0, 0.0, [0.0, 0.0]
        return ids, signs, closes

    def _expected(self):
        return max(self.buy_share * self.buy, (1 - self.buy_share) * self.sell) if self.run else abs(self.flow)

    def _imbalance(self, w):
        flow = self.sign * w
        self.theta += flow
        self.flow = self.alpha_flow * flow + (1 - self.alpha_flow) * self.flow
        return abs(self.theta) >= self.threshold

    def _run(self, w):
        bought = self.sign > 0
        self.runs[0 if bought else 1] += w
        self.buy_share = self.alpha_flow * bought + (1 - self.alpha_flow) * self.buy_share
        if bought:
            self.buy = self.alpha_flow * w + (1 - self.alpha_flow) * self.buy
        else:
            self.sell = self.alpha_flow * w + (1 - self.alpha_flow) * self.sell
        return max(self.runs) >= self.threshold


def imbalance_bar_ids(trades: DataFrame, alpha_ticks: float = 0.1, alpha_flow: float = 0.1, expected_flow: float = 0.5, expected_ticks: float = 10.0, kind: str = "tick", run: bool = False) -> DataFrame:
    """``bar_id``, ``tick_sign`` and ``closes`` of every trade but a symbol's first (null).

    ``kind`` weighs a signed tick by 1, its volume or its value; ``run`` accumulates buys and
    sells apart.  A bar closes when the absolute flow reaches the expected number of ticks
    times the expected flow, both exponentially weighted (the number over bars, the flow over
    ticks).  An unchanged price carries the last sign, +1 at first."""

    def machine():
        return _Imbalance(alpha_ticks, alpha_flow, expected_flow, expected_ticks, kind, run)

    return fold(trades, machine, ["price", "quantity"], {"bar_id": "long", "tick_sign": "int", "closes": "boolean"})


def imbalance_bars(trades: DataFrame, **options) -> DataFrame:
    return _closed(ohlcv(imbalance_bar_ids(trades, **options)))


def ewma(df: DataFrame, column: str, alpha: float, initial: float, out: str = "ewma") -> DataFrame:
    """``alpha * x + (1 - alpha) * previous`` from an explicit initial value; null values change nothing."""

    def machine():
        last = initial

        def step(values):
            nonlocal last
            got = []
            for v in values:
                last = last if v is None else alpha * v + (1 - alpha) * last
                got.append(last)
            return (got,)

        return step

    return fold(df, machine, [column], {out: "double"})


def micro_features(ids: DataFrame) -> DataFrame:
    """Bars with microstructure features of the trades inside each (``ids``: trades with ``bar_id``,
    ``sign`` and perhaps ``closes``).  Bars without volume are left out and keep their number."""
    bar = Window.partitionBy(*KEYS, "bar_id")
    inside = bar.orderBy(*ORDER)
    signed = F.col("sign") * F.col("quantity")
    start, span = F.min(F.unix_micros("ts")).over(bar), F.max(F.unix_micros("ts")).over(bar) - F.min(F.unix_micros("ts")).over(bar)
    rows = ids.filter("bar_id IS NOT NULL").withColumns({"_sv": signed, "_lag": F.lag(signed).over(inside), "_early": F.unix_micros("ts") <= start + 0.25 * span, "_span": span, "_value": F.col("price") * F.col("quantity")})
    q, at = F.col("quantity"), F.struct("ts", "seq")
    a, b = F.when(F.col("_lag").isNotNull(), F.col("_sv")), F.when(F.col("_lag").isNotNull(), F.col("_lag"))
    autocorr = F.try_divide(F.covar_samp(a, b), F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0)))
    out = rows.groupBy(*KEYS, "bar_id").agg(
        F.min("ts").alias("ts"),
        F.max("ts").alias("ts_end"),
        F.min("seq").alias("seq"),
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.try_divide(F.sum("_value"), F.nullif(F.sum(q), F.lit(0.0))).alias("vwap"),
        F.sum(q).alias("volume"),
        F.count("*").alias("num_ticks"),
        F.bround(F.sum("_sv"), 8).alias("ofi"),
        F.bround(F.avg(q), 8).alias("mean_trade_size"),
        F.coalesce(F.bround(F.stddev_samp(q), 8), F.lit(0.0)).alias("std_trade_size"),
        F.coalesce(F.bround(sample_skew(q), 8), F.lit(0.0)).alias("skew_trade_size"),
        F.coalesce(F.bround(sample_kurtosis(q), 8), F.lit(0.0)).alias("kurt_trade_size"),
        F.max(q).alias("max_trade_size"),
        F.bround(F.try_divide(F.sum(q * q), F.nullif(F.sum(q) * F.sum(q), F.lit(0.0))), 8).alias("volume_concentration"),
        F.when(F.count("*") > 1, F.bround(F.when(F.max("_span") == 0, F.lit(1.0)).otherwise(F.try_divide(F.sum(F.when(F.col("_early"), q)), F.nullif(F.sum(q), F.lit(0.0)))), 2)).alias("front_loaded_vol_pct"),
        F.coalesce(F.bround(autocorr, 8), F.lit(0.0)).alias("signed_vol_autocorr"),
        *([F.max("closes").alias("closes")] if "closes" in ids.columns else []),
    ).filter("volume <> 0")
    return _closed(out) if "closes" in ids.columns else out


def bar_returns(bars: DataFrame) -> DataFrame:
    """Bars with ``ret``, the simple return of the close."""
    return bars.withColumn("ret", pct_change("close"))


def return_statistics(bars: DataFrame) -> DataFrame:
    """Of each symbol's returns: number, variance, lag-1 autocorrelation, and the Jarque-Bera
    statistic with its p-value (population moments)."""
    rows = bar_returns(bars).filter("ret IS NOT NULL")
    rows = rows.withColumn("_lag", F.lag("ret").over(series()))
    a, b = F.when(F.col("_lag").isNotNull(), F.col("ret")), F.col("_lag")
    # in two passes, as moments that are updated row by row lose digits; a window, so that both add in the order of time
    rows = rows.withColumn("_m", F.avg("ret").over(Window.partitionBy(*KEYS)))
    m2, m3, m4 = (F.avg(F.pow(F.col("ret") - F.col("_m"), F.lit(float(k)))) for k in (2, 3, 4))
    jb = F.count("*") / 6 * (ratio(m3 * m3, F.pow(m2, F.lit(3.0))) + F.pow(ratio(m4, m2 * m2) - 3, F.lit(2.0)) / 4)
    out = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.var_samp("ret").alias("variance"), F.try_divide(F.covar_samp(a, b), F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0))).alias("autocorr"), jb.alias("jarque_bera"))
    return out.withColumn("p_value", F.exp(-F.col("jarque_bera") / 2))


def tick_rule(trades: DataFrame) -> DataFrame:
    """``tick_sign``: sign of the price change, the last one where it is 0, +1 at first."""
    changed = trades.withColumn("_s", F.nullif(F.signum(diff("price")), F.lit(0.0)))
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    return changed.withColumn("tick_sign", F.coalesce(F.last("_s", ignorenulls=True).over(w), F.lit(1.0)).cast("int")).drop("_s")
