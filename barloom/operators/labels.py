"""Barriers, labels and the features and sides of meta-labelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, complete, full, pct_change, ratio, rows, running, series, sign
from .joins import asof_forward, interval_join


def _path(bars: DataFrame, events: DataFrame, bucket_seconds: int) -> DataFrame:
    """Every bar of every event's path, with the price at the start."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("_last"))
    closed = events.join(last, "symbol").withColumn("_end", F.coalesce("t1", "_last"))
    start = bars.select("symbol", F.col("ts").alias("t0"), F.col("close").alias("_p0"))
    return interval_join(closed.join(start, ["symbol", "t0"]), bars.select("symbol", "ts", "close"), bucket_seconds, "t0", "_end")


def triple_barrier(bars: DataFrame, events: DataFrame, profit: float = 1.0, loss: float = 1.0, bucket_seconds: int = 86_400) -> DataFrame:
    """TOUCHES: for each event the first time its return (times side) is above ``profit * trgt`` (``pt``) or below
    ``-loss * trgt`` (``sl``), strictly, on the bars in ``[t0, t1]`` (to the last bar if ``t1`` is null); a
    multiplier of 0 switches a barrier off.  ``first_touch`` is the earliest of the three."""
    ret = (ratio("close", "_p0") - 1) * F.col("side")
    path = _path(bars, events, bucket_seconds).withColumn("_r", ret)
    touch = path.groupBy("symbol", "t0").agg(
        F.min(F.when(F.lit(loss > 0) & (F.col("_r") < -F.lit(float(loss)) * F.col("trgt")), F.col("ts"))).alias("sl"),
        F.min(F.when(F.lit(profit > 0) & (F.col("_r") > F.lit(float(profit)) * F.col("trgt")), F.col("ts"))).alias("pt"),
    )
    return events.select("symbol", "t0", "t1").join(touch, ["symbol", "t0"], "left").withColumn("first_touch", F.least("t1", "sl", "pt"))


def return_labels(bars: DataFrame, events: DataFrame, end: str = "t1", apply_side: bool = False) -> DataFrame:
    """LABELS: return from the first bar at or after ``t0`` to that at or after ``end``, and its sign.

    With ``apply_side`` the return is times side and the label says whether the bet paid (0, 1)."""
    px = bars.select("symbol", "ts", F.col("close").alias("_p"))
    live = events.filter(F.col(end).isNotNull())
    a = asof_forward(live, px, ["_p"], at="t0").withColumnRenamed("_p", "_p0").drop("match_ts")
    b = asof_forward(a, px, ["_p"], at=end).withColumnRenamed("_p", "_p1").drop("match_ts")
    ret = ratio("_p1", "_p0") - 1
    if apply_side:
        ret = ret * F.col("side")
        return b.select("symbol", "t0", F.col(end).alias("t1"), ret.alias("ret"), (ret > 0).cast("int").alias("bin"))
    return b.select("symbol", "t0", F.col(end).alias("t1"), ret.alias("ret"), sign(ret).alias("bin"))


def vertical_labels(bars: DataFrame, events: DataFrame, bucket_seconds: int = 86_400, event_grid: bool = False) -> DataFrame:
    """LABELS: +1 or -1 for the first return of at least ``trgt`` either way before ``t1``, at that time; else 0 at ``t1``.

    ``event_grid`` looks only at bars that start or end some event of the symbol."""
    live = events.filter("t1 IS NOT NULL")
    grid = bars
    if event_grid:
        ends = live.select("symbol", F.col("t0").alias("ts")).unionByName(live.select("symbol", F.col("t1").alias("ts"))).distinct()
        grid = bars.join(ends, ["symbol", "ts"], "left_semi")
    path = _path(grid, live, bucket_seconds).withColumn("_r", ratio("close", "_p0") - 1)
    hit = F.col("_r").isNotNull() & (F.abs("_r") >= F.col("trgt"))
    found = path.groupBy("symbol", "t0", "t1").agg(F.min(F.when(hit, F.struct("ts", F.col("_r").alias("r")))).alias("_h"), F.max(F.struct("ts", F.col("_r").alias("r"))).alias("_l"))
    at = F.coalesce("_h", "_l")
    return found.select("symbol", "t0", F.coalesce(F.col("_h.ts"), F.col("t1")).alias("t1"), at["r"].alias("ret"), F.when(F.col("_h").isNotNull(), sign("_h.r")).otherwise(0).alias("bin"))


def drop_rare_labels(labels: DataFrame, least_share: float = 0.05) -> DataFrame:
    """Drop the rarest class, again and again, while its share is at most ``least_share`` and three classes are left.

    Only the counts of the classes reach the driver."""
    counts = {r["bin"]: r["n"] for r in labels.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    while len(counts) > 2:
        rare = min(counts, key=lambda c: (counts[c], c))
        if counts[rare] / sum(counts.values()) > least_share:
            break
        del counts[rare]
    return labels.filter(F.col("bin").isin(list(counts)))


def ma_cross_side(bars: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    """``side``: the sign of fast minus slow moving average, one bar later."""
    cross = F.signum(full(F.avg, "close", fast) - full(F.avg, "close", slow))
    return bars.withColumn("_c", cross).withColumn("side", F.lag("_c").over(series()).cast("int")).drop("_c")


def bollinger_side(bars: DataFrame, window: int = 20, deviations: float = 2.0) -> DataFrame:
    """``side``: -1 since the close was above the upper band, +1 since it was below the lower one; one bar later."""
    mean, sd = full(F.avg, "close", window), full(F.stddev_samp, "close", window)
    out = bars.withColumns({"_m": mean, "_s": sd})
    signal = F.when(F.col("close") > F.col("_m") + deviations * F.col("_s"), -1).when(F.col("close") < F.col("_m") - deviations * F.col("_s"), 1)
    out = out.withColumn("_x", signal).withColumn("_x", F.last("_x", ignorenulls=True).over(running()))
    return out.withColumn("side", F.lag("_x").over(series()).cast("int")).drop("_m", "_s", "_x")


def meta_features(bars: DataFrame, fast: int = 5, slow: int = 20, window: int = 10) -> DataFrame:
    """``fast_ma, slow_ma, ma_diff, volatility`` as known one bar earlier."""
    out = bars.withColumn("_r", pct_change("close"))
    out = out.withColumns({"_f": full(F.avg, "close", fast), "_s": full(F.avg, "close", slow), "_v": full(F.stddev_samp, "_r", window)})
    w = series()
    lagged = {"fast_ma": F.lag("_f").over(w), "slow_ma": F.lag("_s").over(w), "ma_diff": F.lag(F.col("_f") - F.col("_s")).over(w), "volatility": F.lag("_v").over(w)}
    return out.withColumns(lagged).drop("_r", "_f", "_s", "_v")


def rolling_autocorr(bars: DataFrame, window: int = 5, out: str = "serial_corr") -> DataFrame:
    """Lag-1 autocorrelation of the returns inside each window of ``window`` returns."""
    lagged = bars.withColumn("_r", pct_change("close"))
    lagged = lagged.withColumn("_l", F.lag("_r").over(series()))
    w = rows(window - 1)
    both = F.col("_r").isNotNull() & F.col("_l").isNotNull()
    a, b = F.when(both, F.col("_r")), F.when(both, F.col("_l"))
    value = F.try_divide(F.covar_samp(a, b).over(w), F.nullif(F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w), F.lit(0.0)))
    return lagged.withColumn(out, F.when(F.count(a).over(w) == window - 1, value)).drop("_r", "_l")


def meta_target(labels: DataFrame, features: DataFrame) -> DataFrame:
    """SAMPLES: features at ``t0`` beside the label with -1 taken as 0; rows with a null go."""
    binary = F.element_at(F.create_map(F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(-1), F.lit(0)), F.col("bin"))
    return features.withColumnRenamed("ts", "t0").join(labels.select("symbol", "t0", "t1", binary.alias("bin")), ["symbol", "t0"]).transform(complete)


def primary_predictions(events: DataFrame) -> DataFrame:
    """The primary model bets wherever it has a side: ``pred`` 1 there, else 0."""
    return events.withColumn("pred", F.when(F.coalesce(F.col("side"), F.lit(0)) != 0, 1).otherwise(0))


def last_row(df: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEYS).orderBy(F.desc("ts"), F.desc("seq"))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
