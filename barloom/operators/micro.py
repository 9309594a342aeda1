"""Microstructure estimators on bars and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KEYS, diff, full, log_return, pair_corr, rows, series
from .weights import ols


def agreement(df: DataFrame, predicted: str, actual: str, keys=()) -> DataFrame:
    """Rows, and the share on which two columns agree."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(predicted) == F.col(actual)).cast("double")).alias("accuracy"))


def roll_model(df: DataFrame, price: str = "price", autocorr: bool = False) -> DataFrame:
    """Half spread ``c = sqrt(-gamma)`` and variance of the unobserved price, gamma the first autocovariance of price
    changes (``autocorr``: their autocorrelation); null where gamma isn't negative."""
    rows_ = df.withColumn("_d", diff(price)).filter("_d IS NOT NULL")
    rows_ = rows_.withColumn("_l", F.lag("_d").over(series()))
    a, b = F.when(F.col("_l").isNotNull(), F.col("_d")), F.col("_l")
    gamma = pair_corr(a, b) if autocorr else F.covar_samp(a, b)
    out = rows_.groupBy(*KEYS).agg(gamma.alias("gamma"), F.var_samp("_d").alias("_v"))
    c2 = F.when(F.col("gamma") < 0, -F.col("gamma"))
    return out.select(*KEYS, "gamma", F.sqrt(c2).alias("half_spread"), (F.col("_v") - 2 * c2).alias("variance"))


def high_low_volatility(bars: DataFrame, window: int = 50, out: str = "hl_vol") -> DataFrame:
    """Parkinson's ``ln(high / low) / sqrt(4 ln 2)`` and its mean over full windows; null for invalid bars."""
    valid = (F.col("high") >= F.col("low")) & (F.col("low") > 0)
    one = bars.withColumn("parkinson", F.when(valid, F.ln(F.col("high") / F.col("low"))) / F.sqrt(4 * F.ln(F.lit(2.0))))
    return one.withColumn(out, full(F.avg, "parkinson", window))


def close_volatility(bars: DataFrame, window: int = 50, least: int = 2, out: str = "c2c_vol") -> DataFrame:
    """Standard deviation of log returns over the last ``window`` bars, from ``least`` values on."""
    r = bars.withColumn("_r", log_return("close"))
    return r.withColumn(out, full(F.stddev_samp, "_r", window, least)).drop("_r")


def volatility_ratio(bars: DataFrame, window: int = 50) -> DataFrame:
    both = close_volatility(high_low_volatility(bars, window), window)
    return both.withColumn("vol_ratio", F.col("c2c_vol") / (F.col("hl_vol") + 1e-12))


def quantile(df: DataFrame, column: str, p: float, keys=KEYS, accuracy: int | None = None) -> DataFrame:
    """The linearly interpolated quantile of each key; with ``accuracy`` a sketch of bounded size."""
    q = F.percentile(column, p) if accuracy is None else F.percentile_approx(column, p, accuracy)
    return df.groupBy(*keys).agg(q.alias("quantile"))


def kyle_lambda(bars: DataFrame) -> DataFrame:
    """OLS of the close's change on order-flow imbalance."""
    return ols(bars.withColumn("_dc", diff("close")), "_dc", "ofi")


def amihud_lambda(bars: DataFrame) -> DataFrame:
    """OLS of the absolute log return on the value traded."""
    return ols(bars.withColumns({"_ar": F.abs(log_return("close")), "_value": F.col("vwap") * F.col("volume")}), "_ar", "_value")


def vpin(bars: DataFrame, window: int = 50, out: str = "vpin") -> DataFrame:
    """Volume-synchronised probability of informed trading: absolute buy-sell difference over volume, summed over full windows."""
    s = F.try_divide(F.col("ofi"), F.nullif(F.col("volume"), F.lit(0.0)))
    bought = (s + 1) / 2 * F.col("volume")
    rows_ = bars.withColumn("_gap", F.abs(bought - (F.col("volume") - bought)))
    return rows_.withColumn(out, F.try_divide(full(F.sum, "_gap", window), F.nullif(full(F.sum, "volume", window), F.lit(0.0)))).drop("_gap")


def rolling(df: DataFrame, fn, column: str, n: int, out: str, least: int | None = None) -> DataFrame:
    """Any aggregate function over the last ``n`` rows."""
    return df.withColumn(out, full(fn, column, n, least))


def rolling_apply(df: DataFrame, fn, column: str, n: int, out: str) -> DataFrame:
    """``fn`` (array column to column) of the list of the last ``n`` values, null until it is full."""
    values = F.collect_list(column).over(rows(n))
    listed: Column = F.when(F.size(values) == n, values)
    return df.withColumn("_list", listed).withColumn(out, F.when(F.col("_list").isNotNull(), fn(F.col("_list")))).drop("_list")
