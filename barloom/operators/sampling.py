"""Event sampling: the symmetric CUSUM filter, its threshold, and horizons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, ORDER, col, diff, pct_change
from .fold import fold
from .joins import asof_forward


def cusum_threshold(df: DataFrame, value: str = "close", factor: float = 1.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """``h`` for each key: ``factor`` sample standard deviations of the first differences."""
    return df.withColumn("_d", diff(value)).groupBy(*keys).agg((F.stddev_samp("_d") * factor).alias("h"))


def cusum_events(df: DataFrame, value: str = "close", h: str = "h", keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """The rows at which a one-sided sum of differences passes ``h`` (a column), with ``direction`` (-1, +1).

    The fall is tested first, strictly; only the side that fired is reset."""

    def machine():
        up = down = 0.0
        last = None

        def step(values, limits):
            nonlocal up, down, last
            out = []
            for v, limit in zip(values, limits, strict=True):
                fired = 0
                if v is not None:
                    if last is not None and limit is not None:
                        up, down = max(0.0, up + (v - last)), min(0.0, down + (v - last))
                        if down < -limit:
                            down, fired = 0.0, -1
                        elif up > limit:
                            up, fired = 0.0, 1
                    last = v
                out.append(fired)
            return (out,)

        return step

    return fold(df, machine, [value, h], {"direction": "int"}, keys, order).filter("direction <> 0")


def vertical_barrier(events: DataFrame, bars: DataFrame, horizon: str = "60 minutes", drop_open: bool = False, snap: bool = True) -> DataFrame:
    """``events`` (``symbol, t0, ...``) with ``t1``: the first bar at or after ``t0 + horizon``, or (``snap=False``)
    that time itself.  Where there is no such bar ``t1`` is null, or the event goes."""
    later = F.col("t0") + F.expr(f"INTERVAL {horizon}")
    if not snap:
        return events.withColumn("t1", later)
    out = asof_forward(events.withColumn("_at", later), bars.select("symbol", "ts"), [], at="_at")
    out = out.withColumnRenamed("match_ts", "t1").drop("_at")
    return out.filter("t1 IS NOT NULL") if drop_open else out


def rolling_volatility(df: DataFrame, value: str = "close", span_us: int = 86_400_000_000, out: str = "trgt", keys: Sequence[str] = KEYS) -> DataFrame:
    """Sample standard deviation of simple returns in ``(ts - span, ts]``; null under two."""
    rows = df.withColumn("_r", pct_change(value)).withColumn("_us", F.unix_micros("ts"))
    w = Window.partitionBy(*keys).orderBy("_us").rangeBetween(-(span_us - 1), 0)
    return rows.withColumn(out, F.stddev_samp("_r").over(w)).drop("_r", "_us")


def side_column(side: Column | None = None) -> Column:
    return (side if side is not None else F.lit(1)).cast("int").alias("side")


def make_events(events: DataFrame, volatility: DataFrame, target: str = "trgt", side: str | None = None) -> DataFrame:
    """EVENTS: ``symbol, t0, t1, trgt, side``; the target is the last known at ``t0``, the side 1 unless given."""
    from .joins import asof_backward

    found = asof_backward(events, volatility.select("symbol", "ts", col(target).alias("_v")), ["_v"], at="t0")
    return found.select("symbol", "t0", "t1", F.col("_v").alias("trgt"), side_column(F.col(side) if side else None))
