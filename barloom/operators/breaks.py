"""Structural breaks: CUSUM tests, Chow-type and supremum Dickey-Fuller tests, martingale tests.

Recursive regressions come from running sums (one window pass); only the tests over pairs of
start and end points run as tasks of their own, one for each key and block of end points, where
the sums of all starts are run back from each end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, log_return, series
from .stationarity import _design, _fit, default_lags


def ar1_design(bars: DataFrame, close: str = "close") -> DataFrame:
    """Log returns ``y`` beside the last one, ``x``; rows without both go."""
    r = bars.withColumn("y", log_return(close))
    return r.withColumn("x", F.lag("y").over(series())).filter("y IS NOT NULL AND x IS NOT NULL")


def _running(names: dict, w) -> dict:
    return {k: F.sum(v).over(w) for k, v in names.items()}


def recursive_cusum(design: DataFrame, start: int = 1000) -> DataFrame:
    """Brown-Durbin-Evans: from row ``start`` on, the standardised one-step-ahead error of the regression of ``y`` on ``x``
    and a constant over all rows before, and its cumulated sum over its overall deviation (``cusum``)."""
    key = Window.partitionBy(*KEYS)
    before = series().rowsBetween(Window.unboundedPreceding, -1)
    # centred by the key's own means, so that the sums don't cancel
    c = design.withColumns({"_my": F.avg("y").over(key), "_mx": F.avg("x").over(key), "_n": F.row_number().over(series()) - 1})
    c = c.withColumns({"_y": F.col("y") - F.col("_my"), "_x": F.col("x") - F.col("_mx")})
    c = c.withColumns(_running({"_sx": F.col("_x"), "_sy": F.col("_y"), "_sxx": F.col("_x") * F.col("_x"), "_sxy": F.col("_x") * F.col("_y"), "_syy": F.col("_y") * F.col("_y")}, before))
    n = F.col("_n")
    mx, my = F.try_divide(F.col("_sx"), F.nullif(n, F.lit(0))), F.try_divide(F.col("_sy"), F.nullif(n, F.lit(0)))
    c = c.withColumns({"_ax": mx, "_ay": my, "_cxx": F.col("_sxx") - F.col("_sx") * mx, "_cxy": F.col("_sxy") - F.col("_sx") * my, "_cyy": F.col("_syy") - F.col("_sy") * my})
    slope = F.try_divide(F.col("_cxy"), F.nullif(F.col("_cxx"), F.lit(0.0)))
    c = c.withColumn("_b", slope)
    error = F.col("_y") - F.col("_ay") - F.col("_b") * (F.col("_x") - F.col("_ax"))
    mse = F.try_divide(F.col("_cyy") - F.col("_b") * F.col("_cxy"), F.nullif(n - 2, F.lit(0)))
    leverage = F.lit(1.0) + F.try_divide(F.lit(1.0), F.nullif(n, F.lit(0))) + F.try_divide((F.col("_x") - F.col("_ax")) * (F.col("_x") - F.col("_ax")), F.nullif(F.col("_cxx"), F.lit(0.0)))
    out = c.withColumn("error", F.when(n >= start, F.try_divide(error, F.nullif(F.sqrt(F.greatest(mse, F.lit(0.0)) * leverage), F.lit(0.0))))).filter("error IS NOT NULL")
    total = F.sum("error").over(series().rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("cusum", F.try_divide(total, F.nullif(F.stddev_samp("error").over(key), F.lit(0.0))))
    return out.select(*KEYS, "ts", "seq", "error", "cusum")


def csw_statistic(bars: DataFrame, window: int = 2000, least: int = 20, close: str = "close", block: int = 5000, order=("ts", "seq")) -> DataFrame:
    """Chu-Stinchcombe-White: at each row with ``window`` rows before it, the largest standardised departure of the last of
    them from any earlier one that leaves ``least`` behind it.  Each pair costs O(1) by prefix sums.

    Rows are numbered, cut into blocks of ``block`` and each block is given the ``window`` rows before it, so a long series is many tasks."""
    numbered = bars.withColumn("_i", F.row_number().over(series()) - 1).select(*KEYS, *order, F.col(close).alias("_v"), "_i")
    blocks = F.sequence(F.floor(F.col("_i") / block), F.floor((F.col("_i") + window) / block))
    dealt = numbered.withColumn("_b", F.explode(blocks))

    def run(key, table):
        table = table.sort_by("_i")
        i, v = table.column("_i").to_numpy(), table.column("_v").to_numpy()
        own = np.flatnonzero((i // block == key[-1].as_py()) & (i >= window))
        d = np.diff(v)
        s1, s2 = np.concatenate([[0.0], np.cumsum(d)]), np.concatenate([[0.0], np.cumsum(d * d)])
        best, at = np.full(len(own), np.nan), np.full(len(own), -1)
        for k, t in enumerate(own):
            last, n = t - 1, np.arange(t - window, t - least)
            m = last - n
            a, b = s1[last] - s1[n], s2[last] - s2[n]
            var = np.maximum(0, (b - a * a / m) / (m - 1))
            with np.errstate(divide="ignore", invalid="ignore"):
                stat = np.where(var > 0, (v[last] - v[n]) / np.sqrt(var * (m + 1)), -np.inf)
            j = int(np.argmax(stat))
            best[k], at[k] = stat[j], m[j]
        pick = pa.array(own)
        return pa.table({c: table.column(c).take(pick) for c in (*KEYS, *order)} | {"csw": pa.array(best, mask=~np.isfinite(best)), "reach": pa.array(at, pa.int64())})

    head = ", ".join(f"{k} {bars.schema[k].dataType.simpleString()}" for k in (*KEYS, *order))
    return dealt.groupBy(*KEYS, "_b").applyInArrow(run, f"{head}, csw double, reach long")


def chow_dickey_fuller(bars: DataFrame, trim: float = 0.15, close: str = "close") -> DataFrame:
    """At each break date between ``trim`` and ``1 - trim`` of a series: the t statistic of delta in
    ``dy = delta * y(t-1) * [t >= date]`` (no constant), by suffix sums."""
    w = series()
    d = bars.withColumns({"_y": F.col(close) - F.lag(close).over(w), "_x": F.lag(close).over(w)}).filter("_x IS NOT NULL")
    key, after = Window.partitionBy(*KEYS), w.rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumns({"_n": F.count("*").over(key), "_i": F.row_number().over(w) - 1, "_syy": F.sum(F.col("_y") * F.col("_y")).over(key)})
    d = d.withColumns({"_sxx": F.sum(F.col("_x") * F.col("_x")).over(after), "_sxy": F.sum(F.col("_x") * F.col("_y")).over(after)})
    delta = F.try_divide(F.col("_sxy"), F.nullif(F.col("_sxx"), F.lit(0.0)))
    s2 = F.try_divide(F.col("_syy") - delta * F.col("_sxy"), F.nullif(F.col("_n") - 1, F.lit(0)))
    t = F.try_divide(delta, F.nullif(F.sqrt(F.try_divide(F.greatest(s2, F.lit(0.0)), F.nullif(F.col("_sxx"), F.lit(0.0)))), F.lit(0.0)))
    inside = (F.col("_i") >= F.floor(F.col("_n") * trim)) & (F.col("_i") < F.ceil(F.col("_n") * (1 - trim)))
    return d.filter(inside).select(*KEYS, "ts", "seq", delta.alias("delta"), t.alias("sdfc"))


def supremum(df: DataFrame, column: str, keys=KEYS) -> DataFrame:
    """The largest value and its time."""
    return df.groupBy(*keys).agg(F.max(column).alias("sup"), F.max_by("ts", F.struct(column, F.col("ts"))).alias("at"))


def _by_end(df: DataFrame, column: str, ends: int, first: int, step: int, fn, out: tuple[str, ...], order=("ts", "seq")) -> DataFrame:
    """``fn(values up to the end)``, a value for each name in ``out``, for each end point from ``first`` on (every ``step``-th), in
    blocks of ``ends`` of them; the series goes to each block up to its last end point."""
    numbered = df.na.drop(subset=[column]).withColumn("_i", F.row_number().over(series()) - 1)
    n = F.count("*").over(Window.partitionBy(*KEYS))
    numbered = numbered.withColumn("_last", F.floor((n - 1) / ends))
    dealt = numbered.select(*KEYS, *order, F.col(column).alias("_v"), "_i", F.explode(F.sequence(F.floor(F.col("_i") / ends), F.col("_last"))).alias("_b"))

    def run(key, table):
        table = table.sort_by("_i")
        v, b = table.column("_v").to_numpy(), key[-1].as_py()
        own = np.array([i for i in range(b * ends, min(len(v), (b + 1) * ends)) if i >= first and (i - first) % step == 0], np.int64)
        found = [fn(v[: i + 1]) for i in own]
        pick = pa.array(own, pa.int64())
        return pa.table({c: table.column(c).take(pick) for c in (*KEYS, *order)} | {name: pa.array([x[k] for x in found], pa.float64()) for k, name in enumerate(out)})

    head = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in (*KEYS, *order))
    return dealt.groupBy(*KEYS, "_b").applyInArrow(run, f"{head}, " + ", ".join(f"{name} double" for name in out))


def _adf_t(x: np.ndarray, lags: int | None) -> float | None:
    lags = default_lags(len(x)) if lags is None else lags
    if len(x) < lags + 5 or np.ptp(x) == 0:
        return None
    y, design = _design(x, lags, True)
    b, se, _ = _fit(y, design)
    return float(b[0] / se[0]) if se[0] > 0 else None


def _suffix(a: np.ndarray) -> np.ndarray:
    """Sums from each row to the last."""
    return np.cumsum(a[::-1], axis=0)[::-1]


def _adf_starts(x: np.ndarray, lags: int, shortest: int, start_step: int = 1) -> np.ndarray:
    """The statistics of ``_adf_t(x[s:], lags)`` for every ``start_step``-th start ``s`` that leaves ``shortest`` values, less those
    without one.  The normal equations of all starts are running sums from the end back, of values centred at the last."""
    x = np.asarray(x, float)
    shortest = max(shortest, lags + 5)
    if len(x) < shortest:
        return np.empty(0)
    y, z = _design(x - x[-1], lags, False)
    z = np.column_stack([z, y])
    starts = np.arange(0, len(x) - shortest + 1, start_step)
    n = (len(z) - starts).astype(float)
    sums = _suffix(z)[starts]
    moments = _suffix(z[:, :, None] * z[:, None, :])[starts] - sums[:, :, None] * sums[:, None, :] / n[:, None, None]
    # with the lags swept out first, what is left of the level and the target is a regression on one column
    moved = np.concatenate([np.arange(1, lags + 1), [0, lags + 1]])
    moments = moments[:, moved][:, :, moved]
    scale = np.sqrt(np.maximum(np.einsum("kii->ki", moments), 0))
    varies = (scale[:, :-1] > 0).all(1)
    scale = np.where(scale > 0, scale, 1)
    moments = (moments / (scale[:, :, None] * scale[:, None, :]))[varies]
    for k in range(lags):
        pivot = moments[:, k, k]
        moments = moments - moments[:, :, k, None] * (moments[:, k, :] / np.where(pivot > 0, pivot, np.inf)[:, None])[:, None, :]
    sxx, sxy, syy = moments[:, -2, -2], moments[:, -2, -1], moments[:, -1, -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = sxy / np.sqrt(sxx * np.maximum(0, syy - sxy * sxy / sxx) / np.maximum(1, n[varies] - lags - 2))
    return t[np.isfinite(t)]


def expanding_adf(df: DataFrame, column: str = "close", first: int = 1000, lags: int | None = None, step: int = 1, ends: int = 64) -> DataFrame:
    """The Dickey-Fuller t statistic over all values up to each row (no choice of lags)."""
    return _by_end(df, column, ends, first, step, lambda x: (_adf_t(x, lags),), ("adf",))


def supremum_adf(df: DataFrame, column: str = "close", first: int = 100, lags: int = 1, step: int = 1, shortest: int = 100, start_step: int = 1, ends: int = 64) -> DataFrame:
    """SADF: at each row the largest statistic over all start points that leave ``shortest`` values."""

    def sup(x):
        found = _adf_starts(x, lags, shortest, start_step)
        return (float(found.max()) if len(found) else None,)

    return _by_end(df, column, ends, first, step, sup, ("sadf",))


def quantile_adf(df: DataFrame, column: str = "close", first: int = 100, lags: int = 1, q: float = 0.95, step: int = 1, shortest: int = 100, start_step: int = 1, ends: int = 64) -> DataFrame:
    """QADF (the ``q`` quantile over start points) and CADF (mean and deviation of those at or above it) at each row."""

    def tail(x):
        found = _adf_starts(x, lags, shortest, start_step)
        if not len(found):
            return None, None, None
        cut = float(np.quantile(found, q))
        top = found[found >= cut]
        return cut, float(top.mean()), float(top.std())

    return _by_end(df, column, ends, first, step, tail, ("qadf", "cadf", "cadf_std"))


def tail_of_scores(df: DataFrame, column: str, q: float = 0.95, keys=KEYS) -> DataFrame:
    """The ``q`` quantile of a column, and mean and deviation of what is above it."""
    cut = df.groupBy(*keys).agg(F.percentile(column, q).alias("cut"))
    return df.join(cut, list(keys)).groupBy(*keys, "cut").agg(F.avg(F.when(F.col(column) > F.col("cut"), F.col(column))).alias("tail_mean"), F.stddev_samp(F.when(F.col(column) > F.col("cut"), F.col(column))).alias("tail_std"))


def _trend_starts(y: np.ndarray, kind: str, penalty: float, shortest: int, start_step: int = 1) -> np.ndarray:
    """``|beta| / (se * length ** penalty)`` of the trend fitted to ``y[s:]``, for every ``start_step``-th start ``s`` that leaves
    ``shortest`` values, less those without one.  The sums of all starts run from the end back."""
    y = np.asarray(y, float)
    starts = np.arange(0, len(y) - max(shortest, 4) + 1, start_step)
    if kind != "poly1":
        # logarithms: no start at or before the last value that has none
        none = np.flatnonzero(y <= 0)
        starts = starts[starts > (none[-1] if len(none) else -1)]
        y = np.log(np.where(y > 0, y, 1))
    if not len(starts):
        return np.empty(0)
    y = y - y[-1]
    length = len(y) - np.arange(len(y), dtype=float)
    s0, s2 = _suffix(y), _suffix(y * y)
    syy = s2 - s0 * s0 / length
    if kind == "power":
        u = np.log(np.arange(1, len(y) + 1))
        u1, u2 = np.cumsum(u)[::-1], np.cumsum(u * u)[::-1]
        # the clock restarts with each start, so its products with the values are no running sum
        uy = np.correlate(y, u, "full")[len(y) - 1 :]
        fits = [(u2 - u1 * u1 / length, uy - u1 * s0 / length)]
    else:
        # polynomials of the time that are orthogonal over the span; the last one is the trend tested
        back = length - 1
        half = back / 2
        b1, b2 = _suffix(back * y), _suffix(back * back * y)
        fits = [(length * (length**2 - 1) / 12, half * s0 - b1)]
        if kind != "exp":
            fits.append((length * (length**2 - 1) * (length**2 - 4) / 180, half**2 * s0 - 2 * half * b1 + b2 - (length**2 - 1) / 12 * s0))
    with np.errstate(divide="ignore", invalid="ignore"):
        sse = np.maximum(0, syy - sum(c * c / q for q, c in fits))
        q, c = fits[-1]
        t = np.abs(c / q) / (np.sqrt(sse / np.maximum(1, length - len(fits) - 1) / q) * length**penalty)
    t = t[starts]
    return t[np.isfinite(t)]


def martingale_test(df: DataFrame, column: str = "close", kind: str = "poly1", penalty: float = 0.0, first: int = 100, shortest: int = 50, step: int = 10, start_step: int = 10, ends: int = 640) -> DataFrame:
    """Sub- and super-martingale test: at each end the largest ``|beta| / (se * length ** penalty)`` over start points,
    of a quadratic (``poly1``), log-quadratic (``poly2``), exponential (``exp``) or power (``power``) trend."""

    def sup(y):
        found = _trend_starts(y, kind, penalty, shortest, start_step)
        return (float(found.max()) if len(found) else None,)

    return _by_end(df, column, ends, first, step, sup, ("smt",))


def critical_value(df: DataFrame, column: str, q: float = 0.99, keys=KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.percentile(column, q).alias("critical"))


