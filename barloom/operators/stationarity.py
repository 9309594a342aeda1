"""Unit-root and cointegration tests, Jarque-Bera, the scan for the least differencing, sine fits.

Tests run once for each key (and order of differencing) over a series that fits one task.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import KEYS
from .fracdiff import ffd_weights

#: MacKinnon's (1994) response surfaces for the distribution of the test statistic with a constant, for 1
#: and 2 series: (least, split, most, polynomial below the split, polynomial above it), lowest power first.
MACKINNON = {
    1: (-18.83, -1.61, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (-18.86, -2.62, 0.92, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}


def mackinnon_p(stat: float, series: int = 1) -> float:
    least, split, most, low, high = MACKINNON[series]
    if stat > most:
        return 1.0
    if stat < least:
        return 0.0
    return NormalDist().cdf(sum(c * stat**k for k, c in enumerate(low if stat <= split else high)))


def _fit(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, standard errors and residual sum of squares of least squares."""
    q, r = np.linalg.qr(x)
    b = np.linalg.solve(r, q.T @ y)
    e = y - x @ b
    sse = float(e @ e)
    inverse = np.linalg.inv(r)
    return b, np.sqrt(np.maximum(0, (inverse * inverse).sum(1) * sse / max(1, len(y) - x.shape[1]))), sse


def _design(x: np.ndarray, lags: int, constant: bool) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(x)
    n = len(d) - lags
    columns = [x[lags:-1], *(d[lags - k : lags - k + n] for k in range(1, lags + 1))]
    if constant:
        columns.append(np.ones(n))
    return d[lags:], np.stack(columns, 1)


def default_lags(n: int, constant: bool = True) -> int:
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - constant - 1))


def adf_test(x: np.ndarray, lags: int | None = None, choose: bool = True, constant: bool = True) -> dict:
    """Augmented Dickey-Fuller: statistic, p-value, lags used, observations.  ``choose`` takes the number of lags up to
    ``lags`` (a rule of the length by default) with the least AIC on a common sample; else all of them are used."""
    x = np.asarray(x, float)
    most = default_lags(len(x), constant) if lags is None else lags
    if len(x) < most + 4 or np.ptp(x) == 0:
        return {"stat": None, "p_value": None, "lags": None, "n": len(x)}
    used = most
    if choose and most:
        y, full = _design(x, most, constant)
        best = None
        for k in range(most + 1):
            part = np.concatenate([full[:, : 1 + k], full[:, 1 + most :]], 1)
            _, _, sse = _fit(y, part)
            n = len(y)
            aic = n * math.log(max(sse, 1e-300) / n) + 2 * part.shape[1]
            if best is None or aic < best[0]:
                best = (aic, k)
        used = best[1]
    y, full = _design(x, used, constant)
    b, se, _ = _fit(y, full)
    stat = float(b[0] / se[0]) if se[0] > 0 else None
    return {"stat": stat, "p_value": None if stat is None or not constant else mackinnon_p(stat), "lags": used, "n": len(y)}


RESULT = "stat double, p_value double, lags int, n long"


def _per_key(df: DataFrame, columns: list[str], schema: str, test, keys=KEYS, order=("ts", "seq")) -> DataFrame:
    """One row for each key from its rows in order."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, table):
        table = table.sort_by([(c, "ascending") for c in order])
        values = [table.column(c).to_numpy() for c in columns]
        found = test(*values)
        got = {k: table.column(k).slice(0, 1) for k in keys}
        return pa.table(got | {c: pa.array([found[c]], {"double": pa.float64(), "int": pa.int32(), "long": pa.int64()}[kind]) for c, kind in (x.split() for x in schema.split(", "))})

    head = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    out = df.na.drop(subset=columns).select(*keys, *order, *columns).groupBy(*keys).applyInArrow(run, f"{head}, {schema}")
    return out.select(*keys, *names)


def adf(df: DataFrame, column: str = "close", lags: int | None = None, choose: bool = True, keys=KEYS, order=("ts", "seq")) -> DataFrame:
    return _per_key(df, [column], RESULT, lambda x: adf_test(x, lags, choose), keys, order)


def cointegration(df: DataFrame, a: str, b: str, keys=KEYS, order=("ts", "seq")) -> DataFrame:
    """Engle-Granger: ``a`` regressed on ``b`` and a constant, then a unit-root test (no constant) of the residuals."""

    def test(y, x):
        design = np.stack([x, np.ones(len(x))], 1)
        if len(y) < 12 or np.ptp(x) == 0:
            return {"stat": None, "p_value": None, "lags": None, "n": len(y)}
        coefficients, _, _ = _fit(y, design)
        found = adf_test(y - design @ coefficients, constant=False)
        return found | {"p_value": None if found["stat"] is None else mackinnon_p(found["stat"], 2)}

    return _per_key(df, [a, b], RESULT, test, keys, order)


def jarque_bera(df: DataFrame, column: str, keys=KEYS) -> DataFrame:
    """``n / 6 * (S ** 2 + K ** 2 / 4)`` with population moments, and its p-value."""
    s, k = F.skewness(column), F.kurtosis(column)
    out = df.groupBy(*keys).agg(F.count(column).alias("n"), (F.count(column) / 6 * (s * s + k * k / 4)).alias("stat"))
    return out.withColumn("p_value", F.exp(-F.col("stat") / 2))


def _ffd_array(x: np.ndarray, d: float, least: float) -> np.ndarray:
    """Nothing where the series is shorter than the window."""
    w = ffd_weights(d, least)[::-1]
    return np.convolve(x, w, "valid") if len(x) >= len(w) else x[:0]


def scan_orders(spark: SparkSession, df: DataFrame, column: str = "close", orders: list[float] | None = None, least: float = 1e-2, order=("ts", "seq"), keys=KEYS) -> DataFrame:
    """``d``, the unit-root test of the series differenced by it, its length and its correlation with the original; one
    task for each key and order."""
    orders = orders or [round(0.1 * k, 10) for k in range(11)]
    grid = F.broadcast(spark.createDataFrame([(float(d),) for d in orders], "d double"))

    def run(key, table):
        table = table.sort_by([(c, "ascending") for c in order])
        x, d = table.column(column).to_numpy(), table.column("d")[0].as_py()
        y = _ffd_array(x, d, least)
        found = adf_test(y) if len(y) > 12 else {"stat": None, "p_value": None, "lags": None}
        z = x[len(x) - len(y) :]
        corr = float(np.corrcoef(z, y)[0, 1]) if len(y) > 2 and np.ptp(y) > 0 and np.ptp(z) > 0 else None
        return pa.table({k: table.column(k).slice(0, 1) for k in keys} | {"d": pa.array([d]), "stat": pa.array([found["stat"]], pa.float64()), "p_value": pa.array([found["p_value"]], pa.float64()), "lags": pa.array([found["lags"]], pa.int32()), "n": pa.array([len(y)], pa.int64()), "corr": pa.array([corr], pa.float64())})

    head = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.na.drop(subset=[column]).select(*keys, *order, column).crossJoin(grid).groupBy(*keys, "d").applyInArrow(run, f"{head}, d double, {RESULT}, corr double")


def least_order(scan: DataFrame, level: float = 0.05, keys=KEYS) -> DataFrame:
    """The smallest order whose test rejects a unit root."""
    return scan.groupBy(*keys).agg(F.min(F.when(F.col("p_value") < level, F.col("d"))).alias("d"))


def fit_sine(y: np.ndarray, period: float = 50.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Least squares of ``A sin(w t + phi) + C`` by Levenberg-Marquardt from (1, 2 pi / period, 0, 0); parameters and R2."""
    t, p, damp = np.arange(len(y), dtype=float), np.array([1.0, 2 * math.pi / period, 0.0, 0.0]), 1e-3

    def residual(p):
        return y - (p[0] * np.sin(p[1] * t + p[2]) + p[3])

    e = residual(p)
    for _ in range(rounds):
        angle = p[1] * t + p[2]
        j = np.stack([np.sin(angle), p[0] * t * np.cos(angle), p[0] * np.cos(angle), np.ones(len(t))], 1)
        a, g = j.T @ j, j.T @ e
        step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0]
        tried = residual(p + step)
        if tried @ tried < e @ e:
            small = e @ e - tried @ tried < 1e-14 * (e @ e + 1e-300)
            p, e, damp = p + step, tried, damp / 3
            if small:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    total = float(((y - y.mean()) ** 2).sum())
    return p, 1 - float(e @ e) / total if total > 0 else math.nan


def sine_sweep(spark: SparkSession, df: DataFrame, column: str = "value", orders: list[float] | None = None, least: float = 1e-2, period: float = 50.0, keys=KEYS, order=("seq",)) -> DataFrame:
    """R2 of a sine fitted to the series differenced by each order; null where it can't be fitted."""
    orders = orders or [round(0.05 * k, 10) for k in range(41)]
    grid = F.broadcast(spark.createDataFrame([(float(d),) for d in orders], "d double"))

    def run(key, table):
        table = table.sort_by([(c, "ascending") for c in order])
        d = table.column("d")[0].as_py()
        y = _ffd_array(table.column(column).to_numpy(), d, least)
        r2 = None
        if len(y) > 8 and np.ptp(y) > 1e-12:
            try:
                found = fit_sine(y, period)[1]
                r2 = found if math.isfinite(found) else None
            except np.linalg.LinAlgError:
                r2 = None
        return pa.table({k: table.column(k).slice(0, 1) for k in keys} | {"d": pa.array([d]), "r2": pa.array([r2], pa.float64())})

    head = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.na.drop(subset=[column]).select(*keys, *order, column).crossJoin(grid).groupBy(*keys, "d").applyInArrow(run, f"{head}, d double, r2 double")


def best_order(sweep: DataFrame, keys=KEYS) -> DataFrame:
    return sweep.filter("r2 IS NOT NULL").groupBy(*keys).agg(F.max_by("d", F.struct("r2", -F.col("d"))).alias("d"), F.max("r2").alias("r2"))
