"""Mean-reverting prices: estimation, simulated trading rules and the best of them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import KEYS, diff, series


def estimate_ou(df: DataFrame, column: str = "close", least: int = 20, keys=KEYS) -> DataFrame:
    """``phi, mean, sigma, half_life`` of ``P(t) = (1 - phi) mean + phi P(t-1) + sigma e``, by regression of changes on the last price.

    Sigma is the population deviation of the residuals; the half-life is null unless 0 < phi < 1; all are null under ``least`` changes."""
    w = series(keys)
    d = df.withColumns({"_x": F.lag(column).over(w), "_y": diff(column, w)}).filter("_x IS NOT NULL AND _y IS NOT NULL")
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("_y", "_x").alias("_b"), F.regr_intercept("_y", "_x").alias("_a"), F.regr_syy("_y", "_x").alias("_syy"), F.regr_sxy("_y", "_x").alias("_sxy"))
    enough = F.col("n") >= least
    phi = F.when(enough, 1 + F.col("_b"))
    out = s.withColumns({"phi": phi, "mean": F.when(enough, F.try_divide(-F.col("_a"), F.nullif(F.col("_b"), F.lit(0.0)))), "sigma": F.when(enough, F.sqrt(F.greatest(F.col("_syy") - F.col("_b") * F.col("_sxy"), F.lit(0.0)) / F.col("n")))})
    return out.select(*keys, "n", "phi", "mean", "sigma", F.when((F.col("phi") > 0) & (F.col("phi") < 1), -math.log(2) / F.ln("phi")).alias("half_life"))


def with_fallback(estimates: DataFrame, df: DataFrame, column: str = "close", half_life: float = 50.0, keys=KEYS) -> DataFrame:
    """Where there is no estimate: the mean price, the deviation of its changes and a fixed half-life."""
    d = df.withColumn("_d", diff(column)).groupBy(*keys).agg(F.avg(column).alias("_m"), F.stddev_samp("_d").alias("_s"))
    return estimates.join(d, list(keys)).withColumns({"mean": F.coalesce("mean", "_m"), "sigma": F.coalesce("sigma", "_s"), "half_life": F.coalesce("half_life", F.lit(half_life))}).drop("_m", "_s")


def rule_grid(sigma: float, points: int = 10, least: float = 0.5, most: float = 3.0) -> list[float]:
    return [float(x) for x in np.linspace(least * sigma, most * sigma, points)]


STATS = "pt double, sl double, n long, total double, squares double"


def simulate_rules(spark: SparkSession, forecast: float, half_life: float, sigma: float, takes: list[float], stops: list[float], paths: int = 10_000, longest: int = 200, start: float = 0.0, seed: int = 0, short: bool = False, block: int = 2000) -> DataFrame:
    """Mean, population deviation and Sharpe ratio of the profit of every (take, stop) pair over simulated paths.

    A position is left when its profit is above ``take``, below ``-stop``, or after more than ``longest`` steps.  All pairs see the
    same paths; blocks of paths are tasks, each seeded by its number, and only sums leave them."""
    phi = 2 ** (-1 / half_life)
    pt, sl = np.array(takes), np.array(stops)
    sign = -1.0 if short else 1.0

    def run(batches):
        for b in batches:
            for number, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rng = np.random.default_rng([seed, number])
                price, profit = np.full(n, start), np.empty((longest + 1, n))
                for step in range(longest + 1):
                    price = (1 - phi) * forecast + phi * price + sigma * rng.standard_normal(n)
                    profit[step] = sign * (price - start)
                # the first step above each take and below each stop (profit extremes only grow)
                up, down = np.maximum.accumulate(profit), np.minimum.accumulate(profit)
                first_up = np.stack([(up <= t).sum(0) for t in pt])
                first_down = np.stack([(down >= -s).sum(0) for s in sl])
                out = ([], [], [], [], [])
                for i, t in enumerate(pt):
                    for j, s in enumerate(sl):
                        at = np.minimum(np.minimum(first_up[i], first_down[j]), longest)
                        got = profit[at, np.arange(n)]
                        for column, v in zip(out, (t, s, n, got.sum(), (got * got).sum())):
                            column.append(float(v) if column is not out[2] else int(v))
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(out[2], pa.int64()), pa.array(out[3]), pa.array(out[4])], names=["pt", "sl", "n", "total", "squares"])

    blocks = math.ceil(paths / block)
    tasks = spark.range(0, blocks, 1, blocks).select("id", F.least(F.lit(block), F.lit(paths) - F.col("id") * block).cast("int").alias("n"))
    sums = tasks.mapInArrow(run, STATS).groupBy("pt", "sl").agg(F.sum("n").alias("n"), F.sum("total").alias("_t"), F.sum("squares").alias("_q"))
    mean = F.col("_t") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("_q") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.select("pt", "sl", "n", mean.alias("mean"), sd.alias("deviation"), F.try_divide(mean, F.nullif(sd, F.lit(0.0))).alias("sharpe"))


def heat_map(results: DataFrame, stops: list[float]) -> DataFrame:
    """One row for each take, one column for each stop."""
    wide = results.withColumn("_c", F.concat(F.lit("sl_"), F.round("sl", 6).cast("string"))).groupBy("pt")
    return wide.pivot("_c", sorted({f"sl_{round(s, 6)}" for s in stops})).agg(F.first("sharpe"))


def best_rule(results: DataFrame, take: float | None = None, stop: float | None = None) -> DataFrame:
    """The pair with the largest Sharpe ratio, perhaps with one side fixed."""
    r = results.filter("sharpe IS NOT NULL")
    if take is not None:
        r = r.filter(F.abs(F.col("pt") - take) < 1e-9)
    if stop is not None:
        r = r.filter(F.abs(F.col("sl") - stop) < 1e-9)
    pick = F.max_by(F.struct("pt", "sl"), F.struct("sharpe", -F.col("pt"), -F.col("sl")))
    return r.agg(pick.alias("r"), F.max("sharpe").alias("sharpe")).select("r.pt", "r.sl", "sharpe")
