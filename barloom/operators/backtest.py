"""Backtest statistics, probabilistic and deflated Sharpe ratios, and strategy risk."""

from __future__ import annotations

import math
from functools import reduce
from itertools import chain
from operator import add
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS, pair_corr, running, series
from ..functions.normal import norm_cdf
from .fold import fold

EULER = 0.5772156649015329


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def hhi(x: Column, empty_sum: float | None = None) -> Column:
    """Concentration of shares, 0 (even) to 1; null for two values or fewer, ``empty_sum`` if they sum to 0."""
    n = F.count(x)
    raw = _ratio(F.sum(x * x), F.sum(x) * F.sum(x))
    return F.when(n > 2, F.coalesce((raw - 1 / n) / (1 - 1 / n), F.lit(empty_sum)))


def concentration(df: DataFrame, column: str = "ret", keys=KEYS) -> DataFrame:
    """``hhi_positive`` (returns of 0 and more) and ``hhi_negative``."""
    x = F.col(column)
    return df.groupBy(*keys).agg(hhi(F.when(x >= 0, x)).alias("hhi_positive"), hhi(F.when(x < 0, x)).alias("hhi_negative"))


def time_concentration(df: DataFrame, with_empty_days: bool = True, keys=KEYS) -> DataFrame:
    """Concentration of the number of bets over days, with or without the days between first and last that have none."""
    days = df.groupBy(*keys, F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    if with_empty_days:
        span = days.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b"))
        calendar = span.select(*keys, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day"))
        days = calendar.join(days, [*keys, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return days.groupBy(*keys).agg(hhi(F.col("n").cast("double"), 0.0).alias("hhi_time"))


def equity(df: DataFrame, column: str = "ret", keys=KEYS) -> DataFrame:
    """``equity``: the compounded growth of 1 (null from a loss of all on)."""

    def machine():
        # sums of 16 ** k logarithms each: the exponential shows the error of a sum that is carried from row to row
        levels, lost = [[]], False

        def step(values):
            nonlocal lost
            out = []
            for v in values:
                lost = lost or (v is not None and v <= -1)
                levels[0].append(math.log(1 + v) if v is not None and not lost else 0.0)
                k = 0
                while len(levels[k]) == 16:
                    if k + 1 == len(levels):
                        levels.append([])
                    levels[k + 1].append(reduce(add, levels[k], 0.0))
                    levels[k] = []
                    k += 1
                total = reduce(add, chain.from_iterable(reversed(levels)), 0.0)
                out.append(None if lost else math.exp(total) if not total > 709 else float(np.exp(total)))
            return (out,)

        return step

    return fold(df, machine, [column], {"equity": "double"}, keys)


def high_water_drawdowns(df: DataFrame, column: str = "equity", dollars: bool = False, keys=KEYS) -> DataFrame:
    """One row for each high-water mark that was followed by a lower value: the depth below it (``dollars``, or relative to it) and the
    days until the next such mark (null for the last)."""
    marks = df.withColumn("hwm", F.max(column).over(running(keys)))
    by = marks.groupBy(*keys, "hwm").agg(F.min(column).alias("_low"), F.min("ts").alias("start")).filter(F.col("hwm") > F.col("_low"))
    depth = F.col("hwm") - F.col("_low") if dollars else 1 - _ratio(F.col("_low"), F.col("hwm"))
    w = Window.partitionBy(*keys).orderBy("start")
    days = (F.lead(F.unix_micros("start")).over(w) - F.unix_micros("start")) / 86_400e6
    return by.select(*keys, "start", "hwm", depth.alias("drawdown"), days.alias("days_under_water"))


def drawdowns(df: DataFrame, column: str = "equity", keys=KEYS) -> DataFrame:
    """Each row's relative drawdown from the running maximum."""
    return df.withColumn("drawdown", 1 - _ratio(F.col(column), F.max(column).over(running(keys))))


def under_water_runs(df: DataFrame, keys=KEYS) -> DataFrame:
    """Length in rows and greatest depth of each run of rows with a drawdown."""
    w = series(keys)
    under = (F.col("drawdown") > 0).cast("int")
    marked = df.withColumn("_u", under).withColumn("_new", F.when((F.col("_u") == 1) & (F.coalesce(F.lag("_u").over(w), F.lit(0)) == 0), 1).otherwise(0))
    marked = marked.withColumn("run", F.sum("_new").over(running(keys))).filter("_u = 1")
    return marked.groupBy(*keys, "run").agg(F.min("ts").alias("start"), F.count("*").alias("length"), F.max("drawdown").alias("depth"))


def quantile_of(df: DataFrame, column: str, p: float = 0.95, keys=KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.percentile(column, p).alias(f"{column}_quantile"))


def performance(df: DataFrame, column: str = "ret", underlying: str | None = None, year_days: int = 365, calendar_days: bool = True, keys=KEYS) -> DataFrame:
    """Annualised return, Sharpe and information ratios, hit ratio, mean hit and miss.

    Periods a year are the mean number of rows on a day (all days from first to last, or those with rows) times ``year_days``."""
    x = F.col(column)
    excess = x - F.col(underlying) if underlying else x
    days = (F.datediff(F.max("ts"), F.min("ts")) + 1) if calendar_days else F.count_distinct(F.to_date("ts"))
    out = df.groupBy(*keys).agg(
        F.count(x).alias("n"),
        (F.count(x) / days * year_days).alias("periods"),
        F.avg(x).alias("_m"),
        F.stddev_samp(x).alias("_s"),
        F.avg(excess).alias("_em"),
        F.stddev_samp(excess).alias("_es"),
        F.avg((x > 0).cast("double")).alias("hit_ratio"),
        F.avg(F.when(x > 0, x)).alias("mean_hit"),
        F.avg(F.when(x < 0, x)).alias("mean_miss"),
    )
    root = F.sqrt("periods")
    return out.select(*keys, "n", "periods", (F.pow(1 + F.col("_m"), F.col("periods")) - 1).alias("annual_return"), (_ratio(F.col("_m"), F.col("_s")) * root).alias("sharpe"), (_ratio(F.col("_em"), F.col("_es")) * root).alias("information_ratio"), "hit_ratio", "mean_hit", "mean_miss")


def sharpe(df: DataFrame, column: str = "ret", periods: float | None = 252, keys=KEYS) -> DataFrame:
    """Mean over sample deviation, annualised unless ``periods`` is None; without deviation 0 or infinite, by the mean."""
    m, s = F.avg(column), F.stddev_samp(column)
    flat = F.when(m == 0, F.lit(0.0)).otherwise(F.signum(m) * F.lit(float("inf")))
    value = F.when(s == 0, flat).otherwise(_ratio(m, s) * F.lit(math.sqrt(periods) if periods else 1.0))
    return df.groupBy(*keys).agg(value.alias("sharpe"))


def probabilistic_sharpe(sr: Column, benchmark: Column | float, n: Column, skew: Column, kurtosis: Column) -> Column:
    """Chance that the true ratio is above the benchmark; all ratios per period, ``kurtosis`` 3 for a normal."""
    variance = 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr
    return norm_cdf((sr - benchmark) * F.sqrt(n - 1) / F.sqrt(F.when(variance > 0, variance)))


def psr(df: DataFrame, column: str = "ret", benchmark: float = 0.0, keys=KEYS) -> DataFrame:
    """Each key's per-period Sharpe ratio and the probability that it is above ``benchmark`` (per period)."""
    out = df.groupBy(*keys).agg(F.count(column).alias("n"), _ratio(F.avg(column), F.stddev_samp(column)).alias("sr"), F.skewness(column).alias("skew"), (F.kurtosis(column) + 3).alias("kurtosis"))
    return out.withColumn("psr", probabilistic_sharpe(F.col("sr"), F.lit(float(benchmark)), F.col("n"), F.col("skew"), F.col("kurtosis")))


def psr_annualised(df: DataFrame, column: str = "ret", annual_benchmark: float = 0.0, year_periods: float = 252.0, keys=KEYS) -> DataFrame:
    """As ``psr``, with the benchmark given a year."""
    return psr(df, column, annual_benchmark / math.sqrt(year_periods), keys)


def expected_best_sharpe(variance: float, trials: int) -> float:
    """The expected largest of ``trials`` independent ratios with this variance and no skill."""
    inv = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * inv(1 - 1 / trials) + EULER * inv(1 - 1 / (trials * math.e)))


def deflated_sharpe(df: DataFrame, trials: int, trial_variance: float, column: str = "ret", compat: bool = False, keys=KEYS) -> DataFrame:
    """The probability that the ratio is above what the best of ``trials`` would show by chance; ``compat`` divides by the trials' deviation instead."""
    best = expected_best_sharpe(trial_variance, trials)
    out = psr(df, column, best, keys).withColumnRenamed("psr", "dsr").withColumn("benchmark", F.lit(best))
    return out.withColumn("dsr", norm_cdf((F.col("sr") - best) / math.sqrt(trial_variance))) if compat else out


def strategy_correlation(df: DataFrame, strategy: str = "ret", underlying: str = "market", keys=KEYS) -> DataFrame:
    """Correlation overall, on even and on odd days of the month."""
    even = F.dayofmonth("ts") % 2 == 0
    s, u = F.col(strategy), F.col(underlying)
    return df.groupBy(*keys).agg(pair_corr(s, u).alias("overall"), pair_corr(F.when(even, s), F.when(even, u)).alias("even_days"), pair_corr(F.when(~even, s), F.when(~even, u)).alias("odd_days"))


# strategy risk: scalars and columns alike


def symmetric_sharpe(p, n):
    """Ratio of ``n`` bets a year that win or lose the same with precision ``p``."""
    return (2 * p - 1) / (2 * (p * (1 - p)) ** 0.5) * n**0.5


def implied_precision(theta, n):
    return 0.5 * (1 + (theta * theta / (theta * theta + n)) ** 0.5)


def implied_frequency(theta, p):
    return theta * theta * 4 * p * (1 - p) / (2 * p - 1) ** 2


def asymmetric_sharpe(p, n, win, lose):
    """Ratio of ``n`` bets a year that win ``win`` with precision ``p`` and else ``lose`` (negative)."""
    return ((win - lose) * p + lose) / ((win - lose) * (p * (1 - p)) ** 0.5) * n**0.5


def implied_win(theta: float, p: float, n: float, lose: float) -> float:
    """The win at which ``asymmetric_sharpe`` is ``theta``."""
    c = theta / math.sqrt(n) * math.sqrt(p * (1 - p))
    return lose * (p - 1 - c) / (p - c)


def implied_precision_asymmetric(theta: float, n: float, win: float, lose: float) -> float:
    """The precision at which ``asymmetric_sharpe`` is ``theta`` (the larger root)."""
    a = (n + theta * theta) * (win - lose) ** 2
    b = (2 * n * lose - theta * theta * (win - lose)) * (win - lose)
    c = n * lose * lose
    return (-b + math.sqrt(max(0.0, b * b - 4 * a * c))) / (2 * a)


def sharpe_sensitivities(p: float, n: float, win: float, lose: float, h: float = 1e-5) -> dict[str, float]:
    """Central differences of ``asymmetric_sharpe``."""
    base = {"p": p, "n": n, "win": win, "lose": lose}
    out = {}
    for k, v in base.items():
        step = h * (abs(v) or 1.0)
        up, down = (asymmetric_sharpe(**(base | {k: v + s * step})) for s in (1, -1))
        out[k] = (up - down) / (2 * step)
    return out


def annual_sharpe(mean: float, deviation: float, periods: float) -> tuple[float, float]:
    """Per period and per year."""
    return mean / deviation, mean / deviation * math.sqrt(periods)


def mixture_moments(parts: list[tuple[float, float, float]]) -> tuple[float, float, float, float]:
    """Mean, variance, skewness and kurtosis of a mixture of ``(weight, mean, deviation)`` normals."""
    m = sum(w * a for w, a, _ in parts)
    c2 = sum(w * (s * s + (a - m) ** 2) for w, a, s in parts)
    c3 = sum(w * ((a - m) ** 3 + 3 * (a - m) * s * s) for w, a, s in parts)
    c4 = sum(w * ((a - m) ** 4 + 6 * (a - m) ** 2 * s * s + 3 * s**4) for w, a, s in parts)
    return m, c2, c3 / c2**1.5, c4 / c2**2


def mixture_psr(parts: list[tuple[float, float, float]], n: int, benchmark: float) -> float:
    """Probabilistic Sharpe ratio of a mixture of returns over ``n`` periods against a per-period benchmark; 1 less it is the chance to fail."""
    m, v, skew, kurtosis = mixture_moments(parts)
    sr = m / math.sqrt(v)
    return NormalDist().cdf((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(1 - skew * sr + (kurtosis - 1) / 4 * sr * sr))


# general characteristics


def bets(positions: DataFrame, position: str = "position", keys=KEYS) -> DataFrame:
    """One row for each stretch of one non-zero sign of the position: side, start, end and rows."""
    w = series(keys)
    s = positions.withColumn("_s", F.signum(position).cast("int"))
    s = s.withColumn("_new", F.when(F.col("_s") != F.coalesce(F.lag("_s").over(w), F.lit(0)), 1).otherwise(0)).withColumn("bet", F.sum("_new").over(running(keys)))
    return s.filter("_s <> 0").groupBy(*keys, "bet").agg(F.first("_s").alias("side"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("*").alias("rows"))


def characteristics(positions: DataFrame, position: str = "position", price: str = "price", ret: str = "ret", keys=KEYS) -> DataFrame:
    """Time range, mean value under management, leverage, share of longs, bets a year, mean holding period, annual turnover,
    hit ratio, and return on execution costs (``cost`` per unit of value traded, if there is such a column)."""
    w = series(keys)
    p = positions.withColumns({"_value": F.abs(F.col(position) * F.col(price)), "_traded": F.abs(F.col(position) - F.coalesce(F.lag(position).over(w), F.lit(0.0))) * F.col(price), "_pnl": F.coalesce(F.lag(position).over(w), F.lit(0.0)) * (F.col(price) - F.lag(price).over(w))})
    cost = F.sum(F.col("cost") * F.col("_traded")) if "cost" in positions.columns else F.lit(None).cast("double")
    base = p.groupBy(*keys).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.avg("_value").alias("mean_value"), _ratio(F.max("_value"), F.avg("_value")).alias("leverage"), F.avg((F.col(position) > 0).cast("double")).alias("ratio_of_longs"), F.sum("_traded").alias("_traded"), F.sum("_pnl").alias("pnl"), cost.alias("_cost"))
    per = bets(positions, position, keys).groupBy(*keys).agg(F.count("*").alias("n_bets"), F.avg((F.unix_micros("t1") - F.unix_micros("t0")) / 86_400e6).alias("holding_days"))
    years = (F.unix_micros("last") - F.unix_micros("first")) / (365.25 * 86_400e6)
    out = base.join(per, list(keys), "left")
    return out.select(*keys, "first", "last", "mean_value", "leverage", "ratio_of_longs", F.coalesce("n_bets", F.lit(0)).alias("n_bets"), "holding_days", _ratio(F.coalesce("n_bets", F.lit(0)), years).alias("bets_a_year"), _ratio(_ratio(F.col("_traded"), F.col("mean_value")), years).alias("annual_turnover"), "pnl", _ratio(F.col("pnl"), F.col("_cost")).alias("return_on_execution_costs"))


def attribution(df: DataFrame, by: str, column: str = "pnl", keys=KEYS) -> DataFrame:
    """Sum and share of a result by class of risk."""
    total = F.sum(F.sum(column)).over(Window.partitionBy(*keys))
    return df.groupBy(*keys, by).agg(F.sum(column).alias(column), _ratio(F.sum(column), total).alias("share"))
