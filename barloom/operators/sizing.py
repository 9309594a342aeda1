"""Bet sizing: from probabilities, from what is open at once, from forecasts against prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import KEYS
from ..functions.normal import norm_cdf
from .joins import sweep


def size_from_probability(p: Column, classes: int = 2) -> Column:
    """``2 Phi(z) - 1`` with ``z = (p - 1/K) / sqrt(p (1 - p))``; null outside (0, 1), 0 at 1/K."""
    inside = (p > 0) & (p < 1)
    safe = F.when(inside, p)
    z = (safe - 1.0 / classes) / F.sqrt(safe * (1 - safe))
    return F.when(inside, 2 * norm_cdf(z) - 1)


def size_curves(spark: SparkSession, most_classes: int = 10, points: int = 99) -> DataFrame:
    """``classes, p, size`` for 2 to ``most_classes`` classes, above the even chance."""
    grid = spark.range(2, most_classes + 1).select(F.col("id").cast("int").alias("classes")).crossJoin(F.broadcast(spark.range(1, points + 1).select((F.col("id") / (points + 1)).alias("p"))))
    z = (F.col("p") - 1.0 / F.col("classes")) / F.sqrt(F.col("p") * (1 - F.col("p")))
    return grid.filter(F.col("p") > 1.0 / F.col("classes") + 1e-6).withColumn("size", 2 * norm_cdf(z) - 1)


def discretise(x: Column, step: float) -> Column:
    """To multiples of ``step``, halves to the even one, within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.bround(x / step) * step))


def average_active(signals: DataFrame, signal: str = "signal") -> DataFrame:
    """At each start and end: the mean of the signals open there, 0 where none is."""
    at = sweep(signals, [signal])
    return at.select(*KEYS, "ts", "n", F.coalesce(F.try_divide(F.col(signal), F.nullif(F.col("n"), F.lit(0))), F.lit(0.0)).alias(signal))


def get_signal(predictions: DataFrame, step: float = 0.1, classes: int = 2) -> DataFrame:
    """From ``symbol, t0, t1, prob, pred`` (and perhaps ``side``): signed sizes, averaged while open, made discrete."""
    size = F.col("pred") * size_from_probability(F.col("prob"), classes)
    if "side" in predictions.columns:
        size = size * F.col("side")
    averaged = average_active(predictions.withColumn("signal", size))
    return averaged.withColumn("signal", discretise(F.col("signal"), step))


def active_counts(bets: DataFrame, side: str = "signal") -> DataFrame:
    """At each start and end: bets open, their mean, and how many are long and short."""
    marked = bets.withColumns({"_v": F.col(side).cast("double"), "_l": (F.col(side) > 0).cast("double"), "_s": (F.col(side) < 0).cast("double")})
    at = sweep(marked, ["_v", "_l", "_s"])
    return at.select(*KEYS, "ts", F.coalesce(F.try_divide(F.col("_v"), F.nullif(F.col("n"), F.lit(0))), F.lit(0.0)).alias("average"), F.col("n").alias("total"), F.col("_l").cast("long").alias("long"), F.col("_s").cast("long").alias("short"))


def budget_size(counts: DataFrame) -> DataFrame:
    """``long / max long - short / max short`` over each key, and ``net``, the difference of the counts."""
    key = Window.partitionBy(*KEYS)

    def share(c):
        return F.coalesce(F.try_divide(F.col(c), F.nullif(F.max(c).over(key), F.lit(0))), F.lit(0.0))

    return counts.withColumns({"budget": share("long") - share("short"), "net": F.col("long") - F.col("short")})


def fit_mixture(df: DataFrame, column: str = "net", components: int = 2, seed: int = 42) -> list[tuple[float, float, float]]:
    """``(weight, mean, deviation)`` of a Gaussian mixture of one column (as many rows as components)."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=[column], outputCol="features").transform(df.select(F.col(column).cast("double").alias(column)))
    model = GaussianMixture(k=components, seed=seed, maxIter=100).fit(rows)
    got = [(float(w), float(g["mean"][0]), float(g["cov"].toArray()[0][0]) ** 0.5) for w, g in zip(model.weights, model.gaussiansDF.collect(), strict=True)]
    return sorted(got, key=lambda g: g[1])


def mixture_cdf(x: Column, mixture: list[tuple[float, float, float]]) -> Column:
    total = F.lit(0.0)
    for w, m, s in mixture:
        total = total + F.lit(w) * norm_cdf((x - m) / max(s, 1e-12))
    return total


def mixture_size(x: Column, mixture: list[tuple[float, float, float]]) -> Column:
    """``(F(x) - F(0)) / (1 - F(0))`` from 0 up, ``(F(x) - F(0)) / F(0)`` below; 0 where that divides by 0, within -1 and 1."""
    f, f0 = mixture_cdf(x, mixture), mixture_cdf(F.lit(0.0), mixture)
    size = F.when(x >= 0, F.try_divide(f - f0, F.nullif(1 - f0, F.lit(0.0)))).otherwise(F.try_divide(f - f0, F.nullif(f0, F.lit(0.0))))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(size, F.lit(0.0))))


# sigmoid sizes


def sigmoid_size(w: Column, x: Column) -> Column:
    return x / F.sqrt(w + x * x)


def sigmoid_width(divergence: Column, size: Column) -> Column:
    """The width at which a divergence gives a size."""
    return divergence * divergence * (1 / (size * size) - 1)


def sigmoid_target(w: Column, forecast: Column, price: Column, most: int) -> Column:
    """Whole units, towards zero."""
    return (sigmoid_size(w, forecast - price) * most).cast("int")


def sigmoid_inverse(forecast: Column, w: Column, size: Column) -> Column:
    return forecast - size * F.sqrt(w / (1 - size * size))


def _mean_over_units(position: Column, target: Column, price_at) -> Column:
    """The mean of the prices at which each unit between position and target is right; null if there is none."""
    step = F.signum(target - position).cast("int")
    units = F.when(target != position, F.sequence(position + step, target, step))
    prices = F.transform(units, price_at)
    return F.try_divide(F.aggregate(prices, F.lit(0.0), lambda a, x: a + x), F.size(units))


def sigmoid_limit(target: Column, position: Column, forecast: Column, w: Column, most: int) -> Column:
    """The price that breaks even on an order from ``position`` to ``target`` (a target of all units has no finite price)."""
    return _mean_over_units(position, target, lambda j: sigmoid_inverse(forecast, w, j / F.lit(float(most))))


# power sizes


def power_size(x: Column, k: Column, p: float) -> Column:
    if p == 0:
        raise ValueError("a power of 0 has no size")
    return F.signum(x) * F.least(F.lit(1.0), F.pow(F.abs(x) / k, F.lit(float(p))))


def power_target(x: Column, k: Column, p: float, most: int) -> Column:
    return (power_size(x, k, p) * most).cast("int")


def power_inverse(forecast: Column, size: Column, k: Column, p: float) -> Column:
    """The price at which the size is right."""
    return forecast - F.signum(size) * k * F.pow(F.abs(size), F.lit(1.0 / p))


def power_width(divergence: Column, size: Column, p: float) -> Column:
    """The scale at which a divergence gives a size; infinite for a size of 0."""
    return F.when(size == 0, F.lit(float("inf"))).otherwise(F.abs(divergence) / F.pow(F.abs(size), F.lit(1.0 / p)))


def power_limit(target: Column, position: Column, forecast: Column, k: Column, p: float, most: int) -> Column:
    """As ``sigmoid_limit``; an order of no units is priced at the forecast."""
    mean = _mean_over_units(position, target, lambda j: power_inverse(forecast, j / F.lit(float(most)), k, p))
    return F.when(target == position, forecast).otherwise(mean)
