"""Seeded generators; every value is a function of the row's number and the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """In (0, 1), the same for equal keys wherever it is computed."""
    h = F.xxhash64(F.lit(seed), *keys)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(2**53))


def gaussian(seed: int, *keys: Column | str) -> Column:
    """Box and Muller's transform of two uniform values."""
    return F.sqrt(-2 * F.ln(uniform(seed, *keys))) * F.cos(6.283185307179586 * uniform(seed + 500_009, *keys))


def classification(spark: SparkSession, n: int = 5000, informative: int = 10, redundant: int = 10, noise: int = 20, seed: int = 0, end: str = "2024-01-01") -> DataFrame:
    """SAMPLES: ``I_*`` decide ``bin``, ``R_*`` mix the informative ones, ``N_*`` say nothing; business days up to ``end``."""
    rows = spark.range(n).withColumnRenamed("id", "row_id")
    info = [gaussian(seed + k, "row_id").alias(f"I_{k}") for k in range(informative)]
    df = rows.select("row_id", *info, *(gaussian(seed + 1000 + k, "row_id").alias(f"N_{k}") for k in range(noise)), (gaussian(seed + 5000, "row_id") * 0.5).alias("_e"))
    for k in range(redundant):
        a, b = F.col(f"I_{k % informative}"), F.col(f"I_{(3 * k + 1) % informative}")
        df = df.withColumn(f"R_{k}", 0.6 * a - 0.4 * b + 0.2 * gaussian(seed + 3000 + k, "row_id"))
    signal = sum(((-1) ** k * F.col(f"I_{k}") for k in range(informative)), F.lit(0.0))
    back = F.lit(n - 1) - F.col("row_id")
    last = F.to_date(F.lit(end))
    monday = F.date_sub(last, F.weekday(last))
    at = F.least(F.weekday(last), F.lit(4)) - back
    weeks = F.floor(at / 5)
    day = F.date_add(monday, (7 * weeks + at - 5 * weeks).cast("int"))
    return df.select(F.lit("SYN").alias("symbol"), "row_id", day.cast("timestamp").alias("t0"), day.cast("timestamp").alias("t1"), (signal + F.col("_e") > 0).cast("int").alias("bin"), F.lit(1.0 / n).alias("w"), *[c for c in df.columns if c[:2] in ("I_", "R_", "N_")])


def random_walk(spark: SparkSession, n: int = 120_000, start: str = "2024-01-01", step: float = 0.05, seed: int = 42, symbol: str = "WALK") -> DataFrame:
    """One price a minute, 100 plus summed Gaussian steps."""
    steps = spark.range(n).select(F.lit(symbol).alias("symbol"), F.col("id").alias("seq"), (F.lit(start).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("ts"), (gaussian(seed, "id") * step).alias("_s"))
    w = Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("price", 100 + F.sum("_s").over(w)).drop("_s")


def test_series(spark: SparkSession, n: int = 500, period: int = 50, shift: float = 1.0, seed: int = 42) -> DataFrame:
    """``symbol, seq, value``: IID normal, its sum, a sine, and the sum of the shifted sine."""
    rows = spark.range(n).withColumnRenamed("id", "seq")
    sine = F.sin(2 * 3.141592653589793 * F.col("seq") / period)
    wide = rows.select("seq", F.explode(F.array(*(F.struct(F.lit(name).alias("symbol"), v.alias("value")) for name, v in (("iid", gaussian(seed, "seq")), ("walk", gaussian(seed, "seq")), ("sine", sine), ("shifted", sine + shift))))).alias("x"))
    w = Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return wide.select("x.symbol", "seq", "x.value").withColumn("value", F.when(F.col("symbol").isin("walk", "shifted"), F.sum("value").over(w)).otherwise(F.col("value")))


def signals(spark: SparkSession, n: int = 10_000, start: str = "2020-01-01", longest: int = 25, seed: int = 1) -> DataFrame:
    """SIGNALS on consecutive days: a uniform signal held for 1 to ``longest`` days."""
    t0 = F.date_add(F.to_date(F.lit(start)), F.col("id").cast("int"))
    hold = (F.floor(uniform(seed + 1, "id") * longest) + 1).cast("int")
    return spark.range(n).select(F.lit("SYN").alias("symbol"), F.col("id").alias("seq"), t0.cast("timestamp").alias("t0"), F.date_add(t0, hold).cast("timestamp").alias("t1"), uniform(seed, "id").alias("signal"))


def grid(spark: SparkSession, **axes: tuple[float, float, int]) -> DataFrame:
    """The product of evenly spaced axes ``name=(first, last, points)``."""
    out = None
    for name, (first, last, points) in axes.items():
        axis = spark.range(points).select((F.lit(first) + F.col("id") * ((last - first) / max(1, points - 1))).alias(name))
        out = axis if out is None else out.crossJoin(F.broadcast(axis))
    return out


def alternate_days(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``side``: +1 on even days of the month, -1 on odd ones."""
    return df.withColumn("side", F.when(F.dayofmonth(ts) % 2 == 0, 1).otherwise(-1))
