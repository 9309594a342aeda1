"""Encodings of returns as symbols, and entropies of the symbols."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.columns import KEYS, pct_change, series


def returns(bars: DataFrame, keep_first: bool = False) -> DataFrame:
    out = bars.withColumn("ret", pct_change("close"))
    return out if keep_first else out.filter("ret IS NOT NULL")


def encode_binary(df: DataFrame, column: str = "ret", out: str = "code") -> DataFrame:
    """1 for a positive value, else 0 (also for null)."""
    return df.withColumn(out, F.when(F.col(column) > 0, 1).otherwise(0))


def encode_quantiles(df: DataFrame, column: str = "ret", bins: int = 10, out: str = "code", keys=KEYS) -> DataFrame:
    """The number of inner quantile edges (interpolated, repeated ones once) below the value: right-closed bins from 0."""
    edges = df.groupBy(*keys).agg(F.percentile(column, [k / bins for k in range(bins + 1)]).alias("_all"))
    edges = edges.withColumn("_all", F.array_distinct("_all")).withColumn("_e", F.slice("_all", 2, F.greatest(F.size("_all") - 2, F.lit(0)))).drop("_all")
    return df.join(edges, list(keys)).withColumn(out, F.when(F.col(column).isNotNull(), F.size(F.filter("_e", lambda e: e < F.col(column))))).drop("_e")


def encode_sigma(df: DataFrame, column: str = "ret", out: str = "code", keys=KEYS) -> DataFrame:
    """Codes 0 to 5 by the left-closed bins between -2, -1, 0, 1 and 2 standard deviations."""
    sd = df.groupBy(*keys).agg(F.stddev_samp(column).alias("_s"))
    x = F.col(column)
    code = F.lit(0)
    for k in (-2, -1, 0, 1, 2):
        code = code + (x >= (k * F.col("_s") if k else F.lit(0.0))).cast("int")
    return df.join(sd, list(keys)).withColumn(out, code).drop("_s")


def encode_momentum(df: DataFrame, column: str = "ret", out: str = "code", keep_first: bool = False) -> DataFrame:
    """1 where a value and the last one don't differ in sign; the first has no code (``keep_first``: 0)."""
    product = F.col(column) * F.lag(column).over(series())
    found = df.withColumn(out, F.when(product >= 0, 1).when(product < 0, 0))
    return found.withColumn(out, F.coalesce(out, F.lit(0))) if keep_first else found.filter(F.col(out).isNotNull())


def tail_subsets(df: DataFrame, size: int = 100, most: int = 100) -> DataFrame:
    """``subset`` (0 the oldest) and ``pos``: the last ``size * most`` rows of each key cut into runs of ``size``; what is left over goes from the front."""
    back = Window.partitionBy(*KEYS).orderBy(F.desc("ts"), F.desc("seq"))
    n = F.least(F.floor(F.count("*").over(Window.partitionBy(*KEYS)) / size), F.lit(most))
    r = df.withColumns({"_r": F.row_number().over(back) - 1, "_n": n}).filter(F.col("_r") < F.col("_n") * size)
    return r.withColumns({"subset": (F.col("_n") - 1 - F.floor(F.col("_r") / size)).cast("int"), "pos": (size - 1 - F.col("_r") % size).cast("int")}).drop("_r", "_n")


def plug_in_entropy(df: DataFrame, column: str = "code", keys=KEYS) -> DataFrame:
    """Shannon entropy in bits of the observed frequencies; 0 for one symbol or none."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_c"))
    total = counts.withColumn("_p", F.col("_c") / F.sum("_c").over(Window.partitionBy(*keys)))
    return total.groupBy(*keys).agg(F.when(F.count("*") > 1, -F.sum(F.col("_p") * F.log2("_p"))).otherwise(F.lit(0.0)).alias("entropy"), F.sum("_c").alias("n"))


def phrase_count(text: str) -> int:
    """Distinct phrases of a greedy parse: the shortest prefix not seen yet ends a phrase; a known rest doesn't count."""
    seen, begin = set(), 0
    for end in range(1, len(text) + 1):
        piece = text[begin:end]
        if piece not in seen:
            seen.add(piece)
            begin = end
    return len(seen)


@F.pandas_udf(LongType())
def _phrases(text: pd.Series) -> pd.Series:
    return text.map(phrase_count)


def lempel_ziv(df: DataFrame, column: str = "code", keys=KEYS, order=("ts", "seq")) -> DataFrame:
    """``phrases`` of each key's codes in order (joined as digits), and the rate ``phrases / n * log2 n`` (0 under 2).

    A key's sequence goes to one row: keys should be windows or subsets."""
    listed = df.filter(F.col(column).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(column).cast("string").alias("c")))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["c"]), "")
    out = listed.withColumn("_t", text).withColumn("phrases", _phrases("_t")).withColumn("n", F.char_length("_t").cast("long"))
    rate = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.col("phrases") / F.col("n") * F.log2("n"))
    return out.select(*keys, "n", "phrases", rate.alias("rate"))


def value_counts(df: DataFrame, column: str = "code", keys=KEYS) -> DataFrame:
    return df.groupBy(*keys, column).agg(F.count("*").alias("n"))


def max_entropy(symbols: int) -> float:
    return math.log2(symbols) if symbols > 1 else 0.0
