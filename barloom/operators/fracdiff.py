"""Fractional differencing with a fixed-width window."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KEYS, ORDER, running
from .fold import fold

#: A window of more weights is an error; a negative order's weights never get small.
LONGEST = 1_000_000


def ffd_weights(d: float, least: float = 1e-5, longest: int = LONGEST) -> np.ndarray:
    """Weights of (1 - L) ** d, oldest first, cut where they fall below ``least`` in size; ValueError if ``longest`` of them aren't enough."""
    w = [1.0]
    while True:
        k = len(w)
        nxt = -w[-1] * (d - k + 1) / k
        if abs(nxt) < least:
            return np.array(w[::-1])
        if k >= longest:
            raise ValueError(f"order {d} has more than {longest} weights of {least} or more")
        w.append(nxt)


def ffd(df: DataFrame, column: str, d: float, least: float = 1e-5, out: str = "ffd", keys=KEYS, order=ORDER) -> DataFrame:
    """``df`` with the fractional difference; null while the window isn't full, and wherever the value itself is null
    (nulls inside are filled with the last value first)."""
    weights = ffd_weights(d, least)[::-1].copy()
    width = len(weights)

    def machine():
        seen: list[float] = []
        last = None

        def step(values):
            nonlocal seen, last
            got, at = [None] * len(values), []
            for i, v in enumerate(values):
                if v is not None:
                    last = v
                if last is not None:
                    seen.append(last)
                    at.append(i)
            x = np.array(seen)
            if len(x) >= width:
                done = np.convolve(x, weights, "valid")
                for i, y in zip(at[::-1], done[::-1]):
                    if values[i] is not None:
                        got[i] = float(y)
            seen = seen[len(seen) - width + 1 :] if width > 1 and len(seen) >= width else ([] if width == 1 else seen)
            return (got,)

        return step

    return fold(df, machine, [column], {out: "double"}, keys, order)


def ffd_columns(df: DataFrame, columns: list[str], d: float, least: float = 1e-5) -> DataFrame:
    """``ffd`` of several columns, each as ``<name>_ffd``."""
    for c in columns:
        df = ffd(df, c, d, least, f"{c}_ffd")
    return df


def ffd_native(df: DataFrame, column: str, d: float, least: float = 1e-5, out: str = "ffd", keys=KEYS, order=ORDER) -> DataFrame:
    """The same inside the JVM, for narrow windows (a list of the last values times the weights)."""
    from ..functions.columns import rows

    weights = ffd_weights(d, least)
    filled = df.withColumn("_x", F.last(column, ignorenulls=True).over(running(keys, order)))
    window = F.collect_list("_x").over(rows(len(weights), keys, order))
    dot = F.aggregate(F.zip_with(window, F.array(*(F.lit(float(w)) for w in weights)), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return filled.withColumn("_w", window).withColumn(out, F.when((F.size("_w") == len(weights)) & F.col(column).isNotNull(), dot)).drop("_w", "_x")


def correlation(df: DataFrame, a: str, b: str, keys=KEYS) -> DataFrame:
    from ..functions.columns import pair_corr

    return df.groupBy(*keys).agg(pair_corr(a, b).alias("corr"))
