"""Leakage-safe cross-validation: splits as frames, purging, embargo, and scores.

SPLITS are long frames ``fold, row_id, role`` (``train`` or ``test``); a fold is a handful of numbers
(its test block's limits), so splits are made by joining samples to one row for each fold.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(samples: DataFrame, order: str = "t0") -> DataFrame:
    """``_pos`` from 0 in time order.  Numbered within ranges of time and shifted by the sizes of the ranges before,
    so no task sees all samples."""
    spark = samples.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.unix_micros(F.col(order).cast("timestamp"))
    cuts = samples.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 1000).alias("c")).first()["c"] or []
    marks = F.array(*(F.lit(c) for c in sorted(set(cuts)))).cast("array<bigint>")
    dealt = samples.withColumn("_range", F.size(F.filter(marks, lambda c: c < key)))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    # as many rows as there are ranges
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    w = Window.partitionBy("_range").orderBy(order, "row_id")
    return dealt.withColumn("_in", F.row_number().over(w) - 1).join(F.broadcast(base), "_range").withColumn("_pos", F.col("_base") + F.col("_in")).drop("_range", "_in", "_base")


def _blocks(n: int, k: int) -> list[tuple[int, int]]:
    """k contiguous blocks, the first ``n % k`` one longer."""
    out, lo = [], 0
    for i in range(k):
        hi = lo + n // k + (i < n % k)
        out.append((lo, hi))
        lo = hi
    return out


def holdout(samples: DataFrame, share: float = 0.2, order: str = "t0") -> DataFrame:
    """One fold: the last ``share`` (rounded up) of the samples is the test."""
    n = samples.count()
    cut = n - math.ceil(n * share)
    return positions(samples, order).select(F.lit(0).alias("fold"), "row_id", F.when(F.col("_pos") >= cut, "test").otherwise("train").alias("role"))


def k_fold(samples: DataFrame, k: int = 5, order: str = "t0", seed: int | None = None) -> DataFrame:
    """Contiguous test blocks; with a ``seed`` the order is that of a hash of the row id instead of time."""
    if seed is None:
        placed = positions(samples, order)
    else:
        placed = positions(samples.withColumn("_h", F.timestamp_micros(F.shiftrightunsigned(F.xxhash64("row_id", F.lit(seed)), 12))), "_h")
    blocks = samples.sparkSession.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(_blocks(samples.count(), k))], "fold int, _lo long, _hi long")
    joined = placed.select("row_id", "_pos").crossJoin(F.broadcast(blocks))
    return joined.select("fold", "row_id", F.when((F.col("_pos") >= F.col("_lo")) & (F.col("_pos") < F.col("_hi")), "test").otherwise("train").alias("role"))


def embargo_times(bars: DataFrame, share: float, keys=("symbol",), order=("ts", "seq")) -> DataFrame:
    """``embargo``: the time ``int(n * share)`` rows later, the last one where there is none."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    ranked = bars.withColumns({"_i": F.row_number().over(w.orderBy(*order)), "_n": n})
    step = F.floor(F.col("_n") * share)
    target = ranked.withColumn("_at", F.least(F.col("_i") + step, F.col("_n")))
    later = ranked.select(*keys, F.col("_i").alias("_at"), F.col("ts").alias("embargo"))
    return target.join(later, [*keys, "_at"]).drop("_i", "_n", "_at")


def _purged(samples: DataFrame, folds: list[tuple], share: float, order: str) -> DataFrame:
    """Folds as ``(fold, [(lo, hi), ...])`` test blocks of positions; trains are purged of overlaps and embargoed after each block."""
    spark, placed = samples.sparkSession, positions(samples, order)
    n = samples.count()
    wait = int(n * share)
    blocks = spark.createDataFrame([(f, b, lo, hi) for f, tests in folds for b, (lo, hi) in enumerate(tests)], "fold int, block int, _lo long, _hi long")
    inside = placed.select("row_id", "_pos", "t0", "t1").join(F.broadcast(blocks), (F.col("_pos") >= F.col("_lo")) & (F.col("_pos") < F.col("_hi")))
    spans = inside.groupBy("fold", "block", "_lo", "_hi").agg(F.min("t0").alias("_start"), F.max(F.coalesce("t1", "t0")).alias("_end"))
    # the first position at or after the last test label's end, and so many rows more
    ends = placed.select("_pos", "t0").crossJoin(F.broadcast(spans)).filter(F.col("t0") >= F.col("_end")).groupBy("fold", "block").agg(F.min("_pos").alias("_after"))
    spans = spans.join(ends, ["fold", "block"], "left").withColumn("_from", F.coalesce("_after", F.lit(n)) + wait)
    joined = placed.select("row_id", "_pos", "t0", "t1").crossJoin(F.broadcast(spans))
    is_test = (F.col("_pos") >= F.col("_lo")) & (F.col("_pos") < F.col("_hi"))
    clear = (F.coalesce("t1", "t0") <= F.col("_start")) & (F.col("_pos") < F.col("_lo")) | (F.col("_pos") >= F.col("_from"))
    marked = joined.groupBy("fold", "row_id").agg(F.max(is_test).alias("_test"), F.min(clear).alias("_train"))
    return marked.filter("_test OR _train").select("fold", "row_id", F.when(F.col("_test"), "test").otherwise("train").alias("role"))


def purged_k_fold(samples: DataFrame, k: int = 3, embargo: float = 0.0, order: str = "t0") -> DataFrame:
    """Contiguous test blocks.  Left of a block train the samples whose label ends by its start; right of it those from the
    first position at or after its last label's end, and ``int(n * embargo)`` further."""
    n = samples.count()
    return _purged(samples, [(i, [b]) for i, b in enumerate(_blocks(n, k))], embargo, order)


def path_count(groups: int, tests: int) -> int:
    return math.comb(groups, tests) * tests // groups


def combinatorial(samples: DataFrame, groups: int = 6, tests: int = 2, embargo: float = 0.0, order: str = "t0") -> DataFrame:
    """Combinatorial purged splits: every choice of ``tests`` of the groups is a fold's test."""
    blocks = _blocks(samples.count(), groups)
    return _purged(samples, [(i, [blocks[g] for g in chosen]) for i, chosen in enumerate(itertools.combinations(range(groups), tests))], embargo, order)


def backtest_paths(groups: int, tests: int) -> list[tuple[int, int, int]]:
    """``(path, group, fold)``: which fold's test predictions of each group belong to which path."""
    seen, out = [0] * groups, []
    for fold, chosen in enumerate(itertools.combinations(range(groups), tests)):
        for g in chosen:
            out.append((seen[g], g, fold))
            seen[g] += 1
    return sorted(out)


def walk_forward(samples: DataFrame, k: int = 5, embargo: float = 0.0, order: str = "t0") -> DataFrame:
    """k - 1 folds: train on all blocks so far (labels ending by the test's start), test on the next."""
    n = samples.count()
    folds = [(i - 1, [b]) for i, b in enumerate(_blocks(n, k)) if i]
    splits = _purged(samples, folds, embargo, order)
    limits = samples.sparkSession.createDataFrame([(f, b[0][0]) for f, b in folds], "fold int, _lo long")
    placed = positions(samples, order).select("row_id", "_pos")
    both = splits.join(placed, "row_id").join(F.broadcast(limits), "fold")
    return both.filter((F.col("role") == "test") | (F.col("_pos") < F.col("_lo"))).select("fold", "row_id", "role")


def folds_of(splits: DataFrame) -> Iterator[int]:
    """The fold numbers (as many as there are folds)."""
    yield from sorted(r["fold"] for r in splits.select("fold").distinct().collect())


# scores


def accuracy(y: Column, pred: Column, w: Column | None = None) -> Column:
    w = F.lit(1.0) if w is None else w
    return F.try_divide(F.sum(w * (y == pred).cast("double")), F.nullif(F.sum(w), F.lit(0.0)))


def neg_log_loss(y: Column, p: Column, w: Column | None = None, eps: float = 1e-15) -> Column:
    """Weighted mean log-probability of the class that came (``p``: of class 1), clipped."""
    w = F.lit(1.0) if w is None else w
    own = F.when(y == 1, p).otherwise(1 - p)
    return F.try_divide(F.sum(w * F.ln(F.greatest(F.lit(eps), F.least(F.lit(1 - eps), own)))), F.nullif(F.sum(w), F.lit(0.0)))


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred", keys=()) -> DataFrame:
    """Precision, recall, F1 and support of each class (null where there is nothing to divide by)."""
    labels = df.select(F.col(y).alias("label")).unionByName(df.select(F.col(pred).alias("label"))).distinct()
    cells = df.groupBy(*keys, F.col(y).alias("_y"), F.col(pred).alias("_p")).agg(F.count("*").alias("_n"))
    joined = cells.join(F.broadcast(labels), (F.col("_y") == F.col("label")) | (F.col("_p") == F.col("label")))
    sums = joined.groupBy(*keys, "label").agg(*(F.sum(F.when(c, F.col("_n")).otherwise(0)).alias(n) for n, c in (("tp", (F.col("_y") == F.col("label")) & (F.col("_p") == F.col("label"))), ("support", F.col("_y") == F.col("label")), ("predicted", F.col("_p") == F.col("label")))))
    ratio = lambda a, b: F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0)))
    out = sums.withColumns({"precision": ratio("tp", "predicted"), "recall": ratio("tp", "support")})
    return out.select(*keys, "label", "precision", "recall", F.try_divide(2 * F.col("precision") * F.col("recall"), F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))).alias("f1"), "support")


def confusion(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(y, pred).agg(F.count("*").alias("n"))


def score(predictions: DataFrame, scoring: str | Callable[[DataFrame], float] = "neg_log_loss", y: str = "bin", w: str = "w") -> float:
    """One number from ``prediction`` and ``p`` (of class 1)."""
    if callable(scoring):
        return scoring(predictions)
    if scoring not in ("neg_log_loss", "accuracy"):
        raise ValueError("scoring must be neg_log_loss or accuracy")
    value = accuracy(F.col(y), F.col("prediction"), F.col(w)) if scoring == "accuracy" else neg_log_loss(F.col(y), F.col("p"), F.col(w))
    return predictions.agg(value.alias("v")).first()["v"]
