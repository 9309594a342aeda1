"""Models on SAMPLES, feature importance and hyper-parameter search under purged cross-validation.

Training is ``pyspark.ml``; the driver holds models and one score for each fold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import mean, pstdev, stdev

import numpy as np
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.synthetic import uniform
from . import cv


def forest(trees: int = 100, depth: int = 5, seed: int = 42, features: str = "auto", balanced: bool = False, **options) -> RandomForestClassifier:
    """A random forest over ``features``; with ``features='all'`` it is bagging of trees."""
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="bin", featuresCol="features", weightCol="_w", featureSubsetStrategy=features, impurity=options.pop("impurity", "entropy"), **options)


def assembled(samples: DataFrame, names: Sequence[str], w: str | None = "w", balanced: bool = False) -> DataFrame:
    """``features`` and ``_w`` (the sample's weight, times its class's if ``balanced``)."""
    weight = F.col(w) if w else F.lit(1.0)
    df = samples
    if balanced:
        from .weights import class_weights

        df = class_weights(df)
        weight = weight * F.col("class_weight")
    return VectorAssembler(inputCols=list(names), outputCol="features").transform(df.withColumn("_w", weight.cast("double")).withColumn("bin", F.col("bin").cast("double")))


def predict(model, df: DataFrame) -> DataFrame:
    """With ``p``, the probability of class 1."""
    return model.transform(df).withColumn("p", vector_to_array("probability")[1])


def train_score(samples: DataFrame, names: Sequence[str], splits: DataFrame, estimator: Estimator | None = None, scoring="neg_log_loss") -> dict[str, float]:
    """Fit on fold 0's train, and score on train and test."""
    df = assembled(samples, names).join(splits.filter("fold = 0"), "row_id")
    model = (estimator or forest()).fit(df.filter("role = 'train'"))
    done = predict(model, df)
    return {role: cv.score(done.filter(F.col("role") == role), scoring) for role in ("train", "test")}


def cv_scores(samples: DataFrame, names: Sequence[str], splits: DataFrame, estimator: Estimator | None = None, scoring="neg_log_loss", balanced: bool = False) -> list[float]:
    """One score for each fold of ``splits``."""
    df = assembled(samples, names, balanced=balanced).persist()
    out = []
    try:
        for fold in cv.folds_of(splits):
            own = splits.filter(F.col("fold") == fold).select("row_id", "role")
            rows = df.join(own, "row_id")
            model = (estimator or forest()).fit(rows.filter("role = 'train'"))
            out.append(cv.score(predict(model, rows.filter("role = 'test'")), scoring))
    finally:
        df.unpersist()
    return out


def out_of_bag(samples: DataFrame, names: Sequence[str], trees: int = 10, depth: int = 5, seed: int = 0) -> float:
    """Accuracy of the votes that each sample gets from trees which didn't draw it (Poisson bootstrap)."""
    df = assembled(samples, names).persist()
    votes = None
    try:
        for t in range(trees):
            u = uniform(seed, "row_id", F.lit(t))
            times, cumulated = F.lit(0), 0.0
            for k in range(8):
                cumulated += math.exp(-1) / math.factorial(k)
                times = times + (u > cumulated).cast("int")
            drawn = df.withColumn("_k", times)
            model = DecisionTreeClassifier(maxDepth=depth, labelCol="bin", featuresCol="features", weightCol="_kw", seed=seed + t).fit(drawn.filter("_k > 0").withColumn("_kw", F.col("_w") * F.col("_k")))
            own = predict(model, drawn.filter("_k = 0")).select("row_id", "bin", "p")
            votes = own if votes is None else votes.unionByName(own)
        voted = votes.groupBy("row_id", "bin").agg((F.avg("p") > 0.5).cast("double").alias("pred"))
        return voted.agg(cv.accuracy(F.col("bin"), F.col("pred")).alias("a")).first()["a"]
    finally:
        df.unpersist()


def principal_components(samples: DataFrame, names: Sequence[str], k: int | None = None) -> tuple[DataFrame, list[float]]:
    """Centred projections ``pca_0`` on (all components unless ``k``), and their shares of the variance."""
    k = k or len(names)
    df = VectorAssembler(inputCols=list(names), outputCol="_x").transform(samples)
    model = Pipeline(stages=[StandardScaler(inputCol="_x", outputCol="_c", withMean=True, withStd=False), PCA(k=k, inputCol="_c", outputCol="_p")]).fit(df)
    done = model.transform(df).withColumn("_a", vector_to_array("_p"))
    out = done.select(*samples.columns, *(F.col("_a")[i].alias(f"pca_{i}") for i in range(k)))
    return out, [float(v) for v in model.stages[-1].explainedVariance]


def _frame(df: DataFrame, rows: list[tuple[str, float, float]]) -> DataFrame:
    out = df.sparkSession.createDataFrame([(a, None if b is None else float(b), None if c is None else float(c)) for a, b, c in rows], "feature string, mean double, std double")
    return out.orderBy(F.desc_nulls_last("mean"), "feature")


def importance_mdi(samples: DataFrame, names: Sequence[str], trees: int = 100, depth: int = 5, seed: int = 42) -> DataFrame:
    """Mean decrease of impurity over trees (a tree that doesn't use a feature doesn't count), summing to 1."""
    model = forest(trees, depth, seed, features="onethird", balanced=True).fit(assembled(samples, names, balanced=True))
    per = np.array([t.featureImportances.toArray() for t in model.trees])
    per[per == 0] = np.nan
    with np.errstate(all="ignore"):
        means = np.array([np.nanmean(c) if np.isfinite(c).any() else 0.0 for c in per.T])
        stds = np.array([np.nanstd(c, ddof=1) / math.sqrt(len(per)) if np.isfinite(c).sum() > 1 else 0.0 for c in per.T])
    total = means.sum()
    return _frame(samples, [(n, m / total, s / total) for n, m, s in zip(names, means, stds)])


def importance_mda(samples: DataFrame, names: Sequence[str], splits: DataFrame, estimator: Estimator | None = None, scoring: str = "neg_log_loss", seed: int = 0) -> tuple[DataFrame, float]:
    """Mean decrease of the score when one feature of the test is shuffled, relative to the best there could be; and the mean score.

    A feature's values are dealt anew by joining on two orders of the rows; all features of a fold are scored in one pass."""
    df = samples.withColumn("bin", F.col("bin").cast("double")).withColumn("_w", F.col("w").cast("double")).persist()
    assemble = VectorAssembler(inputCols=list(names), outputCol="features")
    base, drops = [], {n: [] for n in names}
    try:
        for fold in cv.folds_of(splits):
            rows = df.join(splits.filter(F.col("fold") == fold).select("row_id", "role"), "row_id")
            model = (estimator or forest()).fit(assemble.transform(rows.filter("role = 'train'")))
            test = rows.filter("role = 'test'").drop("role")
            placed = cv.positions(test.withColumn("_o", F.timestamp_micros(F.col("row_id"))), "_o").drop("_o").withColumnRenamed("_pos", "_a").persist()
            variants = test.withColumn("feature", F.lit(None).cast("string"))
            for k, name in enumerate(names):
                order = cv.positions(test.select("row_id", name, F.timestamp_micros(F.shiftrightunsigned(F.xxhash64("row_id", F.lit(seed + 7919 * k)), 12)).alias("_o")), "_o").select(F.col("_pos").alias("_a"), F.col(name).alias("_v"))
                variants = variants.unionByName(placed.join(order, "_a").withColumn(name, F.col("_v")).drop("_a", "_v").withColumn("feature", F.lit(name)))
            value = cv.accuracy(F.col("bin"), F.col("prediction"), F.col("_w")) if scoring == "accuracy" else cv.neg_log_loss(F.col("bin"), F.col("p"), F.col("_w"))
            got = {r["feature"]: r["s"] for r in predict(model, assemble.transform(variants)).groupBy("feature").agg(value.alias("s")).collect()}
            placed.unpersist()
            base.append(got[None])
            for name in names:
                best = 1.0 - got[name] if scoring == "accuracy" else -got[name]
                drops[name].append((got[None] - got[name]) / best if best else 0.0)
    finally:
        df.unpersist()
    k = math.sqrt(len(base))
    return _frame(samples, [(n, mean(v), stdev(v) / k if len(v) > 1 else 0.0) for n, v in drops.items()]), mean(base)


def importance_sfi(samples: DataFrame, names: Sequence[str], splits: DataFrame, estimator: Estimator | None = None, scoring: str = "neg_log_loss") -> DataFrame:
    """The cross-validated score of each feature alone (population deviation over folds)."""
    rows = []
    for n in names:
        got = cv_scores(samples, [n], splits, estimator, scoring)
        rows.append((n, mean(got), pstdev(got) / math.sqrt(len(got))))
    return _frame(samples, rows)


def feature_importance(samples: DataFrame, names: Sequence[str], method: str, splits: DataFrame, scoring: str = "neg_log_loss", trees: int = 50, seed: int = 42) -> tuple[DataFrame, float, float]:
    """The importances by ``MDI``, ``MDA`` or ``SFI``, the out-of-bag accuracy and the mean cross-validated score."""
    estimator = forest(trees, seed=seed, features="onethird")
    if method == "MDI":
        found, base = importance_mdi(samples, names, trees, seed=seed), mean(cv_scores(samples, names, splits, estimator, scoring))
    elif method == "MDA":
        found, base = importance_mda(samples, names, splits, estimator, scoring, seed)
    elif method == "SFI":
        found, base = importance_sfi(samples, names, splits, estimator, scoring), mean(cv_scores(samples, names, splits, estimator, scoring))
    else:
        raise ValueError("method must be MDI, MDA or SFI")
    return found, out_of_bag(samples, names, trees=min(trees, 10), seed=seed), base


def kernel_features(samples: DataFrame, names: Sequence[str], gamma: float, size: int = 100, seed: int = 0) -> tuple[DataFrame, list[str]]:
    """Random Fourier features of the RBF kernel (Rahimi and Recht 2007) of standardised features, as ``rff_0`` on.

    An inner product of two rows' features estimates ``exp(-gamma |x - y| ** 2)``."""
    stats = samples.agg(*(f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, math.sqrt(2 * gamma), (size, len(names))), rng.uniform(0, 2 * math.pi, size)
    z = F.array(*((F.col(n) - stats[f"m{i}"]) / (stats[f"s{i}"] or 1.0) for i, n in enumerate(names)))
    df = samples.withColumn("_z", z)
    made = []
    for j in range(size):
        dot = F.aggregate(F.zip_with("_z", F.array(*(F.lit(float(v)) for v in w[j])), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        made.append((math.sqrt(2 / size) * F.cos(dot + float(b[j]))).alias(f"rff_{j}"))
    out = df.select(*samples.columns, *made)
    return out, [f"rff_{j}" for j in range(size)]


def search(samples: DataFrame, names: Sequence[str], splits: DataFrame, nodes: Sequence[dict[str, float]], scoring: str = "neg_log_loss", size: int = 50, seed: int = 0, build: Callable | None = None) -> DataFrame:
    """Cross-validated scores of every node ``{"c": ..., "gamma": ...}`` of a kernel classifier; best first."""
    rows = []
    for node in nodes:
        if build:
            df, own, estimator = build(samples, names, node)
        else:
            df, own = kernel_features(samples, names, node["gamma"], size, seed)
            estimator = LogisticRegression(labelCol="bin", featuresCol="features", weightCol="_w", regParam=1.0 / (2 * node["c"] * 1000), maxIter=50)
        got = cv_scores(df, own, splits, estimator, scoring)
        rows.append((float(node["c"]), float(node["gamma"]), float(mean(got)), float(pstdev(got))))
    return samples.sparkSession.createDataFrame(rows, "c double, gamma double, score double, std double").orderBy(F.desc("score"), "c", "gamma")


def grid_nodes(cs: Sequence[float], gammas: Sequence[float]) -> list[dict[str, float]]:
    return [{"c": c, "gamma": g} for c in cs for g in gammas]


def log_uniform_nodes(n: int, low: float = 1e-2, high: float = 1e2, seed: int = 0) -> list[dict[str, float]]:
    rng = np.random.default_rng(seed)
    return [{"c": float(c), "gamma": float(g)} for c, g in np.exp(rng.uniform(math.log(low), math.log(high), (n, 2)))]


def best_node(results: DataFrame) -> DataFrame:
    return results.agg(F.max_by(F.struct("c", "gamma"), F.struct("score", -F.col("c"))).alias("n"), F.max("score").alias("score")).select("n.c", "n.gamma", "score")


def coarse_to_fine(samples: DataFrame, names: Sequence[str], splits: DataFrame, n: int = 4, factor: float = 2.0, scoring: str = "neg_log_loss", size: int = 50, seed: int = 0) -> DataFrame:
    """Random nodes first, then a grid around the best of them."""
    coarse = search(samples, names, splits, log_uniform_nodes(n, seed=seed), scoring, size, seed)
    top = best_node(coarse).first()
    fine = search(samples, names, splits, grid_nodes([top["c"] / factor, top["c"], top["c"] * factor], [top["gamma"] / factor, top["gamma"] * factor]), scoring, size, seed)
    return coarse.withColumn("stage", F.lit("coarse")).unionByName(fine.withColumn("stage", F.lit("fine"))).orderBy(F.desc("score"))


def close_scores(a: float, b: float, relative: float = 0.5) -> bool:
    """Whether two searches found about the same score."""
    return abs(a - b) <= relative * abs(b)


def forecast_returns(predictions: DataFrame, pred: str = "pred", y: str = "y", move: float = 0.01) -> DataFrame:
    """``ret``: a position of +1 for class 1 and -1 for class 0, in a market that moves by ``move`` either way with the outcome."""
    side = lambda c: F.when(F.col(c) == 1, 1.0).otherwise(-1.0)
    return predictions.withColumn("ret", side(pred) * side(y) * move)
