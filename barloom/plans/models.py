"""Queries: splits, scores, models, importance, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import q6, us
from ..operators import cv as C
from ..operators import models as M
from ..operators.backtest import sharpe
from ..sources import fixtures as X
from ..sources.fixtures import sql_q6 as Q
from .labels import CLOSES, closes
from .registry import query

NUMBERED = f"WITH {X.SQL_SAMPLES}, p AS (SELECT *, row_number() OVER (ORDER BY t0, row_id) - 1 AS pos, count(*) OVER () AS n FROM samples)"
FEW = [f"f{k}" for k in range(6)]
ALL = [f"f{k}" for k in range(64)]


def samples(spark, sf, features=6):
    return X.samples(spark, sf, features)


@query(f"{NUMBERED} SELECT 0 AS fold, row_id, CASE WHEN pos >= n - ceil(n * 0.2) THEN 'test' ELSE 'train' END AS role FROM p")
def holdout_split(spark, sf):
    return C.holdout(samples(spark, sf))


FOLD = "CASE WHEN pos < (n % {k}) * (n // {k} + 1) THEN pos // (n // {k} + 1) ELSE (n % {k}) + (pos - (n % {k}) * (n // {k} + 1)) // (n // {k}) END"


@query(f"{NUMBERED} SELECT i::INTEGER AS fold, row_id, CASE WHEN {FOLD.format(k=7)} = i THEN 'test' ELSE 'train' END AS role FROM p, range(7) t(i)")
def k_fold_splits(spark, sf):
    return C.k_fold(samples(spark, sf), 7)


@query()
def shuffled_k_fold_splits(spark, sf):
    return C.k_fold(samples(spark, sf), 5, seed=1)


def _purged_sql(k: int, embargo: float, more: str = "", keep: str = "true") -> str:
    return f"""{NUMBERED}, f AS (SELECT *, {FOLD.format(k=k)} AS fold FROM p), b AS (SELECT fold, min(pos) AS lo, max(pos) + 1 AS hi, min(t0) AS a, max(t1) AS z, any_value(n) AS n FROM f GROUP BY fold),
    e AS (SELECT b.*, coalesce((SELECT min(pos) FROM p WHERE p.t0 >= b.z), b.n) + floor(b.n * {embargo}) AS after FROM b)
    SELECT e.fold::INTEGER AS fold, row_id, CASE WHEN pos >= lo AND pos < hi THEN 'test' ELSE 'train' END AS role FROM p, e
    WHERE ((pos >= lo AND pos < hi) OR (pos < lo AND t1 <= a) OR (pos >= after)) AND {keep}"""


@query(_purged_sql(5, 0.02))
def purged_k_fold_splits(spark, sf):
    return C.purged_k_fold(samples(spark, sf), 5, embargo=0.02)


@query(_purged_sql(5, 0.0, keep="fold > 0 AND NOT (pos >= hi)").replace("e.fold::INTEGER AS fold", "(e.fold - 1)::INTEGER AS fold"))
def walk_forward_splits(spark, sf):
    return C.walk_forward(samples(spark, sf), 5)


@query(
    f"""{NUMBERED}, g AS (SELECT *, {FOLD.format(k=6)} AS grp FROM p), c AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS fold, a, b FROM range(6) x(a), range(6) y(b) WHERE a < b),
    t AS (SELECT fold, unnest([a, b]) AS grp FROM c), s AS (SELECT t.fold, t.grp, min(pos) AS lo, max(pos) + 1 AS hi, min(t0) AS a, max(t1) AS z, any_value(n) AS n FROM t JOIN g USING (grp) GROUP BY ALL),
    e AS (SELECT s.*, coalesce((SELECT min(pos) FROM p WHERE p.t0 >= s.z), s.n) + floor(s.n * 0.01) AS after FROM s),
    m AS (SELECT e.fold, row_id, bool_or(pos >= lo AND pos < hi) AS test, bool_and((pos < lo AND t1 <= a) OR pos >= after) AS train FROM p, e GROUP BY ALL)
    SELECT fold::INTEGER AS fold, row_id, CASE WHEN test THEN 'test' ELSE 'train' END AS role FROM m WHERE test OR train"""
)
def combinatorial_splits(spark, sf):
    return C.combinatorial(samples(spark, sf), 6, 2, embargo=0.01)


@query(
    """WITH c AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS fold, a, b FROM range(6) x(a), range(6) y(b) WHERE a < b), t AS (SELECT fold, unnest([a, b]) AS grp FROM c)
    SELECT (row_number() OVER (PARTITION BY grp ORDER BY fold) - 1)::INTEGER AS path, grp::INTEGER AS grp, fold::INTEGER AS fold FROM t"""
)
def combinatorial_paths(spark, sf):
    return spark.createDataFrame(C.backtest_paths(6, 2), "path int, grp int, fold int")


@query(f"WITH {CLOSES}, n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM c) SELECT a.symbol, a.seq, {X.sql_us('b.ts')} AS embargo_us FROM n a JOIN c b ON a.symbol = b.symbol AND b.rn = least(a.rn + floor(a.n * 0.05)::BIGINT, a.n)")
def embargo_times(spark, sf):
    return C.embargo_times(closes(spark, sf), 0.05).select("symbol", "seq", us("embargo").alias("embargo_us"))


PREDS = X.SQL_PREDICTIONS


@query(
    f"""WITH {PREDS} SELECT {Q("sum(w * (y = pred)::INTEGER) / sum(w)")} AS weighted_accuracy, {Q("avg((y = pred)::INTEGER)")} AS accuracy,
    {Q("sum(w * ln(greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, CASE WHEN y = 1 THEN p ELSE 1 - p END)))) / sum(w)")} AS neg_log_loss FROM preds"""
)
def weighted_scores(spark, sf):
    y, p, w = F.col("y"), F.col("p"), F.col("w")
    return X.predictions(spark, sf).agg(q6(C.accuracy(y, F.col("pred"), w)).alias("weighted_accuracy"), q6(C.accuracy(y, F.col("pred"))).alias("accuracy"), q6(C.neg_log_loss(y, p, w)).alias("neg_log_loss"))


@query(
    f"""WITH {PREDS}, l AS (SELECT y AS label FROM preds UNION SELECT pred FROM preds),
    c AS (SELECT label, count(*) FILTER (y = label AND pred = label) AS tp, count(*) FILTER (y = label) AS support, count(*) FILTER (pred = label) AS predicted FROM preds, l GROUP BY label),
    r AS (SELECT *, tp::DOUBLE / nullif(predicted, 0) AS p, tp::DOUBLE / nullif(support, 0) AS r FROM c)
    SELECT label, {Q("p")} AS precision, {Q("r")} AS recall, {Q("2 * p * r / nullif(p + r, 0)")} AS f1, support FROM r"""
)
def classification_report(spark, sf):
    return C.classification_report(X.predictions(spark, sf)).select("label", *(q6(c).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"WITH {PREDS} SELECT y, pred, count(*) AS n FROM preds GROUP BY y, pred")
def confusion_matrix(spark, sf):
    return C.confusion(X.predictions(spark, sf))


@query(f"WITH {PREDS}, r AS (SELECT (CASE WHEN pred = 1 THEN 1 ELSE -1 END) * (CASE WHEN y = 1 THEN 1 ELSE -1 END) * 0.01::DOUBLE AS ret FROM preds) SELECT 'all' AS symbol, {Q('avg(ret) / stddev_samp(ret) * sqrt(252::DOUBLE)')} AS sharpe FROM r")
def forecast_sharpe(spark, sf):
    return sharpe(M.forecast_returns(X.predictions(spark, sf)).withColumn("symbol", F.lit("all"))).select("symbol", q6("sharpe").alias("sharpe"))


def _one(spark, **values):
    return spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


@query()
def forest_scores(spark, sf):
    s = samples(spark, sf)
    got = M.train_score(s, FEW, C.holdout(s), M.forest(20), "accuracy")
    return _one(spark, **got)


@query()
def bagged_tree_scores(spark, sf):
    s = samples(spark, sf)
    got = M.train_score(s, FEW, C.holdout(s), M.forest(20, 5, features="all"), "accuracy")
    return _one(spark, **got)


@query()
def out_of_bag_accuracy(spark, sf):
    return _one(spark, oob=M.out_of_bag(samples(spark, sf, len(ALL)), ALL, trees=100))


@query()
def cross_validated_scores(spark, sf):
    s = samples(spark, sf)
    rows = [(kind, float(v)) for kind, splits in (("plain", C.k_fold(s, 3)), ("purged", C.purged_k_fold(s, 3, 0.01)), ("shuffled", C.k_fold(s, 3, seed=1))) for v in M.cv_scores(s, FEW, splits, M.forest(10), "accuracy")]
    return spark.createDataFrame(rows, "kind string, accuracy double")


@query()
def principal_components(spark, sf):
    out, _ = M.principal_components(samples(spark, sf, len(ALL)), ALL)
    return out.select("row_id", *(q6(F.abs(f"pca_{k}")).alias(f"pca_{k}") for k in range(len(ALL))))


@query()
def importance_mdi(spark, sf):
    return M.importance_mdi(samples(spark, sf, len(ALL)), ALL)


@query()
def importance_mda(spark, sf):
    s = samples(spark, sf)
    return M.importance_mda(s, FEW[:4], C.purged_k_fold(s, 2), M.forest(10))[0]


@query()
def importance_sfi(spark, sf):
    s = samples(spark, sf)
    return M.importance_sfi(s, FEW[:3], C.purged_k_fold(s, 2), M.forest(5), "accuracy")


@query()
def grid_search(spark, sf):
    s = samples(spark, sf)
    return M.search(s, FEW, C.purged_k_fold(s, 2), M.grid_nodes([0.1, 10.0], [0.01, 0.1]), size=20)


@query()
def random_search(spark, sf):
    s = samples(spark, sf)
    return M.best_node(M.search(s, FEW, C.purged_k_fold(s, 2), M.log_uniform_nodes(2), size=20))


@query()
def synthetic_samples(spark, sf):
    from ..sources.synthetic import classification

    s = classification(spark, 1000)
    return s.select("row_id", us("t0").alias("t0_us"), "bin", q6("I_0").alias("I_0"), q6("R_0").alias("R_0"), q6("N_0").alias("N_0"))


@query()
def synthetic_signals(spark, sf):
    from ..sources.synthetic import signals

    return signals(spark, 1000).select("seq", us("t0").alias("t0_us"), us("t1").alias("t1_us"), q6("signal").alias("signal"))


@query()
def synthetic_walk(spark, sf):
    from ..sources.synthetic import random_walk

    return random_walk(spark, 5000).select("seq", us("ts").alias("ts_us"), q6("price").alias("price"))
