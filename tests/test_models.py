import pytest
from pyspark.sql import functions as F

from barloom.operators import cv, models, weights
from barloom.sources import synthetic

NAMES = ["I_0", "I_1", "N_0", "N_1"]


@pytest.fixture(scope="module")
def samples(spark):
    return synthetic.classification(spark, 400, informative=2, redundant=0, noise=2, seed=5).persist()


def test_forest_learns(spark, samples):
    got = models.train_score(samples, NAMES, cv.holdout(samples), models.forest(15), "accuracy")
    assert got["train"] > 0.85 and got["test"] > 0.75
    assert 0.75 < models.out_of_bag(samples, NAMES, trees=6) <= 1


def test_importances_tell_signal_from_noise(spark, samples):
    mdi = {r["feature"]: r["mean"] for r in models.importance_mdi(samples, NAMES, trees=15).collect()}
    assert sum(mdi.values()) == pytest.approx(1) and min(mdi["I_0"], mdi["I_1"]) > max(mdi["N_0"], mdi["N_1"])
    found, base = models.importance_mda(samples, NAMES, cv.purged_k_fold(samples, 2), models.forest(10))
    mda = {r["feature"]: r["mean"] for r in found.collect()}
    assert min(mda["I_0"], mda["I_1"]) > max(mda["N_0"], mda["N_1"]) and base < 0
    first = models.importance_sfi(samples, NAMES, cv.k_fold(samples, 2), models.forest(8), "accuracy").first()
    assert first["feature"] in ("I_0", "I_1")
    with pytest.raises(ValueError):
        models.feature_importance(samples, NAMES, "XYZ", cv.k_fold(samples, 2))


def test_search_prefers_a_fitting_node(spark, samples):
    splits = cv.purged_k_fold(samples, 2)
    got = models.search(samples, ["I_0", "I_1"], splits, models.grid_nodes([10.0], [0.1, 1000.0]), size=30)
    best = models.best_node(got).first()
    assert best["gamma"] == 0.1 and [r["score"] for r in got.collect()] == sorted((r["score"] for r in got.collect()), reverse=True)
    assert models.log_uniform_nodes(5, seed=1) == models.log_uniform_nodes(5, seed=1)
    assert all(1e-2 <= n["c"] <= 1e2 for n in models.log_uniform_nodes(50))
    assert models.close_scores(-0.4, -0.5) and not models.close_scores(-0.1, -0.5)


def test_components_and_weights(spark, samples):
    out, share = models.principal_components(samples, NAMES)
    assert sum(share) == pytest.approx(1) and share == sorted(share, reverse=True)
    m = out.agg(*(F.avg(f"pca_{k}").alias(f"m{k}") for k in range(4))).first()
    assert all(abs(v) < 1e-9 for v in m)
    w = weights.class_weights(samples)
    assert w.agg(F.sum("class_weight")).first()[0] == pytest.approx(400)
