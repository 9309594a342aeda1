"""Queries over SAMPLES that take every feature."""

import pytest

from barloom.plans import catalog

DATA = "/root/testdata/sf0.001"
FEATURES = [f"f{k}" for k in range(64)]


def test_components_of_all_features(spark):
    out = catalog.QUERIES["principal_components"](spark, DATA)
    assert out.columns == ["row_id", *(f"pca_{k}" for k in range(64))] and out.count() == 500


def test_impurity_of_all_features(spark):
    found = {r["feature"]: r["mean"] for r in catalog.QUERIES["importance_mdi"](spark, DATA).collect()}
    assert sorted(found) == sorted(FEATURES) and sum(found.values()) == pytest.approx(1)


def test_out_of_bag_takes_all_features_and_100_trees(spark, monkeypatch):
    from barloom.plans import models

    seen = {}
    monkeypatch.setattr(models.M, "out_of_bag", lambda df, names, trees: seen.update(names=list(names), trees=trees, columns=df.columns) or 0.5)
    assert catalog.QUERIES["out_of_bag_accuracy"](spark, DATA).first()["oob"] == 0.5
    assert seen["names"] == FEATURES and seen["trees"] == 100 and set(FEATURES) <= set(seen["columns"])
