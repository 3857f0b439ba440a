"""Queries over embeddings use every element of every vector."""

import numpy as np

from conftest import SMALL
from tilework import plans
from tilework.operators import explain
from tilework.plans import models


def test_queries_read_all_elements(spark, monkeypatch):
    width = len(spark.read.parquet(f"{SMALL}/embeddings.parquet").first()["embedding"])
    seen = {}
    monkeypatch.setattr(models.boost, "train_multiclass", lambda rows, features, *a: seen.update(m_train_multiclass=features))
    monkeypatch.setattr(models.explain, "pca3", lambda rows, features, *a: seen.update(m_pca=features))
    monkeypatch.setattr(models, "_curve", lambda spark, run: run)
    for name in ("m_train_multiclass", "m_pca"):
        plans.queries()[name](spark, SMALL)
        assert len(seen[name]) == width


def test_components_are_those_of_all_rows(spark):
    x = np.random.default_rng(1).normal(size=(300, 4)) @ np.diag([1, 2, 3, 4]) + np.arange(4)
    x[:, 1] += x[:, 0]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", "f0", "f1", "f2", "f3"])
    got = {r["id"]: [r["pc1"], r["pc2"], r["pc3"]] for r in explain.pca3(df, ["f0", "f1", "f2", "f3"], "id", 20).collect()}
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    axes = np.linalg.svd(z - z.mean(0), full_matrices=False)[2][:3].T
    axes *= np.sign(axes[np.abs(axes).argmax(0), range(3)])
    assert len(got) == 20 and all(np.allclose(got[i], z[i] @ axes, atol=1e-6) for i in got)
