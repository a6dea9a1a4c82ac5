"""The two-branch head: its gradient, its weights, its end."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from parlance.operators import branches, evaluate, fusion
from parlance.session import materialize


@pytest.mark.parametrize("features", [0, 3])
def test_gradient_against_differences(features):
    rng = np.random.default_rng(0)
    kinds = branches.shapes(5, features, 4, 3)
    theta = branches.start(kinds, 1)
    text, numbers, y, weight = rng.normal(size=(20, 5)), rng.normal(size=(20, features)), rng.integers(0, 3, 20), rng.random(20)
    loss, slope = branches.loss_and_gradient(theta, kinds, text, numbers, y, weight)
    for k in range(len(theta)):
        step = np.zeros_like(theta)
        step[k] = 1e-6
        up, down = (branches.loss_and_gradient(theta + s * step, kinds, text, numbers, y, weight)[0] for s in (1, -1))
        assert slope[k] == pytest.approx((up - down) / 2e-6, abs=1e-5)


@pytest.fixture(scope="module")
def rows(spark):
    """A rare class that overlaps a common one, and a ring that no linear head can tell."""
    rng = np.random.default_rng(4)
    out = []
    for k in range(400):
        c = "rare" if k % 16 == 0 else ("ring" if k % 2 else "core")
        v = rng.normal(size=2) * 0.5
        if c == "ring":
            turn = rng.random() * 2 * np.pi
            v = np.array([3 * np.cos(turn), 3 * np.sin(turn)])
        out.append((k, c, Vectors.dense((v + (0.6 if c == "rare" else 0)).tolist()), float(v[0] ** 2), float(rng.normal())))
    return materialize(spark.createDataFrame(out, ["id", "label", "embedding", "a", "b"]).coalesce(1), "rows")


def test_sums_over_tasks_are_those_of_all_rows(rows):
    kinds = branches.shapes(2, 2, 4, 3)
    theta, labels = branches.start(kinds, 2), ["core", "rare", "ring"]
    weighted = rows.withColumn("weight", F.lit(0.5) + F.col("id") % 3)
    loss, weight, slope = branches.summed(weighted.repartition(7).select("embedding", "a", "b", "label", "weight"), kinds, ["a", "b"], labels, theta)
    local = weighted.collect()
    want = branches.loss_and_gradient(
        theta, kinds, np.array([r["embedding"].toArray() for r in local]), np.array([[r["a"], r["b"]] for r in local]), np.array([labels.index(r["label"]) for r in local]), np.array([r["weight"] for r in local])
    )
    assert loss == pytest.approx(want[0]) and weight == pytest.approx(sum(r["weight"] for r in local)) and slope == pytest.approx(want[1])


def test_weights_raise_the_rare_class_recall(rows):
    recall = {}
    for name, weight in (("plain", F.lit(1.0)), ("balanced", F.when(F.col("label") == "rare", 10.0).otherwise(0.7))):
        model = fusion.fit_fusion(rows.withColumn("weight", weight), ["a", "b"], head="mlp", embedding_dim=2, hidden=8, tol=0.05)
        found = fusion.predict_fusion(model, rows)
        recall[name] = {r["langue"]: r["recall"] for r in evaluate.per_class(found, "label", "predicted_label").collect()}
        assert recall[name]["ring"] > 0.8
    assert recall["balanced"]["rare"] > recall["plain"]["rare"] + 0.3


def test_text_only_and_limits(rows):
    model = fusion.fit_fusion(rows.withColumn("weight", F.lit(1.0)), [], head="mlp", embedding_dim=2, tol=0.2)
    assert "feature" not in model.kinds and model.passes >= model.steps
    with pytest.raises(RuntimeError, match="gradient"):
        fusion.fit_fusion(rows.withColumn("weight", F.lit(1.0)), [], head="mlp", embedding_dim=2, max_iter=1)
    with pytest.raises(RuntimeError, match="convergence"):
        fusion.fit_fusion(rows.withColumn("weight", F.lit(1.0)), ["a"], max_iter=1)
