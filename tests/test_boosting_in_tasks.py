"""Folds of up to TASK_ROWS rows are fitted by one task for each model: the trees of the passes, and no Spark job for a round."""

import numpy as np
import pytest

from rivalry.operators import boosting as B
from rivalry.plans.base import stored

FOLDS = [2002, 2003]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4))
    x = np.column_stack([x[:, 0], x[:, 1:].round(1)])
    x[:, 1] = x[:, 1].round()
    y = (x @ np.array([[0, 0.6, 1.0], [0, -0.1, 0.5], [0, 1, 2], [0, 0, -1]]) + rng.gumbel(size=(600, 3))).argmax(1)
    made = [(i, 2001 + i % 3, int(y[i]), *map(float, x[i])) for i in range(len(x))]
    return stored(spark.createDataFrame(made, "contest_id long, season int, result int, a double, b double, c double, d double"), "boosted")


def test_tasks_grow_the_trees_of_the_passes(rows, monkeypatch):
    settings = {"deep": B.Boost(tuple("abcd"), trees=5, rate=0.3, leaves=15, depth=4, least=8), "few": B.Boost(("c", "a"), trees=3, rate=0.2, leaves=3, depth=2, least=30, alpha=0.5, lam=2.0)}
    folds = {"deep": FOLDS, "few": FOLDS[1:]}
    got = B.fit_boosted(rows, settings, folds, stored)
    monkeypatch.setattr(B, "TASK_ROWS", 0)
    want = B.fit_boosted(rows, settings, folds, stored)
    assert set(got) == set(want)
    for key, fit in want.items():
        assert all(np.array_equal(a, b) for a, b in zip(got[key]["limits"], fit["limits"], strict=True))
        assert len(got[key]["trees"]) == len(fit["trees"])
        for mine, other in zip(got[key]["trees"], fit["trees"], strict=True):
            for a, b in zip(mine, other, strict=True):
                inner = a.feature >= 0
                assert a.feature.tolist() == b.feature.tolist() and a.bin[inner].tolist() == b.bin[inner].tolist()
                assert np.abs(a.value - b.value).max() < 1e-9


def test_rounds_need_no_jobs(spark, rows):
    def jobs(trees):
        spark.sparkContext.setJobGroup(f"boosted-{trees}", "")
        try:
            B.fit_boosted(rows, {"x": B.Boost(("a", "b"), trees=trees, least=8)}, {"x": FOLDS}, stored)
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boosted-{trees}"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    assert jobs(2) == jobs(8)


def test_a_null_feature_fails(rows):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError, match="null"):
        B.fit_boosted(rows.withColumn("a", F.when(F.col("contest_id") != 7, F.col("a"))), {"x": B.Boost(("a",), trees=1)}, {"x": FOLDS}, stored)
