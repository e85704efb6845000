import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler

from entwine.operators import boosting as B
from entwine.operators import model as L
from entwine.operators.features import FEATURES


def _rows(seed, n):
    rng = random.Random(seed)
    for k in range(n):
        v = [rng.random() if i % 3 else float(rng.randrange(5)) for i in range(len(FEATURES))]
        yield (k, int(v[1] + v[2] * v[4] + 0.1 * v[3] + rng.gauss(0, 0.3) > 1), float(rng.randrange(1, 4)), *v)


def test_trees_are_those_of_spark(spark):
    rows = spark.createDataFrame(list(_rows(3, 700)), ["k", "label", "weight", *FEATURES])
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).coalesce(1).persist()
    a, b = (kind(maxIter=5, stepSize=0.05, maxDepth=4, seed=42, weightCol="weight").fit(rows) for kind in (B.BoostedTrees, GBTClassifier))
    got, want = ([list(r.probability) for r in m.transform(rows).orderBy("k").collect()] for m in (a, b))
    assert np.allclose(got, want, rtol=0, atol=1e-9) and len({x[0] for x in got}) > 20
    assert np.allclose(a.featureImportances.toArray(), b.featureImportances.toArray(), rtol=0, atol=1e-4)  # splits that part a node alike are ties
    assert a.treeWeights == b.treeWeights and a.totalNumNodes > 100


def test_jobs_do_not_grow_with_the_trees(spark):
    train = spark.createDataFrame(list(_rows(4, 200)), ["k", "label", "weight", *FEATURES]).drop("weight")
    sc = spark.sparkContext
    jobs = []
    for trees in (2, 160):
        sc.setJobGroup(f"trees-{trees}", "")
        model = L.fit_gbt(train, trees)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"trees-{trees}")))
        assert model.stages[-1].getNumTrees == trees
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] < 20


@pytest.mark.parametrize("label", [0, 1])
def test_one_label_and_constant_features(spark, label):
    train = spark.createDataFrame([(label, *[1.0] * len(FEATURES))] * 5, ["label", *FEATURES])
    p = [r.probability for r in L.probabilities(L.fit_gbt(train, 3), train).collect()]
    assert len(p) == 5 and all(abs(x - label) < 0.15 for x in p)


def test_no_rows_raise(spark):
    with pytest.raises(ValueError, match="need a row"):
        L.fit_gbt(spark.createDataFrame([], ", ".join(["label int", *(f"{f} double" for f in FEATURES)])), 2)


def test_cuts_lie_at_equal_weights():
    assert B.cuts(np.array([1.0, 2.0, 4.0]), np.ones(3), 32) == [1.5, 3.0]
    assert B.cuts(np.arange(64.0), np.ones(64), 4) == [15.5, 31.5, 47.5]
    assert B.cuts(np.array([5.0]), np.ones(1), 4) == []
