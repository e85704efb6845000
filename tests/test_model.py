import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler

from entwine.operators import model as L
from entwine.operators.features import FEATURES


def test_boosted_trees_read_equal_rows_once(spark, monkeypatch):
    rng = random.Random(5)
    kinds = [(k, int(sum(v) + rng.random() > 7.5), *v) for k in range(40) for v in [[float(rng.randrange(2)) for _ in FEATURES]]]
    rows = [r for r in kinds for _ in range(rng.randrange(1, 9))]
    train = spark.createDataFrame(rows, ["k", "label", *FEATURES])
    gbt = GBTClassifier(maxIter=4, stepSize=0.05, maxDepth=3, seed=42, featuresCol="features", labelCol="label")
    plain = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), gbt]).fit(train)

    seen = []

    class Seen(Pipeline):
        def _fit(self, dataset):
            seen.append((dataset.count(), dataset.rdd.getNumPartitions()))
            return super()._fit(dataset)

    monkeypatch.setattr(L, "Pipeline", Seen)
    fitted = L.fit_gbt(train.repartition(30), 4, 0.05, 3)
    assert seen == [(len(set(r[1:] for r in kinds)), 1)]
    each = spark.createDataFrame(kinds, ["k", "label", *FEATURES])
    got, want = ([r.probability for r in L.probabilities(m, each).orderBy("k").collect()] for m in (fitted, plain))
    assert got == pytest.approx(want, abs=1e-9) and len(set(got)) > 3
