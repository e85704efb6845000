"""Pair classifiers on Spark ML, and their artifact."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .features import FEATURES

_ROWS = 20_000  # of a task of the boosted trees: each level of each tree is a job, so small inputs want few tasks


def settled(rows: DataFrame) -> DataFrame:
    """The rows kept for several reads: in the checkpoint folder if there is one, as the plan and lineage end there."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.persist()


def fit_gbt(train: DataFrame, trees: int = 160, rate: float = 0.05, depth: int = 6, seed: int = 42) -> PipelineModel:
    """Equal rows of features and label go in once, weighted by their number: same sums, fewer rows."""
    gbt = BoostedTrees(maxIter=trees, stepSize=rate, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label", weightCol="weight")
    rows = train.groupBy("label", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    rows = settled(rows)
    few = rows.coalesce(rows.count() // _ROWS + 1)
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), gbt]).fit(few)
    rows.unpersist()
    return model


def fit_logistic(train: DataFrame, ridge: float = 1e-4) -> PipelineModel:
    lr = LogisticRegression(regParam=ridge, featuresCol="features", labelCol="label")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), lr]).fit(train)


def probabilities(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """Adds the probability of a match."""
    out = model.transform(pairs).withColumn("_p", vector_to_array("probability").getItem(1))
    return out.drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("_p", "probability")


def save(model: PipelineModel, idf_name: DataFrame, idf_addr: DataFrame, threshold: float, path: str) -> None:
    """Model, both weight tables and the threshold, below one path."""
    model.write().overwrite().save(f"{path}/model")
    idf_name.write.mode("overwrite").parquet(f"{path}/idf_name")
    idf_addr.write.mode("overwrite").parquet(f"{path}/idf_addr")
    spark = idf_name.sparkSession
    spark.createDataFrame([(json.dumps({"threshold": threshold}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame, DataFrame, float]:
    threshold = json.loads(spark.read.text(f"{path}/settings").first()[0])["threshold"]
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/idf_name"), spark.read.parquet(f"{path}/idf_addr"), threshold


def best_logistic_threshold(model: PipelineModel, valid: DataFrame) -> float:
    """Threshold with the best F0.5 over pairs, among the model's probabilities rounded to two places."""
    p = probabilities(model, valid).select(F.round("probability", 2).alias("p"), "label").groupBy("p").agg(F.sum("label").alias("hit"), F.count(F.lit(1)).alias("n")).collect()
    rows, total = sorted(((r.p, r.hit, r.n) for r in p), reverse=True), sum(r.hit for r in p)
    best, hit, n = (0.0, 0.5), 0, 0
    for cut, h, k in rows:
        hit, n = hit + h, n + k
        if hit:
            precision, recall = hit / n, hit / total
            best = max(best, (1.25 * precision * recall / (0.25 * precision + recall), cut))
    return best[1]
