"""Macro-averaged precision, recall and F0.5, in two definitions, and the threshold sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f_half(p: Column, r: Column) -> Column:
    """1.25 p r / (0.25 p + r); 0 where both are 0."""
    return F.when(p + r == 0, 0.0).otherwise(1.25 * p * r / F.greatest(0.25 * p + r, F.lit(1e-300)))


def per_id(ids: DataFrame, actual: DataFrame, predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_actual, n_predicted and n_both of each id; pairs are (s1_id, t_id) and may repeat.  ``by`` splits the predictions."""
    by = by or []
    actual, predicted = actual.select("s1_id", "t_id").distinct(), predicted.select(*by, "s1_id", "t_id").distinct()
    marked = predicted.join(actual.withColumn("hit", F.lit(1)), ["s1_id", "t_id"], "left")
    pred = marked.groupBy(*by, "s1_id").agg(F.count(F.lit(1)).alias("n_predicted"), F.count("hit").alias("n_both"))
    act = actual.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_actual"))
    out = ids.join(act, "s1_id", "left").join(pred, [*by, "s1_id"], "left")
    return out.fillna(0, ["n_actual", "n_predicted", "n_both"])


def strict_scores(counts: DataFrame) -> DataFrame:
    """Nothing predicted counts as precise only where nothing is to be found; recall of nothing is 1."""
    n = F.greatest("n_predicted", F.lit(1)), F.greatest("n_actual", F.lit(1))
    p = F.when(F.col("n_predicted") > 0, F.col("n_both") / n[0]).otherwise(F.when(F.col("n_actual") == 0, 1.0).otherwise(0.0))
    r = F.when(F.col("n_actual") > 0, F.col("n_both") / n[1]).otherwise(1.0)
    return counts.withColumn("p", p).withColumn("r", r).withColumn("f", f_half(F.col("p"), F.col("r")))


def lenient_scores(counts: DataFrame) -> DataFrame:
    """Counts divide by one at least, and an id without matches scores 1 whatever is predicted."""
    p, r = F.col("n_both") / F.greatest("n_predicted", F.lit(1)), F.col("n_both") / F.greatest("n_actual", F.lit(1))
    out = counts.withColumn("p", p).withColumn("r", r)
    none = (F.col("p") == 0) & (F.col("r") == 0)
    return out.withColumn("f", F.when(none, F.when(F.col("n_actual") == 0, 1.0).otherwise(0.0)).otherwise(f_half(F.col("p"), F.col("r"))))


def macro(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scores.groupBy(*(by or [])).agg(F.avg("f").alias("f05"), F.avg("p").alias("precision"), F.avg("r").alias("recall"))


def thresholds() -> list[float]:
    """0.35 to 0.80 in steps of 0.05, with the drift of repeated addition that numpy.arange has."""
    import numpy as np

    return np.arange(0.35, 0.85, 0.05).tolist()


def sweep(ids: DataFrame, actual: DataFrame, scored: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """threshold, f05, precision, recall; ``scored`` has s1_id, t_id, probability."""
    spark = scored.sparkSession
    grid = thresholds() if grid is None else grid
    # positions join, so that no double is compared for equality
    cuts = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("threshold")) for i, x in enumerate(grid)))
    above = scored.withColumn("c", F.explode(cuts)).filter(F.col("probability") >= F.col("c.threshold")).select(F.col("c.i").alias("i"), "s1_id", "t_id")
    all_ids = ids.select("s1_id").withColumn("i", F.explode(F.array(*(F.lit(i) for i in range(len(grid))))))
    out = macro(strict_scores(per_id(all_ids, actual, above, ["i"])), ["i"])
    steps = spark.createDataFrame(list(enumerate(grid)), "i int, threshold double")
    return out.join(F.broadcast(steps), "i").select("threshold", "f05", "precision", "recall")


def best(swept: DataFrame) -> tuple[float, float]:
    """(threshold, f05): the highest score, the lowest threshold on ties; 0.5 where all are 0."""
    row = swept.orderBy(F.desc("f05"), "threshold").first()
    return (row.threshold, row.f05) if row and row.f05 > 0 else (0.5, 0.0)
