"""Resolution of a stream of target records against a fixed reference table.

Every micro-batch runs the batch plan; the caps per S1 id go on from the pairs of earlier
batches, which are read back from the output.  A batch writes its own folder and replaces it
when it is run again, so a restart gives the same result.  Streamed in (src, rowno) order, the
output equals the batch plan's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import matching as M
from ..sources.records import exists

CAPS = {"candidate": 15, "is_match": 10}
_PAIR = "s_entity_id string, t_entity_id string, batch long"


def _earlier(spark: SparkSession, path: str, kind: str, batch: int) -> DataFrame:
    """Pairs kept per S1 id by batches before this one."""
    folder = f"{path}/{kind}"
    if not exists(spark, folder):
        return spark.createDataFrame([], "s_entity_id string, n long")
    rows = spark.read.schema(_PAIR).option("basePath", folder).parquet(folder).filter(F.col("batch") < batch)
    return rows.groupBy("s_entity_id").agg(F.count(F.lit(1)).alias("n"))


def resolve_stream(s1: DataFrame, stream: DataFrame, path: str, checkpoint: str, most: int = 100, classic: bool = True) -> StreamingQuery:
    """Starts the query on all records available; ``stream`` has the record columns, src and rowno."""

    def step(targets: DataFrame, batch: int) -> None:
        spark = targets.sparkSession
        decisions = M.resolve(s1, targets, most, classic).persist()
        for kind, cap in CAPS.items():
            ranked = M.first_per_entity(decisions.filter(kind), cap)
            order = M.Window.partitionBy("s_entity_id").orderBy("t_row", "s_row")
            kept = ranked.withColumn("rn", F.row_number().over(order)).join(_earlier(spark, path, kind, batch), "s_entity_id", "left")
            kept = kept.filter(F.col("rn") + F.coalesce("n", F.lit(0)) <= cap)
            kept.select("s_entity_id", "t_entity_id").write.mode("overwrite").parquet(f"{path}/{kind}/batch={batch}")
        decisions.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(candidates completed by the matches, matches) written so far."""
    candidates, matches = (spark.read.schema(_PAIR).option("basePath", f"{path}/{k}").parquet(f"{path}/{k}").select("s_entity_id", "t_entity_id") for k in CAPS)
    return candidates.union(matches).distinct(), matches.distinct()
