"""Shared plumbing: the shared folder, written intermediate tables, Arrow batch sizes."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and U+0009-U+000D.
WS = "[ \\t-\\r]+"


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.size(F.array_remove(F.split(text, WS), "")), F.lit(0)).cast("long")


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores in front until no column has it (names differ by more than case)."""
    have, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def arrow_rows(spark: SparkSession, rows: int = 256) -> None:
    """Let Arrow batches hold few rows, since one text can be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) != rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and all runs on one machine, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="entwine-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found, True)
    return found.rstrip("/")


def free_memory(spark: SparkSession) -> bool:
    """Collects the driver's garbage, and lets its JVM give free native memory back to the system; false if it can't.

    Spark deletes the shuffle files of finished steps when their garbage is collected.  What the
    JVM's compilers and plans allocate outside the heap stays with malloc otherwise: some 150 MB
    after the many plans of near-dedup.  JDKs before 17.0.9 have no command for it.
    """
    gc.collect()
    jvm = spark._jvm
    jvm.System.gc()
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        call = next(m for m in jvm.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")  # the server's own class is closed to Py4J
        args = spark.sparkContext._gateway.new_array(jvm.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(server, args)
    except Py4JError:
        return False
    return True


class Scratch:
    """Tables written to the shared folder while an operator runs.

    A written table cuts the lineage: it outlives the executors that made it and is
    read as many times as needed.  ``drop`` removes those that the result doesn't read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        schema = df.schema
        del df
        free_memory(self.spark)
        out = self.spark.read.schema(schema).parquet(path)
        out._entwine_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._entwine_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
