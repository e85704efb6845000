"""Record files: tab-separated sources and sinks, and records derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import MISSING_MARKS

COLUMNS = ["entity_id", "business_name", "business_address", "country"]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def read_tsv(spark: SparkSession, path: str, columns: list[str], pandas_na: bool = True, multi_line: bool = False) -> DataFrame:
    """The named columns of a tab-separated file with a header, as strings, and ``rowno`` in file order.

    ``pandas_na`` reads the marks that pandas takes for missing as null.
    """
    raw = spark.read.option("sep", "\t").option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
    order = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    out = raw.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns), order.alias("rowno"))
    if pandas_na:
        out = out.withColumns({c: F.when(~F.col(c).isin(*MISSING_MARKS), F.col(c)) for c in columns})
    return out


def read_records(spark: SparkSession, paths: str | list[str], first_src: int = 0, strict: bool = True, pandas_na: bool = True) -> DataFrame | None:
    """Records of one or more files in list order: COLUMNS, src (place in the list), rowno.

    A missing file raises unless ``strict`` is off; then it is passed over.  None if no file is left.
    """
    out = None
    for i, path in enumerate([paths] if isinstance(paths, str) else paths, first_src):
        if not exists(spark, path):
            if strict:
                raise FileNotFoundError(path)
            continue
        one = read_tsv(spark, path, COLUMNS, pandas_na).withColumn("src", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def head(rows: DataFrame, first: int, count: int) -> DataFrame:
    """Rows first + 1 .. first + count in the order of ``rowno``."""
    return rows.orderBy("rowno").offset(first).limit(count)


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(s1_id, t_id) of a ground-truth table with source1_entity_id and comma-joined matched_entity_ids."""
    from ..functions.text import split_cell

    return truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode(split_cell(F.col("matched_entity_ids"))).alias("t_id"))


def write_lines(rows: DataFrame, columns: list[str], path: str, single: bool = True) -> None:
    """Tab-separated text with a header and no quoting, in (src, rowno) order, replacing what is there.

    ``single`` makes ``path`` one file, as its readers expect; otherwise it is a folder of parts
    without a header, which is how large results should be written.
    """
    spark = rows.sparkSession
    line = F.concat_ws("\t", *(F.coalesce(c, F.lit("")) for c in columns)).alias("value")
    if not single:
        rows.orderBy("src", "rowno").select(line).write.mode("overwrite").text(path)
        return
    parts = f"{path}.parts"
    rows.orderBy("src", "rowno").select(line).coalesce(1).write.mode("overwrite").text(parts)
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    target, folder = hadoop.fs.Path(path), hadoop.fs.Path(parts)
    fs = target.getFileSystem(conf)
    out = fs.create(target, True)
    out.write(bytearray(("\t".join(columns) + "\n").encode()))
    for status in fs.listStatus(folder):
        if status.getPath().getName().startswith("part-"):
            part = fs.open(status.getPath())
            hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
    out.close()
    fs.delete(folder, True)


def validate(s1: DataFrame, targets: DataFrame, candidates: DataFrame, matches: DataFrame) -> dict[str, int]:
    """Faults of the two outputs by kind; all zero if they are sound.

    Outputs have source1_entity_id and candidate_entity_ids or matched_entity_ids.
    """
    from ..functions.text import split_cell

    def cells(out: DataFrame, column: str) -> DataFrame:
        return out.select("source1_entity_id", F.explode(F.split(column, ",")).alias("t_id")).filter("t_id <> ''")

    def rows(out: DataFrame) -> int:
        have = out.groupBy("source1_entity_id").agg(F.count(F.lit(1)).alias("n"))
        want = s1.groupBy(F.col("entity_id").alias("source1_entity_id")).agg(F.count(F.lit(1)).alias("m"))
        return have.join(want, "source1_entity_id", "full").filter("coalesce(n, 0) <> coalesce(m, 0)").count()

    c, m = cells(candidates, "candidate_entity_ids"), cells(matches, "matched_entity_ids")
    known = targets.select(F.col("entity_id").alias("t_id")).distinct()
    repeated = [x.filter(F.size(F.split(col, ",")) > F.size(split_cell(F.col(col)))).filter(F.col(col) != "").count() for x, col in ((candidates, "candidate_entity_ids"), (matches, "matched_entity_ids"))]
    return {
        "candidate_rows": rows(candidates),
        "match_rows": rows(matches),
        "unknown_candidates": c.join(known, "t_id", "left_anti").count(),
        "unknown_matches": m.join(known, "t_id", "left_anti").count(),
        "repeated_ids": sum(repeated),
        "matches_beyond_candidates": m.distinct().join(c.distinct(), ["source1_entity_id", "t_id"], "left_anti").count(),
    }


def _dealt(records: DataFrame) -> DataFrame:
    """The driver's tables are one row group each; narrow records are dealt out before the costly expressions."""
    return records.repartition(records.sparkSession.sparkContext.defaultParallelism)


def er_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made of the part table: generic chains, typos, web names, missing addresses."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    records = p.selectExpr(
        "concat('S', 1 + p_partkey % 3, '-', lpad(cast(p_partkey as string), 8, '0')) as entity_id",
        "p_partkey as rowno",
        "cast(p_partkey % 3 as int) as src",
        "concat(case when p_partkey % 3 > 0 and p_partkey % 7 = 3 then 'r' else '' end, p_name, ' ', p_type, case when p_partkey % 3 > 0 and p_partkey % 5 = 1 then ' hub.com' else '' end) as business_name",
        "case when p_partkey % 11 = 4 then null when p_partkey % 13 = 5 then concat(p_type, ' ', 10000 + p_size) else concat(p_size, ' ', p_type, ' ', p_brand, ' ', 10000 + p_size) end as business_address",
        "case when (p_partkey div 3) % 10 = 0 then 'FR' else 'US' end as country",
    )
    return _dealt(records)


def er_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made of the documents table: accents, near copies, ids over the match cap."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the first ten words are cut out first, as each use of them is evaluated again
    w = d.withColumn("head", F.regexp_extract("text", r"^\s*+((?:\S++\s++){9}\S++)", 1)).filter("head <> ''").withColumn("w", F.split("head", r"\s+"))
    records = w.selectExpr(
        "concat('S', 1 + doc_id % 3, '-', lpad(cast(doc_id as string), 8, '0')) as entity_id",
        "doc_id as rowno",
        "cast(doc_id % 3 as int) as src",
        "array_join(slice(w, 1, 4), ' ') as business_name",
        "concat(length(w[4]) * 100 + length(w[5]) * 10 + length(w[6]), ' ', array_join(slice(w, 5, 6), ' ')) as business_address",
        "lang as country",
    )
    return _dealt(records)
