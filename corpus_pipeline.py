"""A corpus from raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's
rows to the shared folder and reads them again as the next stage's docs.  Every stage works
on all rows its predecessor kept.  All but the last return the columns of ``documents``.

1. language ID: drops documents without a letter and those whose language is uncertain.
2. near-dedup: keeps the first document of each group of near copies, one row per id and text.
3. decontamination: drops documents that hold a benchmark item.
4. mixing: sources in their target shares, in the order of the schedule's slots; a document
   taken twice is two rows, one cut short by its source's target keeps the words taken.
5. token output: writes token segments in the order in which stage 4 wrote its rows, so that
   the token stream is the mix, and returns doc_id, start, n_tokens, ids_crc32.

Null ids, repeated ids and further columns, whatever their names, stay through all stages but
the last.  An empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.llm.common import Scratch
from entwine.llm.decontaminate import decontaminate
from entwine.llm.langid import identify, learn
from entwine.llm.mixing import mixed_documents
from entwine.llm.neardup import drop_near_duplicates
from entwine.llm.tokens import token_table

LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = identify(docs, learn(docs))
    lang, score = (F.col(f"`{c}`") for c in found.columns[-2:])
    return found.filter((lang != "und") & (score >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_table(docs, stored_order=True)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir))
        if hasattr(before, "_entwine_path"):
            scratch.drop(before)
    return docs


#: Trained models and subword vocabularies are beyond SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None
