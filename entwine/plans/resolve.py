"""End-to-end plans: resolution of record files, training, and their command line.

    python -m entwine.plans.resolve --base-dir DIR [--test-dir DIR] [--output-dir DIR]
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import matching as M
from ..operators import metrics as E
from ..operators import model as L
from ..sources import records as R

log = logging.getLogger(__name__)


def outputs(s1: DataFrame, targets: DataFrame, most: int | None = 100, classic: bool = True) -> tuple[DataFrame, DataFrame]:
    """(candidate rows, match rows), one row per S1 row with src and rowno.

    The decisions are persisted to disk, as both outputs read them.
    """
    decisions = M.resolve(s1, targets, most, classic).select("s_row", "t_row", "s_entity_id", "t_entity_id", "candidate", "is_match").persist(StorageLevel.DISK_ONLY)
    candidates, matches = M.candidates_and_matches(decisions)
    return M.output_rows(s1, candidates, "candidate_entity_ids"), M.output_rows(s1, matches, "matched_entity_ids")


def run(spark: SparkSession, test_dir: str, output_dir: str, most: int = 100, check: bool = True, single: bool = True) -> dict[str, int] | None:
    """Resolves test_source2 and 3 against test_source1; writes both outputs; returns the faults found."""
    s1 = R.read_records(spark, f"{test_dir}/test_source1.tsv")
    targets = R.read_records(spark, [f"{test_dir}/test_source2.tsv", f"{test_dir}/test_source3.tsv"], first_src=1, strict=False)
    if targets is None:
        targets = s1.limit(0)
    candidates, matches = outputs(s1, targets, most)
    for rows, column, name in ((candidates, "candidate_entity_ids", "candidate_pairs.tsv"), (matches, "matched_entity_ids", "matching_results.tsv")):
        R.write_lines(rows, ["source1_entity_id", column], f"{output_dir}/{name}", single)
        log.info("wrote %s/%s", output_dir, name)
    if not check:
        return None
    return R.validate(s1, targets, candidates, matches)


def training_sample(truth: DataFrame, s1: DataFrame, targets: DataFrame, n_train: int = 12_000, n_valid: int = 3_000, distractors: int = 25_000) -> dict[str, DataFrame]:
    """The first rows of the truth, their records, and the targets: matches and the first others of each source.

    ``targets`` has src and rowno; of a repeated id the first record counts.
    """
    sample = R.head(truth, 0, n_train + n_valid)
    train, valid = R.head(truth, 0, n_train).select("source1_entity_id"), R.head(truth, n_train, n_valid).select("source1_entity_id")
    pairs = R.truth_pairs(sample)
    needed = pairs.select(F.col("t_id").alias("entity_id")).distinct()
    found = targets.join(needed, "entity_id", "left_semi")
    from pyspark.sql import Window

    rest = targets.join(needed, "entity_id", "left_anti").withColumn("_rn", F.row_number().over(Window.partitionBy("src").orderBy("rowno"))).filter(F.col("_rn") <= distractors).drop("_rn")
    pool = first_of_id(found.unionByName(rest))

    def of(ids: DataFrame) -> DataFrame:
        return s1.join(ids.withColumnRenamed("source1_entity_id", "entity_id").distinct(), "entity_id", "left_semi")

    return {"train": of(train), "valid": of(valid), "targets": pool, "truth": pairs}


def first_of_id(records: DataFrame) -> DataFrame:
    """One record for each id: the first by (src, rowno)."""
    from pyspark.sql import Window

    w = Window.partitionBy("entity_id").orderBy("src", "rowno")
    return records.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def training_pairs(s1: DataFrame, targets: DataFrame, most: int = 100) -> DataFrame:
    """Candidate pairs without veto, gate or cap; hyphens kept.  Columns: s_/t_ entity_id, names, addresses, tokens."""
    left, right = M.prepared(s1, False), M.prepared(targets, False)
    pairs = M.row_pairs(left, right, most)
    return M.with_bodies(pairs, left, right, ["business_address"])


def featured(pairs: DataFrame, idf_name: DataFrame, idf_addr: DataFrame, classic: bool = True, as_float: bool = True) -> DataFrame:
    """Pairs with the 14 features; weights are joined to each side's records."""
    out = pairs
    for side in ("s", "t"):
        records = pairs.select(F.col(f"{side}_row").alias("row"), F.col(f"{side}_name_tok").alias("name_tok"), F.col(f"{side}_addr_tok").alias("addr_tok")).dropDuplicates(["row"])
        weighed = X.with_weights(X.with_weights(records, idf_name, "name_tok", "name_w", X.NAME_DEFAULT), idf_addr, "addr_tok", "addr_w", X.ADDRESS_DEFAULT)
        out = out.join(weighed.select(F.col("row").alias(f"{side}_row"), F.col("name_w").alias(f"{side}_name_w"), F.col("addr_w").alias(f"{side}_addr_w")), f"{side}_row")
    return X.pair_features(out, classic, as_float)


def weights(pairs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Name and address weights over the S1 side of every pair and every target."""
    t = M.prepared(targets, False)
    names = pairs.select(F.col("s_name_tok").alias("tok")).union(t.select("name_tok"))
    addrs = pairs.select(F.col("s_addr_tok").alias("tok")).union(t.select("addr_tok"))
    return X.idf(names, F.col("tok")), X.idf(addrs, F.col("tok"))


def train(truth: DataFrame, s1: DataFrame, targets: DataFrame, path: str, n_train: int = 12_000, n_valid: int = 3_000, trees: int = 160) -> tuple[float, float]:
    """Fits the boosted trees, picks the threshold by macro F0.5, saves the artifact; returns threshold and score."""
    data = training_sample(truth, s1, targets, n_train, n_valid)
    pool = data["targets"].persist()
    pairs, valid = (training_pairs(data[k], pool).persist() for k in ("train", "valid"))
    idf_name, idf_addr = (w.persist() for w in weights(pairs, pool))
    fitted = L.fit_gbt(X.labelled(featured(pairs, idf_name, idf_addr), data["truth"]).select("label", *X.FEATURES).persist(), trees)
    scored = L.probabilities(fitted, featured(valid, idf_name, idf_addr)).select(F.col("s_entity_id").alias("s1_id"), F.col("t_entity_id").alias("t_id"), "probability").persist()
    ids = data["valid"].select(F.col("entity_id").alias("s1_id"))
    threshold, score = E.best(E.sweep(ids, data["truth"], scored))
    L.save(fitted, idf_name, idf_addr, threshold, path)
    return threshold, score


def _base_dir(given: str | None) -> str:
    if given:
        return given
    here = os.getcwd()
    for base in (here, f"{here}/student_resource"):
        if os.path.isdir(f"{base}/dataset/test"):
            return base
    return here


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Resolve two record files against a reference file.")
    parser.add_argument("--base-dir", help="holds dataset/test; found from the working folder if not given")
    parser.add_argument("--test-dir", help="holds test_source1.tsv, test_source2.tsv and test_source3.tsv")
    parser.add_argument("--output-dir")
    parser.add_argument("--chunksize", type=int, default=200_000, help="accepted and ignored: Spark splits the files")
    parser.add_argument("--skip-validation", action="store_true")
    args = parser.parse_args(argv)
    base = _base_dir(args.base_dir)
    spark = SparkSession.builder.appName("resolve").getOrCreate()
    faults = run(spark, args.test_dir or f"{base}/dataset/test", args.output_dir or f"{base}/output", check=not args.skip_validation)
    for kind, n in (faults or {}).items():
        print(f"{kind}: {n}")
    return int(any((faults or {}).values()))


if __name__ == "__main__":
    sys.exit(main())
