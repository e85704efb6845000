import os
import shutil

import pytest

from entwine.plans import resolve as P
from entwine.sources import records as R
from entwine.streaming import resolve as ST
from entwine.operators import matching as M
from .helpers import RECORD, random_records, records

HEAD = "extra\tentity_id\tbusiness_name\tbusiness_address\tcountry\n"


def write(path, rows):
    path.write_text(HEAD + "".join("x\t" + "\t".join("" if v is None else v for v in r) + "\n" for r in rows), encoding="utf-8")


def test_reading(spark, tmp_path):
    write(tmp_path / "a.tsv", [("007", '"Say ""hi"""', "NA", "US"), ("8", "None", "", "FR"), ("9", "é", "n/a x", "null")])
    got = R.read_records(spark, f"{tmp_path}/a.tsv").orderBy("rowno").collect()
    assert [tuple(r)[:4] for r in got] == [("007", 'Say "hi"', None, "US"), ("8", None, None, "FR"), ("9", "é", "n/a x", None)]
    raw = R.read_records(spark, f"{tmp_path}/a.tsv", pandas_na=False).orderBy("rowno").collect()
    assert raw[0].business_address == "NA" and raw[1].business_name == "None"


def test_missing_files(spark, tmp_path):
    write(tmp_path / "b.tsv", [("1", "a", "b", "US")])
    with pytest.raises(FileNotFoundError):
        R.read_records(spark, f"{tmp_path}/none.tsv")
    some = R.read_records(spark, [f"{tmp_path}/none.tsv", f"{tmp_path}/b.tsv"], first_src=1, strict=False)
    assert [(r.entity_id, r.src) for r in some.collect()] == [("1", 2)]
    assert R.read_records(spark, [f"{tmp_path}/none.tsv"], strict=False) is None


def test_head_keeps_file_order(spark, tmp_path):
    write(tmp_path / "c.tsv", [(str(i), "n", "a", "US") for i in range(500)])
    df = R.read_records(spark, f"{tmp_path}/c.tsv")
    assert [r.entity_id for r in R.head(df, 10, 3).orderBy("rowno").collect()] == ["10", "11", "12"]


def test_command_line(spark, tmp_path):
    test = tmp_path / "dataset" / "test"
    test.mkdir(parents=True)
    s1, s2 = random_records(1, 60, 0), random_records(2, 90, 1)
    write(test / "test_source1.tsv", s1)
    write(test / "test_source2.tsv", s2)
    assert P.main(["--base-dir", str(tmp_path), "--chunksize", "10"]) == 0
    lines = (tmp_path / "output" / "matching_results.tsv").read_text().split("\n")
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and [x.split("\t")[0] for x in lines[1:-1]] == [r[0] for r in s1]
    clean = lambda rows: [(a, b, c or None, d) for a, b, c, d in rows]
    _, matches = M.candidates_and_matches(M.resolve(records(spark, clean(s1)), records(spark, clean(s2), 1)))
    want = {}
    for r in matches.collect():
        want.setdefault(r.s_entity_id, []).append(r.t_entity_id)
    assert {x.split("\t")[0]: x.split("\t")[1] for x in lines[1:-1]} == {r[0]: ",".join(sorted(want.get(r[0], []))) for r in s1}
    assert P.main(["--base-dir", str(tmp_path), "--skip-validation"]) == 0


def test_validation_finds_faults(spark):
    s1, t = records(spark, [("a", "x", "y", "US"), ("b", "x", "y", "US")]), records(spark, [("t1", "x", "y", "US")], 1)
    c = spark.createDataFrame([("a", "t1,t1"), ("c", "")], "source1_entity_id string, candidate_entity_ids string")
    m = spark.createDataFrame([("a", "t9"), ("b", "")], "source1_entity_id string, matched_entity_ids string")
    assert R.validate(s1, t, c, m) == {"candidate_rows": 2, "match_rows": 0, "unknown_candidates": 0, "unknown_matches": 1, "repeated_ids": 1, "matches_beyond_candidates": 1}


def test_folder_output(spark, tmp_path):
    rows = records(spark, [("b", "x", "y", "US"), ("a", "x", None, "US")])
    R.write_lines(rows, ["entity_id", "business_address"], f"{tmp_path}/out", single=False)
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["b\ty", "a\t"]


def test_stream_equals_batch(spark, tmp_path):
    s1 = records(spark, random_records(1, 60, 0)).persist()
    targets = records(spark, random_records(2, 400, 1), 1)
    batch = [{tuple(r) for r in x.collect()} for x in M.candidates_and_matches(M.resolve(s1, targets))]
    os.makedirs(f"{tmp_path}/all")
    for k in range(4):
        targets.filter(f"rowno div 100 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        part = next(f for f in os.listdir(f"{tmp_path}/in/{k}") if f.endswith(".parquet"))
        shutil.copy(f"{tmp_path}/in/{k}/{part}", f"{tmp_path}/all/{k}.parquet")
        os.utime(f"{tmp_path}/all/{k}.parquet", (1_000_000 + k, 1_000_000 + k))  # the stream's order
    ordered = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/all")
    ST.resolve_stream(s1, ordered, f"{tmp_path}/out2", f"{tmp_path}/check").awaitTermination(240)
    got = [{tuple(r) for r in x.collect()} for x in ST.results(spark, f"{tmp_path}/out2")]
    assert got == batch
