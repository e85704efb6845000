import inspect
import math

import pytest
from pyspark.sql import functions as F

from entwine import queries
from entwine.operators import features as X
from entwine.operators import metrics as E
from entwine.operators import model as L
from entwine.plans import resolve as P
from .helpers import random_records, records

CASES = {"both_none": ([], [], 1.0, 1.0), "false_hit": ([], ["x"], 0.0, 1.0), "missed": (["a"], [], 0.0, 0.0), "half": (["a", "b"], ["a"], 0.8333, 0.8333), "extra": (["a"], ["a", "b"], 0.5556, 0.5556)}


@pytest.mark.parametrize("scores, which", [(E.strict_scores, 2), (E.lenient_scores, 3)])
def test_f_half_tables(spark, scores, which):
    ids = spark.createDataFrame([(k,) for k in CASES], "s1_id string")
    pair = "s1_id string, t_id string"
    actual = spark.createDataFrame([(k, t) for k, c in CASES.items() for t in c[0]], pair)
    predicted = spark.createDataFrame([(k, t) for k, c in CASES.items() for t in c[1] * 2], pair)
    out = scores(E.per_id(ids, actual, predicted))
    assert {r.s1_id: r.f for r in out.collect()} == pytest.approx({k: c[which] for k, c in CASES.items()}, abs=5e-5)
    assert E.macro(out).first().f05 == pytest.approx(sum(c[which] for c in CASES.values()) / 5, abs=5e-5)


def test_sweep_and_best(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "s1_id string")
    actual = spark.createDataFrame([("a", "1"), ("b", "2")], "s1_id string, t_id string")
    scored = spark.createDataFrame([("a", "1", 0.9), ("b", "2", 0.6), ("b", "3", 0.5)], "s1_id string, t_id string, probability double")
    swept = E.sweep(ids, actual, scored)
    assert swept.count() == 10 and len(E.thresholds()) == 10
    threshold, score = E.best(swept)
    assert score == 1.0 and threshold == pytest.approx(0.55)
    assert E.best(swept.filter("f05 < 0")) == (0.5, 0.0)
    assert 0.49999999999999994 in E.thresholds()


def test_idf(spark):
    df = spark.createDataFrame([(["a", "a"],)] + [(["b"],)] * 8, "t array<string>")
    got = {r.token: r.idf for r in X.idf(df, F.col("t")).collect()}
    assert got == pytest.approx({"a": math.log(10 / 2) + 1, "b": math.log(10 / 9) + 1})


def test_features_of_equal_records(spark):
    row = ("a", "Blue Moon Cafe", "12 Main St, Austin 78701", "US")
    pairs = P.training_pairs(records(spark, [row]), records(spark, [row], 1))
    out = P.featured(pairs, *P.weights(pairs, records(spark, [row], 1))).first()
    want = dict.fromkeys(X.FEATURES, 1.0) | {"num_conf": 0.0, "comp": 8.9}
    assert {k: out[k] for k in X.FEATURES} == pytest.approx(want, abs=1e-6)


def test_features_of_unknown_tokens(spark):
    pairs = P.training_pairs(records(spark, [("a", "Blue Moon", "1 Oak Rd", "US")]), records(spark, [("b", "Blue Star", None, "US")], 1), 100)
    none = spark.createDataFrame([], "token string, idf double")
    assert pairs.count() == 0  # no shared key
    pairs = P.training_pairs(records(spark, [("a", "Blue Moon Cafe", "1 Oak Rd", "US")]), records(spark, [("b", "Blue Moon", None, "US")], 1), 100)
    out = P.featured(pairs, none, none).first()
    assert out.w_nd == pytest.approx(2 * 12 / 30) and out.w_ad == 0 and out.ad == 0 and out.lr_a == 0


def test_training_end_to_end(spark, tmp_path):
    s1 = records(spark, random_records(1, 60, 0))
    targets = records(spark, random_records(2, 120, 1), 1)
    pairs = P.training_pairs(s1, targets).filter("s_compact = t_compact").select("s_entity_id", "t_entity_id").collect()
    truth = {r.s_entity_id: [] for r in pairs}
    for r in pairs:
        truth[r.s_entity_id].append(r.t_entity_id)
    rows = [(f"S1-{i}", ",".join(truth.get(f"S1-{i}", [])) or None, i) for i in range(60)]
    table = spark.createDataFrame(rows, "source1_entity_id string, matched_entity_ids string, rowno long")
    sample = P.training_sample(table, s1, targets, 40, 20, 25)
    assert sample["train"].count() == 40 and sample["valid"].count() == 20
    threshold, score = P.train(table, s1, targets, f"{tmp_path}/m", 40, 20, trees=5)
    model, names, addrs, kept = L.load(spark, f"{tmp_path}/m")
    assert kept == threshold and 0 < score <= 1 and names.count() and addrs.count()
    again = L.probabilities(model, P.featured(P.training_pairs(s1, targets), names, addrs))
    assert again.filter("probability < 0 or probability > 1").count() == 0


def test_gbt_query_fits_the_whole_operator(monkeypatch):
    monkeypatch.setattr(queries, "_scores", lambda spark, sf_dir, fit: fit)
    fit = queries.QUERIES["gbt_scores"](None, "")
    assert {k: p.default for k, p in inspect.signature(fit).parameters.items() if k != "train"} == {"trees": 160, "rate": 0.05, "depth": 6, "seed": 42}
