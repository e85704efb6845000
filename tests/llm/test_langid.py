import random
import tracemalloc
import zlib

import numpy as np
import pytest

from entwine.llm.common import free_memory
from entwine.llm.langid import BITS, _fit, _sample, fit, features, has_letter, identify_language, train_svm
from .fixtures import DOC, documents

# A few common words of each language.
WORDS = {
    "en": "the and that with for this was have from they house water people between through".split(),
    "de": "der und die nicht mit für das ist auch ein haus wasser zwischen durch menschen".split(),
    "fr": "le et les que pour dans est avec une pas maison eau entre gens très".split(),
    "es": "el y los que para en es con una no casa agua entre gente muy".split(),
}


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.choice([5, 20, 60]))), lang, "s", 1))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(800)
    df = spark.createDataFrame(rows, DOC).withColumnRenamed("source", "score").repartition(4)
    out = identify_language(df).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(out) == 800
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    test = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in test) / len(test) > 0.98
    again = identify_language(df.repartition(7)).collect()
    assert {r.doc_id: r.lang_pred for r in out} == {r.doc_id: r.lang_pred for r in again}


def test_edge_rows(spark):
    rows = documents() + [(900, "123 456 !!", "en", "s", 1), (901, "é", "en", "s", 1), (902, "٣ 日", None, None, None), (903, "x" * 3_000_000, "en", "s", 1)]
    out = identify_language(spark.createDataFrame(rows, DOC)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i in (60, 61, 62, 900):
        assert by[i].lang_pred == "und" and by[i].score == 0
    assert by[901].lang_pred != "und" and by[902].lang_pred != "und"
    assert by[None].held_out is False
    assert identify_language(spark.createDataFrame([], DOC)).count() == 0
    none = identify_language(spark.createDataFrame([(1, "words here", None, "s", 1)], DOC)).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0)]
    one = identify_language(spark.createDataFrame([(i, "words here", "xx", "s", 1) for i in range(4)], DOC)).collect()
    assert {r.lang_pred for r in one} == {"xx"}


def test_machine_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 1]) > 0, 1.0, -1.0)
    assert ((x @ train_svm(x, y) > 0) == (y > 0)).mean() > 0.97


@pytest.mark.parametrize("text", ["a", "ab", "", "née", "  x  "])
def test_features_of_short_texts(text):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    x = features(raw, np.array([0, len(raw)]))
    assert x.shape == (1, 1 << BITS) and x.sum() in (0, pytest.approx(1))
    assert has_letter(raw, np.array([0, len(raw)])).tolist() == [bool(text.strip())]
    assert fit(np.vstack([x, x]), ["en", "de"]).predict(x)[0].shape == (1,)


def sample_of(n):
    rng = np.random.default_rng(2)
    x = rng.poisson(0.1, size=(n, 1 << BITS)).astype(np.float32)
    x[::50] = x[0]
    return x, [rng.choice(sorted(WORDS)) for _ in range(n)]


def test_fitting_takes_little_more_memory_than_the_sample():
    x, lang = sample_of(500)
    tracemalloc.start()
    fit(x, lang)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * x.nbytes


def test_packed_sample_gives_the_same_machines():
    x, lang = sample_of(200)
    order = sorted(range(200), key=lambda i: (lang[i], x[i].tobytes()))
    want = fit(x[order], [lang[i] for i in order])
    mixed = np.random.default_rng(3).permutation(200)
    got = _fit(*_sample([zlib.compress(x[i].tobytes(), 1) for i in mixed], [lang[i] for i in mixed]))
    assert got.languages == want.languages and np.array_equal(got.weights, want.weights)


def test_driver_gives_memory_back(spark):
    assert free_memory(spark)
