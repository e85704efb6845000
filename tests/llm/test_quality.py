import random
import re

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

from entwine.llm.quality import COUNTS, IsolationForest, counts, quality, threshold
from .fixtures import DOC, documents, prose

LABEL = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    w = re.findall("[^\\x20\\x09-\\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\\x20\\x09-\\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered)


TEXT = st.text(st.sampled_from("ab é#|\n\t日 \x0b"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_counts(texts):
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0] + [len(x) for x in raw])
    got = counts(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds)
    assert [tuple(r[:5]) for r in got.tolist()] == [brute(t) for t in texts]
    assert got[:, COUNTS.index("n_distinct")].tolist() == [len(set(re.findall("[^\\x20\\x09-\\x0D]+", t))) for t in texts]


def junk_rows(seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(600):
        text = ". ".join(prose(rng, 9).capitalize() for _ in range(rng.randrange(8, 40)))
        bad = i % 8 == 0
        if bad:
            text = [text.upper() + "!!!", " | ".join(text.split()), re.sub(" ", "$$$ ", text)][i // 8 % 3]
        rows.append((i, text, "en", "s", 1))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    return rows, labels


def test_forest_finds_junk(spark):
    rows, labels = junk_rows(1)
    df = spark.createDataFrame(rows, DOC).withColumnRenamed("n_chars", "quality").repartition(4)
    out = {r.doc_id: r for r in quality(df, spark.createDataFrame(labels, LABEL)).collect()}
    for i, text, *_ in rows:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    good = [out[i].kept for i in range(600) if i % 8]
    bad = [out[i].kept for i in range(600) if i % 8 == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1


def test_threshold_is_that_of_all_labels(spark):
    rows, labels = junk_rows(2)
    labels += [(i, 1, 0) for i in range(1, 120, 2) if i % 8]
    df, known = spark.createDataFrame(rows, DOC).repartition(4), spark.createDataFrame(labels, LABEL)
    out = {r.doc_id: r for r in quality(df, known, sample_rows=100).collect()}
    seen = [(out[i].anomaly, good) for i, good, _ in labels if not out[i].base_failed]
    n_good, n_bad = sum(g for _, g in seen), sum(not g for _, g in seen)
    cost = {s: 4 * sum(g and x > s for x, g in seen) / n_good + sum(not g and x <= s for x, g in seen) / n_bad for s, g in seen if g}
    least = min(cost.values())
    cut = max(s for s, c in cost.items() if c <= least + 1e-12)
    assert all(r.kept == (not r.base_failed and r.anomaly <= cut) for r in out.values())


def test_threshold_of_few():
    assert threshold([], [], [], 4.0) is None
    assert threshold([5], [0], [3], 4.0) is None
    assert threshold([7, 5], [0, 2], [9, 0], 4.0) == 5 / 65536
    assert threshold([9, 7, 5], [1, 0, 2], [0, 0, 0], 4.0) == 9 / 65536


def test_edge_rows(spark):
    df = spark.createDataFrame(documents(), DOC)
    labels = [(0, 1, 0), (0, 0, 1), (None, 1, 0), (5, None, None), (10**9, 1, 0)]
    out = quality(df, spark.createDataFrame(labels, LABEL)).collect()
    assert len(out) == len(documents())
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in out if r.doc_id in (60, 61, 62))
    out = quality(df, spark.createDataFrame([], LABEL)).collect()
    assert all(r.kept != r.base_failed for r in out)
    assert quality(spark.createDataFrame([], DOC), spark.createDataFrame([(1, 1, 0)], LABEL)).count() == 0


def test_forest_is_repeatable():
    x = np.random.default_rng(0).normal(size=(500, 3))
    a, b = IsolationForest(x).score(x), IsolationForest(x).score(x)
    assert (a == b).all() and ((a > 0) & (a < 1)).all()
    assert IsolationForest(x).score(np.array([[9.0, 9, 9]]))[0] > np.quantile(a, 0.95)
