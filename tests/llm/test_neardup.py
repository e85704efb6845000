import random
import re

import numpy as np
import pytest

from entwine.llm import kernels as K
from entwine.llm.neardup import drop_near_duplicates, near_duplicates, shingles, sketch
from .fixtures import DOC, documents, prose


def sets_of(text):
    t = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    w = re.findall("[^\\x20\\x09-\\x0D]+", t)
    if 0 < len(w) < 5:
        return {tuple(w)}
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    ids = [r[0] for r in rows]
    sets = [sets_of(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)), key=lambda k: ids[k])
                root[y] = x
    return {ids[i]: (len(sets[i]), ids[find(i)], find(i) == i) for i in range(len(rows))}


def near_rows(seed):
    """Chains, stars and shattered groups of copies around the threshold."""
    rng = random.Random(seed)
    rows = [(i, r[1]) for i, r in enumerate(documents(seed, 50))]
    for base in range(6):
        words = prose(rng, rng.choice([12, 60, 200])).split()
        for k in range(25):
            w = list(words)
            if base % 2:
                words = w
            for _ in range(rng.randrange(0, 1 + len(w) // 30)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w).upper() if k % 2 else " ".join(w)))
    half = prose(rng, 60)
    rows += [(len(rows) + k, half + " " + prose(rng, rng.choice([10, 20, 40]))) for k in range(60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = near_rows(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows)


def test_edge_rows(spark):
    df = spark.createDataFrame(documents(), DOC).withColumnRenamed("n_chars", "key")
    out = near_duplicates(df).collect()
    assert len(out) == len(documents())
    empty = [r for r in out if r.doc_id in (60, 61, 62)]
    assert all(r.n_shingles == 0 and r.kept and r.component_id == r.doc_id for r in empty)
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    kept = drop_near_duplicates(df).collect()
    assert len(kept) == len({r.doc_id for r in kept})
    assert {r.component_id for r in out} == {r.doc_id for r in kept}
    assert near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_drop_keeps_one_row_of_each_component_whatever_the_ids(spark):
    rng = random.Random(5)
    lone = [prose(rng, 60) for _ in range(8)]
    near = prose(rng, 80)
    rows = [(None, t) for t in lone[:4]] + [(7, t) for t in lone[4:6]] + [(8, lone[6]), (9, lone[7])]
    want = sorted(rows, key=str) + [(None, ""), (7, ""), (7, None)]
    rows += [(None, lone[0]), (9, lone[7]), (10, lone[6].upper()), (None, ""), (None, ""), (7, ""), (7, None)]
    alike = [near + f" tail{k}" for k in range(4)]
    rows += [(5, t) for t in alike] + [(6, alike[0])]
    got = [(r.doc_id, r.text) for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert sum(t in alike for _, t in got) == 1 and {i for i, t in got if t in alike} == {5}
    assert sorted((x for x in got if x[1] not in alike), key=str) == sorted(want, key=str)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 5, 100, 3000):
        pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        agree = []
        for _ in range(20):
            common = rng.permutation(pool)
            a, b = np.sort(common[: n + n // 2]), np.sort(common[n // 2 :])
            s = sketch(np.array([0, len(a), len(a) + len(b)]), np.concatenate([a, b]), 72)
            assert (s != np.uint64(2**64 - 1)).all()
            agree.append((s[0] == s[1]).mean())
        whole = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(np.mean(agree) - whole) < 0.08


def test_shingles_are_sets():
    data = np.frombuffer(b"A b c d e a B c d e f", dtype=np.uint8)
    first, h = shingles(data, np.array([0, len(data), len(data)]))
    assert list(np.diff(first)) == [6, 0] and len(set(h.tolist())) == len(h)
    assert len(shingles(np.frombuffer(b"x y", dtype=np.uint8), np.array([0, 3]))[1]) == 1
    assert K.sliding(np.minimum, np.array([3, 1, 2, 5, 4]), 3).tolist() == [1, 1, 2]
