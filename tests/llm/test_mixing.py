import random

import numpy as np
import pytest

from entwine.llm.mixing import _slots, mix_digest, mix_sources, mixed_documents, targets
from .fixtures import DOC, documents, prose


def water(sizes, weights, share, most):
    """Level at which min(most * size, level * weight) adds up, by bisection."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(most * s, mid * x) for s, x in zip(sizes, w)) < share * sum(sizes):
            lo = mid
        else:
            hi = mid
    return [min(most * s, hi * x) for s, x in zip(sizes, w)]


@pytest.mark.parametrize("seed", range(5))
def test_targets_are_the_water_level(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 10, 1000, 50_000]) for _ in range(rng.randrange(1, 12))]
    if sum(sizes):
        assert targets(sizes, (3, 1, 2), 1.5, 2.0) == pytest.approx(water(sizes, (3, 1, 2), 1.5, 2.0), rel=1e-9, abs=1e-6)
    assert targets([0, 0], (3, 1, 2), 1.5, 2.0) == [0, 0]


def test_golden_slots_are_even():
    cuts = (np.array([0.1, 0.4, 0.75]) * 2**64).astype(np.uint64)
    for n in (100, 1000, 10_000):
        share = np.bincount(_slots(0, n, cuts), minlength=4)
        assert np.abs(share - n * np.array([0.1, 0.3, 0.35, 0.25])).max() < 4


@pytest.mark.parametrize("block", [1, 16, 1024])
def test_taken(spark, block):
    df = spark.createDataFrame(documents(3, 120), DOC).withColumnRenamed("lang", "row").repartition(5)
    out = mix_digest(df, block_words=block).collect()
    assert len(out) == df.count()
    by = {}
    for r in out:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert 0 <= r.taken <= 2 * r.size
    for (size, target), rows in by.items():
        assert sum(r.size for r in rows) == size
        assert abs(sum(r.taken for r in rows) - target) <= 1
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(s for s, _ in by))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(out, key=key) == sorted(mix_digest(df.repartition(3), block_words=block).collect(), key=key)


def test_pieces_fill_blocks(spark):
    df = spark.createDataFrame(documents(5, 80), DOC)
    _, pieces = mix_sources(df, block_words=1)
    words = [r.n for r in pieces.groupBy("slot").agg({"end": "sum", "start": "sum"}).withColumnRenamed("sum(end)", "e").selectExpr("e - `sum(start)` as n").collect()]
    assert set(words) == {1}


def test_mixed_documents(spark):
    df = spark.createDataFrame(documents(6, 80), DOC)
    out = mixed_documents(df).collect()
    taken, got = {}, {}
    for r in mix_digest(df).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == {k: v for k, v in taken.items() if v}


@pytest.mark.parametrize("k", [1, 5, 40])
def test_identical_rows_are_so_many_documents(spark, k):
    rows = [(7, "a b c d e f g h i j", "en", "s", 19)] * k + [(None, "x y z", None, None, 5)] * k
    df = spark.createDataFrame(rows, DOC).repartition(3)
    taken = sum(r.taken for r in mix_digest(df, block_words=4).collect())
    assert taken == sum(len(r.text.split()) for r in mixed_documents(df, block_words=4).collect())
    assert abs(taken - 1.5 * 13 * k) <= 1


def test_the_schedule_decides_the_order(spark):
    """Every prefix of the mix holds each source near its share, and another schedule gives other slots and another order."""
    rng = random.Random(9)
    rows = [(i, prose(rng, 40), "en", f"s{i % 3}", 0) for i in range(600)]
    df = spark.createDataFrame(rows, DOC)

    def run(**options):
        _, pieces = mix_sources(df, block_words=20, **options)
        slots = [(r.slot, rows[r.row.doc_id][3], r.end - r.start) for r in pieces.collect()]
        return sorted(slots), {r.doc_id: r.first_slot for r in mix_digest(df, block_words=20, **options).collect()}, [r.doc_id for r in mixed_documents(df, block_words=20, **options).collect()]

    slots, first, order = run()
    total = sum(n for *_, n in slots)
    share = {s: sum(n for _, x, n in slots if x == s) / total for s in ("s0", "s1", "s2")}
    so_far = dict.fromkeys(share, 0)
    for k, (_, s, n) in enumerate(slots):
        so_far[s] += n
        if k % 50 == 49:
            done = sum(so_far.values())
            assert all(abs(so_far[x] - share[x] * done) <= 8 * 20 for x in share)
    seen = list(dict.fromkeys(order))
    assert seen == sorted(seen, key=lambda d: first[d])
    slots1, first1, order1 = run(step=1)  # all slots of one source, then all of the next
    assert first1 != first and order1 != order and [s[1] for s in slots1] != [s[1] for s in slots]
    assert {s: sum(n for _, x, n in slots1 if x == s) for s in share} == {s: sum(n for _, x, n in slots if x == s) for s in share}


def test_other_columns_keep_names_and_values(spark):
    rows = [(i, f"t{i} " * 30, "en", f"s{i % 2}", i, i * 2, f"k{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, text string, lang string, source string, slot long, doc_id long, h string")
    out = mixed_documents(df, block_words=8).collect()
    assert out and all((r.slot, r.doc_id, r.h) == (r.id, 2 * r.id, f"k{r.id}") for r in out)


def test_long_text(spark):
    rows = [(1, "w " * 300_000, "en", "a", 0), (2, "v " * 10, "en", "a", 0)]
    assert sum(r.taken for r in mix_digest(spark.createDataFrame(rows, DOC)).collect()) == 450_015


def test_sql(spark, tmp_path):
    import duckdb

    from entwine.llm.registry import OP3_SQL

    for k, rows in enumerate((documents(4, 150), [])):
        spark.createDataFrame(rows, DOC).coalesce(1).write.parquet(f"{tmp_path}/{k}")
        db = duckdb.connect()
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{k}/*.parquet'")
        found = db.execute(OP3_SQL)
        names = [x[0] for x in found.description]
        out = mix_digest(spark.read.parquet(f"{tmp_path}/{k}"))
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert out.columns == names and sorted(map(tuple, out.collect()), key=key) == sorted(found.fetchall(), key=key)


def test_empty(spark):
    assert mix_digest(spark.createDataFrame([], DOC)).count() == 0
    out = mix_digest(spark.createDataFrame([(1, None, None, None, None), (2, " ", None, "a", None)], DOC)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in out) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
