import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from entwine.llm.decontaminate import Index, contamination, decontaminate, edits, least_edits, words_of
from .fixtures import DOC, documents, prose

BENCH = "item_id long, text string"


def distance(item, text):
    """Edit distance of item to the nearest passage of text."""
    row = [0] * (len(text) + 1)
    for k, w in enumerate(item, 1):
        new = [k]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(docs, items, rate=0.2):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, text in docs:
        for i, item in items:
            w = words(item)
            if w and distance(w, words(text)) <= edits(len(w), rate):
                out.add((d, i))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), max_size=15))
def test_least_edits(item, text):
    cost, a, b = least_edits(np.array(item, dtype=np.uint64), np.array(text, dtype=np.uint64))
    assert cost == distance(item, text)
    row = list(range(b - a + 1))
    for k, w in enumerate(item, 1):
        new = [k]
        for j, t in enumerate(text[a:b], 1):
            new.append(min(row[j - 1] + (w != t), row[j] + 1, new[-1] + 1))
        row = new
    assert row[-1] == cost


def edited(rng, words, n, new=lambda rng: f"new{rng.random()}"):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words) or 1)
        words[at : at + 1] = rng.choice([[], [new(rng)], [*words[at : at + 1], new(rng)]])
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_finds_what_brute_force_finds(spark, seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, n)) for i, n in enumerate([3, 4, 6, 9, 15, 20, 30, 40, 59, 59, 2, 1])]
    docs = []
    for d in range(300):
        i = rng.randrange(len(items))
        w = items[i][1].split()
        part = edited(rng, w, rng.randrange(0, edits(len(w), 0.2) + 3)) if d % 3 else []
        docs.append((d, f"{prose(rng, rng.choice([0, 5, 200]))}\n{' '.join(part).capitalize()}. {prose(rng, rng.choice([0, 30]))}"))
    truth = brute(docs, items)
    out = contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, BENCH)).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert len(out) == len(got) and got <= truth
    assert len(truth) > 60 and len(got) / len(truth) > 0.99
    assert all(r.edits <= edits(len(items[r.item_id][1].split()), 0.2) for r in out)


def test_blocks_give_the_same(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, 30)) for i in range(30)]
    docs = spark.createDataFrame([(d, prose(rng, 50) + " " + items[d % 30][1]) for d in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame(items, BENCH)
    one = sorted(map(tuple, contamination(docs, bench).collect()))
    assert len(one) == 60
    assert one == sorted(map(tuple, contamination(docs, bench, block_words=200).collect()))


def test_edge_rows(spark):
    docs = documents()
    item = docs[10][1]
    rows = [(1, item), (2, item), (3, None), (4, ""), (5, "two words"), (None, "a b c")]
    df = spark.createDataFrame(docs, DOC).withColumnRenamed("lang", "item_id")
    out = contamination(df, spark.createDataFrame(rows, BENCH)).collect()
    assert {(10, 1), (10, 2)} <= {(r.doc_id, r.item_id) for r in out}
    assert {r.item_id for r in out} <= {1, 2, None}
    assert any(r.item_id is None for r in out)
    bad = {r.doc_id for r in out}
    kept = decontaminate(df, spark.createDataFrame(rows, BENCH)).collect()
    assert len(kept) == sum(r[0] not in bad for r in docs)
    assert contamination(df, spark.createDataFrame([], BENCH)).count() == 0
    assert contamination(spark.createDataFrame([], DOC), spark.createDataFrame(rows, BENCH)).count() == 0


def test_drops_rows_not_ids(spark):
    rng = random.Random(6)
    item = prose(rng, 20)
    clean = [prose(rng, 40) for _ in range(3)]
    bad = [f"{prose(rng, 10)} {item} {prose(rng, 10)}" for _ in range(3)]
    rows = [(None, clean[0]), (None, bad[0]), (1, clean[1]), (1, bad[1]), (2, bad[2]), (3, clean[2]), (None, None), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = decontaminate(docs, spark.createDataFrame([(1, item)], BENCH)).collect()
    want = [(None, clean[0]), (1, clean[1]), (3, clean[2]), (None, None), (1, None)]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(want, key=str)


def test_scripts_without_spaces(spark):
    rng = random.Random(8)
    han, thai = ("".join(chr(rng.randrange(a, b)) for _ in range(30)) for a, b in ((0x4E00, 0x9000), (0x0E01, 0x0E2F)))
    far = "".join(chr(rng.randrange(0x20000, 0x20F00)) for _ in range(20))
    other = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(60))
    docs = [(1, other[:20] + "，" + han + "。" + other[20:]), (2, other), (3, thai[:4] + "ก" + thai[5:] + "x"), (4, "a" + far), (5, han[:10] + "字字" + han[12:]), (6, None)]
    bench = spark.createDataFrame([(1, han), (2, thai), (3, far)], BENCH)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in contamination(df, bench).collect()}
    assert got.keys() == {(1, 1), (3, 2), (4, 3), (5, 1)}
    assert got[1, 1] == got[4, 3] == 0 and got[5, 1] == 2
    assert sorted(r.doc_id for r in decontaminate(df, bench).collect()) == [2, 6]


def test_short_items_are_reported_and_drop_nothing(spark):
    docs = spark.createDataFrame([(1, "x. Two words, two words"), (2, "words two"), (None, "Lone"), (3, ""), (4, "two; words lone")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "two words"), (2, "LONE"), (3, "lone"), (4, "?!"), (None, None)], BENCH)
    out = {tuple(r) for r in contamination(docs, bench).collect()}
    assert out == {(1, 1, 1, 3, 0), (None, 2, 0, 1, 0), (None, 3, 0, 1, 0), (4, 1, 0, 2, 0), (4, 2, 2, 3, 0), (4, 3, 2, 3, 0)}
    assert decontaminate(docs, bench).count() == 5
    assert sorted(r.doc_id for r in decontaminate(docs, bench, least_words=2).collect() if r.doc_id) == [2, 3]


def test_recall_is_reached_in_every_size_group():
    rng = random.Random(9)
    sizes = [40] * 600 + [600, 700, 5, 6, 7]
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(n))) for i, n in enumerate(sizes)]
    index = Index(items, 0.2, 0.999, 6, 2)
    for i in range(600, 605):
        found = 0
        for _ in range(40):
            text = " ".join(edited(rng, items[i][1].split(), edits(sizes[i], 0.2), lambda r: f"new{r.randrange(10**9)}"))
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            found += any(hit[1] == i for hit in index.search(words_of(raw, np.array([0, len(raw)]))))
        assert found >= 39


def test_index_of_nothing():
    assert Index([], 0.2, 0.99, 2, 2).items == []
