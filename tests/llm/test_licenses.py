import random
import re

import numpy as np
import pytest

from entwine.llm.decontaminate import words_of
from entwine.llm.licenses import TEMPLATES, TemplateIndex, align, passage, scan_licenses, winnow
from .fixtures import DOC, documents, prose


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[-1], row[j] + (x == y)))
        row = new
    return row[-1]


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (rng.integers(0, 50, 30).astype(np.uint64) for _ in range(2))
        b[10:13] = a[20:23]  # three equal grams in a row, as a run of five words gives
        picks = [{int(x[i]) for i in winnow(x, np.zeros(30, dtype=int))} for x in (a, b)]
        assert picks[0] & picks[1]


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(5) for _ in range(rng.randrange(1, 12))]
        b = [rng.randrange(5) for _ in range(rng.randrange(1, 15))]
        got = align(np.array(a), np.array(b), -len(a), len(a) + len(b) + 1)
        assert len(got) == lcs(a, b) == lcs(a, [b[k] for k in got])
        if got:
            worth = {(i, j): 3 * (j + 1 - i) - (got[j] + 1 - got[i]) for i in range(len(got)) for j in range(i, len(got))}
            n, start, end = passage(got)
            assert 3 * n - (end - start) == max(worth.values()) and n == sum(start <= k < end for k in got)


def test_planted_notices(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(200):
        name, text = TEMPLATES[i % len(TEMPLATES)]
        w = text.split()
        for _ in range(len(w) // 25):
            at = rng.randrange(len(w))
            w[at] = rng.choice(["changed", "", "two more"]) if w[at] != "Affero" and len(words(w[at])) < 3 else w[at]  # an address is many words; Affero alone tells two notices apart
        before = prose(rng, rng.choice([0, 40]))
        rows.append((i, f"{before}\n{' '.join(w)}\n{prose(rng, 20)}"))
        want[i] = (name, len(words(before)), len(words(before + " " + " ".join(w))))
    rows += [(i, prose(rng, 100)) for i in range(200, 300)]
    out = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id for r in out} == set(range(200))
    for r in out:
        name, a, b = want[r.doc_id]
        assert r.license == name and a <= r.start <= a + 3 and b - 3 <= r.end <= b and 0.8 <= r.coverage <= 1


def test_exact_lines_equal_brute_force(spark):
    rng = random.Random(3)
    lines = [t for _, t in TEMPLATES if len(words(t)) < 15]
    rows = [(i, "\n".join(rng.choice([prose(rng, 8), prose(rng, 3), rng.choice(lines)]) for _ in range(6))) for i in range(150)]
    out = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), coverage=1.0).collect()
    got = sorted((r.doc_id, r.start, r.end) for r in out)
    want = []
    for i, t in rows:
        w = words(t)
        for x in {tuple(words(x)) for x in lines}:
            want += [(i, k, k + len(x)) for k in range(len(w)) if tuple(w[k : k + len(x)]) == x]
    assert got == sorted(want)


@pytest.mark.parametrize("coverage", [0.8, 1.0])
def test_edge_rows(spark, coverage):
    mit = TEMPLATES[1][1]
    rows = documents() + [(800, mit, None, None, None), (800, mit, None, None, None), (None, mit.upper(), None, None, None), (801, f"{mit} {mit}", "en", "s", 1), (802, "word " * 300_000 + mit, "en", "s", 1)]
    out = scan_licenses(spark.createDataFrame(rows, DOC), coverage=coverage).collect()
    count = {i: sum(r.doc_id == i for r in out) for i in (800, 801, 802, None)}
    assert count == {800: 2, 801: 2, 802: 1, None: 1} and len(out) == 6
    assert scan_licenses(spark.createDataFrame([], DOC)).count() == 0


@pytest.mark.parametrize("name, text", TEMPLATES)
def test_adjacent_copies_are_reported_each(name, text):
    index, words = TemplateIndex(list(TEMPLATES)), text.lower()
    n = len(index.words[list(TEMPLATES).index((name, text))])
    for copies in (1, 2, 3, 7):
        for join in (" ", " then some other words "):
            raw = join.join([words] * copies).encode()
            found = sorted(index.scan(words_of(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)])), 0.8), key=lambda r: r[4])
            gap = len(join.split())
            assert [(r[1], r[3], r[4], r[5]) for r in found] == [(name, n, k * (n + gap), k * (n + gap) + n) for k in range(copies)]


def test_edited_copies_of_long_templates():
    rng = random.Random(3)
    index = TemplateIndex(list(TEMPLATES))
    for name, text in TEMPLATES:
        words = text.lower().split()
        if len(words) < 60:
            continue
        parts = []
        for _ in range(4):
            copy = list(words)
            for at in rng.sample(range(len(copy)), len(copy) // 20):
                copy[at] = f"edit{rng.randrange(1000)}"
            parts.append(" ".join(copy))
        raw = " ".join(parts).encode()
        found = index.scan(words_of(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)])), 0.8)
        assert [r[1] for r in found] == [name] * 4 and all(r[2] >= 0.85 for r in found)


def test_templates_from_a_table(spark):
    table = spark.createDataFrame([("X", "one two three four five six seven"), (None, "a b c d e f"), ("Y", None)], "license string, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five six seven eight", 5, "k")], "doc_id long, text string, coverage int, license string")
    assert [tuple(r) for r in scan_licenses(docs, table).collect()] == [(1, "X", 1.0, 7, 1, 8)]
