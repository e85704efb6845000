import hashlib
import random
import re
import time

import pytest

from entwine.llm.substring import SuffixAutomaton, dedup_substrings
from .fixtures import DOC, documents, prose


def brute(rows, window):
    """Rows are (id, text); ids are unique here."""
    first, words = {}, {}
    for i, text in sorted(rows):
        words[i] = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), (i, k))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (i, k):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    rows = [r for r in documents(seed, 90) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    df = spark.createDataFrame(rows, DOC).withColumnRenamed("n_chars", "h").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in dedup_substrings(df).collect()}
    assert got == brute([(r[0], r[1]) for r in rows], 20)


def test_second_reference(spark):
    """Windows that differ from the first place of their anchor but equal a later one."""
    rng = random.Random(4)
    core, rows = prose(rng, 9), []
    sides = [(prose(rng, 30), prose(rng, 30)) for _ in range(4)]
    for i in range(40):
        rows.append((i, f"{rng.choice(sides)[0]} {core} {rng.choice(sides)[1]}"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 20)


def test_edge_rows(spark):
    out = dedup_substrings(spark.createDataFrame(documents(), DOC), with_text=False).collect()
    assert len(out) == len(documents())
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].n_removed == 0  # a null id comes first
    assert {r.n_words for r in by[60] + by[61] + by[62]} == {0}
    assert by[63][0].n_removed == 70
    assert len(by[0]) == 2 and by[0][0] == by[0][1]
    assert dedup_substrings(spark.createDataFrame([], DOC)).count() == 0


def test_automaton_matching_statistics():
    rng = random.Random(0)
    for _ in range(30):
        refs = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(3)]
        sam, place, at = SuffixAutomaton(), 0, []
        for ref in refs:
            sam.add(ref, place)
            at.append(place)
            place += len(ref) + 1
        query = [rng.randrange(3) for _ in range(30)]
        sizes, ends = sam.stream(query, 4)
        for e in range(len(query)):
            best = max(n for n in range(e + 2) if any(query[e + 1 - n : e + 1] == r[k : k + n] for r in refs for k in range(len(r) - n + 1)))
            assert sizes[e] == best
            if best >= 4:
                assert ends[e] == min(p + k + 3 for r, p in zip(refs, at) for k in range(len(r) - 3) if r[k : k + 4] == query[e - 3 : e + 1])


def test_many_identical_rows_and_long_texts(spark):
    """Thousands of copies under one id, or none, are one document; a very long text is read whole."""
    rng = random.Random(8)
    text, other, long = prose(rng, 300), prose(rng, 60), prose(rng, 60_000)
    rows = [(5, text)] * 5000 + [(None, other)] * 2000 + [(6, f"{other} tail"), (9, f"{text} tail"), (10, long), (11, long)]
    began = time.time()
    out = {(r.doc_id, r.n_words, r.n_removed) for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), with_text=False).collect()}
    assert out == {(5, 300, 0), (None, 60, 0), (6, 61, 60), (9, 301, 300), (10, 60_000, 0), (11, 60_000, 60_000)}
    assert time.time() - began < 120
