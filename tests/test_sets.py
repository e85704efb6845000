import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from entwine.functions import sets as S
from entwine.functions.distance import jaro_winkler, similarity
from .helpers import values

A = [([], []), (["a"], []), ([], ["a"]), (["a", "b"], ["b", "c", "c"]), (["a", "a"], ["a"]), (["x"], ["y"])]


def run(spark, f):
    return values(spark, A, f, "array<string>")


def test_similarities(spark):
    assert run(spark, S.dice) == pytest.approx([1, 0, 0, 0.5, 1, 0])
    assert run(spark, S.jaccard) == pytest.approx([1, 0, 0, 1 / 3, 1, 0])
    assert run(spark, S.gate_dice) == pytest.approx([0, 0, 0, 0.5, 1, 0])
    assert run(spark, S.overlaps) == [False, False, False, True, True, False]
    assert run(spark, S.conflicts) == [False, False, False, False, False, True]
    assert run(spark, lambda a, b: S.two_smallest(F.concat(a, b))) == [[], ["a"], ["a"], ["a", "b"], ["a"], ["x", "y"]]


def test_weighted_dice(spark):
    idf = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(3.0))
    assert run(spark, lambda a, b: S.weighted_dice(a, b, idf, 6.0)) == pytest.approx([0, 0, 0, 6 / 13, 1, 0])


def test_length_ratio(spark):
    assert values(spark, [("abc", "a"), ("", ""), (None, "x"), ("é", "e")], S.length_ratio) == pytest.approx([1 / 3, 1, 0, 1])


@pytest.mark.parametrize(
    "a, b, classic, threshold",
    [("martha", "marhta", 0.9611, 0.9611), ("abcdefgh", "bcadefgh", 0.9375, 0.9583), ("", "", 1.0, 0.0), ("abzzzzzz", "abyyyyyy", 0.6, 0.5), ("a", "", 0.0, 0.0), ("a", "b", 0.0, 0.0), ("same", "same", 1.0, 1.0)],
)
def test_jaro_winkler_values(a, b, classic, threshold):
    assert similarity(a, b) == pytest.approx(classic, abs=5e-5)
    assert similarity(a, b, False) == pytest.approx(threshold, abs=5e-5)


@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_jaro_winkler_bounds_and_duckdb(a, b):
    # DuckDB compares bytes, so ASCII only
    import duckdb

    assert 0 <= similarity(a, b) <= 1 + 1e-12
    got = duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0]
    assert got == pytest.approx(similarity(a, b, False), abs=1e-9)


def test_jaro_winkler_column(spark):
    assert values(spark, [("martha", "marhta"), (None, "a"), ("x", "x")], jaro_winkler) == [pytest.approx(0.9611, abs=5e-5), None, 1.0]


def test_jaro_winkler_in_bytes_is_duckdbs():
    import duckdb

    a, b = "viè euxquepa et éai", "vièbald euxquepa et éai"
    assert similarity(a, b, False) < similarity(a, b, False, in_bytes=True)
    for x, y in ((a, b), (b, a), ("é", "è"), ("नमस्ते", "नमते"), ("日本語", "日本"), ("", "é"), ("😀a", "a😀")):
        got = duckdb.execute("select jaro_winkler_similarity(?, ?)", [x, y]).fetchall()[0][0]
        assert got == pytest.approx(similarity(x, y, False, in_bytes=True), abs=1e-12)
