"""Blocking keys, bucket pruning and the candidate join.

Records are DataFrames with entity_id, business_name, business_address, country and an order
(src, rowno).  A key is (family, country, key); a key made of several tokens joins them by U+0001.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sets as S
from ..functions import text as T
from ..functions.cache import per_jvm

SEP = "\x01"
KEY = ["family", "country", "key"]


@per_jvm
def _token_columns(join_hyphens: bool) -> tuple[dict[str, Column], dict[str, Column]]:
    numbers = T.bldg_postal(F.col("addr_tok"))
    first = {"name_tok": T.name_tokens(F.col("business_name")), "addr_tok": T.address_tokens(F.col("business_address"), join_hyphens)}
    return first, {"compact": T.compact(F.col("name_tok")), "bldg": numbers["bldg"], "postal": numbers["postal"]}


def tokenized(records: DataFrame, join_hyphens: bool = True) -> DataFrame:
    """Adds name_tok, addr_tok, compact, bldg and postal."""
    first, then = _token_columns(join_hyphens)
    return records.withColumns(first).withColumns(then)


def key_array(country: Column, name: Column, addr: Column) -> Column:
    """Array of (family, country, key) structs; ``num_l`` may repeat."""

    def first(a: Column, n: int) -> Column:
        return F.array_join(F.slice(a, 1, n), SEP)

    pair = S.two_smallest(name)
    squashed = T.compact(name)
    words = F.filter(addr, lambda t: ~t.rlike("^[0-9]+$") & (F.length(t) >= 3))
    numbers = F.filter(F.transform(S.digit_tokens(addr), lambda t: F.regexp_replace(t, "^0+", "")), lambda t: F.length(t) >= 2)
    single = (
        ("n2", F.size(name) >= 2, first(name, 2)),
        ("n3", F.size(name) >= 3, first(name, 3)),
        ("ns", F.size(pair) == 2, first(pair, 2)),
        ("n1", F.size(pair) == 1, first(pair, 1)),
        ("sq", F.length(squashed) >= 5, F.substring(squashed, 1, 8)),
        ("a2", F.size(addr) >= 2, first(addr, 2)),
        ("aw2", F.size(words) >= 2, first(words, 2)),
        ("aw3", F.size(words) >= 3, first(words, 3)),
        ("aw_sort", F.size(words) >= 3, F.array_join(F.array_sort(F.slice(words, 1, 3)), SEP)),
        ("num_2", F.size(numbers) >= 2, first(numbers, 2)),
        ("num_w", (F.size(numbers) >= 1) & (F.size(words) >= 1), F.concat_ws(SEP, F.get(numbers, F.lit(0)), F.get(words, F.lit(0)))),
        ("num_w2", (F.size(numbers) >= 1) & (F.size(words) >= 2), F.concat_ws(SEP, F.get(numbers, F.lit(0)), F.get(words, F.lit(1)))),
    )

    def struct(family: str, key: Column) -> Column:
        return F.struct(F.lit(family).alias("family"), country.alias("country"), key.alias("key"))

    found = F.filter(F.array(*(F.when(ok, struct(f, key)) for f, ok, key in single)), lambda k: k.isNotNull())
    long = F.transform(F.filter(numbers, lambda t: F.length(t) >= 5), lambda t: struct("num_l", t))
    return F.concat(found, long)


@per_jvm
def _keys_column(null_country: str | None) -> Column:
    country = F.coalesce("country", F.lit(null_country)) if null_country is not None else F.col("country")
    return F.explode(key_array(country, F.col("name_tok"), F.col("addr_tok"))).alias("k")


def with_keys(tokens: DataFrame, columns: Iterable[str], null_country: str | None = None) -> DataFrame:
    """One row for each key of a tokenised record.  ``null_country`` stands in for a missing country."""
    keys = tokens.select(*columns, _keys_column(null_country))
    return keys.select(*columns, "k.*")


def block_sizes(keys: DataFrame, distinct_of: str | None = None) -> DataFrame:
    """Entries of each key; with ``distinct_of``, distinct values of that column."""
    n = F.count(F.lit(1)) if distinct_of is None else F.count_distinct(distinct_of)
    return keys.groupBy(*KEY).agg(n.alias("n"))


def pruned(keys: DataFrame, most: int | None = 100, distinct_of: str | None = None) -> DataFrame:
    """Keys of buckets that hold at most ``most`` entries; None keeps all."""
    if most is None:
        return keys
    small = block_sizes(keys, distinct_of).filter(F.col("n") <= most).drop("n")
    return keys.join(small.withColumnRenamed("country", "_c"), (keys["family"] == small["family"]) & keys["country"].eqNullSafe(F.col("_c")) & (keys["key"] == small["key"]), "left_semi")


def block_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both sides for each shared key; equal pairs may repeat.  A null country meets nothing.

    Both sides are dealt out by key whatever their size: the join makes far more rows than it
    reads, so its work must not follow the partitions of a small input.
    """
    return left.hint("shuffle_hash").join(right, KEY)
