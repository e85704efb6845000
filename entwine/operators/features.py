"""Token weights and the 14 pair features, as column expressions over records and pairs.

Weights are joined to records, not to pairs: each record carries a map of its own tokens, so
no dictionary is collected or broadcast, whatever the size of the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sets as S
from ..functions import text as T
from ..functions.cache import per_jvm
from ..functions.distance import jaro_winkler

NAME_DEFAULT, ADDRESS_DEFAULT = 6.0, 4.0
FEATURES = ["nd", "w_nd", "nj", "jw", "ad", "w_ad", "aj", "num_m", "num_conf", "lr_n", "lr_a", "cm", "comp", "w_nd_x_w_ad"]


def idf(texts: DataFrame, tokens: Column) -> DataFrame:
    """(token, idf): ln((N + 1) / (df + 1)) + 1 over the rows of ``texts``; df counts rows that hold the token."""
    n = texts.agg(F.count(F.lit(1)).alias("n"))
    df = texts.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def with_weights(records: DataFrame, weights: DataFrame, tokens: str, column: str, default: float) -> DataFrame:
    """Adds ``column``: a map from each token of the record to its weight, ``default`` where it has none."""
    each = records.select("row", F.explode(F.array_distinct(tokens)).alias("token")).join(weights, "token", "left")
    maps = each.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("token", F.coalesce("idf", F.lit(default)).alias("w")))).alias(column))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return records.join(maps, "row", "left").withColumn(column, F.coalesce(column, empty))


def _weighted(a: Column, b: Column, wa: Column, wb: Column) -> Column:
    def total(keys: Column, w: Column) -> Column:
        return F.aggregate(keys, F.lit(0.0), lambda s, t: s + w[t])

    both = F.array_intersect(a, b)
    return F.when(F.size(both) == 0, F.lit(0.0)).otherwise(2.0 * total(both, wa) / (total(F.map_keys(wa), wa) + total(F.map_keys(wb), wb)))


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def pair_features(pairs: DataFrame, classic: bool = True, as_float: bool = True) -> DataFrame:
    """Adds FEATURES to pairs with s_ and t_ columns business_name, business_address, name_tok, addr_tok, name_w, addr_w."""
    first, then = _feature_columns()
    names = F.col("s_business_name"), F.col("t_business_name")
    out = pairs.withColumns(first).withColumns({**then, "jw": jaro_winkler(T.raw_prefix(names[0], 40), T.raw_prefix(names[1], 40), classic)})
    return out.withColumns({c: F.col(c).cast("float") for c in FEATURES}) if as_float else out


@per_jvm
def _feature_columns() -> tuple[dict[str, Column], dict[str, Column]]:
    sn, tn, sa, ta = (F.col(c) for c in ("s_name_tok", "t_name_tok", "s_addr_tok", "t_addr_tok"))
    names, addrs = (F.col("s_business_name"), F.col("t_business_name")), (F.col("s_business_address"), F.col("t_business_address"))
    sd, td = S.digit_tokens(sa), S.digit_tokens(ta)
    city, other = T.extract_city(addrs[0]), T.extract_city(addrs[1])
    first = {
        "nd": S.dice(sn, tn),
        "w_nd": _weighted(sn, tn, F.col("s_name_w"), F.col("t_name_w")),
        "nj": S.jaccard(sn, tn),
        "ad": S.dice(sa, ta),
        "w_ad": _weighted(sa, ta, F.col("s_addr_w"), F.col("t_addr_w")),
        "aj": S.jaccard(sa, ta),
        "num_m": _flag(S.overlaps(sd, td)),
        "num_conf": _flag(S.conflicts(sd, td)),
        "lr_n": S.length_ratio(*names),
        "lr_a": S.length_ratio(*addrs),
        "cm": _flag((city != "") & (city == other)),
    }
    score = 2.6 * F.col("nd") + 2.2 * F.col("nj") + 1.4 * F.col("ad") + 1.1 * F.col("aj") + 1.0 + 0.6 * F.col("cm")
    return first, {"comp": score, "w_nd_x_w_ad": F.col("w_nd") * F.col("w_ad")}


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds label: 1 where (s_entity_id, t_entity_id) is in ``truth`` (s1_id, t_id)."""
    t = truth.select(F.col("s1_id").alias("s_entity_id"), F.col("t_id").alias("t_entity_id")).distinct().withColumn("_hit", F.lit(1))
    return pairs.join(t, ["s_entity_id", "t_entity_id"], "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")
