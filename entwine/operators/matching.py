"""Candidate pairs, vetoes, tiers and caps.

Pairs carry row ids only until they are distinct; tokens join them afterwards.  Keys bring along
three 64-bit signatures (of name tokens, building numbers and postal codes), so that most pairs
that gate and vetoes drop are gone right at the blocking join; equal members always share a bit,
so none is dropped wrongly, and the exact rules follow on the rest.  Everything is native but
Jaro-Winkler, which is computed only for pairs whose decision depends on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sets as S
from ..functions import text as T
from ..functions.cache import per_jvm
from ..functions.distance import jaro_winkler
from .blocking import KEY, block_join, pruned, tokenized, with_keys

NO_COUNTRY = "\x00"
_BODY = ["name_tok", "addr_tok", "compact", "bldg", "postal", "business_name"]


def prepared(records: DataFrame, join_hyphens: bool = True) -> DataFrame:
    """Tokenised records with a row id that is unique and ascends with (src, rowno).

    It is a long (48 bits of it for ``rowno``) where ``rowno`` is a whole number, else a struct.
    """
    whole = dict(records.dtypes)["rowno"] in ("tinyint", "smallint", "int", "bigint")
    row = F.shiftleft(F.col("src").cast("long"), 48) + F.col("rowno") if whole else F.struct("src", "rowno")
    return tokenized(records, join_hyphens).withColumn("row", row)


@per_jvm
def _signatures() -> dict[str, Column]:
    def bits(tokens: str) -> Column:
        one = F.transform(tokens, lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int")))
        return F.aggregate(one, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return {"name_sig": bits("name_tok"), "bldg_sig": bits("bldg"), "postal_sig": bits("postal")}


_SIGS = ["name_sig", "bldg_sig", "postal_sig"]


def row_pairs(s1: DataFrame, targets: DataFrame, most: int | None = 100, null_country: str | None = NO_COUNTRY, vetoed: bool = False) -> DataFrame:
    """Distinct (s_row, t_row) that share a key of an S1 bucket of at most ``most`` entries.

    ``vetoed`` drops pairs whose signatures show that the gate or a veto will drop them.
    """
    sigs = _SIGS if vetoed else []
    sides = []
    for records, x in ((s1, "s"), (targets, "t")):
        records = records.withColumns(_signatures()) if vetoed else records
        keys = with_keys(records, ["row", *sigs], null_country)
        keys = pruned(keys, most) if x == "s" else keys
        sides.append(keys.select(F.col("row").alias(f"{x}_row"), *(F.col(c).alias(f"{x}_{c}") for c in sigs), *KEY))
    pairs = block_join(*sides)
    for c in sigs:
        a, b = F.col(f"s_{c}"), F.col(f"t_{c}")
        pairs = pairs.filter((a == 0) | (b == 0) | (a.bitwiseAND(b) != 0))
    return pairs.select("s_row", "t_row").distinct()


def with_bodies(pairs: DataFrame, s1: DataFrame, targets: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Pairs with the columns of both records, prefixed s_ and t_."""
    columns = ["entity_id", *_BODY, *(more or [])]
    s = s1.select(F.col("row").alias("s_row"), *(F.col(c).alias(f"s_{c}") for c in columns))
    t = targets.select(F.col("row").alias("t_row"), *(F.col(c).alias(f"t_{c}") for c in columns))
    return pairs.join(s, "s_row").join(t, "t_row")


@per_jvm
def name_gate() -> Column:
    """False where both names have tokens and share none."""
    return ~S.conflicts(F.col("s_name_tok"), F.col("t_name_tok"))


@per_jvm
def bldg_veto() -> Column:
    return S.conflicts(F.col("s_bldg"), F.col("t_bldg"))


@per_jvm
def postal_veto() -> Column:
    return S.conflicts(F.col("s_postal"), F.col("t_postal"))


@per_jvm
def _score_columns() -> dict[str, Column]:
    return {
        "nd": S.gate_dice(F.col("s_name_tok"), F.col("t_name_tok")),
        "ad": S.dice(F.col("s_addr_tok"), F.col("t_addr_tok")),
        "bldg_match": S.overlaps(F.col("s_bldg"), F.col("t_bldg")),
        "postal_match": S.overlaps(F.col("s_postal"), F.col("t_postal")),
    }


def with_scores(pairs: DataFrame) -> DataFrame:
    """Adds nd, ad and the match flags."""
    return pairs.withColumns(_score_columns())


def is_candidate() -> Column:
    return (F.col("nd") >= 0.20) | (F.col("ad") >= 0.30)


def exact_name() -> Column:
    return (F.col("s_compact") == F.col("t_compact")) & (F.length("s_compact") >= 4)


def domain_name() -> Column:
    return (F.length("s_compact") >= 5) & (F.length("t_compact") >= 5) & T.either_contains(F.col("s_compact"), F.col("t_compact"))


def _corroborated(least: float) -> Column:
    return (F.col("bldg_match") & (F.col("ad") >= 0.25)) | (F.col("postal_match") & (F.col("ad") >= 0.40)) | (F.col("ad") >= least)


def exact_match() -> Column:
    return _corroborated(0.70) | ((F.size("t_addr_tok") == 0) & (F.length("s_compact") >= 8))


def domain_match() -> Column:
    return _corroborated(0.60)


def typo_reach() -> Column:
    return (F.col("nd") >= 0.60) | (F.col("ad") >= 0.70)


def typo_without_jw() -> Column:
    return (F.col("nd") >= 0.90) & F.col("bldg_match") & F.col("postal_match")


def _jw_match(jw: Column) -> Column:
    return ((jw >= 0.92) & (F.col("ad") >= 0.80)) | ((jw >= 0.88) & F.col("bldg_match") & (F.col("ad") >= 0.50))


@per_jvm
def _decision_columns() -> tuple:
    """Filter of live pairs; tiers; decision without Jaro-Winkler; names where it is needed; decision."""
    tier = F.when(exact_name(), 1).when(domain_name(), 2).when(typo_reach(), 3).otherwise(0)
    plain = F.when(F.col("tier") == 1, exact_match()).when(F.col("tier") == 2, domain_match()).when(F.col("tier") == 3, typo_without_jw()).otherwise(False)
    # only pairs whose decision hangs on it reach the UDF with their names
    asks = (F.col("tier") == 3) & ~F.col("plain") & ((F.col("ad") >= 0.80) | (F.col("bldg_match") & (F.col("ad") >= 0.50)))
    names = {"_a": F.when(asks, T.raw_prefix(F.col("s_business_name"), 35)), "_b": F.when(asks, T.raw_prefix(F.col("t_business_name"), 35))}
    match = {"is_match": F.col("plain") | F.coalesce(_jw_match(F.col("jw")), F.lit(False))}
    return name_gate() & ~bldg_veto() & ~postal_veto(), {"candidate": is_candidate(), "tier": tier}, {"plain": plain}, names, match


def decided(pairs: DataFrame, classic: bool = True, in_bytes: bool = False) -> DataFrame:
    """Pairs that pass gate and vetoes, with candidate, tier (1 exact, 2 domain, 3 typo, 0 none) and is_match."""
    live, tiers, plain, names, match = _decision_columns()
    live = with_scores(pairs.filter(live)).withColumns(tiers).withColumns(plain).filter("candidate or plain or tier = 3").withColumns(names)
    kept = ["s_row", "t_row", "s_entity_id", "t_entity_id", "candidate", "tier", "plain", "nd", "ad", "bldg_match", "postal_match", "_a", "_b"]
    live = live.select(*kept).withColumn("jw", jaro_winkler(F.col("_a"), F.col("_b"), classic, in_bytes))
    return live.withColumns(match).drop("plain", "_a", "_b")


def first_per_entity(pairs: DataFrame, most: int) -> DataFrame:
    """The first ``most`` pairs of each S1 id in the order of targets, then of S1 rows."""
    order = Window.partitionBy("s_entity_id").orderBy("t_row", "s_row")
    return pairs.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= most).drop("_rn")


def candidates_and_matches(decisions: DataFrame, most_candidates: int = 15, most_matches: int = 10) -> tuple[DataFrame, DataFrame]:
    """(s_entity_id, t_entity_id) of the capped candidates, completed by the matches, and of the capped matches."""
    ids = ["s_entity_id", "t_entity_id"]
    matches = first_per_entity(decisions.filter("is_match"), most_matches).select(*ids)
    candidates = first_per_entity(decisions.filter("candidate"), most_candidates).select(*ids)
    return candidates.union(matches).distinct(), matches.distinct()


def resolve(s1: DataFrame, targets: DataFrame, most: int | None = 100, classic: bool = True, in_bytes: bool = False) -> DataFrame:
    """Decisions on all candidate pairs of two record sets."""
    left, right = prepared(s1), prepared(targets)
    return decided(with_bodies(row_pairs(left, right, most, vetoed=True), left, right), classic, in_bytes)


def output_rows(s1: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """One row per S1 row: source1_entity_id and its sorted target ids joined by commas."""
    ids = pairs.groupBy("s_entity_id").agg(F.array_join(F.array_sort(F.collect_set("t_entity_id")), ",").alias(column))
    out = s1.select("src", "rowno", "entity_id").join(ids, F.col("entity_id") == F.col("s_entity_id"), "left")
    return out.select("src", "rowno", F.col("entity_id").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


@per_jvm
def pair_score() -> Column:
    """Weighted name, address, country and city agreement of a pair with s_ and t_ columns; 0 across countries."""
    sn, tn, sa, ta = (F.col(c) for c in ("s_name_tok", "t_name_tok", "s_addr_tok", "t_addr_tok"))
    sc, tc = F.col("s_country"), F.col("t_country")
    city, other = T.extract_city(F.col("s_business_address")), T.extract_city(F.col("t_business_address"))
    same_city = F.when((city != "") & (city == other), 0.6).otherwise(0.0)
    same_country = F.when(sc.eqNullSafe(tc), 1.0).otherwise(0.0)
    score = 2.6 * S.dice(sn, tn) + 2.2 * S.jaccard(sn, tn) + 1.4 * S.dice(sa, ta) + 1.1 * S.jaccard(sa, ta) + same_country + same_city
    return F.when((F.coalesce(sc, F.lit("")) != "") & (F.coalesce(tc, F.lit("")) != "") & (sc != tc), 0.0).otherwise(score)


def generate_candidates(s1: DataFrame, targets: DataFrame, most: int | None = 100, least: float = 2.0) -> DataFrame:
    """(s_entity_id, t_entity_id) by the in-memory rules: target buckets pruned by distinct ids, hyphens
    kept, equal countries, pair score of at least ``least``; of a repeated id the last record counts.

    Every S1 row's keys are probed; ids without a candidate give no row (``output_rows`` adds them).
    """
    from pyspark.sql import Window as W

    left, right = prepared(s1, False), prepared(targets, False)
    most = most or None  # a falsy size prunes nothing
    t_keys = pruned(with_keys(right, ["entity_id"]).withColumnRenamed("entity_id", "t_id"), most, "t_id").select("t_id", *KEY)
    s_keys = with_keys(left, ["row"]).withColumnRenamed("row", "s_row")
    pairs = block_join(s_keys.select("s_row", *KEY), t_keys).select("s_row", "t_id").distinct()
    last = right.withColumn("_rn", F.row_number().over(W.partitionBy("entity_id").orderBy(F.col("row").desc()))).filter("_rn = 1")
    more = ["business_address", "country"]
    columns = ["entity_id", "name_tok", "addr_tok", *more]
    s = left.select(F.col("row").alias("s_row"), *(F.col(c).alias(f"s_{c}") for c in columns))
    t = last.select(F.col("entity_id").alias("t_id"), *(F.col(c).alias(f"t_{c}") for c in columns))
    both = pairs.join(s, "s_row").join(t, "t_id").filter(F.col("s_country") == F.col("t_country"))
    return both.withColumn("score", pair_score()).filter(F.col("score") >= least).select("s_row", "s_entity_id", "t_entity_id", "score")
