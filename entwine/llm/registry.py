"""Queries of this subpackage, and the SQL of those that SQL can express.

Every query reads its whole tables with production parameters and returns its full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"), with_text=False).drop("spans")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_digest

    return mix_digest(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_language

    return identify_language(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "n_links")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .editcount import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_table

    return token_table(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_substring_dedup,
    op2_license_scan,
    op3_source_mixing,
    op4_language_id,
    op5_benchmark_decontamination,
    op6_quality_rules,
    op7_minhash_neardup,
    op8_html_extraction,
    op9_token_counts,
    op10_token_output,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


_WORDS = "regexp_extract_all(coalesce({}, ''), '[^ \\t-\\r]+')"

OP1_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, k, array_to_string(w[k+1:k+20], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w)-19, 0))) AS k FROM d)),
again AS MATERIALIZED (SELECT doc_id, k FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, k) > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, k + unnest(range(0, 20)) AS i FROM again),
kept AS MATERIALIZED (SELECT u.doc_id, array_to_string(list(u.word ORDER BY u.i), ' ') AS t FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d) u ANTI JOIN gone g ON g.doc_id = u.doc_id AND g.i = u.i GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(g.n, 0)::bigint AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP3_SQL = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, len({_WORDS.format('text')})::bigint AS size,
 ('0x' || substr(md5('7|' || coalesce(doc_id::varchar, 'null') || '|' || md5(coalesce(text, ''))), 1, 15))::bigint AS r FROM documents),
named AS (SELECT source, sum(size)::bigint AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][1 + sid % 3] AS w, 1.5::double * sum(s) OVER () AS total FROM named),
tide AS (SELECT *, (total - coalesce(sum(2 * s) OVER before, 0)::double) / sum(w) OVER ahead AS level FROM weighed WHERE s > 0
 WINDOW before AS (ORDER BY s / w::double, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ahead AS (ORDER BY s / w::double, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
water AS (SELECT min_by(level, s / w::double) AS level FROM tide WHERE level * w <= 2 * s),
src AS MATERIALIZED (SELECT source, sid, s, CASE WHEN s = 0 THEN 0.0::double ELSE least((SELECT coalesce(level, 1e300) FROM water) * w, 2.0::double * s) END AS target FROM weighed),
goal AS MATERIALIZED (SELECT *, least(floor(target + 0.5)::bigint, 2 * s) AS words, (least(floor(target + 0.5)::bigint, 2 * s) + 255) // 256 AS need FROM src),
span AS MATERIALIZED (SELECT sid, need, (upto - words)::hugeint * 18446744073709551616 // greatest(all_words, 1) AS lo, upto::hugeint * 18446744073709551616 // greatest(all_words, 1) AS hi, (all_words + 255) // 256 AS n_slots
 FROM (SELECT *, (sum(words) OVER (ORDER BY sid))::bigint AS upto, (sum(words) OVER ())::bigint AS all_words FROM goal)),
point AS (SELECT n, ((n + 1)::hugeint * 11400714819323198485) % 18446744073709551616 AS place FROM range(0, coalesce((SELECT max(n_slots) FROM span), 0)) t(n)),
drawn AS MATERIALIZED (SELECT n AS slot, sid, row_number() OVER (PARTITION BY sid ORDER BY n) - 1 AS k, need FROM point JOIN span ON place >= lo AND place < hi),
short AS (SELECT sid, need, coalesce(c, 0) AS have, n_slots + coalesce(sum(need - coalesce(c, 0)) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM span LEFT JOIN (SELECT sid, count(*) AS c FROM drawn GROUP BY sid) USING (sid) WHERE need > coalesce(c, 0)),
slots AS MATERIALIZED (SELECT slot, sid, k FROM drawn WHERE k < need UNION ALL SELECT base + i, sid, have + i FROM (SELECT *, unnest(range(0, need - have)) AS i FROM short)),
placed AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, size, s, target, words, sid, (sum(size) OVER (PARTITION BY sid ORDER BY r, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size)::bigint AS off FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source),
pass AS MATERIALIZED (SELECT id, sid, p * s + off AS lo, least(p * s + off + size, words) AS hi FROM (SELECT *, unnest(range(0, (words - 1) // s + 1)) AS p FROM placed WHERE size > 0 AND words > 0) WHERE p * s + off < words),
piece AS (SELECT id, sid, unnest(range(lo // 256, (hi - 1) // 256 + 1)) AS k FROM pass),
stands AS (SELECT id, min(slot)::bigint AS first_slot, max(slot)::bigint AS last_slot, count(*) AS n_pieces FROM piece JOIN slots USING (sid, k) GROUP BY id),
taken AS (SELECT id, sum(hi - lo)::bigint AS taken FROM pass GROUP BY id)
SELECT doc_id, size, s AS source_size, target, coalesce(taken, 0) AS taken, first_slot, last_slot, coalesce(n_pieces, 0) AS n_pieces FROM placed LEFT JOIN taken USING (id) LEFT JOIN stands USING (id)"""

OP7_SQL = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, array_to_string(w[k+1:k+5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w)-4, least(len(w), 1)))) AS k FROM d))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b USING (s) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m.y, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x) m USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The other operators rest on trained models, subword vocabularies or alignments; their tests use brute force."""
    return {"op1_substring_dedup": OP1_SQL, "op3_source_mixing": OP3_SQL, "op7_minhash_neardup": OP7_SQL}
