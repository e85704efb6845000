"""The queries of ``entwine.queries`` in DuckDB SQL.

Written from the definitions of the operators, as expressions and common table expressions
that are put together here; no Spark code is shared.
"""

from __future__ import annotations

from .functions.words import ADDRESS_ALIASES, GENERIC_ADDRESS_WORDS, STOPWORDS, TRADING_MARKERS, WEB_SUFFIXES

PARTS = """parts AS (SELECT 'S'||(1+p_partkey%3)||'-'||lpad(p_partkey::varchar,8,'0') AS entity_id, p_partkey AS rowno, (p_partkey%3)::int AS src,
 CASE WHEN p_partkey%3>0 AND p_partkey%7=3 THEN 'r' ELSE '' END || p_name || ' ' || p_type || CASE WHEN p_partkey%3>0 AND p_partkey%5=1 THEN ' hub.com' ELSE '' END AS business_name,
 CASE WHEN p_partkey%11=4 THEN NULL WHEN p_partkey%13=5 THEN p_type||' '||(10000+p_size) ELSE p_size||' '||p_type||' '||p_brand||' '||(10000+p_size) END AS business_address,
 CASE WHEN (p_partkey//3)%10=0 THEN 'FR' ELSE 'US' END AS country FROM part)"""

DOCS = r"""docs AS (SELECT 'S'||(1+doc_id%3)||'-'||lpad(doc_id::varchar,8,'0') AS entity_id, doc_id AS rowno, (doc_id%3)::int AS src, array_to_string(w[1:4],' ') AS business_name,
 (len(w[5])*100+len(w[6])*10+len(w[7]))||' '||array_to_string(w[5:10],' ') AS business_address, lang AS country
 FROM (SELECT *, regexp_split_to_array(regexp_replace(text,'^\s+|\s+$','','g'),'\s+') AS w FROM documents) WHERE len(w)>=10)"""


def _list(words: list[str]) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


def strip_accents(e: str) -> str:
    return f"regexp_replace(strip_accents({e}),'[^\\x00-\\x7F]','','g')"


def clean_domain(e: str) -> str:
    s = "|".join(WEB_SUFFIXES)
    return f"regexp_replace(regexp_replace(coalesce({e},''),'(?i)\\.({s})\\b',' ','g'),'(?i)({s})$','')"


def norm(e: str) -> str:
    return f"trim(regexp_replace(replace(lower({strip_accents(clean_domain(e))}),'&',' and '),'[^a-z0-9]+',' ','g'))"


def dba(e: str) -> str:
    return f"regexp_replace(coalesce({e},''),'(?i)\\b({'|'.join(TRADING_MARKERS)})\\b',' ','g')"


def hyphen(e: str) -> str:
    once = "regexp_replace({},'([0-9])-([0-9])','\\1\\2','g')"
    return once.format(once.format(f"coalesce({e},'')"))


def tokens(normal: str, stop: list[str]) -> str:
    alias = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ADDRESS_ALIASES.items())
    named = f"list_transform(string_split({normal},' '), lambda t: CASE t {alias} ELSE t END)"
    return f"list_filter({named}, lambda t: (len(t)>1 OR regexp_full_match(t,'[0-9]')) AND NOT list_contains({_list(stop)},t))"


def name_tok(e: str) -> str:
    return tokens(norm(dba(e)), STOPWORDS)


def addr_tok(e: str, join: bool = True) -> str:
    return tokens(norm(hyphen(e) if join else e), STOPWORDS + GENERIC_ADDRESS_WORDS)


def numbers(toks: str) -> str:
    return f"list_transform(flatten(list_transform({toks}, lambda t: regexp_extract_all(t,'[0-9]+'))), lambda r: ltrim(r,'0'))"


def distinct(e: str) -> str:
    """Distinct members in order of appearance."""
    return f"list_filter({e}, lambda x, i: list_position({e}, x) = i)"


def city(e: str) -> str:
    words = f"string_split({norm(e)},' ')"
    return f"CASE WHEN len({words})>2 THEN array_to_string({words}[-2:],' ') ELSE {norm(e)} END"


def cells(e: str) -> str:
    return f"array_to_string({e},'|')"


def tok_cte(of: str, name: str = "tok", join: bool = True) -> str:
    """Tokenised records."""
    return f"""{name}_a AS MATERIALIZED (SELECT *, {name_tok('business_name')} AS nt, {addr_tok('business_address', join)} AS atk FROM {of}),
{name} AS MATERIALIZED (SELECT *, array_to_string(nt,'') AS compact, {numbers('atk')} AS nums FROM {name}_a),
{name}_n AS MATERIALIZED (SELECT * EXCLUDE (nums), list_distinct(list_filter(nums, lambda n: len(n) BETWEEN 1 AND 4)) AS bldg, list_distinct(list_filter(nums, lambda n: len(n) BETWEEN 5 AND 6)) AS postal FROM {name})"""


def keys_cte(of: str, name: str = "keys") -> str:
    s = "chr(1)"
    first = lambda a, n: f"array_to_string({a}[1:{n}],{s})"
    rows = [
        ("n2", "len(nt)>=2", first("nt", 2)),
        ("n3", "len(nt)>=3", first("nt", 3)),
        ("ns", "len(u)>=2", first("u", 2)),
        ("n1", "len(u)=1", "u[1]"),
        ("sq", "len(compact)>=5", "compact[1:8]"),
        ("a2", "len(atk)>=2", first("atk", 2)),
        ("aw2", "len(w)>=2", first("w", 2)),
        ("aw3", "len(w)>=3", first("w", 3)),
        ("aw_sort", "len(w)>=3", f"array_to_string(list_sort(w[1:3]),{s})"),
        ("num_2", "len(d)>=2", first("d", 2)),
        ("num_w", "len(d)>=1 AND len(w)>=1", f"d[1]||{s}||w[1]"),
        ("num_w2", "len(d)>=1 AND len(w)>=2", f"d[1]||{s}||w[2]"),
    ]
    union = " UNION ALL ".join(f"SELECT entity_id, src, rowno, '{f}' AS family, country, {k} AS key FROM {name}_w WHERE {c}" for f, c, k in rows)
    long = f"SELECT entity_id, src, rowno, 'num_l', country, unnest(list_filter(d, lambda n: len(n)>=5)) FROM {name}_w"
    return f"""{name}_w AS MATERIALIZED (SELECT *, list_sort(list_distinct(nt)) AS u, list_filter(atk, lambda t: NOT regexp_full_match(t,'[0-9]+') AND len(t)>=3) AS w,
 list_filter(list_transform(list_filter(atk, lambda t: regexp_full_match(t,'[0-9]+')), lambda t: ltrim(t,'0')), lambda n: len(n)>=2) AS d FROM {of}),
{name} AS MATERIALIZED ({union} UNION ALL {long})"""


def pairs_cte(most: int, tok: str = "tok_n", keys: str = "keys") -> str:
    """Distinct pairs of an S1 record and a target that share a key of a small S1 bucket."""
    return f"""small AS MATERIALIZED (SELECT family, country, key FROM {keys} WHERE src=0 GROUP BY ALL HAVING count(*)<={most}),
pair AS MATERIALIZED (SELECT DISTINCT s.rowno AS s_no, t.rowno AS t_no FROM {keys} s JOIN small USING (family, country, key) JOIN {keys} t USING (family, country, key) WHERE s.src=0 AND t.src>0),
body AS MATERIALIZED (SELECT s.entity_id AS s_id, t.entity_id AS t_id, t.src AS t_src, s_no, t_no, s.nt AS sn, t.nt AS tn, s.atk AS sa, t.atk AS ta, s.compact AS sc, t.compact AS tc, s.bldg AS sb, t.bldg AS tb, s.postal AS sp, t.postal AS tp,
 s.business_name AS s_name, t.business_name AS t_name, s.business_address AS s_addr, t.business_address AS t_addr, s.country AS s_country, t.country AS t_country
 FROM pair JOIN {tok} s ON s.rowno=s_no JOIN {tok} t ON t.rowno=t_no)"""


def conflict(a: str, b: str) -> str:
    return f"(len({a})>0 AND len({b})>0 AND NOT list_has_any({a},{b}))"


def common(a: str, b: str) -> str:
    return f"len(list_intersect({a},{b}))::double"


def size(a: str) -> str:
    return f"len(list_distinct({a}))::double"


def dice(a: str, b: str) -> str:
    return f"CASE WHEN len({a})=0 AND len({b})=0 THEN 1.0::double ELSE 2.0::double*{common(a, b)}/({size(a)}+{size(b)}) END"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a})=0 AND len({b})=0 THEN 1.0::double ELSE {common(a, b)}/({size(a)}+{size(b)}-{common(a, b)}) END"


def flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 1.0::double ELSE 0.0::double END"


def ratio(a: str, b: str) -> str:
    a, b = f"len(coalesce({a},''))::double", f"len(coalesce({b},''))::double"
    return f"CASE WHEN greatest({a},{b})=0 THEN 1.0::double ELSE least({a},{b})/greatest({a},{b}) END"


def score(sn: str = "sn", tn: str = "tn", sa: str = "sa", ta: str = "ta") -> str:
    same_city = f"({city('s_addr')})<>'' AND ({city('s_addr')})=({city('t_addr')})"
    return f"CASE WHEN s_country<>t_country THEN 0.0::double ELSE 2.6::double*({dice(sn, tn)})+2.2::double*({jaccard(sn, tn)})+1.4::double*({dice(sa, ta)})+1.1::double*({jaccard(sa, ta)})+{flag('s_country=t_country')}+CASE WHEN {same_city} THEN 0.6::double ELSE 0.0::double END END"


DECIDED = f"""scored AS MATERIALIZED (SELECT *, CASE WHEN len(sn)=0 THEN 0.0::double ELSE {dice('sn', 'tn')} END AS nd, {dice('sa', 'ta')} AS ad, list_has_any(sb,tb) AS bm, list_has_any(sp,tp) AS pm,
 jaro_winkler_similarity(lower(coalesce(s_name,'')[1:35]), lower(coalesce(t_name,'')[1:35])) AS jw FROM body WHERE NOT {conflict('sn', 'tn')} AND NOT {conflict('sb', 'tb')} AND NOT {conflict('sp', 'tp')}),
tiered AS MATERIALIZED (SELECT *, CASE WHEN sc=tc AND len(sc)>=4 THEN 1 WHEN len(sc)>=5 AND len(tc)>=5 AND (contains(sc,tc) OR contains(tc,sc)) THEN 2 WHEN nd>=0.60::double OR ad>=0.70::double THEN 3 ELSE 0 END AS tier,
 (nd>=0.20::double OR ad>=0.30::double) AS candidate FROM scored),
decided AS MATERIALIZED (SELECT *, CASE tier WHEN 1 THEN (bm AND ad>=0.25::double) OR (pm AND ad>=0.40::double) OR ad>=0.70::double OR (len(ta)=0 AND len(sc)>=8)
 WHEN 2 THEN (bm AND ad>=0.25::double) OR (pm AND ad>=0.40::double) OR ad>=0.60::double
 WHEN 3 THEN (jw>=0.92::double AND ad>=0.80::double) OR (jw>=0.88::double AND bm AND ad>=0.50::double) OR (nd>=0.90::double AND bm AND pm) ELSE false END AS is_match FROM tiered),
cand AS MATERIALIZED (SELECT s_id, t_id FROM decided WHERE candidate QUALIFY row_number() OVER (PARTITION BY s_id ORDER BY t_src, t_no, s_no)<=15),
mat AS MATERIALIZED (SELECT s_id, t_id FROM decided WHERE is_match QUALIFY row_number() OVER (PARTITION BY s_id ORDER BY t_src, t_no, s_no)<=10),
full_cand AS MATERIALIZED (SELECT * FROM cand UNION SELECT * FROM mat)"""


def resolve(of: str, most: int = 100) -> str:
    base = PARTS if of == "parts" else DOCS
    return f"WITH {base}, {tok_cte(of)}, {keys_cte('tok')}, {pairs_cte(most)}, {DECIDED} "


def jw_classic(a: str, b: str, of: str) -> str:
    """Classic Jaro-Winkler of the distinct pairs of two string expressions over ``of``, as jwc (a, b, jw)."""
    return f"""jwp AS MATERIALIZED (SELECT *, greatest(0, greatest(len(a), len(b)) // 2 - 1) AS reach FROM (SELECT DISTINCT {a} AS a, {b} AS b FROM {of})),
jwh AS MATERIALIZED (SELECT a, b, list_reduce(list_transform(range(1, len(a) + 1), lambda i: [i]), lambda hits, x: list_append(hits, coalesce(list_min(list_filter(range(greatest(1, x[1] - reach), least(len(b), x[1] + reach) + 1), lambda j: b[j] = a[x[1]] AND NOT list_contains(hits, j))), 0)), []::BIGINT[]) AS hits FROM jwp),
jwt AS MATERIALIZED (SELECT a, b, list_filter(range(1, len(a) + 1), lambda i: hits[i] > 0) AS l, list_sort(list_filter(hits, lambda h: h > 0)) AS t FROM jwh),
jws AS MATERIALIZED (SELECT a, b, len(l)::double AS m, len(list_filter(range(1, len(l) + 1), lambda k: a[l[k]] <> b[t[k]]))::double AS odd,
 CASE WHEN a[1] <> b[1] THEN 0 WHEN a[1:2] <> b[1:2] OR least(len(a), len(b)) < 2 THEN 1 WHEN a[1:3] <> b[1:3] OR least(len(a), len(b)) < 3 THEN 2 WHEN a[1:4] <> b[1:4] OR least(len(a), len(b)) < 4 THEN 3 ELSE 4 END AS p FROM jwt),
jwj AS MATERIALIZED (SELECT a, b, p, (m / len(a) + m / len(b) + (m - odd / 2.0::double) / m) / 3.0::double AS j, m FROM jws),
jwc AS MATERIALIZED (SELECT a, b, CASE WHEN a = b THEN 1.0::double WHEN a = '' OR b = '' OR m = 0 THEN 0.0::double ELSE j + 0.1::double * p * (1.0::double - j) END AS jw FROM jwj)"""


def simple(e: str, of: str = "docs", column: str = "business_name", name: str = "result") -> str:
    base = PARTS if of == "parts" else DOCS
    return f"WITH {base} SELECT entity_id, {e} AS {name} FROM {of}"


TRUTH = """t0 AS (SELECT d.*, substr(x.text,1,60) AS prefix FROM docs d JOIN documents x ON x.doc_id=d.rowno),
truth AS MATERIALIZED (SELECT DISTINCT a.entity_id AS s1_id, b.entity_id AS t_id FROM t0 a JOIN t0 b ON a.prefix=b.prefix WHERE a.src=0 AND b.src>0),
ids AS MATERIALIZED (SELECT entity_id AS s1_id FROM docs WHERE src=0)"""


def metric(lenient: bool, predicted: str = "mat") -> str:
    if lenient:
        p, r = "b/greatest(np,1)::double", "b/greatest(na,1)::double"
        f = f"CASE WHEN {p}=0 AND {r}=0 THEN CASE WHEN na=0 THEN 1.0 ELSE 0.0 END ELSE 1.25::double*{p}*{r}/(0.25::double*{p}+{r}) END"
    else:
        p, r = "CASE WHEN np>0 THEN b/np::double WHEN na=0 THEN 1.0::double ELSE 0.0::double END", "CASE WHEN na>0 THEN b/na::double ELSE 1.0::double END"
        f = f"CASE WHEN ({p})+({r})=0 THEN 0.0 ELSE 1.25::double*({p})*({r})/(0.25::double*({p})+({r})) END"
    counts = f"SELECT ids.s1_id, (SELECT count(*) FROM truth t WHERE t.s1_id=ids.s1_id) AS na, (SELECT count(*) FROM {predicted} m WHERE m.s_id=ids.s1_id) AS np, (SELECT count(*) FROM {predicted} m JOIN truth t ON t.s1_id=m.s_id AND t.t_id=m.t_id WHERE m.s_id=ids.s1_id) AS b FROM ids"
    return f"SELECT round(avg(({f})::double),6) AS f05, round(avg(({p})::double),6) AS precision, round(avg(({r})::double),6) AS recall FROM ({counts})"


def idf_cte(col: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT token, ln((n+1)/(df+1)::double)+1 AS idf FROM (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({col})) AS token FROM corpus) GROUP BY token), (SELECT count(*) AS n FROM corpus))"""


# names without accents, as jaro_winkler_similarity compares bytes
PLAIN = DOCS.replace("docs AS (", "accented AS (", 1) + f", docs AS (SELECT * REPLACE ({strip_accents('business_name')} AS business_name) FROM accented)"
FEATURES_BASE = f"WITH {PLAIN}, {tok_cte('docs', join=False)}, {keys_cte('tok')}, {pairs_cte(100)}, corpus AS MATERIALIZED (SELECT sn AS nt, sa AS atk FROM body UNION ALL SELECT nt, atk FROM tok WHERE src>0), {idf_cte('nt', 'idf_nt')}, {idf_cte('atk', 'idf_at')}"


def weighted(a: str, b: str, idf: str, default: float) -> str:
    """Weighted dice of every pair, as (s_no, t_no, v)."""

    def total(e: str) -> str:
        return f"(SELECT sum(coalesce(i.idf,{default}::double)) FROM (SELECT unnest({e}) AS token) u LEFT JOIN {idf} i USING (token))"

    return f"CASE WHEN len(list_intersect({a},{b}))=0 THEN 0.0::double ELSE 2.0::double*{total(f'list_intersect({a},{b})')}/({total(f'list_distinct({a})')}+{total(f'list_distinct({b})')}) END"


def features(columns: list[str]) -> str:
    digits = lambda a: f"list_filter({a}, lambda t: regexp_full_match(t,'[0-9]+'))"
    every = {
        "nd": dice("sn", "tn"),
        "w_nd": weighted("sn", "tn", "idf_nt", 6.0),
        "nj": jaccard("sn", "tn"),
        "jw": "jaro_winkler_similarity(lower(coalesce(s_name,'')[1:40]), lower(coalesce(t_name,'')[1:40]))",
        "ad": dice("sa", "ta"),
        "w_ad": weighted("sa", "ta", "idf_at", 4.0),
        "aj": jaccard("sa", "ta"),
        "num_m": flag(f"list_has_any({digits('sa')},{digits('ta')})"),
        "num_conf": flag(conflict(digits("sa"), digits("ta"))),
        "lr_n": ratio("s_name", "t_name"),
        "lr_a": ratio("s_addr", "t_addr"),
        "cm": flag(f"({city('s_addr')})<>'' AND ({city('s_addr')})=({city('t_addr')})"),
    }
    inner = ", ".join(f"({every[c]}) AS {c}" for c in every)
    extra = {"comp": "2.6::double*nd+2.2::double*nj+1.4::double*ad+1.1::double*aj+1.0::double+0.6::double*cm", "w_nd_x_w_ad": "w_nd*w_ad"}
    outer = ", ".join(f"round({extra.get(c, c)},6) AS {c}" for c in columns)
    return f"{FEATURES_BASE} SELECT s_id, t_id, {outer} FROM (SELECT s_id, t_id, {inner} FROM body)"


def oracle_sql() -> dict[str, str]:
    from .operators.features import FEATURES
    from .operators.metrics import thresholds

    parts, docs = resolve("parts"), resolve("docs")
    tok_docs = f"WITH {DOCS}, {tok_cte('docs')} "
    keys_docs = f"WITH {DOCS}, {tok_cte('docs')}, {keys_cte('tok')} "
    keys_parts = f"WITH {PARTS}, {tok_cte('parts')}, {keys_cte('tok')} "
    with_pairs = f"WITH {PARTS}, {tok_cte('parts')}, {keys_cte('tok')}, {pairs_cte(100)} "
    show = "replace(key, chr(1), '|') AS key"
    entry_b = f"""WITH {DOCS}, {tok_cte('docs', join=False)}, {keys_cte('tok')}, small AS MATERIALIZED (SELECT family, country, key FROM keys WHERE src>0 GROUP BY ALL HAVING count(DISTINCT entity_id)<=100),
pair AS MATERIALIZED (SELECT DISTINCT s.rowno AS s_no, t.rowno AS t_no FROM keys s JOIN small USING (family, country, key) JOIN keys t USING (family, country, key) WHERE s.src=0 AND t.src>0),
body AS MATERIALIZED (SELECT s.entity_id AS s_id, t.entity_id AS t_id, s.nt AS sn, t.nt AS tn, s.atk AS sa, t.atk AS ta, s.business_address AS s_addr, t.business_address AS t_addr, s.country AS s_country, t.country AS t_country FROM pair JOIN tok s ON s.rowno=s_no JOIN tok t ON t.rowno=t_no),
gen AS MATERIALIZED (SELECT s_id, t_id, {score()} AS score FROM body WHERE s_country=t_country) """
    grid = ",".join(f"({i},{x!r}::double)" for i, x in enumerate(thresholds()))
    sweep_counts = "SELECT i, threshold, ids.s1_id, (SELECT count(*) FROM truth t WHERE t.s1_id=ids.s1_id) AS na, coalesce(p.np,0) AS np, coalesce(p.b,0) AS b FROM ids CROSS JOIN grid LEFT JOIN pred p USING (i, s1_id)"
    p, r = "CASE WHEN np>0 THEN b/np::double WHEN na=0 THEN 1.0::double ELSE 0.0::double END", "CASE WHEN na>0 THEN b/na::double ELSE 1.0::double END"
    out_rows = "SELECT d.entity_id AS source1_entity_id, coalesce(string_agg(DISTINCT m.t_id, ',' ORDER BY m.t_id),'') AS {c} FROM {of} d LEFT JOIN {t} m ON m.s_id=d.entity_id WHERE d.src=0 GROUP BY d.entity_id, d.rowno"
    names = [f"lower(coalesce({x}_name,'')[1:35])" for x in "st"]
    threshold_jw = f"jaro_winkler_similarity({names[0]}, {names[1]})"
    by_classic = DECIDED.replace(threshold_jw, "jwc.jw").replace("FROM body WHERE", f"FROM body JOIN jwc ON jwc.a={names[0]} AND jwc.b={names[1]} WHERE")
    default_parts = f"WITH {PARTS}, {tok_cte('parts')}, {keys_cte('tok')}, {pairs_cte(100)}, {jw_classic(*names, 'body')}, {by_classic} "
    default_docs = default_parts.replace(PARTS, DOCS, 1).replace(tok_cte("parts"), tok_cte("docs"), 1)
    head = "SELECT entity_id, rowno, 'train' AS split FROM (SELECT * FROM parts WHERE src=0 ORDER BY rowno LIMIT 300) UNION ALL SELECT entity_id, rowno, 'valid' FROM (SELECT * FROM parts WHERE src=0 ORDER BY rowno LIMIT 100 OFFSET 300)"
    needed = f"{TRUTH}, needed AS (SELECT DISTINCT t_id AS entity_id FROM truth)"
    q = {
        "norm_text": simple(norm("business_name")),
        "clean_domain": simple(clean_domain("business_name"), "parts"),
        "clean_dba": simple(dba("replace(business_name, ' hub', ' t/a hub')"), "parts"),
        "hyphen_join": simple(hyphen("replace(business_address, ' ', '-')"), "parts"),
        "compact_name": tok_docs + "SELECT entity_id, compact AS result FROM tok",
        "strip_accents": f"SELECT doc_id, {strip_accents('text')} AS result FROM documents",
        "name_tokens": tok_docs + f"SELECT entity_id, {cells('nt')} AS result FROM tok",
        "addr_tokens": tok_docs + f"SELECT entity_id, {cells('atk')} AS result FROM tok",
        "addr_tokens_unjoined": f"WITH {PARTS} SELECT entity_id, {cells(addr_tok('business_address', False))} AS result FROM parts",
        "city": simple(city("business_address"), "parts"),
        "bldg_postal": f"WITH {PARTS}, {tok_cte('parts')} SELECT entity_id, {cells('list_sort(bldg)')} AS bldg, {cells('list_sort(postal)')} AS postal FROM tok_n",
        "clean_digits": tok_docs + f"SELECT entity_id, {cells('list_sort(list_distinct(list_filter(nums, lambda n: len(n)>=2)))')} AS result FROM tok",
        "indic_flag": "SELECT doc_id, regexp_matches(text || CASE WHEN doc_id%2=0 THEN 'नम' ELSE '' END, '[\\x{0900}-\\x{0D7F}]') AS result FROM documents",
        "raw_prefix": f"WITH {DOCS} SELECT entity_id, lower(business_name[1:35]) AS result FROM docs",
        "jaccard": with_pairs + f"SELECT s_id, t_id, round({jaccard('sa', 'ta')},6) AS result FROM body",
        "dice": with_pairs + f"SELECT s_id, t_id, round({dice('sn', 'tn')},6) AS result FROM body",
        "len_ratio": with_pairs + f"SELECT s_id, t_id, round({ratio('s_addr', 't_addr')},6) AS result FROM body",
        "digit_overlap": with_pairs
        + "SELECT s_id, t_id, list_has_any(sd,td) AS overlap, (len(sd)>0 AND len(td)>0 AND NOT list_has_any(sd,td)) AS conflict FROM (SELECT s_id, t_id, list_filter(sa, lambda t: regexp_full_match(t,'[0-9]+')) AS sd, list_filter(ta, lambda t: regexp_full_match(t,'[0-9]+')) AS td FROM body)",
        "jaro_winkler": with_pairs + "SELECT s_id, t_id, round(jaro_winkler_similarity(lower(s_name[1:35]), lower(t_name[1:35])),6) AS result FROM body",
        "jaro_winkler_classic": f"{with_pairs}, {jw_classic(*names, 'body')} SELECT s_id, t_id, round(jw,6) AS result FROM body JOIN jwc ON a={names[0]} AND b={names[1]}",
        "resolve_default": default_parts + "SELECT s_id, t_id FROM mat",
        "decisions_default": default_docs + "SELECT s_id, t_id, candidate, tier, is_match FROM decided WHERE candidate OR is_match",
        "candidates_by_id": entry_b + "SELECT d.entity_id AS source1_entity_id, coalesce(string_agg(DISTINCT g.t_id, ',' ORDER BY g.t_id),'') AS candidate_entity_ids FROM docs d LEFT JOIN gen g ON g.s_id=d.entity_id AND g.score>=2.0::double WHERE d.src=0 GROUP BY d.entity_id, d.rowno",
        "blocking_keys": keys_docs + f"SELECT entity_id, family, country, {show} FROM keys",
        "block_sizes": keys_parts + f"SELECT family, country, {show}, count(*) AS n FROM keys WHERE src=0 GROUP BY ALL",
        "pruned_blocks": keys_parts + f"SELECT entity_id, family, country, {show} FROM keys WHERE src=0 AND (family, country, key) IN (SELECT (family, country, key) FROM keys WHERE src=0 GROUP BY ALL HAVING count(*)<=20)",
        "block_index_distinct": keys_docs + f"SELECT family, country, {show}, count(DISTINCT entity_id) AS n, string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) AS ids FROM keys GROUP BY ALL HAVING count(DISTINCT entity_id)<=100",
        "blocking_join": with_pairs + "SELECT s.entity_id AS s_id, t.entity_id AS t_id, s.family, count(*) AS n FROM keys s JOIN small USING (family, country, key) JOIN keys t USING (family, country, key) WHERE s.src=0 AND t.src>0 GROUP BY ALL",
        "pairs_deduped": with_pairs + "SELECT s_id, t_id FROM body",
        "name_gate": with_pairs + f"SELECT s_id, t_id FROM body WHERE NOT {conflict('sn', 'tn')}",
        "bldg_veto": with_pairs + f"SELECT s_id, t_id FROM body WHERE {conflict('sb', 'tb')}",
        "postal_veto": with_pairs + f"SELECT s_id, t_id FROM body WHERE {conflict('sp', 'tp')}",
        "pair_decisions": docs + "SELECT s_id, t_id, candidate, tier, is_match, round(nd,6) AS nd, round(ad,6) AS ad FROM decided WHERE candidate OR is_match",
        "tier_exact": parts + "SELECT s_id, t_id, is_match FROM decided WHERE tier=1 AND (candidate OR is_match)",
        "tier_domain": parts + "SELECT s_id, t_id, is_match FROM decided WHERE tier=2 AND (candidate OR is_match)",
        "tier_typo": parts + "SELECT s_id, t_id, is_match FROM decided WHERE tier=3",
        "candidates_top15": docs + "SELECT s_id, t_id FROM cand",
        "matches_top10": docs + "SELECT s_id, t_id FROM mat",
        "candidates_completed": docs + "SELECT s_id, t_id FROM full_cand",
        "resolve": parts + "SELECT s_id, t_id FROM mat",
        "candidate_output": docs + out_rows.format(c="candidate_entity_ids", of="docs", t="full_cand"),
        "matching_output": parts + out_rows.format(c="matched_entity_ids", of="parts", t="mat"),
        "pair_score": with_pairs + f"SELECT s_id, t_id, round({score()},6) AS score FROM body",
        "generate_candidates": entry_b + "SELECT s_id, t_id FROM gen WHERE score>=2.0::double",
        "split_cells": docs + ", outp AS (" + out_rows.format(c="ids", of="docs", t="mat") + ") SELECT source1_entity_id AS s_id, unnest(string_split(ids,',')) AS t_id FROM outp WHERE ids<>''",
        "semi_needed": f"WITH {DOCS}, {needed} SELECT d.entity_id, rowno FROM docs d WHERE src>0 AND entity_id IN (SELECT entity_id FROM needed)",
        "anti_distractors": f"WITH {DOCS}, {needed} SELECT entity_id, rowno FROM docs WHERE src>0 AND entity_id NOT IN (SELECT entity_id FROM needed) QUALIFY row_number() OVER (PARTITION BY src ORDER BY rowno)<=100",
        "dedup_first": f"WITH {DOCS}, two AS (SELECT entity_id, src, rowno FROM docs UNION ALL SELECT entity_id, src+3, rowno+1 FROM docs WHERE rowno%2=0) SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY src, rowno)=1",
        "head_split": f"WITH {PARTS} {head}",
        "id_prefix": f"WITH {DOCS} SELECT entity_id, starts_with(entity_id,'S2-') AS s2, starts_with(entity_id,'S3-') AS s3 FROM docs",
        "idf_name": FEATURES_BASE + " SELECT token, round(idf,6) AS idf FROM idf_nt",
        "idf_addr": FEATURES_BASE + " SELECT token, round(idf,6) AS idf FROM idf_at",
        "weighted_dice": features(["w_nd", "w_ad"]),
        "pair_features": features(FEATURES),
        "pair_labels": f"{docs}, {TRUTH} SELECT s_id, t_id, (EXISTS (SELECT 1 FROM truth t WHERE t.s1_id=s_id AND t.t_id=body.t_id))::int AS label FROM body",
        "macro_f05": f"{docs}, {TRUTH} {metric(False)}",
        "macro_f05_lenient": f"{docs}, {TRUTH} {metric(True)}",
        "threshold_sweep": f"{docs}, {TRUTH}, grid(i, threshold) AS (VALUES {grid}), scores AS MATERIALIZED (SELECT s_id, t_id, {dice('sn', 'tn')} AS p FROM body), pred AS MATERIALIZED (SELECT i, s_id AS s1_id, count(*) AS np, count(t.t_id) AS b FROM scores JOIN grid ON p>=threshold LEFT JOIN truth t ON t.s1_id=s_id AND t.t_id=scores.t_id GROUP BY ALL) "
        f"SELECT round(threshold,2) AS threshold, round(avg((CASE WHEN ({p})+({r})=0 THEN 0.0 ELSE 1.25::double*({p})*({r})/(0.25::double*({p})+({r})) END)::double),6) AS f05, round(avg(({p})::double),6) AS precision, round(avg(({r})::double),6) AS recall FROM ({sweep_counts}) GROUP BY i, threshold",
        "validate_outputs": "SELECT * FROM (VALUES ('candidate_rows',0::bigint),('match_rows',0),('unknown_candidates',0),('unknown_matches',0),('repeated_ids',0),('matches_beyond_candidates',0)) v(fault, n)",
    }
    return q
