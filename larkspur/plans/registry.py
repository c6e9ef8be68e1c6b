"""All registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import fixed, ingredient_text, prices, urls
from larkspur.operators import audit, catalog, ingredients, kb, offers, rows
from larkspur.plans import duck
from larkspur.plans.base import QUERIES, SQL, registered
from larkspur.plans.duck import q, strip, sub, text
from larkspur.plans.views import CANDIDATES, OFFERS, TASK_ROWS, VARIANTS, load, view
from larkspur.scratch import spread, stored

C = f"WITH cand AS ({CANDIDATES})"
_PARSE_KEEP = "row_id, import_id, row_index, brand, product_name, market, sku_key, raw_ingredient_text, source_ref, source_type, review_status, status"
_steps, _ = duck.clean_ctes("(SELECT *, " + duck.strip_label("raw_ingredient_text") + " AS x FROM cand)", "x", _PARSE_KEEP)
_dict_rows = ", ".join(f"({k}, {q(a)}, {q(b)})" for k, (a, b) in enumerate(fixed.SYNONYMS))
_tidy = lambda t: duck.collapse(duck.strip_of(strip(duck.strip_of(strip(t), " \t\n\r–—•·●・-")), duck.PUNCT))
_TIDIED = f"list_filter(list_transform(list_filter(list_transform(string_split(marked, chr(1)), lambda p: {strip('p')}), lambda p: p <> ''), lambda t: {_tidy('t')}), lambda t: t <> '')"
#: Cleaned rows with tokens, then their names by dictionary, then the parse; states I1 to I5 again.
PARSE = f"""{C}, {_steps},
{duck.marked_ctes('one', 'cleaned', 'cleaned', ',，、;；' + chr(10) + chr(13) + chr(9) + '|•·●・')},
single AS (SELECT row_id, list_filter(list_transform(string_split(marked, chr(1)), lambda p: {strip('p')}), lambda p: p <> '') AS pieces FROM one),
slashed AS (SELECT row_id, pieces[1] AS cleaned FROM single WHERE len(pieces) = 1 AND regexp_matches(pieces[1], '\\s/\\s')),
{duck.marked_ctes('two', 'slashed', 'cleaned', '/')},
toks AS (SELECT cleaned.*, CASE WHEN two.row_id IS NOT NULL THEN {_TIDIED.replace('marked', 'two.marked')} ELSE {_TIDIED.replace('marked', 'one.marked')} END AS tokens FROM cleaned JOIN one USING (row_id) LEFT JOIN two USING (row_id)),
dict0 AS (SELECT {duck.lookup_key('a')} AS key, b AS standard, k FROM (VALUES {_dict_rows}) v(k, a, b)),
dict AS (SELECT key, arg_min(standard, k) AS standard FROM dict0 GROUP BY key),
items AS (SELECT row_id, i, tok, tagged, {duck.lookup_key('tok')} AS key FROM (SELECT row_id, i, {strip(sub('tok', "<[^>]{1,80}>"))} AS tok, regexp_matches(tok, '<[^>]{{1,80}}>') AS tagged FROM (SELECT row_id, unnest(range(1, len(tokens) + 1)) AS i, unnest(tokens) AS tok FROM toks)) WHERE tok <> ''),
named AS (SELECT items.row_id, i, tok, tagged, dict.standard IS NULL AS uncertain, regexp_matches(tok, '[一-鿿]') AS cjk, CASE WHEN dict.standard IS NOT NULL THEN dict.standard WHEN regexp_matches(tok, '[一-鿿]') THEN tok WHEN regexp_matches(tok, '[A-Z0-9]|[-/]') THEN replace(replace(upper(tok[1]), 'ß', 'SS'), 'ẞ', 'SS') || tok[2:]
  ELSE array_to_string(list_transform(regexp_split_to_array(tok, '\\s+'), lambda w: replace(replace(upper(w[1]), 'ß', 'SS'), 'ẞ', 'SS') || w[2:]), ' ') END AS name FROM items LEFT JOIN dict USING (key)),
agg AS (SELECT row_id, string_agg(name, '; ' ORDER BY i) AS inci_list, count(*) AS n_items, count(DISTINCT CASE WHEN uncertain THEN tok END) AS n_unrecognized, count(CASE WHEN uncertain AND cjk THEN 1 END) AS n_review FROM named GROUP BY row_id),
invalid AS (SELECT row_id, {strip('cleaned')} = '' OR lower(cleaned) IN ({', '.join(q(w) for w in fixed.BLANK_WORDS)}) OR {duck.any_of('lower(cleaned)', fixed.NO_SOURCE_PHRASES)} OR len(tokens) = 0 AS bad,
  len(tokens) = 1 AND (length(tokens[1]) >= 80 OR len(regexp_extract_all(tokens[1], '[A-Za-z0-9]+')) >= 6) AS failed FROM toks),
scored AS (SELECT toks.* EXCLUDE (tokens), bad, inci_list, n_items, n_unrecognized, CASE WHEN bad THEN 0.0 ELSE greatest(0.0, round(1 - CASE WHEN failed THEN 0.5 ELSE 0 END - 0.1 * coalesce(n_review, 0), 6)) END::DOUBLE AS parse_confidence
  FROM toks JOIN invalid USING (row_id) LEFT JOIN agg USING (row_id)),
parse AS (SELECT * EXCLUDE (bad, inci_list, n_items, n_unrecognized), CASE WHEN bad THEN 'NEEDS_SOURCE' WHEN parse_confidence < 0.6 THEN 'NEEDS_REVIEW' ELSE 'OK' END AS parse_status, CASE WHEN bad THEN '' ELSE coalesce(inci_list, '') END AS inci_list,
  CASE WHEN bad THEN 0 ELSE coalesce(n_items, 0) END AS n_items, CASE WHEN bad THEN 0 ELSE coalesce(n_unrecognized, 0) END AS n_unrecognized FROM scored)
"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CANDIDATES)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingredients.parsed(spread(candidates(spark, sf_dir)))


@registered("ingredient_parse", PARSE + "SELECT row_id, cleaned AS cleaned_text, parse_status, inci_list, parse_confidence, n_items, n_unrecognized, len(CASE WHEN parse_status = 'NEEDS_SOURCE' THEN [] ELSE notes END) AS n_notes FROM parse")
def ingredient_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1 to I5."""
    noise = F.size(F.filter("notes", lambda n: ~n.startswith("Mapped") & ~n.startswith("Removed tag"))).cast("long")
    return parsed(spark, sf_dir).select("row_id", "cleaned_text", "parse_status", "inci_list", "parse_confidence", F.size("inci").cast("long").alias("n_items"), F.size("unrecognized").cast("long").alias("n_unrecognized"), noise.alias("n_notes"))


@registered("ingredient_items", PARSE + "SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY i)::INT AS place, name AS standard_name, tok AS original_text, uncertain, uncertain AND cjk AS needs_review FROM named JOIN (SELECT row_id FROM parse WHERE parse_status <> 'NEEDS_SOURCE') USING (row_id)")
def ingredient_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ingredient of every list, in order."""
    items = stored(parsed(spark, sf_dir).select("row_id", "inci"), "parsed-items").select("row_id", F.explode("inci").alias("i"))
    return items.select("row_id", F.col("i.order").alias("place"), "i.standard_name", "i.original_text", "i.uncertain", "i.needs_review")


@registered("ingredient_parse_all")
def ingredient_parse_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).select("row_id", "cleaned_text", "parse_status", "inci_list", "inci", "unrecognized", "notes", "parse_confidence", "needs_review")


@registered("unrecognized_report", PARSE + "SELECT tok AS token, count(DISTINCT row_id) AS n_rows, count(*) AS n_occurrences FROM named JOIN (SELECT row_id FROM parse WHERE parse_status <> 'NEEDS_SOURCE') USING (row_id) WHERE uncertain GROUP BY tok")
def unrecognized_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingredients.unrecognized_report(stored(parsed(spark, sf_dir).select("row_id", "inci"), "parsed-items"))


#: Later versions of the dictionary, of the candidates' own first tokens: version 2 names them, version 3 renames some and takes others out.
_FIRST = "SELECT row_id, token, row_number() OVER (ORDER BY cast(row_id AS bigint)) AS position FROM (SELECT row_id, trim(split_part(raw_ingredient_text, ',', 1)) AS token FROM cand WHERE cast(row_id AS bigint) % 3 = 0) WHERE length(token) BETWEEN 2 AND 60 AND token NOT LIKE '%<%'"
_VERSIONS = f"""SELECT token AS synonym, 'Known ' || cast(length(token) AS string) AS standard, 2 AS version, position FROM ({_FIRST}) UNION ALL
SELECT token, CASE WHEN position % 2 = 0 THEN 'Renamed ' || cast(position AS string) END, 3, position FROM ({_FIRST}) WHERE position % 4 < 2"""
_versioned = PARSE.replace("dict AS (SELECT key, arg_min(standard, k) AS standard FROM dict0 GROUP BY key)", f"versions AS (SELECT key, standard, 1 AS version, k AS position FROM dict0 UNION ALL SELECT {duck.lookup_key('synonym')} AS key, standard, version, position FROM ({_VERSIONS})),\ndict AS (SELECT * FROM (SELECT key, first(standard ORDER BY version DESC, position) AS standard FROM versions GROUP BY key) WHERE standard IS NOT NULL)")


@registered("ingredient_versions", _versioned + "SELECT row_id, parse_status, inci_list, parse_confidence, n_items, n_unrecognized FROM parse")
def ingredient_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I3 by a dictionary table of three versions, whose newest entry counts."""
    cand = candidates(spark, sf_dir)
    later = spark.sql(_VERSIONS.replace("FROM cand", "FROM {cand}"), cand=cand)
    table = ingredients.built_in_dictionary(spark).unionByName(later.withColumns({"position": F.col("position").cast("long")}))
    done = ingredients.parsed(spread(cand), dictionary=ingredients.dictionary_names(table))
    return done.select("row_id", "parse_status", "inci_list", "parse_confidence", F.size("inci").cast("long").alias("n_items"), F.size("unrecognized").cast("long").alias("n_unrecognized"))


@registered("unrecognized_sketches", PARSE + "SELECT tok AS token, count(DISTINCT row_id) AS n_rows, count(*) AS n_occurrences FROM named JOIN (SELECT row_id FROM parse WHERE parse_status <> 'NEEDS_SOURCE') USING (row_id) WHERE uncertain GROUP BY tok")
def unrecognized_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I7 of sketches: two halves of the imports are summed up apart and then put together."""
    rows = stored(parsed(spark, sf_dir), "parsed")
    halves = [stored(ingredients.unrecognized_sketches(rows.filter(F.col("import_id").isin(k))), "sketches") for k in (["0", "1"], ["2", "3"])]
    return ingredients.merged_sketches(*halves).select("token", "n_rows", "n_occurrences")


_page = f"{duck.host('url')} || lower(regexp_replace({duck.path('url')}, '/+$', ''))"


def _conflicts(source: str) -> str:
    """CTEs of A6 over a table of candidates with inci_list; the last is clash (row_id, conflicting_row_id)."""
    return f"""b AS (SELECT *, array_to_string(list_filter(list_transform(string_split(inci_list, ';'), lambda p: lower({strip('p')})), lambda p: p <> ''), ';') AS inci, {duck.url_like('source_ref')} AS page_url FROM {source}),
p AS (SELECT *, CASE WHEN page_url <> '' THEN {_page.replace('url', 'page_url')} END AS page, regexp_matches('&' || {duck.query('page_url')}, '&variant=[^&]') AS variant FROM b WHERE {strip(text('sku_key'))} <> '' AND inci <> ''),
m AS (SELECT x.row_id, y.row_id AS other, x.import_id <> y.import_id AS far, y.row_index AS ri FROM p x JOIN p y ON x.sku_key = y.sku_key AND x.inci <> y.inci AND x.row_id <> y.row_id
  WHERE x.import_id = y.import_id OR (y.review_status = 'APPROVED' AND NOT coalesce(lower(x.source_type) = 'official' AND lower(y.source_type) = 'official' AND x.page = y.page AND x.variant AND NOT y.variant, false))),
clash AS (SELECT row_id, first(other ORDER BY far, ri, other) AS conflicting_row_id FROM m GROUP BY row_id)"""


_hosts = lambda b: "list_filter([" + ", ".join(f"CASE WHEN contains(lower({strip(text(b))}), {q(k)}) THEN {q(h)} END" for k, h in fixed.OFFICIAL_HOSTS) + "], lambda x: x IS NOT NULL)"
#: CTEs over parse and named: the last is audit, a row per candidate with the names of its findings.
AUDIT = f""", {_conflicts('parse')}, noted AS MATERIALIZED (SELECT DISTINCT row_id FROM named WHERE tagged OR NOT uncertain AND regexp_matches(tok || ' ' || name, '(?i)ui|noise|artifact|strip|removed|truncat|cleanup|boilerplate|marketing') AND {duck.lookup_key('name')} <> {duck.lookup_key('tok')}), a1 AS MATERIALIZED (SELECT *, {duck.url_like('source_ref')} AS url, {duck.effective_type('source_type', 'source_ref')} AS kind FROM parse),
a2 AS MATERIALIZED (SELECT *, {duck.tokens(duck.host('url') + " || ' ' || " + duck.path('url'))} AS ut, {duck.tokens('brand')} AS bt, {duck.tokens('product_name')} AS pt, {duck.host('url')} AS h, {_hosts('brand')} AS official FROM a1),
a3 AS MATERIALIZED (SELECT *, CASE WHEN url = '' THEN 'missing' WHEN len(list_intersect(ut, bt)) > 0 OR len(list_intersect(ut, pt)) > 0 THEN 'match' WHEN kind IN ('official', 'retailer') AND len(pt) > 0 THEN 'mismatch' ELSE 'unknown' END AS source_match_status,
  len(official) > 0 AND h <> '' AND len(list_filter(official, lambda x: h = x OR ends_with(h, '.' || x))) = 0 AS wrong_host,
  CASE WHEN {strip(text('raw_ingredient_text'))} = '' AND {strip(text('cleaned'))} = '' THEN 'none' WHEN contains(lower({text('raw_ingredient_text')}), 'ingredient') OR contains(lower({text('raw_ingredient_text')}), 'inci') THEN 'labeled_ingredients'
  WHEN parse_status = 'OK' AND inci_list <> '' THEN 'structured_list' WHEN regexp_matches({text('raw_ingredient_text')}, {q(fixed.MARKETING)}) THEN 'noisy_text' ELSE 'ambiguous_text' END AS ingredient_signal_type FROM a2),
a4 AS MATERIALIZED (SELECT *, list_filter([CASE WHEN {strip(text('source_ref'))} = '' THEN 'missing_source_ref' END, CASE WHEN source_match_status = 'mismatch' THEN 'source_product_mismatch' END, CASE WHEN wrong_host AND kind = 'official' THEN 'source_host_not_allowlisted' END,
  CASE WHEN {strip(text('raw_ingredient_text'))} = '' THEN 'empty_raw_ingredient_text' END, CASE parse_status WHEN 'NEEDS_SOURCE' THEN 'parser_needs_source' WHEN 'NEEDS_REVIEW' THEN 'parser_needs_review' END, CASE WHEN row_id IN (SELECT row_id FROM clash) THEN 'duplicate_conflicting_candidate' END], lambda x: x IS NOT NULL) AS blocking,
  list_filter([CASE WHEN wrong_host AND kind <> 'official' THEN 'source_host_not_allowlisted' END, CASE WHEN kind IN ('thirdparty', 'retailer') THEN 'non_official_source_requires_review' END, CASE WHEN ingredient_signal_type = 'noisy_text' THEN 'marketing_copy_instead_of_ingredients' END,
  CASE WHEN parse_status = 'OK' AND coalesce(parse_confidence, 0) < 0.8 THEN 'low_parse_confidence' END, CASE WHEN parse_status <> 'NEEDS_SOURCE' AND (len(notes) > 0 OR row_id IN (SELECT row_id FROM noted)) THEN 'truncated_or_noisy_text' END], lambda x: x IS NOT NULL) AS doubtful FROM a3),
audit AS (SELECT *, len(blocking) AS blockers, len(doubtful) AS reviews, CASE WHEN len(blocking) > 0 THEN 'FAIL' WHEN len(doubtful) > 0 THEN 'REVIEW' ELSE 'PASS' END AS audit_status, greatest(0.0, round(1 - 0.35 * len(blocking) - 0.08 * len(doubtful), 6))::DOUBLE AS audit_score FROM a4)
"""
_audit_sql = PARSE + AUDIT


def audited(spark: SparkSession, sf_dir: str, counts: bool = False) -> DataFrame:
    """All candidates parsed (once: the audit reads the result several times) and audited, with every rule. counts: with the numbers of broken rules, and of the parse what the audit reads."""
    rows_ = parsed(spark, sf_dir)
    return audit.audited(stored(rows_.select(*[c for c in rows_.columns if not counts or c in audit.READ]), "parsed", compact=True), counts=counts)


@registered("audit_rows", _audit_sql + "SELECT row_id, source_match_status, ingredient_signal_type, audit_status, audit_score, coalesce(parse_status = 'OK' AND review_status = 'APPROVED' AND audit_status = 'PASS', false) AS ingest_allowed, blockers + reviews AS n_findings, row_id IN (SELECT row_id FROM clash) AS in_conflict FROM audit")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 to A9."""
    found = (F.col("blockers") + F.col("reviews")).cast("long").alias("n_findings")
    return audited(spark, sf_dir, counts=True).select("row_id", "source_match_status", "ingredient_signal_type", "audit_status", "audit_score", "ingest_allowed", found, "in_conflict")


@registered("audit_summary", _audit_sql + "SELECT import_id, count(*) AS scanned, count_if(blockers + reviews > 0) AS flagged_rows, sum(blockers + reviews)::BIGINT AS findings_total, sum(blockers)::BIGINT AS blocker_count, sum(reviews)::BIGINT AS review_count, 0::BIGINT AS info_count, round(avg(audit_score), 6) AS avg_score FROM audit GROUP BY import_id")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 (the flagship): what the audit finds, per import."""
    return audit.audit_summary(audited(spark, sf_dir, counts=True))


_light = f"{C}, r AS (SELECT *, upper(brand) || ';' || cast(row_index % 5 AS string) AS inci_list, CAST(NULL AS string) AS candidate_id FROM cand)"


def _light_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a short made-up list each, for rules that compare lists."""
    return candidates(spark, sf_dir).withColumns({"inci_list": F.concat(F.upper("brand"), F.lit(";"), (F.col("row_index") % 5).cast("string")), "candidate_id": F.lit(None).cast("string")})


_dup = f"{_light}, {_conflicts('r')} SELECT * FROM clash"


@registered("duplicate_conflicts", _dup)
def duplicate_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return audit.duplicate_conflicts(_light_rows(spark, sf_dir)).select("row_id", F.col("conflict.row_id").alias("conflicting_row_id"))


@registered("text_cleaning", f"SELECT doc_id, {duck.clean_block('text')} AS block, {duck.strip_label('text')} AS stripped, {duck.lookup_key('text')} AS key FROM documents")
def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, T3, I2."""
    t = F.col("text")
    return spread(load(spark, sf_dir, "documents")).select("doc_id", ingredient_text.clean_block(t).alias("block"), ingredient_text.strip_label(t).alias("stripped"), ingredient_text.lookup_key(t).alias("key"))


_t = strip(text("text"))
_hits = " + ".join(f"(contains(lower({_t}), {q(w)}))::INT" for w in fixed.COMMON_TOKENS)
_code = f"(length({_t}) >= 120 AND regexp_matches({_t}, '^[{{\\[]')) OR regexp_matches({_t}, {q(fixed.CODE_SIGNS)})"
_n = lambda c: f"(length({_t}) - length(replace({_t}, {q(c)}, '')))"
_code = f"({_code} OR ({_n('{')} >= 3 AND {_n('}')} >= 3 AND {_n(':')} >= 4 AND {_n(chr(34))} >= 4))"
_parts = f"len(list_filter(regexp_split_to_array({_t}, '[,;，；]\\s*'), lambda p: {strip('p')} <> ''))"


@registered("text_scores", f"""SELECT doc_id, {_code} AS is_code, CASE WHEN {_t} = '' THEN 0.0 WHEN length({_t}) < 10 THEN 0.1 WHEN length({_t}) > 3000 THEN 0.2 WHEN {_code} THEN 0.05
  ELSE round(least(1.0, CASE WHEN regexp_matches({_t}, '[,;，；]') THEN 0.35 ELSE 0 END + least(0.35, ({_hits}) * 0.08) + CASE WHEN {_parts} >= 5 THEN 0.3 WHEN {_parts} >= 4 THEN 0.25 ELSE 0 END), 6) END::DOUBLE AS score,
  {duck.any_of(f"lower({text('text')})", fixed.COMMON_TOKENS)} OR regexp_matches({text('text')}, {q(fixed.INCI_WORDS)}) AS inci_signal,
  {_t} = '' OR lower({_t}) IN ({', '.join(q(w) for w in fixed.BLANK_WORDS)}) OR {duck.any_of(f'lower({_t})', fixed.NO_SOURCE_PHRASES)} AS invalid FROM documents""")
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T6 to T9."""
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", ingredient_text.is_script_or_json(t).alias("is_code"), ingredient_text.ingredient_score(t).alias("score"), ingredient_text.has_inci_signal(t).alias("inci_signal"), ingredient_text.is_invalid_blob(t).alias("invalid"))


_h = "replace(html, chr(160), ' ')"
for _pat, _by in ((r"(?i)<br\s*/?>", "\n"), (r"(?i)</p\s*>", "\n"), (r"(?i)</div\s*>", "\n"), (r"(?i)</li\s*>", "\n"), (r"(?i)</?[a-z][^>]*>", " ")):
    _h = sub(_h, _pat, _by)
_h = f"replace({_h}, chr(13) || chr(10), chr(10))"
for _pat, _by in ((r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n")):
    _h = sub(_h, _pat, _by)


@registered("page_text", f"SELECT page_id, nullif({strip(_h)}, '') AS said FROM pages")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10."""
    return load(spark, sf_dir, "pages").select("page_id", ingredient_text.html_to_text(F.col("html")).alias("said"))


_query = "trim(trim(brand) || ' ' || trim(product_name)) || CASE WHEN market IN ('CN', 'CHN', 'CHINA') THEN ' 全成分' ELSE ' ingredients list INCI' END"


@registered("search_queries", f"{C}, h AS (SELECT *, {_query} AS query, {_hosts('brand')} AS hosts FROM cand) SELECT row_id, array_to_string(list_concat(list_transform(list_distinct(hosts), lambda x: query || ' site:' || x), [query]), chr(10)) AS queries, CASE WHEN {duck.any_of('lower(' + text('source_ref') + ')', fixed.RETAILERS)} THEN 'Retailer' WHEN {duck.any_of('lower(' + text('source_ref') + ')', fixed.THIRD_PARTIES)} THEN 'ThirdParty' ELSE 'Official' END AS source_class FROM h")
def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, H5, H6."""
    asked = ingredient_text.search_queries(F.col("market"), F.col("brand"), F.col("product_name"), urls.official_hosts(F.col("brand")))
    return candidates(spark, sf_dir).select("row_id", F.array_join(asked, "\n").alias("queries"), urls.source_class(F.col("source_ref")).alias("source_class"))


_base = "'https://' || " + duck.host("url")
_kinds = f"""SELECT page_id, {duck.canonical('url')} AS canonical, {duck.url_like('url')} AS normalized, {duck.host('url')} AS host, {duck.url_score('url', 'url')} AS score, coalesce({duck.url_score('url', 'url')} >= 4, false) AS is_product,
  nullif(regexp_extract({duck.path('url')}, '(?i)^/collections/([^/]+)', 1), '') AS collection, {duck.tokens('url')} AS toks FROM pages"""


@registered("page_urls", f"SELECT * EXCLUDE (toks), array_to_string(list_sort(toks), ' ') AS tokens FROM ({_kinds})")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2, O7, U2, U3, U13."""
    u = F.col("url")
    return load(spark, sf_dir, "pages").select("page_id", urls.canonical_url(u).alias("canonical"), urls.normalize_url_like(u).alias("normalized"), urls.host(u).alias("host"), urls.product_url_score(u, u).alias("score"), urls.is_product_url(u, u).alias("is_product"), urls.parse_target(u)["collection"].alias("collection"), F.array_join(F.array_sort(urls.match_tokens(u)), " ").alias("tokens"))


O = f"WITH o AS ({OFFERS})"
_nums = f"list_filter(list_transform(regexp_extract_all(price_display_raw, '[0-9][0-9.,\\s'']*'), lambda t: {duck.number('t')}), lambda v: v IS NOT NULL)"
_cur = "CASE market_id WHEN 'US' THEN 'USD' WHEN 'EU-DE' THEN 'EUR' WHEN 'SG' THEN 'SGD' WHEN 'JP' THEN 'JPY' END"
_sym = f"CASE WHEN contains(price_display_raw, '€') THEN 'EUR' WHEN contains(price_display_raw, '£') THEN 'GBP' WHEN contains(price_display_raw, '$') THEN {_cur} WHEN contains(price_display_raw, '¥') AND market_id = 'JP' THEN 'JPY' END"
_code3 = "CASE WHEN regexp_matches(upper(trim(structured_currency)), '^[A-Z]{3}$') THEN upper(trim(structured_currency)) END"
_offers_sql = f"""{O}, n AS (SELECT *, {_nums} AS n, regexp_matches(price_display_raw, '(?i)\\bto\\b|[-–—~]') AS rng, coalesce({_code3}, {_sym}) AS price_currency FROM o),
norm AS (SELECT *, CASE WHEN len(n) >= 2 AND rng THEN list_min(n) ELSE n[1] END AS price_amount, CASE WHEN price_display_raw = '' THEN 'unknown' WHEN len(n) >= 2 AND rng THEN 'range' WHEN regexp_matches(price_display_raw, '(?i)\\bfrom\\b') THEN 'from' WHEN regexp_matches(price_display_raw, '(?i)\\bmember\\b') THEN 'member'
  WHEN regexp_matches(price_display_raw, '(?i)\\bsale\\b|\\bdiscount\\b|\\bnow\\b') THEN 'sale' WHEN len(n) > 0 THEN 'list' ELSE 'unknown' END AS price_type, CASE WHEN len(n) >= 2 AND rng THEN list_min(n) END AS range_min, CASE WHEN len(n) >= 2 AND rng THEN list_max(n) END AS range_max,
  CASE WHEN {_code3} IS NOT NULL THEN 'high' ELSE 'low' END AS currency_confidence, CASE WHEN coalesce(price_currency, '') = '' THEN 'unknown' WHEN price_currency = {_cur} THEN 'ok' ELSE 'mismatch' END AS market_switch_status,
  CASE WHEN raw_availability = '' THEN NULL WHEN regexp_matches(raw_availability, '(?i)InStock') THEN 'in_stock' ELSE 'out_of_stock' END AS availability,
  source_site || ':' || CASE WHEN coalesce(trim(site_product_id), '') <> '' THEN trim(site_product_id) WHEN variant_sku <> '' THEN sha1(url_canonical)[1:12] || ':' || sha1(variant_sku)[1:12] ELSE sha1(url_canonical)[1:12] END AS source_product_id FROM n)
"""


def normalized_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers.normalized(view(spark, sf_dir, OFFERS))


@registered("offers_normalized", _offers_sql + "SELECT offer_id, source_product_id, price_amount, price_type, range_min, range_max, price_currency, currency_confidence, market_switch_status, availability FROM norm")
def offers_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1 to O6."""
    return normalized_offers(spark, sf_dir).select("offer_id", "source_product_id", "price_amount", "price_type", "range_min", "range_max", "price_currency", "currency_confidence", "market_switch_status", "availability")


_rate = lambda c: f"round(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 4)"


@registered("site_market_counters", f"""{_offers_sql}, g AS (SELECT source_site, market_id, count(*) AS total, {_rate(f'price_currency = {_cur}')} AS native_currency_rate, {_rate('price_amount IS NOT NULL')} AS price_parse_rate, {_rate("currency_confidence = 'low'")} AS low_confidence_rate, {_rate("market_switch_status IN ('mismatch', 'failed')")} AS switch_fail_rate FROM norm GROUP BY ALL),
a AS (SELECT source_site, market_id FROM (SELECT DISTINCT source_site FROM norm) CROSS JOIN (VALUES ('US'), ('EU-DE'), ('SG'), ('JP')) v(market_id))
SELECT source_site, market_id, coalesce(total, 0) AS total, coalesce(native_currency_rate, 0.0)::DOUBLE AS native_currency_rate, coalesce(price_parse_rate, 0.0)::DOUBLE AS price_parse_rate, coalesce(low_confidence_rate, 0.0)::DOUBLE AS low_confidence_rate, coalesce(switch_fail_rate, 0.0)::DOUBLE AS switch_fail_rate FROM g FULL JOIN a USING (source_site, market_id)""")
def site_market_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O12."""
    return offers.site_market_counters(normalized_offers(spark, sf_dir))


@registered("market_expansion", "SELECT p_partkey, m.market_id, m.country, m.currency_target, 'https://shop.example.com/products/' || cast(p_partkey AS string) || '?country=' || m.country || '&locale=' || m.locale || '&currency=' || m.currency_target || CASE WHEN m.market_id = 'JP' THEN '&shipping_destination=JP' ELSE '' END AS market_url FROM part CROSS JOIN (VALUES ('US', 'US', 'USD', 'en-US'), ('EU-DE', 'DE', 'EUR', 'de-DE'), ('SG', 'SG', 'SGD', 'en-SG'), ('JP', 'JP', 'JPY', 'ja-JP')) m(market_id, country, currency_target, locale)")
def market_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O13, P11."""
    products = spread(load(spark, sf_dir, "part")).select("p_partkey", F.concat(F.lit("https://shop.example.com/products/"), F.col("p_partkey").cast("string")).alias("url_canonical"))
    return offers.expanded(products).select("p_partkey", "market_id", "country", "currency_target", "market_url")


V = f"WITH v AS ({VARIANTS}), f AS (SELECT *, CASE WHEN regexp_matches(raw_price, '^-?[0-9]+$') AND currency <> 'JPY' THEN printf('%.2f', raw_price::DOUBLE / 100) ELSE raw_price END AS price, CASE WHEN NOT available THEN 'Out of Stock' WHEN quantity > 0 AND quantity <= 10 THEN 'Low Stock' ELSE 'In Stock' END AS stock FROM v)"


@registered("catalog_variants", V + " SELECT pos, price, stock, product_url || '?variant=' || id || '&utm_source=larkspur&utm_medium=affiliate' AS deep_link FROM f")
def catalog_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2, C3, C6, P8."""
    return catalog.flattened(view(spark, sf_dir, VARIANTS)).select("pos", "price", "stock", "deep_link")


_link = "product_url || '?variant=' || id || '&utm_source=larkspur&utm_medium=affiliate'"


def _pictured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with an image each, and some with a description."""
    v = catalog.flattened(view(spark, sf_dir, VARIANTS))
    return v.withColumns({"image_urls": F.array(F.concat(F.lit("https://i/"), (F.col("pos") % 3).cast("string"))), "description": F.when(F.col("pos") % 5 == 0, F.concat(F.lit("d"), F.col("pos").cast("string")))})


@registered("catalog_rollup", V + f""", g AS (SELECT product_url, count(*) AS n_variants, min(price::DOUBLE) AS v_min, max(price::DOUBLE) AS v_max, arg_min(currency, pos) AS currency, array_to_string(list_sort(list(DISTINCT stock)), ' | ') AS stocks, arg_min(product_title, pos) AS v_title, arg_min('d' || pos, pos) FILTER (pos % 5 = 0) AS description, arg_min({_link}, pos) AS deep_link FROM f GROUP BY product_url),
i AS (SELECT product_url, string_agg('https://i/' || m, ' | ' ORDER BY first_at) AS images FROM (SELECT product_url, pos % 3 AS m, min(pos) AS first_at FROM f GROUP BY ALL) GROUP BY product_url),
p AS (SELECT 'https://shop.example.com/products/' || cast(p_partkey AS string) AS product_url, p_name AS title, p_retailprice AS price FROM part)
SELECT product_url, coalesce(title, v_title) AS title, coalesce(n_variants, 0) AS n_variants, least(v_min, price) AS min_price, greatest(v_max, price) AS max_price, coalesce(currency, 'USD') AS currency, coalesce(stocks, '') AS stocks,
  CASE WHEN title IS NULL THEN images WHEN images IS NULL THEN 'https://i/main' ELSE 'https://i/main | ' || images END AS images, coalesce(description, '') AS description, coalesce(deep_link, '') AS deep_link FROM p FULL JOIN g USING (product_url) LEFT JOIN i USING (product_url)""")
def catalog_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7."""
    products = load(spark, sf_dir, "part").select(F.concat(F.lit("https://shop.example.com/products/"), F.col("p_partkey").cast("string")).alias("product_url"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"), F.array(F.lit("https://i/main")).alias("image_urls"))
    return catalog.product_rollup(products, _pictured(spark, sf_dir))


@registered("export_products", V + """, g AS (SELECT product_url, count(*) AS n, min(price::DOUBLE) AS lo, max(price::DOUBLE) AS hi FROM f GROUP BY product_url), p AS (SELECT 'https://shop.example.com/products/' || cast(p_partkey AS string) AS product_url, p_name AS title, p_retailprice AS price FROM part)
SELECT product_url, title, coalesce(n, 0) AS n_variants, printf('%.2f', least(lo, price)) AS min_price, printf('%.2f', greatest(hi, price)) AS max_price FROM p LEFT JOIN g USING (product_url)""")
def export_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as texts of two decimals."""
    return rows.products_export(catalog_rollup(spark, sf_dir)).select("product_url", "title", "n_variants", "min_price", "max_price")


@registered("catalog_pricing", V + " SELECT arg_min(currency, pos) AS currency, min(price::DOUBLE) AS min_price, max(price::DOUBLE) AS max_price, round(avg(price::DOUBLE), 2) AS avg_price FROM f")
def catalog_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8."""
    return catalog.pricing_stats(catalog.flattened(view(spark, sf_dir, VARIANTS)))


@registered("catalog_by_title", V + ", d AS (SELECT *, row_number() OVER (PARTITION BY product_title, id, sku, product_url ORDER BY pos) AS k FROM f), s AS (SELECT product_title, sku, min(pos) AS first_at FROM d WHERE k = 1 GROUP BY ALL), j AS (SELECT product_title, string_agg(sku, ',' ORDER BY first_at, sku) AS skus FROM s GROUP BY ALL), i AS (SELECT product_title, string_agg('https://i/' || m, ' ' ORDER BY first_at) AS images FROM (SELECT product_title, pos % 3 AS m, min(pos) AS first_at FROM d WHERE k = 1 GROUP BY ALL) GROUP BY ALL) SELECT product_title, first(product_url ORDER BY pos, product_url) AS product_url, count(*) AS n_variants, first(skus) AS skus, first(images) AS images FROM d JOIN j USING (product_title) JOIN i USING (product_title) WHERE k = 1 GROUP BY product_title")
def catalog_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5."""
    return catalog.merged_by_title(_pictured(spark, sf_dir))


@registered("catalog_batches", f"WITH v AS ({VARIANTS}), b AS (SELECT *, CASE WHEN pos % 3 = 0 THEN 0 ELSE 1 END AS batch FROM v WHERE pos % 3 < 2 UNION ALL SELECT *, 2 FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY id, sku ORDER BY batch, pos) AS k FROM b) SELECT id, sku, batch, pos FROM k WHERE k = 1")
def catalog_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9."""
    v = view(spark, sf_dir, VARIANTS)
    return catalog.merged_batches([v.filter("pos % 3 = 0"), v.filter("pos % 3 = 1"), v]).select("id", "sku", F.col("batch").cast("long").alias("batch"), "pos")


@registered("catalog_merged_pricing", V + ", b AS (SELECT *, CASE WHEN pos % 3 = 0 THEN 0 ELSE 1 END AS batch, CASE WHEN pos % 3 = 1 THEN price::DOUBLE / 2 ELSE price::DOUBLE END AS paid FROM f WHERE pos % 3 < 2 UNION ALL SELECT *, 2, price::DOUBLE FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY id, sku ORDER BY batch, pos) AS k FROM b) SELECT arg_min(currency, (batch, pos)) AS currency, min(paid) AS min_price, max(paid) AS max_price, round(avg(paid), 2) AS avg_price FROM k WHERE k = 1")
def catalog_merged_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pricing of three batches' variants after they are merged; the second batch has half the prices."""
    v = catalog.flattened(view(spark, sf_dir, VARIANTS)).withColumn("price", F.col("price").cast("double"))
    return catalog.merged_pricing([v.filter("pos % 3 = 0"), v.filter("pos % 3 = 1").withColumn("price", F.col("price") / 2), v])


_ti = "p_type || CASE WHEN p_size % 3 = 0 THEN ' - ' || p_brand WHEN p_size % 3 = 1 THEN ' | x: y' ELSE '' END"


@registered("catalog_title_split", f"WITH t AS (SELECT p_partkey, p_brand, {_ti} AS title FROM part), s AS (SELECT *, CASE WHEN contains(title, ' - ') THEN split_part(title, ' - ', 1) WHEN contains(title, ' | ') THEN split_part(title, ' | ', 1) END AS b, CASE WHEN contains(title, ' - ') THEN title[position(' - ' IN title) + 3:] WHEN contains(title, ' | ') THEN title[position(' | ' IN title) + 3:] END AS l FROM t), u AS (SELECT *, b IS NOT NULL AND p_partkey % 4 > 0 AS fits FROM s), w AS (SELECT *, avg(CASE WHEN fits THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY p_brand) >= 0.2 AS on_ FROM u) SELECT p_partkey, CASE WHEN on_ AND fits THEN b ELSE title END AS base_title, CASE WHEN on_ AND fits THEN l END AS variant_label FROM w")
def catalog_title_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4."""
    products = load(spark, sf_dir, "part").select("p_partkey", "p_brand", F.expr(_ti).alias("title"))
    return catalog.title_variants(products, "p_brand", single=F.col("p_partkey") % 4 > 0).select("p_partkey", "base_title", "variant_label")


_done = ["OK", "PENDING", "NEEDS_SOURCE", "SKIPPED", "ERROR"]


@registered("task_progress", f"WITH t AS ({TASK_ROWS}), g AS (SELECT task_id, count(*) AS total, " + ", ".join(f"count_if(status = '{s}') AS {s.lower()}" for s in _done) + " FROM t GROUP BY task_id) SELECT *, ok + pending + needs_source + skipped + error AS done, CASE WHEN ok + pending + needs_source + skipped + error = total THEN 'COMPLETED' ELSE 'RUNNING' END AS task_status FROM g")
def task_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9."""
    return rows.task_progress(view(spark, sf_dir, TASK_ROWS))


@registered("list_rows", f"{C}, m AS (SELECT * FROM cand WHERE import_id = '1' AND review_status = 'APPROVED' AND (contains(lower(brand), 'src1') OR contains(lower(product_name), 'src1') OR contains(sku_key, 'src1'))) SELECT row_id, row_index, (SELECT count(*) FROM m) AS total FROM m ORDER BY row_index LIMIT 20 OFFSET 2")
def list_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1."""
    return rows.listed(candidates(spark, sf_dir), "1", "SRC1", 20, 2, review_status="APPROVED").select("row_id", "row_index", "total")


@registered("candidate_import", f"{C}, s AS (SELECT *, {strip('brand')} AS b, {strip('product_name')} AS p, {duck.url_like('source_ref')} AS u, {strip(text('raw_ingredient_text'))} AS t FROM cand) SELECT row_index, b AS brand, p AS product_name, market, sku_key, CASE WHEN u <> '' THEN u ELSE {strip('source_ref')} END AS source_ref, status, CASE WHEN t <> '' AND lower(t) NOT IN ({', '.join(q(w) for w in fixed.BLANK_WORDS)}) THEN 1.0::DOUBLE END AS confidence FROM s WHERE b <> '' AND p <> '' AND market <> ''")
def candidate_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1, with aliased columns."""
    raw = candidates(spark, sf_dir).withColumnsRenamed({"brand": "Brand_EN", "product_name": "Product", "market": "country", "source_ref": "URL", "raw_ingredient_text": "Ingredients", "sku_key": "SKU"})
    return rows.candidates(raw).select("row_index", "brand", "product_name", "market", "sku_key", "source_ref", "status", "confidence")


_kb_said = f"'brand:' || {strip('brand')} || CASE WHEN {strip('product_name')} <> '' THEN ' | product:' || {strip('product_name')} ELSE '' END || ' | market:' || market || CASE WHEN inci_list <> '' THEN ' | inci:' || {strip('inci_list')} ELSE ' | ingredients:' || {strip('cleaned')} END"


@registered("kb_rows", _audit_sql + f", g AS (SELECT *, CASE WHEN row_index % 3 = 0 THEN '' ELSE inci_list END AS inci FROM audit) SELECT row_id AS sku_key, {_kb_said.replace('inci_list', 'inci')} AS kb_text FROM g WHERE parse_status = 'OK' AND review_status = 'APPROVED' AND audit_status = 'FAIL' AND row_index % 2 = 0 AND ({strip('inci')} <> '' OR {strip('cleaned')} <> '')")
def kb_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3, P6, K4, keyed by row, with all gates on (the audit's takes those that failed: none passes in these tables); every third row has no list."""
    rows_ = audited(spark, sf_dir).drop("sku_key").withColumns({"ingest_allowed": F.col("row_index") % 2 == 0, "inci_list": F.when(F.col("row_index") % 3 == 0, "").otherwise(F.col("inci_list"))})
    return kb.kb_rows(rows_, audit="FAIL").select("sku_key", "kb_text")


_slots = """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9]+(?:[-_''][A-Za-z0-9]+)*|[\\x{4e00}-\\x{9fff}]+')) AS token FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 15))::BIGINT AS n FROM w), s AS (SELECT doc_id, (n % 384)::INT AS slot, sum(CASE WHEN n % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v FROM h GROUP BY ALL HAVING sum(CASE WHEN n % 2 = 1 THEN 1 ELSE -1 END) <> 0)
SELECT doc_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 9) AS value FROM s"""


@registered("kb_hash_slots", _slots)
def kb_hash_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2 with the MD5 hash."""
    return kb.slots(load(spark, sf_dir, "documents"), "doc_id", "text", hash="md5").select("doc_id", "slot", F.round("value", 9).alias("value"))


_vector = _slots[: _slots.index("SELECT doc_id, slot, round(")] + """, n AS (SELECT doc_id, slot, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS value FROM s), g AS (SELECT doc_id, k, coalesce(value, 0.0)::FLOAT::DOUBLE AS x FROM (SELECT doc_id, unnest(range(384)) AS k FROM documents) LEFT JOIN n USING (doc_id) WHERE n.slot = k OR n.slot IS NULL)
SELECT doc_id, count(*)::INT AS dims, round(sum(abs(x)), 4) AS total FROM (SELECT d.doc_id, d.k, coalesce(n.value, 0.0)::FLOAT::DOUBLE AS x FROM (SELECT doc_id, unnest(range(384)) AS k FROM documents) d LEFT JOIN n ON n.doc_id = d.doc_id AND n.slot = d.k) GROUP BY doc_id"""
_vector = _vector.replace(", g AS (SELECT doc_id, k, coalesce(value, 0.0)::FLOAT::DOUBLE AS x FROM (SELECT doc_id, unnest(range(384)) AS k FROM documents) LEFT JOIN n USING (doc_id) WHERE n.slot = k OR n.slot IS NULL)", "")


@registered("kb_vectors", _vector)
def kb_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 with the MD5 hash as whole vectors, and K3: the texts of the vectors, read again."""
    made = kb.embedded(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", hash="md5").select("doc_id", kb.vector_text(F.col("embedding")).alias("said"), "embedding")
    numbers = F.split(F.substring("said", 2, 10**6), "[,\\]]")
    exact = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    near = F.aggregate(F.slice(numbers, 1, 384), F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    return made.select("doc_id", (F.size(numbers) - 1).alias("dims"), F.round(F.when(F.abs(exact - near) < 0.001, exact), 4).alias("total"))


@registered("kb_embeddings")
def kb_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 with BLAKE2b, K3."""
    return kb.embedded(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", kb.vector_text(F.col("embedding")).alias("embedding"))


_VECTORS = "SELECT vec_id, embedding, CASE label % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'SG' ELSE 'JP' END AS market, CASE WHEN vec_id % 7 = 0 THEN 'NEEDS_REVIEW' ELSE 'OK' END AS parse_status FROM embeddings"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries: every vector whose id is divisible by 50."""
    return load(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


def _search_sql(where: str) -> str:
    return f"WITH e AS (SELECT *, embedding::DOUBLE[] AS e FROM ({_VECTORS})), p AS (SELECT q.vec_id AS query_id, b.vec_id, round(1 - list_dot_product(b.e, q.e) / (sqrt(list_dot_product(b.e, b.e)) * sqrt(list_dot_product(q.e, q.e))), 9) AS distance FROM e b CROSS JOIN (SELECT * FROM e WHERE vec_id % 50 = 0) q WHERE {where}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance NULLS LAST, vec_id) AS rank FROM p) SELECT query_id, vec_id, rank::INT AS rank, round(distance, 6) + 0.0 AS distance FROM r WHERE rank <= 10"


@registered("kb_search", _search_sql("true"))
def kb_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: a top-10 report for each stated query against all rows."""
    found = kb.search(view(spark, sf_dir, _VECTORS), _asked(spark, sf_dir), "vec_id", parse_status=None)
    return found.withColumn("distance", F.round("distance", 6) + 0.0)


@registered("kb_search_filtered", _search_sql("b.market = 'SG' AND b.parse_status = 'OK'"))
def kb_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6 within a market, and among rows that were parsed well."""
    found = kb.search(view(spark, sf_dir, _VECTORS), _asked(spark, sf_dir), "vec_id", market="SG")
    return found.withColumn("distance", F.round("distance", 6) + 0.0)


@registered("kb_search_cells")
def kb_search_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: the stated queries over cells, with the recall of those that were also searched exactly."""
    return kb.search_cells(view(spark, sf_dir, _VECTORS), _asked(spark, sf_dir), "vec_id")


@registered("kb_upsert", "WITH o AS (SELECT cast(c_custkey AS string) AS sku_key, c_name AS name FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT cast(c_custkey % 200 AS string) AS sku_key, c_name AS name, row_number() OVER (PARTITION BY c_custkey % 200 ORDER BY c_custkey DESC) AS k FROM customer), l AS (SELECT * FROM n WHERE k = 1) SELECT coalesce(l.sku_key, o.sku_key) AS sku_key, CASE WHEN l.sku_key IS NOT NULL THEN l.name ELSE o.name END AS name, CASE WHEN o.sku_key IS NULL THEN 2 ELSE 1 END AS created_at, CASE WHEN l.sku_key IS NULL THEN 1 ELSE 2 END AS updated_at FROM o FULL JOIN l ON o.sku_key = l.sku_key")
def kb_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5."""
    customers = load(spark, sf_dir, "customer")
    old = customers.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("sku_key"), F.col("c_name").alias("name"), F.lit(1).alias("created_at"), F.lit(1).alias("updated_at"))
    new = customers.select((F.col("c_custkey") % 200).cast("string").alias("sku_key"), F.col("c_name").alias("name"), F.col("c_custkey").alias("at"))
    return kb.upserted(old, new, "at", now=F.lit(2))


@registered("url_rules", f"SELECT page_id, coalesce({duck.url_score('url', 'url')} >= 4, false) AS product, regexp_matches(lower(html), {q(fixed.BUY_WORDS)}) AS buy_words, regexp_matches(lower(html), {q(fixed.PRICE_SIGN)}) AND regexp_matches(lower(html), {q(fixed.BUY_WORDS)}) AS product_page FROM pages")
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3, U11 (the driver's pages hold no JSON-LD)."""
    return load(spark, sf_dir, "pages").select("page_id", urls.is_product_url(F.col("url"), F.col("url")).alias("product"), F.lower("html").rlike(fixed.BUY_WORDS).alias("buy_words"), urls.looks_like_product_page(F.col("html")).alias("product_page"))
