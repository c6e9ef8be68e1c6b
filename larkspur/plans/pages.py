"""Queries on pages: links, discovery, structured data, harvest and images, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import sources
from larkspur.functions import fixed, ingredient_text, prices, urls
from larkspur.operators import catalog, discovery, harvest, offers, structured
from larkspur.plans import duck
from larkspur.plans.base import registered
from larkspur.plans.duck import q, strip, text
from larkspur.plans.registry import C, PARSE, candidates, parsed
from larkspur.plans.views import PRODUCT_PAGES, load, view
from larkspur.scratch import scratch_path, stored

_LINKS = """WITH a AS (SELECT page_id, url, unnest(range(len(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["''][^"'']*["''][^>]*>.*?</a>')))) AS pos, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["''][^"'']*["''][^>]*>.*?</a>')) AS tag FROM pages),
b AS (SELECT *, trim(regexp_extract(tag, '(?is)href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS raw, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(tag, '(?is)^<a[^>]*>(.*?)</a>', 1), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS said FROM a),
l AS (SELECT page_id, url, pos, said, CASE WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN raw WHEN starts_with(raw, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || raw ELSE regexp_extract(url, '^[a-z]+://[^/?#]*') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') || raw END AS href FROM b WHERE raw <> '' AND NOT regexp_matches(raw, '(?i)^(#|mailto:|tel:|javascript:)'))
"""
_add = lambda pattern, n: f"CASE WHEN regexp_matches(lower(said), {duck.q(pattern)}) THEN {n} ELSE 0 END"
LINKS_SQL = _LINKS + f"SELECT page_id, pos::INT AS pos, href, said, {duck.url_score('href', 'url')} + {_add(fixed.PRICE_SIGN, 3)} + {_add('(?i)add to cart|buy now|quick shop|learn more|shop now|details', 2)} + {_add('(?i)in stock|out of stock|shade|size', 1)} AS score FROM l"


@registered("page_links", LINKS_SQL)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1, U6."""
    links = discovery.links(load(spark, sf_dir, "pages"))
    return links.select("page_id", "pos", "href", "said", urls.context_score(F.col("href"), F.col("url"), F.col("said")).alias("score"))


_SHOPS = """SELECT p_partkey AS page_id, 'https://shop' || cast(p_partkey % 9 AS string) || '.example.com/list' AS url, CASE p_partkey % 3
  WHEN 0 THEN '<a href="/products/x' || cast(p_partkey AS string) || '?utm_medium=a">x</a><a href="/products/x' || cast(p_partkey AS string) || '">again</a><a href="mailto:a">m</a><a href="https://other.example.org/products/y">y</a><a href="/collections/all">all</a><a href="/p/q-' || cast(p_partkey AS string) || '">q</a>'
  WHEN 1 THEN '<a href="/about">about</a><script>var a = ["/products/s' || cast(p_partkey AS string) || '", "https://shop' || cast(p_partkey % 9 AS string) || '.example.com/the-long-rose-cream", "/img/products/z.png"]</script>' ELSE '<a href="/about">about</a>' END AS html FROM part"""
_no_fall = _LINKS.replace("FROM pages", "FROM shops").replace("WITH a AS", f"WITH shops AS ({_SHOPS}), a AS") + f", s AS (SELECT page_id, {duck.canonical('href')} AS href, {duck.url_score('href', 'url')} AS score FROM l), g AS (SELECT page_id, href, max(score) AS score FROM s WHERE score >= 4 GROUP BY ALL)"
_raw = "unnest(regexp_extract_all(html, '[\"''](https?://[^\"''\\s<>]+|/[^\"''\\s<>]+)[\"'']', 1))"
_fall = _no_fall + f""", t AS (SELECT page_id, url, {_raw} AS raw FROM shops WHERE page_id NOT IN (SELECT page_id FROM g)),
f AS (SELECT page_id, url, CASE WHEN starts_with(raw, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || raw ELSE raw END AS href FROM t),
h AS (SELECT page_id, {duck.canonical('href')} AS href, max({duck.url_score('href', 'url')}) AS score FROM f WHERE {duck.url_score('href', 'url')} >= 4 GROUP BY ALL), u AS (SELECT * FROM g UNION ALL SELECT * FROM h)
SELECT page_id, href, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, href)::INT AS rank FROM u"""


@registered("product_links", _fall)
def product_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U5, with the fallback for pages whose product URLs stand in scripts only."""
    return discovery.product_links(view(spark, sf_dir, _SHOPS, even=True))


_cat_last = f"coalesce(list_filter(string_split({duck.path('url')}, '/'), lambda s: s <> '')[-1], '')"
_cat = f"SELECT page_id, regexp_matches(url, '(?i)^https?://[^/?#]+') AND NOT regexp_matches({duck.path('url')}, {q(fixed.STATIC_FILE)}) AND NOT regexp_matches({duck.path('url')}, {q(fixed.NEGATIVE_PATH)}) AND NOT coalesce({duck.url_score('url', 'url')} >= 4, false) AND len(list_filter(string_split({duck.path('url')}, '/'), lambda s: s <> '')) BETWEEN 1 AND 2 AND NOT (length({_cat_last}) - length(replace({_cat_last}, '-', '')) >= 3 AND regexp_matches({_cat_last}, '(?i)^the-')) AS category"
_seed_own = f"regexp_extract({duck.path('url')}, '^/([^/]+)', 1)"
_seed = f"CASE WHEN regexp_matches({_seed_own}, '(?i)^[a-z]{{2}}[-_][a-z]{{2}}$') AND split_part(lower({_seed_own}), '-', 1) <> 'en' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || '/en-us' || regexp_replace({duck.path('url')}, '^/[^/]+', '') || regexp_extract(url, '[?#].*$') ELSE url END"


@registered("url_classes", f"WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT -k, url FROM ({PRODUCT_PAGES})) {_cat}, {_seed} AS seed FROM u")
def url_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4, U9."""
    both = load(spark, sf_dir, "pages").select("page_id", "url").union(view(spark, sf_dir, PRODUCT_PAGES, even=True).select((-F.col("k")).alias("page_id"), "url"))
    return both.select("page_id", urls.is_category_url(F.col("url"), F.col("url")).alias("category"), urls.market_seed_url(F.col("url"), F.lit("US")).alias("seed"))


_ROBOTS = "SELECT s_suppkey AS k, 'https://s' || cast(s_suppkey AS string) || '.example.com' AS site, CASE WHEN s_suppkey % 3 = 0 THEN 'User-agent: *' || chr(10) || 'Sitemap: https://s' || cast(s_suppkey AS string) || '.example.com/index.xml' ELSE 'User-agent: *' END AS robots FROM supplier"
_cdata = "'<url><loc><![CDATA[' || site || '/products/a&amp;b]]></loc></url>'"
_FETCHED = f"""SELECT site || '/index.xml' AS url, '<?xml version="1.0"?><sitemapindex><sitemap><loc>' || site || '/deep.xml</loc></sitemap><sitemap><loc>' || site || '/gone.xml</loc></sitemap></sitemapindex>' AS body FROM ({_ROBOTS}) WHERE k % 3 = 0
UNION ALL SELECT site || '/deep.xml', '<urlset>' || {_cdata} || '<url><loc> ' || site || '/products/deep </loc></url><url><loc>' || site || '/blog/x</loc></url></urlset>' FROM ({_ROBOTS}) WHERE k % 3 = 0
UNION ALL SELECT site || '/sitemap.xml', '<urlset><url><loc>' || site || '/products/one</loc></url><url><loc>' || site || '/about</loc></url><url><loc>' || site || '/products/deep</loc></url></urlset>' FROM ({_ROBOTS}) WHERE k % 3 < 2
UNION ALL SELECT site || '/sitemap.xml', 'not found' FROM ({_ROBOTS}) WHERE k % 3 = 2"""


@registered("sitemap_files", f"SELECT url, contains(body, '<sitemapindex') AS is_index, NOT contains(body, 'not found') AS is_xml, CASE WHEN contains(body, 'not found') THEN 0 WHEN contains(body, '<sitemapindex') THEN 2 ELSE 3 END::INT - (CASE WHEN ends_with(url, '/x') THEN 1 ELSE 0 END)::INT AS n_locs FROM ({_FETCHED})")
def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8."""
    body = F.col("body")
    return view(spark, sf_dir, _FETCHED).select("url", discovery.is_sitemap_index(body).alias("is_index"), discovery.is_xml(body, F.lit("text/html")).alias("is_xml"), F.size(discovery.sitemap_locs(body)).alias("n_locs"))


_SELECTORS = """SELECT c_custkey AS page_id, 'https://www.brand' || cast(c_custkey AS string) || '.com/' AS url, CASE WHEN c_custkey % 4 = 0 THEN '<h1>Choose your country</h1>' ELSE '' END || '<a href="https://us.brand' || cast(c_custkey AS string) || '.com/">United States</a><a href="https://de.brand' || cast(c_custkey AS string) || '.com/">Deutschland</a>' ||
  CASE WHEN c_custkey % 4 = 1 THEN '<a href="/jp">Japan</a><a href="/sg/">Singapore</a>' ELSE '' END || '<a href="https://other.com/us">United States USA us</a><a href="/us/usa.png">us</a>' AS html, c_custkey % 4 AS kind FROM customer"""


@registered("storefronts", f"SELECT page_id, 'https://us.brand' || cast(page_id AS string) || '.com/' AS href FROM ({_SELECTORS}) WHERE kind IN (0, 1)")
def storefronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8: pages that ask for the country, in words or by four links of the brand."""
    return discovery.storefront(view(spark, sf_dir, _SELECTORS, even=True), "US")


_FETCHES = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 403 WHEN 1 THEN 503 WHEN 2 THEN 200 WHEN 3 THEN 429 ELSE 401 END AS status, event_id % 3 AS h, CASE event_id % 4 WHEN 0 THEN 'Just a moment...' WHEN 1 THEN 'Access denied: reference #1' WHEN 2 THEN 'press & hold' ELSE 'captcha for ' || event_type END AS body FROM events"""


@registered("block_providers", f"SELECT event_id, CASE WHEN contains(lower(body), 'just a moment') OR (status IN (401, 403, 429, 503) AND h = 0 AND contains(body, 'captcha')) THEN 'cloudflare' WHEN status IN (401, 403, 429, 503) AND h = 1 AND contains(lower(body), 'access denied') THEN 'akamai' WHEN contains(body, 'press & hold') THEN 'perimeterx' WHEN status IN (401, 403, 429) AND contains(body, 'captcha') THEN 'unknown' END AS provider FROM ({_FETCHES})")
def block_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U10."""
    headers = F.when(F.col("h") == 0, F.create_map(F.lit("cf-ray"), F.lit("abc"))).when(F.col("h") == 1, F.create_map(F.lit("server"), F.lit("AkamaiGHost"))).otherwise(F.create_map(F.lit("server"), F.lit("nginx")))
    return view(spark, sf_dir, _FETCHES).select("event_id", urls.block_provider(F.col("status"), headers, F.lit(""), F.col("body")).alias("provider"))


_blocked = "regexp_matches(lower(html), 'just a moment|performing security verification|attention required|verify you are human|ray id|challenge-platform|please enable javascript and cookies|_abck|bm_sz|ak_bmsc|press & hold|human verification')"
_same_brand = "regexp_extract(regexp_extract(href, '^[a-z]+://([^/?#]*)', 1), '([^.]+)\\.[^.]+$', 1) = regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '([^.]+)\\.[^.]+$', 1)"
_hosts = f"SELECT DISTINCT 'https://' || {duck.host('url')} AS site, {duck.host('url')} AS host FROM pages"


@registered("crawl_report", _LINKS + f""", n AS (SELECT page_id, count(*) FILTER ({_same_brand} AND NOT regexp_matches({duck.path('href')}, {q(fixed.STATIC_FILE)})) AS own, bool_or(coalesce({duck.url_score('href', 'url')} >= 4, false)) AS linked FROM l GROUP BY page_id),
e AS (SELECT {duck.host('url')} AS site, coalesce({duck.url_score('url', 'url')} >= 4, false) AS product, coalesce(linked, false) AS linked, {_blocked} AS blocked, regexp_matches(html, {q(discovery.SELECTOR_PHRASE)}) OR coalesce(own >= 4, false) AS selector FROM pages LEFT JOIN n USING (page_id)),
s AS (SELECT site, bool_or(product) AS seed, bool_or(linked AND NOT product) AS links, bool_or(blocked) AS blocked, bool_or(selector) AS selector, length(site) % 3 = 0 AS mapped, length(site) % 3 > 0 AS dead, count(*) AS n_pages FROM e GROUP BY site),
o AS (SELECT *, CASE WHEN seed THEN 'seed_page' WHEN mapped THEN 'sitemap' WHEN links THEN 'links' ELSE 'none' END AS strategy FROM s),
f AS (SELECT *, CASE WHEN strategy <> 'none' THEN 'product_schema_missing' WHEN blocked THEN 'bot_challenge' WHEN selector THEN 'non_storefront_root' WHEN dead THEN 'dead_sitemap' ELSE 'no_product_urls' END AS failure FROM o),
g AS (SELECT strategy, failure, count(*) AS n_sites, sum(n_pages)::BIGINT AS n_pages FROM f GROUP BY ALL) SELECT *, round(n_sites / sum(n_sites) OVER (), 4) AS share FROM g""")
def crawl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U12, U14; every third site has a sitemap that lists a product, the others' can't be read."""
    pages = load(spark, sf_dir, "pages")
    sites = pages.select(F.concat(F.lit("https://"), urls.host(F.col("url"))).alias("site")).distinct().withColumn("robots", F.lit(""))
    fetched = sites.select(F.concat("site", F.lit("/sitemap.xml")).alias("url"), F.when((F.length("site") - 8) % 3 == 0, F.concat(F.lit("<urlset><url><loc>"), "site", F.lit("/products/x</loc></url></urlset>"))).otherwise("gone").alias("body"))
    return discovery.crawl_report(discovery.outcomes(discovery.page_events(pages), discovery.sitemap_events(sites, fetched)))


P = f"WITH p AS ({PRODUCT_PAGES})"


@registered("jsonld_objects", P + " SELECT page_id, unnest(CASE kind WHEN 2 THEN ['w', p_name] WHEN 3 THEN [] WHEN 5 THEN ['o'] ELSE [p_name] END) AS name, unnest(CASE kind WHEN 2 THEN [false, true] WHEN 3 THEN [] WHEN 0 THEN [true] WHEN 4 THEN [true] ELSE [false] END) AS is_product FROM p")
def jsonld_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O8."""
    return structured.jsonld(view(spark, sf_dir, PRODUCT_PAGES, even=True).select("page_id", "url", "html")).select("page_id", F.try_variant_get("v", "$.name", "string").alias("name"), structured.is_type("Product").alias("is_product"))


_home = "'https://shop.example.com/products/' || k"
_meta = "CASE WHEN page_id % 2 = 0 THEN 'EUR' END"


@registered("page_offers", P + f""", o AS (
SELECT page_id, 0 AS n, {_home} AS url_canonical, p_name AS product_title, 'S' || k AS variant_sku, price + 0.5 AS price_amount, 'USD' AS price_currency, 'high' AS currency_confidence, 'out_of_stock' AS availability, 'S' || k AS own FROM p WHERE kind = 0
UNION ALL SELECT page_id, 0, {_home} || '?variant=1', p_name, 'A' || k, price, 'SGD', 'high', NULL, 'A' || k FROM p WHERE kind = 1
UNION ALL SELECT page_id, 1, 'https://shop.example.com/products/b', p_name, 'B' || k, price + 1, {_meta}, CASE WHEN {_meta} IS NULL THEN 'low' ELSE 'medium' END, NULL, 'A' || k FROM p WHERE kind = 1
UNION ALL SELECT page_id, 0, {_home}, p_name, 'M1', price, 'JPY', 'high', NULL, NULL FROM p WHERE kind = 2
UNION ALL SELECT page_id, 1, {_home}, p_name, 'Z', price + 0.99, coalesce({_meta}, 'USD'), CASE WHEN {_meta} IS NULL THEN 'low' ELSE 'medium' END, NULL, NULL FROM p WHERE kind = 2
UNION ALL SELECT page_id, 0, {_home}, p_name, NULL, price + 0.99, coalesce({_meta}, 'USD'), CASE WHEN {_meta} IS NULL THEN 'low' ELSE 'medium' END, NULL, NULL FROM p WHERE kind IN (3, 4))
SELECT page_id, n::INT AS n, url_canonical, product_title, 'About ' || p_brand AS product_description, variant_sku, price_amount::DOUBLE AS price_amount, price_currency, currency_confidence, availability,
  'shop:' || coalesce(o.own, sha1({_home})[1:12] || ':' || sha1(coalesce(variant_sku, product_title))[1:12]) AS source_product_id FROM o JOIN p USING (page_id)""")
def page_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O9, O2 in all its confidences: variants of a group, offers of a product, visible prices."""
    found = structured.page_offers(view(spark, sf_dir, PRODUCT_PAGES, even=True).select("page_id", "url", "html"), "shop", "US")
    return found.select("page_id", F.col("n").cast("int").alias("n"), "url_canonical", "product_title", "product_description", "variant_sku", "price_amount", "price_currency", "currency_confidence", "availability", "source_product_id")


@registered("currency_hints", P + " SELECT page_id, CASE WHEN kind = 0 THEN 'USD' WHEN kind = 1 THEN 'SGD' WHEN kind = 2 THEN 'JPY' WHEN page_id % 2 = 0 THEN 'EUR' ELSE 'GBP' END AS hint, CASE WHEN kind = 0 THEN 'USD' WHEN kind = 1 THEN 'SGD' WHEN kind = 2 THEN 'JPY' WHEN page_id % 2 = 0 THEN 'EUR' ELSE 'GBP' END AS shop_hint FROM p")
def currency_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O11, both lists of patterns."""
    h = F.col("html")
    return view(spark, sf_dir, PRODUCT_PAGES, even=True).select("page_id", prices.currency_hint(h).alias("hint"), prices.currency_hint(h, prices.SHOP_CURRENCY_PATTERNS).alias("shop_hint"))


@registered("best_objects", P + " SELECT page_id, p_name AS name, CASE kind WHEN 0 THEN 210 ELSE 0 END::INT AS url_match FROM p WHERE kind IN (0, 1, 2, 4)")
def best_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12."""
    found = structured.best_object(view(spark, sf_dir, PRODUCT_PAGES, even=True).select("page_id", "url", "html"))
    return found.select("page_id", F.try_variant_get("v", "$.name", "string").alias("name"), F.col("url_match").cast("int").alias("url_match"))


_i = "'https://shop.example.com/i/'"


@registered("page_products", P + f""", o AS (
SELECT page_id, 0 AS n, 'S' || k AS sku, {_home} AS url, 'Offer' AS option_name, 'S' || k AS option_value, price || '.50' AS price, 'Out of Stock' AS stock, [{_i} || k || '.jpg', 'https://cdn.example.com/z.png', {_i} || 'main' || k || '.jpg'] AS image_urls FROM p WHERE kind = 0
UNION ALL SELECT page_id, 0, 'A' || k, {_home} || '?variant=1', 'Variant', 'Red', price || '.00', 'In Stock', [{_i} || 'main' || k || '.jpg'] FROM p WHERE kind = 1
UNION ALL SELECT page_id, 1, 'B' || k, 'https://shop.example.com/products/b', 'Size', 'Blue', (price + 1)::VARCHAR, 'In Stock', [{_i} || 'main' || k || '.jpg'] FROM p WHERE kind = 1
UNION ALL SELECT page_id, 0, 'M1', {_home}, 'Offer', 'M1', price || '.00', 'In Stock', [{_i} || 'main' || k || '.jpg'] FROM p WHERE kind = 2
UNION ALL SELECT page_id, 1, 'Z', {_home}, 'Offer', 'Z', '0.00', 'In Stock', [{_i} || 'main' || k || '.jpg'] FROM p WHERE kind = 2
UNION ALL SELECT page_id, 0, 'AUTO-' || sha1({_home})[1:8], {_home}, 'Offer', 'Default', '$' || price || '.99', 'In Stock', [{_i} || 'main' || k || '.jpg'] FROM p WHERE kind IN (3, 4))
SELECT page_id, n::INT AS n, sha1(CASE WHEN kind IN (3, 4) THEN {_home} ELSE {_home} || '|' || sku || '|' || o.price END)[1:12] AS id, sku, p_name AS product_title, o.url, option_name, option_value, o.price, stock, array_to_string(image_urls, ' ') AS images FROM o JOIN p USING (page_id)""")
def page_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13, C14, C15, C10 nested."""
    found = structured.page_products(view(spark, sf_dir, PRODUCT_PAGES, even=True).select("page_id", "url", "html"))
    return found.select("page_id", F.col("n").cast("int").alias("n"), "id", "sku", "product_title", "url", "option_name", "option_value", "price", "stock", F.array_join("image_urls", " ").alias("images"))


@registered("page_signals", P + f" SELECT page_id, p_name AS title, {_home} AS canonical, 'About ' || p_brand AS meta_description, CASE WHEN kind IN (1, 2, 3, 4) THEN '$' || price || '.99' ELSE '' END AS price_texts, CASE WHEN page_id % 2 = 0 THEN 'eur' ELSE 'x1' END AS meta_currencies, {_i} || 'main' || k || '.jpg' AS images FROM p")
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14."""
    joined = lambda c: F.array_join(c, " ").alias(c)
    return structured.signals(view(spark, sf_dir, PRODUCT_PAGES, even=True).select("page_id", "url", "html")).select("page_id", "title", "canonical", "meta_description", joined("price_texts"), joined("meta_currencies"), joined("images"))


_list = "'Water, Glycerin, ' || p_name || ', Sodium Chloride, Fragrance.'"


@registered("harvest_blocks", P + f" SELECT page_id, 'label' AS kind, 'Ingredients' AS block FROM p UNION ALL SELECT page_id, 'near', {_list} FROM p")
def harvest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: labels and what stands next to them."""
    pages = view(spark, sf_dir, PRODUCT_PAGES, even=True).select("page_id", "html", F.lit("US").alias("market"))
    return harvest.blocks(pages).filter("kind in ('label', 'near')").select("page_id", "kind", "block")


@registered("harvest_best", P + f", b AS (SELECT page_id, {_list} AS t, regexp_extract({_list}, '([A-Za-z0-9][A-Za-z0-9()/&+.''’ -]*(?:,\\s*[A-Za-z0-9][A-Za-z0-9()/&+.''’ -]*){{4,}})', 1) AS run FROM p) SELECT page_id, CASE WHEN run <> '' THEN trim(run) ELSE t END AS said, round(least(1.0, 0.65 + least(0.35, 0.08 * len(list_filter([{', '.join(q(w) for w in fixed.COMMON_TOKENS)}], lambda w: contains(lower(CASE WHEN run <> '' THEN trim(run) ELSE t END), w))))), 6)::DOUBLE AS score, true AS verified FROM b")
def harvest_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 to H3, T5: the best block of each page, and whether the page shows it."""
    pages = view(spark, sf_dir, PRODUCT_PAGES, even=True).select("page_id", "html", F.lit("US").alias("market"))
    best = harvest.ranked_blocks(harvest.blocks(pages)).join(pages.select("page_id", ingredient_text.html_to_text(F.col("html")).alias("page")), "page_id")
    return best.select("page_id", "said", "score", harvest.verified(F.col("said"), F.col("page")).alias("verified"))


_POPUP = """SELECT p_partkey AS page_id, p_name || CASE p_partkey % 3 WHEN 2 THEN ' - 50 ml' ELSE ' - Porcelain' END AS product_name, 'US' AS market,
  '<div class="x ingredients-popup"><p>SoftGlow: Water, Tin Oxide, Mica, Glycerin, Acid.</p>' || CASE WHEN p_partkey % 3 = 0 THEN '<p>Porcelain: Aqua, Sodium Benzoate, ' || p_name || ', Glycerin, Citric Acid.</p>' ELSE '<p>Cassis: Water, Mica, Glycerin, Parfum, Alcohol.</p>' END || '</div>' AS html FROM part"""


@registered("variant_blocks", f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Aqua, Sodium Benzoate, ' || regexp_replace(product_name, ' - Porcelain$', '') || ', Glycerin, Citric Acid.' ELSE '' END AS said, page_id % 3 = 1 AS ambiguous FROM ({_POPUP}) WHERE page_id % 3 < 2")
def variant_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: the pop-up paragraph of the product's shade; ambiguous where only others are named."""
    pages = view(spark, sf_dir, _POPUP, even=True)
    return harvest.variant_blocks(harvest.blocks(pages), pages.select("page_id", "product_name")).select("page_id", "said", "ambiguous")


_ATTEMPTS = """SELECT cast(o_custkey AS string) AS row_id, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS group_no, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) - 1 AS url_no, 'u' || cast(o_orderkey AS string) AS url, 200 AS status, cast(o_orderkey % 10 AS double) / 10 AS score, o_orderkey % 3 = 0 AS verified,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Water, ' || o_orderpriority END AS said, o_orderkey % 19 = 0 AS ambiguous FROM orders"""
_choice = f"""WITH a AS ({_ATTEMPTS}), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY group_no, url_no) AS n FROM a WHERE url_no < 3),
s AS (SELECT *, CASE WHEN ambiguous THEN 'ambiguous' WHEN said IS NOT NULL AND verified AND score >= 0.8 THEN 'ok' END AS stop, CASE WHEN said IS NOT NULL THEN score + CASE WHEN verified THEN 0.05 ELSE 0 END END AS value FROM r),
g AS (SELECT row_id, first({{'stop': stop, 'url': url, 'said': said, 'score': score}} ORDER BY n) FILTER (stop IS NOT NULL) AS s, first({{'url': url, 'said': said, 'value': value}} ORDER BY value DESC, n) FILTER (value IS NOT NULL) AS b FROM s GROUP BY row_id),
outcome AS (SELECT row_id, CASE WHEN s.stop = 'ok' THEN 'OK' WHEN s.stop = 'ambiguous' OR b IS NOT NULL THEN 'PENDING' ELSE 'NEEDS_SOURCE' END AS status, CASE WHEN s.stop = 'ok' THEN s.score WHEN s.stop = 'ambiguous' THEN 0.3 WHEN b IS NOT NULL THEN least(0.8, greatest(0.3, b.value)) ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN s IS NOT NULL THEN s.url ELSE b.url END AS source_ref, CASE WHEN s.stop = 'ok' THEN s.said WHEN coalesce(s.stop, '') <> 'ambiguous' THEN b.said END AS raw_ingredient_text FROM g)"""


@registered("chosen_sources", _choice + " SELECT row_id, status, round(confidence, 6) AS confidence, source_ref, raw_ingredient_text FROM outcome")
def chosen_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7."""
    return harvest.chosen(view(spark, sf_dir, _ATTEMPTS)).select("row_id", "status", F.round("confidence", 6).alias("confidence"), "source_ref", "raw_ingredient_text")


@registered("applied_harvest", f"{_choice}, cand AS (SELECT row_id, status AS s0, review_status AS r0 FROM ({PARSE} SELECT row_id, status, review_status FROM parse)) SELECT c.row_id, CASE WHEN h.row_id IS NULL THEN s0 WHEN h.row_id LIKE '%7' THEN 'ERROR' ELSE h.status END AS status, CASE WHEN h.row_id IS NULL OR h.row_id LIKE '%7' THEN r0 ELSE 'UNREVIEWED' END AS review_status, h.row_id IS NOT NULL AND h.row_id NOT LIKE '%7' AND raw_ingredient_text IS NULL AS unparsed, CASE WHEN h.row_id LIKE '%7' THEN repeat('e', 500) END AS error FROM cand c LEFT JOIN outcome h USING (row_id)")
def applied_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8; rows whose id ends in 7 failed with a long message."""
    found = harvest.chosen(view(spark, sf_dir, _ATTEMPTS)).withColumn("error", F.when(F.col("row_id").endswith("7"), F.repeat(F.lit("e"), 900)))
    done = harvest.applied(stored(parsed(spark, sf_dir), "parsed"), found)
    return done.select("row_id", "status", "review_status", F.col("parse_status").isNull().alias("unparsed"), "error")


_lab = "CASE WHEN doc_id % 3 = 0 THEN 'Ingredients: ' || text WHEN doc_id % 3 = 1 THEN 'About this. Full INCI : ' || text ELSE text END"
_bare = lambda x: strip(duck.sub(duck.sub(strip(text(x)), r"(?i)^(ingredients?|inci)\s*[:：]\s*"), r"^(全成分|成分|配料|配方)\s*[:：]\s*"))
_en, _zh = r"(?i)(?:ingredients?|inci)\s*[:：]\s*", r"(?:全成分|成分|配料|配方)\s*[:：]\s*"


def _after(x: str, pattern: str, otherwise: str) -> str:
    label = f"regexp_extract({x}, {q(pattern)})"
    return f"CASE WHEN {label} <> '' AND strpos({x}, {label}) > 1 THEN {strip(f'substr({x}, strpos({x}, {label}) + length({label}))')} ELSE {otherwise} END"


@registered("label_slices", f"SELECT doc_id, {_after('t', _en, _after('t', _zh, 't'))} AS said FROM (SELECT doc_id, {_bare(_lab)} AS t FROM documents)")
def label_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4."""
    return load(spark, sf_dir, "documents").select("doc_id", ingredient_text.slice_after_label(F.expr(_lab)).alias("said"))


_parts = [("'<p>' || p_name || '</p>'", "CASE p_partkey % 4 WHEN 0 THEN p_name || ' and more' WHEN 1 THEN repeat(p_brand || ' ', 12) || 'to use' WHEN 2 THEN repeat(p_brand || ' ', 12) END", "p_type")]
_ov = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' and more' WHEN 1 THEN trim(repeat(p_brand || ' ', 12) || 'to use') ELSE p_name END"


@registered("overviews", f"SELECT p_partkey, {_ov} AS overview, {_ov} || chr(10) || chr(10) || 'How to Use: ' || p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || 'Ingredients and Safety: ' || p_brand ELSE '' END AS description FROM part")
def overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11, T12."""
    s, d, m = (F.expr(e) for e in _parts[0])
    rows = load(spark, sf_dir, "part").withColumn("overview", ingredient_text.choose_overview(s, d, m))
    return rows.select("p_partkey", "overview", ingredient_text.merged_description(F.col("overview"), F.col("p_type"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))).alias("description"))


_FEED = "SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE 'h' || cast(p_partkey AS string) END AS handle, p_size, p_brand, p_partkey % 4 AS kind FROM part"
_feed_json = """named_struct('page', cast((id - 1) / 50 AS int) + 1, 'p', named_struct('id', id, 'title', CASE WHEN kind = 3 THEN '' ELSE title END, 'handle', handle, 'body_html', concat('<p>', p_brand, '</p>'), 'options', array(named_struct('name', 'Size')),
  'featured_image', concat('/f', cast(id AS string), '.jpg'), 'images', array(named_struct('src', concat('https://cdn/i', cast(id AS string), '.jpg'), 'variant_ids', array(id * 10)), named_struct('src', 'https://cdn/logo.png', 'variant_ids', array(0L))),
  'variants', array(named_struct('id', id * 10, 'sku', CASE WHEN kind = 1 THEN ' ' ELSE concat('s', cast(id AS string)) END, 'option1', 'Big', 'price', cast(p_size * 100 AS string), 'available', true, 'inventory_quantity', 5), named_struct('id', id * 10 + 1, 'sku', 'two', 'option1', 'Small', 'price', '7.5', 'available', kind <> 2, 'inventory_quantity', 0))))"""


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product feed as landed files of pages, read back."""
    path = scratch_path(spark, "feed")
    rows = view(spark, sf_dir, _FEED).select(F.expr(_feed_json).alias("x")).select("x.page", "x.p")
    rows.groupBy("page").agg(F.collect_list("p").alias("products")).write.json(path)
    return sources.read_product_feed(spark, path, multi_line=False)


@registered("feed_offers", f"WITH f AS ({_FEED}), v AS (SELECT *, 0 AS n FROM f UNION ALL SELECT *, 1 FROM f) SELECT id AS site_product_id, 'https://s.example.com/products/' || handle AS url_canonical, CASE WHEN kind = 3 THEN handle ELSE title END AS product_title, CASE WHEN n = 1 THEN 'two' WHEN kind = 1 THEN cast(id * 10 AS VARCHAR) ELSE 's' || id END AS variant_sku, CASE WHEN n = 0 THEN p_size * 100 ELSE 7.5 END::DOUBLE AS price_amount, CASE WHEN n = 0 THEN 'low_stock' ELSE 'out_of_stock' END AS availability FROM v WHERE handle <> ''")
def feed_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, O10."""
    found = offers.feed_offers(_feed(spark, sf_dir), "s.example.com", "US")
    return found.select(F.col("site_product_id").cast("long").alias("site_product_id"), "url_canonical", "product_title", "variant_sku", "price_amount", "availability")


@registered("feed_variants", f"WITH f AS ({_FEED}), v AS (SELECT *, 0 AS n FROM f UNION ALL SELECT *, 1 FROM f) SELECT cast(id * 10 + n AS VARCHAR) AS id, CASE WHEN n = 1 THEN 'two' WHEN kind = 1 THEN 'SHOPIFY-' || (id * 10) ELSE 's' || id END AS sku, CASE WHEN n = 0 THEN p_size || '.00' ELSE '7.5' END AS price, CASE WHEN n = 0 THEN 'Low Stock' WHEN kind = 2 THEN 'Out of Stock' ELSE 'In Stock' END AS stock, 'Size' AS option_name, CASE WHEN n = 0 THEN 'Big' ELSE 'Small' END AS option_value, p_brand AS description, CASE WHEN n = 0 THEN 'https://cdn/i' || id || '.jpg https://s.example.com/f' || id || '.jpg' ELSE 'https://s.example.com/f' || id || '.jpg https://cdn/i' || id || '.jpg' END AS images FROM v")
def feed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, C1 with images and description, C10."""
    found = catalog.feed_variants(_feed(spark, sf_dir), "https://s.example.com")
    return found.select("id", "sku", "price", "stock", "option_name", "option_value", "description", F.array_join("image_urls", " ").alias("images"))


_VI = "SELECT l_orderkey * 10 + l_linenumber AS pos, 'p' || cast(l_partkey AS string) AS product_url, CASE l_linenumber % 3 WHEN 0 THEN array('https://i/a.jpg', 'https://i/a.jpg', 'https://i/favicon.ico') WHEN 1 THEN array('https://i/b.jpg 1x, https://i/c.jpg 2x', 'x') ELSE array('https://i/d.jpg', 'https://i/e.jpg') END AS image_urls FROM lineitem"
_n_images = "CASE WHEN l_linenumber % 3 = 2 THEN 2 ELSE 1 END"


@registered("image_counts", f"SELECT l_orderkey * 10 + l_linenumber AS pos, {_n_images}::INT AS n_images, (sum({_n_images}) OVER (PARTITION BY l_partkey))::BIGINT AS n_product_images FROM lineitem")
def image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10 of texts, C16."""
    return catalog.image_counts(view(spark, sf_dir, _VI)).select("pos", "n_images", "n_product_images")


@registered("title_suffixes", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN 'Other ' || p_type ELSE p_name END AS suffix FROM part")
def title_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C15."""
    variant = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" - "), "p_type")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Other "), "p_type")).otherwise(F.col("p_name"))
    return load(spark, sf_dir, "part").select("p_partkey", prices.title_suffix(F.col("p_name"), variant).alias("suffix"))


_MISS = """SELECT p_partkey AS k, 'https://s.example.com/products/' || cast(p_partkey AS string) || '-velvet' AS product_url, 'Glow ' || p_name AS title, p_partkey % 3 AS kind FROM part"""


@registered("missing_images", f"""WITH m AS ({_MISS}) SELECT product_url, -1 AS pos, array_to_string(CASE WHEN kind = 2 THEN ['https://i/own.jpg'] ELSE ['https://i/own.jpg', 'https://i/glow-big.jpg', 'https://i/velvet.jpg?width=900', 'https://i/v1.jpg'] END, ' ') AS images FROM m
UNION ALL SELECT product_url, 1, CASE WHEN kind = 2 THEN 'https://i/v1.jpg' ELSE 'https://i/v1.jpg https://i/glow-big.jpg https://i/velvet.jpg?width=900' END FROM m""")
def missing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: products (position -1) and variants with the relevant images of a second look; of every third product it found none."""
    base = view(spark, sf_dir, _MISS)
    say = lambda *u: F.array(*[F.lit(x) for x in u])
    products = base.select("product_url", "title", say("https://i/own.jpg").alias("image_urls"))
    variants = base.select("product_url", F.lit(1).alias("pos"), F.lit("a").alias("sku"), F.lit("Size").alias("option_name"), F.lit("50").alias("option_value"), "product_url", say("https://i/v1.jpg").alias("image_urls")).toDF("product_url", "pos", "sku", "option_name", "option_value", "url", "image_urls")
    found = base.select("product_url", F.lit(1).alias("pos"), F.lit("a").alias("sku"), F.lit("Size").alias("option_name"), F.lit("50").alias("option_value"), F.when(F.col("kind") == 2, say("https://i/unrelated.jpg")).otherwise(say("https://i/glow-big.jpg", "https://i/velvet.jpg?width=300", "https://i/velvet.jpg?width=900", "https://i/unrelated.jpg")).alias("image_urls"))
    a, b = catalog.fill_missing_images(products, variants, found)
    return a.select("product_url", F.lit(-1).alias("pos"), F.array_join("image_urls", " ").alias("images")).union(b.select("product_url", "pos", F.array_join("image_urls", " ")))


_BATCH = "SELECT p_partkey AS k, 'u' || cast(cast(floor(p_partkey / 3) AS int) AS string) AS product_url, 't' || cast(cast(floor(p_partkey / 3) AS int) % 2 AS string) AS title, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS brand, p_partkey % 3 AS batch FROM part"


@registered("catalog_product_batches", f"WITH b AS ({_BATCH}) SELECT product_url, title, arg_max(brand, batch) FILTER (brand IS NOT NULL) AS brand, string_agg('s' || k, ',' ORDER BY batch) AS skus FROM b GROUP BY ALL")
def catalog_product_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9 of products: three batches, later values win and lists are joined."""
    rows = view(spark, sf_dir, _BATCH).withColumns({"skus": F.array(F.concat(F.lit("s"), "k")), "image_urls": F.array().cast("array<string>")})
    batches = [rows.filter(F.col("batch") == k).drop("k", "batch") for k in range(3)]
    return catalog.merged_products(batches).select("product_url", "title", "brand", F.array_join("skus", ",").alias("skus"))
