"""Queries on structured data, storefronts and images whose pages vary with the tables, and their SQL, which reads JSON and links a second time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import fixed, urls
from larkspur.operators import catalog, discovery, structured
from larkspur.plans import duck
from larkspur.plans.base import registered
from larkspur.plans.duck import q
from larkspur.plans.pages import _LINKS
from larkspur.plans.views import view

#: Pages by part in four locales: objects in arrays, graphs and lists of types, whose URLs equal the page's, share its path or locale, or neither; and JSON that can't be read.
OBJECTS = """
SELECT page_id, url, canonical, p_size,
  '<html><head>' || CASE WHEN canonical <> '' THEN '<link rel="canonical" href="' || canonical || '">' ELSE '' END || '<script type="application/ld+json">[{"@type":"Product","name":"a' || k || '","url":"https://shop.example.com/de-de/products/' || k || '"}' ||
  CASE WHEN p_size % 2 = 0 THEN ',{"@type":["Thing","Product"],"name":"b' || k || '","@id":"https://shop.example.com/en-us/products/' || k || '","offers":[{"url":"https://shop.example.com/products/' || k || '"},{"url":"https://other.example.com/fr/products/' || k || '"},{"price":1}]}' ELSE '' END ||
  ',{"@type":"Organization","name":"o"},"text"]</script><script type="application/ld+json">' || CASE WHEN p_size % 7 = 0 THEN '{bad' ELSE '{"@graph":[{"@type":"ProductGroup","name":"g' || k || '","url":"https://shop.example.com/fr/products/other"},{"@type":"Product","name":"d' || k || '","url":"' || CASE WHEN p_size % 5 = 0 THEN url ELSE 'https://shop.example.com/products/zz' END || '"}],"name":"graph"}' END ||
  '</script></head><body>' || CASE p_size % 4 WHEN 0 THEN 'Add to cart' WHEN 1 THEN '<meta property="og:type" content="product">' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ' $' || cast(p_size AS string) || '.50' ELSE '' END || '</body></html>' AS html
FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN 'https://shop.example.com/products/' || k WHEN p_size % 3 = 1 THEN url ELSE '' END AS canonical FROM (
  SELECT p_partkey AS page_id, cast(p_partkey AS string) AS k, p_size, 'https://shop.example.com/' || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'en-us/' WHEN 2 THEN 'de-de/' ELSE 'fr/' END || 'products/' || cast(p_partkey AS string) AS url FROM part))
"""
#: CTEs: a row per JSON-LD object, with its place (script, item, node), and its URLs.
_JSON = f"""WITH h AS ({OBJECTS}), s AS (SELECT page_id, url, CASE WHEN canonical <> '' THEN canonical ELSE url END AS canonical, unnest(range(len(js))) AS script, unnest(js) AS j FROM (SELECT *, regexp_extract_all(html, '(?s)<script type="application/ld\\+json">(.*?)</script>', 1) AS js FROM h)),
t AS (SELECT *, unnest(range(len(vs))) AS item, unnest(vs) AS v0 FROM (SELECT *, list_filter(CASE WHEN json_type(j::JSON) = 'ARRAY' THEN json_extract(j::JSON, '$[*]') ELSE [j::JSON] END, lambda v: json_type(v) = 'OBJECT') AS vs FROM s WHERE json_valid(j))),
o AS (SELECT *, unnest(range(len(ns))) AS node, unnest(ns) AS v FROM (SELECT *, CASE WHEN json_type(v0, '$."@graph"') = 'ARRAY' THEN list_filter(json_extract(v0, '$."@graph"[*]'), lambda v: json_type(v) = 'OBJECT') ELSE [v0] END AS ns FROM t)),
typed AS (SELECT *, CASE WHEN json_type(v, '$."@type"') = 'ARRAY' THEN json_extract_string(v, '$."@type"[*]') ELSE [json_extract_string(v, '$."@type"')] END AS types FROM o)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, OBJECTS, even=True).select("page_id", "url", "html")


@registered("jsonld_nested", _JSON + " SELECT page_id, script || '-' || item || '-' || node AS place, json_extract_string(v, '$.name') AS name, list_contains(types, 'Product') AS is_product FROM typed")
def jsonld_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of arrays and graphs, in place; texts among them and bad JSON are left out."""
    found = structured.jsonld(_pages(spark, sf_dir))
    return found.select("page_id", F.array_join(F.col("at").cast("array<string>"), "-").alias("place"), F.try_variant_get("v", "$.name", "string").alias("name"), structured.is_type("Product").alias("is_product"))


_locale = lambda u: f"lower(regexp_extract({duck.path(u)}, '^/+([A-Za-z]{{2}}(?:-[A-Za-z]{{2}})?)(?:/|$)', 1))"


@registered("best_objects_locale", _JSON + f""", own AS (SELECT page_id, url, canonical, script, item, node, v, list_distinct(list_filter(list_concat([json_extract_string(v, '$.url'), json_extract_string(v, '$."@id"')], coalesce(json_extract_string(v, '$.offers[*].url'), [])), lambda u: u IS NOT NULL)) AS us FROM typed WHERE list_contains(types, 'Product') OR list_contains(types, 'ProductGroup')),
met AS (SELECT page_id, script, item, node, u, p FROM (SELECT *, unnest(us) AS u FROM own) CROSS JOIN LATERAL (SELECT DISTINCT unnest([canonical, url]) AS p)),
points AS (SELECT page_id, script, item, node, sum(CASE WHEN u = p THEN 120 ELSE 0 END + CASE WHEN {duck.host('u')} = {duck.host('p')} AND {duck.path('u')} = {duck.path('p')} THEN 90 ELSE 0 END +
  CASE WHEN {_locale('u')} = '' OR {_locale('p')} = '' THEN 0 WHEN {_locale('u')} = {_locale('p')} THEN 20 ELSE -25 END) AS points FROM met GROUP BY ALL),
r AS (SELECT own.page_id, json_extract_string(v, '$.name') AS name, coalesce(points, 0)::INT AS url_match, row_number() OVER (PARTITION BY own.page_id ORDER BY coalesce(points, 0) DESC, own.script, own.item, own.node) AS k FROM own LEFT JOIN points USING (page_id, script, item, node))
SELECT page_id, name, url_match FROM r WHERE k = 1""")
def best_objects_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal URLs, equal paths, the same and other locales, of objects and of their offers."""
    found = structured.best_object(_pages(spark, sf_dir))
    return found.select("page_id", F.try_variant_get("v", "$.name", "string").alias("name"), F.col("url_match").cast("int").alias("url_match"))


_has = lambda pattern, n: f"CASE WHEN regexp_matches(lower(html), {q(pattern)}) THEN {n} ELSE 0 END"


@registered("product_page_rules", f"SELECT page_id, {_has(fixed.PRODUCT_TYPE, 4)} + {_has(fixed.PRICE_SIGN, 2)} + {_has(fixed.BUY_WORDS, 2)} + {_has(fixed.PRODUCT_META, 2)} >= 4 AS product_page FROM ({OBJECTS.replace(chr(34) + '@type' + chr(34) + ':' + chr(34) + 'Product' + chr(34), chr(34) + '@type' + chr(34) + ':' + chr(34) + 'Thing' + chr(34))}) WHERE page_id % 2 = 0 UNION ALL SELECT page_id, {_has(fixed.PRODUCT_TYPE, 4)} + {_has(fixed.PRICE_SIGN, 2)} + {_has(fixed.BUY_WORDS, 2)} + {_has(fixed.PRODUCT_META, 2)} >= 4 FROM ({OBJECTS}) WHERE page_id % 2 = 1")
def product_page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup of a product, og:type, prices and buying words; pages of even ids have lost their markup."""
    pages = _pages(spark, sf_dir)
    html = F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit('"@type":"Product"'), F.lit('"@type":"Thing"'))).otherwise(F.col("html"))
    return pages.select("page_id", urls.looks_like_product_page(html).alias("product_page"))


#: Pages that ask for the country in words, or by links, with the markets' words in labels, hosts and paths.
COUNTRIES = """
SELECT c_custkey AS page_id, 'https://www.brand' || cast(c_custkey AS string) || '.com/' AS url, CASE WHEN c_custkey % 2 = 0 THEN '<h1>Choose your country</h1>' ELSE '' END ||
  '<a href="https://' || CASE c_custkey % 3 WHEN 0 THEN 'us.' WHEN 1 THEN 'www.' ELSE '' END || 'brand' || cast(c_custkey AS string) || '.com/' || CASE c_custkey % 5 WHEN 0 THEN 'us' WHEN 1 THEN 'usa/shop' ELSE '' END || '">' || CASE c_custkey % 4 WHEN 0 THEN 'United States' WHEN 1 THEN 'USA - us' ELSE 'Shop' END || '</a>' ||
  '<a href="https://de.brand' || cast(c_custkey AS string) || '.com/">' || CASE c_custkey % 7 WHEN 0 THEN 'Deutschland' WHEN 1 THEN 'Germany (DE)' ELSE 'EU' END || '</a>' ||
  CASE WHEN c_custkey % 5 < 3 THEN '<a href="/sg/">Singapore</a><a href="https://sg.brand' || cast(c_custkey AS string) || '.com/sg">' || CASE WHEN c_custkey % 2 = 0 THEN 'SG' ELSE 'store' END || '</a>' ELSE '' END ||
  '<a href="/jp' || CASE WHEN c_custkey % 3 = 0 THEN '/store' ELSE '' END || '">' || CASE c_custkey % 6 WHEN 0 THEN '日本' WHEN 1 THEN 'Japan' WHEN 2 THEN '日本 (Japan)' ELSE 'x' END || '</a><a href="https://other.com/us/de/sg/jp">United States Germany Singapore Japan</a><a href="/us/usa.png">us</a>' AS html
FROM customer
"""
_words = lambda x: f"(' ' || regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ')"
_brand = lambda u: f"regexp_extract({duck.host(u)}, '([^.]+)\\.[^.]+$', 1)"


def _scores(market: str) -> str:
    parts = [f"CASE WHEN contains({_words(x)}, {q(f' {w} ')}) THEN {n} ELSE 0 END" for w in fixed.MARKET_WORDS[market] for x, n in (("said", 5), (duck.host("href"), 4), (duck.path("href"), 2))]
    return " + ".join(parts)


_own = f"own AS (SELECT *, CASE WHEN {duck.host('href')} <> {duck.host('url')} THEN 1 ELSE 0 END + CASE WHEN {duck.path('href')} NOT IN ('', '/') THEN 1 ELSE 0 END AS extra FROM l WHERE {_brand('href')} = {_brand('url')} AND NOT regexp_matches({duck.path('href')}, {q(fixed.STATIC_FILE)}))"


@registered("storefront_markets", _LINKS.replace("WITH a AS", f"WITH sel AS ({COUNTRIES}), a AS").replace("FROM pages)", "FROM sel)") + f""", {_own}, asks AS (SELECT sel.page_id FROM sel LEFT JOIN (SELECT page_id, count(*) AS n FROM own GROUP BY page_id) c USING (page_id) WHERE regexp_matches(html, {q(discovery.SELECTOR_PHRASE)}) OR coalesce(n, 0) >= 4),
scored AS ({' UNION ALL '.join(f"SELECT page_id, {q(m)} AS market, href, pos, extra + {_scores(m)} AS score FROM own" for m in fixed.MARKET_WORDS)})
SELECT page_id, market, arg_max(href, (score, -pos)) AS href FROM scored JOIN asks USING (page_id) WHERE score >= 4 GROUP BY page_id, market""")
def storefront_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8: the stores of all four markets."""
    pages = view(spark, sf_dir, COUNTRIES, even=True)
    out = None
    for market in fixed.MARKET_WORDS:
        one = discovery.storefront(pages, market).select("page_id", F.lit(market).alias("market"), "href")
        out = one if out is None else out.unionByName(one)
    return out


#: What a second look found of each product, and variants that match it by sku, by option or not at all.
SEEN = """
SELECT product_url, pos, CASE pos WHEN 3 THEN NULL ELSE 's' || cast(pos AS string) END AS sku, CASE WHEN pos < 2 THEN 'Size' ELSE 'Shade' END AS option_name, CASE pos WHEN 0 THEN '50' WHEN 1 THEN '100' ELSE 'Red' END AS option_value, 'https://i/velvet-' || cast(k AS string) || '-' || cast(pos AS string) || '.jpg' AS image
FROM (SELECT p_partkey AS k, p_size, 'https://s.example.com/products/' || cast(p_partkey AS string) AS product_url FROM part) CROSS JOIN (SELECT DISTINCT l_linenumber - 1 AS pos FROM lineitem WHERE l_linenumber <= 4)
WHERE NOT (k % 2 = 0 AND pos = 1) AND NOT (k % 5 = 0 AND pos = 2) AND k % 7 > 0
"""
KNOWN = """
SELECT 'https://s.example.com/products/' || cast(p_partkey AS string) AS product_url, pos, CASE pos WHEN 0 THEN 's1' ELSE 'zz' END AS sku, CASE pos WHEN 1 THEN 'Shade' WHEN 0 THEN 'Size' ELSE NULL END AS option_name, CASE pos WHEN 1 THEN 'Red' WHEN 0 THEN '50' ELSE NULL END AS option_value, 'https://i/own-' || cast(pos AS string) || '.jpg' AS image
FROM part CROSS JOIN (SELECT DISTINCT l_linenumber - 1 AS pos FROM lineitem WHERE l_linenumber <= 3)
"""


@registered("matched_images", f"""WITH seen AS ({SEEN}), v AS ({KNOWN}), n AS (SELECT product_url, list(image ORDER BY pos) AS every FROM seen GROUP BY product_url),
m AS (SELECT v.*, every, coalesce((SELECT last(s.image ORDER BY s.pos) FROM seen s WHERE s.product_url = v.product_url AND s.sku = v.sku), (SELECT last(s.image ORDER BY s.pos) FROM seen s WHERE s.product_url = v.product_url AND s.sku IS NOT NULL AND v.option_name <> '' AND s.option_name = v.option_name AND s.option_value = v.option_value),
  (SELECT first(s.image ORDER BY s.pos) FROM seen s WHERE s.product_url = v.product_url AND s.sku IS NOT NULL)) AS hit FROM v LEFT JOIN n USING (product_url))
SELECT product_url, pos, array_to_string(CASE WHEN every IS NULL THEN [image] ELSE list_concat([image, hit], list_filter(every, lambda u: u <> hit)) END, ' ') AS images FROM m""")
def matched_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: variants by sku, by option, and by the first that was found; products that weren't seen again stay."""
    arrayed = lambda df: df.withColumn("image_urls", F.array("image")).drop("image")
    found, known = arrayed(view(spark, sf_dir, SEEN)), arrayed(view(spark, sf_dir, KNOWN)).withColumn("url", F.col("product_url"))
    products = known.select("product_url").distinct().select("product_url", F.lit("Velvet").alias("title"), F.array().cast("array<string>").alias("image_urls"))
    return catalog.fill_missing_images(products, known, found)[1].select("product_url", "pos", F.array_join("image_urls", " ").alias("images"))
