"""Fixture views over the driver's tables; the same text runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from larkspur.scratch import spread

CANDIDATES = """
SELECT cast(doc_id AS string) AS row_id, cast(doc_id % 4 AS string) AS import_id, doc_id AS row_index, CASE doc_id % 11 WHEN 3 THEN 'Dermalogica' WHEN 7 THEN 'Pixi Beauty' ELSE source END AS brand,
  split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) AS product_name, upper(lang) AS market,
  cast(doc_id % 97 AS string) AS sku_key, text AS raw_ingredient_text,
  CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'https://www.sephora.com/p/' || source || '-' || cast(doc_id AS string) WHEN 2 THEN 'www.' || source || '.com/products/x?variant=' || cast(doc_id % 3 AS string)
    WHEN 3 THEN 'incidecoder.com/products/' || cast(doc_id AS string) WHEN 4 THEN CASE WHEN doc_id % 5 = 0 THEN 'https://shop.dermalogica.com/' || cast(doc_id AS string) ELSE 'no url' END ELSE 'https://brand.example.com/' || split_part(text, ' ', 2) END AS source_ref,
  CASE doc_id % 3 WHEN 0 THEN 'Official' WHEN 1 THEN 'Retailer' ELSE NULL END AS source_type,
  CASE doc_id % 7 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' ELSE 'UNREVIEWED' END AS review_status, 'OK' AS status
FROM documents
"""

OFFERS = """
SELECT l_orderkey * 10 + l_linenumber AS offer_id, s_name AS source_site, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE cast(l_partkey AS string) END AS site_product_id,
  'https://shop.example.com/products/' || cast(l_partkey AS string) AS url_canonical, CASE WHEN l_linenumber % 2 = 0 THEN 'sku-' || cast(l_partkey % 100 AS string) ELSE '' END AS variant_sku,
  CASE n_regionkey WHEN 0 THEN 'US' WHEN 1 THEN 'EU-DE' WHEN 2 THEN 'SG' WHEN 3 THEN 'JP' ELSE 'XX' END AS market_id,
  CASE l_linenumber WHEN 1 THEN '$' || cast(l_partkey % 500 + 1 AS string) || '.50' WHEN 2 THEN 'From $' || cast(l_partkey % 90 + 1 AS string) || ' - $' || cast(l_partkey % 90 + 20 AS string)
    WHEN 3 THEN '€1.' || cast(l_partkey % 900 + 100 AS string) || ',56' WHEN 4 THEN 'now $' || cast(l_partkey % 300 + 1 AS string) WHEN 5 THEN '¥3,' || cast(l_partkey % 900 + 100 AS string)
    WHEN 6 THEN cast(l_partkey % 700 AS string) ELSE '' END AS price_display_raw,
  CASE WHEN l_linenumber % 4 = 0 THEN 'usd' WHEN l_linenumber % 4 = 1 THEN 'dollars' ELSE NULL END AS structured_currency,
  CASE l_returnflag WHEN 'R' THEN 'https://schema.org/OutOfStock' WHEN 'A' THEN 'InStock' ELSE '' END AS raw_availability
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
"""

VARIANTS = """
SELECT cast(l_orderkey AS string) AS id, 'sku-' || cast(l_partkey AS string) || '-' || cast(l_linenumber AS string) AS sku, 'https://shop.example.com/products/' || cast(l_partkey AS string) AS product_url,
  p_name AS product_title, p_brand AS brand, l_orderkey * 10 + l_linenumber AS pos, cast(l_partkey % 4000 AS string) AS raw_price,
  CASE WHEN l_partkey % 5 = 0 THEN 'JPY' ELSE 'USD' END AS currency, l_returnflag <> 'R' AS available, cast(l_quantity AS int) - 5 AS quantity
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

PRODUCT_PAGES = """
SELECT p_partkey AS page_id, 'https://shop.example.com/' || CASE WHEN p_partkey % 7 = 0 THEN 'de-de/' ELSE '' END || 'products/' || cast(p_partkey AS string) || '?utm_source=x' AS url, p_name, p_brand, p_partkey AS k, p_size AS price, p_partkey % 6 AS kind,
  '<html><head><title>Shop</title><link rel="canonical" href="https://shop.example.com/products/' || cast(p_partkey AS string) || '"><meta name="description" content="About ' || p_brand || '"><meta property="og:price:currency" content="' || CASE WHEN p_partkey % 2 = 0 THEN 'eur' ELSE 'x1' END || '">' ||
  '<script type="application/ld+json">' || CASE p_partkey % 6
    WHEN 0 THEN '{"@type":"Product","name":"' || p_name || '","sku":"S' || cast(p_partkey AS string) || '","url":"/products/' || cast(p_partkey AS string) || '?ref=x","image":["/i/' || cast(p_partkey AS string) || '.jpg 2x, /i/y.jpg","/i/placeholder.svg",{"url":"https://cdn.example.com/z.png"}],"offers":{"@type":"Offer","price":"' || cast(p_size AS string) || '.50","priceCurrency":"usd","availability":"https://schema.org/OutOfStock"}}'
    WHEN 1 THEN '[{"@type":"ProductGroup","name":"' || p_name || '","productID":"G' || cast(p_partkey AS string) || '","hasVariant":[{"@type":"Product","name":"' || p_name || ' - Red","sku":"A' || cast(p_partkey AS string) || '","offers":{"price":' || cast(p_size AS string) || ',"priceCurrency":"SGD","url":"/products/' || cast(p_partkey AS string) || '?variant=1"}},{"@type":"Product","name":"Blue","sku":"B' || cast(p_partkey AS string) || '","url":"/products/b","offers":[{"price":"' || cast(p_size + 1 AS string) || '"}]}]}]'
    WHEN 2 THEN '{"@graph":[{"@type":"WebPage","name":"w"},{"@type":["Thing","Product"],"name":"' || p_name || '","mpn":"M1","offers":{"@type":"AggregateOffer","offers":[{"priceSpecification":{"price":' || cast(p_size AS string) || ',"priceCurrency":"JPY"}},{"sku":"Z","price":null}]}}]}'
    WHEN 3 THEN '{bad json' WHEN 4 THEN '{"@type":"Product","name":"' || p_name || '"}' ELSE '{"@type":"Organization","name":"o"}' END ||
  '</script></head><body data-currency="GBP"><h1>' || p_name || '</h1><img src="/i/main' || cast(p_partkey AS string) || '.jpg"><img src="/logo.png">' ||
  CASE WHEN p_partkey % 6 IN (1, 2, 3, 4) THEN '<span class="big price">$' || cast(p_size AS string) || '.99</span>' ELSE '' END || CASE WHEN p_partkey % 6 = 3 THEN '<button>Add to cart</button>' ELSE '' END ||
  '<div data-product-skus-value="[{&quot;id&quot;:&quot;B' || cast(p_partkey AS string) || '&quot;,&quot;size&quot;:&quot;50 ml&quot;}]"></div><h2>Ingredients</h2><div>Water, Glycerin, ' || p_name || ', Sodium Chloride, Fragrance.</div></body></html>' AS html
FROM part
"""

TASK_ROWS = """
SELECT cast(user_id % 20 AS string) AS task_id, event_id AS id,
  CASE event_type WHEN 'view' THEN 'OK' WHEN 'click' THEN 'PENDING' WHEN 'purchase' THEN 'NEEDS_SOURCE' WHEN 'signup' THEN 'SKIPPED' ELSE 'QUEUED' END AS status
FROM events
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, even: bool = False) -> DataFrame:
    """A view's text over the tables of sf_dir. even: their rows are spread over all cores first, for costly work on pages that are made of short rows (a table of a million products is one file of a few MB)."""
    names = set(re.findall(r"(?:FROM|JOIN) (\w+)", sql))
    read = (lambda n: spread(load(spark, sf_dir, n))) if even else (lambda n: load(spark, sf_dir, n))
    return spark.sql(re.sub(r"(FROM|JOIN) (\w+)", r"\1 {\2}", re.sub(r"([{}])", r"\1\1", sql)), **{n: read(n) for n in names})
