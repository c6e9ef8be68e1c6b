"""Queries on crawled sitemaps and paged feeds, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import sources
from larkspur.operators import discovery
from larkspur.plans import duck
from larkspur.plans.base import registered
from larkspur.plans.views import view
from larkspur.scratch import scratch_path

#: Sites by supplier, with their robots files. Every third names an index.
SITES = """
SELECT s_suppkey AS k, 'https://s' || cast(s_suppkey AS string) || '.example.com' AS site,
  CASE WHEN s_suppkey % 3 = 0 THEN 'User-agent: *' || chr(10) || 'Sitemap: https://s' || cast(s_suppkey AS string) || '.example.com/index.xml' ELSE 'User-agent: *' END AS robots
FROM supplier
"""
_LINKED = """SELECT k, site, '/index.xml' AS place, 0 AS n, '/deep.xml' AS target FROM sites WHERE k % 3 = 0
UNION ALL SELECT k, site, '/index.xml', 1, '/gone.xml' FROM sites WHERE k % 3 = 0
UNION ALL SELECT k, site, '/index.xml', 2, '/index.xml' FROM sites WHERE k % 3 = 0
UNION ALL SELECT k, site, '/index.xml', 3, '/chain1.xml' FROM sites WHERE k % 9 = 0
UNION ALL SELECT k, site, '/chain' || cast(n AS string) || '.xml', 0, '/chain' || cast(n + 1 AS string) || '.xml' FROM sites CROSS JOIN chain WHERE k % 9 = 0
UNION ALL SELECT k, site, '/chain' || cast(n AS string) || '.xml', 1, CASE WHEN n % 7 = 0 THEN '/index.xml' ELSE '/side' || cast(n + k % 5 AS string) || '.xml' END FROM sites CROSS JOIN chain WHERE k % 9 = 0"""
_LISTED = """SELECT site, '/deep.xml' AS place, 0 AS n, '<![CDATA[' || site || '/products/a&amp;b]]>' AS loc FROM sites WHERE k % 3 = 0
UNION ALL SELECT site, '/deep.xml', 1, ' ' || site || '/products/caf&#233; ' FROM sites WHERE k % 3 = 0
UNION ALL SELECT site, '/deep.xml', 2, site || '/blog/x' FROM sites WHERE k % 3 = 0
UNION ALL SELECT site, '/sitemap.xml', n, site || CASE n % 4 WHEN 0 THEN '/about' ELSE '/products/item-' || cast(n AS string) END FROM sites CROSS JOIN chain WHERE k % 3 < 2 AND n <= k % 11
UNION ALL SELECT site, '/side' || cast(n AS string) || '.xml', 0, site || '/products/side-' || cast(n % 4 AS string) FROM sites CROSS JOIN chain WHERE k % 9 = 0
UNION ALL SELECT site, '/chain51.xml', 0, site || '/products/last-of-chain' FROM sites WHERE k % 9 = 0"""


def _bodies(dialect: str) -> str:
    """What was fetched (indexes that list each other up to 50 levels deep and in cycles, lists of pages, and pages that aren't XML), in Spark's or DuckDB's words for a list in order."""
    joined = (lambda x: f"array_join(transform(array_sort(collect_list(struct(n, {x} AS x))), e -> e.x), '')") if dialect == "spark" else (lambda x: f"string_agg({x}, '' ORDER BY n, {x})")
    return f"""SELECT site || place AS url, '<?xml version="1.0"?><sitemapindex>' || {joined("'<sitemap><loc>' || site || target || '</loc></sitemap>'")} || '</sitemapindex>' AS body FROM linked GROUP BY site, place
UNION ALL SELECT site || place, '<urlset>' || {joined("'<url><loc>' || loc || '</loc></url>'")} || '</urlset>' FROM listed GROUP BY site, place
UNION ALL SELECT site || '/sitemap.xml', 'not found' FROM sites WHERE k % 3 = 2"""


_CHAIN = "SELECT DISTINCT l_linenumber + 7 * (l_orderkey % 8) AS n FROM lineitem WHERE l_linenumber + 7 * (l_orderkey % 8) <= 50"


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, chain = view(spark, sf_dir, SITES), F.broadcast(view(spark, sf_dir, _CHAIN))  # at most 50 rows; by its size in lineitem the sites would be broadcast
    linked, listed = (spark.sql(t.replace("FROM sites", "FROM {sites}").replace("JOIN chain", "JOIN {chain}"), sites=sites, chain=chain) for t in (_LINKED, _LISTED))
    return spark.sql(_bodies("spark").replace("FROM linked", "FROM {linked}").replace("FROM listed", "FROM {listed}").replace("FROM sites", "FROM {sites}"), linked=linked, listed=listed, sites=sites)


_once = lambda x: f"list_filter({x}, lambda u, i: list_position({x}, u) = i)"
#: CTEs of the walk. A row of `walk` is a site's state: the documents asked for so far in order, and the newest of them.
WALK = f"""WITH RECURSIVE sites AS ({SITES}), chain AS ({_CHAIN}), linked AS ({_LINKED}), listed AS ({_LISTED}), fetched AS ({_bodies("duck")}),
docs AS (SELECT url, regexp_matches(body, '(?i)<sitemapindex') AS is_index,
  list_transform(regexp_extract_all(body, '<loc>\\s*(.*?)\\s*</loc>', 1), lambda u: replace(replace(trim(regexp_replace(u, '^<!\\[CDATA\\[|\\]\\]>$', '', 'g')), '&#233;', 'é'), '&amp;', '&')) AS locs
  FROM fetched WHERE regexp_matches(body, '(?i)<\\?xml|<urlset')),
links AS (SELECT s.site, map_from_entries(list((url, locs))) AS m FROM sites s JOIN docs d ON is_index AND starts_with(d.url, s.site || '/') GROUP BY s.site),
first AS (SELECT site, {_once("list_concat(regexp_extract_all(robots, '(?i)sitemap:\\s*(\\S+)', 1), [site || '/sitemap.xml', site || '/sitemap_index.xml'])")} AS front FROM sites),
walk AS (SELECT site, 0 AS level, front AS seen, front FROM first
  UNION ALL SELECT site, level + 1, list_concat(seen, found), found FROM (
    SELECT site, level, seen, {_once("listed")} AS found FROM (
      SELECT w.site, level, seen, list_filter(flatten(list_transform(front, lambda u: coalesce(m[u], []))), lambda u: NOT list_contains(seen, u)) AS listed FROM walk w JOIN links USING (site))) WHERE len(found) > 0),
visited AS (SELECT site, arg_max(seen, level) AS seen FROM walk GROUP BY site)"""


def _walked(documents: int | None, limit: int | None) -> str:
    cut = "seen" if documents is None else f"seen[1:{documents}]"
    return f"""{WALK},
asked AS (SELECT site, unnest({cut}) AS url, unnest(range(len({cut}))) AS k FROM visited),
locs AS (SELECT site, k, unnest(locs) AS loc, unnest(range(len(locs))) AS n FROM asked JOIN docs USING (url) WHERE NOT is_index),
good AS (SELECT site, loc, min((k, n)) AS place FROM locs WHERE coalesce({duck.url_score('loc', 'site')} >= 4, false) GROUP BY site, loc),
ranked AS (SELECT site, loc, row_number() OVER (PARTITION BY site ORDER BY place)::INT AS rank FROM good)
SELECT * FROM ranked{'' if limit is None else f' WHERE rank <= {limit}'}"""


@registered("sitemap_products", _walked(None, None))
def sitemap_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole walks, 50 levels deep, through cycles and missing files."""
    return discovery.sitemap_products(view(spark, sf_dir, SITES), _fetched(spark, sf_dir))


@registered("sitemap_budget", _walked(20, 6))
def sitemap_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 20 documents a site are asked for, and the first six products are taken."""
    return discovery.sitemap_products(view(spark, sf_dir, SITES), _fetched(spark, sf_dir), documents=20, limit=6)


#: Products of feeds by brand, ten to a page; of some feeds a page in the middle is short, of some one is missing.
_PAGED = """
SELECT p_brand AS feed, p_partkey AS id, p_name AS title, cast(floor((place - 1) / 10) AS int) + 1 AS page
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place, cast(regexp_extract(p_brand, '[0-9]+', 0) AS int) AS a FROM part)
WHERE NOT (a % 3 = 1 AND place BETWEEN 21 AND 24) AND NOT (a % 4 = 2 AND place BETWEEN 10 * (a % 3) + 1 AND 10 * (a % 3) + 10)
"""


@registered("feed_pages", f"""WITH p AS ({_PAGED}), n AS (SELECT feed, page, count(*) AS n FROM p GROUP BY feed, page),
s AS (SELECT feed, page FROM n WHERE page <= 4 AND page <= coalesce((SELECT min(page) FROM n m WHERE m.feed = n.feed AND m.n < 10), 999) AND (SELECT count(*) FROM n m WHERE m.feed = n.feed AND m.page <= n.page) = page)
SELECT feed, id, title FROM p JOIN s USING (feed, page)""")
def feed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of different lengths in one landing place, each cut at its own first short or missing page, and after four."""
    path = scratch_path(spark, "feeds")
    rows = view(spark, sf_dir, _PAGED)
    products = F.collect_list(F.struct("id", "title")).alias("products")
    rows.groupBy("feed", "page").agg(products).write.json(path)
    return sources.read_product_feed(spark, path, max_pages=4, page_size=10, multi_line=False).select("feed", "id", "title")
