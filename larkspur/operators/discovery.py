"""Discovery over page snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from larkspur.functions import fixed, urls
from larkspur.functions.core import collapse, let, strip, text
from larkspur.scratch import scratch_path, stored

_ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>|<option\b[^>]*?\bvalue\s*=\s*["']([^"']*)["'][^>]*>(.*?)</option>"""
_NUMERIC = "&#(?:[xX][0-9a-fA-F]+|[0-9]+);"
#: Named entities.
ENTITIES = [("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")]


def decoded(c: Column) -> Column:
    """Numeric entities (decimal or hexadecimal, any code point) and named ones as characters; numbers beyond Unicode stay."""

    def char(e: Column) -> Column:
        digits = F.regexp_extract(e, r"[0-9a-fA-F]+", 0)
        hexadecimal = e.rlike("^&#[xX]")
        point = F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 7, F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("long"))
        valid = (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(e)

    def all_of(x: Column) -> Column:
        made = F.transform(F.regexp_extract_all(x, F.lit(_NUMERIC), 0), char)
        return F.array_join(F.zip_with(F.split(x, _NUMERIC, -1), made, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")

    c = F.when(F.contains(c, F.lit("&#")), let(c, all_of)).otherwise(c)
    for name, by in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(by))
    return c


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Page columns (but html) with pos, href (absolute) and said (the link's text) of each anchor and option; page-internal and script links are left out."""
    found = pages.select(*[c for c in pages.columns if c != html], F.posexplode(F.regexp_extract_all(text(F.col(html)), F.lit(_ANCHOR), 0)).alias("pos", "tag"))
    raw = strip(F.coalesce(F.nullif(F.regexp_extract("tag", _ANCHOR, 1), F.lit("")), F.regexp_extract("tag", _ANCHOR, 3)))
    said = collapse(decoded(F.regexp_replace(F.concat(F.regexp_extract("tag", _ANCHOR, 2), F.regexp_extract("tag", _ANCHOR, 4)), "<[^>]*>", " ")))
    out = found.withColumns({"raw": raw, "said": said}).filter("raw <> '' and not raw rlike '(?i)^(#|mailto:|tel:|javascript:)'")
    return out.withColumn("href", urls.absolute_url(decoded(F.col("raw")), F.col(url))).drop("raw", "tag")


def product_links(pages: DataFrame, id: str = "page_id", url: str = "url", fallback: bool = True) -> DataFrame:
    """Per page the product-like URLs (score 4 or more), ranked by score and URL; pages without any try URLs in their text."""
    scored = links(pages).select(id, urls.canonical_url(F.col("href")).alias("href"), urls.product_url_score(F.col("href"), F.col(url)).alias("score"))
    best = scored.filter("score >= 4").groupBy(id, "href").agg(F.max("score").alias("score"))
    if fallback:
        bare = pages.join(best.select(id).distinct(), id, "left_anti")
        quoted = F.regexp_extract_all(text(F.col("html")), F.lit(r"""["'](https?://[^"'\s<>]+|/[^"'\s<>]+)["']"""), 1)
        more = bare.select(id, url, F.explode(quoted).alias("raw")).select(id, url, urls.canonical_url(urls.absolute_url(F.replace("raw", F.lit("\\/"), F.lit("/")), F.col(url))).alias("href"))
        best = best.unionByName(more.select(id, "href", urls.product_url_score(F.col("href"), F.col(url)).alias("score")).filter("score >= 4").groupBy(id, "href").agg(F.max("score").alias("score")))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(id).orderBy(F.col("score").desc(), "href")))


def robots_sitemaps(robots: Column) -> Column:
    """The sitemap lines of a robots file."""
    return F.transform(F.regexp_extract_all(text(robots), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1), strip)


def sitemap_locs(xml: Column) -> Column:
    """The locs of a sitemap, CDATA stripped."""
    return F.transform(F.regexp_extract_all(text(xml), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1), lambda u: strip(decoded(F.regexp_replace(u, r"(?s)^<!\[CDATA\[\s*|\s*\]\]>$", ""))))


def is_sitemap_index(xml: Column) -> Column:
    return text(xml).rlike(r"(?i)<sitemapindex\b")


def is_xml(body: Column, content_type: Column) -> Column:
    return F.contains(F.lower(text(content_type)), F.lit("xml")) | text(body).rlike(r"(?is)^\s*<\?xml|<(?:urlset|sitemapindex)\b")


#: Where a site's sitemaps stand if its robots file names none.
DEFAULT_SITEMAPS = ("/sitemap.xml", "/sitemap_index.xml")


def sitemap_walk(sites: DataFrame, fetched: DataFrame, documents: int | None = None) -> DataFrame:
    """Site, url, way and level of each document that a breadth-first walk over a site's sitemaps asks for.

    sites: site, robots; fetched: url, body. A walk begins with the sitemaps of the robots file and the default ones and
    follows indexes until no new document turns up, however deep; cycles end, as each document is asked for once a
    site. `way` holds the position in each index on the way (the earliest way counts), so (level, way) is the order of
    the walk. Documents that weren't fetched or aren't XML are asked for like others. With `documents` a site's walk
    ends after so many, in that order. A null site or robots file counts as having no sitemaps of its own.

    Each level is stored once and joined with the links of indexes, which are read from the bodies once; the level
    after it holds only documents that no level has yet. The loop ends with the first empty level. Of a level only its
    keys are broadcast, if their bytes are few, to pick what they meet out of links and earlier levels; the rest is joined
    by a shuffle of what was picked. Stored tables are a fraction of their rows' size, so by their files all earlier
    levels would be broadcast, through the driver, level after level.
    """
    spark = sites.sparkSession
    body = F.col("body")
    indexes = fetched.filter(is_xml(body, F.lit("")) & is_sitemap_index(body))
    links_of = stored(indexes.select(F.col("url").alias("from"), F.posexplode(sitemap_locs(body)).alias("at", "url")).filter("url <> ''").distinct(), "sitemap-links")
    default = F.array(*[F.concat("site", F.lit(p)) for p in DEFAULT_SITEMAPS])
    start = sites.filter("site is not null").groupBy("site").agg(F.max("robots").alias("robots"))
    front = start.select("site", F.posexplode(F.array_distinct(F.concat(robots_sitemaps(F.col("robots")), default))).alias("at", "url"))
    front = front.select("site", "url", F.array("at").alias("way"))
    root, level = scratch_path(spark, "sitemap-walk"), 0
    shape = "site string, url string, way array<int>"
    while True:
        if documents is not None:
            place = F.row_number().over(Window.partitionBy("site").orderBy("way"))
            front = front.withColumn("k", place).filter(F.col("k") <= documents)
            if level:
                spent = spark.read.schema(f"{shape}, level int").parquet(root).groupBy("site").agg(F.count(F.lit(1)).alias("n"))
                front = front.join(spent.hint("merge"), "site").filter(F.col("k") + F.col("n") <= documents)
        bytes_of = _kept(front, f"{root}/level={level}")
        walked = spark.read.schema(f"{shape}, level int").parquet(root)
        if not bytes_of:
            return walked
        now = spark.read.schema(shape).parquet(f"{root}/level={level}").withColumnRenamed("url", "from")
        met = links_of.join(_narrow(now.select("from"), bytes_of), "from", "left_semi")
        reached = now.join(met.hint("merge"), "from").groupBy("site", "url").agg(F.min(F.concat("way", F.array("at"))).alias("way"))
        path = scratch_path(spark, "sitemap-reached")
        bytes_of = _kept(reached, path)
        reached = spark.read.schema(shape).parquet(path)
        seen = walked.select("site", "url").join(_narrow(reached.select("site", "url"), bytes_of), ["site", "url"], "left_semi")
        front = reached.join(seen.hint("merge"), ["site", "url"], "left_anti")
        level += 1


#: Bytes of a level's keys up to which they are broadcast; low, as each level's pass through the driver.
LEVEL_BYTES = 8 << 20


def _kept(front: DataFrame, path: str) -> int:
    """Writes site, url and way, and tells how many bytes the first two take (0: there are no rows)."""
    held = Observation()
    size = F.octet_length("site") + F.octet_length("url") + 16
    front.select("site", "url", "way").observe(held, F.coalesce(F.sum(size.cast("long")), F.lit(0)).alias("n")).write.parquet(path)
    return held.get["n"]


def _narrow(keys: DataFrame, size: int) -> DataFrame:
    """The keys of a level with the hint for the join that picks what they meet out of larger tables."""
    return F.broadcast(keys) if size <= LEVEL_BYTES else keys.hint("merge")


def sitemap_products(sites: DataFrame, fetched: DataFrame, documents: int | None = None, limit: int | None = None) -> DataFrame:
    """Site, loc and rank of the product-like http locs of each site's sitemaps, in the order of sitemap_walk; with `limit` the first so many a site."""
    body = F.col("body")
    pages = fetched.filter(is_xml(body, F.lit("")) & ~is_sitemap_index(body)).select("url", F.posexplode(sitemap_locs(body)).alias("at", "loc"))
    locs = sitemap_walk(sites, fetched, documents).join(pages.hint("merge"), "url")
    good = locs.filter(urls.is_http(F.col("loc")) & urls.is_product_url(F.col("loc"), F.col("site"))).groupBy("site", "loc").agg(F.min(F.struct("level", "way", "at")).alias("first"))
    ranked = good.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("first", "loc")))
    return ranked.filter(F.lit(True) if limit is None else F.col("rank") <= limit).select("site", "loc", "rank")


#: What a page says that asks for the visitor's country.
SELECTOR_PHRASE = r"(?i)select your country|hello,\s*please select your country|choose your country"


def _brand(url: Column) -> Column:
    return F.regexp_extract(urls.host(url), r"([^.]+)\.[^.]+$", 1)


def selector_pages(pages: DataFrame) -> DataFrame:
    """U8: page_id and selector: whether a page asks for the country, in words or by four or more links within its brand."""
    own = links(pages).filter((_brand(F.col("href")) == _brand(F.col("url"))) & ~urls.path(F.col("href")).rlike(fixed.STATIC_FILE))
    counts = own.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return pages.join(counts, "page_id", "left").select("page_id", (text(F.col("html")).rlike(SELECTOR_PHRASE) | F.coalesce(F.col("n") >= 4, F.lit(False))).alias("selector"))


def storefront(pages: DataFrame, market: str, least: int = 4) -> DataFrame:
    """U8: per selector page the link to the market's store, if its words score `least` or more: 5 for each word in the link's text, 4 in the host, 2 in the path, 1 for another host and 1 for a path; the first of equals."""
    words = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    host, path = urls.host(F.col("href")), urls.path(F.col("href"))
    score = points(host != urls.host(F.col("url")), 1) + points(~path.isin("", "/"), 1)
    for w in fixed.MARKET_WORDS[market]:
        for c, n in ((F.col("said"), 5), (host, 4), (path, 2)):
            score = score + points(F.contains(words(c), F.lit(f" {w} ")), n)
    own = links(pages).filter((_brand(F.col("href")) == _brand(F.col("url"))) & ~urls.path(F.col("href")).rlike(fixed.STATIC_FILE)).withColumn("score", score)
    best = own.filter(F.col("score") >= least).groupBy("page_id").agg(F.max_by("href", F.struct("score", -F.col("pos"))).alias("href"))
    return best.join(selector_pages(pages).filter("selector"), "page_id", "left_semi")


def page_events(pages: DataFrame) -> DataFrame:
    """What a crawl saw of each page: site, how it leads to products (seed_page: it is one itself; links: it links to some), who blocked it, and whether it asks for the country."""
    linked = product_links(pages).select("page_id").distinct().withColumn("linked", F.lit(True))
    no_headers = F.create_map().cast("map<string,string>")
    own = urls.is_product_url(F.col("url"), F.col("url"))
    rows = pages.join(linked, "page_id", "left").join(selector_pages(pages), "page_id")
    return rows.select(
        urls.host(F.col("url")).alias("site"), F.when(own, "seed_page").otherwise("links").alias("strategy"), (own | F.coalesce("linked", F.lit(False))).alias("product"),
        urls.block_provider(F.lit(200), no_headers, F.lit(""), F.col("html")).alias("block"), F.lower(text(F.col("html"))).rlike(fixed.PRODUCT_TYPE).alias("schema"), "selector",
    )


def sitemap_events(sites: DataFrame, fetched: DataFrame) -> DataFrame:
    """What a crawl's sitemaps say of each site: whether they list products, and whether none could be read as XML."""
    found = sitemap_products(sites, fetched).select("site").distinct().withColumn("product", F.lit(True))
    default = F.array(*[F.concat("site", F.lit(p)) for p in DEFAULT_SITEMAPS])
    asked = sites.select("site", F.explode(F.concat(robots_sitemaps(F.col("robots")), default)).alias("url")).join(fetched, "url")
    alive = asked.filter(is_xml(F.col("body"), F.lit(""))).select("site").distinct().withColumn("alive", F.lit(True))
    out = sites.join(found, "site", "left").join(alive, "site", "left")
    return out.select(urls.host(F.col("site")).alias("site"), F.coalesce("product", F.lit(False)).alias("sitemap_product"), F.col("alive").isNull().alias("dead_sitemap"))


def outcomes(events: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """Per site the strategy (seed page, sitemap or links, the first that found a product) and the failure: without products bot_challenge, non_storefront_root, dead_sitemap or no_product_urls, in this order; with products, product_schema_missing if no page has the markup."""
    found = lambda s: F.bool_or((F.col("strategy") == s) & F.col("product"))
    per = events.groupBy("site").agg(found("seed_page").alias("seed"), found("links").alias("links"), F.bool_or(F.col("block").isNotNull()).alias("blocked"), F.bool_or("schema").alias("schema"), F.bool_or("selector").alias("selector"), F.count(F.lit(1)).alias("n_pages"))
    per = per.join(sitemaps, "site", "left").withColumns({"sitemap_product": F.coalesce("sitemap_product", F.lit(False)), "dead_sitemap": F.coalesce("dead_sitemap", F.lit(True))})
    strategy = F.when(F.col("seed"), "seed_page").when(F.col("sitemap_product"), "sitemap").when(F.col("links"), "links").otherwise("none")
    failure = F.when(strategy != "none", F.when(F.col("schema"), "none").otherwise("product_schema_missing")).when(F.col("blocked"), "bot_challenge").when(F.col("selector"), "non_storefront_root").when(F.col("dead_sitemap"), "dead_sitemap").otherwise("no_product_urls")
    return per.select("site", strategy.alias("strategy"), failure.alias("failure"), "n_pages")


def crawl_report(sites: DataFrame) -> DataFrame:
    """Sites, and their share, per strategy and failure."""
    per = sites.groupBy("strategy", "failure").agg(F.count(F.lit(1)).alias("n_sites"), F.sum("n_pages").alias("n_pages"))
    return per.withColumn("share", F.round(F.col("n_sites") / F.sum("n_sites").over(Window.partitionBy(F.lit(1))), 4))
