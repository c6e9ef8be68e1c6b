"""Offers: normalisation, market expansion and quality counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import fixed, prices, urls


def markets(spark: SparkSession) -> DataFrame:
    """A row per market (four, so it may be broadcast)."""
    return spark.createDataFrame(fixed.MARKETS, "market_id string, country string, currency_target string, locale string")


def effective_market(rows: DataFrame, column: str = "market_id") -> DataFrame:
    """P10: the known market or US, with its profile."""
    asked = F.upper(F.trim(F.coalesce(column, F.lit(""))))
    known = F.when(asked.isin([m[0] for m in fixed.MARKETS]), asked).otherwise("US")
    return rows.withColumn(column, known).join(F.broadcast(markets(rows.sparkSession).withColumnRenamed("market_id", column)), column)


def effective_markets(asked: Column) -> Column:
    """P10 of a list: the known markets, distinct in order; US if there are none."""
    codes = F.transform(asked, lambda m: F.upper(F.trim(F.coalesce(m, F.lit("")))))
    known = F.array_distinct(F.filter(codes, lambda m: m.isin([x[0] for x in fixed.MARKETS])))
    return F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("US")))


def normalized(rows: DataFrame) -> DataFrame:
    """O1 to O6 on raw offers (source_site, site_product_id, url_canonical, variant_sku, market_id, price_display_raw, structured_currency, meta_currencies?, raw_availability)."""
    meta = F.col("meta_currencies") if "meta_currencies" in rows.columns else F.array().cast("array<string>")
    out = rows.withColumns({"p": prices.parse_price(F.col("price_display_raw")), "c": prices.resolve_currency(F.col("structured_currency"), meta, F.col("price_display_raw"), F.col("market_id"))})
    out = out.withColumns({
        "price_amount": F.col("p.price_amount"), "price_type": F.col("p.price_type"), "range_min": F.col("p.range_min"), "range_max": F.col("p.range_max"), "price_currency": F.col("c.code"), "currency_confidence": F.col("c.confidence"),
        "market_switch_status": prices.market_switch(F.col("c.code"), prices.market_currency(F.col("market_id"))), "availability": prices.availability(F.col("raw_availability")),
        "source_product_id": prices.source_product_id(F.col("source_site"), F.col("site_product_id"), F.col("url_canonical"), F.col("variant_sku")),
    })
    return out.drop("p", "c")


def expanded(products: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Each product once per requested market, with that market's profile and URL."""
    known = [m for m in fixed.MARKETS if wanted is None or m[0] in wanted] or fixed.MARKETS[:1]
    profiles = F.broadcast(products.sparkSession.createDataFrame(known, "market_id string, country string, currency_target string, locale string"))
    return products.crossJoin(profiles).withColumn("market_url", urls.with_market_params(F.col("url_canonical"), F.col("market_id")))


def site_market_counters(offers: DataFrame, sites: DataFrame | None = None, failed: bool = False) -> DataFrame:
    """Per site and market, in order, the rates of normalised offers; known markets without offers have rates 0 and, for the switch, whether the run failed."""
    rate = lambda cond: F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)), 4)
    made = offers.groupBy("source_site", "market_id").agg(
        F.count(F.lit(1)).alias("total"), rate(F.col("price_currency") == prices.market_currency(F.col("market_id"))).alias("native_currency_rate"), rate(F.col("price_amount").isNotNull()).alias("price_parse_rate"),
        rate(F.col("currency_confidence") == "low").alias("low_confidence_rate"), rate(F.col("market_switch_status").isin("mismatch", "failed")).alias("switch_fail_rate"),
    )
    asked = (sites if sites is not None else offers.select("source_site").distinct()).crossJoin(F.broadcast(markets(offers.sparkSession).select("market_id")))
    out = made.join(asked, ["source_site", "market_id"], "full")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("native_currency_rate", "price_parse_rate", "low_confidence_rate")}
    return out.withColumns({**zero, "switch_fail_rate": F.coalesce("switch_fail_rate", F.lit(1.0 if failed else 0.0)), "total": F.coalesce("total", F.lit(0))}).orderBy("source_site", "market_id")


def feed_offers(feed: DataFrame, site: str, market: str) -> DataFrame:
    """An offer per variant of a product feed."""
    rows = feed.filter(F.coalesce("handle", F.lit("")) != "").select("id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("handle")).alias("product_title"), "handle", F.explode("variants").alias("v"))
    raw = rows.select(
        F.lit(site).alias("source_site"), F.col("id").cast("string").alias("site_product_id"), F.concat(F.lit(f"https://{site}/products/"), F.col("handle")).alias("url_canonical"), "product_title",
        F.coalesce(F.nullif(F.trim("v.sku"), F.lit("")), F.col("v.id").cast("string")).alias("variant_sku"), F.lit(market).alias("market_id"), F.col("v.price").alias("price_display_raw"), F.lit(None).cast("string").alias("structured_currency"),
        F.lit(None).cast("string").alias("raw_availability"), prices.availability_of(F.col("v.available"), F.col("v.inventory_quantity")).alias("feed_availability"),
    )
    return normalized(raw).withColumn("availability", F.col("feed_availability")).drop("feed_availability")
