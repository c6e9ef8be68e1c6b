"""Prices, currencies and stock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.core import let, strip, text


def _number(token: Column) -> Column:
    """One run of digits and separators as a double: the last of two kinds of separators is the decimal one."""

    def value(t: Column) -> Column:
        comma, dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
        dot_last = F.length(F.regexp_extract(t, r"[^.]*$", 0)) < F.length(F.regexp_extract(t, r"[^,]*$", 0))
        no_comma, as_dot = F.replace(t, F.lit(","), F.lit("")), F.replace(t, F.lit(","), F.lit("."))
        both = F.when(dot_last, no_comma).otherwise(F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        plain = F.when(comma & dot, both).when(comma, F.when(t.rlike("^[^,]*,[^,]{1,2}$"), as_dot).otherwise(no_comma)).otherwise(t)
        return F.regexp_extract(plain, r"^[0-9]*\.?[0-9]*", 0).try_cast("double")

    return let(F.regexp_replace(token, r"[\s']", ""), value)


def parse_price(c: Column) -> Column:
    """O1: struct of price_amount, price_type, range_min and range_max."""
    raw = text(c)
    found = F.filter(F.transform(F.regexp_extract_all(raw, F.lit(r"[0-9][0-9.,\s']*"), 0), _number), lambda v: v.isNotNull())

    def parsed(n: Column) -> Column:
        ranged = (F.size(n) >= 2) & raw.rlike(r"(?i)\bto\b|[-–—~]")
        first = F.try_element_at(n, F.lit(1))
        kind = F.when(ranged, "range").when(raw.rlike(r"(?i)\bfrom\b"), "from").when(raw.rlike(r"(?i)\bmember\b"), "member").when(raw.rlike(r"(?i)\bsale\b|\bdiscount\b|\bnow\b"), "sale").when(first.isNotNull(), "list").otherwise("unknown")
        return F.struct(F.when(ranged, F.array_min(n)).otherwise(first).alias("price_amount"), F.when(raw == "", "unknown").otherwise(kind).alias("price_type"), F.when(ranged, F.array_min(n)).alias("range_min"), F.when(ranged, F.array_max(n)).alias("range_max"))

    return let(found, parsed)


def currency_code(c: Column) -> Column:
    return let(F.upper(strip(c)), lambda u: F.when(u.rlike("^[A-Z]{3}$"), u))


def market_currency(market: Column) -> Column:
    """The currency of each market."""
    m = F.upper(text(market))
    return F.when(m == "US", "USD").when(m == "EU-DE", "EUR").when(m == "SG", "SGD").when(m == "JP", "JPY")


def symbol_currency(price: Column, market: Column) -> Column:
    """O3. The currency of each symbol."""
    p = text(price)
    return F.when(p.rlike("€"), "EUR").when(p.rlike("£"), "GBP").when(p.rlike("[$]"), market_currency(market)).when(p.rlike("[¥￥]") & (F.upper(text(market)) == "JP"), "JPY")


def resolve_currency(structured: Column, meta: Column, price: Column, market: Column) -> Column:
    """O2: struct of code and confidence; meta is an array of codes."""
    first_meta = F.try_element_at(F.filter(F.transform(F.coalesce(meta, F.array().cast("array<string>")), currency_code), lambda x: x.isNotNull()), F.lit(1))
    return F.struct(F.coalesce(currency_code(structured), first_meta, symbol_currency(price, market)).alias("code"), F.when(currency_code(structured).isNotNull(), "high").when(first_meta.isNotNull(), "medium").otherwise("low").alias("confidence"))


def market_switch(observed: Column, expected: Column, failed: Column | None = None) -> Column:
    """O4."""
    return F.when(F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False), "failed").when(text(observed) == "", "unknown").when(F.upper(observed) == F.upper(expected), "ok").otherwise("mismatch")


def availability(raw: Column) -> Column:
    """O5, of a schema.org text."""
    return F.when(text(raw) == "", F.lit(None)).when(raw.rlike("(?i)InStock"), "in_stock").when(raw.rlike("(?i)OutOfStock"), "out_of_stock").when(raw.rlike("(?i)PreOrder"), "preorder").otherwise(raw)


def availability_of(available: Column, quantity: Column) -> Column:
    """O5, of a feed's flag and quantity."""
    return F.when(available.eqNullSafe(False) | F.coalesce(quantity <= 0, F.lit(False)), "out_of_stock").when(F.coalesce(quantity <= 10, F.lit(False)), "low_stock").otherwise("in_stock")


def stock_status(available: Column, quantity: Column, low: int = 10) -> Column:
    """C3."""
    return F.when(available.eqNullSafe(False), "Out of Stock").when(F.coalesce((quantity > 0) & (quantity <= low), F.lit(False)), "Low Stock").otherwise("In Stock")


def short_hash(c: Column) -> Column:
    return F.substring(F.sha1(F.encode(c, "UTF-8")), 1, 12)


def source_product_id(site: Column, product_id: Column, url: Column, sku: Column) -> Column:
    """O6."""
    by_url = F.concat(site, F.lit(":"), short_hash(url))
    return F.when(strip(text(product_id)) != "", F.concat(site, F.lit(":"), strip(product_id))).when(strip(text(sku)) != "", F.concat(by_url, F.lit(":"), short_hash(strip(sku)))).otherwise(by_url)


def currency_hint(html: Column, patterns: list[str] | None = None) -> Column:
    """The first valid code that the page shows, by pattern."""
    patterns = patterns or CURRENCY_PATTERNS
    found = [F.nullif(F.regexp_extract(text(html), p, 1), F.lit("")) for p in patterns]
    return F.upper(F.coalesce(*found))


#: Where pages tell their currency, in order.
CURRENCY_PATTERNS = [
    r'(?i)"priceCurrency"\s*:\s*"([A-Za-z]{3})"',
    "(?i)meta[^>]+property=[\"']og:price:currency[\"'][^>]+content=[\"']([A-Za-z]{3})[\"']",
    "(?i)meta[^>]+property=[\"']product:price:currency[\"'][^>]+content=[\"']([A-Za-z]{3})[\"']",
    "(?i)data-currency=[\"']([A-Za-z]{3})[\"']",
    "(?i)cart_currency=([A-Za-z]{3})",
]


#: The same with what some shop systems write, in order.
SHOP_CURRENCY_PATTERNS = [
    *CURRENCY_PATTERNS[:4], r'(?i)Shopify\.currency\s*=\s*\{[^}]*"active"\s*:\s*"([A-Za-z]{3})"', r'(?i)currencyCode"\s*:\s*"([A-Za-z]{3})"',
    r"(?i)window\.ShopifyAnalytics\.meta\.currency\s*=\s*['\"]([A-Za-z]{3})['\"]", CURRENCY_PATTERNS[4],
]


def feed_price(raw: Column, currency: Column) -> Column:
    """C2, of a string: whole numbers are cents unless the currency has none; blank is 0.00."""
    cents = let(strip(text(raw)), lambda t: F.when(t == "", "0.00").when(t.rlike("^-?[0-9]+$") & (F.coalesce(currency, F.lit("USD")) != "JPY"), F.format_string("%.2f", t.try_cast("double") / 100)).otherwise(t))
    return cents


def title_suffix(product: Column, variant: Column) -> Column:
    """The variant's title without the product's before it."""
    rest = strip(F.regexp_replace(strip(F.substring(variant, F.length(product) + 1, F.length(variant))), "^[-–—:|/]+", ""))
    p, v = F.lower(strip(text(product))), F.lower(strip(text(variant)))
    return F.when((p == "") | (v == ""), "").when(~F.startswith(v, p), strip(variant)).otherwise(F.coalesce(F.nullif(rest, F.lit("")), strip(variant)))
