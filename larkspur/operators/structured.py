"""Structured data of pages: signals, JSON-LD objects, and the offers and products in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import prices, urls
from larkspur.functions.core import collapse, let, strip, text
from larkspur.functions.ingredient_text import choose_overview, html_to_text
from larkspur.operators.discovery import decoded
from larkspur.operators.offers import normalized
from larkspur.scratch import stored

_SCRIPT = r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
#: What makes an image no picture of the product.
NO_IMAGE = r"(?i)(placeholder\.svg|/favicon|/apple-touch-icon|/logo(?:[._/-]|$)|/sprite(?:[._/-]|$)|tracking|teads\.tv)"
#: Where an object holds its image, and where further ones.
IMAGE_KEYS = ["url", "src", "contentUrl", "contentURL", "secureUrl", "secure_url"]
NESTED_KEYS = ["thumbnail", "primaryImage", "image", "images"]


# ---------------------------------------------------------------- page signals


def _meta(html: Column, *keys: str) -> Column:
    """The content of the first meta element of one of the keys, in their order."""
    found = [F.nullif(strip(decoded(F.regexp_extract(html, rf"""(?is)<meta\b(?=[^>]*\b(?:property|name|itemprop)\s*=\s*["']{k}["'])[^>]*\bcontent\s*=\s*["']([^"']*)["']""", 1))), F.lit("")) for k in keys]
    return F.coalesce(*found)


def _inner(html: Column, tag: str) -> Column:
    return F.nullif(collapse(decoded(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", " "))), F.lit(""))


def _marked_texts(html: Column, mark: str, most: int) -> Column:
    """Of the first elements with an attribute like `mark`: their content, data-price or text up to the next tag."""
    pick = lambda e: F.coalesce(*[F.nullif(strip(decoded(F.regexp_extract(e, p, 1))), F.lit("")) for p in (r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", r"""(?is)\bdata-price\s*=\s*["']([^"']*)["']""", r"(?is)^<[^>]*>([^<]*)")])
    elements = F.slice(F.regexp_extract_all(html, F.lit(rf"(?is)<[a-z][^>]*\b{mark}[^>]*>[^<]*"), 0), 1, most)
    return F.filter(F.transform(elements, pick), lambda t: t.isNotNull())


def signals(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """C14: page columns (but html) with title, canonical, meta_description, details, price_texts, meta_currencies, images and dom_variants (of a data-product-skus-value attribute).

    Elements are found by patterns over the page's text, so an element's text ends at the next tag.
    """
    h = text(F.col(html))
    amounts = F.array(_meta(h, "og:price:amount"), _meta(h, "product:price:amount"))
    price_texts = F.concat(_marked_texts(h, r"""itemprop\s*=\s*["']price["']""", 5), F.filter(amounts, lambda t: t.isNotNull()), _marked_texts(h, r"""class\s*=\s*["'][^"']*price""", 5), _marked_texts(h, r"data-price\s*=", 5))
    hidden = F.regexp_extract(h, r"""(?is)<[^>]*\bid\s*=\s*["']overview-about-text["'][^>]*\bvalue\s*=\s*["']([^"']*)["']""", 1)
    about = F.regexp_extract(h, r"""(?is)<div[^>]*\bclass\s*=\s*["'][^"']*more-about-product-content[^"']*["'][^>]*>(.*?)</div>""", 1)
    details = F.coalesce(html_to_text(F.when(hidden != "", decoded(F.coalesce(F.try_url_decode(hidden), hidden)))), html_to_text(F.when(about != "", about)))
    attribute = r"""(?is)\b(?:data-src|zoom-src|data-zoom-src|data-zoom-image|data-large-image|srcset|src)\s*=\s*["']([^"']*)["']"""
    pictures = F.concat(F.filter(F.array(_meta(h, "og:image"), _meta(h, "twitter:image")), lambda u: u.isNotNull()), F.flatten(F.transform(F.regexp_extract_all(h, F.lit(r"(?is)<img\b[^>]*>"), 0), lambda t: F.regexp_extract_all(t, F.lit(attribute), 1))))
    skus = F.try_parse_json(decoded(F.regexp_extract(h, r"""(?is)\bdata-product-skus-value\s*=\s*["']([^"']*)["']""", 1)))
    return pages.withColumns({
        "title": F.coalesce(_inner(h, "h1"), _meta(h, "og:title"), _inner(h, "title"), F.lit("")),
        "canonical": _link(F.coalesce(F.nullif(decoded(F.regexp_extract(h, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']canonical["'])[^>]*\bhref\s*=\s*["']([^"']*)["']""", 1)), F.lit("")), _meta(h, "og:url"), F.col(url)), F.col(url)),
        "meta_description": _meta(h, "description", "og:description"), "details": details, "price_texts": price_texts,
        "meta_currencies": F.filter(F.array(_meta(h, "og:price:currency"), _meta(h, "product:price:currency"), _meta(h, "priceCurrency")), lambda c: c.isNotNull()),
        "images": image_list(F.transform(pictures, lambda u: _absolute(u, F.col(url)))), "dom_variants": skus,
    }).drop(html)


def _joined(href: Column, base: Column) -> Column:
    """href, worked out once, against the page's URL."""
    return let(href, lambda h: urls.absolute_url(h, base))


def _link(href: Column, base: Column) -> Column:
    """The same in its canonical form."""
    return let(_joined(href, base), urls.canonical_url)


def _absolute(u: Column, base: Column) -> Column:
    return _joined(F.regexp_extract(strip(text(u)), r"^[^\s,]+", 0), base)


def image_list(images: Column) -> Column:
    """C10, of an array of texts: absolute http URLs, the first of a source set, no placeholders or logos, distinct in order."""
    first = F.transform(F.coalesce(images, F.array().cast("array<string>")), lambda u: F.regexp_extract(strip(text(u)), r"^[^\s,]+", 0))
    return F.array_distinct(F.filter(first, lambda u: u.rlike("(?i)^https?://") & ~u.rlike(NO_IMAGE)))


def image_urls(v: Column, base: Column, levels: int = 2) -> Column:
    """C10, of a variant: texts, arrays and objects that hold images or further such values, `levels` deep, in order."""

    def flat(x: Column, depth: int) -> Column:
        said = F.try_variant_get(x, "$", "string")
        own = F.when(F.schema_of_variant(x) == "STRING", F.array(said)).otherwise(F.array().cast("array<string>"))
        if depth == 0:
            return own
        many = F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>"))
        inner = lambda k: F.try_variant_get(x, f"$.{k}", "variant")
        held = F.concat(*[_one(inner(k)) for k in IMAGE_KEYS], *[let(inner(k), lambda y: F.when(y.isNull(), F.array().cast("array<string>")).otherwise(flat(y, depth - 1))) for k in NESTED_KEYS])
        return F.when(F.size(many) > 0, F.flatten(F.transform(many, lambda y: flat(y, depth - 1)))).when(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), held).otherwise(own)

    empty = F.array().cast("array<string>")
    return F.when(v.isNull(), empty).otherwise(image_list(F.transform(F.coalesce(flat(v, levels), empty), lambda u: _absolute(u, base))))


def _one(v: Column) -> Column:
    return F.filter(F.array(F.try_variant_get(v, "$", "string")), lambda u: u.isNotNull())


# ---------------------------------------------------------------- JSON-LD


def _get(v: Column, path: str) -> Column:
    return F.nullif(strip(F.try_variant_get(v, path, "string")), F.lit(""))


def _objects(v: Column) -> Column:
    """The objects of a variant: itself, or an array's."""
    return F.filter(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)), lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))


def _offers(v: Column) -> Column:
    """The offers of an object; one that nests offers stands for these."""
    inner = lambda o: let(_objects(F.try_variant_get(o, "$.offers", "variant")), lambda n: F.when(F.size(n) > 0, n).otherwise(F.array(o)))
    return F.flatten(F.transform(_objects(F.try_variant_get(v, "$.offers", "variant")), inner))


def jsonld(pages: DataFrame) -> DataFrame:
    """Page columns (but html) with at (its place in the page) and v, one row per JSON-LD object; arrays and @graph flattened, bad JSON dropped."""
    scripts = pages.select(*[c for c in pages.columns if c != "html"], F.posexplode(F.regexp_extract_all(text(F.col("html")), F.lit(_SCRIPT), 1)).alias("script", "s"))
    found = scripts.withColumn("v", F.try_parse_json("s")).drop("s").filter("v is not null")
    keep = [c for c in found.columns if c not in ("script", "v")]
    found = found.select(*keep, "script", F.posexplode(_objects(F.col("v"))).alias("item", "v"))
    graph = F.when(F.startswith(F.schema_of_variant(F.try_variant_get("v", '$["@graph"]', "variant")), F.lit("ARRAY")), _objects(F.try_variant_get("v", '$["@graph"]', "variant"))).otherwise(F.array("v"))
    return found.select(*keep, "script", "item", F.posexplode(graph).alias("node", "v")).select(*keep, F.array("script", "item", "node").alias("at"), "v")


def is_type(name: str, v: Column | None = None) -> Column:
    v = F.col("v") if v is None else v
    return F.coalesce(F.try_variant_get(v, '$["@type"]', "string") == name, F.lit(False)) | F.coalesce(F.array_contains(F.try_variant_get(v, '$["@type"]', "array<string>"), name), F.lit(False))


def _fit(v: Column, page: Column, canonical: Column) -> Column:
    """How well an object's URLs fit the page's: equal (120), of one path (90), of one locale (20) or of another (-25)."""
    own = F.array_distinct(F.filter(F.concat(F.array(_get(v, "$.url"), _get(v, '$["@id"]')), F.transform(_offers(v), lambda o: _get(o, "$.url"))), lambda u: u.isNotNull()))
    locale = lambda c: F.lower(F.regexp_extract(urls.path(c), "^/+([A-Za-z]{2}(?:-[A-Za-z]{2})?)(?:/|$)", 1))

    def points(u: Column, p: Column) -> Column:
        known = (locale(u) != "") & (locale(p) != "")
        same = (urls.host(u) == urls.host(p)) & (urls.path(u) == urls.path(p))
        return F.when(u == p, 120).otherwise(0) + F.when(same, 90).otherwise(0) + F.when(known & (locale(u) == locale(p)), 20).when(known, -25).otherwise(0)

    total = lambda u: F.aggregate(F.array_distinct(F.array(canonical, page)), F.lit(0), lambda a, p: a + points(u, p))
    return F.aggregate(F.transform(own, lambda u: _link(u, page)), F.lit(0), lambda a, u: a + total(u))


def best_object(pages: DataFrame, types: tuple[str, ...] = ("Product", "ProductGroup")) -> DataFrame:
    """Per page the object of the types whose URLs fit best, of equals the first in the page. Adds url_match."""
    kind = is_type(types[0])
    for t in types[1:]:
        kind = kind | is_type(t)
    canonical = signals(pages).select("page_id", F.col("canonical").alias("__canonical"))
    objects = jsonld(pages).filter(kind).join(canonical, "page_id")
    ranked = objects.withColumn("url_match", _fit(F.col("v"), urls.canonical_url(F.col("url")), F.col("__canonical")))
    return ranked.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("url_match").desc(), "at"))).filter("k = 1").drop("k", "at", "__canonical")


def _read_pages(pages: DataFrame, by_fit: bool) -> DataFrame:
    """Per page its signals, group (the first ProductGroup), variants (array of its Products), primary (the first Product, else the first variant, else the group) and whether it looks like a product page. by_fit: first by C12."""
    seen = signals(pages).join(pages.select("page_id", urls.looks_like_product_page(F.col("html")).alias("looks")), "page_id")
    objects = jsonld(pages).select("page_id", "url", "at", "v").join(seen.select("page_id", "canonical"), "page_id")
    fit = _fit(F.col("v"), urls.canonical_url(F.col("url")), F.col("canonical")) if by_fit else F.lit(0)
    ranked = objects.withColumns({"product": is_type("Product"), "group": is_type("ProductGroup"), "fit": fit}).filter("product or group")
    order = Window.partitionBy("page_id", "product").orderBy(F.col("fit").desc(), "at")
    first = ranked.withColumn("k", F.row_number().over(order)).filter("k = 1")
    product = first.filter("product").select("page_id", F.col("v").alias("own"))
    group = first.filter("not product").select("page_id", F.col("v").alias("group"))
    out = seen.join(product, "page_id", "left").join(group, "page_id", "left")
    variants = F.filter(_objects(F.try_variant_get("group", "$.hasVariant", "variant")), lambda v: is_type("Product", v))
    out = out.withColumn("variants", F.when(F.col("group").isNotNull(), variants).otherwise(F.array().cast("array<variant>"))).withColumn("primary", F.coalesce("own", F.try_element_at("variants", F.lit(1)), "group")).drop("own")
    return stored(out, "pages-read")  # read three times, for the three kinds of pages


def _price(o: Column) -> Column:
    return F.coalesce(_get(o, "$.price"), _get(o, "$.priceSpecification.price"), _get(o, "$.priceSpecification.priceSpecification.price"))


def _shown_price(o: Column) -> Column:
    """A number with two decimals, a text as it is."""

    def shown(x: Column) -> Column:
        return F.when(F.schema_of_variant(x) == "STRING", F.nullif(strip(F.try_variant_get(x, "$", "string")), F.lit(""))).otherwise(F.format_string("%.2f", F.try_variant_get(x, "$", "double")))

    held = [F.try_variant_get(o, p, "variant") for p in ("$.price", "$.priceSpecification.price", "$.priceSpecification.priceSpecification.price")]
    return F.coalesce(*[F.when(x.isNotNull() & (F.schema_of_variant(x) != "VOID"), shown(x)) for x in held])


def _currency(o: Column) -> Column:
    return F.coalesce(_get(o, "$.priceCurrency"), _get(o, "$.priceSpecification.priceCurrency"), _get(o, "$.priceSpecification.priceSpecification.priceCurrency"))


def _branches(read: DataFrame) -> DataFrame:
    """A row per variant of a group of several (item, offer: its first), else per offer of the primary object, else one per page of a product or of what looks like one."""
    offers = F.when(F.col("primary").isNotNull(), _offers(F.col("primary"))).otherwise(F.array().cast("array<variant>"))
    read = read.withColumn("offers", offers)
    none = F.lit(None).cast("variant")
    several = read.filter(F.size("variants") > 1).select("*", F.posexplode("variants").alias("n", "item")).withColumn("offer", F.try_element_at(_offers(F.col("item")), F.lit(1)))
    single = read.filter((F.size("variants") <= 1) & (F.size("offers") > 0)).select("*", F.posexplode("offers").alias("n", "offer")).withColumn("item", none)
    bare = read.filter((F.size("variants") <= 1) & (F.size("offers") == 0) & (F.col("primary").isNotNull() | F.col("looks"))).withColumns({"n": F.lit(0), "item": none, "offer": none})
    return several.unionByName(single).unionByName(bare)


def page_offers(pages: DataFrame, site: str, market: str) -> DataFrame:
    """The normalised offers of pages (page_id, url, html): one per variant of a group of several, else one per offer of the product, else one of the page's visible price if the page is a product's, else none."""
    v, item, offer = F.col("primary"), F.col("item"), F.col("offer")
    rows = _branches(_read_pages(pages, by_fit=False))
    rows = rows.withColumn("home", _link(F.coalesce(_get(v, "$.url"), F.col("canonical")), F.col("url")))
    home = F.col("home")
    title = F.coalesce(_get(F.col("group"), "$.name"), _get(v, "$.name"), F.nullif("title", F.lit("")))
    sku = F.coalesce(*[_get(x, p) for x, p in ((item, "$.sku"), (item, "$.mpn"), (offer, "$.sku"))], F.when(item.isNull() & offer.isNotNull(), F.coalesce(_get(v, "$.sku"), _get(v, "$.mpn"))))
    stands_for_sku = F.coalesce(sku, F.when(offer.isNotNull() & item.isNull(), F.concat(F.lit("AUTO-"), prices.short_hash(F.concat_ws("|", home, "n")))).when(item.isNull(), title))
    own_url = F.when(item.isNotNull(), _link(F.coalesce(_get(offer, "$.url"), _get(item, "$.url"), home), F.col("url"))).otherwise(home)
    overview = choose_overview(F.coalesce(_get(v, "$.description"), _get(F.col("group"), "$.description")), F.col("details"), F.col("meta_description"))
    raw = rows.select(
        "page_id", "n", F.lit(site).alias("source_site"), F.coalesce(_get(v, "$.productID"), _get(v, "$.sku")).alias("site_product_id"), home.alias("url_canonical"), own_url.alias("offer_url"), title.alias("product_title"),
        F.coalesce(html_to_text(_get(item, "$.description")), overview).alias("product_description"), stands_for_sku.alias("variant_sku"), sku.alias("sku"), F.lit(market).alias("market_id"),
        F.coalesce(_price(offer), F.try_element_at("price_texts", F.lit(1))).alias("price_display_raw"), _currency(offer).alias("structured_currency"), "meta_currencies", _get(offer, "$.availability").alias("raw_availability"),
    )
    return normalized(stored(raw, "offers-read")).withColumns({"variant_sku": F.col("sku"), "url_canonical": F.col("offer_url")}).drop("sku", "offer_url", "meta_currencies")


def page_products(pages: DataFrame, currency: str = "USD") -> DataFrame:
    """The variants of pages, by the objects that fit the page best (C12): ids, options, prices, stock and images; what the page's own list of variants says is joined by sku."""
    v, item, offer = F.col("primary"), F.col("item"), F.col("offer")
    rows = _branches(_read_pages(pages, by_fit=True))
    rows = rows.withColumn("home", _link(F.coalesce("canonical", _get(v, "$.url")), F.col("url")))
    home = F.col("home")
    title = F.coalesce(_get(F.col("group"), "$.name"), _get(v, "$.name"), F.col("title"))
    auto = F.concat(F.lit("AUTO-"), prices.short_hash(F.concat_ws("|", home, "n")))
    sku = F.coalesce(_get(item, "$.sku"), _get(item, "$.mpn"), _get(offer, "$.sku"), F.when(item.isNull() & offer.isNotNull(), F.coalesce(_get(v, "$.sku"), _get(v, "$.mpn"))), F.when(item.isNull() & offer.isNull(), F.concat(F.lit("AUTO-"), F.substring(prices.short_hash(home), 1, 8))), auto)
    rows = rows.withColumns({"product_title": title, "sku": sku})
    known = F.filter(_objects(F.col("dom_variants")), lambda d: F.coalesce(_get(d, "$.id"), _get(d, "$.sku")) == F.col("sku"))
    rows = rows.withColumn("dom", F.try_element_at(known, F.lit(-1)))
    dom = F.col("dom")
    shade = F.coalesce(_get(dom, "$.shades[0].title"), _get(dom, "$.multi_shade_description"))
    kind, said = F.when(_get(dom, "$.size").isNotNull(), "Size").when(shade.isNotNull(), "Shade"), F.coalesce(_get(dom, "$.size"), shade)
    named = F.nullif(prices.title_suffix(F.col("product_title"), text(_get(item, "$.name"))), F.lit(""))
    value = F.when(item.isNotNull(), F.coalesce(_get(item, "$.color"), named, said, _get(item, "$.name"), F.col("sku"))).when(offer.isNotNull(), F.coalesce(_get(offer, "$.name"), _get(offer, "$.description"), said, F.col("sku"))).otherwise("Default")
    price = F.coalesce(_shown_price(offer), F.when(item.isNull(), _shown_price(dom)), F.when(item.isNotNull() | offer.isNull(), F.coalesce(F.try_element_at("price_texts", (F.col("n") + 1).cast("int")), F.try_element_at("price_texts", F.lit(1)))), F.lit("0.00"))
    link = _joined(F.coalesce(F.when(item.isNull(), _get(dom, "$.localized_path")), _get(offer, "$.url"), F.when(item.isNotNull(), _get(item, "$.url")), F.col("home")), F.col("url"))
    pictures = F.array_distinct(F.concat(image_urls(F.try_variant_get(item, "$.image", "variant"), F.col("url")), image_urls(F.try_variant_get(offer, "$.image", "variant"), F.col("url")), image_urls(F.try_variant_get(dom, "$.images", "variant"), F.col("url")), image_urls(F.try_variant_get(v, "$.image", "variant"), F.col("url")), image_urls(F.try_variant_get("group", "$.image", "variant"), F.col("url")), F.col("images")))
    stock = F.when(text(_get(offer, "$.availability")).rlike("(?i)OutOfStock"), "Out of Stock").otherwise("In Stock")
    shown = rows.withColumns({"price": price, "option_value": value, "option_name": F.coalesce(kind, F.when(item.isNotNull(), "Variant").otherwise("Offer")), "link": link, "stock": stock, "image_urls": pictures, "single": item.isNull() & offer.isNull()})
    ident = F.when(F.col("single"), prices.short_hash(F.col("home"))).otherwise(prices.short_hash(F.concat_ws("|", "home", "sku", "price")))
    return shown.select("page_id", "n", ident.alias("id"), "sku", "product_title", F.col("home").alias("product_url"), F.col("link").alias("url"), "option_name", "option_value", "price", F.lit(currency).alias("currency"), "stock", "image_urls")
