"""Products and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import prices, urls
from larkspur.functions.core import let, strip, text
from larkspur.functions.ingredient_text import html_to_text
from larkspur.operators.structured import image_list, image_urls

#: What may stand between a title and its variant, in order.
DELIMITERS = [" — ", " – ", " - ", " | ", ": "]


def split_title(title: Column) -> Column:
    """C4: struct of base and label at the first delimiter that leaves both; nulls if none does."""

    def of(t: Column) -> Column:
        out = F.struct(F.lit(None).cast("string").alias("base"), F.lit(None).cast("string").alias("label"))
        for d in reversed(DELIMITERS):
            at = F.locate(d, t)
            base, label = strip(F.substring(t, F.lit(1), at - 1)), strip(F.substring(t, at + len(d), F.length(t)))
            out = F.when((at > 1) & (base != "") & (label != ""), F.struct(base.alias("base"), label.alias("label"))).otherwise(out)
        return out

    return let(strip(text(title)), of)


def title_variants(products: DataFrame, feed: str, title: str = "title", share: float = 0.2, single: Column | None = None) -> DataFrame:
    """C4: adds base_title and variant_label to the products whose title splits and that have one default variant (single; all, if not given), in feeds where `share` or more of the products do. Shares are joined, so a large feed isn't brought to one task."""
    s = split_title(F.col(title))
    fits = s["base"].isNotNull() & (F.lit(True) if single is None else F.coalesce(single, F.lit(False)))
    rows = products.withColumn("s", F.when(fits, s))
    shares = rows.groupBy(F.col(feed).alias("__feed")).agg((F.avg(F.when(F.col("s").isNotNull(), 1.0).otherwise(0.0)) >= share).alias("__on"))
    rows = rows.join(shares, F.col(feed).eqNullSafe(F.col("__feed")), "left")
    on = F.col("__on") & F.col("s").isNotNull()
    return rows.withColumns({"base_title": F.when(on, F.col("s.base")).otherwise(F.col(title)), "variant_label": F.when(on, F.col("s.label"))}).drop("s", "__feed", "__on")


def feed_variants(feed: DataFrame, base: str, currency: str = "USD") -> DataFrame:
    """A row per variant of a product feed, with description and images (its own first, then the product's)."""
    at = F.lit(base)
    product_images = F.array_distinct(F.concat(image_urls(F.col("featured_image"), at), image_urls(F.col("images"), at)))
    own = lambda v: F.filter(F.try_variant_get("images", "$", "array<variant>"), lambda i: F.coalesce(F.array_contains(F.try_variant_get(i, "$.variant_ids", "array<bigint>"), v["id"]), F.lit(False)))
    rows = feed.select("id", "title", "handle", "body_html", "options", "images", product_images.alias("product_images"), F.posexplode("variants").alias("pos", "v"))
    options = F.filter(F.array("v.option1", "v.option2", "v.option3"), lambda o: strip(text(o)) != "")
    images = F.array_distinct(F.concat(image_urls(F.col("v.featured_image"), at), F.flatten(F.coalesce(F.transform(own(F.col("v")), lambda i: image_urls(i, at)), F.array().cast("array<array<string>>"))), F.col("product_images")))
    return rows.select(
        F.col("v.id").cast("string").alias("id"), F.coalesce(F.nullif(strip(text(F.col("v.sku"))), F.lit("")), F.concat(F.lit("SHOPIFY-"), F.col("v.id").cast("string"))).alias("sku"), F.col("title").alias("product_title"),
        F.concat(at, F.lit("/products/"), F.col("handle")).alias("product_url"), F.array_join(F.transform("options", lambda o: o["name"]), " / ").alias("option_name"), F.array_join(options, " / ").alias("option_value"),
        prices.feed_price(F.col("v.price"), F.lit(currency)).alias("price"), F.lit(currency).alias("currency"), prices.stock_status(F.col("v.available"), F.col("v.inventory_quantity")).alias("stock"),
        html_to_text(F.col("body_html")).alias("description"), images.alias("image_urls"), "pos",
    )


def ordered_lists(rows: DataFrame, keys: list[str], values: Column, order: Column, name: str) -> DataFrame:
    """keys, name: the distinct values of each key's arrays, in order of their first place (by `order`, then within the array). Equal values are folded before they are gathered, so a key's list is as long as its distinct values."""
    places = rows.select(*keys, order.alias("__order"), F.posexplode(values).alias("__at", "__value"))
    first = places.groupBy(*keys, "__value").agg(F.min(F.struct("__order", "__at")).alias("__first"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__first", "__value"))), lambda x: x["__value"]).alias(name))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's columns, where keys may be null."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(named, same, "left").drop(*[f"__{k}" for k in keys])


def merged_by_title(variants: DataFrame) -> DataFrame:
    """A row per title: the first product's URL, distinct variants by id, sku and URL, distinct skus and images in order of the variants."""
    images = F.col("image_urls") if "image_urls" in variants.columns else F.array().cast("array<string>")
    key = ["product_title", "id", "sku", "product_url"]
    once = variants.withColumn("image_urls", images).groupBy(*key).agg(F.min("pos").alias("pos"), F.min_by("image_urls", "pos").alias("image_urls"))
    titles = once.groupBy("product_title").agg(F.min_by("product_url", F.struct("pos", "product_url")).alias("product_url"), F.count(F.lit(1)).alias("n_variants"))
    skus = ordered_lists(once, ["product_title"], F.array("sku"), F.struct("pos", "sku"), "skus")
    pictures = ordered_lists(once, ["product_title"], F.col("image_urls"), F.struct("pos", "sku"), "images")
    both = _joined(_joined(titles, skus, ["product_title"]), pictures, ["product_title"])
    said = lambda c, by: F.coalesce(F.array_join(c, by), F.lit("")).alias(c)
    return both.select("product_title", "product_url", "n_variants", said("skus", ","), said("images", " "))


def flattened(variants: DataFrame) -> DataFrame:
    """Variants with price, stock and deep link."""
    return variants.withColumns({"price": prices.feed_price(F.col("raw_price"), F.col("currency")), "stock": prices.stock_status(F.col("available"), F.col("quantity")), "deep_link": urls.deep_link(F.col("product_url"), F.col("id"))})


def product_rollup(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Per product URL of either side: counts, price bounds, currency of the first variant (USD if none), stocks, images (the product's, then its variants' in order), description and deep link."""
    price = F.col("price").try_cast("double")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    extra = lambda df, **kinds: df.select("*", *[none(c, k) for c, k in kinds.items() if c not in df.columns])
    empty = F.array().cast("array<string>")
    variants = extra(variants, image_urls="array<string>", description="string", deep_link="string")
    products = extra(products, image_urls="array<string>", description="string", deep_link="string")
    v = variants.groupBy("product_url").agg(
        F.count(F.lit(1)).alias("n_variants"), F.min(price).alias("v_min"), F.max(price).alias("v_max"), F.min_by("currency", "pos").alias("currency"), F.array_join(F.array_sort(F.collect_set("stock")), " | ").alias("stocks"),
        F.min_by("product_title", "pos").alias("v_title"), F.min_by("description", F.when(F.col("description").isNotNull(), F.col("pos"))).alias("v_description"), F.min_by("deep_link", F.when(F.col("deep_link").isNotNull(), F.col("pos"))).alias("v_link"),
    )
    v = _joined(v, ordered_lists(variants, ["product_url"], F.col("image_urls"), F.col("pos"), "v_images"), ["product_url"])
    p = products.select("product_url", F.col("title").alias("p_title"), F.col("price").cast("double").alias("p_price"), F.col("image_urls").alias("p_images"), F.col("description").alias("p_description"), F.col("deep_link").alias("p_link"))
    both = p.join(v, "product_url", "full")
    return both.select(
        "product_url", F.coalesce("p_title", "v_title").alias("title"), F.coalesce("n_variants", F.lit(0)).alias("n_variants"), F.least("v_min", "p_price").alias("min_price"), F.greatest("v_max", "p_price").alias("max_price"),
        F.coalesce("currency", F.lit("USD")).alias("currency"), F.coalesce("stocks", F.lit("")).alias("stocks"), F.array_join(F.array_distinct(F.concat(F.coalesce("p_images", empty), F.coalesce("v_images", empty))), " | ").alias("images"),
        F.coalesce("p_description", "v_description", F.lit("")).alias("description"), F.coalesce("p_link", "v_link", F.lit("")).alias("deep_link"),
    )


def pricing_stats(variants: DataFrame) -> DataFrame:
    """One row; zeros without a numeric price, currency of the first row."""
    price = F.col("price").try_cast("double")
    return variants.agg(F.coalesce(F.min_by("currency", "pos"), F.lit("USD")).alias("currency"), F.coalesce(F.min(price), F.lit(0.0)).alias("min_price"), F.coalesce(F.max(price), F.lit(0.0)).alias("max_price"), F.coalesce(F.round(F.avg(price), 2), F.lit(0.0)).alias("avg_price"))


def merged_batches(batches: list[DataFrame]) -> DataFrame:
    """The variants of all batches; of equal id and sku the first counts."""
    rows = None
    for k, b in enumerate(batches):
        part = b.withColumn("batch", F.lit(k))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("id", "sku").orderBy("batch", "pos"))).filter("k = 1").drop("k")


def image_counts(variants: DataFrame, images: str = "image_urls") -> DataFrame:
    """Images per variant, and per product over its variants."""
    n = F.size(image_list(F.col(images)))
    return variants.withColumn("n_images", n).withColumn("n_product_images", F.sum("n_images").over(Window.partitionBy("product_url")))


def merged_products(batches: list[DataFrame]) -> DataFrame:
    """C9 of products (product_url, title, skus and image_urls as arrays, others): per URL and title the values of the last batch that has any, and the lists of all in order."""
    rows = None
    for k, b in enumerate(batches):
        part = b.withColumn("batch", F.lit(k))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    plain = [c for c in rows.columns if c not in ("product_url", "title", "skus", "image_urls", "batch")]
    keys = ["product_url", "title"]
    last = F.count(F.lit(1)).alias("__n"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))).alias(c) for c in plain]
    out = rows.groupBy(*keys).agg(*last).drop("__n")
    for c in ("skus", "image_urls"):
        out = _joined(out, ordered_lists(rows, keys, F.col(c), F.col("batch"), c), keys).withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out


def merged_pricing(batches: list[DataFrame]) -> DataFrame:
    """The pricing (C8) of the merged variants, which replaces that of the batches."""
    return pricing_stats(merged_batches(batches).withColumn("pos", F.struct("batch", "pos")))


#: Words of a title or path that tell nothing about its images.
HINT_STOP_WORDS = ["with", "from", "your", "that", "this", "default", "title", "shop", "beauty", "cream", "serum", "body", "face", "gift", "card", "sample", "products", "product", "collections"]


def _hints(*said: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", *[F.coalesce(F.try_url_decode(s), s) for s in said])), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(HINT_STOP_WORDS) & ~w.rlike("^[0-9]+$")))


def relevant_images(title: Column, url: Column, images: Column) -> Column:
    """The images whose URL has hints of the title, or of the URL's path and query: 3 points for a hint of eight letters, else 2. Of one image in several widths the widest, the last of equals; by points, then in order."""
    hints = _hints(title, urls.path(url), urls.query(url))
    width = lambda u: F.coalesce(F.nullif(F.regexp_extract(u, r"[?&](?:width|w|sw)=([0-9]+)", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    bare = lambda u: F.regexp_replace(F.regexp_replace(u, r"(?<=[?&])(?:width|w|sw|height|h|sh)=[^&#]*&?", ""), r"[?&](?=#|$)", "")

    def ranked(h: Column) -> Column:
        points = lambda u: F.aggregate(h, F.lit(0), lambda a, w: a + F.when(F.contains(F.lower(F.coalesce(F.try_url_decode(u), u)), w), F.when(F.length(w) >= 8, 3).otherwise(2)).otherwise(0))
        scored = F.filter(F.transform(images, lambda u, i: F.struct(bare(u).alias("key"), width(u).alias("width"), i.alias("i"), u.alias("u"), points(u).alias("points"))), lambda x: x["points"] > 0)

        def best(all_: Column) -> Column:
            def of(key: Column) -> Column:
                mine = F.filter(all_, lambda x: x["key"] == key)
                pick = lambda f: F.transform(mine, f)
                return F.struct((-F.array_max(pick(lambda x: x["points"]))).alias("points"), F.array_min(pick(lambda x: x["i"])).alias("i"), F.array_max(pick(lambda x: F.struct(x["width"].alias("width"), x["i"].alias("i"), x["u"].alias("u"))))["u"].alias("u"))

            return F.transform(F.sort_array(F.transform(F.array_distinct(F.transform(all_, lambda x: x["key"])), of)), lambda x: x["u"])

        return let(scored, best)

    return let(hints, ranked)


def fill_missing_images(products: DataFrame, variants: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C11: products (product_url, title, image_urls) and variants (product_url, pos, sku, option_name, option_value, url, image_urls) with the relevant images that a second look at the pages found (rows like variants; a sku of null is the product's own).

    A variant takes those of the found variant of its sku, else of its option, else of the first, and those of the
    product. A product of which no relevant image was found stays as it is.
    """
    empty = F.array().cast("array<string>")
    per = found.groupBy("product_url").agg(F.array_sort(F.collect_list(F.struct("pos", "sku", "option_name", "option_value", F.coalesce("image_urls", empty).alias("u")))).alias("seen"))
    all_ = F.array_distinct(F.flatten(F.transform("seen", lambda x: x["u"])))
    known = products.join(per, "product_url").withColumn("extra", relevant_images(F.col("title"), F.col("product_url"), all_)).filter(F.size("extra") > 0).select("product_url", F.col("title").alias("__title"), "seen", "extra")
    rows = variants.join(known, "product_url", "left")
    own = F.filter("seen", lambda x: x["sku"].isNotNull())
    by_sku, by_option = F.filter(own, lambda x: x["sku"] == F.col("sku")), F.filter(own, lambda x: (text(x["option_name"]) != "") & (text(x["option_name"]) == text(F.col("option_name"))) & (text(x["option_value"]) == text(F.col("option_value"))))
    match = F.coalesce(F.try_element_at(by_sku, F.lit(-1)), F.try_element_at(by_option, F.lit(-1)), F.try_element_at(own, F.lit(1)))
    wanted = F.array_distinct(F.concat(F.coalesce(match["u"], empty), "extra"))
    more = relevant_images(F.concat_ws(" ", "__title", "option_name", "option_value"), F.coalesce("url", "product_url"), wanted)
    new_variants = rows.withColumn("image_urls", F.when(F.col("seen").isNotNull(), F.array_distinct(F.concat(F.coalesce("image_urls", empty), more))).otherwise(F.col("image_urls"))).drop("__title", "seen", "extra")
    of_variants = new_variants.groupBy("product_url").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("image_urls", empty).alias("u")))), lambda x: x["u"])).alias("v_images"))
    out = products.join(known.select("product_url", "extra"), "product_url", "left").join(of_variants, "product_url", "left")
    merged = F.array_distinct(F.concat(F.coalesce("image_urls", empty), "extra", F.coalesce("v_images", empty)))
    return out.withColumn("image_urls", F.when(F.col("extra").isNotNull(), merged).otherwise(F.col("image_urls"))).drop("extra", "v_images"), new_variants
