"""URLs: normal forms, hosts, product scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import fixed
from larkspur.functions.core import has_any, let, lookup, strip, text

_SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*://)([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def is_http(url: Column) -> Column:
    return text(url).rlike(r"(?i)^https?://[^/?#]+")


def host(url: Column) -> Column:
    """In lower case, with the port; '' if there is none."""
    return F.lower(F.regexp_extract(text(url), _SPLIT, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(text(url), _SPLIT, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(text(url), _SPLIT, 4)


def normalize_url_like(c: Column) -> Column:
    """A1."""
    first = lambda t: F.split(t, "/")[0]
    return let(strip(text(c)), lambda t: F.when(t.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), t).when(F.startswith(t, F.lit("www.")) | F.contains(first(t), F.lit(".")), F.concat(F.lit("https://"), t)).otherwise(""))


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host, no fragment, no tracking parameters; other texts as they are."""

    def rebuild(url: Column) -> Column:
        kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^[^=]*", 0).rlike(fixed.TRACKING_KEY))
        base = F.concat(F.lower(F.regexp_extract(url, _SPLIT, 1)), host(url), F.when(path(url) == "", "/").otherwise(path(url)))
        return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)

    return F.when(is_http(c), rebuild(c)).otherwise(c)


def absolute_url(href: Column, base: Column) -> Column:
    """href against the base's page: absolute, protocol-relative, rooted and relative forms."""
    scheme, root = F.regexp_extract(base, r"^[A-Za-z]+:", 0), F.concat(F.regexp_extract(base, _SPLIT, 1), F.regexp_extract(base, _SPLIT, 2))
    folder = F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), "[^/]*$", "")
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, href)).when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(root, folder, href))


def with_market_params(url: Column, market: Column) -> Column:
    """The market's country, locale and currency where the query lacks them."""
    out = url
    for k, name in enumerate(("country", "locale", "currency")):
        value = lookup([(m, x) for m, *rest in fixed.MARKETS for x in [(rest[0], rest[2], rest[1])[k]]])[market]
        out = let(out, lambda u, name=name, value=value: _with_param(u, name, value))  # bound: a parameter names its URL six times, so four would be over a thousand copies
    shipping = F.when(market == "JP", "JP")
    return F.when(is_http(url), let(out, lambda u: _with_param(u, "shipping_destination", shipping))).otherwise(url)


def _with_param(url: Column, name: str, value: Column) -> Column:
    present = F.concat(F.lit("&"), query(url)).rlike(f"&{name}(=|&|$)")
    bare, mark = F.regexp_replace(url, "#.*$", ""), F.regexp_extract(url, "#.*$", 0)
    joint = F.when(F.contains(bare, F.lit("?")), "&").otherwise("?")
    return F.when(present | value.isNull(), url).otherwise(F.concat(bare, joint, F.lit(f"{name}="), value, mark))


def deep_link(url: Column, variant_id: Column, source: str = "larkspur", medium: str = "affiliate") -> Column:
    """The variant where the path is a product's, then source and medium, after what else the query holds."""
    varied = url.rlike("(?i)^[^?#]*/products/") & variant_id.rlike("^[0-9]+$")
    new = F.concat(F.when(varied, F.concat(F.lit("variant="), variant_id, F.lit("&"))).otherwise(""), F.lit(f"utm_source={source}&utm_medium={medium}"))
    kept = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~p.rlike("^utm_(source|medium)(=|$)") & ~(varied & p.rlike("^variant(=|$)")))
    general = F.concat(F.regexp_replace(url, r"[?#].*$", ""), F.lit("?"), F.array_join(F.array_append(kept, new), "&"), F.regexp_extract(url, "#.*$", 0))
    return F.when(~is_http(url), url).when(url.rlike("[?#]"), general).otherwise(F.concat(url, F.lit("?"), new))


def source_class(url: Column) -> Column:
    """H5: retailer, thirdparty or official by host substrings of the whole URL."""
    u = F.lower(text(url))
    return F.when(has_any(u, fixed.RETAILERS), "Retailer").when(has_any(u, fixed.THIRD_PARTIES), "ThirdParty").otherwise("Official")


def effective_source_type(source_type: Column, source_ref: Column) -> Column:
    u = F.lower(normalize_url_like(source_ref))
    return let(u, lambda x: F.when(has_any(x, fixed.THIRD_PARTIES), "thirdparty").when(has_any(x, fixed.RETAILERS), "retailer").otherwise(F.lower(strip(text(source_type)))))


def match_tokens(c: Column) -> Column:
    """A2."""
    words = F.filter(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), 0), lambda t: ((F.length(t) >= 4) | ((F.length(t) >= 3) & t.rlike("[0-9]"))) & ~t.isin(fixed.STOP_WORDS))
    return let(F.array_distinct(words), lambda w: F.array_union(w, F.transform(F.filter(w, lambda t: F.contains(t, F.lit("0"))), lambda t: F.replace(t, F.lit("0"), F.lit("o")))))


def official_hosts(brand: Column) -> Column:
    """H6: the hosts of all keys that the brand contains."""
    b = F.lower(strip(text(brand)))
    return F.array_distinct(F.filter(F.array(*[F.when(F.contains(b, F.lit(k)), h) for k, h in fixed.OFFICIAL_HOSTS]), lambda h: h.isNotNull()))


def host_allowed(source_host: Column, allowed: Column) -> Column:
    """A5."""
    h = F.lower(strip(text(source_host)))
    return (h != "") & F.exists(allowed, lambda a: (h == F.lower(a)) | F.endswith(h, F.concat(F.lit("."), F.lower(a))))


def _segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda s: s != "")


def product_url_score(url: Column, base: Column) -> Column:
    """Null stands for minus infinity."""

    def score(p: Column) -> Column:
        def of(parts: Column) -> Column:
            depth, last = F.size(parts), F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
            hyphens = F.length(last) - F.length(F.replace(last, F.lit("-"), F.lit("")))
            add = lambda cond, n: F.when(cond, n).otherwise(0)
            total = add(p.rlike("/products?/"), 6) + add(p.rlike("/p/[^/]+$"), 6) + add(p.rlike(r"\.html$"), 6)
            total = total + add((depth == 1) & (hyphens >= 3), 4) + add((depth <= 2) & last.rlike("(?i)^the-[a-z0-9-]+$"), 4)
            total = total + add((depth <= 2) & (hyphens >= 2), 2) + add((depth <= 2) & last.rlike(fixed.CARE_WORDS), 2)
            return F.when(p.rlike(fixed.NEGATIVE_PATH), -4).otherwise(total)

        return let(_segments(p), of)

    never = ~is_http(url) | (host(url) != host(base)) | path(url).rlike(fixed.STATIC_FILE) | path(url).isin("", "/")
    return F.when(~never, let(F.lower(path(url)), score))


def is_product_url(url: Column, base: Column, strict: bool = False) -> Column:
    """U3."""
    if strict:
        return is_http(url) & F.lower(path(url)).rlike(r"/products?/|[-_][0-9]{4,}\.html$|/p/[^/]+$")
    return F.coalesce(product_url_score(url, base) >= 4, F.lit(False))


def is_category_url(url: Column, base: Column) -> Column:
    """U4."""
    parts = _segments(path(url))
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    hyphens = F.length(last) - F.length(F.replace(last, F.lit("-"), F.lit("")))
    fits = is_http(url) & (host(url) == host(base)) & ~path(url).rlike(fixed.STATIC_FILE) & ~path(url).rlike(fixed.NEGATIVE_PATH) & ~is_product_url(url, base)
    return fits & F.size(parts).between(1, 2) & ~((hyphens >= 3) & last.rlike("(?i)^the-"))


def market_seed_url(url: Column, market: Column) -> Column:
    """The leading locale of the path becomes the market's, unless the language already is."""
    wanted = F.lower(lookup([(m, locale) for m, _, _, locale in fixed.MARKETS])[market])
    own = F.regexp_extract(path(url), "^/([^/]+)", 1)
    other = own.rlike("(?i)^[a-z]{2}[-_][a-z]{2}$") & (F.split(F.lower(own), "-")[0] != F.split(wanted, "-")[0])
    return F.when(is_http(url) & wanted.isNotNull() & other, F.concat(F.regexp_extract(url, _SPLIT, 1), F.regexp_extract(url, _SPLIT, 2), F.lit("/"), wanted, F.regexp_replace(path(url), "^/[^/]+", ""), F.regexp_extract(url, "[?#].*$", 0))).otherwise(url)


def parse_target(c: Column) -> Column:
    """Struct of domain, base_url, seed_url (if there is a path) and collection handle."""

    def parts(u: Column) -> Column:
        base = F.concat(F.lower(F.regexp_extract(u, _SPLIT, 1)), host(u))
        return F.struct(host(u).alias("domain"), base.alias("base_url"), F.when(~path(u).isin("", "/"), u).alias("seed_url"), F.nullif(F.regexp_extract(path(u), "(?i)^/collections/([^/]+)", 1), F.lit("")).alias("collection"))

    return let(F.when(strip(text(c)).rlike(r"(?i)^https?://"), strip(c)).otherwise(F.concat(F.lit("https://"), strip(text(c)))), parts)


def context_score(url: Column, base: Column, said: Column) -> Column:
    """U2 and what the link's text and surroundings say; null stands for minus infinity."""
    t = F.lower(text(said))
    add = lambda pattern, n: F.when(t.rlike(pattern), n).otherwise(0)
    return product_url_score(url, base) + add(fixed.PRICE_SIGN, 3) + add(fixed.SHOP_WORDS, 2) + add(fixed.STOCK_WORDS, 1)


def looks_like_product_page(html: Column) -> Column:
    """U11."""

    def score(h: Column) -> Column:
        add = lambda pattern, n: F.when(h.rlike(pattern), n).otherwise(0)
        return add(fixed.PRODUCT_TYPE, 4) + add(fixed.PRICE_SIGN, 2) + add(fixed.BUY_WORDS, 2) + add(fixed.PRODUCT_META, 2)

    return let(F.lower(text(html)), score) >= 4


def block_provider(status: Column, headers: Column, title: Column, body: Column) -> Column:
    """Who blocked the fetch, or null. Header names are expected in lower case."""
    joined = F.concat_ws("\n", F.lower(text(title)), F.lower(text(body)))
    blocked = F.coalesce(status.isin(401, 403, 429, 503), F.lit(False))
    server = F.lower(text(headers["server"]))
    held = lambda p: joined.rlike(p)
    return (
        F.when((text(headers["cf-mitigated"]) != "") | held(fixed.CLOUDFLARE_SIGNS) | (blocked & (text(headers["cf-ray"]) != "") & held(fixed.CLOUDFLARE_WORDS)), "cloudflare")
        .when(held(fixed.AKAMAI_SIGNS) | (blocked & F.contains(server, F.lit("akamai")) & held(fixed.AKAMAI_WORDS)), "akamai")
        .when(held(fixed.PERIMETERX_SIGNS) & (blocked | held(fixed.PERIMETERX_WORDS)), "perimeterx")
        .when(F.coalesce(status.isin(401, 403, 429), F.lit(False)) & held(fixed.BLOCK_WORDS), "unknown")
    )
