"""Golden vectors of the operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import ingredient_text, prices, urls
from larkspur.operators import audit, catalog, discovery, harvest, kb, offers, rows, structured
from larkspur.operators.ingredients import parsed
from larkspur.streaming import stream_candidates

PARSE = [
    ("Ingredients: Aqua (Water), Glycerin, Niacinamide, Phenoxyethanol.", "OK", "Aqua; Glycerin; Niacinamide; Phenoxyethanol", 1.0),
    ("全成分：水，甘油，烟酰胺", "OK", "Aqua; Glycerin; Niacinamide", 1.0),
    ("See image", "NEEDS_SOURCE", "", 0.0),
    ("Aqua/Water/Eau, Glycerin, Parfum (Fragrance)", "OK", "Aqua; Glycerin; Parfum", 1.0),
    ("Aqua Glycerin Niacinamide Zinc PCA Phenoxyethanol", "NEEDS_REVIEW", None, 0.5),
    ("#vegan Water, Glycerin, Niacinamide, [more] Phenoxyethanol. Read more", "OK", "Aqua; Glycerin; Niacinamide; Phenoxyethanol", 1.0),
    ("Water, Glycerin, and...", "OK", "Aqua; Glycerin", 1.0),
    ("Water, Glycerin, etc.", "OK", "Aqua; Glycerin", 1.0),
    ("  ", "NEEDS_SOURCE", "", 0.0),
    ("N/A", "NEEDS_SOURCE", "", 0.0),
    (None, "NEEDS_SOURCE", "", 0.0),
    ("甲，乙，丙，丁", "OK", "甲; 乙; 丙; 丁", 0.6),
    ("甲，乙，丙，丁，戊", "NEEDS_REVIEW", "甲; 乙; 丙; 丁; 戊", 0.5),
    ("Water [x, y], Glycerin", "OK", None, 1.0),
]


def test_parse(spark):
    df = spark.createDataFrame([(str(i), r[0]) for i, r in enumerate(PARSE)], "row_id string, raw_ingredient_text string")
    got = {r["row_id"]: r for r in parsed(df).collect()}
    for i, (_, status, names, confidence) in enumerate(PARSE):
        r = got[str(i)]
        assert (r["parse_status"], r["parse_confidence"]) == (status, confidence), PARSE[i]
        assert names is None or r["inci_list"] == names
    assert got["13"]["inci"][0]["original_text"] == "Water [x, y]"


def test_full_label_prefix_is_stripped(spark):
    df = spark.createDataFrame([("1", "Full Ingredients List: Aqua/Water/Eau, Glycerin")], "row_id string, raw_ingredient_text string")
    r = parsed(df).first()
    assert r["cleaned_text"].startswith("Aqua/Water/Eau, Glycerin") and r["inci"][0]["standard_name"] == "Aqua"


def _value(spark, column, **given):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()] or [F.lit(1).alias("one")])
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("raw", "amount", "kind"), [("From $12 - $20", 12.0, "range"), ("1.234,56", 1234.56, "list"), ("1,234", 1234.0, "list"), ("1,23", 1.23, "list"), ("10 2-pack", 102.0, "list"), ("", None, "unknown"), ("now $5", 5.0, "sale"), ("from 7", 7.0, "from")])
def test_prices(spark, raw, amount, kind):
    got = _value(spark, prices.parse_price(F.col("p")), p=raw)
    assert (got["price_amount"], got["price_type"]) == (amount, kind)


def test_currencies(spark):
    df = spark.createDataFrame([("jpy", ["USD"], "$19.99", "JP"), (None, [], "$5", "SG"), (None, [], "¥3,200", "JP"), (None, ["eur"], "$1", "US")], "s string, m array<string>, p string, k string")
    got = [tuple(r["c"]) for r in df.select(prices.resolve_currency(F.col("s"), F.col("m"), F.col("p"), F.col("k")).alias("c")).collect()]
    assert got == [("JPY", "high"), ("SGD", "low"), ("JPY", "low"), ("EUR", "medium")]
    assert _value(spark, prices.feed_price(F.col("p"), F.lit("USD")), p="1999") == "19.99"
    assert _value(spark, prices.feed_price(F.col("p"), F.lit("JPY")), p="1999") == "1999"


@pytest.mark.parametrize(("path", "product"), [("/de-de/niacinamide-10-zinc-1-serum-100436.html", True), ("/products/x", True), ("/the-geranium-rose-body-cream", True), ("/", False), ("/en-us", False), ("/product/detail.css", False), ("/collections/all", False)])
def test_product_urls(spark, path, product):
    base = "https://theordinary.com"
    assert _value(spark, urls.is_product_url(F.col("u"), F.lit(base)), u=base + path) is product


def test_url_forms(spark):
    assert _value(spark, urls.canonical_url(F.col("u")), u="https://A.com/x?utm_source=1&b=2#top") == "https://a.com/x?b=2"
    assert _value(spark, urls.market_seed_url(F.col("u"), F.lit("US")), u="https://a.com/de-de/x") == "https://a.com/en-us/x"
    assert _value(spark, urls.market_seed_url(F.col("u"), F.lit("US")), u="https://a.com/en-eu/x") == "https://a.com/en-eu/x"
    assert _value(spark, urls.block_provider(F.lit(403), F.create_map(F.lit("cf-ray"), F.lit("x")), F.lit("Just a moment..."), F.lit(""))) == "cloudflare"


CANDIDATE = "row_id string, import_id string, row_index long, brand string, product_name string, market string, sku_key string, raw_ingredient_text string, source_ref string, source_type string, review_status string"


def _candidates(spark, *given):
    base = {"import_id": "i", "brand": "B", "product_name": "P", "market": "US", "sku_key": "s", "raw_ingredient_text": "Water, Glycerin", "source_ref": None, "source_type": "Official", "review_status": "UNREVIEWED"}
    names = [f.split()[0] for f in CANDIDATE.split(", ")]
    return spark.createDataFrame([tuple(({"row_id": str(k), "row_index": k} | base | g)[n] for n in names) for k, g in enumerate(given)], CANDIDATE)


def test_audit_rules(spark):
    df = _candidates(
        spark, {"brand": "Olehenriksen", "source_ref": "https://www.cosdna.com/x", "source_type": "ThirdParty", "sku_key": "a"}, {"brand": "Olehenriksen", "source_ref": "https://www.strawberrynet.com/x", "sku_key": "b"},
        {"brand": "Dermalogica", "product_name": "Dermalogica X", "source_ref": "https://skinsafeproducts.com/dermalogica-x", "sku_key": "c"}, {"brand": "Pixi Beauty", "product_name": "H2O SkinTint - Porcelain", "source_ref": "https://pixibeauty.com/products/h20-skin-tint", "sku_key": "d"}, {"sku_key": "e"},
    )
    got = {r["row_id"]: r for r in audit.audited(parsed(df)).collect()}
    found = lambda k: {(f["anomaly_type"], f["severity"]) for f in got[k]["findings"]}
    assert {("source_host_not_allowlisted", "review"), ("non_official_source_requires_review", "review")} <= found("0")
    assert {("source_host_not_allowlisted", "review"), ("non_official_source_requires_review", "review")} <= found("1")
    assert found("2") == {("source_host_not_allowlisted", "blocker")}
    assert got["3"]["source_match_status"] == "match" and got["3"]["audit_status"] == "PASS"
    assert found("4") == {("missing_source_ref", "blocker")} and got["4"]["audit_score"] == 0.65


def test_duplicate_conflicts(spark):
    other = {"raw_ingredient_text": "Water, Urea"}
    url = "https://b.com/p"
    cases = {
        "elsewhere": ([{}, other | {"import_id": "j"}], None), "same import": ([{}, other], "1"), "approved elsewhere": ([{}, other | {"import_id": "j", "review_status": "APPROVED"}], "1"),
        "variant upgrade": ([{"source_ref": url + "?variant=1"}, other | {"import_id": "j", "review_status": "APPROVED", "source_ref": url}], None), "same list": ([{}, {}], None),
    }
    for name, (given, expected) in cases.items():
        got = {r["row_id"]: r["conflict"]["row_id"] for r in audit.duplicate_conflicts(parsed(_candidates(spark, *given))).collect()}
        assert got.get("0") == expected, name


def test_duplicate_conflicts_are_those_of_all_pairs(spark):
    """Random rows of few skus, lists, imports and pages, against every pair of rows."""
    import random

    rng = random.Random(9)
    rows = []
    for k in range(400):
        ref = rng.choice([None, "https://a.com/p", "https://a.com/P/?variant=1", "https://a.com/p?variant=2", "https://b.com/q", "https://b.com/q?variant=3"])
        rows.append((f"r{k}", str(rng.randrange(150)), rng.randrange(200), rng.choice([f"s{k % 3}", "hot", "hot", None]), rng.choice(["A", "A; B", "a;b", "C", "D", ""]), ref, rng.choice(["Official", "Retailer", None]), rng.choice(["APPROVED", "UNREVIEWED", None])))
    df = spark.createDataFrame(rows, "row_id string, import_id string, row_index int, sku_key string, inci_list string, source_ref string, source_type string, review_status string")
    key = lambda said: ";".join(p for p in (x.strip().lower() for x in said.split(";")) if p)
    page = lambda ref: ref and ref.split("?")[0].rstrip("/").lower().removeprefix("https://")
    want = {}
    for x in rows:
        met = []
        for y in rows:
            if x[3] and x[3] == y[3] and key(x[4]) and key(y[4]) and key(x[4]) != key(y[4]):
                upgrade = x[6] == y[6] == "Official" and page(x[5]) and page(x[5]) == page(y[5]) and "variant=" in x[5] and "variant=" not in y[5]
                if x[1] == y[1] or (y[7] == "APPROVED" and not upgrade):
                    met.append((x[1] != y[1], y[2], y[0]))
        if met:
            want[x[0]] = min(met)
    got = {r["row_id"]: (r["conflict"]["far"], r["conflict"]["row_index"], r["conflict"]["row_id"]) for r in audit.duplicate_conflicts(df).collect()}
    assert got == want and any(f for f, _, _ in want.values()) and not all(f for f, _, _ in want.values())


def test_duplicate_conflicts_of_hot_keys(spark):
    rng = random.Random(4)
    given = []
    for k in range(240):
        sku = rng.choice(["hot", "warm", "few"])
        imp = rng.choice("abcdef")
        said = f"Water, Urea {ord(imp) % 2 if sku == 'hot' else rng.randrange(2) if sku == 'warm' else 0}"
        given.append({"sku_key": sku, "import_id": imp, "row_index": rng.randrange(1000), "inci_list": said, "review_status": rng.choice(["APPROVED", "UNREVIEWED"]), "source_ref": rng.choice([None, "https://b.com/p", "https://b.com/p?variant=1", "https://b.com/q?variant=1"]), "source_type": rng.choice(["Official", "Retailer"]), "row_id": f"{k:03}"})
    df = _candidates(spark, *given).join(spark.createDataFrame([(g["row_id"], g["inci_list"]) for g in given], "row_id string, inci_list string"), "row_id")

    def meets(x, y):
        if x["sku_key"] != y["sku_key"] or x["inci_list"] == y["inci_list"]:
            return False
        page = lambda g: (g["source_ref"] or "").split("?")[0]
        variant = lambda g: "variant" in (g["source_ref"] or "")
        upgrade = x["source_type"] == y["source_type"] == "Official" and page(x) and page(x) == page(y) and variant(x) and not variant(y)
        return x["import_id"] == y["import_id"] or (y["review_status"] == "APPROVED" and not upgrade)

    want = {x["row_id"]: min((x["import_id"] != y["import_id"], y["row_index"], y["row_id"]) for y in given if meets(x, y))[2] for x in given if any(meets(x, y) for y in given)}
    assert {r["row_id"]: r["conflict"]["row_id"] for r in audit.duplicate_conflicts(df).collect()} == want
    assert any(x["import_id"] != given[int(want[x["row_id"]])]["import_id"] for x in given if x["row_id"] in want)


def test_patches(spark):
    df = parsed(_candidates(spark, {"source_ref": "https://b.com/p"}, {})).withColumn("reviewed_by", F.lit(None).cast("string"))
    patches = spark.createDataFrame([("0", {"raw_ingredient_text": "Water, Urea", "source_ref": None})], "row_id string, patch map<string,string>")
    out, records = audit.corrected(df, patches, "me")
    got = {r["row_id"]: r for r in out.collect()}
    assert got["0"]["inci_list"] == "Aqua; Urea" and got["0"]["source_ref"] is None and got["1"]["inci_list"] == "Aqua; Glycerin"
    assert [r["row_id"] for r in records.collect()] == ["0"]
    assert audit.reviewed(df, spark.createDataFrame([("1", {"review_status": "APPROVED"})], "row_id string, patch map<string,string>"))[0].filter("review_status = 'APPROVED'").count() == 1


PAGES = [
    ("<h2>Ingredients</h2><div>Water, Glycerin, Sodium Chloride, Fragrance.</div>", "US", "Water"), ("<div><h3>全成分</h3><p>水，甘油，乙醇，香精。</p></div>", "CN", "水"),
    ("<script>Ingredients: Water, Glycerin, Alcohol, Parfum, Citric Acid</script>", "US", None),
]


def test_blocks(spark):
    df = spark.createDataFrame([(k, h, m) for k, (h, m, _) in enumerate(PAGES)], "page_id long, html string, market string")
    got = {r["page_id"]: r for r in harvest.ranked_blocks(harvest.blocks(df)).collect()}
    for k, (_, _, part) in enumerate(PAGES):
        assert (k not in got) if part is None else (part in got[k]["said"] and got[k]["score"] >= 0.6)


def test_choice_of_source(spark):
    schema = "row_id string, group_no int, url_no int, url string, status int, score double, verified boolean, said string, ambiguous boolean"
    rows_ = [("a", 0, 0, "bad", 200, 0.5, False, "x", False), ("a", 0, 1, "good", 200, 0.9, True, "Water", False), ("b", 0, 0, "weak", 200, 0.5, True, "y", False), ("c", 0, 0, "p", 200, 0.0, False, "", True), ("c", 1, 0, "q", 200, 0.9, True, "z", False), ("d", 0, 0, "none", 404, 0.0, False, None, False)]
    got = {r["row_id"]: (r["status"], r["source_ref"], round(r["confidence"], 2)) for r in harvest.chosen(spark.createDataFrame(rows_, schema)).collect()}
    assert got == {"a": ("OK", "good", 0.9), "b": ("PENDING", "weak", 0.55), "c": ("PENDING", "p", 0.3), "d": ("NEEDS_SOURCE", None, 0.0)}


def test_jsonld_offers(spark):
    html = """<script type="application/ld+json">{"@graph":[{"@type":"ProductGroup","name":"G","hasVariant":[{"@type":"Product","sku":"G062104","offers":{"url":"https://s.com/a?v=1","price":"SGD 92","priceCurrency":"SGD"}},{"@type":"Product","sku":"G062105","offers":[{"url":"https://s.com/a?v=2","price":"92","priceCurrency":"SGD"}]}]}]}</script>
    <script type="application/ld+json">{bad</script>"""
    df = spark.createDataFrame([(1, "https://s.com/a", html), (2, "https://s.com/b", '<script type="application/ld+json">{"@type":["Product"],"sku":"G062203","name":"N","offers":{"price":"176"}}</script>')], "page_id long, url string, html string")
    got = {(r["page_id"], r["variant_sku"]): (r["price_amount"], r["price_currency"]) for r in structured.page_offers(df, "s.com", "SG").collect()}
    assert got == {(1, "G062104"): (92.0, "SGD"), (1, "G062105"): (92.0, "SGD"), (2, "G062203"): (176.0, None)}
    assert {r["page_id"]: r["product_title"] for r in structured.page_products(df).collect()} == {1: "G", 2: "N"}


def test_counters_show_markets_without_offers(spark):
    raw = spark.createDataFrame([("s", None, "u", None, "US", "$5", None, None)], "source_site string, site_product_id string, url_canonical string, variant_sku string, market_id string, price_display_raw string, structured_currency string, raw_availability string")
    got = {r["market_id"]: (r["total"], r["native_currency_rate"], r["switch_fail_rate"]) for r in offers.site_market_counters(offers.normalized(raw), failed=True).collect()}
    assert got["US"] == (1, 1.0, 0.0) and got["JP"] == (0, 0.0, 1.0)


def test_sitemaps_and_images(spark):
    sites = spark.createDataFrame([("https://s.com", "Sitemap: https://s.com/dead.xml")], "site string, robots string")
    fetched = spark.createDataFrame([("https://s.com/sitemap.xml", "<urlset><loc>https://s.com/products/a</loc><loc><![CDATA[https://s.com/about]]></loc></urlset>")], "url string, body string")
    assert [r["loc"] for r in discovery.sitemap_products(sites, fetched).collect()] == ["https://s.com/products/a"]
    assert _value(spark, catalog.image_list(F.array(F.lit("https://x/a.png 2x, b"), F.lit("/rel.png"), F.lit("https://x/logo.png"), F.lit("https://x/a.png")))) == ["https://x/a.png"]


def test_kb(spark):
    df = spark.createDataFrame([("1", "a b b"), ("2", "")], "id string, said string")
    got = {r["id"]: r["embedding"] for r in kb.embedded(df, "id", "said", dim=16).collect()}
    assert abs(sum(x * x for x in got["1"]) - 1) < 1e-5 and not any(got["2"])
    both = spark.createDataFrame([("a", "OK", "APPROVED", "PASS", True, "x", "y"), ("b", "OK", "UNREVIEWED", "REVIEW", False, "x", "y")], "sku_key string, parse_status string, review_status string, audit_status string, ingest_allowed boolean, cleaned_text string, inci_list string")
    assert [r["sku_key"] for r in kb.kb_rows(both).collect()] == ["a"]


def test_import_drops_incomplete_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Brand,Product,Country,Ingredients,SKU\nB,P,US,"Water, Glycerin",1\n,P,US,x,2\nB,Q,US,n/a,003\n')
    got = rows.import_candidates(spark, str(tmp_path / "a.csv"), "i").orderBy("row_index").collect()
    assert [(r["row_index"], r["status"], r["sku_key"], r["confidence"]) for r in got] == [(0, "SKIPPED", "1", 1.0), (2, "EMPTY", "003", None)]
    with pytest.raises(ValueError):
        rows.exported(spark.range(1), "all")


def test_stream_equals_batch(spark, tmp_path):
    df = _candidates(spark, {}, {"raw_ingredient_text": "See image"}).withColumn("ingest_allowed", F.lit(False)).withColumn("audit_status", F.lit("UNAUDITED"))
    df.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = stream_candidates(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda b, _: b.write.mode("append").parquet(out), str(tmp_path / "cp"))
    q.awaitTermination()
    key = lambda d: sorted((r["row_id"], r["audit_status"], r["audit_score"]) for r in d.collect())
    assert key(spark.read.parquet(out)) == key(audit.audited(parsed(df), with_duplicates=False))


def test_texts(spark):
    assert _value(spark, ingredient_text.slice_after_label(F.lit("Full Ingredients: Polybutene, Wax"))) == "Polybutene, Wax"
    assert _value(spark, ingredient_text.clean_block(F.lit("Water Read more #vegan https://x.y"))) == "Water"
    assert _value(spark, ingredient_text.merged_description(F.lit("a"), F.lit(""), F.lit("b"))) == "a\n\nIngredients and Safety: b"
