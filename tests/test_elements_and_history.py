"""Element tables, dictionaries, sketches and histories on small inputs."""

from __future__ import annotations

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from larkspur.operators import audit, cells, elements, ingredients, rows


def texts_of(html):
    said, found = elements.page_elements(html)
    return [(e[0], said[e[5] : e[5] + e[6]]) for e in found]


def test_elements_are_spans():
    html = "<div>one <b>two</b> three<br>four<p>five &eacute;&#33;</p></span></div><script>no <b>x</b></script><ul><li>a<li>b</ul>tail"
    assert texts_of(html) == [("", "one two three four five é! a b tail"), ("div", "one two three four five é!"), ("b", "two"), ("br", ""), ("p", "five é!"), ("script", ""), ("ul", "a b"), ("li", "a b"), ("li", "b")]
    _, found = elements.page_elements(html)
    assert [e[2] for e in found] == [-1, 0, 1, 1, 1, 0, 0, 6, 7]  # parents
    assert [e[3] for e in found] == [-1, 5, 3, 4, -1, 6, -1, -1, -1]  # next siblings
    assert [e[4] for e in found] == [8, 4, 2, 3, 4, 5, 8, 8, 8]  # last descendants
    assert elements.page_elements("") == ("", [("", {}, -1, -1, 0, 0, 0)])


def test_blocks_stay_linear(spark):
    """Labels that share siblings and ancestors give no copies of these."""
    label = "<h3>Ingredients {}</h3>"
    html = "<div>" + "".join(label.format(k) for k in range(400)) + "<p>" + "water, " * 50 + "</p></div>"
    df = spark.createDataFrame([(1, html, "US"), (2, None, "US"), (3, "<p>" * 3000 + "deep" + "</p>" * 3000, None)], "page_id long, html string, market string")
    got = elements.blocks(df).collect()
    assert {r["page_id"] for r in got} == {1}
    kinds = {k: [r for r in got if r["kind"] == k] for k in ("label", "near", "around")}
    assert len(kinds["label"]) == 400 and len(kinds["near"]) == 400 and len(kinds["around"]) == 2  # the document and the element around all
    assert sum(len(r["block"]) for r in got) < 6 * len(html)


def dictionary(spark, *entries):
    return spark.createDataFrame([(*e, n) for n, e in enumerate(entries)], ingredients.DICTIONARY)


def test_dictionary_tables_change_names(spark):
    df = spark.createDataFrame([("1", "Water, Foo Bar, <b>Baz</b>"), ("2", "水, foo bar"), ("3", ""), ("4", None)], "row_id string, raw_ingredient_text string")
    plain = {r["row_id"]: r["inci_list"] for r in ingredients.parsed(df).collect()}
    table = ingredients.built_in_dictionary(spark)
    same = {r["row_id"]: r["inci_list"] for r in ingredients.parsed(df, dictionary=ingredients.dictionary_names(table)).collect()}
    assert same == plain and plain["1"].startswith("Aqua; ")
    more = table.unionByName(dictionary(spark, ("FOO bar", "Second", 2), ("foo  bar", "Late", 2), ("water", "H2O", 3), ("baz", "Z", 3), ("baz", None, 4)))
    names = lambda v: {r["row_id"]: r["inci_list"] for r in ingredients.parsed(df, dictionary=ingredients.dictionary_names(more, v)).collect()}
    assert names(2)["2"] == "Aqua; Second" and names(3)["1"] == "H2O; Second; Z" and names(None)["1"].startswith("H2O; Second; Baz")


def test_sketches_stay_within_their_bound(spark):
    token = F.array(F.struct(F.lit("rare").alias("original_text"), F.lit(True).alias("uncertain")), F.struct(F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("original_text"), F.lit(True).alias("uncertain")))
    many = spark.range(60_000).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 3).alias("import_id"), token.alias("inci"))
    tables = [ingredients.unrecognized_sketches(many.filter(F.col("import_id") == k)) for k in range(3)] + [ingredients.unrecognized_sketches(many.filter("import_id = 0"))]
    got = {r["token"]: (r["n_rows"], r["n_occurrences"]) for r in ingredients.merged_sketches(*tables).collect()}
    for t, n in (("rare", 60_000), ("even", 30_000), ("odd", 30_000)):
        assert abs(got[t][0] - n) < 0.05 * n and got[t][1] == n * 4 // 3
    by = ingredients.merged_sketches(*tables[:3], by=("token", "import_id"))
    assert by.count() == 9


def test_rows_as_of_a_time(spark):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    now = spark.createDataFrame([("1", "c", "kept"), ("2", "z", "kept"), ("3", "only", "kept")], "row_id string, brand string, note string")
    say = lambda b: "{}" if b is None else f'{{"row_id":"1","brand":"{b}"}}'
    records = spark.createDataFrame([("1", "r", at(1), "normalize_source_ref", say("a"), say("b")), ("1", "r", at(1), "reparse_current_text", say("b"), say(None)), ("1", None, at(3), "manual_correction", say(None), say("c")), ("2", None, at(3), "manual_correction", say("y"), say("z"))], "row_id string, audit_run_id string, created_at timestamp, correction_type string, before string, after string")
    brands = lambda df: {r["row_id"]: r["brand"] for r in df.collect()}
    assert brands(audit.as_of(now, records, F.lit(at(0)))) == {"1": "a", "2": "y", "3": "only"}
    assert brands(audit.as_of(now, records, F.lit(at(2)))) == {"1": None, "2": "y", "3": "only"}
    assert brands(audit.as_of(now, records, F.lit(at(4)))) == {"1": "c", "2": "z", "3": "only"}
    assert brands(audit.as_of_run(now, records, "r")) == {"1": None, "2": "y", "3": "only"} and audit.as_of(now, records, F.lit(at(1))).columns == now.columns
    assert [r["nth"] for r in audit.history(records, row_id="1").orderBy("nth").collect()] == [1, 2, 3]


def test_rows_as_of_a_run_get_back_all_that_records_tell(spark):
    """numbers and flags of a record are put back as what they are; columns that no record tells stay."""
    assert set(audit.PAYLOAD) < set(audit.READ)
    now = spark.createDataFrame([("1", "new", 0.25, False, "PASS", 7), ("2", "own", 1.0, True, "PASS", 8)], "row_id string, brand string, confidence double, ingest_allowed boolean, audit_status string, row_index int")
    records = spark.createDataFrame([("1", "r", datetime.datetime(2024, 1, 1), "reparse_current_text", "{}", '{"row_id":"1","brand":"old","confidence":0.5,"ingest_allowed":true}'), ("1", None, datetime.datetime(2024, 1, 2), "manual_correction", "{}", "{}")], "row_id string, audit_run_id string, created_at timestamp, correction_type string, before string, after string")
    got = sorted(audit.as_of_run(now, records, "r").select(*now.columns).collect())
    assert got == [("1", "old", 0.5, True, None, 7), ("2", "own", 1.0, True, "PASS", 8)]


def test_cells_keep_recall(spark):
    """An index of few probes finds what the exact search finds, on clustered vectors; rows without a vector are left out."""
    rng = random.Random(1)
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    middle = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    made = [(k, unit([m + rng.gauss(0, 0.2) for m in middle[k % 20]])) for k in range(2000)] + [(5000, None), (5001, [1.0])]
    df = spark.createDataFrame(made, "id long, u array<double>")
    asked = df.filter("id % 100 = 0 and id < 2000").select(F.col("id").alias("query_id"), F.col("u").alias("q"))
    index = cells.build(df, "id")
    true = {(r["query_id"], r["id"]) for r in cells.nearest(df.filter("id < 5000"), asked, "id", 10).collect()}
    probes, depth, measured = cells.recalled(index, df.filter("id < 5000"), asked, 10, 0.9)
    got = {(r["query_id"], r["id"]) for r in cells.within(index, asked, 10, probes, depth).collect()}
    assert len(true) == 200 and len(true & got) >= 0.9 * 200 and probes <= len(index.centers) // 2 and measured.count() == 20
    assert cells.build(df.filter("u is null"), "id") is None


def test_exports_are_read_back(spark, tmp_path):
    made = [("1", 2, "B, \"quoted\"", "x\ny", 0.5, None), ("2", 1, "A", "plain", None, ["n1", "n2"])]
    df = spark.createDataFrame(made, "row_id string, row_index int, brand string, raw_ingredient_text string, confidence double, notes array<string>")
    basic = rows.exported(df, "basic")
    assert basic.columns == rows.EXPORT and [r["row_id"] for r in basic.collect()] == ["2", "1"]
    with pytest.raises(ValueError, match="mode"):
        rows.exported(df, "other")
    rows.write_csv(rows.exported(df, "reviewed"), f"{tmp_path}/r")
    back = {r["row_id"]: r for r in spark.read.csv(f"{tmp_path}/r", header=True, multiLine=True, escape='"').collect()}
    assert back["1"]["brand"] == 'B, "quoted"' and back["1"]["raw_ingredient_text"] == "x\ny" and back["2"]["notes"] == '["n1","n2"]'
    rollup = spark.createDataFrame([("u2", "b", 1, 2.5, 3.0), ("u1", "a", 0, None, None)], "product_url string, title string, n_variants int, min_price double, max_price double")
    rows.write_csv(rows.products_export(rollup), f"{tmp_path}/p", quote_all=True)
    lines = [re.sub(r"\s", "", line) for f in sorted((tmp_path / "p").glob("*.csv")) for line in f.read_text().splitlines()]
    assert '"u1","a","0","",""' in lines and '"u2","b","1","2.50","3.00"' in lines
