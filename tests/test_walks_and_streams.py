"""Sitemap walks, paged feeds, merged candidates and task progress on small inputs, with the cases that tables don't have."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from larkspur import sources, streaming
from larkspur.operators import discovery


def index(*urls):
    return "<?xml version='1.0'?><sitemapindex>" + "".join(f"<loc>{u}</loc>" for u in urls) + "</sitemapindex>"


def pages(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


@pytest.fixture(scope="module")
def crawl(spark):
    s = "https://s.com"
    sites = spark.createDataFrame([(s, f"Sitemap: {s}/i.xml\nsitemap: {s}/b.xml"), ("https://t.com", None), (None, "Sitemap: https://s.com/b.xml")], "site string, robots string")
    rows = [(f"{s}/i.xml", index(f"{s}/s1.xml", f"{s}/b.xml", f"{s}/i.xml")), (f"{s}/b.xml", pages(f"{s}/products/b", f"{s}/products/a")), (f"{s}/sitemap.xml", "no xml"), (f"{s}/s7.xml", pages(f"{s}/products/deep", f"{s}/products/a", "ftp://s.com/products/x"))]
    rows += [(f"{s}/s{k}.xml", index(f"{s}/s{k + 1}.xml", f"{s}/i.xml", "")) for k in range(1, 7)] + [(None, None), ("https://t.com/sitemap.xml", None)]
    return sites, spark.createDataFrame(rows, "url string, body string")


def test_walk_goes_to_any_depth_and_ends_in_cycles(crawl):
    walked = discovery.sitemap_walk(*crawl).filter("site = 'https://s.com'").orderBy("level", "way").collect()
    assert [r["url"].removeprefix("https://s.com/") for r in walked] == ["i.xml", "b.xml", "sitemap.xml", "sitemap_index.xml", *(f"s{k}.xml" for k in range(1, 8))]
    found = discovery.sitemap_products(*crawl).orderBy("rank").collect()
    assert [(r["loc"].rpartition("/")[2], r["rank"]) for r in found] == [("b", 1), ("a", 2), ("deep", 3)]


@pytest.mark.parametrize(("documents", "want"), [(1, []), (2, ["b", "a"]), (10, ["b", "a"]), (11, ["b", "a", "deep"])])
def test_walk_spends_its_budget_in_order(crawl, documents, want):
    assert [r["loc"].rpartition("/")[2] for r in discovery.sitemap_products(*crawl, documents=documents).orderBy("rank").collect()] == want
    assert discovery.sitemap_walk(*crawl, documents=documents).filter("site = 'https://s.com'").count() == documents


def test_entities(spark):
    said = ["&#36;19.99 &#163;5 &#8364;6", "caf&#233; &#xE9; &#X1F600;", "&amp;#36; &#0; &#55296; &#99999999; &#; &lt;b&gt; &quot;", None]
    got = [r["t"] for r in spark.createDataFrame([(t,) for t in said], "t string").select(discovery.decoded(F.col("t")).alias("t")).collect()]
    assert got == ["$19.99 £5 €6", "café é 😀", "&#36; \0 &#55296; &#99999999; &#; <b> \"", None]


def test_feeds_end_at_their_own_short_page(spark, tmp_path):
    page = lambda *ids: {"products": [{"id": k, "title": f"t{k}", "handle": f"h{k}"} for k in ids]}
    landed = {"a/1": page(1), "b/1": page(2, 3), "b/2": page(4), "b/3": page(5, 6), "c/1": page(7, 8), "c/3": page(9, 10), "d/1": {"products": None}, "e/1": page(11, 12), "e/2": page(13, 14)}
    for name, said in landed.items():
        (tmp_path / "f" / name.split("/")[0]).mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / f"{name}.json").write_text(json.dumps(said | {"page": int(name[-1])}))
    ids = lambda **kw: sorted(r["id"] for r in sources.read_product_feed(spark, f"{tmp_path}/f/*", **kw).collect())
    assert ids() == list(range(1, 15)) and ids(page_size=2) == [1, 2, 3, 4, 7, 8, 11, 12, 13, 14] and ids(page_size=2, max_pages=1) == [1, 2, 3, 7, 8, 11, 12]
    feeds = {r["id"]: r["feed"].rpartition("/")[2] for r in sources.read_product_feed(spark, f"{tmp_path}/f/*").collect()}
    assert feeds[4] == "b" and feeds[1] == "a"


def test_merges_happen_once_and_whole(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/c"
    at = datetime.datetime(2024, 1, 1)
    rows = lambda *r: spark.createDataFrame([(i, t, at + datetime.timedelta(days=d)) for i, t, d in r], "row_id string, said string, updated_at timestamp")
    held = lambda: {r["row_id"]: r["said"] for r in streaming.candidates_snapshot(spark, root).collect()}
    assert streaming.candidates_snapshot(spark, root) is None
    assert streaming.merge_candidates(spark, root, rows(("1", "a", 0), ("2", "b", 1), ("2", "old", 0), (None, "x", 0)), 0)
    assert held() == {"1": "a", "2": "b"}
    assert streaming.merge_candidates(spark, root, rows(("2", "c", 0), ("3", "d", 0)), 1) and held() == {"1": "a", "2": "c", "3": "d"}
    assert not streaming.merge_candidates(spark, root, rows(("2", "replayed", 9)), 1) and held()["2"] == "c"

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(streaming, "replace_text", killed)
        with pytest.raises(KeyboardInterrupt):
            streaming.merge_candidates(spark, root, rows(("1", "half", 0)), 2)
    assert held() == {"1": "a", "2": "c", "3": "d"}
    assert streaming.merge_candidates(spark, root, rows(("1", "whole", 0)), 2, parts=2) and held() == {"1": "whole", "2": "c", "3": "d"}
    assert len(json.loads((tmp_path / "c" / "manifest.json").read_text())["parts"]) == 1


def test_progress_counts_a_row_once(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    parts = [
        [("t", "1", at(1), 1, "QUEUED"), ("t", "2", at(1), 2, "QUEUED"), ("u", "1", at(1), 3, None)],
        [("t", "1", at(2), 4, "PENDING"), ("t", "1", at(2), 4, "PENDING"), ("t", "2", at(5), 9, "OK"), (None, "9", at(1), 1, "OK")],
        [("t", "1", at(3), 5, "OK"), ("t", "2", at(4), 8, "ERROR"), ("t", "1", at(2), 4, "PENDING")],
    ]
    kinds = "task_id string, row_id string, said_at timestamp, seq long, status string"
    landing, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    seen = []
    for part in parts:
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(landing)
        streaming.stream_task_progress(streaming.landed_files(spark, kinds, landing), out, check).awaitTermination()
        rows = streaming.progress_of_changes(spark.read.schema(streaming.CHANGES).parquet(out)).collect()
        seen.append({r["task_id"]: (r["total"], r["ok"], r["pending"], r["done"], r["task_status"]) for r in rows})
    assert seen[0] == {"t": (2, 0, 0, 0, "RUNNING"), "u": (1, 0, 0, 0, "RUNNING")}
    assert seen[1]["t"] == (2, 1, 1, 2, "COMPLETED") and seen[2]["t"] == (2, 2, 0, 2, "COMPLETED") and seen[2]["u"] == seen[0]["u"]
