"""What large tables need: rows over all cores, expressions that name their input once, and shortcuts of the parser that change nothing."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from larkspur import streaming
from larkspur.functions import fixed, ingredient_text, urls
from larkspur.operators import audit, discovery, ingredients, rows
from larkspur.plans import registry, reviews, streams, walks
from larkspur.plans.views import PRODUCT_PAGES, view
from larkspur.scratch import small, spread
from tests.conftest import SF


def size_of(df) -> int:
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_rows_of_one_file_are_spread(spark, tmp_path):
    """a small file of many rows, or one whose rows lie in one row group, is worked on by all cores; rows that lie even stay."""
    spark.range(4000).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(4000).repartition(4).write.parquet(f"{tmp_path}/even")
    one, even = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("one", "even"))
    assert spread(one).rdd.getNumPartitions() >= 4 and spread(one).count() == 4000
    assert spread(even).rdd.getNumPartitions() == even.rdd.getNumPartitions()
    lone = spark.range(4000).coalesce(1).unionByName(spark.range(3).repartition(7))
    assert spread(lone).groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0] < 1000
    assert view(spark, SF, PRODUCT_PAGES, even=True).rdd.getNumPartitions() >= 4


def test_market_url_names_its_url_a_few_times(spark):
    """four parameters in a row were over a thousand copies of the URL."""
    assert size_of(registry.QUERIES["market_expansion"](spark, SF)) < 20000
    given = ["https://a.com/p", "https://a.com/p?country=DE#x", "https://a.com/?locale=&q", "http://a.com/#f?currency=1", "ftp://a.com/p", "", None]
    want = ["https://a.com/p?country=JP&locale=ja-JP&currency=JPY&shipping_destination=JP", "https://a.com/p?country=DE&locale=ja-JP&currency=JPY&shipping_destination=JP#x", "https://a.com/?locale=&q&country=JP&currency=JPY&shipping_destination=JP", "http://a.com/?country=JP&locale=ja-JP&currency=JPY&shipping_destination=JP#f?currency=1", "ftp://a.com/p", "", None]
    df = spark.createDataFrame([(u,) for u in given], "u string")
    assert [r["x"] for r in df.select(urls.with_market_params(F.col("u"), F.lit("JP")).alias("x")).collect()] == want


def plain_clean(t: str) -> tuple[str, list[str]]:
    notes, t = [], t.strip(" \t\n\x0b\f\r")
    for pattern, by, note in fixed.NOISE_STEPS:
        new = re.sub(pattern.replace("$1", ""), by.replace("$1", r"\1"), t, flags=re.ASCII)
        notes += [note] if new != t else []
        t = new
    t = re.sub(r"\s{2,}|[^\S ]", " ", t, flags=re.ASCII).strip(" \t\n\x0b\f\r")
    return t.strip("。．. ;；,，"), notes


def test_shortcuts_of_cleaning_change_nothing(spark):
    """a step is left out only where its pattern can't match."""
    said = [
        "a, b and", "a, b AND ... ", "a & ", "a, ETC. ", "a, etc.\n\n" + " " * 60, "d" + "." * 60, "an" + "d" + "." * 47, "x and" + " " * 47, "band", "re​ad more, a", "a HTTPS://x.y b", "a #tag b", "#tag", "x#tag", "[ More ] a", "a... b", "a… b", "Read  LESS a", "how to\nread an Ingredient  list", "INGREDIENTS BY\tFUNCTION",
        "see\n text", "click   here now", "view full list", "show all ingredients", " \t", "", "a\tb\x0bc\fd\re\nf  g", "  . a ;", "seé text", "Show ﬁ more",
    ]
    got = spark.createDataFrame(list(enumerate(said)), "k int, t string").select("k", ingredient_text.clean_with_notes(F.col("t")).alias("c")).orderBy("k").collect()
    for r, t in zip(got, said, strict=True):
        assert (r["c"]["text"], r["c"]["notes"]) == plain_clean(t), repr(t)
    ends = [f"a{chr(c)}and{chr(c)}" for c in (0x85, 0x2028, 0x2029)]  # ends of lines in Java's patterns, not in Python's
    assert [r["n"] for r in spark.createDataFrame([(t,) for t in ends], "t string").select(ingredient_text.clean_with_notes(F.col("t"))["notes"].alias("n")).collect()] == [["Removed truncation ending"]] * 3


def test_long_tokens_are_only_passed_over_where_no_key_can_match(spark):
    """marks, brackets and dots can shorten a long token to a key."""
    said = ["Water" + " (a very long remark on where this water is from and how)", "Water......................................................", "<" + "x" * 60 + "> aqua", "wa™™ter", "glycerin " + "/ " * 30, "acrylates/c10-30 alkyl acrylate crosspolymer", "w" * 80, "İ" * 50]
    got = [r["n"][0]["standard_name"] if r["n"] else None for r in spark.createDataFrame([(k, [t]) for k, t in enumerate(said)], "k int, t array<string>").select("k", ingredients.mapped(F.col("t")).alias("n")).orderBy("k").collect()]
    assert got[:3] == ["Aqua"] * 3 and got[4:6] == ["Glycerin", "Acrylates/C10-30 Alkyl Acrylate Crosspolymer"] and got[3] == "Aqua" and got[6] == "W" + "w" * 79


def test_corrections_store_rows_once(spark, monkeypatch):
    """a correction stores all rows once and of the audited ones their new state, in Zstandard; a normalised link joins nothing."""
    kept = []
    monkeypatch.setattr(audit, "stored", lambda df, label, compact=False, f=audit.stored: kept.append((label, compact)) or f(df, label, compact))
    df = ingredients.parsed(spark.createDataFrame([("1", "i", 0, "b", "p", "US", "k", "Water, Glycerin", "www.a.com/x", "Official", "UNREVIEWED", "OK")], "row_id string, import_id string, row_index int, brand string, product_name string, market string, sku_key string, raw_ingredient_text string, source_ref string, source_type string, review_status string, status string"))
    done, records = audit.corrected(df, spark.createDataFrame([("1", {"brand": "c"})], "row_id string, patch map<string,string>"), "me")
    assert done.first()["brand"] == "c" and records.first()["actor"] == "me"
    assert [k for k in kept if k[0] != "lists"] == [("patched", True), ("audited-again", True)]
    records = audit.auto_corrected(df, "r")[1].orderBy("correction_type").collect()
    assert [r["correction_type"] for r in records] == ["normalize_source_ref", "reparse_current_text"]
    assert '"source_ref":"www.a.com/x"' in records[0]["before"] and '"source_ref":"https://www.a.com/x"' in records[0]["after"]


def test_rows_of_one_csv_file_are_parsed_by_all_cores(spark, tmp_path):
    """one task reads a file, but doesn't parse it."""
    (tmp_path / "a.csv").write_text("brand,product,market,ingredients\n" + "b,p,US,Water\n" * 20)
    got = rows.import_candidates(spark, f"{tmp_path}/a.csv", "i")
    assert got.rdd.getNumPartitions() >= 4 and got.count() == 20


def test_export_sorts_stored_rows(spark, monkeypatch):
    """the sort reads its rows twice, so they are parsed before."""
    kept = []
    monkeypatch.setattr(reviews, "stored", lambda df, label, **kw: kept.append(label) or df.limit(0))
    registry.QUERIES["export_candidates"](spark, SF)
    assert kept == ["parsed"]


def test_a_landed_part_is_one_batch(spark, tmp_path, monkeypatch):
    """a part of several files was a batch a file, each of which touches all of the state; its events met Python row by row."""
    seen = []
    monkeypatch.setattr(streams.streaming, "stream_task_progress", lambda *a, f=streaming.stream_task_progress: seen.append(f(*a)) or seen[-1])
    events = view(spark, SF, "SELECT * FROM events").repartition(5)
    monkeypatch.setattr(streams, "view", lambda *_: events.selectExpr("cast(user_id % 20 AS string) AS task_id", "cast(user_id AS string) AS row_id", "ts AS said_at", "event_id AS seq", "'OK' AS status"))
    got = streams.stream_task_progress(spark, SF).agg(F.sum("total").alias("n")).first()["n"]
    assert got == events.select("user_id").distinct().count()
    assert len(seen) == 3 and {len([p for p in q.recentProgress if p["numInputRows"]]) for q in seen} == {1}
    monkeypatch.setattr(streaming, "LANES", 1)  # all rows in one lane
    assert streams.stream_task_progress(spark, SF).agg(F.sum("total").alias("n")).first()["n"] == got


def test_landed_candidates_are_dealt_out_and_merged_narrow(spark, tmp_path, monkeypatch):
    """candidates of one file were parsed by one task, and a batch's rows were all gathered by row_id with their JSON."""
    kept = []
    monkeypatch.setattr(streaming, "stored", lambda df, label, compact=False, f=streaming.stored: kept.append((label, df.rdd.getNumPartitions())) or f(df, label, compact))
    rows_ = [(str(k % 7), "i", k, "b", "p", "US", "k", "Water, Glycerin" if k < 7 else "Water", None, None, None, "OK") for k in range(10)]
    kinds = "row_id string, import_id string, row_index int, brand string, product_name string, market string, sku_key string, raw_ingredient_text string, source_ref string, source_type string, review_status string, status string"
    spark.createDataFrame([*rows_, (None, *rows_[0][1:])], kinds).coalesce(1).write.parquet(f"{tmp_path}/in")
    streaming.stream_candidates(streaming.landed_files(spark, kinds, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = streaming.candidates_snapshot(spark, f"{tmp_path}/out").collect()
    assert sorted(r["row_id"] for r in got) == [str(k) for k in range(7)]
    assert dict(kept)["stream-parsed"] >= 4 and "stream-again" in dict(kept)


def test_walks_broadcast_no_sites(spark):
    """stored levels and sites were broadcast, through the driver, level after level; only the chain's 50 rows may be."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    sites, fetched = view(spark, SF, walks.SITES), walks._fetched(spark, SF)
    found = discovery.sitemap_products(sites, fetched)
    assert "BroadcastHashJoin" not in plan(found) and "SortMergeJoin" in plan(found)
    nested = [line for line in plan(fetched).splitlines() if "BroadcastNestedLoopJoin" in line]
    assert nested and all("BuildRight" in line for line in nested)


def test_csv_job_bounds_its_files_and_spreads_its_rows(spark, tmp_path, monkeypatch):
    """a CSV file of all candidates was read, parsed and written again by one task."""
    monkeypatch.setattr(rows, "TEXT_ROWS", 2)
    (tmp_path / "a.csv").write_text("id,ingredients\n" + "".join(f'{k},"Water,\nGlycerin"\n' for k in range(30)))
    got = rows.parse_csv_job(spark, f"{tmp_path}/a.csv", f"{tmp_path}/out")
    assert got.rdd.getNumPartitions() >= 4 and [r["id"] for r in got.collect()] == [str(k) for k in range(30)]
    files = sorted((tmp_path / "out").glob("*.csv"))
    back = [[r["id"] for r in spark.read.csv(str(f), header=True, multiLine=True, escape='"').collect()] for f in files]
    assert len(files) >= 15 and max(map(len, back)) <= 2 and [k for ids in back for k in ids] == [str(k) for k in range(30)]


def test_auto_corrections_parse_once(spark, monkeypatch):
    """rows that come parsed were parsed anew, and both states of a row joined."""
    df = ingredients.parsed(spark.createDataFrame([(str(k), "i", k, "b", "p", "US", "k", said, ref, "Official", "UNREVIEWED", "OK") for k, (said, ref) in enumerate([("Water, Glycerin", "www.a.com/x"), ("Urea", "https://a.com"), (" ", "www.a.com"), (None, None)])], "row_id string, import_id string, row_index int, brand string, product_name string, market string, sku_key string, raw_ingredient_text string, source_ref string, source_type string, review_status string, status string"))
    kept = lambda made: sorted((r["row_id"], r["correction_type"], r["actor"], r["before"], r["after"]) for r in made[1].collect())
    state = lambda made: sorted(map(str, made[0].select(*df.columns).collect()))
    again = audit.auto_corrected(df, "r")
    want, rows_ = kept(again), state(again)
    monkeypatch.setattr(audit, "parsed", None)
    once = audit.auto_corrected(df, "r", just_parsed=True)
    assert kept(once) == want and len(want) == 4 and state(once) == rows_
    assert registry.QUERIES["auto_corrections"](spark, SF).count() > 0


def test_shortcuts_of_tokens_change_nothing(spark, monkeypatch):
    """tokens that are tidy, keys that are the text in lower case, names of plain words, and long tokens with dots."""
    said = [
        "Water, a3, ä b, A b c, é-f, x\ty, ·a·, -a b-, a.b., (a) b, b (c, d), [e, f] g, ß ss, a  b, a：b, ™x, x™ y, g/h i, 0, . , ;", "a / b / c", "\tx\x0b|\x0c y \r\n z", "İstanbul b, ǆ a, ﬁx me, o'neil d'or, a_b c.d", "a b\u0001c d",
        "Water" + " . " * 60 + "x", "w " * 60, "Aqua" + "(x. y)" * 30, "Aqua" + " ®" * 60 + ", ." * 3, "", "a;b；c、d，e•f·g●h・i",
    ]
    df = spark.createDataFrame(list(enumerate(said)), "k int, cleaned_text string")
    names = lambda: [(r["tokens"], r["n"]) for r in ingredients.tokenized(df).withColumn("n", ingredients.mapped(F.col("tokens"))).orderBy("k").collect()]
    key = lambda: [r["x"] for r in df.select("k", F.transform(F.split("cleaned_text", ","), ingredient_text.lookup_key).alias("x")).orderBy("k").collect()]
    short = names(), key()
    for module in (ingredients, ingredient_text):  # with none of them, all go the whole way
        monkeypatch.setattr(module, "ascii_only", lambda c: F.lit(False) & (F.length(c) < 0))
    monkeypatch.setattr(ingredients, "_long_key", lambda *_: F.lit(False))
    whole = names(), key()
    assert whole[0] == short[0] and whole[1] == short[1]
    monkeypatch.undo()
    got = spark.createDataFrame([(0, "Aqua. " * 20), (1, "w. " * 60), (2, "Aqua" + " ®" * 60)], "k int, t string").select("k", ingredients._long_key(F.col("t"), 44).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in got] == [True, False, False]


def test_audit_run_parses_once_and_stores_what_it_reads(spark, monkeypatch):
    """audit_run parsed its rows twice and stored all rows' texts and arrays three times."""
    kept, parses, plain = [], [], audit.stored
    for module in (audit, reviews):
        monkeypatch.setattr(module, "stored", lambda df, label, compact=False, f=plain: kept.append((label, df.columns)) or f(df, label, compact))
    monkeypatch.setattr(audit, "parsed", lambda *a, **kw: parses.append(a))
    assert registry.QUERIES["audit_run"](spark, SF).count() > 0 and not parses
    held = dict(reversed(kept))  # of a label the first
    assert "audit-among" not in held and not {"inci", "unrecognized", "needs_review"} & set(held["base-rows"])
    assert "raw_ingredient_text" not in held["lists"]


def test_list_keys_of_joined_lists(spark):
    """a list as the parser joins it needs no split."""
    said = ["Aqua; Urea", "Aqua;Urea; ", "; Aqua", "Aqua ; Urea", "Aqua;; Urea", "Aqua;\tUrea", "Aqua;  Urea", "Ärger; ΟΔΟΣ; É", "", " ", ";", "A B; c", None]
    got = [r["x"] for r in spark.createDataFrame(list(enumerate(said)), "k int, t string").select("k", ingredient_text.inci_key(F.col("t")).alias("x")).orderBy("k").collect()]
    assert got == [";".join(p.strip().lower() for p in (t or "").split(";") if p.strip()) for t in said]


def test_audit_rows_shuffle_no_lists_for_few_skus(spark):
    """rows of few skus were shuffled with their lists at each step of the conflict search, and evidence was made to be counted."""
    plan = registry.QUERIES["audit_rows"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan and "strategy=broadcast" in plan
    nested = spark.range(10).select("id", F.struct(F.repeat(F.lit("x"), 1000).alias("t")).alias("s"))
    size = lambda df: "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert size(small(nested, 12000)) and not size(small(nested, 9000))


CANDIDATE = "row_id string, import_id string, row_index int, brand string, product_name string, market string, sku_key string, raw_ingredient_text string, source_ref string, source_type string, review_status string, status string"


def test_patches_joined_before_the_parse_change_nothing(spark, monkeypatch):
    """rows that come with their patch give the rows and records of patches joined to parsed rows, and store only texts that patches give."""
    said = ["Water, Glycerin", "Urea", " ", None, "Water; Foo", "Aqua"]
    df = spark.createDataFrame([(str(k), "i", k, "b", "p", "US", "k", t, "www.a.com/x", "Official", "UNREVIEWED", "OK") for k, t in enumerate(said)], CANDIDATE)
    given = [("0", {"raw_ingredient_text": "Urea, Water", "brand": "c"}), ("1", {"inci_list": "X", "review_status": "APPROVED"}), ("2", {"reviewed_by": " me "}), ("3", {"parse_status": "OK", "parse_confidence": "x"}), ("4", {"raw_ingredient_text": ""}), ("9", {"brand": "none"})]
    patches = spark.createDataFrame(given, "row_id string, patch map<string,string>")
    kept, plain = [], audit.stored
    monkeypatch.setattr(audit, "stored", lambda d, label, compact=False: kept.append((label, d.columns)) or plain(d, label, compact))
    come = plain(ingredients.parsed(audit.with_patches(df, patches)), "come")
    lean = audit.reviewed_rows(come), audit.updated(come)
    assert {k for k, _ in kept} == {"lists", "parsed-again"} and not any("inci_list" in cs for k, cs in kept if k == "lists")
    whole = audit.reviewed(ingredients.parsed(df), patches), (audit.updated(ingredients.parsed(df), patches), None)
    told = lambda d: sorted(str(r.asDict()) for r in d.drop("reviewed_at", "created_at").collect())
    for got, (rows_, records) in zip(lean, whole, strict=True):
        assert told(got.drop("record").select(*rows_.columns)) == told(rows_)
        assert records is None or told(audit.apart(got)[1]) == told(records) and records.count() == 5


def test_conflicts_of_many_skus_are_those_of_few(spark, monkeypatch):
    """where the search's tables are too large to be sent to the rows, rows meet them by joins, with the same findings and evidence."""
    made = [(str(k), str(k % 2), k, "b", "p", "US", f"k{k % 3}" if k % 5 else None, f"Water, Glycerin{'a' * (k % 4)}", "www.a.com/x", "Official", "APPROVED" if k % 2 else "UNREVIEWED", "OK") for k in range(24)]
    df = audit.stored(ingredients.parsed(spark.createDataFrame([*made, (None, *made[1][1:])], CANDIDATE)), "rows")
    told = lambda d: sorted(str(r.asDict()) for r in d.collect())
    few, seen = told(audit.audited(df)), []
    monkeypatch.setattr(audit, "small", lambda d: seen.append(d.columns) or d)
    assert told(audit.audited(df)) == few and seen and sum("duplicate_conflicting_candidate" in x and '"inci_list":"Aqua; Glycerin' in x for x in few) > 10


def test_export_sorts_lean_rows_and_packs_its_files(spark, tmp_path):
    """the sort carries no columns that are made of others again, and files are compressed where asked; the export stays the same."""
    df = ingredients.parsed(spark.createDataFrame([(str(k), k, t) for k, t in enumerate(["Water, foo bar, 水仙, foo bar, <b>Baz</b>", "no source", "", None, "a" * 90, 'x "q"\ny, z'])], "row_id string, row_index int, raw_ingredient_text string")).cache()
    again = ingredients.whole(ingredients.lean(df))
    assert [r.asDict(True) for r in again.select(*df.columns).orderBy("row_index").collect()] == [r.asDict(True) for r in df.orderBy("row_index").collect()] and dict(again.dtypes) == dict(df.dtypes)
    assert not {"inci_list", "unrecognized", "needs_review"} & set(ingredients.lean(df).columns)
    read = lambda p: [r.asDict() for r in spark.read.csv(p, header=True, multiLine=True, escape='"').orderBy("row_id").collect()]
    rows.write_csv(rows.exported(df, "reviewed"), f"{tmp_path}/plain")
    rows.write_csv(rows.exported(ingredients.lean(df), "reviewed", ingredients.whole), f"{tmp_path}/packed", compression="gzip")
    assert read(f"{tmp_path}/plain") == read(f"{tmp_path}/packed") and len(read(f"{tmp_path}/plain")) == 6
    assert list((tmp_path / "packed").glob("*.csv.gz")) and not list((tmp_path / "packed").glob("*.csv"))


def test_patches_and_the_parse_deal_rows_out_once(spark, monkeypatch):
    """texts were spread over the cores and then shuffled again to meet their patches."""
    seen = []
    monkeypatch.setattr(reviews, "stored", lambda df, label, compact=False: seen.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for most in ("-1", threshold):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            reviews.base_rows(spark, SF, audit.READ, reviews._patches(spark, SF, {"brand": "'x'"}, "row_index % 3 = 0"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in seen[0] and seen[0].count("Exchange hashpartitioning") == 2 and "RoundRobin" not in seen[0]
    assert "BroadcastHashJoin" in seen[1] and seen[1].count("Exchange hashpartitioning") == 1
