"""Harvest of ingredient texts from page snapshots (H1 to H4, H7, H8) and page signals (C14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import fixed
from larkspur.functions.core import collapse, let, strip, text
from larkspur.functions.ingredient_text import block_label_stripped, clean_block, has_inci_signal, ingredient_score, inline_sequence, is_script_or_json, meaningful
from larkspur.operators.elements import blocks  # noqa: F401  (H1)
from larkspur.operators.ingredients import INCI, parsed
from larkspur.scratch import stored

def ranked_blocks(found: DataFrame) -> DataFrame:
    """H2: per page the best block: its inline sequence of ten characters or more, no script, score 0.3 or more; of equal ones the first, by score, length, place."""
    good = lambda said: let(ingredient_score(said), lambda score: F.when((F.length(said) >= 10) & ~is_script_or_json(said) & (score >= 0.3), F.array(F.struct(said.alias("said"), score.alias("score")))))
    # a filter on `said` would be moved before it and make it anew for each condition; nothing moves past an explosion
    rows = found.select("page_id", "pos", F.explode_outer(let(inline_sequence(F.col("block")), good)).alias("b")).filter("b is not null").select("page_id", "pos", "b.*")
    first = Window.partitionBy("page_id", F.lower("said")).orderBy("pos")
    best = Window.partitionBy("page_id").orderBy(F.col("score").desc(), F.length("said"), "pos")
    rows = rows.withColumn("k", F.row_number().over(first)).filter("k = 1").withColumn("k", F.row_number().over(best)).filter("k = 1")
    return rows.select("page_id", "said", "score")


def verified(said: Column, page_text: Column) -> Column:
    """H3: the first twenty characters of the cleaned text occur in the page's text."""
    start = F.lower(F.substring(collapse(block_label_stripped(clean_block(said))), 1, 20))
    return (start != "") & F.contains(F.lower(text(page_text)), start)


def variant_hint(product: Column) -> Column:
    """H4: what follows the last " - " of a product's name, unless it tells a size or a kit."""
    hint = strip(F.regexp_extract(collapse(text(product)), r"^.* - (.*)$", 1))
    return F.when(hint.rlike(fixed.SIZE_HINT), "").otherwise(hint)


def variant_blocks(found: DataFrame, products: DataFrame) -> DataFrame:
    """H4: page_id, said, score, ambiguous, for pages of products (page_id, product_name) with a hint: the best pop-up paragraph that names it, or the next within three up to another label; ambiguous if others are named only."""
    hints = products.select("page_id", variant_hint(F.col("product_name")).alias("hint")).filter("hint <> ''")
    rows = found.filter("kind = 'popup'").join(hints, "page_id")
    order = Window.partitionBy("page_id").orderBy("pos")
    short = (F.length("block") <= 40) & ~F.col("block").rlike("[,/;]") & ~has_inci_signal(F.col("block")) & (F.size(F.split("block", r"\s+")) <= 3)
    rows = rows.withColumns({"names": F.contains(F.lower("block"), F.lower("hint")), "label": short})
    near = [F.lag(F.col("names") & ((F.length("block") < 15) | ~has_inci_signal(F.col("block"))), k).over(order) for k in (1, 2, 3)]
    other = F.col("label") & ~F.col("names")
    blocked = [F.lit(False), F.coalesce(F.lag(other, 1).over(order), F.lit(False)), F.coalesce(F.lag(other, 1).over(order), F.lit(False)) | F.coalesce(F.lag(other, 2).over(order), F.lit(False))]
    follows = F.lit(False)
    for n, b in zip(near, blocked, strict=True):
        follows = follows | (F.coalesce(n, F.lit(False)) & ~b)
    rows = rows.withColumn("mine", F.col("names") | (follows & ~other))
    bare = strip(F.regexp_replace(strip(F.regexp_replace(clean_block(F.col("block")), r"(?i)^ingredients?\s+", "")), F.concat(F.lit(r"(?i)^\Q"), F.col("hint"), F.lit(r"\E\b[\s:：-]*")), ""))
    good = rows.filter("mine").withColumn("said", bare).filter((F.length("said") >= 10) & ~is_script_or_json(F.col("said")) & has_inci_signal(F.col("said"))).withColumn("score", ingredient_score(F.col("said"))).filter("score >= 0.3")
    best = good.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("score").desc(), F.length("said"), "pos"))).filter("k = 1").select("page_id", "said", "score", F.lit(False).alias("ambiguous"))
    first_word = F.lower(F.regexp_extract("block", r"^[^\s:]{3,}", 0))
    labels = rows.filter(~F.col("block").rlike("(?i)^(ingredients?|inci)")).groupBy("page_id", "hint").agg(F.collect_set(F.nullif(first_word, F.lit(""))).alias("labels"))
    unsure = labels.filter((F.size("labels") >= 2) & ~F.array_contains("labels", F.lower("hint"))).join(best.select("page_id"), "page_id", "left_anti")
    return best.unionByName(unsure.select("page_id", F.lit("").alias("said"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous")))


def chosen(attempts: DataFrame) -> DataFrame:
    """H7: per row the source of its attempts (row_id, group_no, url_no, url, status, score, verified, said, ambiguous).

    Of each group the first three URLs count. The first attempt that is verified at 0.8 or more is OK; an ambiguous
    one before it gives PENDING 0.3 without a text; else the best by score + 0.05 if verified, the earliest of equals,
    is PENDING between 0.3 and 0.8; without any text NEEDS_SOURCE 0.
    """
    order = Window.partitionBy("row_id").orderBy("group_no", "url_no")
    rows = attempts.filter("url_no < 3").withColumn("n", F.row_number().over(order))
    has = F.col("said").isNotNull() & (F.col("said") != "")
    stop = F.when(F.col("ambiguous"), "ambiguous").when(has & F.col("verified") & (F.col("score") >= 0.8), "ok")
    value = F.col("score") + F.when(F.col("verified"), 0.05).otherwise(0.0)
    pick = rows.withColumns({"stop": stop, "value": F.when(has, value)}).groupBy("row_id").agg(
        F.min(F.when(F.col("stop").isNotNull(), F.struct("n", "stop", "url", "said", "score"))).alias("s"), F.max(F.when(F.col("value").isNotNull(), F.struct("value", (-F.col("n")).alias("m"), "url", "said"))).alias("b"),
    )
    ok, unsure = F.col("s.stop") == "ok", F.col("s.stop") == "ambiguous"
    return pick.select(
        "row_id", F.when(ok, "OK").when(unsure | F.col("b").isNotNull(), "PENDING").otherwise("NEEDS_SOURCE").alias("status"),
        F.when(ok, F.col("s.score")).when(unsure, 0.3).when(F.col("b").isNotNull(), F.least(F.lit(0.8), F.greatest(F.lit(0.3), F.col("b.value")))).otherwise(0.0).alias("confidence"),
        F.when(F.col("s").isNotNull(), F.col("s.url")).otherwise(F.col("b.url")).alias("source_ref"), F.when(ok, F.col("s.said")).when(~F.coalesce(unsure, F.lit(False)), F.col("b.said")).alias("raw_ingredient_text"),
    )


_OUTCOME = ("status", "confidence", "source_ref", "source_type", "raw_ingredient_text", "error")
_CLEARED = {"cleaned_text": "string", "parse_status": "string", "inci_list": "string", "parse_confidence": "double", "reviewed_by": "string", "reviewed_at": "timestamp", "audit_score": "double", "source_match_status": "string", "ingredient_signal_type": "string"}


def applied(rows: DataFrame, outcome: DataFrame) -> DataFrame:
    """H8: rows with their outcome (row_id, status, confidence, source_ref, source_type?, raw_ingredient_text, error?) written in, parse, review and audit reset, and parsed anew where there is a text. An outcome with an error makes the row's status ERROR and keeps its first 500 characters; the rest of that row stays."""
    have = outcome.columns
    new = outcome.select("row_id", *[(F.col(c) if c in have else F.lit(None).cast("string")).alias(f"n_{c}") for c in _OUTCOME], F.lit(True).alias("__hit"))
    out = rows.join(new, "row_id", "left")
    failed = F.col("n_error").isNotNull()
    hit = F.coalesce(F.col("__hit") & ~failed, F.lit(False))
    kinds = dict(rows.dtypes)
    old = lambda c, kind: F.col(c) if c in kinds else F.lit(None).cast(kind)
    changed = {c: F.when(hit, F.col(f"n_{c}")).otherwise(old(c, "double" if c == "confidence" else "string")) for c in _OUTCOME[:-1]}
    changed["status"] = F.when(F.coalesce(F.col("__hit") & failed, F.lit(False)), "ERROR").otherwise(changed["status"])
    changed["error"] = F.when(F.col("__hit"), F.substring("n_error", 1, 500)).otherwise(old("error", "string"))
    changed |= {c: F.when(~hit, old(c, kind)) for c, kind in _CLEARED.items()}
    changed |= {"review_status": F.when(hit, "UNREVIEWED").otherwise(old("review_status", "string")), "audit_status": F.when(hit, "UNAUDITED").otherwise(old("audit_status", "string")), "ingest_allowed": F.when(hit, False).otherwise(old("ingest_allowed", "boolean"))}
    for c, kind in (("inci", INCI), ("unrecognized", "array<string>"), ("notes", "array<string>"), ("needs_review", "array<struct<original_text:string,issue:string>>")):
        changed[c] = F.when(~hit, old(c, kind))
    out = stored(out.withColumns(changed).withColumn("__hit", hit).drop(*[f"n_{c}" for c in _OUTCOME]), "harvested")
    again = F.col("__hit") & (meaningful(F.col("raw_ingredient_text")) != "")
    return parsed(out.filter(again)).select(*out.columns).unionByName(out.filter(~again)).drop("__hit")
