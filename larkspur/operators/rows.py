"""Candidate rows: import, alignment, listing, selection, review queue, export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.core import let, strip, text
from larkspur.functions.ingredient_text import meaningful
from larkspur.functions.urls import normalize_url_like
from larkspur.operators.ingredients import parsed
from larkspur.scratch import SPREAD

#: Column names of candidate files, the first that a file has counts.
ALIASES = {
    "brand": ["brand", "brand_en", "brand_zh", "brand_original"],
    "product_name": ["product_name", "product", "product_name_en", "product_name_zh", "product_name_original", "product title"],
    "market": ["market", "country", "region"],
    "raw_ingredient_text": ["raw_ingredient_text", "ingredients", "ingredient_text"],
    "candidate_id": ["candidate_id"],
    "sku_key": ["sku_key", "sku"],
    "external_seed_id": ["external_seed_id", "seed_id"],
    "external_product_id": ["external_product_id"],
    "source_ref": ["source_ref", "source_url", "url"],
    "source_type": ["source_type"],
    "status": ["status", "harvest_status"],
    "confidence": ["confidence", "harvest_confidence"],
}
DEFAULTS = {"review_status": "UNREVIEWED", "audit_status": "UNAUDITED", "ingest_allowed": False}


def candidates(raw: DataFrame, index: str = "row_index", also: tuple[str, ...] = ()) -> DataFrame:
    """S1 on a frame of strings that has an index column: aliases resolved, blanks null, incomplete rows dropped; columns of `also` are kept as they are."""
    have = {c.strip().lower(): c for c in raw.columns}
    found = {name: next((have[a] for a in aliases if a in have), None) for name, aliases in ALIASES.items()}
    if missing := [c for c in ("brand", "product_name", "market") if not found[c]]:
        raise ValueError(f"no column for {', '.join(missing)}")
    cell = lambda c: meaningful(F.col(f"`{found[c]}`").cast("string")) if found[c] else F.lit("")
    rows = raw.select(F.col(index).alias("row_index"), *also, *[cell(c).alias(c) for c in ALIASES]).filter("brand <> '' and product_name <> '' and market <> ''")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    url = normalize_url_like(F.col("source_ref"))
    confidence = F.col("confidence").try_cast("double") if found["confidence"] else F.when(F.col("raw_ingredient_text") != "", 1.0)
    return rows.select(
        "row_index", *also, "brand", "product_name", "market", blank("candidate_id").alias("candidate_id"), F.coalesce(blank("sku_key"), blank("candidate_id")).alias("sku_key"), blank("external_seed_id").alias("external_seed_id"),
        blank("external_product_id").alias("external_product_id"), blank("raw_ingredient_text").alias("raw_ingredient_text"), F.nullif(F.when(url != "", url).otherwise(F.col("source_ref")), F.lit("")).alias("source_ref"), blank("source_type").alias("source_type"),
        F.coalesce(blank("status"), F.when(F.col("raw_ingredient_text") != "", "SKIPPED").otherwise("EMPTY")).alias("status"), confidence.alias("confidence"),
    )


def import_candidates(spark: SparkSession, path: str, import_id: str) -> DataFrame:
    """S1 from CSV files, parsed where there is text. Rows are numbered in the order of their file before any is dropped; row_id also holds the file, so several files don't collide. Fields may hold line breaks, so a file is read by one task; its rows are then dealt out to be parsed."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumns({"__at": F.monotonically_increasing_id(), "__file": F.input_file_name()})
    raw = raw.withColumn("row_index", F.row_number().over(Window.partitionBy("__file").orderBy("__at")) - 1)
    rows = candidates(raw, also=("__file",)).withColumns({"import_id": F.lit(import_id), "row_id": F.concat_ws("-", F.lit(import_id), F.substring(F.sha1(F.encode("__file", "UTF-8")), 1, 8), "row_index")}).drop("__file")
    return aligned(parsed(rows.repartition(SPREAD * spark.sparkContext.defaultParallelism)))


def aligned(rows: DataFrame) -> DataFrame:
    """The newer columns with their defaults where they lack or are null."""
    for c, v in DEFAULTS.items():
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v))
    return rows


def listed(rows: DataFrame, import_id: str, q: str | None = None, limit: int = 200, offset: int = 0, **equal) -> DataFrame:
    """A page of an import's rows in order, with the count of all that match."""
    out = rows.filter(F.col("import_id") == import_id)
    for c, v in equal.items():
        out = out.filter(F.col(c) == v)
    if q:
        held = F.lit(False)
        for c in [c for c in ("brand", "product_name", "candidate_id", "sku_key") if c in rows.columns]:
            held = held | F.contains(F.lower(text(F.col(c))), F.lit(q.lower()))
        out = out.filter(held)
    total = out.agg(F.count(F.lit(1)).alias("total"))
    return out.orderBy("row_index").offset(offset).limit(max(1, min(500, limit))).crossJoin(F.broadcast(total))


def selected(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose row_id is in ids."""
    return rows.join(ids.select("row_id").distinct(), "row_id", "left_semi")


def page_window(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A slice in a stable order, with has_more and next_offset."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    more = F.col("total") > offset + limit
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total)).withColumns({"has_more": more, "next_offset": F.when(more, offset + limit)})


def review_queue(rows: DataFrame, status: str) -> DataFrame:
    """Rows with a text or a parse whose parse status (NEEDS_REVIEW if never parsed) is the one asked for."""
    signal = (strip(text(F.col("raw_ingredient_text"))) != "") | F.col("parse_status").isNotNull()
    return rows.filter(signal & (F.coalesce("parse_status", F.lit("NEEDS_REVIEW")) == status))


EXPORT = ["row_id", "row_index", "brand", "product_name", "market", "status", "confidence", "source_type", "source_ref", "raw_ingredient_text", "error", "updated_at"]
EXPORT_REVIEWED = [*EXPORT, "candidate_id", "sku_key", "external_seed_id", "external_product_id", "cleaned_text", "parse_status", "parse_confidence", "inci_list", "inci", "unrecognized", "notes", "needs_review", "review_status", "reviewed_by", "reviewed_at", "audit_status", "audit_score", "source_match_status", "ingredient_signal_type", "ingest_allowed"]


def exported(rows: DataFrame, mode: str = "basic", whole: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """S3: the columns to export, in order of row_index; arrays as JSON. whole: makes columns that needn't be sorted with the rows."""
    if mode not in ("basic", "reviewed"):
        raise ValueError(f"unknown export mode {mode!r}")
    rows = whole(rows.orderBy("row_index"))
    kinds = dict(rows.dtypes)
    cell = lambda c: F.lit(None).cast("string").alias(c) if c not in kinds else F.to_json(c).alias(c) if kinds[c].startswith("array") else F.col(c)
    return rows.select(*[cell(c) for c in (EXPORT if mode == "basic" else EXPORT_REVIEWED)])


#: Rows of a CSV file of long texts. Fields may hold line breaks, so whoever reads a file needs one task for it.
TEXT_ROWS = 4096


def write_csv(rows: DataFrame, path: str, quote_all: bool = False, most: int = 0, compression: str = "none") -> None:
    """CSV with doubled quotes; with quote_all every field is quoted. most: rows a file at most (0: any number)."""
    rows.write.option("maxRecordsPerFile", most).csv(path, header=True, quoteAll=quote_all, escape='"', mode="overwrite", compression=compression)


def parse_csv_job(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Reads CSV, drops earlier outputs, and writes it with seven parse columns, in the order of its rows. A file is read by one task; its rows are then dealt out in ranges to be parsed, and written in files of TEXT_ROWS rows."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    raw = raw.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(SPREAD * spark.sparkContext.defaultParallelism, "__at").sortWithinPartitions("__at").drop("__at")
    old = {"parse_status", "inci_list", "inci_list_json", "unrecognized_tokens", "normalization_notes", "parse_confidence", "needs_review"}
    raw = raw.drop(*[c for c in raw.columns if c.strip().lower() in old])
    names = {c.strip().lower(): c for c in raw.columns}
    column = next((names[a] for a in ("raw_ingredient_text", "ingredients", "ingredient_text", "raw_ingredients") if a in names), None)
    rows = parsed(raw.withColumn("__raw", F.col(f"`{column}`") if column else F.lit(None).cast("string")), "__raw").drop("__raw", "cleaned_text")
    done = rows.withColumns({"inci_list_json": F.to_json("inci"), "unrecognized_tokens": F.to_json("unrecognized"), "normalization_notes": F.to_json("notes"), "needs_review": F.to_json("needs_review")}).drop("inci", "unrecognized", "notes")
    write_csv(done, out, most=TEXT_ROWS)
    return done


def variants_export(variants: DataFrame) -> DataFrame:
    """The fourteen columns, image URLs distinct in order."""
    have = variants.columns
    names = ["id", "sku", "brand", "product_title", "product_url", "option_name", "option_value", "price", "currency", "stock", "description", "image_urls", "deep_link", "simulated"]
    joined = lambda c: F.array_join(F.array_distinct(F.filter(c, lambda u: strip(text(u)) != "")), " | ")
    return variants.select(*[F.lit("").alias(c) if c not in have else joined(c).alias(c) if c == "image_urls" else text(F.col(c).cast("string")).alias(c) for c in names])


def products_export(rollup: DataFrame) -> DataFrame:
    """C7 with prices of two decimals, in order of title."""
    two = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c))).otherwise("").alias(c)
    return rollup.orderBy("title", "product_url").select(*[two(c) if c in ("min_price", "max_price") else F.col(c) for c in rollup.columns])


def task_progress(task_rows: DataFrame) -> DataFrame:
    """H9: per task the rows by status, how many are done, and whether it is completed."""
    done = ["OK", "PENDING", "NEEDS_SOURCE", "SKIPPED", "ERROR"]
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in done]
    return task_rows.groupBy("task_id").agg(F.count(F.lit(1)).alias("total"), *counts).withColumn("done", sum((F.col(s.lower()) for s in done), F.lit(0).cast("long"))).withColumn("task_status", F.when(F.col("done") == F.col("total"), "COMPLETED").otherwise("RUNNING"))
