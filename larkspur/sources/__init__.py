"""Sources of snapshots: product feeds and fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.scratch import small

VARIANT = "struct<id:long,sku:string,title:string,option1:string,option2:string,option3:string,price:string,available:boolean,inventory_quantity:int,featured_image:variant>"
FEED = f"id long, title string, handle string, body_html string, variants array<{VARIANT}>, options array<struct<name:string>>, images variant, featured_image variant"
PAGE_FETCH = "url string, final_url string, status int, headers map<string,string>, content_type string, html string, fetched_at timestamp"


def read_product_feed(spark: SparkSession, path: str, max_pages: int | None = None, page_size: int | None = None, multi_line: bool = True) -> DataFrame:
    """Products, with their feed, of landed feed pages: JSON with products and page, a page a file, or with multi_line=False a page a line.

    A feed is what the page's `feed` says, else the folder that the file lies in; a page without a number is a first
    one. Each feed is read like a shop would be asked, page after page from 1: with page_size it ends with its own first
    page of fewer products, and before the first that isn't there; with max_pages it ends there at the latest.
    """
    pages = spark.read.schema(f"feed string, page int, products array<struct<{FEED.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=multi_line)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/", 1)
    pages = pages.select(F.coalesce("feed", folder).alias("feed"), F.coalesce("page", F.lit(1)).alias("page"), F.coalesce("products", F.array()).alias("products"))
    if max_pages is not None:
        pages = pages.filter(F.col("page") <= max_pages)
    if page_size is not None:
        # numbers of pages alone are shuffled, not their products; a feed has few pages
        sizes = pages.groupBy("feed", "page").agg(F.sum(F.size("products")).alias("n"))
        before = Window.partitionBy("feed").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
        order = Window.partitionBy("feed").orderBy("page")
        sound = (F.coalesce(F.min("n").over(before), F.lit(page_size)) >= page_size) & (F.row_number().over(order) == F.col("page"))
        pages = pages.join(small(sizes.withColumn("sound", sound).filter("sound").select("feed", "page")), ["feed", "page"], "left_semi")
    return pages.select("feed", F.explode("products").alias("p")).select("p.*", "feed")


def read_page_fetch(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages."""
    return spark.read.schema(PAGE_FETCH).parquet(path)
