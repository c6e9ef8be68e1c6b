"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, pseudonyms, and mixing to target weights.

Each stage takes a table with the columns of documents (doc_id, text, source and any others) and all but the last
return the same columns. Rows with nulls pass as each docstring says; an empty table gives an empty one.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, mixing, near_dup, pii, quality
from larkspur.llm._shared import small, stored, table, whole_row

#: The setting that holds the secret of the pseudonyms.
KEY_SETTING = "spark.larkspur.pii.key"
_KEYS: dict[str, str] = {}


def pii_key(spark: SparkSession) -> str:
    """The session's key; where it has none, a random one that holds for the application and is nowhere kept, so its pseudonyms can't be undone or linked to another run's."""
    return spark.conf.get(KEY_SETTING, None) or _KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules on repetition reject go.

    Null texts and texts of under 50 words are rejected, whatever their other columns hold. Each row is judged by its
    text alone, so repeated rows stay or go together. Columns that are named like a figure of the rules keep their values.
    """
    figures = quality.repetition(docs.select(F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    return figures.filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the smallest id; of classes without an id that of the smallest text.

    Of rows of one id one stays, that of the smallest text, then of the smallest other values. Null texts and texts
    without words are one class.
    """
    return near_dup.representatives(docs).select(*[f"`{c}`" for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Items of fewer than five words are too common to tell a leak.

    A document is a row's id, which may be null, and its text: all its repeated rows go, and another text of the same
    id stays. Null texts hold nothing and stay.
    """
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"), shortest=decontaminate.SHINGLE).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    found = small(stored(found, "pipeline-leaks"))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]) & (F.xxhash64(docs["text"]) == found["__key"]), "left_anti").select(*[f"`{c}`" for c in docs.columns])


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts give way to pseudonyms, by the session's key (see pii_key).

    Each row gives one row, with all its other columns; null texts stay null. Equal rows give equal ones.
    """
    changed = pii.pseudonymised(docs.select(F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), pii_key(spark))
    return changed.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


_ADDED = ("size", "source_size", "target", "copies", "taken")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, copies and taken (words); those of which it takes nothing go.

    Null and empty texts have no words and go. A null source is a source of its own. Repeated rows are taken each, by
    copies of their own; of rows that differ in other columns alone the first in their order get more, so reruns agree. Columns of the added names are replaced.
    """
    plan = mixing.mixed(docs).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("source").alias("__source"), *_ADDED)
    plan = stored(plan, "pipeline-plan")
    rows = docs.select(*[f"`{c}`" for c in docs.columns if c not in _ADDED], F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("__text"))
    twice = stored(plan.groupBy("__id", "__key", "__source").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("__id").alias("i"), F.col("__key").alias("k"), F.col("__source").alias("s")), "pipeline-twice")
    held = whole_row(rows, [c for c in rows.columns if c not in ("doc_id", "text", "source", "__text")])  # rows that differ in other columns alone get their copies in that order
    plan, rows = _numbered(plan, ["__id", "__key", "__source"], twice, F.col("copies").desc(), "__n"), _numbered(rows, ["doc_id", "__text", "source"], twice, held, "__m")
    same = rows["doc_id"].eqNullSafe(plan["__id"]) & (rows["__text"] == plan["__key"]) & rows["source"].eqNullSafe(plan["__source"]) & (rows["__m"] == plan["__n"])
    return rows.join(plan.filter("taken > 0"), same).drop("__id", "__key", "__source", "__text", "__n", "__m")


def _numbered(rows: DataFrame, keys: list[str], twice: DataFrame, order, name: str) -> DataFrame:
    """rows with 1 under `name`, but those of keys in `twice` counted up from 1: only these are shuffled for it."""
    if twice.isEmpty():
        return rows.withColumn(name, F.lit(1))
    twice = small(twice)
    met = F.col(keys[0]).eqNullSafe(twice["i"]) & (F.col(keys[1]) == twice["k"]) & F.col(keys[2]).eqNullSafe(twice["s"])
    several = rows.join(twice, met, "left_semi").withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return rows.join(twice, met, "left_anti").withColumn(name, F.lit(1)).unionByName(several)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("pseudonyms", pseudonyms), ("mixing", mix)]
#: Suffix arrays, signatures and keyed permutations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
