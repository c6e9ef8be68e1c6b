"""The registered queries of the operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import chat, decontaminate, langid, licenses, mixing, near_dup, negatives, packing, pii, quality, suffix_dedup, warc, whitening
from larkspur.llm._shared import shared_dir, table


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op9_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The key of the registered query; a real run passes its own secret.
PII_KEY = "registered query"


def op1_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return langid.identified(table(spark, sf_dir, "documents"), F.coalesce(held_out, F.lit(False)))


def op4_simhash_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents")).drop("kept")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapsed(table(spark, sf_dir, "conversations"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = parts.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"))
    return packing.packed(digests)


def op12_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_gnat_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.prepared(table(spark, sf_dir, "embeddings"))
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", changed), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_feistel_pii, op2_warc_archive, op3_kneser_ney_langid, op4_simhash_leaks, op5_pivotal_mix, op6_suffix_array_dedup, op7_license_scan, op8_chat_snapshots, op9_suffix_repetition, op10_bag_minhash, op11_best_fit_packing, op12_polarised_whitening, op13_gnat_negatives)}
SQL = {"op8_chat_snapshots": chat.SQL, "op13_gnat_negatives": negatives.SQL}
