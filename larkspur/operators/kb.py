"""The knowledge base: rows, hash embeddings, upsert and search."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.core import first_nonblank, let, strip, text
from larkspur.operators import cells
from larkspur.scratch import stored


def kb_tokens(c: Column) -> Column:
    """K1."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit("[A-Za-z0-9]+(?:[-_'][A-Za-z0-9]+)*|[\\u4e00-\\u9fff]+"), 0)


def gates(rows: DataFrame, parse: str | None = "OK", review: str | None = "APPROVED", audit: str | None = "PASS", need_allowed: bool = True) -> DataFrame:
    """An empty gate is off."""
    out = rows
    for column, gate in (("parse_status", parse), ("review_status", review), ("audit_status", audit)):
        if gate:
            out = out.filter(F.upper(strip(text(F.col(column)))) == gate.upper())
    if need_allowed:
        out = out.filter(F.lower(F.col("ingest_allowed").cast("string")).isin("1", "true", "yes", "y", "on"))
    return out


def kb_rows(rows: DataFrame, **options) -> DataFrame:
    """K4: sku_key, fields and kb_text of the rows that pass the gates and have a key and some text."""
    columns = rows.columns
    key = first_nonblank(*[F.col(c) for c in ("candidate_id", "sku_key", "row_id", "id") if c in columns])
    inci, clean = strip(text(F.col("inci_list"))), strip(text(F.col("cleaned_text")))
    parts = F.concat_ws(" | ", *[F.when(strip(text(F.col(c))) != "", F.concat(F.lit(f"{label}:"), strip(F.col(c)))) for label, c in (("brand", "brand"), ("product", "product_name"), ("market", "market"), ("category", "category")) if c in columns], F.when(inci != "", F.concat(F.lit("inci:"), inci)).otherwise(F.concat(F.lit("ingredients:"), clean)))
    passed = gates(rows, **options).withColumn("kb_key", key).filter((F.col("kb_key").isNotNull()) & ((inci != "") | (clean != "")))
    return passed.withColumn("kb_text", parts).drop("sku_key").withColumnRenamed("kb_key", "sku_key")


@F.pandas_udf(T.LongType())
def _blake(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big", signed=True))


def slots(rows: DataFrame, id: str, said: str, dim: int = 384, hash: str = "blake2b") -> DataFrame:
    """K2, sparse: id, slot, value: the normalised signed counts of hashed tokens; each distinct token is hashed once."""
    words = rows.select(id, F.explode(kb_tokens(F.col(said))).alias("token")).groupBy(id, "token").agg(F.count(F.lit(1)).alias("k"))
    if hash == "md5":
        number = F.conv(F.substring(F.md5("token"), 1, 15), 16, 10).cast("long")
        hashed = words.withColumn("h", number)
    else:
        distinct = words.select("token").distinct().withColumn("h", _blake("token"))
        hashed = words.join(distinct, "token")
    low = F.col("h").bitwiseAND(F.lit((1 << 63) - 1))
    high = F.when(F.col("h") < 0, pow(2, 63, dim)).otherwise(0)  # an unsigned 64-bit number
    sign = F.when(F.col("h").bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)
    summed = hashed.groupBy(id, ((low % dim + high) % dim).cast("int").alias("slot")).agg(F.sum(sign * F.col("k")).alias("v")).filter("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(id)).cast("double"))
    return summed.select(id, "slot", (F.col("v") / norm).alias("value"))


def embedded(rows: DataFrame, id: str, said: str, dim: int = 384, hash: str = "blake2b") -> DataFrame:
    """K2: id and embedding array<float>; zeros without tokens."""
    entry = slots(rows, id, said, dim, hash).groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)).cast("float"))
    return rows.select(id).join(entry, id, "left").select(id, F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0).cast("float"), dim)).otherwise(dense).alias("embedding"))


def vector_text(v: Column) -> Column:
    """K3."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string("%.6f", x.cast("double"))), ","), F.lit("]"))


def upserted(base: DataFrame, new: DataFrame, order: str, keys: tuple[str, ...] = ("sku_key",), now: Column | None = None) -> DataFrame:
    """K5: the new snapshot: the last new row of a key (by `order`) replaces, created_at stays, updated_at is now."""
    now = F.current_timestamp() if now is None else now
    last = new.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).filter("k = 1").drop("k", order, "created_at", "updated_at")
    values = [c for c in base.columns if c not in (*keys, "created_at", "updated_at")]
    both = base.alias("o").join(last.withColumn("__new", F.lit(True)).alias("n"), list(keys), "full")
    is_new = F.coalesce(F.col("__new"), F.lit(False))
    return both.select(*keys, *[F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values], F.coalesce("o.created_at", now).alias("created_at"), F.when(is_new, now).otherwise(F.col("o.updated_at")).alias("updated_at"))


def cosine_distance(x: Column, y: Column) -> Column:
    """1 - cosine; null for a zero vector."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return let(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), lambda n: F.when(n > 0, 1 - dot(x, y) / n))


def _unit(v: Column) -> Column:
    """A vector of length one; null for a zero vector."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, p: s + p.cast("double") * p.cast("double")))
    return let(norm, lambda n: F.when(n > 0, F.transform(v, lambda p: p.cast("double") / n)))


def _chosen(base: DataFrame, market: str | None, parse_status: str | None) -> DataFrame:
    for column, value in (("market", market), ("parse_status", parse_status)):
        base = base if value is None else base.filter(F.col(column) == value)
    return base


def search(base: DataFrame, queries: DataFrame, id: str, limit: int = 10, embedding: str = "embedding", market: str | None = None, parse_status: str | None = "OK") -> DataFrame:
    """K6: per query (query_id, query_embedding: a stated set) the nearest rows by cosine distance, rank 1 to limit; of a market, if given, and of a parse status (OK; None for all).

    Zero vectors have no distance and come last. Exact: see cells.nearest.
    """
    rows = _chosen(base, market, parse_status).select(id, _unit(F.col(embedding)).alias("u"))
    return cells.nearest(rows, queries.select("query_id", _unit(F.col("query_embedding")).alias("q")), id, limit)


def search_cells(base: DataFrame, queries: DataFrame, id: str, limit: int = 10, k: int | None = None, probes: int | None = None, embedding: str = "embedding", recall_target: float = 0.95, sample_queries: int = 200) -> DataFrame:
    """K7: K6 over an index of cells: query_id, id, rank, distance, and recall for the sampled queries (null for others).

    The index is written once (cells.build). Up to sample_queries of the queries, by hash, are also searched exactly:
    what they need for the recall target sets the probes and the candidates of all; the others are searched over cells
    alone. Of equally near rows any may be found.
    """
    rows = base.select(id, _unit(F.col(embedding)).alias("u"))
    asked = stored(queries.select("query_id", _unit(F.col("query_embedding")).alias("q")), "cell-queries")
    index = cells.build(rows, id, k)
    if index is None:
        return cells.nearest(rows.limit(0), asked, id, limit).withColumn("recall", F.lit(None).cast("double"))
    some = stored(asked.orderBy(F.xxhash64("query_id"), "query_id").limit(sample_queries), "cell-sample")
    probes, depth, measured = cells.recalled(index, rows.filter("u is not null"), some, limit, recall_target, probes)
    return cells.within(index, asked, limit, probes, depth).join(measured, "query_id", "left")
