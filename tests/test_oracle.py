"""Every registered query of the library against its SQL in DuckDB, at the smallest size."""

from __future__ import annotations

import hashlib
import math
import re

import duckdb
import pytest

from larkspur.plans import markup, pages, registry, reviews, streams, structures, walks  # noqa: F401
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    return v


def compare(df, con, sql):
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    mine = sorted(repr([value(r[c]) for c in cols]) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    assert mine == sorted(repr([value(r[k]) for k in at]) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, name):
    compare(registry.QUERIES[name](spark, SF), duck, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_recall_of_cells(spark):
    """K7 reaches the recall that it promises, and probing all cells is exact."""
    found = registry.QUERIES["kb_search_cells"](spark, SF).select("query_id", "recall").distinct().collect()
    assert found and sum(r["recall"] for r in found) >= 0.9 * len(found)


def test_blake_embeddings(spark):
    """K2 with BLAKE2b against plain Python, whole texts."""
    got = {r["doc_id"]: [float(x) for x in r["embedding"].strip("[]").split(",")] for r in registry.QUERIES["kb_embeddings"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        slots = [0.0] * 384
        for token in re.findall("[A-Za-z0-9]+(?:[-_'][A-Za-z0-9]+)*|[\u4e00-\u9fff]+", (text or "").lower()):
            n = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
            slots[n % 384] += 1 if n % 2 else -1
        norm = math.sqrt(sum(x * x for x in slots)) or 1.0
        assert got[d] == pytest.approx([x / norm for x in slots], abs=2e-6)
