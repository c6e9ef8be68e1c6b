"""Packing, whitening and hard negatives against plain versions, with nulls, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import bisect
import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import negatives, packing, queries, whitening
from tests.conftest import SF
from tests.test_oracle import compare, duck  # noqa: F401

# ---------------------------------------------------------------- packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(packing.default_tokenizer())
    made.encode_special_tokens = True
    return made


def best_fit(lengths, size=2048):
    """Sequences that best fit of the longest first needs."""
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        left = (gaps.pop(at) if at < len(gaps) else size) - length
        n += left + length == size
        bisect.insort(gaps, left)
    return n


def check_packed(rows, size=2048):
    """No sequence is longer than size, and places are without gaps."""
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= size
    return len(held)


def test_packing_of_documents(spark, tokenizer):
    rows = queries.op11_best_fit_packing(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by.keys() == texts.keys()
    for d, parts in by.items():
        ids = [*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 0]
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and sum(r["length"] for r in parts) == len(ids)
        assert all(r["length"] == 2048 for r in parts[1:]) and len(parts) == math.ceil(len(ids) / 2048)
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert check_packed(rows) <= best_fit(r["length"] for r in rows) + 1


@pytest.mark.parametrize("kind", ["even", "hot", "small", "large"])
def test_packing_is_near_best_fit(spark, kind):
    rng = random.Random(4)
    draw = {"even": lambda: rng.randint(1, 2048), "hot": lambda: 683 if rng.random() < 0.4 else rng.randint(1, 1500), "small": lambda: 1 + int(rng.expovariate(1 / 90)), "large": lambda: rng.randint(900, 1150)}[kind]
    lengths = [min(2048, draw()) for _ in range(20_000)]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length int")
    used = check_packed(packing.packed(df, lane_rows=3000).collect())
    assert used <= 1.01 * best_fit(lengths) + 1 and used >= math.ceil(sum(lengths) / 2048)


def test_packing_of_odd_rows(spark, tokenizer):
    texts = [None, "", " ", "a" * 50_000, "word " * 40_000, "café 中文 \U0001f600 ไทย ²", "<|endoftext|> x", "same", "same", "x\n\n  y\t z"]
    df = spark.createDataFrame([(k if k != 5 else None, t, -1, "s", 9) for k, t in enumerate(texts)] + [(7, "same", -1, "s", 9)], "doc_id long, text string, length int, sequence_id string, offset int")
    parts = packing.pieces(df)
    out = packing.packed(parts.withColumn("sequence_id", F.lit("gone")).withColumn("note", F.lit("kept"))).collect()
    assert check_packed(out) and {r["note"] for r in out} == {"kept"} and sum(r["doc_id"] == 7 for r in out) == 2
    for k, t in enumerate(texts):
        mine = sorted((r["piece"], bytes(r["ids"])) for r in out if r["doc_id"] == (k if k != 5 else None))
        want = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(b for _, b in (mine if k != 7 else mine[:1])) == want
    whole = packing.sequences(packing.packed(parts)).collect()
    assert sum(r["length"] for r in whole) == sum(r["length"] for r in out) and all(len(r["ids"]) == 4 * r["length"] <= 4 * 2048 for r in whole)
    lengths = spark.createDataFrame([(1, None), (2, 0), (3, 2049), (4, 2048)], "doc_id long, length int")
    assert {r["doc_id"]: r["sequence_id"] is None for r in packing.packed(lengths).collect()} == {1: True, 2: True, 3: True, 4: False}
    assert packing.packed(packing.pieces(df.limit(0))).count() == 0


def test_ids_are_those_of_the_tokenizer(tokenizer, monkeypatch):
    ids = packing.Ids(packing.default_tokenizer())
    assert ids._fast is not None
    slow = lambda t: np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    for c in [c for c in map(chr, range(0x3100)) if packing._SETTLED.fullmatch(c)]:
        t = f"a{c}a 1{c}1 {c}{c} .{c}. {c} \n{c}"
        assert ids(t) == slow(t), hex(ord(c))
    monkeypatch.setattr(packing, "CUT_CHARS", 50)
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice(["word", " ", "  ", "\n", "don't", "12", "!?", "\t", "é", " "]) for _ in range(rng.randrange(200)))
        assert ids(t) == slow(t)


# ---------------------------------------------------------------- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, 0) for i, v, k in rows], "vec_id long, embedding array<float>, label int, x int")


def true_whitening(rows):
    """By numpy: vec_id and x of the rows that take part, the fit list, and (deviation, whitened up to sign, explained)."""
    ok = [(i, np.array([math.floor(64 * float(np.float32(c))) + 10**6 for c in v], object)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in ok}), object)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s).astype(float) / n
    e, axes = np.linalg.eigh(y.T @ y / n)
    e, axes = e[::-1], axes[:, ::-1]
    return ok, n, [int(((n * x - s) ** 2).sum()) for _, x in ok], np.array([((n * x - s).astype(float) / n) @ axes for _, x in ok]), e


def check_whitening(df, rows):
    ok, n, deviation, flat, e = true_whitening(rows)
    got = collections.defaultdict(list)
    for r in df.collect():
        got[r["component"]].append(r)
    k = min(16, len(e))
    assert sorted(got) == list(range(1, k + 1))
    for c in range(k):
        assert collections.Counter((r["vec_id"], r["deviation"], r["n"]) for r in got[c + 1]) == collections.Counter((i, d, n) for (i, _), d in zip(ok, deviation, strict=True))
        assert all(r["identity_error"] is None or r["identity_error"] < 1e-4 for r in got[c + 1])
        if e[c] > 1e-9 * max(e):
            assert all(abs(r["explained"] - e[c] / e.sum()) < 1e-9 for r in got[c + 1])
            want = sorted(np.round(np.abs(flat[:, c] / np.sqrt(e[c])), 5))
            assert np.allclose(sorted(abs(r["whitened"]) for r in got[c + 1]), want, atol=2e-5)
        else:
            assert all(r["whitened"] is None for r in got[c + 1])


def test_whitening_of_embeddings(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(queries.op12_polarised_whitening(spark, SF), rows)


def test_whitening_of_odd_rows(spark):
    rng = random.Random(2)
    nan, inf = float("nan"), float("inf")
    rows = [(k, [rng.gauss(0, 1 + c) for c in range(20)], 1) for k in range(60)] + [(1, [0.5] * 20, 1)] * 9 + [(None, [0.25] * 20, None)]
    odd = [(100, None, 1), (101, [], 1), (102, [None] * 20, 1), (103, [nan] + [0.0] * 19, 1), (104, [0.0] * 19 + [inf], 1), (105, [1.0, 2.0], 1), (106, [-inf] * 20, 1), (107, [3e38] * 20, 1)]
    check_whitening(whitening.whitened(vectors(spark, rows + odd).repartition(5)), [(i, v) for i, v, _ in rows])
    flat = [(k, [rng.gauss(0, 1), 1.0, 2.0], 1) for k in range(30)]  # one direction varies
    check_whitening(whitening.whitened(vectors(spark, flat)), [(i, v) for i, v, _ in flat])
    one = whitening.whitened(vectors(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).collect()
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, None)} and len(one) == 4
    assert whitening.whitened(vectors(spark, odd[:5])).count() == 0 and whitening.whitened(vectors(spark, rows).limit(0)).count() == 0


def test_sums_stay_exact():
    rng = np.random.default_rng(1)
    for top in (10**3, 2**25, 2**40, 2**61):
        t = rng.integers(-top, top, (50, 3))
        assert whitening._exact(t) == [sum(int(v) ** 2 for v in t[:, c]) for c in range(3)]
        assert whitening._squares(t) == [v if v < 2**63 else None for v in (sum(int(a) ** 2 for a in row) for row in t)]


# ---------------------------------------------------------------- hard negatives


def true_negatives(rows, anchors, positives=5, few=5):
    """rows: (id, label, x), each once."""
    out = []
    for i, k, x in [r for r in rows if anchors(r[0])]:
        scored = [(-sum(a * b for a, b in zip(x, y, strict=True)), j, other) for j, other, y in rows if (j, other, y) != (i, k, x)]
        for p, j, _ in sorted(s for s in scored if s[2] == k)[:positives]:
            hard = sorted(s for s in scored if s[2] != k and -80 * p <= -100 * s[0] <= -100 * p)[:few]
            out += [(i, j, at + 1, n, -p, -s) for at, (s, n, _) in enumerate(hard)]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def test_negatives_by_sql(spark, duck):  # noqa: F811
    compare(queries.op13_gnat_negatives(spark, SF), duck, queries.SQL["op13_gnat_negatives"])


@pytest.mark.parametrize("kind", ["clustered", "copies", "flat", "zero"])
def test_negatives_by_brute_force(spark, monkeypatch, kind):
    """Trees of several levels, blocks of a few anchors, ties and repeated rows."""
    monkeypatch.setattr(negatives, "LEAF_ROWS", 8)
    rng = random.Random(6)
    made = []
    for k in range(400):
        base = [0] * 6 if kind == "zero" else [rng.randint(-9, 9) for _ in range(6)] if kind == "flat" else [50 * (k % 7 == c) + rng.randint(0, 6) for c in range(6)]
        made.append((k, k % 3, base if kind != "copies" or k % 4 else [40, 30, 3, 3, 3, 3]))
    rows = sorted({(i, k, tuple(x)) for i, k, x in made})
    df = spark.createDataFrame([(i, k, list(x)) for i, k, x in rows] + [(0, 0, list(rows[0][2]))] * 3, "vec_id long, label long, x array<long>")
    got = found(negatives.hard_negatives(df.repartition(3), F.col("vec_id") % 9 == 0, queries=7))
    want = true_negatives(rows, lambda i: i % 9 == 0)
    assert got == want and want


def test_leaves_are_ruled_out(spark):
    """On clustered rows most leaves aren't looked at, and nothing is lost."""
    rng = np.random.default_rng(3)
    x = (rng.integers(0, 2, (3000, 5)) * 400 + rng.integers(0, 20, (3000, 5))).tolist()
    df = spark.createDataFrame([(k, k % 4, v) for k, v in enumerate(x)], "vec_id long, label long, x array<long>")
    index = negatives.Index(df, 5, 6)
    q = np.array(x[:40], float)
    score = np.array(x, float) @ q.T
    top = np.sort(score, axis=0)[-6]
    leaf = index.tree.descend(np.array(x, float))
    ways, far, asked = index.tree.paths(), {}, 0
    assert index.tree.leaves == len(ways) > 20 and set(leaf.tolist()) <= set(ways)
    for k, way in ways.items():
        ok = index.tree.open_to(way, q, top, np.full(40, 2.0**60), far)
        asked += ok.sum()
        assert not (score[leaf == k][:, ~ok] >= top[~ok]).any()
    assert asked < 0.5 * 40 * len(ways)


def test_negatives_of_odd_rows(spark):
    nan = float("nan")
    odd = [(100, None, 1), (200, [1.0, nan], 1), (None, [1.0, 1.0], 1), (300, [1.0, None], 0), (400, [], 0), (500, [1.0], 0), (600, [1.0, 1.0], None), (700, [1e30, 1.0], 1)]
    fine = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.85, 0.1], 0), (2, [0.85, 0.1], 0), (3, [-1.0, 0.0], 1), (4, [0.8, 0.3], 0)]
    rows = negatives.prepared(vectors(spark, odd + fine))
    assert rows.count() == len(fine)
    floor = lambda v: tuple(math.floor(256 * float(np.float32(c))) for c in v)
    got = found(negatives.hard_negatives(rows.withColumn("anchor", F.lit("clash")), F.col("vec_id") % 100 == 0))
    assert got == true_negatives(sorted({(i, k, floor(v)) for i, v, k in fine}), lambda i: i % 100 == 0) and got
    assert negatives.hard_negatives(rows.limit(0), F.lit(True)).count() == 0 and negatives.hard_negatives(rows, F.lit(None).cast("boolean")).count() == 0
