"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm._shared import WORD, mix, small, stored, uniform

#: Weights by source in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
#: The mix takes so much of all words, and so much of one source at most.
BUDGET = 1.5
CAP = 2.0
#: Rows of the largest source class that one task rounds, about; groups of residuals that one task of the tree combines.
BLOCK_ROWS = 1024
FAN_IN = 64
_NEAR = 1e-9


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """Per source (null is a source): source_size and target, from rows (source, size).

    Sources share budget * all sizes by weight; a target stops at cap * its source's size and the excess is shared
    again, so target = min(cap * size, level * weight) with one level for all. The level is found by sorting sources by
    cap * size / weight: each takes its cap as long as that is below an equal share of what is left. This runs on one
    row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    per = per.withColumn("share", (F.lit(float(budget)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    full = F.col("most") <= F.col("share") * F.col("weight")
    level = F.max(F.when(~full, F.col("share"))).over(everything)
    return per.select("source", "source_size", F.when(full, F.col("most")).otherwise(F.least("most", level * F.col("weight"))).alias("target"))


def pivot(p: np.ndarray, u: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rounds probabilities one against the next within each group: 0 or 1 for each, which stay open (one of a group at most), and what they then hold.

    Of two open values the mass goes at random to either, so far that one is integral, with chances that keep each
    value's mean. new: whether a group begins.
    """
    out, left, opened = np.zeros(len(p), np.int64), p.astype(float), np.zeros(len(p), bool)
    at, a = -1, 0.0
    for i, (b, x, first) in enumerate(zip(p.tolist(), u.tolist(), new.tolist(), strict=True)):
        if first and at >= 0:
            opened[at], left[at], at = True, a, -1
        if b <= _NEAR or b >= 1 - _NEAR:
            out[i] = b > 0.5
        elif at < 0:
            at, a = i, b
        else:
            s = a + b
            if s < 1:  # one gets all, the other none
                if x * s < b:
                    at = i
                a = s
            else:  # one becomes 1, the other keeps the rest
                if x * (2 - s) < 1 - b:
                    out[at], at = 1, i
                else:
                    out[i] = 1
                a = s - 1
            if a <= _NEAR or a >= 1 - _NEAR:
                out[at], at = a > 0.5, -1
    if at >= 0:
        opened[at], left[at] = True, a
    return out, opened, left


def _round(keys: list[str], seed: int, level: int, last: bool):
    """Over rows sorted by key and size; a group may go on in the next batch, so the row that is open at a batch's end waits for it."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        if last and len(pdf):
            u = uniform(mix(pdf["chance"].to_numpy(np.int64).view(np.uint64) ^ np.uint64(seed)))
            pdf = pdf.assign(extra=np.where(pdf["open"], u < pdf["p"], pdf["extra"]).astype(np.int64), open=False)
        return pdf

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            code = pdf[keys].apply(lambda c: pd.factorize(c)[0])
            new = (code != code.shift()).any(axis=1).to_numpy()
            u = uniform(mix(pdf["chance"].to_numpy(np.int64).view(np.uint64) + np.uint64(seed * 1009 + level * 7919 + 1)))
            pdf["extra"], pdf["open"], pdf["p"] = pivot(pdf["p"].to_numpy(float), u, new)
            waits = pdf["open"].to_numpy() & (np.arange(len(pdf)) >= np.flatnonzero(new)[-1]) if len(pdf) else np.zeros(0, bool)
            held = pdf[waits] if waits.any() else None
            yield settle(pdf[~waits])
        if held is not None:
            yield settle(held)

    return run


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, budget: float = BUDGET, cap: float = CAP, block_rows: int = BLOCK_ROWS, seed: int = 5) -> DataFrame:
    """Per row of docs: its id, text_key (XXH64 of the text), source, size (words), source_size, target, copies and taken = copies * size.

    Each row of a source gets the same expected number of copies, target / source_size. Its whole part is fixed; the
    fraction is a probability, rounded by the pivotal method: within blocks of equal source and size class, in order of
    size, neighbours exchange mass until one is integral, so a block leaves one open row at most. Those go up a tree
    of FAN_IN blocks each, then by source, where the last is rounded by itself. So counts come out within one row of
    their mean, and words within about the size of the rows that met. Blocks depend on ids and sizes alone: reruns
    agree, whatever the partitions.

    Null texts and texts without words have size 0 and taken 0. A null source is a source of its own, last in order.
    Repeated rows are rounded as rows of their own; of rows that agree in id and text it doesn't matter which is which,
    and two texts of one id have chances of their own. Only open rows (whose fraction isn't integral yet) reach the
    loop in Python that rounds them; the running sums that find the targets go over one row per source. Other columns
    are left out, whatever their names. An empty table gives an empty result.
    """
    sizes = stored(docs.select(F.col(id).cast("long").alias("id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key")), "mix-sizes")
    goal = small(stored(targets(sizes, weights, budget, cap), "mix-targets"))
    rows = sizes.join(goal, sizes["source"].eqNullSafe(goal["source"])).select("id", "text_key", sizes["source"], "size", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = max(1, math.ceil(sizes.count() / block_rows))
    rows = rows.withColumn("whole", F.floor(rate + F.lit(_NEAR)).cast("long")).withColumn("p", F.when(F.col("size") > 0, F.greatest(rate - F.col("whole"), F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumns({"chance": F.xxhash64("id", "text_key"), "kind": F.coalesce(F.floor(F.log2(F.col("size").cast("double"))), F.lit(-1)).cast("long"), "extra": F.lit(0).cast("long")})
    rows = rows.withColumns({"block": F.pmod(F.xxhash64("chance", F.lit(seed)), F.lit(blocks)), "open": F.col("p") > _NEAR})
    done, left, level = [rows.filter(~F.col("open"))], rows.filter("open"), 0
    while True:
        keys = ["source", "kind", "block"] if blocks > 1 or level == 0 else ["source", "kind"] if level > 0 and level < 1000 else ["source"]
        last = keys == ["source"]
        left = left.repartition(*keys).sortWithinPartitions(*keys, "size", "chance", "id", "text_key")
        left = stored(left.mapInPandas(_round(keys, seed, level, last), rows.schema), f"mix-level{level}")
        done.append(left.filter(~F.col("open")))
        if last:
            break
        left = left.filter("open")
        if keys == ["source", "kind"]:
            level = 1000
        else:
            level, blocks = level + 1, math.ceil(blocks / FAN_IN)
            left = left.withColumn("block", F.floor(F.col("block") / FAN_IN).cast("long"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    copies = F.col("whole") + F.col("extra")
    return out.select(F.col("id").alias(id), "text_key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
