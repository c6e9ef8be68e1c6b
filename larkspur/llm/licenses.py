"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._native import plain_words, shingles
from larkspur.llm._shared import small, stored

SHINGLE = 5
CONTAINED = 0.8
#: Bands of one row each. A window of length 2W holds a template of more than W / 2 shingles with Jaccard similarity
#: 0.8 / 4.2 at least, so one of 64 bands agrees with probability 1 - (1 - 0.19) ** 64 = 0.999998 or more.
BANDS = 64
#: Public license notices.
NOTICES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "mit": ["Released under the MIT License"],
    "gpl-3.0": ["licensed under the GNU General Public License, version 3"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0"],
    "cc-by-4.0": ["licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4.0": ["licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}


def whole_texts() -> dict[str, list[str]]:
    """The license texts of the folder license_texts, by license."""
    return {p.stem: [p.read_text("utf-8")] for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def templates() -> dict[str, list[str]]:
    """Notices and whole texts, several for a license."""
    whole = whole_texts()
    return {k: NOTICES.get(k, []) + whole.get(k, []) for k in sorted({*NOTICES, *whole})}


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def window_length(n: int) -> int:
    """Half the length, in shingles, of the windows for a template of n shingles: the next power of two."""
    return 1 << max(0, n - 1).bit_length()


def _signed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, band, value: the MinHash of each key's shingles s, one row a band."""
    mins = rows.groupBy(*keys).agg(*[F.min(F.xxhash64("s", F.lit(k))).alias(f"m{k}") for k in range(BANDS)])
    return mins.select(*keys, F.posexplode(F.array(*[f"m{k}" for k in range(BANDS)])).alias("band", "value"))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", known: dict[str, list[str]] | None = None, contained: float = CONTAINED, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, license, template, containment, start (in words): for each document and license it holds, the fullest window.

    known: the texts of each license, notices and whole ones (templates() if none are given); template tells which one
    was found. Words are lower-case runs of letters and digits. Windows of 2W shingles begin at every W-th one, for W of
    each power of two that a template needs, so any run of W shingles lies within one. A window that has fewer of the
    templates' distinct shingles than the smallest template of its W must have can't hold one, so it is left out before
    it is read; each other gets a MinHash of all its shingles, and templates that share a band are verified by the share
    of their distinct shingles in the window.

    A document is a row's id and text (text_key, its XXH64): repeated rows give one result, different texts of one id,
    and rows without an id, results of their own. Null and empty texts hold none. Texts of fewer than `size` words are refused
    as templates. Of equally full windows the first counts, of equally full texts of a license the first. Other
    columns are left out, whatever their names; an empty table gives none.
    """
    spark, keys = docs.sparkSession, ["none", "doc_id", "text_key"]
    window = [*keys, "half", "start"]
    listed = [(k, j, template_words(t)) for k, texts in (templates() if known is None else known).items() for j, t in enumerate(texts)]
    if short := [k for k, _, w in listed if len(w) < size]:
        raise ValueError(f"templates of fewer than {size} words: {short}")
    bench = spark.createDataFrame([(k, j, w, window_length(len(w) - size + 1)) for k, j, w in listed], "license string, template int, words array<string>, half int")
    bench = stored(bench.select("license", "template", "half", F.array_distinct(shingles(F.col("words"), size)).alias("ts")), "license-templates")
    inside = stored(bench.select("license", "template", "half", F.explode("ts").alias("s")), "license-shingles")
    marks = small(stored(inside.select("half", "s").distinct(), "license-marks"))
    least = F.broadcast(bench.groupBy("half").agg(F.min(F.ceil(F.size("ts") * contained)).alias("least")))  # a row per power of two
    bands = stored(_signed(inside, ["license", "template", "half"]), "license-bands")

    docs = docs.select(F.col(id).isNull().alias("none"), F.coalesce(F.col(id), F.lit(0).cast(docs.schema[id].dataType)).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    hits = docs.select(*keys, F.posexplode(shingles(plain_words(F.col("text")), size)).alias("pos", "s")).join(marks, "s")
    number = F.floor(F.col("pos") / F.col("half")).cast("int")
    spots = hits.select(*keys, "half", "s", F.explode(F.array_distinct(F.array(number, F.greatest(number - 1, F.lit(0))))).alias("at"))
    full = spots.groupBy(*keys, "half", "at").agg(F.countDistinct("s").alias("n")).join(least, "half").filter("n >= least")
    windows = stored(full.select(*keys, "half", (F.col("at") * F.col("half")).alias("start")), "license-windows")
    held = docs.join(small(stored(windows.select(*keys).distinct(), "license-documents")), keys, "left_semi").dropDuplicates(keys)
    said = held.select(*keys, F.posexplode(shingles(plain_words(F.col("text")), size)).alias("at", "s"))
    place = F.explode(F.filter(F.flatten(F.transform(F.array(*[F.lit(h) for h in sorted({window_length(len(w) - size + 1) for *_, w in listed})]), lambda h: F.transform(F.array(F.lit(0), F.lit(1)), lambda d: F.struct(h.alias("half"), ((F.floor(F.col("at") / h) - d) * h).cast("int").alias("start"))))), lambda w: w["start"] >= 0))
    placed = said.select(*keys, "s", place.alias("w")).select(*keys, "s", F.col("w.half").alias("half"), F.col("w.start").alias("start"))
    met = _signed(placed.join(small(windows), window), window).join(small(bands), ["half", "band", "value"])
    met = stored(met.select(*window, "license", "template").distinct(), "license-met")
    shared = placed.join(marks, ["half", "s"]).join(small(met), window).join(small(inside), ["license", "template", "half", "s"])
    shared = shared.groupBy(*window, "license", "template").agg(F.countDistinct("s").alias("both"))
    sizes = F.broadcast(bench.select("license", "template", "half", F.size("ts").alias("n")))  # a row per template
    held = shared.join(sizes, ["license", "template", "half"]).withColumn("containment", F.col("both") / F.col("n")).filter(F.col("containment") >= contained)
    best = held.groupBy(*keys, "license").agg(F.max(F.struct("containment", (-F.col("start")).alias("start"), (-F.col("template")).alias("template"))).alias("b"))
    return best.select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "text_key", "license", (-F.col("b.template")).alias("template"), F.col("b.containment").alias("containment"), (-F.col("b.start")).cast("long").alias("start"))
