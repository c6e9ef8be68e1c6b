"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm._native import let, places, plain_words, shingles
from larkspur.llm._shared import hot_join, small, stored

SHINGLE = 5
SIMILARITY = 0.8
#: Of 64 bits. Fingerprints within RADIUS agree, up to OFF bits, in one of BLOCKS blocks, as RADIUS < (OFF + 1) * BLOCKS.
#: A window meets 4 * 697 / 65,536 = 4.3 % of the items' fingerprints (eight blocks of eight bits and one bit off: 28 %).
RADIUS, BLOCKS, BLOCK_BITS, OFF = 15, 4, 16, 3


def fingerprint(shingle: str, weight: str) -> Column:
    """An aggregate: the 64 signs of the weighted sums of the bits of hashes."""
    bits = F.lit(0).cast("long")
    for k in range(64):
        sign = F.when(F.getbit(F.col(shingle), F.lit(k)) == 1, F.col(weight)).otherwise(-F.col(weight))
        bits = bits.bitwiseOR(F.when(F.sum(sign) > 0, F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return bits


def _block(bits: Column, k: int) -> Column:
    return F.shiftrightunsigned(bits, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _blocks(bits: str) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("block"), _block(F.col(bits), k).alias("value")) for k in range(BLOCKS)]))


def near_prints(own: DataFrame, bits: DataFrame) -> DataFrame:
    """own, near: for each fingerprint of `own` (different ones), those of the column `bits` within RADIUS, if any.

    Values of `bits` are entered under each block's value and all values up to OFF bits off, so every pair within the
    radius meets in a block; the distance of the whole fingerprints then decides.
    """
    off = F.explode(F.array(*[F.lit(m) for m in range(1 << BLOCK_BITS) if m.bit_count() <= OFF]))
    entered = bits.select("bits").distinct().select("bits", _blocks("bits").alias("at")).select("bits", "at.block", "at.value", off.alias("off"))
    index = stored(entered.groupBy("block", F.col("value").bitwiseXOR(F.col("off")).alias("value")).agg(F.collect_list("bits").alias("listed")), "leak-index")
    probes = own.select("own", _blocks("own").alias("at")).select("own", "at.block", "at.value")
    met = probes.join(index, ["block", "value"]).select("own", F.explode("listed").alias("bits"))
    return met.filter(F.bit_count(F.col("own").bitwiseXOR(F.col("bits"))) <= RADIUS).groupBy("own").agg(F.collect_set("bits").alias("near"))


def _runs(docs: DataFrame, keys: list[str], bench: DataFrame, lengths: list[int]) -> DataFrame:
    """Items of few words where a document has the same words in a row. Such a window is one shingle, so it is like an item (similarity 1) or not at all."""
    listed = F.flatten(F.array(*[let(plain_words(F.col("text")), lambda w, n=n: F.transform(places(w, n), lambda i: F.struct(i.alias("start"), F.slice(w, i + 1, n).alias("words")))) for n in lengths]))
    said = docs.select(*keys, F.explode(listed).alias("r")).select(*keys, "r.start", "r.words").join(small(stored(bench.select("words").distinct(), "leak-runs")), "words", "left_semi")
    first = said.groupBy(*keys, "words").agg(F.min("start").alias("start"))
    return first.join(small(bench), "words").groupBy(*keys, "item_id").agg(F.max(F.struct(F.lit(1.0).alias("similarity"), (-F.col("start")).alias("start"), (-F.size("words")).alias("n_words"))).alias("b"))


def leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE, shortest: int = 1) -> DataFrame:
    """doc_id, text_key, item_id, start, n_words, similarity: for each document and item it holds, the most similar window.

    Words are lower-case runs of letters and digits. Windows have the length of an item. One without any shingle of
    any item can't be similar to one, so only places with such a shingle are looked at, and windows are laid so that
    it stands where it stands in an item of that length. Rare shingles of an item are those of the greatest weight
    that together pass what a similar window may lack; a window without a rare shingle of any item is like none, so it
    is left out before it is read. Thus phrases that many items share lay no windows alone. Each window gets a SimHash
    of its shingles, weighted by count and by rarity among the items, 1 + ln((1 + items) / (1 + items with it)).
    Windows and items whose fingerprints lie within RADIUS of each other are found by blocks (near_prints), each
    different fingerprint once. Then the exact similarity decides, the sum of the smaller weights over the sum of the
    larger ones.

    Items of fewer than `size` words are found where their words stand in a row, if they have `shortest` words at
    least: they are one shingle of all their words. Null items, and those without a word, are never found.

    A document is a row's id and text (text_key, its XXH64): repeated rows give one result, different texts of one id
    results of their own, and so do rows without an id (their doc_id is null). Null and empty texts hold no item.
    Items of one id and different texts are each looked for, and the best counts for the id. Of equally similar windows the first counts. Other columns are left out, whatever
    their names. Empty tables give none.
    """
    keys = ["none", "doc_id", "text_key"]
    window = [*keys, "start", "n_words"]
    docs = docs.select(F.col(id).isNull().alias("none"), F.coalesce(F.col(id), F.lit(0).cast(docs.schema[id].dataType)).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    every = stored(items.select(F.col(item).alias("item_id"), plain_words(F.col(item_text)).alias("words")).filter(F.size("words") >= min(max(1, shortest), size)).dropDuplicates().withColumn("number", F.xxhash64("item_id", "words")), "leak-items")
    bench, few = every.filter(F.size("words") >= size), every.filter(F.size("words") < size)
    total = bench.count()
    placed = bench.select("number", F.size("words").alias("n_words"), F.posexplode(shingles(F.col("words"), size)).alias("at", "s"))
    rarity = stored(placed.groupBy("s").agg((1 + F.log((F.lit(1.0) + total) / (1 + F.countDistinct("number")))).alias("rarity")), "leak-rarity")
    parts = stored(placed.groupBy("number", "s").agg(F.count(F.lit(1)).alias("m")).join(small(rarity), "s").withColumn("w", F.col("m") * F.col("rarity")), "leak-parts")
    marks = stored(parts.groupBy("number").agg(fingerprint("s", "w").alias("bits"), F.sum("w").alias("item_weight")), "leak-marks")
    spots = stored(placed.select("s", "n_words", "at").distinct(), "leak-spots")
    by_weight = Window.partitionBy("number").orderBy(F.desc("rarity"), "s").rowsBetween(Window.unboundedPreceding, -1)
    lacking = (1 - similarity + 1e-6) * F.sum("w").over(Window.partitionBy("number"))
    rare = parts.select("s", (F.coalesce(F.sum("w").over(by_weight), F.lit(0.0)) <= lacking).alias("rare"))
    known = stored(rare.groupBy("s").agg(F.max("rare").alias("rare")), "leak-shingles")

    hits = docs.select(*keys, F.posexplode(shingles(plain_words(F.col("text")), size)).alias("pos", "s")).join(small(known), "s").distinct()
    to_here = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("rare"), F.col("pos"))
    hits = hits.select(*keys, "pos", "s", F.max(own).over(to_here(F.asc("pos"))).alias("back"), F.min(own).over(to_here(F.desc("pos"))).alias("ahead"))
    hits = hits.join(small(spots), "s").withColumn("start", F.greatest(F.col("pos") - F.col("at"), F.lit(0)))
    hits = hits.filter((F.col("back") >= F.col("start")) | (F.col("ahead") <= F.col("start") + F.col("n_words") - size))
    laid = stored(hits.select(*window).distinct(), "leak-laid")
    held = docs.join(small(stored(laid.select(*keys).distinct(), "leak-documents")), keys, "left_semi").dropDuplicates(keys)
    said = held.select(*keys, F.posexplode(shingles(plain_words(F.col("text")), size)).alias("at", "s"))
    cut = laid.select(*window, F.explode(F.sequence("start", F.col("start") + F.col("n_words") - size)).alias("at")).join(said, [*keys, "at"])
    bags = cut.groupBy(*window, "s").agg(F.count(F.lit(1)).alias("m"))
    unseen = 1 + F.log(F.lit(1.0 + total))
    bags = stored(bags.join(small(rarity), "s", "left").withColumn("rarity", F.coalesce("rarity", unseen)).withColumn("w", F.col("m") * F.col("rarity")), "leak-bags")
    prints = stored(bags.groupBy(*window).agg(fingerprint("s", "w").alias("own"), F.sum("w").alias("own_weight")), "leak-prints")

    seen = stored(prints.groupBy("own").agg(F.count(F.lit(1)).alias("windows")), "leak-seen")
    near = stored(near_prints(seen, marks).join(seen, "own"), "leak-near")
    met = hot_join(prints, near, ["own"], "windows", "inner").select(*window, "own_weight", F.explode("near").alias("bits"))
    met = met.join(small(marks), "bits").select(*window, "own_weight", "number", "item_weight")
    mine = parts.select("number", "s", F.col("m").alias("item_m"))
    shared = met.join(bags.select(*window, "s", "m", "rarity"), window).join(small(mine), ["number", "s"])
    both = shared.groupBy(*window, "number", "own_weight", "item_weight").agg(F.sum(F.least("m", "item_m") * F.col("rarity")).alias("both"))
    found = both.withColumn("similarity", F.round(F.col("both") / (F.col("own_weight") + F.col("item_weight") - F.col("both")), 9)).filter(F.col("similarity") >= similarity)
    found = found.join(small(bench.select("number", "item_id")), "number")
    best = found.groupBy(*keys, "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"), (-F.col("n_words")).alias("n_words"))).alias("b"))
    if lengths := [r["n"] for r in few.select(F.size("words").alias("n")).distinct().collect()]:  # below `size`
        best = best.unionByName(_runs(docs, keys, few, lengths)).groupBy(*keys, "item_id").agg(F.max("b").alias("b"))
    return best.select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "text_key", "item_id", (-F.col("b.start")).cast("long").alias("start"), (-F.col("b.n_words")).cast("long").alias("n_words"), F.col("b.similarity").alias("similarity"))
