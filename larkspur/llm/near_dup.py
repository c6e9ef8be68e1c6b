"""MinHash near-duplicates of multisets of word shingles: BagMinHash signatures, bands, exact verification, classes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm._shared import WORD, Words, chunks, hot_join, mix, small, stored, uniform, utf8, whole_row

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** 5) ** 25 = 0.99995.
BANDS, ROWS = 25, 5
#: Texts left to compare pair by pair get longer signatures. A pair of similarity 0.8 differs in 101 of 504 components
#: on average, and in over 137 with probability 0.00004.
LONG, MOST_DIFFER = 504, 137
#: Components that one long holds, of seven bits each in a byte.
LANES = 7


def bags(buf: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (hashes) with their texts and counts, in order of text and hash."""
    shingle, doc = Words(buf, bounds).shingles(size)
    if not len(shingle):
        return shingle, doc, doc
    by = np.lexsort((shingle, doc))
    shingle, doc = shingle[by], doc[by]
    new = np.empty(len(by), bool)
    new[0] = True
    new[1:] = (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return shingle[at], doc[at], np.diff(np.append(at, len(by)))


def bag_min_hash(shingle: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int, m: int) -> np.ndarray:
    """m components for each text; two texts agree in one with the probability of their weighted Jaccard similarity.

    A shingle's weights 1, 2, 3, ... are levels, and each level has a Poisson process of rate one whose points fall on
    random components; a component is the time of the first point of any level that the text's weights reach. Levels
    are taken together in a hierarchy of intervals (0, 1], (1, 2], (2, 4], (4, 8], ...: one process per interval, of
    the rate of its length, whose points fall on random levels in it, and those over the weight don't count. So a
    weight w needs about log2(w) processes. Points come in order of time, and a process ends when it has passed all
    components of its text.
    """
    sig = np.full((docs, m), np.inf)
    top = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    of = np.repeat(np.arange(len(shingle)), top)
    level = np.arange(len(of)) - np.repeat(np.cumsum(top) - top, top)
    rate = np.where(level == 0, 1.0, 2.0 ** (level - 1))
    below = np.where(level == 0, 0.0, rate)
    state = mix(shingle[of] + level.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    doc, most, t, step = doc[of], weight[of].astype(float), np.zeros(len(of)), 0
    while len(doc):
        step += 1
        draw = mix(state + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
        t = t - np.log(uniform(draw)) / rate
        draw = mix(draw + np.uint64(1))
        part = (draw % np.uint64(m)).astype(np.int64)
        ok = below + np.ceil(uniform(mix(draw + np.uint64(2))) * rate) <= most
        np.minimum.at(sig.reshape(-1), doc[ok] * m + part[ok], t[ok])
        live = t < sig.max(axis=1)[doc]
        doc, most, t, rate, below, state = doc[live], most[live], t[live], rate[live], below[live], state[live]
    return sig


def _text_key(text: Column) -> Column:
    return F.md5(F.when(text.rlike(WORD), text).otherwise(""))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """(id, text) -> id, text_key (MD5 of the text, or of nothing if it has no words), weight (shingles) and bands (hashes; none for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, bounds = utf8(batch.column(1))
            for lo, hi in chunks(bounds, 4 << 20):
                at = bounds[lo : hi + 1]
                shingle, doc, count = bags(buf[at[0] : at[-1]], at - at[0], size)
                n = hi - lo
                sig = bag_min_hash(shingle, doc, count, n, bands * rows).view(np.uint64).reshape(n, bands, rows)
                key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (n, 1))
                for k in range(rows):
                    key = mix(key + sig[:, :, k])
                weight = np.bincount(doc, count, n).astype(np.int64)
                held = np.concatenate(([0], np.cumsum(np.where(weight > 0, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(held), pa.array(key[weight > 0].reshape(-1).view(np.int64)))
                part = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(weight), lists], ["id", "text_key", "weight", "bands"])

    keyed = docs.select("id", "text", _text_key(F.col("text")).alias("text_key"))
    return keyed.mapInArrow(run, "id long, text_key string, weight long, bands array<long>")


def _shingle_table(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, bounds = utf8(batch.column(1))
            for lo, hi in chunks(bounds):
                at = bounds[lo : hi + 1]
                shingle, doc, count = bags(buf[at[0] : at[-1]], at - at[0], size)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                held = pa.array([shingle[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                counts = pa.array([count[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.slice(lo, hi - lo).column(0), held, counts], ["id", "shingles", "counts"])

    return docs.select("id", "text").mapInArrow(run, "id long, shingles binary, counts binary")


def _shingle_rows(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, bounds = utf8(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(bounds):
                at = bounds[lo : hi + 1]
                shingle, doc, count = bags(buf[at[0] : at[-1]], at - at[0], size)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][doc]), pa.array(shingle.view(np.int64)), pa.array(count.astype(np.int64))], ["id", "shingle", "m"])

    return docs.select("id", "text").mapInArrow(run, "id long, shingle long, m long")


def lone_weight(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """id, lone: the weight of the shingles that no other of these texts has (rows only where there is any)."""
    per = _shingle_rows(docs, size).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id"), F.max("m").alias("m"))
    return per.filter("n = 1").groupBy("id").agg(F.sum("m").alias("lone"))


def long_signatures(docs: DataFrame, m: int = LONG, size: int = SHINGLE) -> DataFrame:
    """(id, text) -> id, marks: seven bits of each of m components, LANES to a long."""
    longs = -(-m // LANES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, bounds = utf8(batch.column(1))
            for lo, hi in chunks(bounds):
                at = bounds[lo : hi + 1]
                n = hi - lo
                shingle, doc, count = bags(buf[at[0] : at[-1]], at - at[0], size)
                sig = bag_min_hash(shingle, doc, count, n, m)
                lane = np.zeros((n, longs * LANES), np.int64)
                lane[:, :m] = (mix(sig.view(np.uint64)) & np.uint64(127)).astype(np.int64)
                packed = (lane.reshape(n, longs, LANES) << (8 * np.arange(LANES))).sum(axis=2)
                marks = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * longs), pa.array(packed.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.slice(lo, n).column(0), marks], ["id", "marks"])

    return docs.select("id", "text").mapInArrow(run, "id long, marks array<long>")


def differing(x: Column, y: Column, longs: int) -> Column:
    """In how many components two signatures' marks differ."""
    ones, high = F.lit(int("7f" * LANES, 16)).cast("long"), F.lit(int("80" * LANES, 16)).cast("long")
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count((p.bitwiseXOR(q) + ones).bitwiseAND(high))), F.lit(0), lambda a, b: a + b)


def overlap(x: bytes, nx: bytes, y: bytes, ny: bytes) -> float:
    """Weighted Jaccard similarity of two bags: the sum of the smaller counts over that of the larger ones."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    na, nb = np.frombuffer(nx, np.int32), np.frombuffer(ny, np.int32)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(na[i], nb[j]).sum())
    return both / max(1, int(na.sum()) + int(nb.sum()) - both)


def verified(pairs: DataFrame, docs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """Those of (stored) pairs a, b of texts (numbers of texts: node, rep, text_key) that have the similarity, with it."""
    involved = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "near-ids")
    asked = stored(texts.join(small(involved), "node", "left_semi"), "near-asked")
    bag = stored(_shingle_table(_text_of(docs, asked), size), "near-bags")
    left = bag.select(F.col("id").alias("a"), F.col("shingles").alias("xa"), F.col("counts").alias("na"))
    right = bag.select(F.col("id").alias("b"), F.col("shingles").alias("xb"), F.col("counts").alias("nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            got = np.array([overlap(*r) for r in rows], float)
            keep = pa.array(got >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(got).filter(keep)], ["a", "b", "similarity"])

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "xa", "na", "xb", "nb")
    return both.mapInArrow(run, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """id, class_id (the smallest id) of all ids of (stored) edges a, b: labels pass to neighbours and then jump along labels, till none changes."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "near-edges")
    label = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("class_id")), "near-label")
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class_id").alias("near"))
        low = label.join(near, "id").select("id", F.col("class_id").alias("was"), F.least("class_id", "near").alias("low"))
        jump = label.select(F.col("id").alias("low"), F.col("class_id").alias("next"))
        new = stored(low.join(jump, "low", "left").select("id", "was", F.least("low", "next").alias("class_id")), "near-label")
        label = new.select("id", "class_id")
        if not new.filter("was <> class_id").limit(1).count():
            return label


def extended(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: only classes that these connect are looked at, not the links within them."""
    at = lambda side: label.select(F.col("id").alias(side), F.col("class_id").alias(f"class_{side}"))
    between = links.select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left")
    between = between.select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b")).filter("a <> b").distinct()
    top = components(between)
    high = top.select(F.col("id").alias("class_id"), F.col("class_id").alias("high"))
    moved = label.join(high, "class_id", "left").select("id", F.coalesce("high", "class_id").alias("class_id"))
    return stored(moved.unionByName(top.join(label.select("id"), "id", "left_anti")), "near-label")


def _undecided(band: DataFrame, label: DataFrame) -> DataFrame:
    """Band rows, with class_id, of the buckets whose texts are in several classes."""
    placed = band.join(label, band["rep"] == label["id"], "left").select(*[band[c] for c in band.columns], F.coalesce("class_id", "rep").alias("class_id"))
    mixed = placed.groupBy("band").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).filter("low < high").select("band")
    return placed.join(mixed, "band", "left_semi")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, most_differ: int = MOST_DIFFER, size: int = SHINGLE) -> DataFrame:
    """Per row of docs: its id, same_text (the smallest id of equal texts) and class_id (the smallest id of its class).

    Texts are linked if the bags of their `size`-word shingles have a weighted Jaccard similarity of `similarity` or
    more; classes are what links connect. Equal texts are first taken as one. In each band bucket every text is
    verified against one pivot, the one with the smallest hash of all, so a bucket of n texts gives n - 1 pairs, and
    where it still holds several classes, against the text that has most of its weight in common with others. What is
    then left in different classes is verified pair by pair, so no link is lost to the short cuts. Two bounds keep
    these pairs few: what two texts share is at most the weight of either's shingles that any other such text has, and
    must be similarity / (1 + similarity) of both weights, so only texts whose weights are that near meet at all; and longer signatures that differ in over most_differ
    components are as unlikely for a link as to share no band (a chance of 0.00004 at exactly the similarity; most_differ
    = 504 gives this short cut up). Links come from whole bags alone, whose shingles are 64-bit hashes: two texts of n
    shingles each share one by chance with a probability of n * n / 2^64.

    Texts of fewer than `size` words are one shingle; null texts and texts without words are equal to each other, and
    near to nothing else. Each different text is classed by itself, so rows of one id with different texts may be of
    different classes, and rows without an id are linked like others; same_text and class_id are null where no row of
    the text or class has an id.
    """
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sig, classes = _classed(docs, similarity, bands, rows, most_differ, size)
    found = hot_join(sig.select("id", "text_key"), classes, ["text_key"], "alike", "inner")
    return found.select(F.col("id").alias(id), F.col("rep").alias("same_text"), "class_id")


def _text_of(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """id (the text's number), text of (stored) texts (node, rep, text_key): of each text one row, whose id is the smallest that has it."""
    texts = small(texts.select("node", "rep", "text_key"))
    met = docs.join(texts, docs["id"].eqNullSafe(texts["rep"]) & (_text_key(docs["text"]) == texts["text_key"]))
    return met.select(F.col("node").alias("id"), docs["text"]).dropDuplicates(["id"])


def _classed(docs: DataFrame, similarity: float, bands: int, rows: int, most_differ: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows (id, text_key), and per text its smallest id (rep), class (its least number: class_key; its smallest id: class_id) and how many rows have it (alike)."""
    sig = stored(signatures(docs, bands, rows, size), "near-signatures")
    reps = sig.groupBy("text_key").agg(F.min("id").alias("rep"), F.any_value("weight").alias("weight"), F.any_value("bands").alias("bands"), F.count(F.lit(1)).alias("alike"))
    reps = stored(reps.withColumn("node", F.monotonically_increasing_id()), "near-texts")  # texts are numbered, so those without an id count, too
    numbered = reps.select("node", "rep", "text_key")
    band = stored(reps.select(F.col("node").alias("rep"), "weight", F.explode("bands").alias("band")), "near-bands")
    pivot = band.groupBy("band").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), F.col("rep").alias("pivot"))).alias("p"), F.count("*").alias("n")).filter("n > 1").select("band", "p.pivot")
    pairs = band.join(pivot, "band").filter("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    pairs = stored(pairs, "near-pairs")
    edges = stored(verified(pairs, docs, numbered, similarity, size), "near-links")
    label = components(edges)
    placed = _undecided(band, label)
    open_ = stored(numbered.join(small(stored(placed.select(F.col("rep").alias("node")).distinct(), "near-open-ids")), "node", "left_semi"), "near-open-texts")
    texts = _text_of(docs, open_)
    lone = stored(lone_weight(texts, size), "near-lone")
    placed = placed.join(small(lone), placed["rep"] == lone["id"], "left").withColumn("common", F.col("weight") - F.coalesce("lone", F.lit(0))).drop("id")
    placed = stored(placed, "near-open")
    center = placed.groupBy("band").agg(F.max(F.struct((F.col("common") / F.col("weight")).alias("share"), F.col("rep").alias("pivot"))).alias("p")).select("band", "p.pivot")
    again = placed.join(center, "band").filter("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    again = stored(again.join(pairs, ["a", "b"], "left_anti"), "near-pairs")
    pairs = pairs.union(again)
    label = extended(label, stored(verified(again, docs, numbered, similarity, size), "near-links"))

    rest = _undecided(placed.drop("class_id"), label).filter(F.col("common") >= F.lit(similarity) * F.col("weight"))
    marks = stored(long_signatures(texts, LONG, size), "near-marks")
    rest = rest.join(marks, rest["rep"] == marks["id"]).drop("id").join(reps.select(F.col("node").alias("rep"), "bands"), "rep")
    step = F.floor(F.log(F.col("weight").cast("double")) / math.log(1 / similarity) + 1e-9)  # linked texts are of one step of weight or the next
    x = rest.select("band", step.alias("step"), *[F.col(c).alias(f"{c}_x") for c in ("rep", "weight", "common", "class_id", "marks", "bands")])
    y = rest.select("band", F.explode(F.array(step - 1, step, step + 1)).alias("step"), *[F.col(c).alias(f"{c}_y") for c in ("rep", "weight", "common", "class_id", "marks", "bands")])
    possible = F.least("common_x", "common_y") * (1 + similarity) >= F.lit(similarity) * (F.col("weight_x") + F.col("weight_y"))
    alike = differing(F.col("marks_x"), F.col("marks_y"), -(-LONG // LANES)) <= most_differ
    once = x["band"] == F.array_min(F.array_intersect("bands_x", "bands_y"))
    rest = x.join(y, (x["band"] == y["band"]) & (x["step"] == y["step"]) & (F.col("rep_x") < F.col("rep_y")) & (F.col("class_id_x") != F.col("class_id_y")) & possible & alike & once)
    rest = rest.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).distinct()
    rest = stored(rest.join(pairs, ["a", "b"], "left_anti"), "near-rest")
    if rest.limit(1).count():
        label = extended(label, stored(verified(rest, docs, numbered, similarity, size), "near-links"))
    keyed = reps.join(label.withColumnRenamed("id", "node"), "node", "left").select("text_key", "rep", "alike", F.coalesce("class_id", "node").alias("class_key"))
    named = keyed.groupBy("class_key").agg(F.min("rep").alias("class_id"))
    return sig, stored(keyed.join(named, "class_key"), "near-classes")


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, most_differ: int = MOST_DIFFER, size: int = SHINGLE) -> DataFrame:
    """One document of each class (see near_duplicates): that of the smallest id; where none has an id, that of the smallest text.

    A document is an id: it goes if any of its texts is in a class of a smaller id, and of its rows that of the smallest
    text stays, then of the smallest other values, so reruns agree in all columns. Other columns stay as they are. Null
    texts and texts without words are one class. An empty table gives none.
    """
    lean = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sig, classes = _classed(lean, similarity, bands, rows, most_differ, size)
    met = hot_join(sig.select("id", "text_key"), classes, ["text_key"], "alike", "inner")
    gone = small(stored(met.filter("id <> class_id").select("id").distinct(), "near-gone"))
    twice = small(stored(docs.filter(F.col(id).isNotNull()).groupBy(F.col(id).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("id"), "near-twice"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.struct(*columns)
    # which of equal rows stays is settled by all that they hold
    ordered = F.struct(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"), whole_row(docs, [c for c in docs.columns if c != text]).alias("r"))
    key = F.col(f"`{id}`").cast("long")
    kept = docs.filter(key.isNotNull()).join(gone, key == gone["id"], "left_anti")
    once = kept.join(twice, key == twice["id"], "left_anti").select(*columns)
    repeated = kept.join(twice, key == twice["id"], "left_semi").groupBy(key.alias("__id")).agg(F.min_by(whole, ordered).alias("__row")).select("__row.*")
    # rows without an id: of classes that no id is in, one each
    alone = classes.filter("class_id is null").select("text_key", "class_key", "alike")
    bare = docs.filter(key.isNull()).select(whole.alias("__row"), ordered.alias("__order"), _text_key(F.col(f"`{text}`")).alias("text_key"))
    bare = hot_join(bare, stored(alone, "near-alone"), ["text_key"], "alike", "inner").groupBy("class_key").agg(F.min_by("__row", "__order").alias("__row")).select("__row.*")
    return once.unionByName(repeated).unionByName(bare)
