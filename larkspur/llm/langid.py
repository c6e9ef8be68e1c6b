"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted arrays.

All grams of all training rows are kept. Spark counts them and joins the counts to probabilities; the table is then
range-sorted by gram and packed into shards of bounded size. A task that scores texts loads the shards that its grams
fall into and forgets the ones it used longest ago, so its memory is bounded however large the models are.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm._shared import shared_dir, stored

#: Characters of the longest grams; four of 16 bits make a 64-bit key, so keys are exact.
ORDER = 4
#: Values of one shard (14 bytes each at most), and bytes of shards that a task holds.
SHARD_VALUES, HELD_BYTES = 1 << 20, 192 << 20
#: Values of the table of grams by languages that a task fills at once.
TABLE_VALUES = 1 << 23
#: One of so many training texts is held back to find where to reject, and scored by models that haven't seen it.
FOLDS = 10
#: A prediction is rejected if its cross-entropy is above this quantile of the language's held-back texts.
ACCEPTED = 0.995
#: The score is the posterior of so many average grams.
SCORE_GRAMS = 20
UNKNOWN = "und"
_SPACE, _SYMBOLS = 0x20, 1 << 16
_CHUNK = 1 << 21
#: Grams that a task counts before it hands them on.
_HELD_GRAMS = 1 << 21


def _alphabet() -> np.ndarray:
    """Letters (and halves of characters beyond 16 bits) stand for themselves, all else for a space."""
    kept = np.array([chr(c).isalpha() or 0x300 <= c < 0x370 or 0xD800 <= c < 0xE000 for c in range(_SYMBOLS)])
    return np.where(kept, np.arange(_SYMBOLS), _SPACE).astype(np.uint16)


class Grams:
    """Turns texts into the grams of their lower-case letters, runs of all else being one space."""

    def __init__(self):
        self.table = _alphabet()

    def symbols(self, text: str) -> np.ndarray:
        s = self.table[np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), np.uint16)]
        if len(s):
            blank = s == _SPACE
            s = s[np.concatenate(([True], ~(blank[1:] & blank[:-1])))]
        pad = np.full(ORDER - 1, _SPACE, np.uint16)
        return np.concatenate((pad, s, pad[:1]))

    def keys(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The grams of all parts, and the part of each."""
        size = np.array([len(p) - ORDER + 1 for p in parts])
        s = np.concatenate(parts).astype(np.uint64)
        key = s[: len(s) - ORDER + 1].copy()
        for k in range(1, ORDER):
            key = (key << np.uint64(16)) | s[k : len(s) - ORDER + 1 + k]
        start = np.cumsum([0, *(len(p) for p in parts)])[:-1]
        at = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
        return key[at], np.repeat(np.arange(len(parts)), size)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, text, fold) -> lang, gram, n over all rows, and first, that of the rows which no fold holds back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held = Grams(), {}

        def merge(key: tuple[str, bool], parts: list[np.ndarray]) -> None:
            gram, n = np.unique(grams.keys(parts)[0], return_counts=True)
            if key in held:
                both = np.concatenate((held[key][0], gram))
                gram, at = np.unique(both, return_inverse=True)
                n = np.bincount(at, np.concatenate((held[key][1], n))).astype(np.int64)
            held[key] = (gram, n)

        def flush() -> Iterator[pa.RecordBatch]:
            while held:
                (lang, fold), (gram, n) = held.popitem()
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(gram), np.int32))), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(n.astype(np.int64) * (not fold))], ["lang", "gram", "n", "first"])

        for batch in batches:
            waiting: dict[tuple[str, bool], list[np.ndarray]] = {}
            size: dict[tuple[str, bool], int] = {}
            for lang, text, fold in zip(*batch.columns, strict=True):
                key, s = (lang.as_py(), fold.as_py()), grams.symbols(text.as_py())
                waiting.setdefault(key, []).append(s)
                size[key] = size.get(key, 0) + len(s)
                if size[key] >= _CHUNK:
                    merge(key, waiting.pop(key))
                    size[key] = 0
            for key, parts in waiting.items():
                merge(key, parts)
            if sum(len(g) for g, _ in held.values()) >= _HELD_GRAMS:
                yield from flush()
        yield from flush()

    return docs.select("lang", "text", "fold").mapInArrow(run, "lang string, gram long, n long, first long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))


def _suffix(order: int) -> int:
    """A mask that keeps the last characters."""
    return -1 if order == ORDER else (1 << (16 * order)) - 1


def probabilities(counts: DataFrame) -> DataFrame:
    """(lang, gram, c) of the longest grams -> kind, key, lang, value: all that the models say.

    Kinds 1 to ORDER hold grams of that many characters and the logarithm of their interpolated probability after all
    but their last; kinds ORDER + 1 to 2 ORDER their contexts, and the logarithm of the share that these leave to
    shorter grams. The longest grams count by frequency, shorter ones by how many characters precede them.
    """
    levels, own = {ORDER: counts.select("lang", "gram", F.col("c").cast("double").alias("c"))}, None
    for k in range(ORDER - 1, 0, -1):
        levels[k] = levels[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit(_suffix(k))).alias("gram")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    for k, level in levels.items():
        level = level.select(F.lit(k).alias("k"), "lang", "gram", "c")
        own = level if own is None else own.unionByName(level)
    own = stored(own, "lang-grams")
    one, two = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    off = F.broadcast(own.groupBy("k", "lang").agg(F.when(one > 0, F.least(F.lit(0.9), one / (one + 2 * two))).otherwise(0.5).alias("off")))  # a row per language and k
    context = own.groupBy("k", "lang", F.shiftrightunsigned("gram", 16).alias("context")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
    context = stored(context.join(off, ["k", "lang"]).withColumn("share", F.col("off") * F.col("kinds") / F.col("total")), "lang-contexts")
    seen = own.withColumn("context", F.shiftrightunsigned("gram", 16)).join(context, ["k", "lang", "context"])
    seen = stored(seen.select("k", "lang", "gram", ((F.col("c") - F.col("off")) / F.col("total")).alias("p"), "share"), "lang-seen")
    lower, done = None, None
    for k in range(1, ORDER + 1):
        level = seen.filter(F.col("k") == k)
        if lower is None:
            level = level.select("lang", "gram", (F.col("p") + F.col("share") / _SYMBOLS).alias("p"))
        else:
            short = lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("q"))
            level = level.withColumn("short", F.col("gram").bitwiseAND(F.lit(_suffix(k - 1)))).join(short, ["lang", "short"]).select("lang", "gram", (F.col("p") + F.col("share") * F.col("q")).alias("p"))
        lower = stored(level, "lang-level")
        part = lower.select(F.lit(k).alias("kind"), F.col("gram").alias("key"), "lang", F.log("p").cast("float").alias("value"))
        done = part if done is None else done.unionByName(part)
    return done.unionByName(context.select((F.col("k") + ORDER).alias("kind"), F.col("context").alias("key"), "lang", F.log("share").cast("float").alias("value")))


_SHARD = "kind int, shard long, first long, bytes binary"


def _packed(languages: list[str], shard_values: int):
    """Of rows sorted by kind and key: shards of whole keys, each a row."""
    number = {lang: j for j, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, held = 0, None

        def cut(kind: int, key: np.ndarray, lang: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            data = np.array([len(start), len(key)], np.int64).tobytes() + key[start].tobytes() + np.append(start, len(key)).astype(np.uint32).tobytes() + value.tobytes() + lang.tobytes()
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([(TaskContext.get().partitionId() << 32) + made], pa.int64()), pa.array([int(key[0])], pa.int64()), pa.array([data], pa.binary())], ["kind", "shard", "first", "bytes"])

        for batch in batches:
            said = batch.column(2).dictionary_encode()
            own = np.array([number[x] for x in said.dictionary.to_pylist()], np.uint16)[said.indices.to_numpy()]
            new = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), own, batch.column(3).to_numpy().astype(np.float32))
            held = new if held is None else tuple(np.concatenate((a, b)) for a, b in zip(held, new, strict=True))
            while len(held[1]) and (held[0][0] != held[0][-1] or len(held[1]) > shard_values):
                kinds, keys = held[0], held[1]
                upto = int(np.searchsorted(kinds, kinds[0], "right"))
                at = min(upto, shard_values)
                if at < upto:
                    at = int(np.searchsorted(keys[:upto], keys[at], "left")) or int(np.searchsorted(keys[:upto], keys[0], "right"))
                if at == len(keys):
                    break  # the last key may go on in the next batch
                yield cut(int(kinds[0]), *(x[:at] for x in held[1:]))
                made, held = made + 1, tuple(x[at:] for x in held)
        if held is not None and len(held[1]):
            yield cut(int(held[0][0]), *held[1:])

    return run


_HELD: OrderedDict[tuple, tuple] = OrderedDict()


def _shard(root: str, kind: int, shard: int) -> tuple[np.ndarray, ...]:
    """Sorted keys, where each one's values start, languages and values; kept in the worker as long as there is room."""
    name = (root, kind, shard)
    if name in _HELD:
        _HELD.move_to_end(name)
        return _HELD[name]
    store, path = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    data = pa.dataset.dataset(f"{path}/kind={kind}/shard={shard}", filesystem=store, format="parquet").to_table(columns=["bytes"]).column(0)[0].as_py()
    keys, n = np.frombuffer(data, np.int64, 2)
    at = 16 + 8 * keys
    out = (np.frombuffer(data, np.int64, keys, 16), np.frombuffer(data, np.uint32, keys + 1, at), np.frombuffer(data, np.uint16, n, at + 4 * (keys + 1) + 4 * n), np.frombuffer(data, np.float32, n, at + 4 * (keys + 1)))
    while _HELD and sum(len(x[0]) * 12 + len(x[2]) * 6 for x in _HELD.values()) + len(data) > HELD_BYTES:
        _HELD.popitem(last=False)
    _HELD[name] = out
    return out


@dataclass
class KneserNey:
    """The models of some languages: where their shards are, and the first key of each, by kind."""

    languages: list[str]
    root: str
    firsts: dict[int, tuple[np.ndarray, np.ndarray]]

    def _values(self, kind: int, asked: np.ndarray) -> np.ndarray:
        """A row for each of sorted keys, a column per language; NaN for what hasn't been seen."""
        out = np.full((len(asked), len(self.languages)), np.nan, np.float32)
        first, shards = self.firsts[kind]
        where = np.searchsorted(first, asked, "right") - 1
        for w in np.unique(where[where >= 0]):
            keys, start, lang, value = _shard(self.root, kind, int(shards[w]))
            lo, hi = np.searchsorted(where, [w, w + 1])
            at = np.minimum(np.searchsorted(keys, asked[lo:hi]), len(keys) - 1)
            known = np.flatnonzero(keys[at] == asked[lo:hi])
            n = (start[at[known] + 1] - start[at[known]]).astype(np.int64)
            inner = np.arange(n.sum()) + np.repeat(start[at[known]].astype(np.int64) - (np.cumsum(n) - n), n)
            out[np.repeat(lo + known, n), lang[inner]] = value[inner]
        return out

    def log_probability(self, asked: np.ndarray) -> np.ndarray:
        """Of each sorted gram's last character after the others, a column per language."""
        grams, short = {ORDER: asked}, {}
        for k in range(ORDER - 1, 0, -1):
            grams[k], short[k + 1] = np.unique(grams[k + 1] & np.int64(_suffix(k)), return_inverse=True)
        out = np.full((1, len(self.languages)), -math.log(_SYMBOLS), np.float32)
        short[1] = np.zeros(len(grams[1]), np.int64)
        for k in range(1, ORDER + 1):
            context, at = np.unique((grams[k].view(np.uint64) >> np.uint64(16)).view(np.int64), return_inverse=True)
            back = np.nan_to_num(self._values(ORDER + k, context), nan=0.0)
            own = self._values(k, grams[k])
            out = np.where(np.isnan(own), back[at] + out[short[k]], own)
        return out


def trained(counts: DataFrame, shard_values: int = SHARD_VALUES) -> KneserNey:
    """The models of (stored) counts (lang, gram, c), in shards in the shared folder."""
    spark, root = counts.sparkSession, shared_dir(counts.sparkSession, "lang-model")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # as many as languages
    rows = probabilities(counts)
    (rows.repartitionByRange("kind", "key").sortWithinPartitions("kind", "key", "lang").select("kind", "key", "lang", "value")
        .mapInArrow(_packed(languages, shard_values), _SHARD).write.partitionBy("kind", "shard").parquet(root))
    return _opened(spark, root, languages)


def _opened(spark: SparkSession, root: str, languages: list[str]) -> KneserNey:
    index = spark.read.schema("first long, kind int, shard long").parquet(root).select("kind", "first", "shard").toPandas() if languages else None  # a row per SHARD_VALUES values
    firsts = {}
    for kind in range(1, 2 * ORDER + 1):
        part = index[index["kind"] == kind].sort_values("first") if languages else None
        firsts[kind] = (part["first"].to_numpy(np.int64), part["shard"].to_numpy(np.int64)) if languages else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return KneserNey(languages, root, firsts)


def predicted(docs: DataFrame, model: KneserNey, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1) and cross_entropy (of lang_pred, in nats a gram; null for und)."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "cross_entropy")]
    docs = docs.select(*[f"`{c}`" for c in names])
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            texts = batch.column(names.index(text))
            lo, parts, size = 0, [], 0
            for i in range(len(texts)):
                said = texts[i].as_py() or ""
                lettered = any(map(str.isalpha, said)) and len(model.languages) > 0
                parts.append(grams.symbols(said) if lettered else np.zeros(ORDER - 1, np.uint16))
                size += len(parts[-1])
                if size >= _CHUNK or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(lo, i + 1 - lo).columns, *_judged(model, grams, parts)], [*names, "lang_pred", "score", "cross_entropy"])
                    lo, parts, size = i + 1, [], 0

    return docs.mapInArrow(run, schema)


def cross_entropies(model: KneserNey, grams: Grams, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per text its grams, and per language the mean of their negative log-probabilities."""
    key, part = grams.keys(parts)
    n = np.bincount(part, minlength=len(parts))
    loss = np.zeros((len(parts), len(model.languages)))
    asked, at = np.unique(key.view(np.int64), return_inverse=True)
    block = max(1, TABLE_VALUES // max(1, len(model.languages)))
    for lo in range(0, len(asked), block):
        logp = model.log_probability(asked[lo : lo + block])
        mine = np.flatnonzero((at >= lo) & (at < lo + block)) if len(asked) > block else slice(None)
        own, doc = at[mine] - lo, part[mine]
        for j in range(len(model.languages)):
            loss[:, j] -= np.bincount(doc, logp[own, j], len(parts))
    return n, loss / np.maximum(n, 1)[:, None]


def _judged(model: KneserNey, grams: Grams, parts: list[np.ndarray]) -> list[pa.Array]:
    if not model.languages:
        return [pa.array([UNKNOWN] * len(parts)), pa.array([0.0] * len(parts)), pa.nulls(len(parts), pa.float64())]
    n, loss = cross_entropies(model, grams, parts)
    best = loss.argmin(axis=1)
    least = loss[np.arange(len(parts)), best]
    score = 1 / np.exp(-SCORE_GRAMS * (loss - least[:, None])).sum(axis=1)
    said = np.array(model.languages, object)[best]
    said[n == 0] = UNKNOWN
    return [pa.array(said, pa.string()), pa.array(np.where(n > 0, score, 0.0)), pa.array(least, mask=n == 0)]


def identified(docs: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text", lang: str = "lang", accepted: float = ACCEPTED, folds: int = FOLDS, shard_values: int = SHARD_VALUES) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for every row.

    held_out: a column of id and row that says which rows the models don't learn from; of the rest those with a
    language and a text count, all of them and all their grams. A text gets the language of the lowest cross-entropy a
    gram (of equal ones the first by name). It is rejected if that is above the `accepted` quantile of the language's
    held-back training texts: one text in `folds`, by a hash of the text (so that copies go together), is scored by
    models that have learned from the others only. A language rejects none if these are too few to tell its quantile
    (fewer than accepted / (1 - accepted)).

    Null texts and texts without a letter are `und` with score 0, and rejected; so is all if there is nothing to learn
    from. Rows with a null id or language are predicted like others; repeated rows count and are predicted each; very
    long texts are scored whole. Columns of other names are ignored. An empty table gives none.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held_out.alias("held_out"))
    learned = rows.filter("not held_out and lang is not null and text is not null").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(folds)) == 0)
    counts = stored(counted(learned), "lang-counts")
    model = trained(counts.select("lang", "gram", F.col("n").alias("c")), shard_values)
    judged = predicted(rows, model).drop("text")
    first = trained(counts.filter("first > 0").select("lang", "gram", F.col("first").alias("c")), shard_values)
    back = predicted(learned.filter("fold").select("lang", "text"), first).filter("lang = lang_pred")
    n = F.count(F.lit(1))
    limits = back.groupBy("lang_pred").agg(F.when((n + 1) * accepted <= n, F.percentile_approx("cross_entropy", F.lit(accepted), 10000)).alias("most"))
    limits = F.broadcast(stored(limits, "lang-limits"))  # a row per language
    return judged.join(limits, "lang_pred", "left").select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", F.when(F.col("lang_pred") == UNKNOWN, True).otherwise(F.coalesce(F.col("cross_entropy") > F.col("most"), F.lit(False))).alias("rejected"))
