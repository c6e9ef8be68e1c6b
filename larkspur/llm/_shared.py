"""Small helpers that the operators share: shared scratch tables, size-checked broadcasts and word arithmetic in numpy."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, for Java's and DuckDB's regular expressions: the six ASCII white-space bytes separate words.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes up to which a table may be broadcast after its values were summed.
BROADCAST_BYTES = 32 << 20
#: Rows of one key above which it is hot, if it also has one of HOT_SHARE parts of all rows.
HOT_ROWS, HOT_SHARE = 1000, 10_000
#: Bytes of text that numpy works on at once.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir). Only a local master may do without the setting: it gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="larkspur-"))
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_LOCAL: dict[str, str] = {}


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table written to the shared folder and read back: computed once, and safe when executors are lost. Results that are read later may still need it, so it is left to whoever clears that folder."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """With a broadcast hint if the (stored) table takes few bytes in memory, by the sizes of its values; else as it is, for a shuffled join."""
    held = df.agg(F.coalesce(F.sum(_row_bytes(df)), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(df) if held <= limit else df


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: 16 a value, and what texts, binaries and arrays hold."""
    total = F.lit(16 * (len(df.columns) + 1)).cast("long")
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            each = F.octet_length(F.array_join(c, "")) if isinstance(f.dataType.elementType, T.StringType) else F.lit(0)
            wide = 16 * (1 + len(f.dataType.elementType.fields)) if isinstance(f.dataType.elementType, T.StructType) else 16
            total = total + F.coalesce(F.greatest(F.size(c), F.lit(0)) * wide + F.coalesce(each, F.lit(0)), F.lit(0))
    return total


def hot_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "left") -> DataFrame:
    """left joined to right, a (stored) table of one row per key that tells in `weight` how many rows of left have the key.

    Keys of over HOT_ROWS rows, and a HOT_SHARE-th of all, are broadcast (HOT_SHARE rows at most), so that no task
    gets all rows of a key; the others meet by shuffle.
    """
    held = right.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("rows"), F.coalesce(F.max(weight), F.lit(0)).alias("most")).first()
    limit = max(HOT_ROWS, held["rows"] // HOT_SHARE)
    if held["most"] <= limit:
        return left.join(right, on, how)
    hot = F.broadcast(right.filter(F.col(weight) > limit).withColumn("__hot", F.lit(True)))
    met = left.join(hot, on, "left")
    cold = met.filter("__hot is null").select(*left.columns).join(right.filter(F.col(weight) <= limit), on, how)
    return met.filter("__hot").select(*cold.columns).unionByName(cold)


def whole_row(df: DataFrame, columns: list[str]) -> Column:
    """A text that orders rows by all that these columns hold (entries of maps in order of their keys), so ties are settled alike in each run."""

    def of(name: str) -> Column:
        c = F.col(f"`{name}`")
        return (F.sort_array(F.map_entries(c)) if isinstance(df.schema[name].dataType, T.MapType) else c).alias(name)

    return F.to_json(F.struct(*map(of, columns))) if columns else F.lit("")


# ---------------------------------------------------------------- numpy, inside tasks

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: The first 0 to 8 bytes of a little-endian long.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a span up to which numpy works on all spans at once.
LONG_SPAN = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the one of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from mixed 64-bit values."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column and where each begins (one more entry: the end); null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(bounds: np.ndarray, limit: int = CHUNK_BYTES):
    """Runs (from, to) of whole texts of about `limit` bytes."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


class Words:
    """Words of some texts. doc: the text of each word; first: where each text's words begin."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        self.buf, self.bounds, n = buf, bounds, len(buf)
        self.text = ~_SPACE[buf]
        edge = bounds[:-1][bounds[:-1] < bounds[1:]]
        before = np.zeros(n, bool)
        before[1:] = self.text[:-1]
        before[edge] = False
        after = np.zeros(n, bool)
        after[:-1] = self.text[1:]
        after[bounds[1:][bounds[:-1] < bounds[1:]] - 1] = False
        self.start = np.flatnonzero(self.text & ~before)
        self.end = np.flatnonzero(self.text & ~after) + 1
        self._held = np.concatenate((buf, np.zeros(8, np.uint8)))
        self._eight = np.ndarray(n + 1, "<u8", self._held, strides=(1,))  # the eight bytes from each place
        self.first = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(bounds) - 1), self.count)

    def _part(self, start: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
        """The k-th eight bytes of each span, those after its end as zeros."""
        return self._eight[start + 8 * k] & _MASK[np.minimum(size - 8 * k, 8)]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span, the same in every task: eight bytes at a time are mixed in; BLAKE2b for spans of over LONG_SPAN bytes."""
        size = end - start
        out = mix(size.astype(np.uint64) + _ODD)
        left = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
        k = 0
        while len(left):
            out[left] = mix((out[left] ^ self._part(start[left], size[left], k)) + _ODD)
            k += 1
            left = left[size[left] > 8 * k]
        for i in np.flatnonzero(size > LONG_SPAN).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.buf[start[i] : end[i]], digest_size=8).digest(), "little")
        return out

    def numbers(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A number below the count of spans for each: equal if and only if the bytes are. Spans of one hash are held against each other byte by byte."""
        n = len(start)
        if n == 0:
            return np.zeros(0, np.int64)
        hashed = self.hashes(start, end)
        order = np.argsort(hashed, kind="stable")
        new = np.append(True, hashed[order[1:]] != hashed[order[:-1]])
        x, y = order[1:][~new[1:]], order[:-1][~new[1:]]
        if not self._alike(start[x], end[x], start[y], end[y]):  # two texts of one hash: all of them are told apart by their bytes
            seen: dict[bytes, int] = {}
            return np.array([seen.setdefault(self.buf[a:b].tobytes(), len(seen)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(new) - 1
        return out

    def _alike(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> bool:
        size = a_end - a
        if not np.array_equal(size, b_end - b):
            return False
        left, k = np.flatnonzero(size <= LONG_SPAN), 0
        while len(left):
            if not np.array_equal(self._part(a[left], size[left], k), self._part(b[left], size[left], k)):
                return False
            k += 1
            left = left[size[left] > 8 * k]
        return all(np.array_equal(self.buf[a[i] : a_end[i]], self.buf[b[i] : b_end[i]]) for i in np.flatnonzero(size > LONG_SPAN).tolist())

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of `size` successive words and the text of each; a text of fewer words, but one at least, has one shingle of all."""
        word, n = self.hashes(self.start, self.end), len(self.start)
        end = self.first[1:][self.doc] if n else np.zeros(0, int)
        total = np.zeros(n, np.uint64)
        for k in range(size):
            part = np.zeros(n, np.uint64)
            part[: max(0, n - k)] = word[k:]
            part[np.arange(n) + k >= end] = 0
            total = mix(total + part + np.uint64(k + 1))
        keep = (np.arange(n) + size <= end) | ((np.arange(n) == self.first[:-1][self.doc]) & (self.count[self.doc] < size))
        return total[keep], self.doc[keep]
