"""Best-fit packing: token pieces of documents are packed into sequences of bounded length, in bulk-synchronous rounds."""

from __future__ import annotations

import functools
import itertools
import json
import re
import sys
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._shared import stored

#: Tokens of a sequence.
SIZE = 2048
#: Rows (documents and gaps) that one sweep goes through. Each lane can leave one sequence badly filled, so of the
#: thousands of sequences that it fills less than a thousandth is lost.
LANE_ROWS = 8192
#: Rounds by the size of documents: each takes documents of over this part of a sequence that earlier rounds left.
PARTS = (2, 4, 8, 0)
#: Bytes of ids after which a batch is passed on; characters of a text that are worked on at once.
BATCH_BYTES, CUT_CHARS = 4 << 20, 1 << 20

#: How a byte-level tokenizer cuts a text into words; characters whose class (letter, number, space) all editions of Unicode that libraries use agree on.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SETTLED = re.compile("[\x00-\x1b\x20-\u036f\u0386-\u03e1\u0400-\u0525\u1e00-\u1eff\u2000-\u200a\u2010-\u2027\u2030-\u205e\u20a0-\u20b5\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]*")
_EDGE = re.compile(r"\S(?=\s)")


class Ids:
    """Ids of texts as little-endian unsigned 32-bit integers, by a file of the `tokenizers` library.

    Of a byte-level BPE file whose merges stand in the order of their ids, the vocabulary also goes into the faster
    library of ranks, which gives the same ids; texts with a character outside _SETTLED, and other kinds of files, go
    to `tokenizers` itself. Names of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(path)
        self._slow.encode_special_tokens = True
        self._fast = _ranked(path)

    def __call__(self, text: str) -> bytes:
        if self._fast is None or not _SETTLED.fullmatch(text):
            return array("I", self._slow.encode(text, add_special_tokens=False).ids).tobytes()
        if len(text) <= CUT_CHARS:
            return array("I", self._fast.encode_ordinary(text)).tobytes()
        out, at = [], 0
        while at < len(text):  # in parts that end where a word must end: before white space after another character
            edge = _EDGE.search(text, at + CUT_CHARS)
            to = edge.end() if edge else len(text)
            out.append(array("I", self._fast.encode_ordinary(text[at:to])).tobytes())
            at = to
        return b"".join(out)


def _ranked(path: str):
    """The ranks' library with a tokenizer file's vocabulary, or None if the file isn't a plain byte-level BPE."""
    import tiktoken

    said = json.loads(Path(path).read_text())
    model, cut = said["model"], said.get("pre_tokenizer") or {}
    plain = said.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and sys.byteorder == "little"
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    vocab = model["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in itertools.pairwise(made)):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others are moved up, in order
    byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in set(shown))}
    special = {t["content"] for t in said.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): k for token, k in vocab.items() if token not in special}
    return tiktoken.Encoding(path, pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}) if len(made) + 256 == len(ranks) else None


@functools.lru_cache(maxsize=4)
def _ids(path: str) -> Ids:
    return Ids(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece (from 0), start (ids of the document before it), length and ids (little-endian unsigned 32-bit, binary) of each document.

    A document is its text's ids and then end_id; a null text counts as empty, so every row has a piece. One of more
    than `size` ids is cut into pieces of `size`, of which the first may be shorter. Each row is a document of its own,
    repeated and null ids included. tokenizer: a file for the `tokenizers` library that each executor has; None names
    the public byte-level one, by a name that is looked up on the executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(tokenizer or default_tokenizer())
        end = np.array([end_id], "<u4").tobytes()
        rows, held = ([], [], [], [], []), 0

        def batch() -> pa.RecordBatch:
            kinds = (None, pa.int32(), pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, kind or key) for c, kind in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

        for b in batches:
            key = b.column(0).type
            for row, said in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = ids(said.as_py() or "") + end
                n = len(data) // 4
                first = (n - 1) % size + 1
                at = 0
                for k in range((n + size - 1) // size):
                    to = first + k * size
                    for c, v in zip(rows, (row, k, at, to - at, data[4 * at : 4 * to]), strict=True):
                        c.append(v)
                    at = to
                held += len(data)
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = ([], [], [], [], []), 0
        if rows[0]:
            yield batch()

    taken = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = taken.schema["doc_id"].dataType.simpleString()
    return taken.mapInArrow(run, f"doc_id {kind}, piece int, start long, length int, ids binary")


def packed(rows: DataFrame, size: int = SIZE, length: str = "length", lane_rows: int = LANE_ROWS) -> DataFrame:
    """The rows (pieces of 1 to `size` tokens, by column `length`) with the sequence each is in and its place there.

    sequence_id: the same for pieces that stand together (any numbers); offset: places are without gaps from 0. Columns
    of those names in the input are replaced; all others stay as they are. Rows that are null, below 1 or above `size`
    in length fit no sequence: both values are null.

    Bulk-synchronous best fit. Pieces of over half a sequence open one each, which leaves gaps. Each round takes the
    next shorter pieces: they and the gaps that could hold one are range-sorted by size and dealt from that order to
    lanes in turn, so each lane has the same spread of both. A lane sweeps its pieces from the longest on: each goes
    to its successor among the gaps, the smallest that holds it. Pieces after the same gap are ranked (longer first,
    then a hash of the row): the first takes it, the next sweeps on to the next gap, and where none is left it opens a
    sequence. What remains of a gap is a gap of the next round. A lane has about lane_rows rows at any size of the
    input, and only sizes and row numbers are shuffled.
    """
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    lean = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{length}`").cast("int").alias("n"))
    lean = stored(lean.withColumn("n", F.when(F.col("n").between(1, size), F.col("n"))).withColumn("key", F.monotonically_increasing_id()), "packing-pieces")
    first = max(1, size // PARTS[0])
    opens = lean.filter(F.col("n") > first)
    placed = opens.select("key", F.col("key").alias("sequence_id"), F.lit(0).alias("offset"))
    gaps = opens.filter(F.col("n") < size).select("key", (F.lit(size) - F.col("n")).alias("value"))
    above = first
    for part in PARTS[1:]:
        below = size // part if part else 0
        if below >= above:
            continue
        docs = lean.filter((F.col("n") > below) & (F.col("n") <= above)).select("key", F.col("n").alias("value"))
        done = _round(docs, gaps.filter(F.col("value") > below), size, lane_rows)
        placed = placed.unionByName(done.filter("sequence_id is not null").select("key", "sequence_id", "offset"))
        gaps = gaps.filter(F.col("value") <= below).unionByName(done.filter("sequence_id is null").select("key", F.col("offset").alias("value")))
        above = below
    out = lean.join(placed, "key", "left")
    return out.select("row.*", "sequence_id", F.col("offset").cast("long").alias("offset")) if kept else out.select("sequence_id", F.col("offset").cast("long").alias("offset"))


def _round(docs: DataFrame, gaps: DataFrame, size: int, lane_rows: int) -> DataFrame:
    """One round, stored: a row (key, sequence_id, offset) per document, and per open gap (key of the sequence, null, tokens left)."""
    both = docs.withColumn("doc", F.lit(True)).unionByName(gaps.withColumn("doc", F.lit(False))).withColumn("tie", F.xxhash64("key"))
    lanes = max(1, -(-both.count() // lane_rows))
    # numbers in sorted order: the sort stays, since what numbers the rows is not deterministic to the optimiser
    order = [F.col("doc"), F.col("value").desc(), F.col("tie")]
    dealt = both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    lane = F.pmod(F.col("at") + F.shiftright("at", 33) * 7919, F.lit(lanes)).cast("int")
    swept = dealt.select(lane.alias("lane"), "key", "value", "doc", "tie").groupBy("lane").applyInArrow(_sweep(size), "key long, sequence_id long, offset int")
    return stored(swept, "packing-round")


def _sweep(size: int):
    def run(lane: pa.Table) -> pa.Table:
        key, value, doc, tie = (lane.column(c).to_numpy() for c in ("key", "value", "doc", "tie"))
        gap_of, tokens = key[~doc], value[~doc]
        where: list[list[int]] = [[] for _ in range(size + 1)]
        for k in np.lexsort((tie[~doc], tokens)).tolist():
            where[tokens[k]].append(int(gap_of[k]))
        open_ = 0  # bit v: a gap of v tokens is there
        for v in set(tokens.tolist()):
            open_ |= 1 << v
        keys, sizes = key[doc], value[doc]
        ranked = np.lexsort((tie[doc], -sizes))
        out_key, out_seq, out_at = [], [], []
        for k, n in zip(keys[ranked].tolist(), sizes[ranked].tolist(), strict=True):
            fits = open_ >> n
            if fits:  # the successor: the smallest gap of n tokens at least
                v = n + (fits & -fits).bit_length() - 1
                seq = where[v].pop()
                if not where[v]:
                    open_ ^= 1 << v
            else:
                v, seq = size, k
            out_key.append(k)
            out_seq.append(seq)
            out_at.append(size - v)
            if v > n:
                where[v - n].append(seq)
                open_ |= 1 << (v - n)
        for v in range(1, size + 1):
            out_key += where[v]
            out_seq += [None] * len(where[v])
            out_at += [v] * len(where[v])
        return pa.table({"key": pa.array(out_key, pa.int64()), "sequence_id": pa.array(out_seq, pa.int64()), "offset": pa.array(out_at, pa.int32())})

    return run


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id, length and ids (binary) of each sequence, from packed pieces with their ids: what a trainer reads. Pieces without a sequence are left out."""
    one = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return rows.filter("sequence_id is not null").groupBy("sequence_id").agg(one.alias("parts")).select("sequence_id", (F.length(whole) / 4).cast("int").alias("length"), whole.alias("ids"))
