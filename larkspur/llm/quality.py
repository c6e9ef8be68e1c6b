"""Quality rules on repetition, from suffix arrays over the words of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm._shared import Words, chunks, utf8

#: Repeats of fewer words don't count against a text.
MIN_REPEAT = 10
#: The share of words that repeats may cover, and the longest repeat in words, of texts that are kept.
MAX_COVERED = 0.30
MAX_LONGEST = 200
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def longest_repeats(key: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each place the length of the longest run from it that also begins elsewhere.

    key: a value per word (equal words of one text have equal values, words of two texts never have); end: where the
    text of each word ends. The suffixes are sorted by prefix doubling, in which only groups that are still tied are
    refined; the common prefixes of neighbours are then read off the ranks of each round. A suffix's longer one of the
    two common prefixes is the widest longest-common-prefix interval that holds it, a maximal repeat.
    """
    n = len(key)
    if n < 2:
        return np.zeros(n, np.int64)
    order = np.argsort(key)
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = key[order[1:]] != key[order[:-1]]
    head = np.flatnonzero(new)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    levels, step = [], 1
    tied = _tied(order, new)
    while len(tied):
        levels.append(rank.copy())
        follow = np.zeros(len(tied), np.uint64)
        inside = tied + step < end[tied]
        follow[inside] = rank[tied[inside] + step].astype(np.uint64) + np.uint64(1)
        both = (rank[tied].astype(np.uint64) << np.uint64(32)) | follow
        by = np.argsort(both)
        tied, both = tied[by], both[by]
        own = both >> np.uint64(32)
        group = np.empty(len(tied), bool)
        group[0] = True
        group[1:] = own[1:] != own[:-1]
        split = group.copy()
        split[1:] |= both[1:] != both[:-1]
        at = np.arange(len(tied))
        in_group = at - np.repeat(np.flatnonzero(group), np.diff(np.append(np.flatnonzero(group), len(tied))))
        heads = np.flatnonzero(split)
        rank[tied] = own.astype(np.int32) + np.repeat(in_group[heads], np.diff(np.append(heads, len(tied)))).astype(np.int32)
        tied = _tied(tied, split)
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    length = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) if levels else np.zeros(0, np.int64)
    a, b, same = order[live], order[live + 1], np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + same, b + same
        ok = (x < end[a]) & (y < end[b])
        ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        same[ok] += 1 << k
    length[live] = same
    longest = np.zeros(n, np.int64)
    longest[order[:-1]] = length
    longest[order[1:]] = np.maximum(longest[order[1:]], length)
    return longest


def _tied(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Those of a sorted list that share their group with another."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    return order[~alone]


def covered(at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n places lies in the union of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:n]) > 0


def measure(buf: np.ndarray, bounds: np.ndarray, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """Figures for each of some texts."""
    w, n = Words(buf, bounds), len(bounds) - 1
    per = lambda flag, doc: np.bincount(doc[flag], minlength=n)
    since = lambda flag: np.diff(np.concatenate(([0], np.cumsum(flag)))[bounds])
    out = {"n_words": w.count, "word_chars": since(w.text & ((buf & 0xC0) != 0x80)), "n_symbols": since(_SYMBOL[buf])}
    cut = np.flatnonzero(buf == 10)
    full = bounds[:-1] < bounds[1:]
    start = np.sort(np.concatenate((bounds[:-1][full], cut + 1)))
    start = start[start < len(buf)]
    end = np.append(start[1:], len(buf)) if len(start) else start
    end = end - ((end > start) & (buf[end - 1] == 10)) if len(start) else end
    start, end = start[end > start], end[end > start]
    said = np.concatenate(([0], np.cumsum(w.text)))
    worded = said[end] > said[start]
    start, end = start[worded], end[worded]
    doc = np.searchsorted(bounds, start, "right") - 1
    out["n_dup_lines"] = np.bincount(doc, minlength=n)
    if len(start):
        _, kept = np.unique(w.numbers(start, end) * n + doc, return_index=True)
        out["n_dup_lines"] = out["n_dup_lines"] - np.bincount(doc[kept], minlength=n)
    words = len(w.start)
    last = w.first[1:][w.doc] if words else np.zeros(0, np.int64)
    longest = longest_repeats(w.numbers(w.start, w.end) * n + w.doc, last)
    three = np.flatnonzero(longest >= 3)
    out["n_repeat_words"] = per(covered(three, np.full(len(three), 3), words), w.doc)
    long = np.flatnonzero(longest >= min_repeat)
    out["n_covered_words"] = per(covered(long, longest[long], words), w.doc)
    out["longest_repeat"] = np.zeros(n, np.int64)
    np.maximum.at(out["longest_repeat"], w.doc, longest)
    return out


def repetition(docs: DataFrame, text: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Adds figures on each text, and whether it is kept.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words (words in repeats of min_repeat
    words and more), longest_repeat (in words), base_failed (under 50 words, or over half of them in repeated windows
    of three words) and kept (not base_failed, at most max_covered of the words in repeats, no repeat of over
    max_longest words). Words and lines are equal if their bytes are. Null and empty texts have no words and so fail; every row gives one row, equal rows equal ones.
    Columns of these names in the input are replaced. Each text is measured by itself: nothing is shuffled.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]
    keep = [c for c in docs.columns if c not in (*names, "base_failed", "kept")]
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in keep]).schema, *(T.StructField(n, T.LongType()) for n in names), *(T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, bounds = utf8(batch.column(keep.index(text)))
            for lo, hi in chunks(bounds):
                at = bounds[lo : hi + 1]
                m = measure(buf[at[0] : at[-1]], at - at[0], min_repeat)
                bad = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                good = ~bad & (m["n_covered_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_longest)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(m[n].astype(np.int64)) for n in names), pa.array(bad), pa.array(good)], [*keep, *names, "base_failed", "kept"])

    return docs.select(*[f"`{c}`" for c in keep]).mapInArrow(run, schema)
