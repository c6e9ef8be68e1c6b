"""Removal of repeated byte strings: suffix arrays per shard, common prefixes, and merging of shards by binary search.

Shards are packs of some megabytes of whole texts. A first pass over them finds which content occurs twice at all: of
the k-grams in each window of `length` bytes one, that with the smallest hash, is its anchor, so equal windows have
equal anchors wherever they stand. Only windows whose anchor occurs again are sorted. Each shard then finds its own
repeats, and sends on, by anchor, what is left of its sorted windows; there the shards' windows meet and are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._shared import _INVERSE, _ODD, chunks, hot_join, mix, small, stored, utf8

LENGTH = 100
#: Bytes of the k-grams among which a window's anchor is chosen.
ANCHOR = 60
PACK_BYTES = 1 << 19
#: Packs that share one list of anchors which occur again.
LOT_PACKS = 16
#: Bytes of text for each of the groups in which shards meet, and bytes above which a group is dealt out by window.
GROUP_BYTES, HEAVY_BYTES = 4 << 20, 8 << 20
_LANES, _FAR = 8192, 128
#: Bytes hashed at once, and windows merged at once.
_PIECE, _BLOCK = 1 << 18, 300_000
#: Windows that are dealt out one by one at once.
_SINGLES = 20_000
#: Hashes that a task holds before it hands them on.
_LOT_HASHES = 2_000_000


def span_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place (for the last places there is none)."""
    n = len(buf) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for at in range(0, n, _PIECE):
        piece = buf[at : at + _PIECE + size - 1]
        m = len(piece)
        power = np.full(m + 1, _ODD)
        power[0] = 1
        total = np.zeros(m + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * np.cumprod(power)[:m], out=total[1:])
        power[1:] = _INVERSE
        out[at : at + _PIECE] = mix((total[size:] - total[:-size]) * np.cumprod(power)[: m - size + 1])
    return out


def anchors(buf: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows begin that lie within one text, the place of each one's anchor, and a key of each k-gram.

    Anchors are the least of many hashes, so theirs are small ones; keys are hashed anew and spread evenly over groups.
    """
    h = span_hashes(buf, k)
    if len(buf) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), h
    low = np.uint64((1 << 21) - 1)
    best = (h & ~low) | (np.arange(len(h), dtype=np.uint64) & low)
    width, have = length - k + 1, 1
    while have * 2 <= width:
        best = np.minimum(best[: len(best) - have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[: len(best) - (width - have)], best[width - have :])
    end = np.repeat(bounds[1:], np.diff(bounds))
    start = np.flatnonzero(np.arange(len(best)) + length <= end[: len(best)])
    place = start + ((best[start] - start.astype(np.uint64)) & low).astype(np.int64)
    return start, place, mix(h + _ODD)


def words8(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, zeros after the end."""
    n, out = len(buf), np.zeros(len(buf), np.uint64)
    for at in range(0, n, _PIECE):
        piece = np.concatenate((buf[at : at + _PIECE + 8], np.zeros(8, np.uint8))).astype(np.uint64)
        m = min(_PIECE, n - at)
        for k in range(8):
            out[at : at + m] = (out[at : at + m] << np.uint64(8)) | piece[k : m + k]
    return out


def suffix_array(word: np.ndarray, end: np.ndarray, far: int = _FAR) -> np.ndarray:
    """Places in the order of the texts from them, as far as `far` bytes decide.

    Larsson and Sadakane's refinement: after a sort by eight bytes, groups that are tied at h bytes are sorted by the
    rank of the place h further on, which doubles h; groups of one are settled and not touched again. end: where the
    run of text that holds each place ends.
    """
    n = len(word)
    order = np.argsort(word)
    new = np.ones(n, bool)
    new[1:] = word[order[1:]] != word[order[:-1]]
    head = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    alone = new.copy()
    alone[:-1] &= new[1:]
    tied, h = order[~alone], 8
    while len(tied) and h < far:
        follow = np.zeros(len(tied), np.uint64)
        inside = tied + h < end[tied]
        follow[inside] = rank[tied[inside] + h].astype(np.uint64) + np.uint64(1)
        both = (rank[tied].astype(np.uint64) << np.uint64(32)) | follow
        by = np.argsort(both)
        tied, both = tied[by], both[by]
        own = both >> np.uint64(32)
        group, split = np.ones(len(tied), bool), np.ones(len(tied), bool)
        group[1:] = own[1:] != own[:-1]
        split[1:] = both[1:] != both[:-1]
        first, heads = np.flatnonzero(group), np.flatnonzero(split)
        inner = np.arange(len(tied)) - np.repeat(first, np.diff(np.append(first, len(tied))))
        rank[tied] = own.astype(np.int64) + np.repeat(inner[heads], np.diff(np.append(heads, len(tied))))
        alone = split.copy()
        alone[:-1] &= split[1:]
        tied, h = tied[~alone], h * 2
    return np.argsort(rank, kind="stable")


def common_prefixes(word: np.ndarray, end: np.ndarray, order: np.ndarray, far: int = _FAR) -> np.ndarray:
    """For each place in the order, how many bytes it has in common with the one before it, `far` at most.

    Kasai's rule, that the place after one with a common prefix of l has one of l - 1 at least, is followed in many
    stretches of the text at once. It needs an order that l bytes decide, so after a prefix of `far` it starts anew.
    """
    n = len(word)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    lanes = min(_LANES, n)
    steps = -(-n // lanes)
    base, have = np.arange(lanes) * steps, np.zeros(lanes, np.int64)
    for step in range(steps):
        at = base + step
        live = np.flatnonzero((at < n) & (before[np.minimum(at, n - 1)] >= 0))
        i = at[live]
        j = before[i]
        most = np.minimum(np.minimum(end[i] - i, end[j] - j), far)
        common = np.minimum(np.maximum(have[live] - 1, 0), most)
        open_ = np.flatnonzero(common < most)
        while len(open_):
            differ = word[i[open_] + common[open_]] ^ word[j[open_] + common[open_]]
            same = sum((differ < np.uint64(1 << (64 - 8 * b))).astype(np.int64) for b in range(1, 8)) + (differ == 0)
            common[open_] += same
            open_ = open_[(same == 8) & (common[open_] < most[open_])]
        common = np.minimum(common, most)
        have[:] = 0
        have[live] = np.where(common < far, common, 0)
        out[i] = common
    return out[order]


def _runs(doc: np.ndarray, at: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of successive places of one document (and equal further values)."""
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    for x in more:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(at))[: len(first)] - 1


def shard_repeats(buf: np.ndarray, bounds: np.ndarray, start: np.ndarray, length: int, ids: np.ndarray) -> np.ndarray:
    """Which of the windows at `start` are equal to one of a smaller id, or of the same id and a smaller place. ids: ascending, of each text."""
    cover = np.zeros(len(buf) + 1, np.int64)
    cover[start] += 1
    cover[start + length] -= 1
    held = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    gap = np.ones(len(held), bool)
    gap[1:] = held[1:] != held[:-1] + 1
    gap |= np.isin(held, bounds)
    first = np.flatnonzero(gap)
    end = np.repeat(np.append(first[1:], len(held)), np.diff(np.append(first, len(held))))
    word = words8(buf[held])
    for k in range(1, 8):  # bytes of the next run don't count
        cut = np.flatnonzero(np.arange(len(held)) + k >= end)
        word[cut] &= np.uint64((0xFFFFFFFFFFFFFFFF << (8 * (8 - k))) & 0xFFFFFFFFFFFFFFFF)
    far = max(_FAR, 1 << (length - 1).bit_length())
    order = suffix_array(word, end, far)
    shared = common_prefixes(word, end, order, far)
    wanted = np.zeros(len(held), bool)
    wanted[np.searchsorted(held, start)] = True
    mine = np.flatnonzero(wanted[order])
    if not len(mine):
        return np.zeros(0, bool)
    least = np.minimum.reduceat(shared[: mine[-1] + 1], np.append(0, mine[:-1] + 1))
    group = np.flatnonzero(np.append(True, least[1:] < length))
    place = order[mine]
    age = place
    if (ids[1:] == ids[:-1]).any():  # texts of one id are of one age
        doc = np.searchsorted(bounds, held[place], "right") - 1
        at = held[place] - bounds[doc]
        by = np.lexsort((at, ids[doc]))
        new = (np.diff(ids[doc][by], prepend=0) != 0) | (np.diff(at[by], prepend=0) != 0)
        age = np.empty(len(place), np.int64)
        age[by] = np.cumsum(new)
    earliest = np.repeat(np.minimum.reduceat(age, group), np.diff(np.append(group, len(mine))))
    out = np.zeros(len(held), bool)
    out[place] = age != earliest
    return out[np.searchsorted(held, start)]


_PACK = "pack long, lot long, ids binary, tags binary, bounds binary, text binary"
_PART = "kind int, part int, sub int, pack long, size long, runs long, docs binary, tags binary, froms binary, tos binary, text binary"


def _packed(docs: DataFrame, pack_bytes: int) -> DataFrame:
    """(id, tag, text) -> a row per pack; texts of a pack are in order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            by = pa.compute.sort_indices(batch.column(0))
            ids, tags = (batch.column(k).take(by).to_numpy() for k in (0, 1))
            buf, bounds = utf8(batch.column(2).take(by))
            for lo, hi in chunks(bounds, pack_bytes):
                at = bounds[lo : hi + 1]
                task = TaskContext.get().partitionId() << 32
                row = [task + made, task + made // LOT_PACKS, ids[lo:hi].astype(np.int64).tobytes(), tags[lo:hi].astype(np.int64).tobytes(), (at - at[0]).astype(np.int64).tobytes(), buf[at[0] : at[-1]].tobytes()]
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["pack", "lot", "ids", "tags", "bounds", "text"])

    return docs.mapInArrow(run, _PACK)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["bounds"], np.int64), np.frombuffer(row["text"], np.uint8)


def _parts(h: np.ndarray, parts: int) -> np.ndarray:
    """The group of each hash; ascending with it."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """One at a time: packs are large."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _anchor_sets(packs: DataFrame, length: int, k: int, parts: int) -> DataFrame:
    """Per lot of packs and group the keys of the anchors, those of several windows apart twice.

    Half of a key is enough: keys that agree by chance only leave more windows to be compared.
    """

    def cut(lot: int, held: list[np.ndarray]) -> pa.RecordBatch:
        own, n = np.unique(np.concatenate(held), return_counts=True)
        own = np.repeat(own, np.minimum(n, 2))
        group = _parts(own, parts)
        at = np.flatnonzero(np.diff(group, prepend=-1))
        return pa.RecordBatch.from_arrays([pa.array(group[at].astype(np.int32)), pa.array([lot] * len(at), pa.int64()), pa.array([x.tobytes() for x in np.split(own.astype(np.uint32), at[1:])], pa.binary())], ["part", "lot", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, held = None, []
        for batch in batches:
            for row in _rows(batch):
                if held and (row["lot"] != lot or sum(map(len, held)) > _LOT_HASHES):
                    yield cut(lot, held)
                    held = []
                lot, (_, bounds, buf) = row["lot"], _unpacked(row)
                _, place, h = anchors(buf, bounds, length, k)
                if len(place):
                    held.append(h[np.unique(place)])
        if held:
            yield cut(lot, held)

    return packs.mapInArrow(run, "part int, lot long, hashes binary")


def _again(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which of a group's hashes occur more than once, for each lot that has them."""
    own = [np.frombuffer(x, np.uint32) for x in pdf["hashes"]]
    key, n = np.unique(np.concatenate(own), return_counts=True)
    twice = key[n > 1]
    out = [(p, x) for p, x in zip(pdf["lot"], (o[np.isin(o, twice)] for o in own), strict=True) if len(x)]
    return pd.DataFrame({"lot": [p for p, _ in out], "hashes": [np.unique(x).tobytes() for _, x in out]})


def _within(length: int, k: int, parts: int):
    """Of packs with the anchors that occur again: the windows that repeat within, and what is left by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                ids, bounds, buf = _unpacked(row)
                tags = np.frombuffer(row["tags"], np.int64)
                again = np.sort(np.frombuffer(b"".join(row["again"]), np.uint32))
                start, place, h = anchors(buf, bounds, length, k)
                own = h[place]
                half = own.astype(np.uint32)
                keep = again[np.minimum(np.searchsorted(again, half), len(again) - 1)] == half
                start, place, own = start[keep], place[keep], own[keep]
                if not len(start):
                    continue
                gone = shard_repeats(buf, bounds, start, length, ids)
                doc = np.searchsorted(bounds, start, "right") - 1
                out = []
                lo, hi = _runs(doc[gone], start[gone])
                d, s = doc[gone], start[gone]
                if len(lo):
                    out.append((0, 0, ids[d[lo]], tags[d[lo]], s[lo] - bounds[d[lo]], s[hi] - bounds[d[lo]] + length, b"", 0))
                d, s, p, x = doc[~gone], start[~gone], place[~gone], own[~gone]
                if len(s):
                    lo, hi = _runs(d, s, p)
                    by = np.argsort(x[lo], kind="stable")
                    lo, hi = lo[by], hi[by]
                    group = _parts(x[lo], parts)
                    for part in np.split(np.arange(len(lo)), np.flatnonzero(np.diff(group)) + 1):
                        a, b = lo[part], hi[part]
                        size = s[b] - s[a] + length
                        spot = np.arange(size.sum()) + np.repeat(s[a] - (np.cumsum(size) - size), size)
                        out.append((1, int(group[part[0]]), ids[d[a]], tags[d[a]], s[a] - bounds[d[a]], s[b] - bounds[d[a]] + length, buf[spot].tobytes(), 0))
                yield _part_batch(out, row["pack"])
                pa.default_memory_pool().release_unused()

    return run


def _part_batch(rows: list[tuple], pack: int) -> pa.RecordBatch:
    column = lambda k: pa.array([np.asarray(r[k]).astype(np.int64).tobytes() for r in rows], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([sub for *_, sub in rows], pa.int32()), pa.array([pack] * len(rows), pa.int64()), pa.array([len(r[6]) for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), column(2), column(3), column(4), column(5), pa.array([r[6] for r in rows], pa.binary())],
        ["kind", "part", "sub", "pack", "size", "runs", "docs", "tags", "froms", "tos", "text"],
    )


def _singles(length: int):
    """Of a heavy group's rows: each window on its own, in the one of the group's `subs` parts that a hash of its bytes says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                doc, tag, lo, hi = (np.frombuffer(row[c], np.int64) for c in ("docs", "tags", "froms", "tos"))
                buf, size = np.frombuffer(row["text"], np.uint8), hi - lo
                base, until = np.cumsum(size) - size, np.cumsum(size - length + 1)
                for at in range(0, until[-1], _SINGLES):
                    own = np.arange(at, min(at + _SINGLES, until[-1]))
                    r = np.searchsorted(until, own, "right")
                    inner = own - (until[r] - (size[r] - length + 1))
                    spot, first = base[r] + inner, base[r[0]]
                    key = span_hashes(buf[first : base[r[-1]] + size[r[-1]]], length)[spot - first]
                    sub = _parts(mix(key + _ODD), row["subs"])
                    by = np.argsort(sub, kind="stable")
                    out = []
                    for x in np.split(by, np.flatnonzero(np.diff(sub[by])) + 1):
                        text = buf[(spot[x][:, None] + np.arange(length)).ravel()].tobytes()
                        out.append((1, row["part"], doc[r[x]], tag[r[x]], lo[r[x]] + inner[x], lo[r[x]] + inner[x] + length, text, int(sub[x[0]])))
                    yield _part_batch(out, row["pack"])

    return run


def _dealt(found: DataFrame, length: int, heavy_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows that go to the merge, and intervals that are settled on the way.

    A group above `heavy_bytes`, as one very frequent anchor makes it, is dealt out by window, so that no task holds it
    whole. Equal windows stay together then; where these alone are over `heavy_bytes` (one passage of very many packs),
    packs are merged in lots first, as a tree: of equal windows of a lot only the earliest goes on.
    """
    sizes = found.groupBy("part").agg(F.sum("size").alias("size"), F.sum("runs").alias("runs")).filter(F.col("size") > heavy_bytes)
    subs = F.ceil((F.col("size") - F.col("runs") * (length - 1)) * length / (heavy_bytes / 2)).cast("int")
    heavy = stored(sizes.select("part", subs.alias("subs")), "suffix-heavy")
    if heavy.isEmpty():
        return found, []
    heavy = small(heavy)
    light, done = found.join(heavy, "part", "left_anti").select(*found.columns), []
    dealt = stored(found.join(heavy, "part").mapInArrow(_singles(length), _PART), "suffix-dealt")
    before = None
    while True:
        hot = stored(dealt.groupBy("part", "sub").agg(F.sum("size").alias("total")).filter(F.col("total") > 2 * heavy_bytes), "suffix-hot")
        total = hot.agg(F.sum("total")).first()[0]
        if total is None or before is not None and total >= before:
            return light.unionByName(dealt), done
        before, hot = total, small(hot.withColumn("lots", F.ceil(F.col("total") / heavy_bytes).cast("int")))
        lot = F.pmod(F.xxhash64("pack", "docs", "froms"), "lots")
        merged = dealt.join(hot, ["part", "sub"]).withColumn("lot", lot).select("lot", *dealt.columns)
        merged = stored(merged.groupBy("part", "sub", "lot").applyInPandas(_survivors(length), _PART), "suffix-merged")
        done.append(merged.filter("kind = 0"))
        dealt = dealt.join(hot, ["part", "sub"], "left_anti").select(*dealt.columns).unionByName(merged.filter("kind = 1"))


def _merged(pdf: pd.DataFrame, length: int) -> tuple[np.ndarray, ...]:
    """Merges what packs have left of one group's windows: sorted keys, each pack's places in them by binary search, and bytes compared. Per window its document, tag, place, spot in the text and whether an equal one is earlier; and the text."""
    doc = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["docs"]])
    tag = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["tags"]])
    lo = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["froms"]])
    size = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["tos"]]) - lo
    pack = np.repeat(np.arange(len(pdf)), [len(x) // 8 for x in pdf["docs"]])
    buf = np.frombuffer(b"".join(pdf["text"]), np.uint8)
    base, n = np.cumsum(size) - size, size - length + 1
    until = np.cumsum(n)
    key, end, i = np.empty(until[-1], np.uint64), base + size, 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(end, base[i] + 4 * _PIECE, "right")))
        hashes = span_hashes(buf[base[i] : end[j - 1]], length)
        for k in range(i, j):
            key[until[k] - n[k] : until[k]] = hashes[base[k] - base[i] : base[k] - base[i] + n[k]]
        i = j
    blocks, found = -(-len(key) // _BLOCK), []
    for block in range(blocks):  # equal keys are of one block
        own = np.flatnonzero((key % np.uint64(blocks)) == block) if blocks > 1 else np.arange(len(key))
        r = np.searchsorted(until, own, "right")
        inner = own - (until[r] - n[r])
        later = np.zeros(len(own), bool)
        later[_later(key[own], base[r] + inner, doc[r], lo[r] + inner, pack[r], buf, length)] = True
        found.append((r, inner, later))
    r, inner, later = (np.concatenate([f[k] for f in found]) for k in (0, 1, 2))
    return doc[r], tag[r], lo[r] + inner, base[r] + inner, later, buf


def _intervals_of(d: np.ndarray, t: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    by = np.lexsort((at, t, d))
    d, t, at = d[by], t[by], at[by]
    a, b = _runs(d, at, t)
    return d[a], t[a], at[a], at[b] + length


def _between(length: int):
    """The intervals of a group's windows to which an equal one is earlier."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d, t, at, _, later, _ = _merged(pdf, length)
        return pd.DataFrame(dict(zip(("id", "tag", "lo", "hi"), _intervals_of(d[later], t[later], at[later], length), strict=True)))

    return run


def _survivors(length: int):
    """Of a lot of a hot group: its intervals (kind 0), and of equal windows the earliest (kind 1)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d, t, at, spot, later, buf = _merged(pdf, length)
        out = []
        if later.any():
            gone = _intervals_of(d[later], t[later], at[later], length)
            out.append((0, *gone, b""))
        d, t, at, spot = d[~later], t[~later], at[~later], spot[~later]
        out.append((1, d, t, at, at + length, buf[(spot[:, None] + np.arange(length)).ravel()].tobytes()))
        pack, part, sub = int(pdf["pack"].min()), int(pdf["part"].iloc[0]), int(pdf["sub"].iloc[0])
        rows = [(kind, part, sub, pack, len(text), len(a), *(np.asarray(x).astype(np.int64).tobytes() for x in (a, b, c, e)), text) for kind, a, b, c, e, text in out]
        return pd.DataFrame(rows, columns=["kind", "part", "sub", "pack", "size", "runs", "docs", "tags", "froms", "tos", "text"])

    return run


def _later(key: np.ndarray, spot: np.ndarray, doc: np.ndarray, at: np.ndarray, pack: np.ndarray, buf: np.ndarray, length: int) -> np.ndarray:
    """Which windows equal one of an earlier document or place. Texts of one id are of one age: those at the same place aren't earlier."""
    merged = np.unique(key)
    age = np.empty(len(key), np.int64)
    age[np.lexsort((at, doc))] = np.arange(len(key))
    where = np.empty(len(key), np.int64)
    for run in np.split(np.arange(len(key)), np.flatnonzero(np.diff(pack)) + 1):
        by = run[np.argsort(key[run])]
        where[by] = np.searchsorted(merged, key[by])
    first = np.full(len(merged), len(key))
    np.minimum.at(first, where, age)
    by_age = np.empty(len(key), np.int64)
    by_age[age] = np.arange(len(key))
    twin = by_age[first[where]]
    later = np.flatnonzero((doc[twin] != doc) | (at[twin] != at))
    for k in range(length):
        later = later[buf[spot[later] + k] == buf[spot[twin[later]] + k]]
    return later


def _intervals(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[c], np.int64)) for c in ("docs", "tags", "froms", "tos")], ["id", "tag", "lo", "hi"])

    return found.select("docs", "tags", "froms", "tos").mapInArrow(run, "id long, tag long, lo long, hi long")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
        out = []
        for k in range(batch.num_rows):
            data = (batch.column(1)[k].as_py() or "").encode("utf-8")
            spans = sorted((x["lo"], x["hi"]) for x in batch.column(2)[k].as_py() or ())
            kept, at, runs = [], 0, 0
            for lo, hi in spans:
                if lo > at or not runs:
                    kept.append(data[at:lo])
                    runs += 1
                    at = hi
                else:
                    at = max(at, hi)
            kept = b"".join([*kept, data[at:]])
            out.append((len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in out], pa.int64() if j < 3 else pa.string()) for j in range(5))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def removed(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = ANCHOR, pack_bytes: int = PACK_BYTES, heavy_bytes: int = HEAVY_BYTES) -> DataFrame:
    """Per document: its id, n_bytes, n_removed, n_spans, kept_sha256 and kept (what is left of the text; bytes that no longer form a character show as U+FFFD).

    Each byte goes that is covered by a string of `length` bytes (of the UTF-8 text; null is empty) which also begins
    earlier: in a document of smaller id, or before in the same one. Strings are those of the input. Matches are
    exact: windows meet by hash, but count only if their bytes are equal. Texts that equal an earlier document's whole
    text (by SHA-256) go at once, if they have `length` bytes. Rows without an id are never removed from and never
    earlier. Rows of one id are one document, with strings at equal places of equal age: an exactly repeated row loses
    nothing by the other (it is packed once), and of different texts of an id each loses what begins at a smaller place
    in another. Other columns are left out, whatever their names; an empty table gives none. length must be k (the bytes
    of an anchor) or more.
    """
    if not 8 <= k <= length:
        raise ValueError("k must be 8 or more, and length k or more")
    docs = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))
    keys = stored(docs.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes")), "suffix-keys")
    first = keys.filter(F.col("id").isNotNull() & (F.col("n_bytes") >= length)).groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("k"))
    first = stored(first.filter("k > 1"), "suffix-first")
    # of the rows of one text: those of larger ids, and the smallest id if it repeats
    alike = hot_join(keys, first.withColumnRenamed("k", "alike"), ["key"], "alike", "inner").groupBy("id", "key").agg(F.any_value(F.col("id") > F.col("first")).alias("copy"), F.count(F.lit(1)).alias("k"))
    alike = stored(alike.filter("copy or k > 1"), "suffix-copies")
    copies, repeats = small(alike.filter("copy").select("id", "key")), alike.filter("not copy").select("id", "key")
    tag = F.conv(F.substring(F.hex("key"), 1, 15), 16, 10).cast("long")  # tells texts of one id apart
    rest = docs.join(copies, ["id", "key"], "left_anti").select("id", tag.alias("tag"), "text", "key")
    once = rest.filter("id is not null")
    if not repeats.isEmpty():
        repeats = small(repeats)
        once = once.join(repeats, ["id", "key"], "left_anti").select(rest.columns).unionByName(once.join(repeats, ["id", "key"], "left_semi").dropDuplicates(["id", "key"]))
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(1, int(total // GROUP_BYTES))

    packs = stored(_packed(once.select("id", "tag", "text"), pack_bytes), "suffix-packs")
    sets = _anchor_sets(packs, length, k, parts)
    again = sets.groupBy("part").applyInPandas(_again, "lot long, hashes binary").groupBy("lot").agg(F.collect_list("hashes").alias("again"))
    found = stored(packs.join(again.hint("merge"), "lot").mapInArrow(_within(length, k, parts), _PART), "suffix-found")
    dealt, done = _dealt(found.filter("kind = 1"), length, heavy_bytes)
    spans = dealt.groupBy("part", "sub").applyInPandas(_between(length), "id long, tag long, lo long, hi long")
    for settled in (found.filter("kind = 0"), *done):
        spans = spans.union(_intervals(settled))
    spans = stored(spans.groupBy("id", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "suffix-spans")
    cut = rest.join(spans.hint("merge"), ["id", "tag"], "left").select("id", "text", "spans").mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    whole = keys.join(copies, ["id", "key"], "left_semi")
    whole = whole.select("id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit("").alias("kept"))
    return cut.unionByName(whole).withColumnRenamed("id", id)
