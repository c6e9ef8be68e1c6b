"""Search of unit vectors: exact in blocks (K6), and over stored cells with product-quantised residuals (K7)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.scratch import scratch_path, small, stored

#: Queries of a block, which alone pass the driver and go to every task; distances that a task works out at once.
BLOCK_QUERIES, BLOCK_CELLS = 2048, 4 << 20
#: Cells at most (their number is about the root of the rows), and rows of the sample that centres and codebooks are fitted on.
MOST_CELLS, SAMPLE_ROWS = 4096, 20_000
#: Parts that a residual is cut into, and codewords of each (a byte names one).
PARTS, WORDS = 16, 64
#: Of each ten neighbours that are asked for, so many candidates by codes are ranked again exactly.
DEPTH = 8


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of d numbers; those of null or of another length are NaN."""
    out = np.full((len(column), d), np.nan)
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    good = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (lengths == d))
    if len(good) == len(column):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    if len(good):
        out[good] = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return out


def _blocks(queries: DataFrame, size: int):
    """(query_id as Arrow, matrix) of each block of queries. A block is what a pass over the rows answers."""
    n = max(1, -(-queries.count() // size))
    for k in range(n):
        part = queries if n == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k)
        held = part.select("query_id", "q").toArrow().combine_chunks()
        column = held.column("q").chunk(0) if held.num_rows else pa.array([], pa.list_(pa.float64()))
        d = max((len(v) for v in column.to_pylist() if v is not None), default=0)
        yield held.column("query_id").combine_chunks(), _matrix(column, d), d


def _best(table: pa.Table, limit: int) -> pa.Table:
    """The first `limit` rows of each query, by distance and then id."""
    table = table.sort_by([("query", "ascending"), ("distance", "ascending"), ("id", "ascending")])
    q = table.column("query").to_numpy()
    new = np.append(True, q[1:] != q[:-1]) if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - (np.flatnonzero(new)[np.cumsum(new) - 1] if len(q) else 0)
    return table.filter(pa.array(rank < limit))


class _Heap:
    """What a task has found: the first `limit` rows of each query so far."""

    def __init__(self, limit: int):
        self.limit, self.held = limit, None

    def add(self, who: np.ndarray, distance: np.ndarray, ids: pa.Array) -> None:
        """distance: queries by rows (infinite: last, undefined); who: the queries' numbers."""
        k = min(self.limit, distance.shape[1]) - 1
        if k < 0 or len(who) == 0:
            return
        q, r = np.nonzero(distance <= np.partition(distance, k, axis=1)[:, k : k + 1])
        new = _best(pa.table({"query": pa.array(who[q].astype(np.int32)), "distance": pa.array(distance[q, r]), "id": ids.take(pa.array(r))}), self.limit)
        self.held = new if self.held is None else _best(pa.concat_tables([self.held, new]).combine_chunks(), self.limit)


def _ranked(found: DataFrame, id: str, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), id)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", id, "rank", "distance")


def nearest(rows: DataFrame, queries: DataFrame, id: str, limit: int, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, id, rank, distance of the first `limit` rows of each query by 1 - inner product (nine decimals), ties by id.

    rows: id, u; queries: query_id, q; unit vectors of doubles. Where one of the two is null, or the lengths differ, the
    distance is null and last. Each task holds blocks of rows against a block of queries as matrices and keeps `limit`
    rows a query; only these are shuffled. Queries are a stated set, asked in blocks of `block`; each goes over the rows once.
    """
    kind, query_kind = rows.schema[id].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    out = None
    for names, q, d in _blocks(queries, block):

        def run(batches: Iterator[pa.RecordBatch], names=names, q=q, d=d) -> Iterator[pa.RecordBatch]:
            heap, every = _Heap(limit), np.arange(len(q))
            step = max(1, BLOCK_CELLS // max(1, len(q)))
            for b in batches:
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    away = np.round(1 - q @ _matrix(part.column(1), d).T, 9)
                    heap.add(every, np.where(np.isnan(away), np.inf, away), part.column(0))
            if heap.held is not None:
                away = heap.held.column("distance").to_numpy()
                yield from pa.table({"query_id": names.take(heap.held.column("query").combine_chunks()), id: heap.held.column("id"), "distance": pa.array(away, mask=np.isinf(away))}).to_batches()

        found = _ranked(rows.select(id, "u").mapInArrow(run, f"query_id {query_kind}, {id} {kind}, distance double"), id, limit)
        out = found if out is None else out.unionByName(found)
    return out


# ---------------------------------------------------------------- cells


@dataclass
class Cells:
    """A stored index: rows (id, u, code) in folders by cell; centres of cells; codewords by part."""

    path: str
    id: str
    kind: str
    centers: np.ndarray
    words: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.id} {self.kind}, u array<double>, code binary, cell int").parquet(self.path)


def _lloyd(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centres of a sample, from rows that are spread over it."""
    centers = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        side = _square_distances(x, centers).argmin(axis=1)
        total = np.zeros_like(centers)
        np.add.at(total, side, x)
        n = np.bincount(side, minlength=k)
        centers[n > 0] = total[n > 0] / n[n > 0][:, None]
    return centers


def _square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T


def _parts(x: np.ndarray, parts: int) -> np.ndarray:
    """rows by parts by numbers, filled up with zeros."""
    wide = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, wide * parts - x.shape[1]))).reshape(len(x), parts, wide)


def build(rows: DataFrame, id: str, k: int | None = None, sample_rows: int = SAMPLE_ROWS, parts: int = PARTS, words: int = WORDS, seed: int = 1) -> Cells | None:
    """The index of rows (id, u: unit vectors), written once to the shared folder; None if no row has a vector.

    Centres and codewords are fitted on a sample of about sample_rows rows, every row is indexed. k: the number of
    cells, by default about the root of the rows, MOST_CELLS at most. Rows without a vector, or of another length than
    the centres, are left out. Rows are dealt by cell and a hash, so a cell with very many is written as several files.
    """
    spark = rows.sparkSession
    rows = stored(rows.select(id, "u").filter("u is not null and size(u) > 0"), "cells-rows")
    total = rows.count()
    if total == 0:
        return None
    k = max(1, min(k or round(math.sqrt(total)), MOST_CELLS, total))
    some = stored(rows.select("u").sample(min(1.0, sample_rows / total), seed=seed) if total > sample_rows else rows.select("u"), "cells-sample")
    d = some.groupBy(F.size("u").alias("d")).count().orderBy(F.desc("count"), "d").first()["d"]
    some = some.filter(F.size("u") == d)
    fitted = KMeans(k=k, seed=seed, maxIter=10).fit(some.select(array_to_vector("u").alias("features")))
    centers = np.array([c.tolist() for c in fitted.clusterCenters()])
    held = np.array(some.limit(sample_rows).toPandas()["u"].tolist(), np.float64)
    left = _parts(held - centers[_square_distances(held, centers).argmin(axis=1)], parts)
    books = np.stack([_lloyd(left[:, m], min(words, len(left))) for m in range(parts)])
    kind = rows.schema[id].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _matrix(b.column(1), d)
            good = np.flatnonzero(~np.isnan(u).any(axis=1))
            u = u[good]
            cell = _square_distances(u, centers).argmin(axis=1)
            rest = _parts(u - centers[cell], parts)
            code = np.stack([_square_distances(rest[:, m], books[m]).argmin(axis=1) for m in range(parts)], axis=1).astype(np.uint8)
            part = b.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(cell.astype(np.int32))], names=[id, "u", "code", "cell"])

    path = scratch_path(spark, "cells")
    placed = rows.mapInArrow(place, f"{id} {kind}, u array<double>, code binary, cell int")
    placed.repartitionByRange("cell", F.xxhash64(id)).sortWithinPartitions("cell").write.partitionBy("cell").parquet(path)
    return Cells(path, id, kind, centers, books)


def within(index: Cells, queries: DataFrame, limit: int, probes: int, depth: int, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, id, rank, distance of the first `limit` rows among those of the `probes` cells whose centres are nearest.

    Tasks read codes alone, of the probed cells' folders alone, and keep the first `depth` rows a query by the codes'
    distance. Of these the vectors are read, and ranked by the exact distance.
    """
    spark = queries.sparkSession
    id, centers, books = index.id, index.centers, index.words
    query_kind, parts = queries.schema["query_id"].dataType.simpleString(), len(books)
    out = None
    for names, q, d in _blocks(queries, block):
        if d != centers.shape[1]:
            continue
        good = np.flatnonzero(~np.isnan(q).any(axis=1))
        names, q = names.take(pa.array(good)), q[good]
        away = _square_distances(q, centers)
        order = np.argsort(away, axis=1, kind="stable")[:, :probes]
        asking: dict[int, np.ndarray] = {int(c): np.flatnonzero((order == c).any(axis=1)) for c in np.unique(order)}

        def scan(batches: Iterator[pa.RecordBatch], names=names, q=q, asking=asking) -> Iterator[pa.RecordBatch]:
            heap = _Heap(depth)
            for b in batches:
                cell = b.column(2).to_numpy()
                cuts = np.flatnonzero(np.diff(cell)) + 1
                for a, z in zip(np.append(0, cuts), np.append(cuts, len(cell)), strict=True):
                    who = asking[int(cell[a])]
                    shift = _parts(q[who] - centers[cell[a]], parts)
                    table = [_square_distances(shift[:, m], books[m]) for m in range(parts)]
                    step = max(1, BLOCK_CELLS // max(1, len(who)))
                    for at in range(int(a), int(z), step):
                        part = b.slice(at, min(step, int(z) - at))
                        code = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, parts)
                        heap.add(who, sum(table[m][:, code[:, m]] for m in range(parts)), part.column(0))
            if heap.held is not None:
                held = heap.held
                yield from pa.table({"query_id": names.take(held.column("query").combine_chunks()), id: held.column("id"), "distance": held.column("distance")}).to_batches()

        pruned = index.rows(spark).filter(F.col("cell").isin([int(c) for c in asking]))
        close = _ranked(pruned.select(id, "code", "cell").mapInArrow(scan, f"query_id {query_kind}, {id} {index.kind}, distance double"), id, depth).select("query_id", id)
        vectors = pruned.select(id, "u").join(small(stored(close, "cells-close")), id)
        dot = F.aggregate(F.zip_with("u", "q", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        exact = vectors.join(small(queries), "query_id").select("query_id", id, F.round(1 - dot, 9).alias("distance"))
        found = _ranked(exact, id, limit)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"query_id {query_kind}, {id} {index.kind}, rank int, distance double")


def recalled(index: Cells, rows: DataFrame, sample: DataFrame, limit: int, target: float, probes: int | None = None) -> tuple[int, int, DataFrame]:
    """probes, depth and (query_id, recall) of a sample of queries, which are searched exactly once: from few probes on, both are doubled until the mean recall is `target`, or all cells and rows are taken."""
    true = stored(nearest(rows, sample, index.id, limit), "cells-true")
    k, total = len(index.centers), rows.count()
    probes, depth = min(k, probes or max(1, k // 8)), limit * DEPTH
    while True:
        found = within(index, sample, limit, probes, depth)
        hits = true.select("query_id", index.id).join(found.select("query_id", index.id, F.lit(1).alias("hit")), ["query_id", index.id], "left")
        each = stored(hits.groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall")), "cells-recall")
        if (each.agg(F.avg("recall").alias("r")).first()["r"] or 1.0) >= target or (probes == k and depth >= total):
            return probes, depth, each
        probes, depth = min(k, 2 * probes), 2 * depth if probes >= k // 2 or depth <= 2 * limit * DEPTH else depth
