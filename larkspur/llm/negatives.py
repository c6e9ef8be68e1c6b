"""Hard negatives of anchors from an exact search in a GNAT-style tree of split points with distance ranges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm._shared import hot_join, stored
from larkspur.llm.whitening import fixed_point, of_one_length

#: Fixed-point scale of components; components above MOST in size count as not finite (scores then fit 64 bits up to 2^11 dimensions).
SCALE, MOST = 256, float(1 << 25)
#: Split points of a node, rows that a leaf should have, and levels at most (FANOUT ** LEVELS leaves bound the tree's size).
FANOUT, LEAF_ROWS, LEVELS = 8, 256, 4
#: Rows of the sample that split points are chosen from, and those of it that a node looks at.
SAMPLE, CANDIDATES = 16_384, 512
#: Different anchors that one pass over the leaves answers, rows of a leaf that are scored at once.
QUERIES, CHUNK = 4096, 4096
#: A relative allowance for rounding wherever distances are compared.
SLACK = 1e-9


@dataclass
class Tree:
    """Nodes of split points. below[node][j]: the node below split point j, or -1 - leaf. low, high[node][i, j]: the least and greatest distance from split point i to a row below j; least, most[node][j]: squared lengths of the rows below j."""

    points: list[np.ndarray] = field(default_factory=list)
    below: list[list[int]] = field(default_factory=list)
    leaves: int = 0
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    least: list[np.ndarray] = field(default_factory=list)
    most: list[np.ndarray] = field(default_factory=list)

    def paths(self) -> dict[int, list[tuple[int, int]]]:
        """Of each leaf the (node, split point) on the way to it."""
        out: dict[int, list[tuple[int, int]]] = {}
        todo: list[tuple[int, list[tuple[int, int]]]] = [(0, [])]
        while todo:
            node, way = todo.pop()
            for j, to in enumerate(self.below[node] if self.points else [-1]):
                here = [*way, (node, j)] if self.points else []
                if to < 0:
                    out[-1 - to] = here
                else:
                    todo.append((to, here))
        return out

    def open_to(self, way: list[tuple[int, int]], x: np.ndarray, low: np.ndarray, high: np.ndarray, far: dict[int, np.ndarray]) -> np.ndarray:
        """Of which queries x a row below the way could score from low to high, by what the ranges allow. far: distances to the split points of nodes, kept from leaf to leaf."""
        ok, square = np.ones(len(x), bool), (x * x).sum(axis=1)
        for node in set(far) - {n for n, _ in way}:
            del far[node]
        for node, j in way:
            if node not in far:
                far[node] = distances(x, self.points[node])
            q = far[node]
            nearest = np.maximum(0.0, np.maximum(q - self.high[node][:, j], self.low[node][:, j] - q).max(axis=1)) * (1 - SLACK)
            farthest = (q + self.high[node][:, j]).min(axis=1) * (1 + SLACK)
            # 2 * score = |q|^2 + |x|^2 - distance^2: scores of rows whose distance is in the annulus and whose length is in its range
            most = (square + self.most[node][j]) * (1 + SLACK) - nearest**2
            least = (square + self.least[node][j]) * (1 - SLACK) - farthest**2
            ok &= (most >= 2 * low - 1) & (least <= 2 * high + 1)
        return ok

    def descend(self, x: np.ndarray, seen=None) -> np.ndarray:
        """The leaf of each row: at each node the side of the nearest split point (the first of equally near ones). seen(node, distances, side, rows) is told of each step."""
        leaf = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))] if self.points else []
        while todo:
            node, rows = todo.pop()
            far = distances(x[rows], self.points[node])
            side = far.argmin(axis=1)
            if seen:
                seen(node, far, side, rows)
            for j, to in enumerate(self.below[node]):
                part = rows[side == j]
                if to < 0:
                    leaf[part] = -1 - to
                elif len(part):
                    todo.append((to, part))
        return leaf


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances, from integers that stand in doubles."""
    square = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2.0 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0.0))


def grown(sample: np.ndarray, rows: int) -> Tree:
    """A tree for so many rows: each node's split points are chosen from its part of the sample, each as far as can be from those before; equal rows make no second point."""
    tree, levels = Tree(), 0
    while FANOUT**levels * LEAF_ROWS < rows and levels < LEVELS:
        levels += 1

    def node(part: np.ndarray, left: int) -> int:
        some = part[:CANDIDATES]
        nearest = np.full(len(some), np.inf)
        chosen, at = [], 0
        while len(chosen) < FANOUT and nearest[at] > 0:
            chosen.append(at)
            nearest = np.minimum(nearest, distances(some, some[at : at + 1])[:, 0])
            at = int(nearest.argmax())
        if left == 0 or len(chosen) < 2:
            tree.leaves += 1
            return -tree.leaves
        me = len(tree.points)
        tree.points.append(some[chosen])
        tree.below.append([])
        side = distances(part, some[chosen]).argmin(axis=1)
        tree.below[me] = [node(part[side == j], left - 1) for j in range(len(chosen))]
        return me

    if len(sample) == 0 or node(sample, levels) < 0:
        return Tree(leaves=1)
    return tree


def _doubles(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


class Index:
    """Rows (x, label, their six smallest ids) in the leaves of a tree, stored by leaf; `keep` is the number of ids."""

    def __init__(self, rows: DataFrame, d: int, keep: int):
        """rows: vec_id, label, x. Equal vectors of one label are one entry with their `keep` smallest different ids: more can't be among the first `keep` of any search, as they tie."""
        first = Window.partitionBy("x", "label").orderBy("vec_id")
        few = rows.select("x", "label", "vec_id").distinct().withColumn("at", F.row_number().over(first)).filter(F.col("at") <= keep)  # cut before the shuffle, too
        entries = stored(few.groupBy("x", "label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "negatives-entries")
        self.d, self.keep = d, keep
        sample = entries.select("x").orderBy(F.xxhash64("x"), "x").limit(SAMPLE).toPandas()["x"]
        tree = self.tree = grown(np.array(sample.tolist(), np.float64).reshape(-1, d), entries.count())

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(tree.descend(_doubles(b.column(0), d))), *b.columns], names=["leaf", "x", "label", "ids"])

        kinds = {f.name: f.dataType.simpleString() for f in entries.schema}
        placed = entries.mapInArrow(place, f"leaf int, x {kinds['x']}, label {kinds['label']}, ids {kinds['ids']}")
        self.rows = stored(placed.repartitionByRange("leaf", F.xxhash64("x")).sortWithinPartitions("leaf"), "negatives-leaves")
        self._measure()

    def _measure(self) -> None:
        """The ranges of distances from each split point to the rows below each of its node; a few numbers a split point, whatever the number of rows."""
        tree, d = self.tree, self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low: dict[tuple[int, int, int], float] = {}
            high: dict[tuple[int, int, int], float] = {}

            def note(key: tuple[int, int, int], a: float, b: float) -> None:
                low[key], high[key] = min(a, low.get(key, a)), max(b, high.get(key, b))

            for b in batches:
                x = _doubles(b.column(0), d)
                square = (x * x).sum(axis=1)

                def seen(node: int, far: np.ndarray, side: np.ndarray, rows: np.ndarray) -> None:
                    for j in np.unique(side).tolist():
                        part, own = far[side == j], square[rows[side == j]]
                        for i, (a, c) in enumerate(zip(part.min(axis=0).tolist(), part.max(axis=0).tolist(), strict=True)):
                            note((node, i, j), a, c)
                        note((node, -1, j), float(own.min()), float(own.max()))

                tree.descend(x, seen)
            if low:
                keys = np.array(list(low), np.int32)
                yield pa.RecordBatch.from_arrays([*(pa.array(keys[:, c]) for c in range(3)), pa.array(list(low.values())), pa.array([high[k] for k in low])], names=["node", "i", "j", "low", "high"])

        found = self.rows.select("x").mapInArrow(run, "node int, i int, j int, low double, high double").groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")) if tree.points else None
        for p in tree.points:
            k = len(p)
            tree.low.append(np.full((k, k), np.inf))
            tree.high.append(np.full((k, k), -np.inf))
            tree.least.append(np.full(k, np.inf))
            tree.most.append(np.full(k, -np.inf))
        for r in found.collect() if found is not None else []:
            at = tree.least, tree.most
            if r["i"] >= 0:
                tree.low[r["node"]][r["i"], r["j"]], tree.high[r["node"]][r["i"], r["j"]] = r["low"], r["high"]
            else:
                at[0][r["node"]][r["j"]], at[1][r["node"]][r["j"]] = r["low"], r["high"]

    def search(self, x: np.ndarray, label: np.ndarray, same: bool, first: int, low: np.ndarray, high: np.ndarray) -> DataFrame:
        """(query, score, id) of the first `first` rows of each query with low <= score <= high, of its own label or of others; higher scores first, ties by smaller id. Queries: the rows of x, of which a call gets a bounded number.

        Two passes over the leaves: each query first looks into the leaf where it would stand itself, and what it finds
        narrows its window; then into all leaves that the ranges can't rule out. Exact.
        """
        home = self.tree.descend(x)
        near = _firsts(self._pass(x, label, same, first, low, high, home), first)
        held = np.full(len(x), -1)
        worst = low.copy()
        for r in near.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("worst")).collect():  # a row per query of the block
            held[r["query"]] = r["n"]
            if r["n"] >= first:
                worst[r["query"]] = max(worst[r["query"]], r["worst"])
        return _firsts(self._pass(x, label, same, first, worst, high, None), first)

    def _pass(self, x, label, same, first, low, high, home) -> DataFrame:
        tree, d, keep = self.tree, self.d, self.keep
        paths = tree.paths()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bound = low.astype(np.float64).copy()
            got = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            far: dict[int, np.ndarray] = {}

            def asking(leaf: int) -> np.ndarray:
                """The queries that the ranges on the way to the leaf don't rule out."""
                if home is not None:
                    return np.flatnonzero(home == leaf)
                return np.flatnonzero(tree.open_to(paths[leaf], x, bound, high, far))

            for b in batches:
                leaf_of = b.column(0).to_numpy()
                cuts = np.flatnonzero(np.diff(leaf_of)) + 1
                for a, z in zip(np.append(0, cuts), np.append(cuts, len(leaf_of)), strict=True):
                    for at in range(int(a), int(z), CHUNK):
                        part = b.slice(at, min(CHUNK, int(z) - at))
                        who = asking(int(leaf_of[at]))
                        if len(who) == 0:
                            continue
                        ids = part.column(3)
                        begin = ids.offsets.to_numpy()
                        begin, ids = begin - begin[0], ids.flatten().to_numpy()
                        rows = _doubles(part.column(1), d)
                        score = _products(x[who], rows)
                        match = (part.column(2).to_numpy()[None, :] == label[who][:, None]) == same
                        score = np.where(match & (score >= bound[who][:, None]) & (score <= high[who][:, None]), score, np.iinfo(np.int64).min)
                        if score.shape[1] > first:
                            kth = np.partition(score, score.shape[1] - first, axis=1)[:, score.shape[1] - first]
                            score = np.where(score >= kth[:, None], score, np.iinfo(np.int64).min)
                        q, e = np.nonzero(score > np.iinfo(np.int64).min)
                        if len(q) == 0:
                            continue
                        entry = _cut(q, score[q, e], ids[begin[e]], first, e)
                        q, s, e = who[entry[0]], entry[1], entry[3]
                        times = (begin[e + 1] - begin[e]).astype(np.int64)
                        flat = np.repeat(begin[e], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        got = _cut(np.append(got[0], np.repeat(q, times)), np.append(got[1], np.repeat(s, times)), np.append(got[2], ids[flat]), first)[:3]
                        full = np.flatnonzero(np.bincount(got[0], minlength=len(x)) >= first)
                        last = np.full(len(x), np.inf)
                        np.minimum.at(last, got[0], got[1].astype(np.float64))
                        bound[full] = np.maximum(bound[full], last[full])
            if len(got[0]):
                yield pa.RecordBatch.from_arrays([pa.array(got[0].astype(np.int32)), pa.array(got[1]), pa.array(got[2])], names=["query", "score", "id"])

        assert keep >= first
        return self.rows.mapInArrow(run, "query int, score long, id long")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integers that stand in doubles, as exact 64-bit integers."""
    if a.size == 0 or b.size == 0 or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _cut(q: np.ndarray, score: np.ndarray, ident: np.ndarray, first: int, more: np.ndarray | None = None):
    """The first `first` of each query, higher scores and then smaller ids first."""
    order = np.lexsort((ident, -score, q))
    q = q[order]
    new = np.append(True, q[1:] != q[:-1])
    rank = np.arange(len(q)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    order = order[rank < first]
    return q[rank < first], score[order], ident[order], None if more is None else more[order]


def _firsts(found: DataFrame, first: int) -> DataFrame:
    """Of what all tasks found, the first of each query; stored."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first), "negatives-found")


def hard_negatives(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), queries: int = QUERIES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of hard negatives (rank from 1).

    rows: vec_id, label, x (integers of one length); rows equal in all three are one row. Anchors are the rows where the
    column is_anchor holds. An anchor's positives are its first `positives` other rows of its label, by inner product
    with it, ties by smaller id. Of each, the first `negatives` rows of other labels are taken whose score is at least
    share[0] / share[1] of the positive's and at most the positive's; a negative positive score has none. An anchor
    whose label has no other row, or that has no negatives, gives no row.

    The search is exact: see Index. Equal anchors (vector and label) search once. Anchors are asked in blocks of
    `queries`, which alone pass the driver; each block goes over the leaves four times.
    """
    spark = rows.sparkSession
    rows = stored(rows.select("vec_id", "label", "x", F.coalesce(is_anchor, F.lit(False)).alias("anchor")), "negatives-rows")
    top = rows.agg(F.max(F.size("x")).alias("d")).first()
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if top["d"] is None:
        return spark.createDataFrame([], shape)
    index = Index(rows, top["d"], positives + 1)
    anchors = rows.filter("anchor").select("vec_id", "label", "x").distinct()
    asked = anchors.groupBy("x", "label").agg(F.count("*").alias("weight"))
    asked = stored(asked.withColumn("key", F.monotonically_increasing_id()), "negatives-asked")
    blocks = max(1, -(-asked.count() // queries))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("x", "label"), F.lit(blocks)))
    answers = None
    for k in range(blocks):
        one = _block(index, asked.filter(F.col("block") == k) if blocks > 1 else asked, positives, negatives, share)
        answers = one if answers is None else answers.unionByName(one)
    # a row per different anchor: its first positives (one more, as it may be among them itself), each with its negatives
    each = stored(asked.select("x", "label", "key", "weight").join(answers, "key"), "negatives-answers")
    met = hot_join(anchors, each.drop("key"), ["x", "label"], "weight", "inner")
    others = F.slice(F.filter("positives", lambda p: p["id"] != F.col("vec_id")), 1, positives)
    pairs = met.select(F.col("vec_id").alias("anchor_id"), F.explode(others).alias("p"))
    flat = pairs.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode("p.negatives").alias("rank", "n"))
    return flat.select("anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))


def _block(index: Index, asked: DataFrame, positives: int, negatives: int, share: tuple[int, int]) -> DataFrame:
    """key and positives (id, score, negatives (id, score)) of the block's anchors. The block has a bounded number of rows."""
    spark = asked.sparkSession
    held = asked.select("key", "label", "x").orderBy("key").toArrow()
    key, label = held.column("key").to_numpy(), held.column("label").to_numpy()
    x = np.array(held.column("x").to_pylist(), np.float64).reshape(-1, index.d)
    limit = np.iinfo(np.int64).max // 4
    found = index.search(x, label, True, positives + 1, np.full(len(x), -limit), np.full(len(x), limit)).toArrow().sort_by([("query", "ascending"), ("rank", "ascending")])
    q, score = found.column("query").to_numpy(), found.column("score").to_numpy()
    # a window per anchor and different positive score
    pair, place = np.unique(np.stack([q, score], axis=1), axis=0, return_inverse=True)
    place = place.ravel()
    bottom = -(-share[0] * pair[:, 1] // share[1])
    some = np.flatnonzero(bottom <= pair[:, 1])
    number = np.full(len(pair), -1)
    number[some] = np.arange(len(some))
    hard = index.search(x[pair[some, 0]], label[pair[some, 0]], False, negatives, bottom[some], pair[some, 1])
    hard = hard.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda n: F.struct(n["id"].alias("id"), n["score"].alias("score"))).alias("negatives"))
    link = pa.table({"key": key[q], "rank": found.column("rank"), "id": found.column("id"), "score": found.column("score"), "query": number[place].astype(np.int32)})
    each = spark.createDataFrame(link).join(hard, "query").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "negatives"))).alias("positives"))
    return stored(each, "negatives-block")


def prepared(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, x of the rows that take part: those with an id, a label and a vector of finite entries (within MOST) of the most frequent length. Entries become floor(SCALE * entry)."""
    x = fixed_point(F.col(f"`{embedding}`"), SCALE, MOST)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), x.alias("x")).filter("vec_id is not null and label is not null and x is not null")
    return of_one_length(rows, "x")[0]


SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(CAST(v AS DOUBLE) * 256)) AS x
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND len(a.x) = len(r.x) AND a IS DISTINCT FROM r
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), pairs AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT * FROM pairs WHERE rank <= 5
"""
