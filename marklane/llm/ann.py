"""Nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own codebook, so a cell
is a pair of centroids. For a query the cells are visited by rising summed
distance with a heap until enough entries are named; those entries are
reranked by the exact inner product on the original vectors. How many are
enough is measured on the table itself: some queries are compared with every
entry, and the budget is the one that finds RECALL of their true neighbours.

Largest inner products become smallest distances by one more component,
sqrt(M^2 - |x|^2) for entries and 0 for queries, so norms may differ.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: Rows that codebooks are fitted on at most, and centroids of a half at most.
SAMPLE, MOST_CENTROIDS = 20_000, 1024
#: Entries that one group of neighbouring cells holds, and queries that are compared with it at once.
GROUP, ASKED = 8192, 256
#: Queries that are compared with every entry to measure the budget, and the share of their true neighbours that it finds.
PROBES, RECALL = 256, 0.95
#: A cell counts in a budget for this many times the mean cell at most, so that a hot cell does not use it up.
HOT = 4


def usable(v: Column) -> Column:
    """True for vectors that are not null, not empty, not zero and hold only finite numbers."""
    d = F.transform(v, lambda x: x.cast("double"))
    ok = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & ok & F.exists(d, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from distinct sampled rows; an empty centroid keeps its place."""
    rng = np.random.default_rng(seed)
    rows = np.unique(x, axis=0)
    c = rows[rng.permutation(len(rows))[:k]]
    for _ in range(rounds):
        near = assign(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Codebooks of both halves and the number of entries of each cell."""

    def __init__(self, first: np.ndarray, second: np.ndarray, norm2: float, half: int) -> None:
        self.first, self.second, self.norm2, self.half = first, second, norm2, half
        self.counts = np.zeros((len(first), len(second)), np.int64)

    def places(self) -> np.ndarray:
        """The place from which on each cell's entries stand in the row of all cells, which keeps cells together that are near in both halves.

        Centroids of a half are ranked along their main direction, and cells follow the interleaved bits of both ranks.
        """
        a, b = (np.argsort(np.argsort(_along(c), kind="stable"), kind="stable") for c in (self.first, self.second))
        code = np.zeros(self.counts.shape, np.int64)
        for bit in range(max(len(a), len(b)).bit_length()):
            code |= (a[:, None] >> bit & 1) << (2 * bit + 1) | (b[None, :] >> bit & 1) << (2 * bit)
        order, counts = np.argsort(code.reshape(-1), kind="stable"), self.counts.reshape(-1)
        out = np.empty(len(counts), np.int64)
        out[order] = np.cumsum(counts[order]) - counts[order]
        return out

    def weights(self) -> np.ndarray:
        """What each cell counts in a budget: its entries, but for hot cells."""
        filled = max(1, int((self.counts > 0).sum()))
        return np.minimum(self.counts, HOT * -(-int(self.counts.sum()) // filled))

    def halves(self, x: np.ndarray, entry: bool) -> tuple[np.ndarray, np.ndarray]:
        extra = np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0)) if entry else np.zeros(len(x))
        return x[:, : self.half], np.hstack([x[:, self.half :], extra[:, None]])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x, True)
        return assign(a, self.first) * len(self.second) + assign(b, self.second)

    def visit(self, da: np.ndarray, db: np.ndarray, entries: int, weights: np.ndarray) -> list[int]:
        """Cells by rising da[i] + db[j] until their ``weights`` reach ``entries`` or no cell is left."""
        ia, ib = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        out, found = [], 0
        heap, seen = [(da[ia[0]] + db[ib[0]], 0, 0)], {(0, 0)}
        while heap and found < entries:
            _, i, j = heapq.heappop(heap)
            cell = (int(ia[i]), int(ib[j]))
            if n := int(weights[cell]):
                out.append(cell[0] * len(db) + cell[1])
                found += n
            for p in ((i + 1, j), (i, j + 1)):
                if p[0] < len(ia) and p[1] < len(ib) and p not in seen:
                    seen.add(p)
                    heapq.heappush(heap, (da[ia[p[0]]] + db[ib[p[1]]], *p))
        return out


def _along(c: np.ndarray) -> np.ndarray:
    """Where rows lie along their main direction."""
    centred = c - c.mean(axis=0)
    return centred @ np.linalg.svd(centred, full_matrices=False)[2][0]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), width)


def build(vectors: DataFrame) -> tuple[Index | None, DataFrame, int]:
    """(index, entries with their cell, width). ``vectors``: vec_id, v (usable vectors).

    The commonest width is indexed (the wider of equally common ones); vectors of other widths take no part.
    Codebooks are fitted on SAMPLE rows chosen by a hash of vec_id; every row is
    indexed. The number of centroids grows as the square root of the rows, up to
    MOST_CENTROIDS, so a cell keeps about the same number of entries up to there.
    """
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = vectors.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("m")).agg(F.max(F.struct("n", "w", "m"))).first()[0]
    if size is None:
        return None, vectors.select("vec_id", "v", F.lit(0).alias("cell")), 0
    n, width = size["n"], size["w"]
    vectors = vectors.where(F.size("v") == width)
    sample = np.array([r["v"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()], np.float64)
    index = Index(np.zeros((1, 1)), np.zeros((1, 1)), size["m"], (width + 1) // 2)
    k = min(MOST_CENTROIDS, max(1, round(math.sqrt(n) / 8)))
    a, b = index.halves(sample, True)
    index.first, index.second = kmeans(a, k, 1), kmeans(b, k, 2)
    index.counts = np.zeros((len(index.first), len(index.second)), np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(shared.value.cells(x), pa.int64())], names=["vec_id", "x", "cell"])

    entries = materialise(vectors.select("vec_id", "v").mapInArrow(cells, "vec_id long, x binary, cell long"))
    for r in entries.groupBy("cell").count().collect():  # a row per cell: MOST_CENTROIDS squared at most
        index.counts[divmod(r["cell"], len(index.second))] = r["count"]
    return index, entries, width


def measured(index: Index, stored: DataFrame, queries: Column, width: int, k: int, recall: float) -> int:
    """The budget with which PROBES queries (chosen by a hash) find ``recall`` of their true ``k`` neighbours.

    One pass compares them with every entry; k rows a query come to the driver.
    """
    asked = stored.where(queries).select("vec_id", "x").orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(PROBES).collect()
    if not asked:
        return 0
    y = np.frombuffer(b"".join(bytes(r["x"]) for r in asked), np.float64).reshape(-1, width)
    shared = stored.sparkSession.sparkContext.broadcast((np.array([r["vec_id"] for r in asked], np.int64), y))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, y = shared.value
        best, cells = np.full((len(y), k), -np.inf), np.zeros((len(y), k), np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, width)
            s = np.where(own[:, None] == ids[None, :], -np.inf, y @ x.T)
            s = np.hstack([best, s])
            c = np.hstack([cells, np.broadcast_to(batch.column(2).to_numpy(zero_copy_only=False), (len(y), len(ids)))])
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            best, cells = np.take_along_axis(s, top, 1), np.take_along_axis(c, top, 1)
        q, at = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(best[q, at]), pa.array(cells[q, at])], names=["q", "score", "cell"])

    found = stored.select("vec_id", "x", "cell").mapInArrow(nearest, "q int, score double, cell long")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "cell"))
    true = found.withColumn("r", rank).where(F.col("r") <= k).select("q", "cell").collect()
    weights = index.weights().reshape(-1)
    a, b = index.halves(y, False)
    da, db = distances(a, index.first), distances(b, index.second)
    before = []  # what a search has counted when it comes to each neighbour's cell
    for i in range(len(y)):
        order = np.argsort((da[i][:, None] + db[i][None, :]).reshape(-1), kind="stable")
        ahead = np.zeros(len(order), np.int64)
        ahead[order] = np.cumsum(weights[order]) - weights[order]
        before += [int(ahead[r["cell"]]) for r in true if r["q"] == i]
    return sorted(before)[max(0, math.ceil(recall * len(before)) - 1)] + 1 if before else 0


def search(vectors: DataFrame, queries: Column, k: int = 20, entries: int = 4000, share: float = 0.0, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` entries of largest inner product found for each query row.

    ``vectors``: vec_id, v. Queries are the rows where ``queries`` holds; a query is
    no candidate of its own. Unusable vectors (see ``usable``), null ids and vectors of another
    width than the commonest take no part; an empty table gives no rows. Ties go to the smaller vec_id; columns beside vec_id and v
    are ignored. Cells are visited until ``entries`` entries,
    or ``share`` of all entries, or as many as ``recall`` needs (see ``measured``) are named, whichever is most;
    a hot cell's entries count in part only. Rows with equal vec_id are entries of their own.

    Cells in a row make up groups of GROUP entries, a hot cell several of them. A task reads the entries of a group once and
    reranks the visited ones for ASKED queries at a time; it hands on ``k`` rows for each query, not ``k`` for each cell.
    """
    spark = vectors.sparkSession
    index, stored, width = build(vectors.where(F.col("vec_id").isNotNull() & usable(F.col("v"))))
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = int(index.counts.sum())
    wanted = max(entries, math.ceil(share * rows))
    if wanted < rows:
        wanted = max(wanted, measured(index, stored, queries, width, k, recall))
    wanted += 1
    weights, counts = index.weights(), index.counts.reshape(-1)
    start = index.places()
    first, last = start // GROUP, (start + np.maximum(counts, 1) - 1) // GROUP
    shared = spark.sparkContext.broadcast(index)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query, vector, group, cells): a row for each group that holds visited cells."""
        index = shared.value
        for batch in batches:
            raw = batch.column(1).to_pylist()
            a, b = index.halves(np.frombuffer(b"".join(raw), np.float64).reshape(-1, width), False)
            da, db = distances(a, index.first), distances(b, index.second)
            out: list[list] = [[], [], [], []]
            for i, q in enumerate(batch.column(0).to_pylist()):
                cells = np.sort(np.array(index.visit(da[i], db[i], wanted, weights), np.int64))
                spread = last[cells] - first[cells] + 1
                each = np.repeat(cells, spread)
                groups = np.arange(len(each)) - np.repeat(np.cumsum(spread) - spread, spread) + first[each]
                by_group = np.argsort(groups, kind="stable")
                each, groups = each[by_group], groups[by_group]
                at = np.r_[0, np.flatnonzero(np.diff(groups)) + 1, len(groups)]
                for lo, hi in zip(at[:-1], at[1:], strict=True):
                    for column, value in zip(out, (q, raw[i], groups[lo], each[lo:hi].astype("<i4").tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["vec_id", "x", "g", "cells"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries with the group in which their cell has its place; a hot cell's entries are dealt over its groups by their id and vector."""
        for batch in batches:
            cell = batch.column(2).to_numpy(zero_copy_only=False)
            deal = batch.column(3).to_numpy(zero_copy_only=False).astype(np.uint64) % np.maximum(counts[cell], 1).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array((start[cell] + deal.astype(np.int64)) // GROUP)], names=["vec_id", "x", "cell", "g"])

    # entries and queries of a group are neighbours in one sorted stream: entries (empty ``cells``) first, then queries
    asked = stored.where(queries).select("vec_id", "x").mapInArrow(named, "vec_id long, x binary, g long, cells binary")
    held = stored.select("vec_id", "x", "cell", F.xxhash64("vec_id", "x").alias("deal")).mapInArrow(placed, "vec_id long, x binary, cell long, g long")
    n_groups = int(last.max()) + 1
    held = held.select("g", F.lit(None).cast("binary").alias("cells"), "vec_id", "x", F.col("cell").cast("long").alias("cell"))
    asked = asked.select("g", "cells", "vec_id", "x", F.lit(None).cast("long").alias("cell"))
    stream = held.unionByName(asked).repartition(n_groups, "g").sortWithinPartitions("g", F.col("cells").isNotNull())

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block = _Group(width, k), _Block()
        for batch in batches:
            for g, cells, vec_id, x, cell in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group.number:
                    yield from block.answers(group)
                    group = _Group(width, k, g)
                if cells is None:
                    group.add(vec_id, x, cell)
                else:
                    block.add(vec_id, x, cells)
                    if len(block.ids) == ASKED:
                        yield from block.answers(group)
        yield from block.answers(group)

    scored = stream.mapInArrow(rerank, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Group:
    """The entries of one group of cells."""

    def __init__(self, width: int, k: int, number: int | None = None) -> None:
        self.width, self.k, self.number = width, k, number
        self.ids, self.raw, self.cells, self.x = [], [], [], None

    def add(self, vec_id: int, x: bytes, cell: int) -> None:
        self.ids.append(vec_id), self.raw.append(x), self.cells.append(cell)

    def ready(self) -> None:
        """Arrays in place of the lists, sorted by cell, once all entries are there."""
        if self.x is None:
            cells = np.array(self.cells, np.int64)
            order = np.argsort(cells, kind="stable")
            self.x = np.frombuffer(b"".join(self.raw), np.float64).reshape(-1, self.width)[order]
            self.ids, self.raw = np.array(self.ids, np.int64)[order], []
            self.names, self.begin = np.unique(cells[order], return_index=True)
            self.sizes = np.diff(np.r_[self.begin, len(cells)])

    def nearest(self, ids: np.ndarray, y: np.ndarray, cells: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, entry, score) of the ``k`` best visited entries of each query. A cell's entries are multiplied with the queries that visit it; with all of them only where at least half is visited."""
        self.ready()
        if not len(self.x):
            return
        visited = np.zeros((len(ids), len(self.names)), bool)
        for i, c in enumerate(cells):
            visited[i, np.searchsorted(self.names, c[np.isin(c, self.names)])] = True
        of = visited * self.sizes
        if 2 * of.sum() >= len(ids) * len(self.x):  # most is visited: one product of all
            whole = y @ self.x.T
            there = np.repeat(visited, self.sizes, axis=1)
            for i in range(len(ids)):
                other = np.flatnonzero(there[i])
                yield from self._best(ids[i], y[i], other, whole[i, other])
            return
        # the scores of a query stand together, cell after cell
        ends = np.cumsum(of.sum(axis=1))
        at = np.cumsum(of, axis=1) - of + np.r_[0, ends[:-1]][:, None]
        rough, entry = np.empty(ends[-1]), np.empty(ends[-1], np.int32)
        for j, (a, n) in enumerate(zip(self.begin.tolist(), self.sizes.tolist(), strict=True)):
            asking = np.flatnonzero(visited[:, j])
            if len(asking):
                spots = at[asking, j][:, None] + np.arange(n)
                rough[spots] = y[asking] @ self.x[a : a + n].T
                entry[spots] = np.arange(a, a + n)
        for i, (lo, hi) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)):
            yield from self._best(ids[i], y[i], entry[lo:hi], rough[lo:hi])

    def _best(self, query: int, y: np.ndarray, other: np.ndarray, near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The ``k`` best of the entries ``other`` but the query's own, whose products are about ``near``."""
        own = self.ids[other] == query
        if own.any():
            other, near = other[~own], near[~own]
        if (over := len(near) - self.k) > 0:
            bar = np.partition(near, over)[over]
            other = other[near >= bar - 1e-9 * (1 + abs(bar))]
        if len(other):
            s = (self.x[other] * y).sum(axis=1)  # the exact measure, in one order of additions
            order = np.lexsort((self.ids[other], -s))[: self.k]
            yield np.full(len(order), query), self.ids[other][order], s[order]


class _Block:
    """Queries that wait for their group."""

    def __init__(self) -> None:
        self.ids, self.raw, self.cells = [], [], []

    def add(self, vec_id: int, x: bytes, cells: bytes) -> None:
        self.ids.append(vec_id), self.raw.append(x), self.cells.append(np.frombuffer(cells, "<i4"))

    def answers(self, group: _Group) -> Iterator[pa.RecordBatch]:
        if self.ids:
            y = np.frombuffer(b"".join(self.raw), np.float64).reshape(-1, group.width)
            found = list(group.nearest(np.array(self.ids, np.int64), y, self.cells))
            self.__init__()
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])
