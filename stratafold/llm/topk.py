"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

Each task turns its vectors into blocks of bounded size, and a block's vectors are dealt to cells around a few of them.  A cell has a list for every
dimension, sorted when it is first read.  A query reads the lists of its non-zero components from their best end, all to the same depth.
Vectors met for the first time are scored in full (random access).  A vector not met yet scores at most the sum, over the lists, of component
times last value read; once that bound is below the k-th best score, the cell is done.  A bound equal to that score doesn't stop the search, as ties
go to the smaller id.

Before anything is read, a cell's vectors score at most the sum of its lists' best ends, and at most what its centre scores and its radius adds.  Cells
are read in the order of that bound, and those below the k-th best score aren't read at all; what earlier blocks of a task have found
counts, too.  Where most of a block would have to be read even so, as for vectors that lie alike in all directions, the block is scored outright, for
many queries in one product: reading the lists to their ends would meet the same vectors.  (`Block.top` tells how many vectors it scored.)

Queries are broadcast in blocks of bounded size, all vectors being read once for each; a block of vectors returns k rows for a
query at most, and a window that keeps the k best on the map side merges them.

Edge cases: vectors that are null, or hold a null or non-finite component, and rows with a null id take no part; vectors of another length
than the query's are no candidates for it; the query's own rows are all rows with its id; an id that several rows carry is asked
once, with the smallest vector; repeated rows are candidates each; fewer than k candidates give fewer rows; columns besides those named are
passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most vectors in a block of candidates, and components in it.
BLOCK_ROWS, BLOCK_CELLS = 1 << 16, 1 << 22
#: Most components of the queries that are broadcast at once.
QUERY_CELLS = 1 << 22
#: About as many vectors are in a cell, and most cells of a block.
CELL_ROWS, MOST_CELLS = 1 << 10, 64
#: Scores of a product that are held at once.
HELD = 1 << 23
FIRST_DEPTH = 8


def valid(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


class Cell:
    """Some vectors of a block, `rows` of it, with a sorted list for each dimension."""

    def __init__(self, rows: np.ndarray, x: np.ndarray) -> None:
        self.rows, self.x = rows, x
        self.order: np.ndarray | None = None

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        if self.order is None:
            self.order = np.argsort(self.x, axis=0, kind="stable").astype(np.int32)
            self.values = np.take_along_axis(self.x, self.order, axis=0)
        return self.order, self.values


class Best:
    """The k best rows of a block so far; of equal scores, the rows that come first."""

    def __init__(self, k: int, floor: float | None) -> None:
        self.k, self.floor = k, floor
        self.at, self.score, self.scored = np.empty(0, np.int64), None, 0

    def add(self, at: np.ndarray, score: np.ndarray) -> None:
        self.scored += len(at)
        at, score = np.concatenate([self.at, at]), score if self.score is None else np.concatenate([self.score, score])
        keep = score >= self.least() if len(score) else np.zeros(0, bool)
        if len(score) > self.k:
            # The k-th best score, then all of that score or more by (score, row).
            keep &= score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
        at, score = at[keep], score[keep]
        rank = np.lexsort((at, -score))[: self.k]
        self.at, self.score = at[rank], score[rank]

    def least(self) -> float:
        """What a score must reach to matter."""
        known = -np.inf if self.floor is None else self.floor
        return max(known, self.score[-1]) if self.score is not None and len(self.score) >= self.k else known


class Block:
    """Vectors of one length, in cells."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, cells: int | None = None) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order].astype(np.float64)
        self.most = np.abs(self.x).max(initial=0)
        n = len(self.ids)
        own = self._dealt(min(MOST_CELLS, max(1, n // CELL_ROWS)) if cells is None else cells)
        self.cells = [Cell(rows, self.x[rows]) for c in np.unique(own) for rows in [np.flatnonzero(own == c)]]
        self.high, self.low, self.centre = (np.stack([f(c.x, axis=0) for c in self.cells]) if n else np.zeros((0, x.shape[1])) for f in (np.max, np.min, np.mean))
        self.radius = np.array([np.sqrt(((c.x - m) ** 2).sum(axis=1).max()) for c, m in zip(self.cells, self.centre, strict=True)])

    def _dealt(self, cells: int) -> np.ndarray:
        """A cell for each vector: that of the nearest of some vectors, moved to their cells' means once."""
        n = len(self.x)
        if cells <= 1:
            return np.zeros(n, np.int64)
        centre = self.x[np.random.default_rng(n).choice(n, cells, replace=False)]
        for last in (False, True):
            own = np.concatenate([((part @ centre.T) - (centre**2).sum(axis=1) / 2).argmax(axis=1) for part in np.array_split(self.x, -(-n // 8192))])
            if not last:
                centre = np.stack([self.x[own == c].mean(axis=0) if (own == c).any() else centre[c] for c in range(cells)])
        return own

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """What no vector of each cell can exceed, by query and cell."""
        lists = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        ball = q @ self.centre.T + np.sqrt((q**2).sum(axis=1))[:, None] * self.radius
        most = np.minimum(lists, ball)
        return most + np.abs(most) * 1e-9 + 1e-6  # for the rounding of these numbers

    def top(self, own: int, q: np.ndarray, k: int, floor: float | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best but those with id `own`, best first, and how many vectors were scored; none below `floor`."""
        ((ids, scores, scored),) = self.search([(own, q)], k, [floor])
        return ids, scores, scored

    def search(self, asked: list[tuple[int, np.ndarray]], k: int, floors: list[float | None]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """The same for many queries."""
        bests = [Best(k, f) for f in floors]
        if len(self.ids) and asked:
            sizes, outright = np.array([len(c.rows) for c in self.cells]), []
            bounds = self.bounds(np.stack([q for _, q in asked]).astype(np.float64))
            for i, (own, q) in enumerate(asked):
                order = np.argsort(-bounds[i], kind="stable")
                if bounds[i][order[0]] < bests[i].least():
                    continue
                self._read(order[0], own, q, bests[i])
                left = order[1:][bounds[i][order[1:]] >= bests[i].least()]
                if 2 * sizes[left].sum() > len(self.ids):
                    outright.append(i)
                    continue
                for c in left:
                    if bounds[i][c] >= bests[i].least():
                        self._read(c, own, q, bests[i])
            self._outright([(i, *asked[i]) for i in outright], bests)
        return [(self.ids[b.at], (b.score if b.score is not None else np.empty(0)).astype(np.int64), b.scored) for b in bests]

    def _exact(self, q: np.ndarray) -> np.ndarray:
        """The query as doubles where those hold all scores exactly, else as integers."""
        return q.astype(np.float64) if self.most * np.abs(q).sum(dtype=np.float64) < 2**53 else q.astype(np.int64)

    def _own(self, own: int) -> tuple[int, int]:
        return int(np.searchsorted(self.ids, own)), int(np.searchsorted(self.ids, own, side="right"))

    def _read(self, c: int, own: int, q: np.ndarray, best: Best) -> None:
        """The threshold algorithm in one cell."""
        cell, q = self.cells[c], self._exact(q)
        (order, values), x, n = cell.lists(), cell.x.astype(q.dtype, copy=False), len(cell.rows)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        first, after = self._own(own)
        seen = (cell.rows >= first) & (cell.rows < after)
        depth, last = 0, False
        while not last:
            before, depth = depth, min(n, max(FIRST_DEPTH, depth * 4))
            mark = np.zeros(n, bool)
            mark[order[n - depth : n - before, up]] = True
            mark[order[before:depth, down]] = True
            mark &= ~seen
            seen |= mark
            if np.count_nonzero(seen) * 2 > n or depth == n:
                mark |= ~seen
                last = True
            new = np.flatnonzero(mark)
            best.add(cell.rows[new], x[new] @ q)
            if not last:
                bound = values[n - depth, up].astype(q.dtype) @ q[up] + values[depth - 1, down].astype(q.dtype) @ q[down]
                last = best.least() > bound

    def _outright(self, asked: list[tuple[int, int, np.ndarray]], bests: list[Best]) -> None:
        """All vectors scored, for many queries in one product."""
        n = len(self.ids)
        step = max(1, HELD // max(1, n))
        for k in range(0, len(asked), step):
            part = asked[k : k + step]
            exact = [self._exact(q) for _, _, q in part]
            doubles = all(q.dtype == np.float64 for q in exact)
            scores = np.stack(exact) @ self.x.T if doubles else np.stack([q.astype(np.int64) for q in exact]) @ self.x.astype(np.int64).T
            for (i, own, _), row in zip(part, scores, strict=True):
                best = Best(bests[i].k, bests[i].floor)
                first, after = self._own(own)
                rows = np.concatenate([np.arange(first), np.arange(after, n)])
                best.add(rows, row[rows])
                bests[i] = best


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of vectors of one length each, as they fill up."""
    open_: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}

    def full(d: int) -> bool:
        rows = sum(map(len, open_[d][0]))
        return rows >= BLOCK_ROWS or rows * max(1, d) >= BLOCK_CELLS

    def close(d: int) -> Block:
        ids, parts = open_.pop(d)
        return Block(np.concatenate(ids), np.concatenate(parts))

    for batch in batches:
        ids, vectors = batch.column(0).to_numpy(), batch.column(1)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy())])
        sizes = np.diff(at)
        for d in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == d)
            a, b = open_.setdefault(d, ([], []))
            a.append(ids[rows])
            b.append(flat[at[rows][:, None] + np.arange(d)].reshape(len(rows), d))
            if full(d):
                yield close(d)
        while len(open_) > 64:  # of many lengths, the fullest goes first
            yield close(max(open_, key=lambda d: sum(map(len, open_[d][0]))))
    for d in list(open_):
        yield close(d)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, *, query_cells: int = QUERY_CELLS) -> DataFrame:
    """The k best rows of `vectors` for each query: query_id, rank, vec_id, score.

    Both tables have vec_id and vec, an array of bigint without nulls.
    """
    spark = vectors.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("vec").alias("vec"))
    cells = queries.agg(F.sum(F.size("vec") + 1)).first()[0] or 0
    blocks = max(1, -(-cells // query_cells))
    parts = None
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        asked = spark.sparkContext.broadcast(_queries(part.select("vec_id", "vec").toArrow()))

        def scan(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            floors: dict[int, float] = {}  # the k-th best score of what this task has returned for a query
            for block in _blocks(batches):
                ids, x = asked.value.get(block.x.shape[1], ((), ()))
                found = block.search(list(zip(ids, x, strict=True)), k, [floors.get(i) for i in ids])
                for i, (_, scores, _) in zip(ids, found, strict=True):
                    if len(scores) == k:
                        floors[i] = float(scores[-1])
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(np.array(ids, np.int64), [len(f[0]) for f in found])), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))],
                        names=["query_id", "vec_id", "score"],
                    )

        found = vectors.select("vec_id", "vec").mapInArrow(scan, "query_id bigint, vec_id bigint, score bigint")
        parts = found if parts is None else parts.unionAll(found)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _queries(table: pa.Table) -> dict[int, tuple[list[int], np.ndarray]]:
    """Ids and vectors of the queries, by length."""
    table = table.combine_chunks()
    ids, vectors = table.column("vec_id").to_numpy(), table.column("vec").combine_chunks()
    flat, sizes = vectors.flatten().to_numpy(), vectors.value_lengths().to_numpy()
    at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return {int(d): (ids[sizes == d].tolist(), flat[at[sizes == d][:, None] + np.arange(d)]) for d in np.unique(sizes)}


def quantised(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and vec: floor(scale * x) of every component, of the rows that take part."""
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v")).filter(F.col("vec_id").isNotNull() & valid(F.col("v")))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("vec"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, min(v) AS v FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (SELECT query_id, vec_id, coalesce(list_sum(list_transform(list_zip(q.v, v.v), lambda x: x[1] * x[2])), 0)::BIGINT AS score
      FROM q JOIN v ON vec_id <> query_id AND len(q.v) = len(v.v))
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 10
"""
