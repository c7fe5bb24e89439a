"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into segments at several resolutions, coarse to fine; a segment keeps its mean and its deviation (root of the
sum of squared differences from the mean). For a segment of length L, <a, b> = L * mean_a * mean_b + <a - mean_a, b - mean_b>, at
most L * mean_a * mean_b + dev_a * dev_b: the same statistics that bound the Euclidean distance from below. A pair is
dropped at a resolution if its bound is under the query's k-th best score so far; survivors, and only these, get their exact score.

Plan: all vectors are packed into blocks of bounded size, the asking ones into query blocks as well. First each query block
meets one group of candidate blocks, which gives every query a floor, the k-th best score there. Then a cell is a query block and
a group of candidate blocks; it starts from the floors, so it prunes from its first block on. The work spreads over (query
blocks x groups) whatever the values are, and equal or hot vectors don't matter. A cell returns its best k per query, and a window
keeps the best k of these. Nothing is broadcast or collected. How much is pruned depends on the vectors: pruned() counts it.

Vectors that are null, empty or hold a null or non-finite component, and rows without an id, take no part. Each row asks for itself
and is no candidate of its own; rows that share an id ask and are candidates each, and a repeated query id gets its ranks once for
each row. Ties go to the smaller id. Ids are whole numbers. Vectors meet those of their own length only; long vectors
make blocks of fewer rows. Scores are exact integers; beyond 64 bits they stop at the ends of a long. An empty table or no
query gives an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, batch, materialise, quoted, unused

QUERY_BLOCK = CANDIDATE_BLOCK = 4096
GROUP_BLOCKS = 4
TILE = 512
_BLOCK_BYTES = 8 << 20
_SAFE = 2.0**53
_ENDS = (-(2**63), 2**63 - 1)


_BLOCKS = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("asks", pa.binary()), ("vectors", pa.binary())])
_BLOCKS_SQL = "block long, dim int, rows binary, ids binary, asks binary, vectors binary"


class _Packer:
    """Rows of one partition to blocks of equally long vectors."""

    def __init__(self, most: int):
        self.most, self.made, self.part, self.held = most, 0, TaskContext.get().partitionId() << 32, {}

    def add(self, row: int | None, i: int, ask: bool, vector: bytes) -> Batches:
        """row: its number; None gives it one."""
        dim = len(vector) // 8
        rows, ids, asks, vectors = self.held.setdefault(dim, ([], [], [], []))
        rows.append(row)
        ids.append(i)
        asks.append(ask)
        vectors.append(vector)
        if len(ids) >= max(1, min(self.most, _BLOCK_BYTES // (8 * dim))):
            yield self.block(dim)

    def block(self, dim: int) -> pa.RecordBatch:
        rows, ids, asks, vectors = self.held.pop(dim)
        self.made += 1
        first = self.part + self.made * self.most
        rows = np.array([first + k if r is None else r for k, r in enumerate(rows)], np.int64)
        return batch(_BLOCKS, [self.part + self.made], [dim], [rows.tobytes()], [np.array(ids, np.int64).tobytes()], [np.array(asks, bool).tobytes()], [b"".join(vectors)])

    def rest(self) -> Batches:
        for dim in list(self.held):
            yield self.block(dim)


def _packed(scale: float, most: int) -> Callable[[Batches], Batches]:
    """(id, vector, asks) to blocks of floor(scale * vector)."""

    def run(batches: Batches) -> Batches:
        packer = _Packer(most)
        for b in batches:
            for i, v, ask in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                yield from packer.add(None, i, ask, np.floor(scale * v.values.to_numpy()).tobytes())
        yield from packer.rest()

    return run


def _queries(most: int) -> Callable[[Batches], Batches]:
    """The asking rows of blocks, packed again."""

    def run(batches: Batches) -> Batches:
        packer = _Packer(most)
        for b in batches:
            for dim, rows, ids, asks, vectors in zip(*(b.column(c).to_pylist() for c in ("dim", "rows", "ids", "asks", "vectors")), strict=True):
                rows, ids, width = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64), 8 * dim
                for k in np.flatnonzero(np.frombuffer(asks, bool)).tolist():
                    yield from packer.add(int(rows[k]), int(ids[k]), True, vectors[k * width : (k + 1) * width])
        yield from packer.rest()

    return run


def resolutions(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine. The finest has single components in half of its segments."""
    return sorted({n for n in (4, 16, dim // 2, 3 * dim // 4) if 1 < n < dim})


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """(rows, 2 * segments): sqrt(L) * mean and deviation of each segment; the bound of a pair is the product of two rows."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)[:-1]
    n = np.diff(cuts, append=x.shape[1])
    sums, squares = np.add.reduceat(x, cuts, axis=1), np.add.reduceat(x * x, cuts, axis=1)
    return np.hstack([sums / np.sqrt(n), np.sqrt(np.maximum(squares - sums * sums / n, 0))])


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of q and x."""
    peak = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if peak < _SAFE:
        return (q @ x.T).astype(np.int64)
    a, b = (np.array([[int(v) for v in row] for row in m], dtype=object) for m in (q, x))
    return np.clip(a @ b.T, *_ENDS).astype(np.int64)


def _norm(x: np.ndarray) -> float:
    return float((x * x).sum(axis=1).max(initial=0)) ** 0.5


class _Best:
    """The best k of each query of a tile, and how many candidates met it and survived each resolution."""

    def __init__(self, rows: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int):
        self.rows, self.q, self.floors, self.k = rows, q, floors, k
        self.stats = [segment_statistics(q, n) for n in resolutions(q.shape[1])]
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in rows]
        self.counts = np.zeros((len(rows), len(self.stats) + 1), np.int64)

    def meet(self, rows: np.ndarray, ids: np.ndarray, c: np.ndarray, stats: list[np.ndarray]) -> None:
        alive = self.rows[:, None] != rows[None, :]
        self.counts[:, 0] += alive.sum(axis=1)
        scale = _norm(self.q) * _norm(c)
        for level, (mine, theirs) in enumerate(zip(self.stats, stats, strict=True), 1):
            if scale < _SAFE:  # beyond, floating-point bounds are no bounds
                alive &= mine @ theirs.T + 1e-9 * (1 + scale) >= self.floors[:, None]
            self.counts[:, level] += alive.sum(axis=1)
        for r in np.flatnonzero(alive.any(axis=1)):
            at = np.flatnonzero(alive[r])
            s, i = np.append(self.found[r][0], _exact(self.q[r : r + 1], c[at])[0]), np.append(self.found[r][1], ids[at])
            if len(s) > 4 * self.k:  # ties at the k-th score all stay until they are sorted by id
                near = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
                s, i = s[near], i[near]
            top = np.lexsort((i, -s))[: self.k]
            self.found[r] = s[top], i[top]
            if len(top) == self.k:
                self.floors[r] = max(self.floors[r], s[top[-1]])


def _meet(k: int, tile: int, queries: pa.Table, candidates: pa.Table):
    """For each query block: its block id, query ids and the tiles' results."""
    blocks = []
    for dim, rows, ids, data in zip(*(candidates.column(c).to_pylist() for c in ("dim", "rows", "ids", "vectors")), strict=True):
        blocks.append((np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, dim)))
    for block, dim, rows, ids, data, floors in zip(*(queries.column(c).to_pylist() for c in ("block", "dim", "rows", "ids", "vectors", "floors")), strict=True):
        rows, q = np.frombuffer(rows, np.int64), np.frombuffer(data).reshape(-1, dim)
        floors = np.full(len(rows), -np.inf) if floors is None else np.frombuffer(floors).copy()
        tiles = [_Best(rows[t : t + tile], q[t : t + tile], floors[t : t + tile], k) for t in range(0, len(rows), tile)]
        for crows, cids, c in blocks:
            if c.shape[1] == dim:
                stats = [segment_statistics(c, n) for n in resolutions(dim)]
                for t in tiles:
                    t.meet(crows, cids, c, stats)
        yield block, np.frombuffer(ids, np.int64), tiles


def _floors(k: int, tile: int) -> Callable:
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        made = [(block, np.concatenate([t.floors for t in tiles]).tobytes()) for block, _, tiles in _meet(k, tile, queries, candidates)]
        return pa.table({"of": pa.array([b for b, _ in made], pa.int64()), "floors": pa.array([f for _, f in made], pa.binary())})

    return run


_FOUND = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("counts", pa.list_(pa.int64()))])


def _cell(k: int, tile: int) -> Callable:
    """Rows of the best k, and a row for each query with its counts."""

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        for _, ids, tiles in _meet(k, tile, queries, candidates):
            at = 0
            for t in tiles:
                for row, (scores, others), counts in zip(t.rows.tolist(), t.found, t.counts.tolist(), strict=True):
                    out.append((row, int(ids[at]), None, None, counts))
                    out += [(row, int(ids[at]), i, s, None) for s, i in zip(scores.tolist(), others.tolist(), strict=True)]
                    at += 1
        return pa.Table.from_batches([batch(_FOUND, *(zip(*out, strict=True) if out else [[]] * 5))])

    return run


def _cells(vectors: DataFrame, queries, k: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(quoted(vector_col))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    asks = unused(vectors.columns, "asks")
    valid = vectors.withColumn(asks, F.coalesce(queries, F.lit(False))).where(F.col(quoted(id_col)).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    given = valid.select(F.col(quoted(id_col)).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.col(asks).alias("asks"))
    candidates = materialise(given.mapInArrow(_packed(scale, CANDIDATE_BLOCK), _BLOCKS_SQL))
    asking = materialise(candidates.mapInArrow(_queries(QUERY_BLOCK), _BLOCKS_SQL))
    nq, groups = max(1, asking.count()), -(-candidates.count() // GROUP_BLOCKS) or 1
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    q = asking.withColumn("qb", dealt(nq)).withColumn("floors", F.lit(None).cast("binary"))
    c = candidates.withColumn("cg", dealt(groups))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # Query blocks of number qb start with the group qb mod groups.
    some = F.explode(F.when(F.col("cg") < nq, F.sequence(F.col("cg"), F.lit(nq - 1).cast("long"), F.lit(groups).cast("long"))))
    first = q.withColumn("cg", F.pmod("qb", F.lit(groups))).groupBy("qb", "cg").cogroup(c.withColumn("qb", some).groupBy("qb", "cg"))
    floors = materialise(first.applyInArrow(_floors(k, TILE), "of long, floors binary"))
    seeded = q.drop("floors").join(floors, F.col("block") == F.col("of"), "left").drop("of")
    met = seeded.withColumn("cg", every(groups)).groupBy("qb", "cg").cogroup(c.withColumn("qb", every(nq)).groupBy("qb", "cg"))
    return met.applyInArrow(_cell(k, TILE), "row long, query_id long, vec_id long, score long, counts array<long>")


def top_k_inner_products(vectors: DataFrame, queries, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """queries: condition on the rows of vectors. Components become floor(scale * x). Returns query_id, rank, vec_id, score."""
    cells = _cells(vectors, queries, k, scale, id_col, vector_col).where("vec_id is not null")
    ranked = cells.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pruned(vectors: DataFrame, queries, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(level, pairs): the pairs of queries and candidates at level 0, and those that survive each resolution, coarse to fine."""
    cells = _cells(vectors, queries, k, scale, id_col, vector_col).where("counts is not null")
    return cells.select(F.posexplode("counts").alias("level", "pairs")).groupBy("level").agg(F.sum("pairs").alias("pairs"))
