"""Exact top-k search by inner product with multi-resolution segment statistics.

Components are scaled to integers floor(1024 * x). Every vector is cut into segments, coarse to fine; of each segment
its mean and its deviation are kept. By Cauchy-Schwarz within the segments,
    q . x  <=  sum over segments of  length * (mean_q * mean_x + deviation_q * deviation_x),
which is the usual lower bound of the distance |q|^2 + |x|^2 - 2 q . x written for the product. For a block of candidates
the bound at one segment prunes first, the finer ones prune what is left, and only survivors get exact products. A bound
must reach the k-th best score that is known of the query: that of its best in the task so far, carried from batch to
batch, or a floor that the driver has taken from SEED_ROWS rows before, whichever is higher. Where most pairs of a block are
alive, a level is one matrix product over the block; where few are, it is taken pair by pair.

Directions of unlike variance make the bounds tight, so vectors are turned first (an orthogonal matrix from the seed rows'
second moments, which leaves products as they are) and segments are cut in order of variance. On vectors without any
structure only the finest level prunes (README has the survivors by level).

Queries come in blocks of at most QUERY_BLOCK rows (their number grows until no block holds more), each broadcast over
one scan of the candidates; a task returns at most k rows per query, and a window per query merges them. Nothing is
sampled or dropped: pruning only skips what can't be among the k best.

Nulls and edges: vectors that are null, empty, or hold null or non-finite components take no part, neither do null ids;
vectors of another dimension than the query's aren't its candidates; ties go to the smaller id; a query's own row is
every row with its id; rows repeated under one id count once, with their smallest vector; fewer candidates than k give
all; scores beyond 64 bits are not defined; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept, trim

SCALE = 1024
QUERY_BLOCK = 4096
LEVELS = (1, 4, 16, 32)
CANDIDATE_BLOCK = 4096
QUERY_STEP = 512
SEED_ROWS = 8192
#: A level is taken pair by pair where fewer than this share of a block's pairs are alive.
FEW = 1 / 16
#: Pairs whose statistics are gathered at a time.
PAIRS = 1 << 17
#: Below any product; its negative is an int64 too.
NO_SCORE = -((1 << 63) - 1)
NO_ID = np.iinfo(np.int64).max
#: Sums of whole numbers up to here are exact in a double.
EXACT = float(1 << 53)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows of scaled means and deviations, so that the bound is the product of two such rows. Columns that don't fill
    the segments evenly go to the last one."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = np.empty((len(x), 2 * (len(edges) - 1)))
    for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        part, root = x[:, a:b], np.sqrt(b - a)
        mean = part.mean(axis=1)
        out[:, 2 * s] = mean * root
        out[:, 2 * s + 1] = np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The exact products of all rows of q with all of x, whole numbers held as doubles."""
    if len(q) and len(x) and np.abs(q).max() * np.abs(x).max() * x.shape[1] >= EXACT:
        return q.astype(np.int64) @ x.astype(np.int64).T
    return (q @ x.T).astype(np.int64)


class Asked:
    """The queries of one dimension: ids, scaled vectors, the turn and the statistics by level, and a floor of each query's
    k-th best score."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, seed_ids: np.ndarray, seed: np.ndarray, k: int):
        self.ids, self.q = ids, q
        self.turn = np.linalg.eigh(seed.T @ seed)[1][:, ::-1] if len(seed) and np.isfinite(seed.T @ seed).all() else np.eye(q.shape[1])
        turned = q @ self.turn
        self.levels = [statistics(turned, s) for s in LEVELS]
        self.size = np.sqrt((q**2).sum(axis=1))
        self.floor = np.full(len(q), NO_SCORE)
        for at in range(0, len(q), QUERY_STEP):
            step = slice(at, at + QUERY_STEP)
            scores = products(q[step], seed)
            scores[ids[step, None] == seed_ids[None, :]] = NO_SCORE
            if len(seed) >= k:
                self.floor[step] = np.partition(scores, len(seed) - k, axis=1)[:, len(seed) - k]


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, asked: Asked, k: int):
        self.asked, self.k = asked, k
        self.ids, self.scores = np.full((len(asked.ids), k), NO_ID), np.full((len(asked.ids), k), NO_SCORE)
        self.alive = np.zeros(len(LEVELS) + 1, dtype=np.int64)  # pairs, and those that each level leaves

    def take(self, ids: np.ndarray, x: np.ndarray) -> None:
        turned = x @ self.asked.turn
        levels = [statistics(turned, s) for s in LEVELS]
        size = np.sqrt((x**2).sum(axis=1))
        for at in range(0, len(self.asked.ids), QUERY_STEP):
            self._step(slice(at, min(at + QUERY_STEP, len(self.asked.ids))), ids, x, levels, size)

    def _step(self, step: slice, ids: np.ndarray, x: np.ndarray, levels: list[np.ndarray], size: np.ndarray) -> None:
        asked = self.asked
        least = np.maximum(self.scores[step, -1], asked.floor[step])
        # What rounding may take from a bound, as a share of the product of lengths.
        room = least[:, None] - (1e-9 * asked.size[step, None] * size[None, :] + 1e-6)
        alive = np.ones(room.shape, dtype=bool)
        pairs: tuple[np.ndarray, np.ndarray] | None = None  # once few are alive
        self.alive[0] += alive.size
        for level, (all_q, sx) in enumerate(zip(asked.levels, levels), 1):
            sq = all_q[step]
            if pairs is None:
                alive &= sq @ sx.T >= room
                left = int(alive.sum())
                if left < FEW * alive.size:
                    pairs = np.nonzero(alive)
            else:
                keep = np.zeros(len(pairs[0]), dtype=bool)
                for p in range(0, len(keep), PAIRS):
                    a, b = pairs[0][p : p + PAIRS], pairs[1][p : p + PAIRS]
                    keep[p : p + PAIRS] = np.einsum("ij,ij->i", sq[a], sx[b]) >= room[a, b]
                pairs = (pairs[0][keep], pairs[1][keep])
                left = len(pairs[0])
            self.alive[level] += left
        if pairs is None:
            scores = products(asked.q[step], x)
            qi, xi = np.nonzero(alive & (scores >= least[:, None]))
            scores = scores[qi, xi]
        else:
            qi, xi = pairs
            scores = np.concatenate([np.einsum("ij,ij->i", asked.q[step][qi[p : p + PAIRS]].astype(np.int64), x[xi[p : p + PAIRS]].astype(np.int64)) for p in range(0, len(qi), PAIRS)] or [np.zeros(0, np.int64)])
        worst, worst_id = self.scores[step, -1][qi], self.ids[step, -1][qi]
        better = (scores >= least[qi]) & ((scores > worst) | ((scores == worst) & (ids[xi] < worst_id))) & (ids[xi] != asked.ids[step][qi])
        self._merge(step, qi[better], ids[xi[better]], scores[better])

    def _merge(self, step: slice, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(rows):
            return
        touched = np.unique(rows)
        held_ids, held = self.ids[step], self.scores[step]  # views
        all_rows = np.concatenate([np.repeat(touched, self.k), rows])
        all_ids, all_scores = np.concatenate([held_ids[touched].ravel(), ids]), np.concatenate([held[touched].ravel(), scores])
        order = np.lexsort((all_ids, -all_scores, all_rows))
        starts = np.searchsorted(all_rows[order], touched)
        top = order[starts[:, None] + np.arange(self.k)[None, :]]
        held_ids[touched], held[touched] = all_ids[top], all_scores[top]


def _usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """m_id, m_vec (scaled integers as doubles), one row per id."""
    whole = F.col("m_vec")
    finite: Column = ~F.exists(whole, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = vectors.select(F.col(id_column).cast("long").alias("m_id"), F.col(vector).cast("array<double>").alias("m_vec"))
    v = v.where(F.col("m_id").isNotNull() & whole.isNotNull() & (F.size(whole) > 0)).where(finite)
    v = v.withColumn("m_vec", F.transform(whole, lambda c: F.floor(c * SCALE).cast("double")))
    return v.groupBy("m_id").agg(F.min("m_vec").alias("m_vec"))


def _by_dimension(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dimension, ids, vectors as rows, of lists of any lengths."""
    ids, lengths = ids.to_numpy(zero_copy_only=False).astype(np.int64), vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        yield dim, ids[rows], flat[starts[rows][:, None] + np.arange(dim)[None, :]]


def _numbers(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and vectors of a bounded number of rows, by dimension, on the driver."""
    got = rows.select("m_id", "m_vec").toArrow()
    return {dim: (ids, x) for dim, ids, x in _by_dimension(got["m_id"].combine_chunks(), got["m_vec"].combine_chunks())} if got.num_rows else {}


def _blocks(asked: DataFrame, query_block: int) -> tuple[DataFrame, int]:
    """asked with its block m_block, and the number of blocks, none of which holds more than query_block rows."""
    blocks = max(1, -(-asked.count() // query_block))
    while True:
        numbered = asked.withColumn("m_block", F.pmod(F.xxhash64("m_id"), F.lit(blocks)))
        if (numbered.groupBy("m_block").count().agg(F.max("count")).first()[0] or 0) <= query_block:
            return numbered, blocks
        blocks += -(-blocks // 8)


def search(vectors: DataFrame, queries: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, survivors: list | None = None) -> DataFrame:
    """queries: a condition on the column m_id. Returns query_id, rank, vec_id, score. survivors: a list that is given the number of
    pairs, and of those that each level leaves."""
    spark = vectors.sparkSession
    rows = kept(_usable(vectors, id_column, vector))
    seeds = _numbers(rows.limit(SEED_ROWS))
    asked, blocks = _blocks(rows.where(queries), query_block)
    counts = [spark.sparkContext.accumulator(0) for _ in range(len(LEVELS) + 1)]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = None
    for block in range(blocks):
        none = (np.zeros(0, np.int64), np.zeros((0, 0)))
        by_dim = {dim: Asked(ids, q, *(seeds.get(dim) or (none[0], np.zeros((0, dim)))), k) for dim, (ids, q) in _numbers(asked.where(F.col("m_block") == block)).items()}
        shared = spark.sparkContext.broadcast(by_dim)

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = {dim: Best(a, k) for dim, a in shared.value.items()}
            for batch in batches:
                for dim, ids, x in _by_dimension(batch.column(0), batch.column(1)):
                    if dim in held:
                        for p in range(0, len(ids), CANDIDATE_BLOCK):
                            held[dim].take(ids[p : p + CANDIDATE_BLOCK], x[p : p + CANDIDATE_BLOCK])
            for best in held.values():
                there = best.scores > NO_SCORE
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(best.asked.ids, there.sum(axis=1))), pa.array(best.ids[there]), pa.array(best.scores[there])], names=["query_id", "vec_id", "score"])
                for counter, n in zip(counts, best.alive.tolist()):
                    counter.add(n)
            trim()

        tops = rows.mapInArrow(each, "query_id long, vec_id long, score long")
        tops = kept(tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        shared.destroy()
        found = tops if found is None else found.unionByName(tops)
    if survivors is not None:
        survivors[:] = [c.value for c in counts]
    return found


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
