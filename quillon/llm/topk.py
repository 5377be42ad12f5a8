"""Exact top-k inner products by an impact-ordered index, processed score at a time.

Vectors are whole numbers. Each task indexes blocks of its own vectors: a component that is not 0 is a posting (place of the vector, value) of its
dimension, and each dimension's postings are ordered by impact, the magnitude, quantised to LEVELS; those of one level are a segment.
Queries, TOGETHER at a time, take the segments of all dimensions by descending impact on their scores, |query component| x level: in rounds,
each down to half the impact of the round before. What a candidate can still gain or lose is at most the sum over the dimensions of |query component| x the
greatest value of the segments not yet taken. A query stops on the proof that all but a few candidates lie below its k-th best; these few are
scored again exactly. Without proof it goes on to the last segment, where all scores are exact.

Queries are written to the shared folder once. A task reads them in blocks and sends all blocks through the index of a block of its vectors while
that is alive, so that vectors are read and indexed once; only the best k a query and block of vectors are shuffled. Nothing grows with the input in
a task or in the driver.

Cases: vectors that are null, or hold null or a component that is not finite, take no part, nor do rows with a null id; vectors of different
length are not compared; of rows that share a query's id the least vector asks, and none of them answers it; other repeated rows are
candidates each; empty vectors score 0; ties go to the smaller id; an empty table gives an empty result; large components are multiplied as whole
numbers of any size, and a score beyond a long counts as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import materialise_at, read_shared, table

#: Queries of a block, and those that take segments together; vectors indexed together; levels of impact; candidates left at which a query may stop.
QUERIES, TOGETHER, VECTORS, LEVELS, FEW = 2048, 128, 16384, 12, 32
BEST = "query_id long, vec_id long, score long"
LONG = (1 << 63) - 1
#: Sums of products of whole numbers below this are exact as doubles.
EXACT = float(1 << 53)


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def quantise(v: Column, scale: int = 256) -> Column:
    """Whole numbers as doubles; beyond 2^52 a double is whole."""

    def whole(x: Column) -> Column:
        y = F.least(F.greatest(x.cast("double") * scale, F.lit(-1.7e308)), F.lit(1.7e308))
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)

    return F.transform(v, whole)


class Index:
    """Postings of a block of vectors, for each dimension by descending impact, with the bounds of the segments."""

    def __init__(self, vectors: np.ndarray):
        size = np.abs(vectors.T)
        step = float(size.max(initial=0)) / LEVELS + 1e-300
        level = np.minimum((size / step).astype(np.int32), LEVELS - 1)
        level[size == 0] = -1  # no posting
        order = np.argsort(-level, axis=1, kind="stable")
        self.count, self.dims = vectors.shape
        self.at = order.astype(np.int32)
        self.value = np.take_along_axis(vectors.T, order, axis=1)
        ranked = np.take_along_axis(level, order, axis=1)
        # Segment j of a dimension has level LEVELS - 1 - j and ends at end[dimension, j]; top is the greatest value of a segment.
        self.end = np.stack([(ranked >= l).sum(axis=1) for l in range(LEVELS - 1, -1, -1)], axis=1) if self.dims else np.zeros((0, LEVELS), np.int64)
        greatest = lambda l: np.where(level == l, size, 0).max(axis=1, initial=0)
        self.top = np.stack([greatest(l) for l in range(LEVELS - 1, -1, -1)], axis=1) if self.dims else np.zeros((0, LEVELS))


def search_together(index: Index, queries: np.ndarray, own: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of each query: places of the possible members of its k best; `own`: places that do not answer it.

    The queries' segments are taken in one order, by the greatest impact on any of them; each is proved by itself, and left out from then on.
    """
    found: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
    active = np.arange(len(queries))
    scores = np.zeros((index.count, len(queries)))
    for q, places in enumerate(own):
        scores[places, q] = -np.inf
    # The impact of what a dimension still holds, and how many of its segments are taken.
    size = np.abs(queries)
    ahead = np.maximum.accumulate(index.top[:, ::-1], axis=1)[:, ::-1]
    ahead = np.concatenate([ahead, np.zeros((index.dims, 1))], axis=1)
    impact = size.max(axis=0, initial=0)[:, None] * ahead
    taken, rows = np.zeros(index.dims, np.int64), np.arange(index.dims)
    least = float(impact.max(initial=0))

    def settle(columns: np.ndarray, bounds: np.ndarray, always: bool) -> np.ndarray:
        """Which of the columns are settled: members are those within twice the bound of the k-th best score."""
        done = np.zeros(scores.shape[1], bool)
        if index.count > k and len(columns):
            kth = np.partition(scores[:, columns], index.count - k, axis=0)[index.count - k]
        else:
            kth = np.full(len(columns), -np.inf)
        for c, least_score in zip(columns.tolist(), (kth - 2 * bounds).tolist(), strict=True):
            possible = np.flatnonzero(scores[:, c] >= least_score)
            if always or len(possible) <= FEW:
                found[active[c]] = possible[scores[possible, c] > -np.inf]
                done[c] = True
        return done

    while len(active):
        open_ = float(impact[rows, taken].max(initial=0))
        if open_ <= 0:
            settle(np.arange(len(active)), np.zeros(len(active)), True)
            break
        least = min(least / 2, open_ / 2) if open_ < least else least / 2
        to = (impact > least).sum(axis=1)
        start = np.where(taken > 0, index.end[rows, np.maximum(taken - 1, 0)], 0)
        end = np.where(to > 0, index.end[rows, np.maximum(to - 1, 0)], 0)
        asked = np.ascontiguousarray(queries[active].T)
        for d in np.flatnonzero(end > start).tolist():
            at = slice(start[d], end[d])
            scores[index.at[d, at]] += index.value[d, at, None] * asked[d]
        taken = np.maximum(taken, to)
        rest = size[active] @ ahead[rows, taken]
        # The proof is tried where what is left is small beside the best score.
        hopeful = np.flatnonzero((rest > 0) & (4 * rest < scores.max(axis=0, initial=0))) if index.count > k else active[:0]
        if len(hopeful):
            left = ~settle(hopeful, rest[hopeful], False)
            if not left.all():
                scores, active = np.ascontiguousarray(scores[:, left]), active[left]
    return found


def search(index: Index, query: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """search_together of one query."""
    return search_together(index, query[None, :], [own], k)[0]


def _exact(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products as whole numbers, within a long."""
    asked = [int(x) for x in query.tolist()]
    return [max(-LONG - 1, min(LONG, sum(int(x) * y for x, y in zip(v, asked, strict=True)))) for v in vectors.tolist()]


def _best(ids: np.ndarray, scores: list[int] | np.ndarray, k: int) -> list[tuple[int, int]]:
    return sorted(zip((-s for s in (scores if isinstance(scores, list) else scores.tolist())), ids.tolist(), strict=True))[:k]


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, vectors) of the rows of each length."""
    lists = batch.column(1)
    offsets = lists.offsets.to_numpy()
    flat, ids, sizes = lists.values.to_numpy(), batch.column(0).to_numpy(), np.diff(offsets)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        yield n, ids[rows], flat[offsets[rows][:, None] + np.arange(n)[None, :]]


def best_of(candidates: DataFrame, queries: str, k: int) -> DataFrame:
    """BEST k candidates (vec_id, v) of each block of vectors for each query of the Parquet files below `queries`."""

    def answered(n: int, ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        greatest = np.abs(vectors).max(axis=1, initial=0)
        limit = np.sqrt(EXACT / max(n, 1))
        plain = np.flatnonzero(greatest < limit)
        wide = np.flatnonzero(greatest >= limit)  # few: their products are made as whole numbers of any size
        index = Index(vectors[plain])
        place = {}
        for at, i in enumerate(ids[plain].tolist()):
            place.setdefault(i, []).append(at)
        for batch in read_shared(queries, QUERIES):
            out: list[tuple[int, int, int]] = []
            for length, query_ids, asked in _vectors(batch):
                if length != n:
                    continue
                narrow = np.abs(asked).max(axis=1, initial=0) < limit
                for at in range(0, len(asked), TOGETHER):
                    part = np.arange(at, min(at + TOGETHER, len(asked)))
                    some = part[narrow[part]]
                    own = [np.asarray(place.get(q, []), np.int64) for q in query_ids[some].tolist()]
                    members = dict(zip(some.tolist(), search_together(index, asked[some], own, k), strict=True))
                    for j in part.tolist():
                        q, query, found = int(query_ids[j]), asked[j], []
                        if j in members:
                            m = plain[members[j]]
                            found = _best(ids[m], (vectors[m] @ query).astype(np.int64), k)
                        others = wide[ids[wide] != q] if j in members else np.flatnonzero(ids != q)
                        if len(others):
                            found = sorted([*found, *_best(ids[others], _exact(vectors[others], query), k)])[:k]
                        out += [(q, i, -s) for s, i in found]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for n, ids, vectors in _vectors(batch):
                for at in range(0, len(ids), VECTORS):
                    own = held.setdefault(n, [])
                    own.append((ids[at : at + VECTORS], vectors[at : at + VECTORS]))
                    if sum(len(i) for i, _ in own) >= VECTORS:
                        yield from answered(n, np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own]))
                        held[n] = []
        for n, own in held.items():
            if own:
                yield from answered(n, np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own]))

    return candidates.mapInArrow(found, BEST)


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every other row for each row that asks."""
    i, v = F.col(vec_id), F.col(embedding)
    usable = embeddings.where(i.isNotNull() & finite(v))
    vectors = usable.select(i.cast("long").alias("vec_id"), quantise(v).alias("v"))
    queries = usable.where(is_query).groupBy(i.cast("long").alias("vec_id")).agg(F.min(quantise(v)).alias("v"))
    found = best_of(vectors, materialise_at(queries, "queries"), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_SQL = {
    "op4_exact_topk": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
