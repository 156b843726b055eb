"""Exact dense retrieval: search, batches, named vectors, several branches, recommendation, reranking, distances.

Scores are doubles, better when higher. Every ranking ends with the id, so ties have one order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.constants import DEFAULT_K, MAX_K, MULTI_BRANCHES, RERANK_PREFETCH
from fathom.errors import require
from fathom.functions import vectors as V
from fathom.functions.payload import where
from fathom.operators import fusion

#: Query vectors that go to the executors at a time in a batch search: at most this many numbers.
BLOCK_NUMBERS = 1 << 22
#: Points that a task keeps for a block, of all its queries together.
BLOCK_FOUND = 1 << 20
#: Scores of a tile, which is all that a task makes at a time, and the queries in it.
TILE, TILE_QUERIES = 1 << 19, 256


def checked_k(k: int) -> int:
    require(isinstance(k, int) and 0 <= k <= MAX_K, "invalid_limit", f"limit must be 0 to {MAX_K}")
    return k


def checked_query(query: Sequence[float]) -> list[float]:
    values = [float(v) for v in query]
    require(bool(values) and all(map(math.isfinite, values)), "22023", "a query vector must be finite and not empty")
    return values


def scored(points: DataFrame, query: Sequence[float], metric: str = "cosine", using: str | None = None, vector: str = "vector") -> DataFrame:
    """Add ``score``; points without the vector are left out, one of another dimension is an error."""
    q = checked_query(query)
    own = F.element_at("vectors", using) if using else F.col(vector)
    return points.where(own.isNotNull()).withColumn("score", V.score(metric, V.literal(q), V.checked(own, len(q))))


def top(rows: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The k best, by score, then id: one bounded heap a task, merged once."""
    return rows.orderBy(F.desc("score"), F.asc(id_col)).limit(checked_k(k))


def search(
    points: DataFrame, query: Sequence[float], *, k: int = DEFAULT_K, metric: str = "cosine", using: str | None = None,
    payload_filter: dict | None = None,
) -> DataFrame:
    """SEARCH ... NEAR: filter, score, keep the best k. Exact, so any recall target holds."""
    return top(scored(where(points, payload_filter), query, metric, using), k)


def stored_vector(points: DataFrame, point_id: str, using: str | None = None) -> list[float]:
    """The vector of a point named as @id; an unknown id is an error."""
    own = F.element_at("vectors", using) if using else F.col("vector")
    row = points.where(F.col("id") == point_id).select(own.alias("v")).head()
    require(row is not None and row.v is not None, "point_not_found", f"no point {point_id} with that vector")
    return list(row.v)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    require(bool((lengths == dimension).all()), "22000", f"expected {dimension} dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products over the first axis, one after the other: equal columns have equal sums wherever they stand."""
    out = np.zeros(b.shape[1:])
    for x, y in zip(a, b, strict=True):
        out += x * y
    return out


class _Best:
    """The k best points of each query, by exact score, then id, kept in one table of at most about twice so many rows."""

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = np.ascontiguousarray(q.T), k, metric
        self.squares = _dots(self.q, self.q)
        self.sent = q / np.where(self.squares > 0, np.sqrt(self.squares), 1.0)[:, None] if metric == "cosine" else q
        self.bound = np.full(len(q), -np.inf)
        self.rows, self.new = None, []

    def add(self, m: np.ndarray, ids: np.ndarray) -> None:
        """Products find the candidates, with room for their rounding; those alone are scored pair by pair."""
        t = np.ascontiguousarray(m.T)
        squares = _dots(t, t)
        near, k = 16 * (len(t) + 4) * np.finfo(float).eps, self.k
        if self.metric == "cosine":
            m = m / np.where(squares > 0, np.sqrt(squares), 1.0)[:, None]
        for at in range(0, len(self.sent), TILE_QUERIES):
            part = slice(at, at + TILE_QUERIES)
            s, bound, own = self.sent[part] @ m.T, self.bound[part], self.squares[part]
            room = np.full(len(s), near)
            if self.metric == "dot":
                room = near * np.sqrt(own * squares.max())
            elif self.metric == "l2":
                s = 2 * s - squares - own[:, None]
                room, bound = near * (own + squares.max()), -bound * bound
            room = np.nan_to_num(room, nan=np.inf)
            least = bound - room
            found = ~(s < least[:, None])
            if s.shape[1] > k and np.count_nonzero(found) > 2 * k * len(s):
                within = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 2 * room
                found = ~(s < np.fmax(least, within)[:, None])
            i, j = np.nonzero(found)
            if len(i):
                self.new.append((i + at, self.exact(i + at, j, t, squares), ids[j]))
                if sum(len(x[0]) for x in self.new) > max(TILE, len(self.bound) * k):
                    self.settle()
        if sum(len(x[0]) for x in self.new) > len(self.bound) * k // 2:
            self.settle()

    def exact(self, i: np.ndarray, j: np.ndarray, t: np.ndarray, squares: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        for x, y in zip(self.q, t, strict=True):
            # differences, not the binomial formula: that loses digits for near vectors
            out += (x[i] - y[j]) ** 2 if self.metric == "l2" else x[i] * y[j]
        if self.metric == "l2":
            return -np.sqrt(out)
        if self.metric == "cosine":
            size = np.sqrt(self.squares[i] * squares[j])
            out = np.clip(np.divide(out, size, out=np.zeros_like(out), where=size != 0), -1.0, 1.0)
        return out

    def settle(self) -> None:
        i, s, ids = map(np.concatenate, zip(*([self.rows] if self.rows else []), *self.new, strict=True))
        order = np.lexsort((ids, np.where(np.isnan(s), -np.inf, -s), i))
        i, s, ids = i[order], s[order], ids[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        last = rank == self.k - 1
        self.bound[i[last]] = np.nan_to_num(s[last], nan=np.inf, posinf=np.inf, neginf=-np.inf)
        keep = rank < self.k
        self.rows, self.new = (i[keep], s[keep], ids[keep]), []


def batch_search(points: DataFrame, queries: DataFrame, *, k: int = DEFAULT_K, metric: str = "cosine") -> DataFrame:
    """(qid, id, score, rank): every query of (qid, vector) against every point of (id, vector), in matrix products.

    Queries go out in blocks of bounded size, products are made in tiles of bounded size; a task keeps k points a
    query, and only those are shuffled.
    """
    require(metric in V.METRICS, "invalid_metric", f"metric must be one of {V.METRICS}")
    checked_k(k)
    spark, kind = points.sparkSession, points.schema["id"].dataType.simpleString()
    qkind = queries.schema["qid"].dataType.simpleString()
    schema = f"qid {qkind}, id {kind}, score double"
    given = points.where(F.col("vector").isNotNull()).select("id", "vector")
    out, block, size = [], [], 0

    def run_block(rows: list) -> DataFrame:
        require(len({len(v) for _, v in rows}) == 1, "22000", "queries of one dimension are expected")
        sent = spark.sparkContext.broadcast(([name for name, _ in rows], np.stack([v for _, v in rows])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            best = _Best(q, k, metric)
            step = max(1, min(TILE // min(len(q), TILE_QUERIES), TILE // max(1, q.shape[1])))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    some = batch.slice(at, step)
                    own = some.column(0)
                    ids = own.to_numpy(zero_copy_only=False) if pa.types.is_integer(own.type) and not own.null_count else np.array(own.to_pylist(), object)
                    with np.errstate(all="ignore"):
                        best.add(_matrix(some.column(1), q.shape[1]), ids)
            if best.new:
                best.settle()
            i, s, ids = best.rows or (np.zeros(0, int), np.zeros(0), np.zeros(0, object))
            names = np.array(names, object)
            for at in range(0, len(i), TILE // 8):
                part = slice(at, at + TILE // 8)
                frame = pd.DataFrame({"qid": names[i[part]], "id": ids[part], "score": s[part]})
                yield pa.RecordBatch.from_pandas(frame, schema=target, preserve_index=False)

        return given.mapInArrow(run, schema)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    target = pa.schema([("qid", kinds[qkind]), ("id", kinds[kind]), ("score", pa.float64())])
    asked = queries.where(F.col("vector").isNotNull()).select("qid", "vector").toLocalIterator() if k else ()
    for row in asked:
        block.append((row.qid, np.array(row.vector, np.float64)))
        size += len(row.vector)
        if size >= BLOCK_NUMBERS or len(block) * k >= BLOCK_FOUND:
            out.append(run_block(block))
            block, size = [], 0
    if block:
        out.append(run_block(block))
    if not out:
        return spark.createDataFrame([], schema + ", rank int")
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)


def multi_search(
    points: DataFrame, queries: Sequence[Sequence[float]], *, k: int = DEFAULT_K, metric: str = "cosine", mode: str = "rrf",
    weights: Sequence[float] | None = None, payload_filter: dict | None = None,
) -> DataFrame:
    """MULTI: one search a branch, fused. Without a mode branches fuse by rank, which is this engine's choice."""
    require(1 <= len(queries) <= MULTI_BRANCHES, "invalid_branches", f"1 to {MULTI_BRANCHES} branches")
    weights = list(weights or [1.0] * len(queries))
    require(len(weights) == len(queries), "invalid_weights", "one weight a branch")
    branches = [search(points, q, k=k, metric=metric, payload_filter=payload_filter).select("id", "score") for q in queries]
    return top(fusion.fuse_many(branches, mode, weights), k)


def recommend(
    points: DataFrame, like: Sequence[str], unlike: Sequence[str] = (), *, k: int = DEFAULT_K, metric: str = "cosine",
    using: str | None = None, payload_filter: dict | None = None,
) -> DataFrame:
    """RECOMMEND: near the mean of liked less the mean of unliked points, of length one; seeds are left out.

    The arithmetic is this engine's choice.
    """
    require(len(like) > 0, "invalid_seeds", "at least one liked point")
    seeds = [*dict.fromkeys([*like, *unlike])]
    own = F.element_at("vectors", using) if using else F.col("vector")
    found = {r.id: np.array(r.v, float) for r in points.where(F.col("id").isin(seeds)).select("id", own.alias("v")).collect() if r.v is not None}
    require(all(s in found for s in seeds), "point_not_found", "a seed is unknown or has no such vector")
    v = np.mean([found[s] for s in like], axis=0)
    if unlike:
        v = v - np.mean([found[s] for s in unlike], axis=0)
    size = np.linalg.norm(v)
    query = (v / size if size else v).tolist()
    return search(points.where(~F.col("id").isin(seeds)), query, k=k, metric=metric, using=using, payload_filter=payload_filter)


def rerank(
    points: DataFrame, query: Sequence[float], boosts: Sequence[tuple[str, object, float]], *, k: int = DEFAULT_K,
    prefetch: int | None = None, metric: str = "cosine", payload_filter: dict | None = None,
) -> DataFrame:
    """The best ``prefetch`` (three times k unless given), each score multiplied by every boost whose field matches."""
    depth = prefetch if prefetch is not None else min(MAX_K, RERANK_PREFETCH * k)
    first = search(points, query, k=depth, metric=metric, payload_filter=payload_filter)
    factor = F.lit(1.0)
    for field, value, boost in boosts:
        factor = factor * F.when(F.col(field) == F.lit(value), float(boost)).otherwise(1.0)
    return top(first.withColumn("score", F.col("score") * factor), k)


def order_by_distance(rows: DataFrame, operator: str, query: Sequence[float], *, k: int = DEFAULT_K, vector: str = "vector", id_col: str = "id") -> DataFrame:
    """ORDER BY v <op> literal LIMIT k: by the operator's own metric, nearest first."""
    q = checked_query(query)
    found = rows.where(F.col(vector).isNotNull()).withColumn("distance", V.distance(operator, V.literal(q), V.checked(F.col(vector), len(q))))
    return found.orderBy("distance", id_col).limit(checked_k(k))


def dims(vector: Column) -> Column:
    return F.when(vector.isNotNull(), F.size(vector))
