"""Exact top-k by inner product: columnar branch-and-bound.

Vectors become integers, stored by dimension. What the dimensions still to
come can add to a score is at most the product of the two remaining lengths
(Cauchy-Schwarz), so a candidate whose score so far and this bound stay
below a query's k-th best is dropped.

1. Each query is scored against a bounded sample of the vectors. The k-th
   best of these is a lower bound of its k-th best of all.
2. Queries are taken in blocks of bounded size, each broadcast with these
   bounds and searched against every partition. Scores are accumulated a
   block of dimensions at a time, at first for many queries at once. As soon
   as half of the pairs are dropped, each query goes on alone with its
   surviving candidates moved together, and compacts them after each block.
3. A partition returns at most k rows a query, none below the query's bound,
   of which the k best are taken.

Scores are whole numbers: in floats below 2**24, in doubles below 2**53, in
64-bit integers (slower) beyond; a score that no long may hold raises an
error. All pairs are looked at, so time grows with queries times vectors.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows without an id; shorter vectors count
as filled with zeros; equal scores go to the smaller id; with fewer
candidates than k all are returned; a query repeated with the same vector
counts once, repeated candidates count each; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, ship

#: Queries broadcast at once; with 64 dimensions of 8 bytes 16 MB.
QUERY_BLOCK = 32_768
#: Vectors in the sample that gives the first bounds, about; 8 MB.
SEEDS = 16_384
_ROWS, _QUERIES, _DIMENSIONS = 8_192, 256, 8
_OUT = "query_id bigint, vec_id bigint, score bigint"
#: Makes up for rounding in bounds.
_SLACK = 1e-9


def whole_vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id and floor(scale * x) of each component, of the rows that take part."""
    values = F.col("embedding").cast("array<double>")
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("bigint"), values.alias("x"), bad.alias("bad"))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & ~F.col("bad"))
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("x"))


class Search:
    """k best of a stream of vectors for a block of queries, from lower bounds of their k-th best."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int, exact: type):
        # Heavy dimensions first: the remaining lengths shrink sooner.
        self.order = np.argsort(-(queries.astype(float) ** 2).sum(0), kind="stable")
        self.ids, self.k, self.least = ids, k, least.astype(float)
        self.queries = queries[:, self.order].astype(exact)
        self.rest = self._rest(self.queries)
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        #: Pairs that were scored in each block of dimensions.
        self.scored = np.zeros(len(self.rest), np.int64)

    @staticmethod
    def _rest(rows: np.ndarray) -> np.ndarray:
        """Length of what each block of dimensions leaves to come, per row."""
        squares = rows.astype(float) ** 2
        ends = range(_DIMENSIONS, rows.shape[1] + _DIMENSIONS, _DIMENSIONS)
        return np.stack([np.sqrt(squares[:, end:].sum(1)) for end in ends])

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        vectors = vectors[:, self.order].astype(self.queries.dtype)
        columns, rest = np.ascontiguousarray(vectors.T), self._rest(vectors)
        for first in range(0, len(self.ids), _QUERIES):
            self._add(slice(first, first + _QUERIES), ids, columns, rest)

    def _add(self, own: slice, ids: np.ndarray, columns: np.ndarray, rest: np.ndarray) -> None:
        queries, least = self.queries[own], self.least[own, None]
        scores = np.zeros((len(queries), len(ids)), queries.dtype)
        alive = np.ones(scores.shape, bool)
        block = 0
        while block < len(rest) and 2 * np.count_nonzero(alive) > alive.size:
            part = slice(block * _DIMENSIONS, (block + 1) * _DIMENSIONS)
            self.scored[block] += scores.size
            scores += queries[:, part] @ columns[part]
            more = self.rest[block][own][:, None] * rest[block]
            alive = scores + more + (np.abs(scores) + more) * _SLACK >= least
            block += 1
        for row in range(len(queries)):
            self._alone(own.start + row, np.flatnonzero(alive[row]), scores[row], block, ids, columns, rest)

    def _alone(self, q: int, left: np.ndarray, scores: np.ndarray, block: int, ids, columns, rest) -> None:
        """What is left of the candidates of one query, over the dimensions still to come."""
        query, least, scores = self.queries[q], self.least[q], scores[left]
        for at in range(block, len(rest)):
            if not len(left):
                return
            part = slice(at * _DIMENSIONS, (at + 1) * _DIMENSIONS)
            self.scored[at] += len(left)
            scores = scores + query[part] @ columns[part, left]
            more = self.rest[at][q] * rest[at][left]
            alive = scores + more + (np.abs(scores) + more) * _SLACK >= least
            left, scores = left[alive], scores[alive]
        other = ids[left] != self.ids[q]
        if not other.any():
            return
        best, found = self.best[q]
        best = np.concatenate([best, scores[other].astype(np.int64)])
        found = np.concatenate([found, ids[left][other]])
        take = np.lexsort((found, -best))[: self.k]
        self.best[q] = best[take], found[take]
        if len(take) == self.k:
            self.least[q] = max(least, float(best[take[-1]]))

    def rows(self) -> pa.RecordBatch:
        counts = [len(found) for _, found in self.best]
        none = [np.empty(0, np.int64)]
        scores = np.concatenate([scores for scores, _ in self.best] + none)
        found = np.concatenate([ids for _, ids in self.best] + none)
        query = np.repeat(self.ids, counts)
        arrays = [pa.array(a, pa.int64()) for a in (query, found, scores)]
        return pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])


def first_bounds(ids: np.ndarray, queries: np.ndarray, seeds: tuple, k: int, exact: type) -> np.ndarray:
    """The k-th best score of each query within the sample, and the least number there is if that has fewer."""
    seed_ids, vectors = seeds
    least = np.full(len(ids), np.iinfo(np.int64).min)
    columns = vectors.astype(exact).T
    for first in range(0, len(ids), _QUERIES):
        own = slice(first, first + _QUERIES)
        scores = queries[own].astype(exact) @ columns
        other = seed_ids[None, :] != ids[own, None]
        enough = other.sum(1) >= k
        if enough.any():
            lowest = scores.dtype.type(-np.inf) if scores.dtype.kind == "f" else np.iinfo(np.int64).min
            scores = np.where(other, scores, lowest)
            least[own][enough] = np.partition(scores, -k, axis=1)[:, -k][enough].astype(np.int64)
    return least


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, filled with zeros up to `width`."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _packed(rows: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and whole vectors of rows that bring these as bytes."""
    matrix = np.zeros((len(rows), width), np.int64)
    for line, row in zip(matrix, rows, strict=True):
        line[:] = np.frombuffer(row["x"], np.int64)
    return np.array([row["vec_id"] for row in rows], np.int64), matrix


def _bytes(width: int):
    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [row.tobytes() for row in _matrix(batch.column("x"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(x, pa.binary())], ["vec_id", "x"])

    return as_bytes


def _bounded(queries: DataFrame, seeds, k: int, width: int, exact: type) -> DataFrame:
    """The queries with x as bytes and a lower bound of their k-th best score."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            x = _matrix(batch.column("x"), width)
            least = first_bounds(ids, x, seeds.value, k, exact)
            arrays = [pa.array(ids), pa.array([row.tobytes() for row in x], pa.binary()), pa.array(least)]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "x", "least"])

    return queries.mapInArrow(bounded, "vec_id bigint, x binary, least bigint")


def _searched(rows: DataFrame, block, k: int, width: int, exact: type) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Search(*block.value, k, exact)
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                some = batch.slice(first, _ROWS)
                ids = some.column("vec_id").to_numpy(zero_copy_only=False)
                state.add(ids, _matrix(some.column("x"), width))
        yield state.rows()

    return rows.mapInArrow(search, _OUT)


def top_k(
    embeddings: DataFrame,
    *,
    k: int = 20,
    every: int = 20,
    scale: int = 64,
    query_block: int = QUERY_BLOCK,
    seeds: int = SEEDS,
) -> DataFrame:
    """query_id, rank, vec_id and score; queries are ids divisible by `every`."""
    spark = embeddings.sparkSession
    ship(spark)
    rows = whole_vectors(embeddings, scale)
    square = F.aggregate("x", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    widest, most, n = rows.agg(F.max(F.size("x")), F.max(square), F.count("*")).first()
    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    if not n:
        return rows.select(
            F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score")
        )
    # No score, nor any sum on the way to it, is above the largest square of a length.
    if most >= 2**63:
        raise ValueError(f"scores up to {most:.3g} don't fit a long")
    exact = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    spread = F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(1 << 40))
    sample = rows.where(spread < math.ceil(min(1.0, seeds / n) * (1 << 40)))
    sample = _packed(sample.mapInArrow(_bytes(widest), "vec_id bigint, x binary").collect(), widest)
    queries = cut(_bounded(queries, spark.sparkContext.broadcast(sample), k, widest, exact))
    pieces = max(1, math.ceil(queries.count() / query_block))
    piece = F.pmod(F.xxhash64("vec_id"), F.lit(pieces))
    found = None
    for p in range(pieces):
        own = queries.where(piece == p).collect()
        least = np.array([row["least"] for row in own], np.int64)
        block = spark.sparkContext.broadcast((*_packed(own, widest), least))
        part = _searched(rows, block, k, widest, exact)
        by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        part = part.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
        part = cut(part) if pieces > 1 else part
        found = part if found is None else found.union(part)
    return found.select("query_id", "rank", "vec_id", "score")
