"""Exact top-k inner products of many queries with all vectors, by tiled matrix products.

Queries are taken in slices of bounded size that are sent to all tasks. Each task multiplies its shard with the slice
tile by tile, keeps the best k of every query after each tile, and returns k rows per query at the end of the shard; the
lists of the shards are merged in a tree of bounded fan-in. Vectors are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.common import Scratch

#: Queries per slice (their vectors are in every task's memory) and vectors per tile.
SLICE = 4_096
TILE = 4_096
#: Lists that one merge step takes together.
FAN_IN = 32
SCHEMA = "query_id long, shard int, vec_id long, score long"


def quantised(vectors: DataFrame, id_column: str, vector: str, scale: int, keep: Sequence[str] = ()) -> DataFrame:
    """(vec_id, x, *keep): floor(scale * component) as doubles, for vectors without null or non-finite components."""
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf")))
    )
    values = F.transform(x, lambda v: _floor(v, scale))
    return vectors.filter(fine & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("vec_id"), values.alias("x"), *keep
    )


def _floor(value: Column, scale: int) -> Column:
    return F.floor(value.cast("double") * F.lit(float(scale))).cast("double")


def _matrix(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length `dim` as a matrix, and their row numbers."""
    lengths = np.diff(column.offsets.to_numpy())
    at = np.flatnonzero(lengths == dim)
    taken = column.take(pa.array(at)) if len(at) < len(column) else column
    return taken.flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim), at


def _product(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact integer inner products: the narrowest number type in which no partial sum rounds."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * max(queries.shape[1], 1)
    if bound < 2**24:
        return (queries.astype(np.float32) @ shard.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (queries @ shard.T).astype(np.int64)
    exact = np.array([[int(v) for v in row] for row in queries], object).reshape(queries.shape)
    other = np.array([[int(v) for v in row] for row in shard], object).reshape(shard.shape)
    product = exact.dot(other.T) if queries.shape[1] else np.zeros((len(queries), len(shard)), object)
    return np.clip(product, -(2**63) + 2, 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first columns of each row by (score descending, id ascending); columns must be in order of id."""
    if scores.shape[1] > k:
        masked = np.where(valid, scores, np.iinfo(np.int64).min + 1)
        edge = -np.partition(-masked, k - 1, axis=1)[:, k - 1 : k]
        above, ties = masked > edge, masked == edge
        room = k - above.sum(1, keepdims=True)
        take = above | (ties & (np.cumsum(ties, axis=1) <= room))
        at = np.flatnonzero(take) % scores.shape[1]
        at = at.reshape(len(scores), k)
    else:
        at = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.take_along_axis(scores, at, 1), ids[at], np.take_along_axis(valid, at, 1)


def _merge(a, b, k: int):
    scores, ids, valid = (np.concatenate([x, y], axis=1) for x, y in zip(a, b, strict=True))
    order = np.lexsort((ids, -scores, ~valid), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in (scores, ids, valid))


def _search(query_ids: np.ndarray, queries: list[tuple[int, np.ndarray, np.ndarray]], k: int):
    """`queries`: for each length of vectors the numbers of the queries and their matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for start in range(0, batch.num_rows, TILE):
                tile = batch.slice(start, TILE)
                ids = tile.column("vec_id").to_numpy()
                for dim, numbers, matrix in queries:
                    shard, at = _matrix(tile.column("x"), dim)
                    if not len(at):
                        continue
                    order = np.argsort(ids[at], kind="stable")
                    own = ids[at][order]
                    scores = _product(matrix, shard[order])
                    valid = query_ids[numbers][:, None] != own[None, :]
                    if best is None:
                        best = _nothing(len(query_ids), k)
                    found = _best(scores, own, valid, k)
                    merged = _merge(tuple(x[numbers] for x in best), found, k)
                    for whole, part in zip(best, merged, strict=True):
                        whole[numbers] = part
        if best is not None:
            scores, ids, valid = best
            row, column = np.nonzero(valid)
            shard_number = np.full(len(row), _partition(), np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[row]), pa.array(shard_number), pa.array(ids[row, column]), pa.array(scores[row, column])],
                ["query_id", "shard", "vec_id", "score"],
            )

    return run


def _nothing(n: int, k: int):
    return np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool)


def _partition() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k vectors with the highest integer inner product.

    Components count as floor(scale * x). Ties go to the smaller id; fewer than k rows come where there are fewer other
    vectors. Vectors that are null or hold a null or non-finite component, and null ids, take no part, neither as query
    nor as candidate. Only vectors of the query's own length are candidates. A query's own row is every row with its id;
    of rows that repeat an id, the query's vector is the smallest. An empty table, or one without queries, gives no rows.
    Products beyond 64 bits are cut to the largest long.

    One pass over the table per SLICE queries, so work is queries x vectors; a slice is a few MB.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    rows = quantised(vectors, id_column, vector, scale)
    asked = quantised(vectors.filter(is_query), id_column, vector, scale).groupBy("vec_id").agg(F.min("x").alias("x"))
    asked = scratch.write("queries", asked)
    count = asked.count()
    slices = max(1, -(-count // SLICE))
    by_slice = scratch.write("slices", asked.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices))))
    parts = []
    for number in range(slices):
        found = by_slice.filter(F.col("slice") == number).toPandas()
        ids = found["vec_id"].to_numpy(np.int64)
        lengths = np.array([len(x) for x in found["x"]], np.int64)
        queries = [
            (int(dim), np.flatnonzero(lengths == dim), np.stack([np.asarray(x) for x in found["x"][lengths == dim]]))
            for dim in np.unique(lengths)
        ]
        part = rows.mapInArrow(_search(ids, queries, k), SCHEMA) if len(ids) else spark.createDataFrame([], SCHEMA)
        parts.append(scratch.write(f"part{number}", part))
    lists = parts[0]
    for part in parts[1:]:
        lists = lists.unionByName(part)
    shards = (lists.agg(F.max("shard").alias("n")).first()["n"] or 0) + 1
    while shards > FAN_IN:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        lists = _first(lists, ["query_id", "shard"], k).drop("rank")
        shards = -(-shards // FAN_IN)
    return _first(lists, ["query_id"], k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
