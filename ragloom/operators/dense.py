"""Exact vector search in numpy blocks.

Spark partitions the vectors; a task multiplies one block with another and returns only what survives, so the pairs of
a block are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions.scale import small_batches, top_k
from ragloom.operators.lexical import query_filters

SCORE_DIGITS = 9
BLOCK_VECTORS = 2_048
#: Bounds of a slice of queries that every task holds: its rows and the numbers in its vectors.
SLICE_QUERIES = 8_192
SLICE_VALUES = 4 << 20
QUERY_SLICE = 256


def _unit(flat: pa.Array, rows: int) -> np.ndarray:
    """Row-normalised matrix of a flat list column; a zero vector stays zero."""
    matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties by id."""
    live = np.flatnonzero(scores > -np.inf)
    if len(live) > k:
        edge = np.partition(scores[live], len(live) - k)[len(live) - k]
        live = live[scores[live] >= edge]
    return live[np.lexsort((ids[live], -scores[live]))[:k]]


def _batch(keys: list, ids: list, scores: list, types: tuple, names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(keys, types[0]), pa.array(ids, types[1]), pa.array(scores, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    return pa.string() if dict(df.dtypes)[name] == "string" else pa.int64()


def vector_topk(query_vectors: DataFrame, chunk_vectors: DataFrame, k: int) -> DataFrame:
    """Best `k` chunks per query by cosine similarity: (query_pk, chunk_id, score, rank).

    query_vectors: query_pk, embedding[, filter_process, filter_tags]; chunk_vectors: chunk_id, embedding
    [, process_name, tags]. A filter on a column that the chunks don't have filters nothing. Queries are cut into slices
    of bounded size that travel to the tasks, one pass over the chunks for each; the chunks are never shuffled, and a
    task returns k rows per query whatever it has read.
    """
    small_batches(query_vectors.sparkSession)
    wanted = query_vectors.filter(F.col("embedding").isNotNull()).select(
        "query_pk", "embedding", *query_filters(query_vectors)
    )
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding")).alias("values")).first()
    slices = max(1, -(-size["n"] // SLICE_QUERIES), -(-(size["values"] or 0) // SLICE_VALUES))
    hits = None
    for number in range(slices):
        part = wanted if slices == 1 else wanted.filter(F.pmod(F.xxhash64("query_pk"), F.lit(slices)) == number)
        found = _scan_topk(part, chunk_vectors, k)
        hits = found if hits is None else hits.unionByName(found)
    return top_k(hits, ["query_pk"], [F.col("score").desc(), F.col("chunk_id")], k)


def _hit_schema(query_vectors: DataFrame, chunk_vectors: DataFrame) -> str:
    types = dict(query_vectors.dtypes)["query_pk"], dict(chunk_vectors.dtypes)["chunk_id"]
    return "query_pk {}, chunk_id {}, score double".format(*types)


def _scan_topk(wanted: DataFrame, chunk_vectors: DataFrame, k: int) -> DataFrame:
    """One pass over the chunks; each task keeps the best k of every query so far and yields them at its end."""
    local = wanted.toArrow().combine_chunks()
    if local.num_rows == 0:
        return wanted.sparkSession.createDataFrame([], _hit_schema(wanted, chunk_vectors))
    queries = wanted.sparkSession.sparkContext.broadcast(
        (
            local["query_pk"].to_pylist(),
            _unit(local["embedding"].combine_chunks().flatten(), local.num_rows),
            local["_process"].to_pylist(),
            local["_tags"].to_pylist(),
        )
    )
    keep = [c for c in ("process_name", "tags") if c in chunk_vectors.columns]
    types = _arrow_type(wanted, "query_pk"), _arrow_type(chunk_vectors, "chunk_id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, matrix, processes, tag_sets = queries.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in (part for whole in batches for part in _parts(whole, BLOCK_VECTORS)):
            ids = np.array(batch.column("chunk_id").to_pylist())
            vectors = _unit(batch.column("embedding").flatten(), batch.num_rows)
            names = {c: np.array(batch.column(c).to_pylist(), dtype=object) for c in keep}
            for start in range(0, len(keys), QUERY_SLICE):
                similarity = np.round(matrix[start : start + QUERY_SLICE] @ vectors.T, SCORE_DIGITS)
                for row, scores in enumerate(similarity, start):
                    if processes[row] and "process_name" in names:
                        scores = np.where(names["process_name"] == processes[row], scores, -np.inf)
                    if tag_sets[row] and "tags" in names:
                        scores = np.where(np.isin(names["tags"].astype(str), tag_sets[row]), scores, -np.inf)
                    found = _best(scores, ids, k)
                    scores, near = scores[found], ids[found]
                    if row in best and len(found):
                        scores, near = np.concatenate([best[row][0], scores]), np.concatenate([best[row][1], near])
                        found = _best(scores, near, k)
                        scores, near = scores[found], near[found]
                    if len(found):
                        best[row] = scores, near
        if best:
            yield _batch(
                [keys[row] for row, (_, near) in best.items() for _ in near],
                [v for _, near in best.values() for v in near.tolist()],
                [v for scores, _ in best.values() for v in scores.tolist()],
                types, ["query_pk", "chunk_id", "score"],
            )

    vectors = chunk_vectors.filter(F.col("embedding").isNotNull()).select("chunk_id", "embedding", *keep)
    return vectors.mapInArrow(scan, _hit_schema(wanted, chunk_vectors))


def _parts(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
