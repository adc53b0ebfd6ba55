"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.scale import drop_work, work_path

#: Groups with more than one HOT_SHARE-th of all rows are broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 200
WORDS = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Written intermediate tables of one operator call, dropped as soon as nothing reads them any more."""

    def __init__(self, session):
        self.session, self.paths = session, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = self.paths[name] = work_path(self.session)
        df.write.parquet(path)
        return self.session.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            drop_work(self.session, self.paths.pop(name))


def give_back() -> None:
    """Give memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A task function that gives memory back to the system when it ends: Python workers serve many tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """The rows in one struct `row`, which no column of the caller's can clash with, and further columns."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *columns)


def fresh(name: str, taken: list[str]) -> str:
    """`name`, made longer until no column is called so, in any case of letters."""
    known = {t.lower() for t in taken}
    while name in known:
        name += "_"
    return name


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Give every row the values of its group, where one group may hold any share of the rows.

    `groups` has one row per key with its row count `size`. The groups above 1 / HOT_SHARE of all rows, fewer than
    HOT_SHARE by that definition, are broadcast, so their rows stay where they are; the rest meet by a shuffle in which
    no key is large. Both inputs should be stored, they are read twice.
    """
    total = groups.agg(F.sum(size).alias("n")).first()["n"] or 0
    hot = groups.filter(F.col(size) > total // HOT_SHARE)
    cold = groups.filter(F.col(size) <= total // HOT_SHARE)
    columns = [c for c in groups.columns if c != key]
    of_hot = rows.join(F.broadcast(hot), key).select(*rows.columns, *columns)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return of_hot.unionByName(others.join(cold.hint("merge"), key).select(*rows.columns, *columns))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string column without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole, offsets.astype(np.int64)


def pieces(batch: pa.RecordBatch, weight: str | int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose column `weight` has about `limit` bytes each (a longer row stands alone)."""
    _, offsets = buffers(batch.column(weight))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components: (node, component) with the smallest node as component, for every node with an edge.

    Alternating large-star and small-star steps; each step is written to the shared folder, so that lineage stays
    short and lost executors cost one step. Only minima per node are aggregated, so a hub is no collected group.
    """
    scratch = Scratch(edges.sparkSession)
    low, high = F.least(a, b), F.greatest(a, b)
    now = scratch.write("0", edges.filter(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct())
    step, seen = 0, None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(f"l{step}", large.filter(F.col("u") != F.col("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.write(f"{step + 1}", small)
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"l{step}", f"{step}")
        if mark == seen:
            roots = after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        now, seen, step = after, mark, step + 1


__all__ = [
    "HOT_SHARE", "WORDS", "Scratch", "buffers", "components", "fresh", "give_back", "join_groups", "mix64", "packed", "pieces", "tidy",
]
