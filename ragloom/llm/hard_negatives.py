"""Hard negatives: rows of other labels whose inner product with an anchor is just below that of one of its positives.

Candidates are stored once as Parquet blocks in the order of a Hilbert curve, each with the minimum and maximum of every
dimension (its zone map). Interval arithmetic on a zone map bounds the scores an anchor can have in the block; a block
is read for the anchors whose score windows meet these bounds only. First each anchor reads the blocks whose middle
promises most, and what it finds there raises the lower ends of its windows before the other blocks are chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.common import Scratch
from ragloom.llm.topk_search import _best, _merge, _product, quantised

#: Rows of a block, and blocks that share a folder (folders without a wanted block are not opened).
BLOCK = 256
SHELF = 128
#: Dimensions and bits of each on the curve: those that vary most; a key has KEY_DIMS * KEY_BITS <= 63 bits.
KEY_DIMS, KEY_BITS = 9, 7
#: Anchors that one pass over the blocks serves, those multiplied together, and blocks each anchor reads first.
SLICE = 8_192
TILE = 512
PROBES = 2
LEAST, MOST = -(2**63) + 2, 2**63 - 1
BLOCKS_SCHEMA = (
    "label string, length int, block long, n int, low binary, high binary, ids binary, vectors binary, shelf long"
)


# ---- curve and blocks ------------------------------------------------------------------------------------------------


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points with coordinates below 2**bits; at most 63 bits in all."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    if not dims:
        return np.zeros(len(points), np.int64)
    one = np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        low = np.uint64((1 << bit) - 1)
        for n in range(dims):
            flip = ((x[n] >> np.uint64(bit)) & one).astype(bool)
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[n]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[n] ^= swap
    for n in range(1, dims):
        x[n] ^= x[n - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(((x[-1] >> np.uint64(bit)) & one).astype(bool), np.uint64((1 << bit) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for n in range(dims):
            key = (key << one) | ((x[n] >> np.uint64(bit)) & one)
    return key.astype(np.int64)


def _matrices(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the lists of each length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield int(length), at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), length)


RANGES_SCHEMA = "length int, dim int, n long, total double, squares double, low double, high double"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for length, _, x in _matrices(batch.column("x")):
            with np.errstate(over="ignore"):
                parts = [x.sum(0), (x * x).sum(0), x.min(0), x.max(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(length, length, np.int32)), pa.array(np.arange(length, dtype=np.int32)),
                 pa.array(np.full(length, len(x))), *[pa.array(p) for p in parts]],
                ["length", "dim", "n", "total", "squares", "low", "high"],
            )


def _curves(ranges: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of vectors: the dimensions on the curve, their minima and widths."""
    found = {}
    for length, rows in ranges.groupby("length"):
        rows = rows.sort_values("dim")
        with np.errstate(over="ignore", invalid="ignore"):
            variance = np.nan_to_num((rows["squares"] / rows["n"] - (rows["total"] / rows["n"]) ** 2).to_numpy())
        dims = np.argsort(-variance, kind="stable")[:KEY_DIMS]
        low, high = rows["low"].to_numpy()[dims], rows["high"].to_numpy()[dims]
        found[int(length)] = (dims, low, np.maximum(high - low, 1.0))
    return found


def _keyed(curves):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, size = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
            for length, at, x in _matrices(batch.column("x")):
                size[at] = length
                if length:
                    dims, low, width = curves[length]
                    with np.errstate(over="ignore", invalid="ignore"):
                        share = np.nan_to_num((x[:, dims] - low) / width)
                    key[at] = hilbert_keys(np.clip(share * (1 << KEY_BITS), 0, (1 << KEY_BITS) - 1), KEY_BITS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(size), pa.array(key), batch.column("vec_id"), batch.column("x")],
                ["label", "length", "key", "vec_id", "x"],
            )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most BLOCK neighbouring rows with one label and length."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    number = 0
    for batch in batches:
        labels = np.array(batch.column("label").to_pylist(), object)
        length, ids, x = batch.column("length").to_numpy(), batch.column("vec_id").to_numpy(), batch.column("x")
        changes = np.flatnonzero((labels[1:] != labels[:-1]) | (length[1:] != length[:-1])) + 1
        for start, end in zip([0, *changes], [*changes, batch.num_rows], strict=True):
            for first in range(start, end, BLOCK):
                last = min(first + BLOCK, end)
                order = np.argsort(ids[first:last], kind="stable")
                own = x.slice(first, last - first).flatten().to_numpy(zero_copy_only=False)
                own = own.reshape(last - first, length[first])[order]
                yield pa.RecordBatch.from_pylist([{
                    "label": labels[first], "length": int(length[first]), "block": (task << 32) | number,
                    "n": last - first, "low": own.min(0).tobytes(), "high": own.max(0).tobytes(),
                    "ids": ids[first:last][order].tobytes(), "vectors": own.tobytes(),
                    "shelf": (task << 24) | (number // SHELF),
                }], schema=_BLOCKS)
                number += 1


_BLOCKS = pa.schema([
    ("label", pa.string()), ("length", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("low", pa.binary()),
    ("high", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary()), ("shelf", pa.int64()),
])


def write_blocks(rows: DataFrame, path: str) -> DataFrame:
    """Store rows (vec_id, label, x) as blocks in curve order, one folder per shelf; returns the stored table."""
    spark = rows.sparkSession
    ranges = rows.mapInArrow(_ranges, RANGES_SCHEMA).groupBy("length", "dim").agg(
        *[F.sum(c).alias(c) for c in ("n", "total", "squares")], F.min("low").alias("low"), F.max("high").alias("high")
    )
    # One row per length and dimension.
    curves = _curves(ranges.toPandas())
    order = ["label", "length", "key", "vec_id"]
    keyed = rows.mapInArrow(_keyed(curves), "label string, length int, key long, vec_id long, x array<double>")
    sorted_ = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_.mapInArrow(_packed, BLOCKS_SCHEMA).write.partitionBy("shelf").parquet(path)
    return spark.read.schema(BLOCKS_SCHEMA).parquet(path)


# ---- anchors and windows ---------------------------------------------------------------------------------------------


@dataclass
class Slice:
    """Anchors with their score windows; `floor` is the lower end once `k` better rows are known."""

    ids: np.ndarray
    labels: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]
    same: bool
    k: int
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray
    read: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, found: pd.DataFrame, k: int) -> Slice:
        lengths = np.array([len(x) for x in found["x"]], np.int64)
        by_length = {}
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            by_length[int(length)] = at, np.array([found["x"].iloc[n] for n in at], np.float64).reshape(len(at), length)
        low, high = np.full((len(found), 1), LEAST), np.full((len(found), 1), MOST)
        labels = found["label"].to_numpy(object)
        return cls(found["vec_id"].to_numpy(np.int64), labels, by_length, True, k, low, high, low)

    def wanting(self, low: np.ndarray, high: np.ndarray, same: bool) -> Slice:
        return Slice(self.ids, self.labels, self.by_length, same, self.k, low, high, low)

    def bounds(self, length: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor numbers, and the least and largest score each can have in each block."""
        at, x = self.by_length[length]
        up, down = np.maximum(x, 0), np.minimum(x, 0)
        least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        size = np.abs(x) @ np.maximum(np.abs(low), np.abs(high)).T
        if size.max(initial=0) >= 2**53:  # sums may round
            slack = size * 2.0**-40
            least, most = least - slack, most + slack
        return at, least, most

    def wanted(self, length: int, labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchor numbers, and whether each needs each block: a window meets the block's bounds and its label fits."""
        at, least, most = self.bounds(length, low, high)
        meets = np.zeros(least.shape, bool)
        for n in range(self.low.shape[1]):
            meets |= (most >= self.floor[at, n, None]) & (least <= self.high[at, n, None])
        meets &= (self.labels[at][:, None] == labels[None, :]) == self.same
        return at, meets


def _tiles(slice_: Slice, batches: Iterator[pa.RecordBatch]):
    """(batch, row numbers, length, labels, low, high) for the blocks of each length the anchors have."""
    for batch in batches:
        length = batch.column("length").to_numpy()
        labels = np.array(batch.column("label").to_pylist(), object)
        for own in np.unique(length):
            if int(own) not in slice_.by_length:
                continue
            at = np.flatnonzero(length == own)
            for start in range(0, len(at), BLOCK):
                part = at[start : start + BLOCK]
                low, high = (
                    np.array([np.frombuffer(batch.column(c)[int(n)].as_buffer(), np.float64) for n in part]).reshape(len(part), own)
                    for c in ("low", "high")
                )
                yield batch, part, int(own), labels[part], low, high


def _promising(slice_: Slice):
    """For each anchor the blocks with the highest score of their middle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch, part, length, labels, low, high in _tiles(slice_, batches):
            at, least, most = slice_.bounds(length, low, high)
            fine = (slice_.labels[at][:, None] == labels[None, :]) == slice_.same
            middle = np.where(np.isfinite(least + most), (least + most) / 2, 0.0)
            blocks = batch.column("block").to_numpy()[part]
            shelves = batch.column("shelf").to_numpy()[part]
            if best is None:
                shape = (len(slice_.ids), PROBES)
                best = [np.full(shape, -np.inf), np.zeros(shape, np.int64), np.zeros(shape, np.int64)]
            scores = np.concatenate([best[0][at], np.where(fine, middle, -np.inf)], axis=1)
            order = np.argsort(-scores, axis=1, kind="stable")[:, :PROBES]
            best[0][at] = np.take_along_axis(scores, order, 1)
            for n, values in ((1, blocks), (2, shelves)):
                whole = np.concatenate([best[n][at], np.broadcast_to(values, (len(at), len(values)))], axis=1)
                best[n][at] = np.take_along_axis(whole, order, 1)
        if best is not None:
            row, column = np.nonzero(best[0] > -np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row.astype(np.int32)), *[pa.array(b[row, column]) for b in best]],
                ["anchor", "score", "block", "shelf"],
            )

    return run


def _shelves(slice_: Slice):
    """The shelves that hold a block some anchor still needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[int] = set()
        for batch, part, length, labels, low, high in _tiles(slice_, batches):
            _, meets = slice_.wanted(length, labels, low, high)
            found.update(batch.column("shelf").to_numpy()[part[meets.any(axis=0)]].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], ["shelf"])

    return run


def _scores(slice_: Slice, probes: dict[int, np.ndarray] | None):
    """The best `k` rows of every window among the blocks read: those of `probes`, else those the bounds choose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, shape = slice_.low.shape[1], (len(slice_.ids), slice_.k)
        best = None
        for batch, part, length, labels, low, high in _tiles(slice_, batches):
            own, x = slice_.by_length[length]
            place = {int(n): row for row, n in enumerate(own)} if probes is not None else None
            at, meets = slice_.wanted(length, labels, low, high) if probes is None else (own, None)
            for column, n in enumerate(part):
                block = batch.column("block")[int(n)].as_py()
                if probes is not None:
                    rows = np.array([place[int(a)] for a in probes.get(block, ()) if int(a) in place], np.int64)
                else:
                    rows = np.flatnonzero(meets[:, column])
                    seen = slice_.read.get(block)
                    rows = rows[~np.isin(at[rows], seen)] if seen is not None else rows
                if not len(rows):
                    continue
                ids = np.frombuffer(batch.column("ids")[int(n)].as_buffer(), np.int64)
                vectors = np.frombuffer(batch.column("vectors")[int(n)].as_buffer(), np.float64).reshape(len(ids), length)
                for start in range(0, len(rows), TILE):
                    some = rows[start : start + TILE]
                    anchors = own[some]
                    scores = _product(x[some], vectors)
                    other = slice_.ids[anchors][:, None] != ids[None, :]
                    for w in range(windows):
                        valid = other & (scores >= slice_.low[anchors, w, None]) & (scores <= slice_.high[anchors, w, None])
                        hit = valid.any(axis=1)
                        if not hit.any():
                            continue
                        if best is None:
                            best = [[np.zeros((*shape, windows), np.int64) for _ in range(2)], np.zeros((*shape, windows), bool)]
                        mine = anchors[hit]
                        known = (best[0][0][mine, :, w], best[0][1][mine, :, w], best[1][mine, :, w])
                        merged = _merge(known, _best(scores[hit], ids, valid[hit], slice_.k), slice_.k)
                        best[0][0][mine, :, w], best[0][1][mine, :, w], best[1][mine, :, w] = merged
        if best is not None:
            row, column, window = np.nonzero(best[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row.astype(np.int32)), pa.array(window.astype(np.int32)),
                 pa.array(best[0][1][row, column, window]), pa.array(best[0][0][row, column, window])],
                ["anchor", "window", "vec_id", "score"],
            )

    return run


HITS = "anchor int, window int, vec_id long, score long"


def _first(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def search(blocks: DataFrame, slice_: Slice, scratch: Scratch, name: str) -> DataFrame:
    """(anchor, window, rank, vec_id, score): the best `k` rows of every window of every anchor of the slice."""
    zones = blocks.select("label", "length", "block", "low", "high", "shelf")
    promising = zones.mapInArrow(_promising(slice_), "anchor int, score double, block long, shelf long")
    # At most PROBES rows for each anchor of the slice.
    chosen = _first(promising, ["anchor"], PROBES, F.col("score").desc(), F.col("block")).toPandas()
    slice_.read = {int(block): rows["anchor"].to_numpy() for block, rows in chosen.groupby("block")}
    order = (F.col("score").desc(), F.col("vec_id"))
    nearby = blocks.filter(F.col("shelf").isin([int(s) for s in chosen["shelf"].unique()]))
    early = scratch.write(f"{name}early", _first(
        nearby.mapInArrow(_scores(slice_, slice_.read), HITS), ["anchor", "window"], slice_.k, *order
    ).drop("rank"))
    full = early.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    known = full.filter(F.col("n") == slice_.k).toPandas()
    floor = slice_.low.copy()
    floor[known["anchor"], known["window"]] = np.maximum(floor[known["anchor"], known["window"]], known["least"])
    slice_.floor = floor
    shelves = [r["shelf"] for r in zones.mapInArrow(_shelves(slice_), "shelf long").distinct().collect()]
    late = blocks.filter(F.col("shelf").isin(shelves)).mapInArrow(_scores(slice_, None), HITS)
    return _first(early.unionByName(late), ["anchor", "window"], slice_.k, *order)


RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 5,
    least_percent: int = 80,
    scale: int = 256,
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components count as floor(scale * x). Of the rows with an anchor's label the `positives` with the highest inner product
    are its positives; for each of them the `negatives` rows of other labels with the highest score between `least_percent`
    of the positive's and the positive's own come, from rank 1. Ties go to the smaller id. An anchor or positive without
    such rows has none; there are none below a positive with a negative score.

    Rows without id or label, with a null vector or a null or non-finite component take no part. Only vectors of the
    anchor's length are compared. Labels are compared as strings. An anchor never meets rows with its own id; of anchors
    that repeat an id the smallest (label, vector) stands for all, other rows that repeat are rows of their own. An empty
    table, and one without anchors, gives no rows. Products beyond 64 bits are cut to the largest long.

    One pass over zone maps and the blocks they leave per SLICE anchors, twice: for positives and for negatives.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    labelled = vectors.select(
        F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{vector}`").alias("embedding"),
        (F.col(f"`{label}`") if isinstance(label, str) else label).cast("string").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).filter(F.col("label").isNotNull())
    rows = scratch.write("rows", quantised(labelled, "vec_id", "embedding", scale, keep=["label", "anchor"]))
    asked = rows.filter("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("own"))
    asked = scratch.write("asked", asked.select("vec_id", "own.label", "own.x"))
    slices = max(1, -(-asked.count() // SLICE))
    path = scratch.paths["blocks"] = f"{scratch.paths['rows']}-blocks"
    blocks = write_blocks(rows.drop("anchor"), path)
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)))
    parts = []
    for number in range(slices):
        # About SLICE anchors.
        slice_ = Slice.of(asked.filter(F.col("slice") == number).toPandas(), positives)
        if not len(slice_.ids):
            continue
        best = search(blocks, slice_, scratch, f"p{number}").toPandas()
        low = np.ones((len(slice_.ids), positives), np.int64)
        high, ids = np.zeros_like(low), np.zeros_like(low)
        at = best["anchor"].to_numpy(), best["rank"].to_numpy() - 1
        high[at], ids[at] = best["score"], best["vec_id"]
        fine = np.zeros(low.shape, bool)
        fine[at] = best["score"] >= 0
        # The least integer that is at least the share of the score, without overflow.
        part = high // 100 * least_percent - -(high % 100 * least_percent) // 100
        low, high = np.where(fine, part, 1), np.where(fine, high, 0)
        wanting = slice_.wanting(low, high, same=False)
        wanting.k = negatives
        found = search(blocks, wanting, scratch, f"n{number}")
        names = spark.createDataFrame(pd.DataFrame({
            "anchor": np.repeat(np.arange(len(low), dtype=np.int32), positives),
            "window": np.tile(np.arange(positives, dtype=np.int32), len(low)),
            "anchor_id": np.repeat(slice_.ids, positives), "positive_id": ids.reshape(-1), "positive_score": high.reshape(-1),
        }))
        parts.append(scratch.write(f"part{number}", found.join(F.broadcast(names), ["anchor", "window"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )))
    if not parts:
        return spark.createDataFrame([], RESULT)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
