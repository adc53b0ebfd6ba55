"""Exact similarity self-join of vectors whose blocks meet only where pivots can't keep them apart.

The angle between two vectors is a metric: if one lies at 20 degrees from a pivot and another at 80, they are at least 60
degrees apart. Vectors are dealt to the nearest of a bounded number of pivots, cut into blocks by their angle to it, and
each block keeps the interval of its angles to every pivot. Two blocks are multiplied only if no pivot's intervals are
further apart than the threshold allows; blocks are chosen by number, and vectors are shuffled for the chosen ones only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.scale import cut_lineage
from ragloom.operators.dense import BLOCK_VECTORS, SCORE_DIGITS, _arrow_type, _unit

#: Pivots at most, the sectors of the angle to a pivot in which vectors are counted, and blocks compared at once.
PIVOTS = 128
RINGS = 256
SLAB_BLOCKS = 512
#: Blocks that a task packs, and that a band holds on average: about 16 MB of vectors.
TASK_BLOCKS = 16
#: Bands at least (if there are as many blocks), and tasks that multiply pairs of bands at most.
BANDS = 16
BAND_TASKS = 4_096
#: Rows and columns of a block pair that are multiplied at once.
TILE_ROWS, TILE_COLUMNS = 256, 2_048
#: Added to the widest angle of a similar pair, against the rounding of angles (radians).
SLACK = 2e-6
#: Blocks of a cell have numbers from cell * CELL on.
CELL = 1 << 32


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _pivots(vectors: DataFrame, rows: int, total: int) -> np.ndarray:
    """Different vectors, the first by a hash of their key; one per block of the table, PIVOTS at most."""
    wanted = min(PIVOTS, max(2, -(-total // rows)))
    found = vectors.orderBy(F.xxhash64("id"), "id").limit(wanted).select("embedding").toArrow().combine_chunks()
    if not found.num_rows:
        return np.zeros((0, 0))
    unit = _unit(found["embedding"].combine_chunks().flatten(), found.num_rows)
    return np.unique(unit[np.isfinite(unit).all(axis=1)], axis=0)


def _pack(vectors: DataFrame, pivots: np.ndarray, threshold: float, rows: int, total: int) -> DataFrame:
    """Stored blocks of at most about 3 * `rows` vectors: block, cell, ids, flat, lo, hi (angles to each pivot)."""
    session = vectors.sparkSession
    shared = session.sparkContext.broadcast(pivots)
    id_type = dict(vectors.dtypes)["id"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("embedding").flatten()
            unit = _unit(flat, batch.num_rows)
            finite = np.isfinite(flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)).all(axis=1)
            fine = finite & ((threshold <= 0) | unit.any(axis=1))
            angles = _angles(unit[fine], shared.value)
            cells = angles.argmin(axis=1).astype(np.int32)
            ring = (angles.min(axis=1, initial=math.pi) * (RINGS / math.pi)).astype(np.int32)
            kept = batch.filter(pa.array(fine))
            yield pa.RecordBatch.from_arrays(
                [kept.column("id"), kept.column("embedding"), pa.array(cells), pa.array(ring)],
                names=["id", "embedding", "cell", "ring"],
            )

    schema = f"id {id_type}, embedding {dict(vectors.dtypes)['embedding']}, cell int, ring int"
    dealt = cut_lineage(vectors.mapInArrow(deal, schema))
    earlier = Window.partitionBy("cell").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
    # At most PIVOTS * RINGS rows, whatever the table holds.
    starts = dealt.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("_n")).select(
        "cell", "ring",
        F.floor(F.coalesce(F.sum("_n").over(earlier), F.lit(0)) / rows).alias("_base"),
        F.ceil(F.col("_n") / rows).alias("_split"),
    )
    number = F.col("cell").cast("long") * CELL + F.col("_base") + F.pmod(F.xxhash64("id"), F.col("_split"))
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-total // (rows * TASK_BLOCKS)))
    packed = (
        dealt.join(F.broadcast(starts), ["cell", "ring"])
        .select(number.alias("block"), "id", "embedding")
        .repartition(tasks, "block")
        .groupBy("block")
        .agg(F.collect_list(F.struct("id", F.col("embedding").alias("v"))).alias("_rows"))
        .select("block", F.col("_rows.id").alias("ids"), F.flatten("_rows.v").alias("flat"))
    )

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = [], []
            for i in range(batch.num_rows):
                flat = batch.column("flat")[i].values
                angles = _angles(_unit(flat, len(batch.column("ids")[i])), shared.value).astype(np.float32)
                lo.append(angles.min(axis=0))
                hi.append(angles.max(axis=0))
            cells = pa.array([b // CELL for b in batch.column("block").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), cells, batch.column("ids"), batch.column("flat"),
                 pa.array(lo, pa.list_(pa.float32())), pa.array(hi, pa.list_(pa.float32()))],
                names=["block", "cell", "ids", "flat", "lo", "hi"],
            )

    kinds = dict(packed.dtypes)
    schema = f"block long, cell int, ids {kinds['ids']}, flat {kinds['flat']}, lo array<float>, hi array<float>"
    return cut_lineage(packed.mapInArrow(bound, schema))


def _apart(lo: np.ndarray, hi: np.ndarray, other_lo: np.ndarray, other_hi: np.ndarray) -> np.ndarray:
    """Least angle between members of two groups each, from their intervals of angles to the pivots (columns)."""
    gap = np.zeros((len(lo), len(other_lo)), dtype=np.float32)
    for p in range(lo.shape[1]):
        np.maximum(gap, lo[:, p, None] - other_hi[None, :, p], out=gap)
        np.maximum(gap, other_lo[None, :, p] - hi[:, p, None], out=gap)
    return gap


def _cell_pairs(blocks: DataFrame, widest: float, pivots: int) -> list[tuple[int, int]]:
    """Pairs of cells that the threshold may connect; at most PIVOTS cells with PIVOTS intervals each are compared."""
    spans = (
        blocks.select("cell", F.posexplode(F.arrays_zip("lo", "hi")).alias("pivot", "_z"))
        .groupBy("cell", "pivot")
        .agg(F.min("_z.lo").alias("lo"), F.max("_z.hi").alias("hi"))
        .orderBy("cell", "pivot")
        .toPandas()
    )
    cells = spans["cell"].to_numpy().reshape(-1, pivots)[:, 0]
    lo, hi = (spans[c].to_numpy(dtype=np.float32).reshape(-1, pivots) for c in ("lo", "hi"))
    x, y = np.nonzero(np.triu(_apart(lo, hi, lo, hi) <= widest))
    return list(zip(cells[x].tolist(), cells[y].tolist()))


def block_pairs(
    vectors: DataFrame, key: str, threshold: float, rows: int = BLOCK_VECTORS
) -> tuple[DataFrame, DataFrame] | None:
    """(blocks, pairs) of a table of vectors (`key`, embedding): the blocks and those pairs of them that have to meet.

    blocks: block, cell, ids, flat, lo, hi; pairs: left_block <= block. None for a table without a usable vector.
    """
    session = vectors.sparkSession
    usable = vectors.filter(F.col(key).isNotNull() & F.col("embedding").isNotNull()).select(
        F.col(key).alias("id"), "embedding"
    )
    total = usable.count()
    pivots = _pivots(usable, rows, total)
    if not len(pivots):
        return None
    blocks = _pack(usable, pivots, threshold, rows, total)
    widest = math.pi if threshold <= 0 else math.acos(min(1.0, threshold - 10.0**-SCORE_DIGITS)) + SLACK
    slabs = (
        blocks.groupBy("cell", F.floor(F.col("block") / SLAB_BLOCKS).alias("slab"))
        .agg(F.collect_list(F.struct("block", "lo", "hi")).alias("members"))
    )
    others = slabs.select(*[F.col(c).alias(f"other_{c}") for c in slabs.columns])
    near = _cell_pairs(blocks, widest, len(pivots))
    if not near:
        return None
    cells = session.createDataFrame(near, "cell int, other_cell int")
    met = slabs.join(F.broadcast(cells), "cell").join(others, "other_cell").filter(
        (F.col("cell") != F.col("other_cell")) | (F.col("slab") <= F.col("other_slab"))
    )

    def matrix(members: pa.StructArray, name: str) -> np.ndarray:
        return members.field(name).flatten().to_numpy().reshape(len(members), -1)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = batch.column("members")[i].values, batch.column("other_members")[i].values
                one, other = left.field("block").to_numpy(), right.field("block").to_numpy()
                gap = _apart(matrix(left, "lo"), matrix(left, "hi"), matrix(right, "lo"), matrix(right, "hi"))
                keep = gap <= widest
                if batch.column("slab")[i].as_py() == batch.column("other_slab")[i].as_py():
                    keep &= one[:, None] <= other[None, :]
                x, y = np.nonzero(keep)
                low, high = np.minimum(one[x], other[y]), np.maximum(one[x], other[y])
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["left_block", "block"])

    chosen = met.select("slab", "members", "other_slab", "other_members").mapInArrow(
        choose, "left_block long, block long"
    )
    return blocks, cut_lineage(chosen)


def banded(pairs: DataFrame, count: int) -> tuple[DataFrame, int]:
    """(low, high, block, partners) for the pairs among `count` blocks, and the number of bands.

    Blocks are dealt to bands and a task multiplies two bands, so a block is shuffled once per band at most and not once
    per block that it meets. A block is multiplied with its partners there; one without partners is there for others.
    """
    bands = max(min(BANDS, count), -(-count // TASK_BLOCKS))
    left, right = F.col("left_block"), F.col("block")
    one, other = (F.pmod(F.xxhash64(x), F.lit(bands)).cast("int") for x in (left, right))
    side = lambda block, partner: F.struct(block.alias("block"), partner.alias("partner"))
    sides = F.inline(F.array(side(left, right), side(right, F.lit(None).cast("long"))))
    keyed = pairs.select(F.least(one, other).alias("low"), F.greatest(one, other).alias("high"), sides)
    return keyed.groupBy("low", "high", "block").agg(F.collect_list("partner").alias("partners")), bands


def similar_pairs(vectors: DataFrame, key: str, threshold: float, rows: int = BLOCK_VECTORS) -> DataFrame:
    """All pairs a < b with cosine similarity of at least `threshold`: (a, b, similarity).

    Exact for any threshold; without clusters the bounds exclude little and every block meets every block. A zero
    vector is similar to nothing at a positive threshold; vectors that are null or not finite and null keys have no pairs.
    """
    key_type = dict(vectors.dtypes)[key]
    schema = f"a {key_type}, b {key_type}, similarity double"
    dealt = block_pairs(vectors, key, threshold, rows)
    if dealt is None:
        return vectors.sparkSession.createDataFrame([], schema)
    blocks, pairs = dealt
    int_key = key_type != "string"
    types = _arrow_type(vectors, key), _arrow_type(vectors, key)

    needed, bands = banded(pairs, blocks.count())

    def keys_of(ids: pa.Array) -> np.ndarray:
        return ids.to_numpy(zero_copy_only=False) if int_key else np.array(ids.to_pylist())

    def products(met: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        for block, (all_ids, all_units, partners) in met.items():
            for partner in partners:
                same = partner == block
                for i in range(0, len(all_ids), TILE_ROWS):
                    one_ids, a = all_ids[i : i + TILE_ROWS], all_units[i : i + TILE_ROWS]
                    for j in range(0, len(met[partner][0]), TILE_COLUMNS):
                        other_ids, b = (x[j : j + TILE_COLUMNS] for x in met[partner][:2])
                        similarity = np.round(a @ b.T, SCORE_DIGITS)
                        hit = similarity >= threshold
                        if same:
                            hit &= one_ids[:, None] < other_ids[None, :]
                        x, y = np.nonzero(hit)
                        one, other = one_ids[x], other_ids[y]
                        different = one != other
                        x, y, one, other = x[different], y[different], one[different], other[different]
                        if len(x):
                            low, high = np.where(one < other, one, other), np.where(one < other, other, one)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(low, types[0]), pa.array(high, types[1]), pa.array(similarity[x, y])],
                                names=["a", "b", "similarity"],
                            )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, met = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("low")[i].as_py(), batch.column("high")[i].as_py()
                if own != pair:
                    yield from products(met)
                    pair, met = own, {}
                ids = keys_of(batch.column("ids")[i].values).copy()
                unit = _unit(batch.column("flat")[i].values, len(ids))
                met[batch.column("block")[i].as_py()] = ids, unit, batch.column("partners")[i].as_py()
        yield from products(met)

    wanted = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(wanted, min(bands * (bands + 1) // 2, BAND_TASKS))
    return (
        needed.join(blocks.select("block", "ids", "flat"), "block")
        .repartition(tasks, "low", "high")
        .sortWithinPartitions("low", "high")
        .mapInArrow(multiply, schema)
    )
