"""Mixing sources to target weights by hash thresholds, with DataFrame operations only.

Every document has a 48-bit hash. What a source takes is the documents below one threshold, besides whole repeats. The
threshold is found by histograms: sizes are summed by source and leading hash bits, the bucket in which the budget ends
is refined by the next bits, and after four levels the budget ends at one hash value. Nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.scale import fits_broadcast, join_hot
from ragloom.llm.common import WORDS, Scratch, packed

HASH_BITS = 48
LEVEL_BITS = 12


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def hash48(*columns: Column) -> Column:
    """Leading 48 bits of the md5 of the columns, as SQL engines can repeat them."""
    joined = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(documents: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, key, size, h); `key` stands for the source and is never null."""
    return documents.select(
        F.col(id_column).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("key"),
        words(text).alias("size"),
        _hash(id_column, text).alias("h"),
    )


def _hash(id_column: str, text: str) -> Column:
    return hash48(F.col(id_column), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def cycled_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, .. `cycle`, repeating, for sources in code point order, null last. One row per source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", ((place - 1) % cycle + 1).cast("long"))


def targets(sources: DataFrame, repeats: int) -> DataFrame:
    """Share the words of all sources by weight; none gets more than `repeats` times its own.

    The excess of capped sources goes to the others by weight. Sources in the order of cap / weight are capped from the
    front, so one running sum finds the level at which the sharing stops. `sources` has one row per source.
    """
    cap, weight = F.col("source_size") * repeats, F.col("weight")
    order = Window.orderBy(cap / weight, F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) - before) / rest
    leveled = sources.withColumn("_level", level).withColumn("_at", F.row_number().over(order))
    first = F.min(F.when(F.col("_level") * weight <= cap, F.struct("_at", "_level"))).over(every)
    return leveled.withColumn("target", F.least(cap.cast("double"), first["_level"] * weight)).drop("_level", "_at")


def thresholds(rows: DataFrame, sources: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, target, source_size, whole, cut, last): whole repeats, and the hash below which one more is taken.

    `last` tells whether documents at the hash `cut` itself are taken, whichever comes nearer to the target.
    """
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    state = sources.select(
        "key", "target", "source_size", whole.alias("whole"), (F.col("target") - whole * size).alias("left"),
        F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"),
    )
    state = scratch.write("level0", state)
    small = fits_broadcast(state)
    levels = HASH_BITS // LEVEL_BITS
    for level in range(1, levels + 1):
        shift, outer = HASH_BITS - LEVEL_BITS * level, HASH_BITS - LEVEL_BITS * (level - 1)
        of_source = state.select("key", "prefix")
        inside = join_hot(rows.select("key", "h", "size", "doc_id"), of_source, ["key"], ["doc_id", "h"], small).filter(
            F.shiftright("h", outer) == F.col("prefix")
        )
        sums = inside.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("key").orderBy("bucket")
        ranked = sums.withColumn("upto", F.sum("words").over(upto)).join(state.select("key", "before", "left"), "key")
        over = ranked.filter(F.col("before") + F.col("upto") > F.col("left"))
        found = over.groupBy("key").agg(
            F.min(F.struct("bucket", (F.col("before") + F.col("upto") - F.col("words")).alias("b"), "words")).alias("x")
        )
        kept = [c for c in state.columns if c not in ("prefix", "before", "step")]
        # Where nothing exceeds what is left (all sizes are 0) every document is below the cut.
        state = scratch.write(
            f"level{level}",
            state.join(found, "key", "left").select(
                *kept,
                F.coalesce(F.col("x.bucket"), F.lit(1 << (LEVEL_BITS * level)).cast("long")).alias("prefix"),
                F.coalesce(F.col("x.b"), F.col("before")).alias("before"),
                F.coalesce(F.col("x.words"), F.lit(0)).alias("step"),
            ),
        )
        scratch.drop(f"level{level - 1}")
    nearer = (F.col("before") + F.col("step") - F.col("left")) < (F.col("left") - F.col("before"))
    return state.select("key", "target", "source_size", "whole", F.col("prefix").alias("cut"), nearer.alias("last"))


def mix(
    documents: DataFrame,
    weights: DataFrame | None = None,
    repeats: int = 3,
    cycle: int = 3,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, times, taken.

    `weights` has (source, weight long); without it weights 1..`cycle` go round. `times` is how often the mix takes the
    document (0 to `repeats`), `taken` the words that makes. Sources may hold any share of the rows; there is one row
    per source in the tables that are sorted, and one per source and 4,096 hash buckets in those that are summed.

    Null texts have size 0. A null source is a source of its own. Rows that repeat id and text have one hash and are
    taken together. A source whose words all lie in one document gets a whole multiple of it.
    """
    return _mixed(documents, weights, repeats, cycle, id_column, text, source).select(
        "doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken")
    )


def _mixed(documents, weights, repeats, cycle, id_column, text, source) -> DataFrame:
    """The rows of `sized` with the figures of their source and `times`."""
    scratch = Scratch(documents.sparkSession)
    rows = scratch.write("sized", sized(documents, id_column, text, source))
    sources = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        weighted = cycled_weights(sources, cycle)
    else:
        own = weights.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key"), "weight")
        weighted = sources.join(own, "key")
    shared = scratch.write("targets", targets(weighted, repeats))
    cuts = thresholds(rows, shared, scratch)
    scratch.drop("targets")
    found = join_hot(rows, cuts, ["key"], ["doc_id", "h"], fits_broadcast(cuts))
    once_more = (F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & F.col("last"))
    times = F.least(F.col("whole") + once_more.cast("long"), F.lit(repeats).cast("long"))
    return found.withColumn("times", times)


def apply_mix(
    documents: DataFrame,
    weights: DataFrame | None = None,
    repeats: int = 3,
    cycle: int = 3,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The documents with their own columns, each as often as the mix takes it."""
    chosen = _mixed(documents, weights, repeats, cycle, id_column, text, source).filter("times > 0").select(
        "h", F.col("key").alias("of"), F.col("times").cast("int").alias("times")
    ).distinct()
    own = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    rows = packed(documents, _hash(id_column, text).alias("h"), own.alias("of"))
    copies = F.explode(F.sequence(F.lit(1), F.col("times")))
    return rows.join(chosen, ["h", "of"]).select("row", copies.alias("copy")).select("row.*")
