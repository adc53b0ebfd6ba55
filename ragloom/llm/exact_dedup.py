"""Exact dedup against a persistent digest index, with DataFrame operations only.

The index is a table bucketed and sorted by digest: one row per text ever seen, with the document that stays. A new
batch is reduced to one row per digest, rows that the index already has go by a sort-merge anti-join for which the index
is not shuffled, and the rest is appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.functions.scale import work_path
from ragloom.llm.common import Scratch, join_groups, packed

#: Digests per bucket that an index is laid out for.
BUCKET_DIGESTS = 4_000_000
LEAST_BUCKETS = 8


def buckets_for(digests: int) -> int:
    """Power of two that keeps buckets near BUCKET_DIGESTS rows."""
    buckets = LEAST_BUCKETS
    while buckets * BUCKET_DIGESTS < digests:
        buckets *= 2
    return buckets


class DigestIndex:
    """A table (digest, keep_id, group_size) bucketed and sorted by digest at `path`.

    A new session opens an index that is there by giving the same path and number of buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, id_type: str = "bigint"):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id {id_type}, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Add the groups whose digest is not in the index yet."""
        new = groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        (
            new.select("digest", "keep_id", "group_size")
            .repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)


def digests(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n): how often each id comes with each text; a null text counts as the empty one."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    rows = documents.select(F.col(id_column).alias("doc_id"), digest.alias("digest"))
    return rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))


def groups(counted: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size): the largest id of each text stays."""
    return counted.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))


def deduplicate(
    documents: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    index: DigestIndex | None = None,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Without `index` a new one is made in the shared folder. With one, texts it has already are not kept; their keep_id
    and group_size are those of the batch that brought them.

    Null ids are smaller than all others. Of rows that repeat both id and text one is kept and the others are not.
    Null and empty texts are equal. An empty table gives no rows.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession)
    counted = scratch.write("digests", digests(documents, id_column, text))
    batch = scratch.write("groups", groups(counted))
    known = None
    if index is None:
        kind = counted.schema["doc_id"].dataType.simpleString()
        index = DigestIndex(spark, work_path(spark), buckets_for(batch.count()), kind)
    else:
        known = scratch.write("known", batch.select("digest").join(index.table().hint("merge"), "digest", "left_semi"))
    index.append(batch)
    rows = join_groups(counted, index.table(), "digest", "group_size")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)
    if known is not None:
        rows = rows.join(known.withColumn("known", F.lit(True)), "digest", "left")
        stays = stays & F.col("known").isNull()
    # Rows that repeat id and text come back one by one, in steps of bounded length.
    step = F.lit(100_000)
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step)))
    rows = rows.withColumn("part", first)
    last = F.least(F.col("n") - F.col("part") * step, step.cast("long")) - 1
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("part") * step, F.col("part") * step + last)))
    return rows.select(
        "doc_id", "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_first(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their own columns, one of each text: that with the largest id.

    Which rows stay is decided by `deduplicate`; of rows that repeat both id and text, the first by the hash of all
    their columns stays.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    kept = deduplicate(documents, id_column, text).filter("kept").select(
        F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha"), (F.col("group_size") > 1).alias("many")
    )
    rows = packed(documents, F.col(id_column).alias("id"), digest.alias("sha"))
    chosen = rows.join(kept, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha")))
    order = Window.partitionBy("sha").orderBy(F.xxhash64("row"))
    first = chosen.filter("many").withColumn("place", F.row_number().over(order)).filter("place = 1")
    return chosen.filter(~F.col("many")).select("row.*").unionByName(first.select("row.*"))
