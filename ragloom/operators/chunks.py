"""Maintenance of the chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.ids import uuid5
from ragloom.functions.text import blank, or_null
from ragloom.sources.evaluation import upsert


def index_manual(existing: DataFrame, entries: DataFrame, order: Column) -> DataFrame:
    """Upsert hand-made chunks (document_id, text, process_name, tags).

    Every entry is chunk 0 of its document, so the entry with the highest `order` replaces the others. An empty
    payload is an error in the service; here no entries leave the table as it is.
    """
    rows = entries.select(
        F.concat(F.col("document_id").cast("string"), F.lit(":0")).alias("chunk_id"),
        F.col("document_id").cast(existing.schema["document_id"].dataType).alias("document_id"),
        F.lit(0).alias("pos"),
        "text",
        or_null(F.col("process_name")).alias("process_name"),
        or_null(F.col("tags")).alias("tags"),
        order.alias("_entry"),
    )
    missing = [c for c in existing.columns if c not in rows.columns]
    padded = rows.select("*", *[F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in missing])
    return upsert(existing, padded, ["chunk_id"], order=F.col("_entry"))


def delete_chunks(chunks: DataFrame, process: str | None = None, tag: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row with `deleted`). Without a condition everything goes; a tag matches as a whole string."""
    doomed = F.lit(True)
    if process is not None:
        doomed = doomed & (F.col("process_name") == process)
    if tag is not None:
        doomed = doomed & (F.col("tags") == tag)
    doomed = F.coalesce(doomed, F.lit(False))
    return chunks.filter(~doomed), chunks.filter(doomed).agg(F.count(F.lit(1)).alias("deleted"))


def normalise_tags(tags: Column, is_array: bool) -> Column:
    """One comma-separated string; blank becomes null."""
    if is_array:
        kept = F.filter(tags, lambda t: F.length(t) > 0)
        return or_null(F.array_join(kept, ","))
    return F.when(~blank(tags), tags)


def reindex(chunks: DataFrame, vectors: DataFrame, semantic_source: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows of the new table, one row with `processed`, `skipped` and `unvectored`).

    Blank chunks are skipped, ids are kept, the page number becomes text for semantic sources. A chunk without a vector
    has no row in the new table and counts as unvectored; `processed` counts the rows written.
    """
    is_array = dict(chunks.dtypes)["tags"].startswith("array")
    rows = chunks.filter(~blank(F.col("text"))).withColumn("tags", normalise_tags(F.col("tags"), is_array))
    if semantic_source and "page_number" in chunks.columns:
        rows = rows.withColumn("page_number", F.col("page_number").cast("string"))
    renewed = rows.join(vectors.select("chunk_id", "embedding"), "chunk_id").withColumn(
        "point_id", uuid5(F.col("chunk_id"))
    )
    found = vectors.select("chunk_id").distinct().withColumn("_found", F.lit(True))
    empty = blank(F.col("text"))
    counts = chunks.select("chunk_id", "text").join(found, "chunk_id", "left").agg(
        F.count_if(~empty & F.col("_found")).alias("processed"), F.count_if(empty).alias("skipped"),
        F.count_if(~empty & F.col("_found").isNull()).alias("unvectored"),
    )
    return renewed, counts


def process_names(chunks: DataFrame, n: int = 100) -> DataFrame:
    """The `n` most frequent process names with their chunk counts; empty names are dropped after the cut."""
    counted = chunks.filter(F.col("process_name").isNotNull()).groupBy("process_name").agg(
        F.count(F.lit(1)).alias("doc_count")
    )
    order = [F.col("doc_count").desc(), F.col("process_name")]
    return counted.orderBy(*order).limit(n).filter(F.col("process_name") != "").select(
        F.col("process_name").alias("name"), "doc_count", F.lit(False).alias("has_model")
    )
