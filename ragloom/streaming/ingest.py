"""Upload events to chunk tables with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragloom.functions.scale import cut_lineage, drop_work, work_path
from ragloom.operators import chunking
from ragloom.operators.elements import prepare_elements

EVENT_FIELDS = """document_id string, file_name string, path string, source string, tags string, process_name string,
chunking_strategy string"""

# Fixed value: the strategy used for unknown names.
DEFAULT_STRATEGY = "by_title"

CHUNK_COLUMNS = """chunk_id document_id pos point_id text page_number section_title element_type roles table_html
process_name tags file_name chunking_strategy""".split()

STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "by_title": chunking.chunk_by_title,
    "semantic": chunking.chunk_semantic,
    "sentence_semantic": chunking.chunk_sentences,
}

# Strategies that read no embeddings.
WITHOUT_VECTORS = ["by_title"]


def chunk_events(events: DataFrame, elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, indexed, failed) of a batch of upload events.

    elements: path, pos, element_type, text, page, section_title, table_html, embedding - what a layout parser made of
    each uploaded file. Of all of them only the paths are read; the rest once, of the batch's files, to be prepared for
    all strategies together. A file without elements has failed; failures are reported, every one of them, and not tried
    again. Of several events of a document whose files are there the last one counts: by `_order`, where events have that
    column, else by the values of all columns.
    """
    spark = events.sparkSession
    known = F.col("chunking_strategy").isin(*STRATEGIES)
    batch = events.withColumn(
        "chunking_strategy", F.when(known, F.col("chunking_strategy")).otherwise(DEFAULT_STRATEGY)
    )
    there = cut_lineage(elements.select("path").distinct().join(batch.select("path"), "path", "left_semi"))
    names = [c for c in batch.columns if c not in ("_order", "document_id")]
    order = F.struct(*(["_order"] if "_order" in batch.columns else []), *names)
    present = batch.join(there, "path", "left_semi")
    latest = present.groupBy("document_id").agg(F.max_by(F.struct(*names), order).alias("_event"))
    found = cut_lineage(latest.select("document_id", "_event.*"))
    failed = batch.join(there, "path", "left_anti").select(
        "document_id", F.concat(F.lit("Upload file missing: "), F.coalesce("path", F.lit(""))).alias("error")
    )
    meta = found.select("document_id", "process_name", "tags", "file_name")
    path = work_path(spark)
    placed = elements.join(found.select("document_id", "path", "chunking_strategy"), "path").drop("path")
    read = ~F.col("chunking_strategy").isin(*WITHOUT_VECTORS)
    prepared = cut_lineage(
        prepare_elements(placed.withColumn("embedding", F.when(read, F.col("embedding")))), "chunking_strategy", path=path
    )
    chunks = None
    for name, chunker in STRATEGIES.items():
        own = prepared.filter(F.col("chunking_strategy") == name).drop("chunking_strategy")
        # Numbering reads the chunks twice, so they are stored and not put together twice.
        merged = work_path(spark)
        made = chunking.build_chunks(cut_lineage(chunker(own), path=merged), meta)
        made = made.withColumn("chunking_strategy", F.lit(name))
        missing = [c for c in CHUNK_COLUMNS if c not in made.columns]
        for column in missing:
            kind = "array<string>" if column == "roles" else "string"
            made = made.withColumn(column, F.lit(None).cast(kind))
        # Strategy by strategy: what one has shuffled is gone before the next one begins.
        made = cut_lineage(made.select(*CHUNK_COLUMNS))
        drop_work(spark, merged)
        chunks = made if chunks is None else chunks.unionByName(made)
    drop_work(spark, path)
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    indexed = (
        found.join(counts, "document_id", "left").fillna(0, ["chunks"])
        .select("document_id", "chunks", "tags", "process_name", "chunking_strategy")
    )
    return chunks, indexed, failed


def ingest_stream(
    spark: SparkSession,
    events_path: str,
    elements: DataFrame,
    output: str,
    checkpoint: str,
    available_now: bool = True,
    files_per_batch: int = 10_000,
) -> StreamingQuery:
    """Start the consumer: JSON event files in, tables `chunks`, `indexed` and `failed` under `output`.

    Every batch overwrites its own partition, so a batch that is run again after a failure leaves no duplicates. Files
    are ordered by their time of change and name, events by their place in a file; `elements` is best partitioned by path.
    """
    place = F.struct(
        F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    source = spark.readStream.schema(EVENT_FIELDS).option("maxFilesPerTrigger", files_per_batch).json(events_path)
    events = source.select("*", place.alias("_place"))

    def handle(batch: DataFrame, number: int) -> None:
        order = F.struct(F.col("_place"), F.monotonically_increasing_id().alias("row"))
        ordered = cut_lineage(batch.withColumn("_order", order).drop("_place"))
        for name, rows in zip(("chunks", "indexed", "failed"), chunk_events(ordered, elements)):
            rows.write.mode("overwrite").parquet(f"{output}/{name}/batch={number}")

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def latest_chunks(spark: SparkSession, output: str) -> DataFrame:
    """The chunk table: of several batches with one chunk id the last one counts."""
    rows = spark.read.parquet(f"{output}/chunks")
    newest = rows.groupBy("chunk_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["chunk_id", "batch"], "left_semi").drop("batch")
