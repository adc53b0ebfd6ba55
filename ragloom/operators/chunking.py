"""Chunking jobs over prepared elements (see `elements.prepare_elements`).

Only positions and lengths travel through the ordered steps; texts are joined in one bounded group per chunk at the
end. A document may hold any share of all rows: ordered scans run over blocks of its positions. Prepared elements are
read several times, so they should come from a stored table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.ids import uuid5
from ragloom.functions.scale import (
    BLOCK_ROWS,
    blocked_row_number,
    blocked_scan,
    cut_lineage,
    halo_blocks,
    percentile_linear,
)
from ragloom.functions.text import joined_in_order, or_null, strip
from ragloom.functions.vectors import dot

# Thresholds and size limits.
BREAK_PERCENTILE = 0.95
SENTENCE_PERCENTILE = 0.90
MIN_CHUNK_CHARS = 100
MAX_SEMANTIC_CHARS = 2400
MAX_TITLE_CHARS = 1800
SOFT_TITLE_CHARS = 1350
TITLE_OVERLAP = 225

SEPARATOR = "\n\n"


def _next(df: DataFrame, *values: str) -> DataFrame:
    """Add `_next_{value}` of the following `idx` of the same document, for each value."""
    follow = Window.partitionBy("document_id", "_block").orderBy("idx")
    rows = halo_blocks(df, "idx", 0, 1).select("*", *[F.lead(v).over(follow).alias(f"_next_{v}") for v in values])
    return rows.filter("_core").drop("_block", "_core")


def adjacent_similarity(elements: DataFrame) -> DataFrame:
    """Cosine similarity of element `idx` and its successor, 0 for a zero vector: (document_id, idx, similarity)."""
    sized = elements.select(
        "document_id", "idx", "embedding", F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("norm")
    )
    pairs = _next(sized, "embedding", "norm").filter(F.col("_next_embedding").isNotNull())
    scale = F.nullif(F.col("norm") * F.col("_next_norm"), F.lit(0.0))
    similarity = dot(F.col("embedding"), F.col("_next_embedding")) / scale
    return pairs.select("document_id", "idx", F.coalesce(similarity, F.lit(0.0)).alias("similarity"))


def semantic_breakpoints(similarities: DataFrame, pct: float = BREAK_PERCENTILE) -> DataFrame:
    """Elements that start a new topic: (document_id, idx).

    The drop from one similarity to the next must exceed the document's `pct` percentile of drops; the chunk then
    starts two elements after the first of the pair.
    """
    pairs = _next(similarities, "similarity").filter(F.col("_next_similarity").isNotNull())
    drop = F.col("similarity") - F.col("_next_similarity")
    drops = cut_lineage(pairs.select("document_id", "idx", drop.alias("_drop")))
    limits = percentile_linear(drops, ["document_id"], "_drop", pct, "_limit")
    return drops.join(limits, "document_id").filter(F.col("_drop") > F.col("_limit")).select(
        "document_id", (F.col("idx") + 2).alias("idx")
    )


def segments(elements: DataFrame, breaks: DataFrame) -> DataFrame:
    """Positions with `seg`, the number of breakpoints up to them: (document_id, idx, length, seg)."""
    sized = elements.select("document_id", "idx", F.length("text").cast("long").alias("length"))
    flagged = sized.join(breaks.select("document_id", "idx", F.lit(1).alias("_break")), ["document_id", "idx"], "left")
    return blocked_scan(
        flagged, ["document_id"], F.floor(F.col("idx") / BLOCK_ROWS), [F.col("idx")],
        F.coalesce("_break", F.lit(0)).cast("long"), "seg",
    ).drop("_break")


def _pack(limit: int, soft: int | None, separator: int):
    """Greedy packing of lengths in sorted order; carries the open part of a segment across batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, size, part = None, 0, 0
        for batch in batches:
            parts = []
            for doc, seg, length in zip(batch["document_id"], batch["seg"], batch["length"]):
                if (doc, seg) != key:
                    key, size, part = (doc, seg), length, 0
                elif size + separator + length > limit or (soft is not None and size > soft):
                    size, part = length, part + 1
                else:
                    size += separator + length
                parts.append(part)
            yield batch.assign(part=parts)[["document_id", "seg", "idx", "part"]]

    return run


def _next_start(lengths: np.ndarray, limit: int, soft: int | None, separator: int) -> np.ndarray:
    """For every element: where the next part begins if a part begins here."""
    ends = np.concatenate([[0], np.cumsum(lengths + separator)])
    own = np.arange(1, len(lengths) + 1)
    stop = np.maximum(np.searchsorted(ends, ends[:-1] + limit + separator, side="right") - 1, own)
    if soft is not None:
        stop = np.minimum(stop, np.maximum(np.searchsorted(ends, ends[:-1] + soft + separator, side="right"), own))
    return stop


def _block_exits(limit: int, soft: int | None, separator: int):
    """Ranges of elements before a block (or the segment's first) and the part left open at the block's end."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        idx, core = rows["idx"].to_numpy(), rows["_core"].to_numpy()
        follow = _next_start(rows["length"].to_numpy(), limit, soft, separator)
        left_open = np.arange(len(idx))
        for i in range(len(idx) - 1, -1, -1):
            if follow[i] < len(idx):
                left_open[i] = left_open[follow[i]]
        entries = np.flatnonzero(~core) if not core[0] else np.array([0])
        exits = idx[left_open[entries]]
        # A later start never ends earlier, so entries with the same exit are neighbours.
        first = np.flatnonzero(np.r_[True, exits[1:] != exits[:-1]])
        last = np.r_[first[1:] - 1, len(exits) - 1]
        return pd.DataFrame({
            "document_id": key[0], "seg": key[1], "_block": key[2],
            "low": idx[entries[first]], "high": idx[entries[last]], "exit": exits[first],
        })

    return run


def _follow_exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk the few ranges of each block in order: which part is open where the block begins."""
    key, block, carry = None, None, 0
    for batch in batches:
        found = []
        for row in batch.itertuples(index=False):
            if (row.document_id, row.seg) != key:
                key, block, carry = (row.document_id, row.seg), None, row.low
            if row[2] != block and row.low <= carry <= row.high:
                block = row[2]
                found.append((row.document_id, row.seg, block, carry))
                carry = row.exit
        yield pd.DataFrame(found, columns=["document_id", "seg", "_block", "entry"])


def _block_starts(limit: int, soft: int | None, separator: int):
    """Elements of a block that begin a part, given the part open before it."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        idx, core = rows["idx"].to_numpy(), rows["_core"].to_numpy()
        follow = _next_start(rows["length"].to_numpy(), limit, soft, separator)
        place, starts = int(np.searchsorted(idx, rows["entry"].iloc[0])), []
        while place < len(idx):
            if core[place]:
                starts.append(idx[place])
            place = follow[place]
        return pd.DataFrame({"document_id": key[0], "seg": key[1], "idx": starts})

    return run


def _split_hot(lengths: DataFrame, limit: int, soft: int | None, separator: int) -> DataFrame:
    """Packing of segments of many elements, in blocks: the same parts as one pass over the segment.

    A block is solved for every part that could be open where it begins. Chains of parts soon fall together, so this
    gives a handful of ranges per block; only these are walked in order. Then every block is cut on its own.
    """
    reach = limit // (separator + 1) + 2
    width = max(BLOCK_ROWS, 4 * reach)
    kind = lengths.schema["document_id"].dataType.simpleString()
    keys = ["document_id", "seg", "_block"]
    blocks = halo_blocks(lengths, "idx", reach, 0, width)
    # The rows before a segment's first element belong to other segments; a block may hold only repeated rows.
    alive = blocks.filter("_core").select(*keys).distinct()
    blocks = blocks.join(alive, keys, "left_semi")
    exits = blocks.groupBy(*keys).applyInPandas(
        _block_exits(limit, soft, separator),
        f"document_id {kind}, seg long, _block long, low long, high long, exit long",
    )
    entries = (
        exits.repartition("document_id", "seg")
        .sortWithinPartitions("document_id", "seg", "_block", "low")
        .mapInPandas(_follow_exits, f"document_id {kind}, seg long, _block long, entry long")
    )
    starts = blocks.join(entries, keys).groupBy(*keys).applyInPandas(
        _block_starts(limit, soft, separator), f"document_id {kind}, seg long, idx long"
    )
    flagged = lengths.join(starts.withColumn("_start", F.lit(1).cast("long")), ["document_id", "seg", "idx"], "left")
    counted = blocked_scan(
        flagged, ["document_id", "seg"], F.floor(F.col("idx") / width), [F.col("idx")],
        F.coalesce("_start", F.lit(0).cast("long")), "_starts",
    )
    return counted.select("document_id", "seg", "idx", (F.col("_starts") - 1).alias("part"))


def split_long_segments(
    lengths: DataFrame, max_chars: int, soft_chars: int | None = None, separator: int = len(SEPARATOR)
) -> DataFrame:
    """Pack the elements of each segment into parts of at most `max_chars` characters.

    lengths: (document_id, seg, idx, length) with contiguous idx; returns (document_id, seg, idx, part). An element
    longer than the limit stays whole. Segments up to a block are folded whole, many per task; longer ones are folded
    block by block over many tasks. The lengths are read several times, so they should come from a stored table.
    """
    rows = lengths.select("document_id", "seg", "idx", F.col("length").cast("long").alias("length"))
    keys = ["document_id", "seg"]
    rows = rows.dropna(subset=keys)
    # One segment per BLOCK_ROWS rows at most.
    hot = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BLOCK_ROWS).select(*keys))
    some = not hot.isEmpty()
    ordered = (
        (rows.join(F.broadcast(hot), keys, "left_anti") if some else rows)
        .repartition(*keys)
        .sortWithinPartitions(*keys, "idx")
    )
    kind = lengths.schema["document_id"].dataType.simpleString()
    short = ordered.mapInPandas(
        _pack(max_chars, soft_chars, separator), f"document_id {kind}, seg long, idx long, part long"
    )
    if not some:
        return short
    long_rows = cut_lineage(rows.join(F.broadcast(hot), keys, "left_semi"))
    return short.unionByName(_split_hot(long_rows, max_chars, soft_chars, separator))


def merge_metadata(separator: str = SEPARATOR) -> list[Column]:
    """Aggregates of one chunk over its elements."""
    page_low, page_high = F.min("page"), F.max("page")
    types = F.collect_set(or_null(F.col("element_type")))
    title, table = or_null(F.col("section_title")), or_null(F.col("table_html"))
    return [
        joined_in_order(F.col("idx"), F.col("text"), separator).alias("text"),
        F.min("idx").alias("first_idx"),
        F.when(page_low == page_high, page_low.cast("string"))
        .otherwise(F.concat_ws("-", page_low, page_high))
        .alias("_pages"),
        F.count("page").alias("_paged"),
        F.min_by("section_title", F.when(title.isNotNull(), F.col("idx"))).alias("section_title"),
        F.when(F.size(types) > 1, F.lit("merged")).otherwise(F.array_max(types)).alias("element_type"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("roles")))).alias("roles"),
        F.min_by("table_html", F.when(table.isNotNull(), F.col("idx"))).alias("table_html"),
    ]


def _merge(parts: DataFrame) -> DataFrame:
    chunks = parts.groupBy("document_id", "seg", "part").agg(*merge_metadata())
    return chunks.withColumn("page_number", F.when(F.col("_paged") > 0, F.col("_pages"))).drop("_pages", "_paged")


def assemble_chunks(elements: DataFrame, breaks: DataFrame, max_chars: int = MAX_SEMANTIC_CHARS) -> DataFrame:
    """Chunks between breakpoints, long segments split, chunks below 100 characters dropped.

    The total that decides about splitting leaves separators out. A document of one element keeps it whatever its
    length.
    """
    placed = cut_lineage(segments(elements, breaks))
    totals = placed.groupBy("document_id", "seg").agg(F.sum("length").alias("_total"))
    singles = placed.groupBy("document_id").agg((F.count(F.lit(1)) == 1).alias("_single"))
    long_rows = cut_lineage(
        placed.join(totals.filter(F.col("_total") > max_chars), ["document_id", "seg"]).drop("_total")
    )
    cut = split_long_segments(long_rows, max_chars).drop("seg")
    parts = placed.join(cut, ["document_id", "idx"], "left").select(
        "document_id", "idx", "seg", F.coalesce("part", F.lit(0)).alias("part")
    )
    return (
        _merge(elements.join(parts, ["document_id", "idx"]))
        .join(singles.filter("_single"), "document_id", "left")
        .filter((F.length("text") >= MIN_CHUNK_CHARS) | F.coalesce("_single", F.lit(False)))
        .drop("_single")
    )


def chunk_semantic(elements: DataFrame, max_chars: int = MAX_SEMANTIC_CHARS) -> DataFrame:
    """Prepared elements with embeddings to topic chunks."""
    return assemble_chunks(elements, semantic_breakpoints(adjacent_similarity(elements)), max_chars)


def chunk_by_title(
    elements: DataFrame, max_chars: int = MAX_TITLE_CHARS, soft: int = SOFT_TITLE_CHARS, overlap: int = TITLE_OVERLAP
) -> DataFrame:
    """Title-bounded chunks.

    Semantics of this library: a title always opens a chunk. Inside a section, elements are packed until the chunk is
    longer than `soft` or the next element would pass `max_chars`. An element longer than `max_chars` is a chunk of its
    own, cut into windows of `max_chars` that repeat `overlap` characters of their predecessor.
    """
    titles = elements.filter(F.col("element_type") == "Title").select("document_id", "idx")
    parts = split_long_segments(cut_lineage(segments(elements, titles)), max_chars, soft)
    rows = elements.join(parts, ["document_id", "idx"])
    merged = _merge(rows)
    step = max_chars - overlap
    windows = F.greatest(F.ceil((F.length("text") - overlap) / step), F.lit(1)).cast("int")
    cut = merged.withColumn("window", F.explode(F.sequence(F.lit(0), windows - 1)))
    return cut.withColumn(
        "text", F.substring("text", F.col("window") * step + 1, F.lit(max_chars))
    )


def chunk_sentences(
    sentences: DataFrame, pct: float = SENTENCE_PERCENTILE, max_chars: int = MAX_SEMANTIC_CHARS
) -> DataFrame:
    """Sentence-level topic chunks: (document_id, seg, part, text, first_idx).

    A chunk ends after a sentence whose distance to the next exceeds the document's percentile. Sentences are joined by
    a blank; the text is cut every `max_chars` characters, pieces are stripped and dropped below 100 characters. Each
    sentence finds its pieces from its character offset, so no whole segment is ever put together.
    """
    trimmed = sentences.withColumn("text", strip(F.col("text")))
    similarities = adjacent_similarity(trimmed)
    distances = cut_lineage(similarities.select("document_id", "idx", (1 - F.col("similarity")).alias("distance")))
    limits = percentile_linear(distances, ["document_id"], "distance", pct, "_limit")
    breaks = distances.join(limits, "document_id").filter(F.col("distance") > F.col("_limit"))
    parted = cut_lineage(
        segments(trimmed, breaks.select("document_id", (F.col("idx") + 1).alias("idx")))
    ).withColumn("length", F.col("length") + 1)
    length = F.col("length")
    placed = blocked_scan(
        parted, ["document_id", "seg"], F.floor(F.col("idx") / BLOCK_ROWS), [F.col("idx")], length, "_end"
    ).withColumn("_start", F.col("_end") - length)
    first, last = F.floor(F.col("_start") / max_chars), F.floor((F.col("_end") - 1) / max_chars)
    pieces = (
        trimmed.select("document_id", "idx", "text")
        .join(placed, ["document_id", "idx"])
        .withColumn("part", F.explode(F.sequence(first, last)))
    )
    begin = F.greatest(F.col("part") * max_chars - F.col("_start"), F.lit(0))
    end = F.least((F.col("part") + 1) * max_chars - F.col("_start"), length)
    piece = F.substring(F.concat("text", F.lit(" ")), (begin + 1).cast("int"), (end - begin).cast("int"))
    chunks = (
        pieces.withColumn("_piece", piece)
        .groupBy("document_id", "seg", "part")
        .agg(
            strip(joined_in_order(F.col("idx"), F.col("_piece"), "")).alias("text"),
            F.min("idx").alias("first_idx"),
        )
    )
    return chunks.filter(F.length("text") >= MIN_CHUNK_CHARS)


def build_chunks(chunks: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Chunk rows with position, id and point id; document-level metadata overlays the chunk's own.

    chunks: document_id, first_idx[, window, part], text, …; meta: document_id, process_name, tags, file_name.
    """
    minor = F.struct(*[c for c in ("first_idx", "seg", "part", "window") if c in chunks.columns])
    overlay = ["process_name", "tags", "file_name"] if meta is not None else []
    if meta is not None:
        meta = meta.select("document_id", *[or_null(F.col(c)).alias(c) for c in overlay])
    numbered = blocked_row_number(
        chunks, ["document_id"], F.floor(F.col("first_idx") / BLOCK_ROWS), [minor], "pos", meta
    ).withColumn("pos", (F.col("pos") - 1).cast("int"))
    chunk_id = F.concat(F.col("document_id").cast("string"), F.lit(":"), F.col("pos").cast("string"))
    own = [c for c in numbered.columns if c not in ("first_idx", "seg", "part", "window", *overlay)]
    return numbered.select(*own, chunk_id.alias("chunk_id"), *overlay).withColumn("point_id", uuid5(F.col("chunk_id")))
