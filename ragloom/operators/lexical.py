"""Full-text search for whole tables of queries: postings in blocks and BM25 that skips blocks.

An index is stored in blocks of neighbouring chunks. For every term of a block it also holds what bounds the term's
weight in any of the block's chunks, so that a query's best possible score in a block is known before a posting is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ragloom.functions.scale import cut_lineage, fits_broadcast, join_hot, small_batches, spread, top_k, work_path
from ragloom.functions.text import tokens

# BM25 parameters and field boosts.
K1 = 1.2
B = 0.75
BOOSTS = {"text": 3.0, "process_name": 5.0, "tags": 2.0}

# Sums of doubles depend on their order, and copies of a text must tie: scores are ranked at this precision.
SCORE_DIGITS = 9

#: Terms of queries that are sent to the tasks at once.
SLICE_TERMS = 200_000
#: Queries scored together in a block.
QUERY_SLICE = 256
#: Chunks of a block, blocks that share a folder, and blocks each query reads before it chooses among the others.
BLOCK_CHUNKS = 64
SHELF_BLOCKS = 64
PROBES = 2


class TextIndex(NamedTuple):
    """What BM25 reads: a stored table with one row per block (`postings`; `write_index` and `read_index` to keep one)."""

    blocks: DataFrame

    @property
    def terms(self) -> DataFrame:
        """(block, term, chunks that have it, total_tf)"""
        term = F.when(F.length("terms") > 0, F.split("terms", " ")).otherwise(F.array().cast("array<string>"))
        return self.blocks.select("block", F.inline(F.arrays_zip(term.alias("term"), "chunks", "total_tf")))

    @property
    def documents(self) -> DataFrame:
        return self.blocks.select(F.inline(F.arrays_zip("chunk_id", "process_name", "tags", "length")))


def _lists(values: pa.Array, ends: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of chunks with their words: the chunks, their terms, what bounds these, and the postings."""
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_CHUNKS):
            part = batch.slice(start, BLOCK_CHUNKS)
            words = part.column(3)
            length = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            coded = words.flatten().dictionary_encode()
            row = np.repeat(np.arange(part.num_rows), length)
            key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * BLOCK_CHUNKS + row, return_counts=True)
            code, row = np.divmod(key, BLOCK_CHUNKS)
            first = np.flatnonzero(np.diff(code, prepend=-1))
            columns = [_lists(part.column(n), [part.num_rows]) for n in range(3)] + [_lists(pa.array(length), [part.num_rows])]
            total, most, ratio = (
                fold.reduceat(x, first) if len(first) else x[:0]
                for fold, x in ((np.add, tf), (np.maximum, tf), (np.minimum, length[row] / tf))
            )
            having = np.diff(np.append(first, len(code)))
            # Words hold no space: as one string they are read and written at a fraction of the time.
            joined = pa.compute.binary_join(_lists(coded.dictionary.take(pa.array(code[first])), [len(first)]), " ")
            counts = [_lists(pa.array(x), [len(first)]) for x in (having, total)]
            numbers = having, most, ratio, row, tf
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) | number]), *columns, joined, *counts,
                    *[pa.array([x.astype(kind).tobytes()]) for x, kind in zip(numbers, _PACKED.values(), strict=True)],
                    pa.array([(task << 32) | (number // SHELF_BLOCKS)]),
                ],
                _BLOCK,
            )
            number += 1


#: What only searches read, as the bytes of numbers.
_PACKED = {"having": np.int32, "most_tf": np.int32, "least_ratio": np.float64, "rows": np.uint16, "tfs": np.int32}
_BLOCK = ["block", "chunk_id", "process_name", "tags", "length", "terms", "chunks", "total_tf", *_PACKED, "shelf"]


def _terms(batch: pa.RecordBatch, n: int) -> pa.Array:
    joined = batch.column("terms").slice(n, 1)
    return pa.compute.split_pattern(joined, " ").values if joined[0].as_py() else pa.array([], pa.string())


def _packed(batch: pa.RecordBatch, name: str, n: int) -> np.ndarray:
    return np.frombuffer(batch.column(name)[n].as_buffer(), _PACKED[name])


def _block_schema(chunks: DataFrame) -> T.StructType:
    own = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in chunks.schema.fields[:3]]
    long = T.ArrayType(T.LongType())
    kinds = [long, T.StringType(), long, long, *[T.BinaryType()] * len(_PACKED), T.LongType()]
    return T.StructType([
        T.StructField("block", T.LongType()), *own, *[T.StructField(n, k) for n, k in zip(_BLOCK[4:], kinds, strict=True)]
    ])


def write_index(chunks: DataFrame, path: str) -> TextIndex:
    """Store term and length statistics of (chunk_id, text, process_name, tags) under `path`.

    A chunk is one row, so its words are counted where it is read: no text and no posting is shuffled. Blocks are runs of
    neighbouring rows; a table that is stored by topic or source gives blocks that queries can skip.
    """
    small_batches(chunks.sparkSession)
    words = F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))
    sent = spread(chunks.select("chunk_id", "process_name", "tags", "text")).select(
        "chunk_id", "process_name", "tags", words.alias("words")
    )
    schema = _block_schema(sent)
    sent.mapInArrow(_counted, schema).write.mode("overwrite").partitionBy("shelf").parquet(path)
    return TextIndex(chunks.sparkSession.read.schema(schema).parquet(path))


def postings(chunks: DataFrame) -> TextIndex:
    """An index in the shared folder of the session."""
    return write_index(chunks, work_path(chunks.sparkSession))


def read_index(spark, path: str) -> TextIndex:
    return TextIndex(spark.read.parquet(path))


def idf(total: Column, having: Column) -> Column:
    return F.log(1 + (total - having + 0.5) / (having + 0.5))


def allowed(process_name: Column, tags: Column) -> Column:
    """Pre-scoring filter of a (query, chunk) row: exact process name, any of the query's tags."""
    return (F.col("_process").isNull() | (process_name == F.col("_process"))) & (
        (F.coalesce(F.size("_tags"), F.lit(0)) <= 0) | F.array_contains("_tags", tags)
    )


def query_filters(queries: DataFrame) -> list[Column]:
    """Optional filter columns of a query table: filter_process string, filter_tags array<string>."""
    process = F.col("filter_process") if "filter_process" in queries.columns else F.lit(None).cast("string")
    tags = F.col("filter_tags") if "filter_tags" in queries.columns else F.lit(None).cast("array<string>")
    return [F.when(F.length(process) > 0, process).alias("_process"), tags.alias("_tags")]


def filter_chunks(chunks: DataFrame, process: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Chunks of one process and of any of the tags; a missing filter lets everything pass."""
    if process:
        chunks = chunks.filter(F.col("process_name") == process)
    if tags:
        chunks = chunks.filter(F.col("tags").isin(list(tags)))
    return chunks


def filter_by_process_scope(chunks: DataFrame, scope: DataFrame) -> DataFrame:
    """Chunks inside any scope row (process_id, node_ids, lane_ids); an empty list does not restrict."""
    s = scope.select(
        F.col("process_id").alias("_pid"), F.col("node_ids").alias("_nodes"), F.col("lane_ids").alias("_lanes")
    )

    def free_or_in(ids: str, value: str) -> Column:
        return (F.coalesce(F.size(ids), F.lit(0)) <= 0) | F.array_contains(ids, F.col(value))

    inside = (F.col("process_id") == F.col("_pid")) & free_or_in("_nodes", "node_id") & free_or_in("_lanes", "lane_id")
    return chunks.join(s, inside, "left_semi")


def bm25_topk(queries: DataFrame, index: TextIndex, k: int) -> DataFrame:
    """Best `k` chunks per query: (query_pk, chunk_id, score, rank).

    queries: query_pk, text[, filter_process, filter_tags]. The text field sums over distinct query terms, a repeated
    term counts as often as it occurs; the keyword fields match on the whole query string. The best field wins.
    Statistics are index-wide, filters only cut the hits.

    A term's weight grows with its count in a chunk and falls with the chunk's length, so the most it can be in a block
    follows from the block's largest count and smallest ratio of length to count. Each query reads the PROBES blocks with
    the highest sum of these first; its k-th score there is a threshold, and blocks whose sum is below it are left out.

    Scores of (query, chunk) pairs are never shuffled: a task passes on the k best of each query. Query terms travel to the
    tasks in slices of bounded size.
    """
    small_batches(queries.sparkSession)
    base = queries.select("query_pk", "text", *query_filters(queries))
    counted = cut_lineage(
        base.select("query_pk", "_process", "_tags", F.explode_outer(tokens(F.col("text"))).alias("term"))
        .filter(F.col("term").isNotNull())
        .groupBy("query_pk", "_process", "_tags", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )
    slices = max(1, -(-counted.count() // SLICE_TERMS))
    order = [F.col("score").desc(), F.col("chunk_id")]
    hits = T.StructType([
        queries.schema["query_pk"], T.StructField("chunk_id", index.blocks.schema["chunk_id"].dataType.elementType),
        T.StructField("score", T.DoubleType()),
    ])
    best = queries.sparkSession.createDataFrame([], hits)
    for number in range(slices):
        # About SLICE_TERMS rows.
        part = counted.filter(F.pmod(F.xxhash64("query_pk"), F.lit(slices)) == number).toPandas()
        if len(part):
            best = best.unionByName(_search_blocks(index.blocks, Asked(part, k), hits, order))
    # A chunk whose best field is a keyword is among the first by that keyword; the same holds for the text.
    documents = index.documents
    keywords = F.explode(F.array("process_name", "tags")).alias("text")
    known = base.join(documents.select(keywords).distinct(), "text", "left_semi")
    small = fits_broadcast(base)
    for field in ("process_name", "tags") if not known.isEmpty() else ():
        best = best.unionByName(top_k(_keyword_hits(base, documents, field, small), ["query_pk"], order, k).drop("rank"))
    merged = best.groupBy("query_pk", "chunk_id").agg(F.max("score").alias("score"))
    return top_k(merged, ["query_pk"], order, k)


class Asked:
    """A slice of queries: their terms with weights, filters and thresholds."""

    def __init__(self, rows, k: int):
        self.k, self.flat, self.steep = k, K1 * (1 - B), 0.0
        self.queries, query = np.unique(rows["query_pk"].to_numpy(), return_inverse=True)
        terms, term = np.unique(rows["term"].to_numpy(object), return_inverse=True)
        order = np.argsort(term, kind="stable")
        self.terms, self.query, self.term = pa.array(terms, pa.string()), query[order], term[order]
        self.qtf = rows["qtf"].to_numpy(float)[order]
        self.first = np.searchsorted(self.term, np.arange(len(terms) + 1))
        one = rows.drop_duplicates("query_pk").set_index("query_pk").loc[self.queries]
        self.filters = [
            (p if isinstance(p, str) else None, frozenset(t) if t is not None and len(t) else None)
            for p, t in zip(one["_process"], one["_tags"], strict=True)
        ]
        numbers = {own: n for n, own in enumerate(dict.fromkeys(self.filters))}
        self.filter = np.array([numbers[own] for own in self.filters], np.int64)
        self.weight = self.qtf
        self.least = np.full(len(self.queries), -np.inf)
        self.read: dict[int, list[int]] = {}

    def weigh(self, having: np.ndarray, total: int, words: int) -> None:
        """Weights from how many of all chunks have each term, and how many words these have together."""
        self.steep = K1 * B * total / max(words, 1)
        self.weight = self.qtf * BOOSTS["text"] * np.log(1 + (total - having + 0.5) / (having + 0.5))[self.term]

    def matched(self, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in the block and here of the terms that both have."""
        here = pa.compute.index_in(terms, value_set=self.terms)
        at = np.flatnonzero(here.is_valid().to_numpy(zero_copy_only=False))
        return at, here.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64)

    def spread(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For terms with these numbers: which of them, and which of our rows (query and weight), for all their queries."""
        sizes = self.first[number + 1] - self.first[number]
        of = np.repeat(np.arange(len(number)), sizes)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.first[number][of]

    def part(self, tf: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        """A term's share of the score by its count and the ratio of the chunk's length to that."""
        return (K1 + 1) / (1 + self.flat / tf + self.steep * ratio)

    def reach(self, batch: pa.RecordBatch, n: int) -> np.ndarray:
        """The most that each query can score in a block."""
        at, number = self.matched(_terms(batch, n))
        most, ratio = (_packed(batch, c, n)[at] for c in ("most_tf", "least_ratio"))
        of, row = self.spread(number)
        # Sums of doubles may differ in their last digits.
        return np.bincount(self.query[row], self.weight[row] * self.part(most, ratio)[of], len(self.queries)) + 1e-6

    def scores(self, batch: pa.RecordBatch, n: int, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query numbers, their scores of all chunks) in a block, for the wanted queries; 0 where a chunk has no term."""
        at, number = self.matched(_terms(batch, n))
        of, row = self.spread(number)
        keep = wanted[self.query[row]]
        of, row = of[keep], row[keep]
        used, of = np.unique(of, return_inverse=True)
        chunks = _packed(batch, "having", n).astype(np.int64)
        rows, tfs = _packed(batch, "rows", n).astype(np.int64), _packed(batch, "tfs", n)
        length = batch.column("length")[n].values.to_numpy()
        sizes, first = chunks[at[used]], (np.cumsum(chunks) - chunks)[at[used]]
        term = np.repeat(np.arange(len(used)), sizes)
        place = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[term]
        shares = np.zeros((len(used), len(length)))
        shares[term, rows[place]] = self.part(tfs[place], length[rows[place]] / tfs[place])
        queries, query = np.unique(self.query[row], return_inverse=True)
        for start in range(0, len(queries), QUERY_SLICE):
            own = queries[start : start + QUERY_SLICE]
            mine = np.flatnonzero((query >= start) & (query < start + QUERY_SLICE))
            cell = (query[mine] - start) * len(used) + of[mine]
            weights = np.bincount(cell, self.weight[row[mine]], len(own) * len(used)).reshape(len(own), len(used))
            yield own, weights @ shares

    def passing(self, process: list, tags: list, queries: np.ndarray) -> np.ndarray:
        """Which chunks of a block pass the filters of the queries."""
        process, tags, masks = np.array(process, object), np.array(tags, object), {}
        for query in queries[np.unique(self.filter[queries], return_index=True)[1]]:
            own = self.filters[query]
            fine = np.ones(len(process), bool) if own[0] is None else process == own[0]
            masks[self.filter[query]] = fine if own[1] is None else fine & np.array([t in own[1] for t in tags], bool)
        return np.array([masks[number] for number in self.filter[queries]], bool).reshape(len(queries), len(process))


def _frequencies(asked: Asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        having = np.zeros(len(asked.terms) + 2, np.int64)  # and all chunks and words
        for batch in batches:
            for n in range(batch.num_rows):
                at, number = asked.matched(_terms(batch, n))
                having[number] += _packed(batch, "having", n)[at]
                length = batch.column("length")[n].values.to_numpy()
                having[-2:] += len(length), length.sum()
        found = np.flatnonzero(having)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(having[found])], ["number", "chunks"])

    return run


def _promising(asked: Asked):
    """For each query the blocks in which it can score most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(asked.queries), PROBES))
        blocks, shelves = np.zeros(best.shape, np.int64), np.zeros(best.shape, np.int64)
        for batch in batches:
            for n in range(batch.num_rows):
                reach = asked.reach(batch, n)
                slot = best.argmin(1)
                better = np.flatnonzero(reach > best[np.arange(len(best)), slot])
                best[better, slot[better]] = reach[better]
                blocks[better, slot[better]] = batch.column("block")[n].as_py()
                shelves[better, slot[better]] = batch.column("shelf")[n].as_py()
        query, slot = np.nonzero(best > 2e-6)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query), *[pa.array(x[query, slot]) for x in (best, blocks, shelves)]],
            ["query", "reach", "block", "shelf"],
        )

    return run


def _within_reach(asked: Asked):
    """Shelves with a block that some query has to read still."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for batch in batches:
            for n in range(batch.num_rows):
                wanted = asked.reach(batch, n) >= np.maximum(asked.least, 2e-6)
                wanted[asked.read.get(batch.column("block")[n].as_py(), [])] = False
                if wanted.any():
                    found.add(batch.column("shelf")[n].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], ["shelf"])

    return run


def _scored(asked: Asked, early: bool, names: list[str], kinds: list[pa.DataType]):
    """The `k` best chunks of each query in the blocks it reads: `early` those noted, else the others within its reach.

    What a query has found in the task raises its threshold there, for hits and for blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        least = np.full(len(asked.queries), -np.inf) if early else asked.least.copy()
        for batch in batches:
            for n in range(batch.num_rows):
                noted = asked.read.get(batch.column("block")[n].as_py(), [])
                wanted = np.zeros(len(asked.queries), bool) if early else asked.reach(batch, n) >= np.maximum(least, 2e-6)
                wanted[noted] = early
                if not wanted.any():
                    continue
                ids, process, tags = (batch.column(c)[n].values for c in ("chunk_id", "process_name", "tags"))
                process, tags = process.to_pylist(), tags.to_pylist()
                for queries, found in asked.scores(batch, n, wanted):
                    scores = np.round(found, SCORE_DIGITS)
                    fine = (found > 0) & (scores >= least[queries][:, None]) & asked.passing(process, tags, queries)
                    hit, chunk = np.nonzero(fine)
                    near = ids.take(pa.array(chunk)).to_pylist()
                    for query, score, c in zip(queries[hit].tolist(), scores[hit, chunk].tolist(), near, strict=True):
                        best.setdefault(query, []).append((-score, c))
                    for query in set(queries[hit].tolist()):
                        held = best[query]
                        if len(held) >= (2 if least[query] > -np.inf else 1) * asked.k:
                            held.sort()
                            del held[asked.k :]
                            least[query] = max(least[query], -held[-1][0])
        rows = [(asked.queries[q], c, -s) for q, held in best.items() for s, c in sorted(held)[: asked.k]]
        columns = zip(*rows, strict=True) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _search_blocks(blocks: DataFrame, asked: Asked, hits: T.StructType, order: list[Column]) -> DataFrame:
    """The best `k` chunks of each query of the slice by the text field."""
    names, kinds = hits.names, [to_arrow_type(f.dataType) for f in hits.fields]
    having = np.zeros(len(asked.terms) + 2)
    frequencies = blocks.select("terms", "having", "length").mapInArrow(_frequencies(asked), "number long, chunks long")
    for row in frequencies.groupBy("number").agg(F.sum("chunks").alias("chunks")).collect():  # one row per term
        having[row["number"]] = row["chunks"]
    asked.weigh(having[:-2], *having[-2:])
    bounds = blocks.select("block", "shelf", "terms", "most_tf", "least_ratio")
    promising = bounds.mapInArrow(_promising(asked), "query long, reach double, block long, shelf long")
    # PROBES rows per query.
    probed = top_k(promising, ["query"], [F.col("reach").desc(), F.col("block")], PROBES).collect()
    for row in probed:
        asked.read.setdefault(row["block"], []).append(row["query"])
    nearby = blocks.filter(F.col("shelf").isin(sorted({r["shelf"] for r in probed})) & F.col("block").isin(sorted(asked.read)))
    read = [c for c in _BLOCK if c not in ("chunks", "total_tf", "shelf")]
    found = nearby.select(*read).mapInArrow(_scored(asked, True, names, kinds), hits)
    early = cut_lineage(top_k(found, ["query_pk"], order, asked.k).drop("rank"))
    known = early.groupBy("query_pk").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    for row in known.filter(F.col("n") >= asked.k).collect():  # one row per query
        asked.least[np.searchsorted(asked.queries, row["query_pk"])] = row["least"]
    shelves = [r["shelf"] for r in bounds.mapInArrow(_within_reach(asked), "shelf long").distinct().collect()]
    near = blocks.filter(F.col("shelf").isin(shelves))
    late = near.select(*read).mapInArrow(_scored(asked, False, names, kinds), hits)
    return early.unionByName(top_k(late, ["query_pk"], order, asked.k).drop("rank"))


def _keyword_hits(queries: DataFrame, documents: DataFrame, field: str, small: bool) -> DataFrame:
    """Chunks whose keyword equals the query string; every keyword has frequency and length one."""
    wanted = queries.withColumnRenamed("text", "_key")
    keyed = documents.filter(F.col(field).isNotNull()).withColumn("_key", F.col(field))
    present = documents.groupBy(F.col(field).alias("_key")).agg(F.count(F.lit(1)).alias("_df"))
    fielded = documents.agg(F.count(field).alias("n")).scalar()
    weighted = wanted.join(present, "_key").withColumn("_w", idf(fielded, F.col("_df")) * BOOSTS[field])
    return (
        join_hot(keyed, weighted, ["_key"], ["chunk_id"], small)
        .filter(allowed(F.col("process_name"), F.col("tags")))
        .select("query_pk", "chunk_id", F.round("_w", SCORE_DIGITS).alias("score"))
    )
