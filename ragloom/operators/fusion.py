"""Rank fusion, hydration, reranking and evidence over tables of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.scale import cut_lineage, fits_broadcast, top_k
from ragloom.functions.text import blank, joined_in_order, or_null
from ragloom.operators.dense import vector_topk
from ragloom.operators.lexical import TextIndex, bm25_topk

# Fusion constant, over-fetch factor, fallback step, confidence levels and display limits.
RRF_K = 60
OVERFETCH = 5
FALLBACK_STEP = 0.1
CONFIDENCE_HIGH = 0.75
CONFIDENCE_MEDIUM = 0.5
CONFIDENCE_TOP = 3
DISPLAY_CHARS = 300
DISPLAY_DIGITS = 4

# Wording of evidence blocks.
SOURCE_LABEL = "Quelle"
UNKNOWN_SOURCE = "unbekannt"
DOCUMENT_FOR = "Dokument zu "
UNKNOWN_DOCUMENT = "Unbekanntes Dokument"
PROCESS_CONTEXT = "Prozesskontext"
PROCESS_FILE = "BPMN-Prozess: "
PROCESS_TITLE = "Prozessmodell: "
STREAMED_CHUNK = "Chunk"
STREAMED_DOCUMENT = "Dokument"
STREAMED_RULE = "\n\n---\n\n"

EVIDENCE_META = ["tags", "page_number", "section_title"]

SOURCE_LABELS = {"hybrid": "rrf", "vector_only": "vector", "bm25_only": "bm25"}


def rrf_weight(rank: Column, k: int | None = RRF_K) -> Column:
    """Reciprocal-rank weight; k of 0 or none means the default."""
    return 1.0 / (F.lit(k or RRF_K) + rank)


def rrf(ranked: DataFrame, k: int | None = RRF_K) -> DataFrame:
    return ranked.withColumn("weight", rrf_weight(F.col("rank"), k))


def fuse(bm25: DataFrame, dense: DataFrame, k: int | None = RRF_K) -> DataFrame:
    """Sum of weights over both lists: (query_pk, chunk_id, bm25_rank, vec_rank, score)."""
    a = bm25.select("query_pk", "chunk_id", F.col("rank").alias("bm25_rank"))
    b = dense.select("query_pk", "chunk_id", F.col("rank").alias("vec_rank"))
    both = a.join(b, ["query_pk", "chunk_id"], "full_outer")
    weights = [F.coalesce(rrf_weight(F.col(rank), k), F.lit(0.0)) for rank in ("bm25_rank", "vec_rank")]
    return both.withColumn("score", weights[0] + weights[1])


def fused_order() -> list[Column]:
    """Best score first; ties keep the text list's order, then the vector list's."""
    return [F.col("score").desc(), F.col("bm25_rank").asc_nulls_last(), F.col("vec_rank").asc_nulls_last()]


def hybrid_search(
    queries: DataFrame,
    index: TextIndex | None,
    chunk_vectors: DataFrame | None,
    k: int,
    mode: str = "hybrid",
    rerank_top_n: int | None = None,
    rrf_k: int | None = RRF_K,
) -> DataFrame:
    """Candidates per query: (query_pk, chunk_id, rrf_score, source, rank).

    queries: query_pk, text, embedding[, filter_process, filter_tags]. Each list is over-fetched 5 times, or to
    `rerank_top_n` when the candidates are to be reranked.
    """
    fetch = rerank_top_n or k * OVERFETCH
    keep = rerank_top_n or k
    lists = {}
    if mode in ("hybrid", "bm25_only"):
        lists["bm25"] = bm25_topk(queries.drop("embedding"), index, fetch)
    if mode in ("hybrid", "vector_only"):
        lists["dense"] = vector_topk(queries.drop("text"), chunk_vectors, fetch)
    if mode == "hybrid":
        fused = top_k(fuse(lists["bm25"], lists["dense"], rrf_k), ["query_pk"], fused_order(), keep)
        hits = fused.withColumnRenamed("score", "rrf_score")
    else:
        (only,) = lists.values()
        hits = only.filter(F.col("rank") <= keep).withColumn("rrf_score", rrf_weight(F.col("rank"), rrf_k))
    return hits.select(
        "query_pk", "chunk_id", "rrf_score", F.lit(SOURCE_LABELS.get(mode, "bm25")).alias("source"), "rank"
    )


def search_modes(
    queries: DataFrame, index: TextIndex, chunk_vectors: DataFrame, k: int, rrf_k: int | None = RRF_K
) -> DataFrame:
    """Hits of all three modes with `mode`, for studies: each list is searched once and stored."""
    text = cut_lineage(bm25_topk(queries.drop("embedding"), index, k * OVERFETCH))
    near = cut_lineage(vector_topk(queries.drop("text"), chunk_vectors, k * OVERFETCH))
    fused = top_k(fuse(text, near, rrf_k), ["query_pk"], fused_order(), k).select(
        "query_pk", "chunk_id", F.col("score").alias("rrf_score"), "rank", F.lit("hybrid").alias("mode")
    )
    single = [
        hits.filter(F.col("rank") <= k).select(
            "query_pk", "chunk_id", rrf_weight(F.col("rank"), rrf_k).alias("rrf_score"), "rank", F.lit(mode).alias("mode")
        )
        for mode, hits in (("bm25_only", text), ("vector_only", near))
    ]
    return fused.unionByName(single[0]).unionByName(single[1])


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk columns for the surviving hits only; a hit without a chunk row disappears, ranks close up.

    The hits are stored first: as long as they are few they go to the chunks, whose texts are not shuffled then.
    """
    wanted = "chunk_id text document_id file_name process_name tags page_number section_title title".split()
    hits = cut_lineage(hits)
    hits = F.broadcast(hits) if fits_broadcast(hits) else hits
    rows = hits.join(chunks.select(*[c for c in wanted if c in chunks.columns]), "chunk_id")
    title = or_null(F.col("title")) if "title" in chunks.columns else F.lit(None).cast("string")
    section = F.col("section_title") if "section_title" in chunks.columns else F.lit(None).cast("string")
    rows = rows.withColumn("title", F.coalesce(title, section)).withColumnRenamed("rank", "_hit")
    close_up = Window.partitionBy("query_pk").orderBy("_hit")
    return rows.withColumn("rank", F.row_number().over(close_up)).drop("_hit")


def rerank(hits: DataFrame, queries: DataFrame, pair_scores: DataFrame, k: int) -> DataFrame:
    """Order candidates by supplied pair scores (query_pk, chunk_id, pair_score); final rank 1..k.

    A blank query passes through. A query none of whose candidates has a score keeps its order with placeholder
    scores 1.0, 0.9, … and the label of fusion.
    """
    rows = (
        hits.join(pair_scores, ["query_pk", "chunk_id"], "left")
        .join(queries.select("query_pk", blank(F.col("text")).alias("_blank")), "query_pk", "left")
    )
    scored = rows.groupBy("query_pk").agg((F.count("pair_score") > 0).alias("_scored"))
    rows = rows.join(scored, "query_pk")
    passes = F.coalesce(F.col("_blank"), F.lit(False))
    by_model = F.col("_scored") & ~passes
    ordered = rows.withColumnRenamed("rank", "first_rank").withColumn(
        "_order", F.when(by_model, -F.coalesce("pair_score", F.lit(float("-inf")))).otherwise(0.0)
    )
    best = top_k(ordered, ["query_pk"], [F.col("_order"), F.col("first_rank")], k)
    fallback = 1.0 - (F.col("rank") - 1) * FALLBACK_STEP
    return best.withColumn(
        "rerank_score", F.when(passes, F.lit(None)).when(by_model, F.col("pair_score")).otherwise(fallback)
    ).withColumn(
        "source", F.when(passes, F.col("source")).when(by_model, F.lit("ce")).otherwise(F.lit("rrf"))
    ).drop("_blank", "_scored", "_order", "pair_score", "first_rank")


def chunk_confidence(rerank_score: Column, score: Column, logistic: bool = True) -> Column:
    """Logistic of a cross-encoder score, else the cosine clipped to 0..1, else null.

    `logistic=False` takes scores that are already normalised as they are.
    """
    model = 1.0 / (1.0 + F.exp(-rerank_score)) if logistic else rerank_score
    return F.when(rerank_score.isNotNull(), model).when(
        score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    )


def answer_confidence(hits: DataFrame, logistic: bool = True, queries: DataFrame | None = None) -> DataFrame:
    """Highest confidence per query and its level: (query_pk, confidence, level).

    With `queries` (query_pk), those without a hit are there too, with confidence 0.
    """
    per_chunk = chunk_confidence(F.col("rerank_score"), F.col("score"), logistic)
    # The maximum of the three highest is the maximum.
    best = hits.groupBy("query_pk").agg(F.max(per_chunk).alias("confidence"))
    if queries is not None:
        found = best.withColumn("_hit", F.lit(True))
        best = queries.select("query_pk").join(found, "query_pk", "left").select(
            "query_pk", F.when(F.col("_hit").isNull(), 0.0).otherwise(F.col("confidence")).alias("confidence")
        )
    level = (
        F.when(F.col("confidence") >= CONFIDENCE_HIGH, "high")
        .when(F.col("confidence") >= CONFIDENCE_MEDIUM, "medium")
        .otherwise("low")
    )
    return best.withColumn("level", level)


def first_confidence(hits: DataFrame) -> DataFrame:
    """Confidence that is recorded with a run: (query_pk, confidence).

    Logistic of the cross-encoder score of the first hit that has one, else the clipped cosine of the first dense hit,
    else null. hits: query_pk, rank, rerank_score, score.
    """
    scored = lambda name: F.min_by(name, F.when(F.col(name).isNotNull(), F.col("rank")))
    first = hits.groupBy("query_pk").agg(scored("rerank_score").alias("_model"), scored("score").alias("_dense"))
    return first.select("query_pk", chunk_confidence(F.col("_model"), F.col("_dense")).alias("confidence"))


def context_block(hits: DataFrame, streamed: bool = False) -> DataFrame:
    """Numbered chunks in rank order as one text per query; a query has at most its k hits.

    `streamed` gives the form that answers are streamed with: chunks named by their files, between rules.
    """
    number, text = F.col("rank").cast("string"), F.coalesce("text", F.lit(""))
    if streamed:
        file_name = F.coalesce("file_name", F.lit(STREAMED_DOCUMENT))
        entry = F.concat(F.lit(f"[{STREAMED_CHUNK} "), number, F.lit(f"] {SOURCE_LABEL}: "), file_name, F.lit("\n"), text)
        return hits.groupBy("query_pk").agg(joined_in_order(F.col("rank"), entry, STREAMED_RULE).alias("context"))
    entry = F.concat(
        F.lit("["), number, F.lit(f"] ({SOURCE_LABEL}: "), F.coalesce("chunk_id", F.lit(UNKNOWN_SOURCE)), F.lit(")\n"), text,
    )
    return hits.groupBy("query_pk").agg(joined_in_order(F.col("rank"), entry, "\n\n").alias("context"))


def evidence_rows(hits: DataFrame, gated: DataFrame) -> DataFrame:
    """Rows for display; the process model comes first where a gating context is on.

    hits: query_pk, rank, chunk_id, text, rrf_score, rerank_score and chunk columns; gated: query_pk, mode,
    process_id, process_name, hint. Tags, page number and section title come from the chunk; the model has none.
    """
    def meta(name: str) -> Column:
        return (F.col(name) if name in hits.columns else F.lit(None)).cast("string").alias(name)

    def shown(name: str) -> Column:
        return F.when(F.col(name) != 0, F.round(name, DISPLAY_DIGITS)).alias(
            "score" if name == "rrf_score" else name
        )

    file_name = F.coalesce(
        or_null(F.col("file_name")),
        F.concat(F.lit(DOCUMENT_FOR), or_null(F.col("process_name"))),
        F.lit(UNKNOWN_DOCUMENT),
    )
    chunks = hits.select(
        "query_pk", F.col("rank").alias("position"), "chunk_id",
        F.substring("text", 1, DISPLAY_CHARS).alias("text"),
        shown("rrf_score"), shown("rerank_score"),
        "process_name", file_name.alias("filename"), "title", *[meta(name) for name in EVIDENCE_META],
    )
    model = gated.filter(F.col("mode").isin("process", "gating") & (F.length("process_name") > 0)).select(
        "query_pk", F.lit(0).alias("position"),
        F.concat(F.lit("bpmn_"), F.coalesce(or_null(F.col("process_id")), F.col("process_name"))).alias("chunk_id"),
        F.coalesce(or_null(F.substring("hint", 1, DISPLAY_CHARS)), F.lit(PROCESS_CONTEXT)).alias("text"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("rerank_score"),
        "process_name",
        F.concat(F.lit(PROCESS_FILE), F.col("process_name")).alias("filename"),
        F.concat(F.lit(PROCESS_TITLE), F.col("process_name")).alias("title"),
        *[F.lit(None).cast("string").alias(name) for name in EVIDENCE_META],
    )
    return model.unionByName(chunks)
