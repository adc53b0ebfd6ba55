"""Retrieval, text-overlap and citation metrics per run and query, in long form (run_id, query_pk, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.functions.scale import BLOCK_ROWS, blocked_row_number, top_k
from ragloom.functions.text import STOP_WORDS, blank, or_null, tokens
from ragloom.functions.vectors import dot

# Ranking sources in order of preference, and cutoffs.
RANKING_SOURCES = ["ce", "rrf"]
CUTOFFS = [3, 5, 10]
NORM_EPSILON = 1e-9


def evaluated_ranking(
    logs: DataFrame, sources: Sequence[str] = RANKING_SOURCES, fallback: bool = True, limit: int | None = None
) -> DataFrame:
    """The ranking that is scored: (run_id, query_pk, position, chunk_id).

    Rows of preferred sources in source order, then rank; lists are concatenated and repeated chunks stay. A query
    without a preferred row uses all its rows by rank. With `limit` only the first positions are kept, which prunes
    before the shuffle.
    """
    keys = ["run_id", "query_pk"]
    place = F.array_position(F.array(*[F.lit(s) for s in sources]).cast("array<string>"), F.col("source"))
    rows = logs.withColumn("_place", F.coalesce(place, F.lit(0)))
    preferred = rows.filter(F.col("_place") > 0)
    kept = preferred
    if fallback:
        kept = kept.unionByName(rows.join(preferred.select(*keys).distinct(), keys, "left_anti").select(*rows.columns)
                                .withColumn("_place", F.lit(0).cast("long")))
    order = [F.col("_place"), F.col("rank"), F.col("source"), F.col("chunk_id")]
    if limit is not None:
        ranked = top_k(kept, keys, order, limit, "position")
    else:
        block = F.col("_place") * (1 << 40) + F.floor(F.col("rank") / BLOCK_ROWS)
        ranked = blocked_row_number(kept, keys, block, order, "position")
    return ranked.select(*keys, F.col("position").cast("long").alias("position"), "chunk_id")


def _gain(relevance: Column, position: Column) -> Column:
    return F.when(relevance > 0, (F.pow(F.lit(2.0), relevance) - 1) / F.log2(position + 1)).otherwise(0.0)


def retrieval_metrics(
    ranking: DataFrame,
    qrels: DataFrame,
    ks: Sequence[int] = CUTOFFS,
    measures: Sequence[str] = ("recall", "mrr", "ndcg"),
    dedupe: bool = False,
) -> DataFrame:
    """recall@k, mrr@k and ndcg@k for queries that have a ranking and gold.

    Repeated chunks count each time, so recall can pass 1, unless `dedupe` keeps only their first position.
    """
    keys, deepest = ["run_id", "query_pk"], max(ks)
    if dedupe:
        first = ranking.groupBy(*keys, "chunk_id").agg(F.min("position").alias("position"))
        ranking = top_k(first.withColumnRenamed("position", "_p"), keys, [F.col("_p")], deepest, "position").drop("_p")
    near = ranking.filter(F.col("position") <= deepest)
    position, relevance = F.col("position"), F.col("relevance")
    judged = near.join(qrels.select("query_pk", "chunk_id", "relevance"), ["query_pk", "chunk_id"], "left")
    hit = relevance > 0
    found = judged.groupBy(*keys).agg(
        F.min(F.when(hit, position)).alias("_first"),
        *[F.count_if(hit & (position <= k)).alias(f"_hits{k}") for k in ks],
        *[F.sum(F.when(position <= k, _gain(relevance, position)).otherwise(0.0)).alias(f"_dcg{k}") for k in ks],
    )
    ideal = top_k(qrels.select("query_pk", "chunk_id", "relevance"), ["query_pk"],
                  [F.col("relevance").desc(), F.col("chunk_id")], deepest, "position")
    best = ideal.groupBy("query_pk").agg(
        *[F.sum(F.when(position <= k, _gain(relevance, position)).otherwise(0.0)).alias(f"_ideal{k}") for k in ks]
    )
    gold = qrels.groupBy("query_pk").agg(F.count_if(hit).alias("_gold")).join(best, "query_pk")
    values = {
        "recall": lambda k: F.when(F.col("_gold") > 0, F.col(f"_hits{k}") / F.col("_gold")).otherwise(0.0),
        "mrr": lambda k: F.when(F.col("_first") <= k, 1.0 / F.col("_first")).otherwise(0.0),
        "ndcg": lambda k: F.when(F.col(f"_ideal{k}") > 0, F.col(f"_dcg{k}") / F.col(f"_ideal{k}")).otherwise(0.0),
    }
    pairs = [
        F.struct(F.lit(f"{m}@{k}").alias("metric"), values[m](k).cast("double").alias("value"))
        for m in measures for k in ks
    ]
    return found.join(gold, "query_pk").select(*keys, F.inline(F.array(*pairs)))


def recall_at_k(ranking: DataFrame, qrels: DataFrame, ks: Sequence[int] = CUTOFFS) -> DataFrame:
    return retrieval_metrics(ranking, qrels, ks, ["recall"])


def mrr_at_k(ranking: DataFrame, qrels: DataFrame, ks: Sequence[int] = CUTOFFS) -> DataFrame:
    return retrieval_metrics(ranking, qrels, ks, ["mrr"])


def ndcg_at_k(ranking: DataFrame, qrels: DataFrame, ks: Sequence[int] = CUTOFFS) -> DataFrame:
    return retrieval_metrics(ranking, qrels, ks, ["ndcg"])


def _f1(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total > 0, 2 * precision * recall / F.nullif(total, F.lit(0.0))).otherwise(0.0)


def content_f1(
    pairs: DataFrame, pred: str = "pred", gold: str = "gold", stop_words: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """Add content_f1, the F1 of the word sets of two texts without stop words."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    sets = pairs.withColumn("_a", F.array_except(tokens(F.coalesce(pred, F.lit(""))), stop)).withColumn(
        "_b", F.array_except(tokens(F.coalesce(gold, F.lit(""))), stop)
    )
    sizes = sets.withColumn("_common", F.size(F.array_intersect("_a", "_b")))
    precision = F.col("_common") / F.nullif(F.size("_a"), F.lit(0))
    recall = F.col("_common") / F.nullif(F.size("_b"), F.lit(0))
    value = F.when(F.col("_common") == 0, 0.0).otherwise(_f1(precision, recall))
    return sizes.withColumn("content_f1", value).drop("_a", "_b", "_common")


def common_subsequence(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, one big-integer step per word of `b`."""
    masks: dict[str, int] = {}
    for place, word in enumerate(a):
        masks[word] = masks.get(word, 0) | (1 << place)
    full = (1 << len(a)) - 1
    open_places = full
    for word in b:
        matched = open_places & masks.get(word, 0)
        open_places = ((open_places + matched) | (open_places - matched)) & full
    return len(a) - open_places.bit_count()


@F.pandas_udf(T.IntegerType())
def _lcs(pred: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([common_subsequence(a, b) for a, b in zip(pred, gold)], dtype="int32")


def rouge_l(pairs: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Add rouge_l_precision, rouge_l_recall and rouge_l_f1; whole texts are compared."""
    sized = pairs.withColumn("_a", tokens(F.coalesce(pred, F.lit("")))).withColumn(
        "_b", tokens(F.coalesce(gold, F.lit("")))
    ).withColumn("_lcs", _lcs("_a", "_b"))
    precision = F.coalesce(F.col("_lcs") / F.nullif(F.size("_a"), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("_lcs") / F.nullif(F.size("_b"), F.lit(0)), F.lit(0.0))
    return (
        sized.withColumn("rouge_l_precision", precision)
        .withColumn("rouge_l_recall", recall)
        .withColumn("rouge_l_f1", _f1(F.col("rouge_l_precision"), F.col("rouge_l_recall")))
        .drop("_a", "_b", "_lcs")
    )


def semantic_similarity(pred_vector: Column, gold_vector: Column, pred: Column, gold: Column) -> Column:
    """Cosine of two supplied vectors, not below 0; 0 for blank text."""
    scale = (F.sqrt(dot(pred_vector, pred_vector)) + NORM_EPSILON) * (
        F.sqrt(dot(gold_vector, gold_vector)) + NORM_EPSILON
    )
    return F.when(blank(pred) | blank(gold), 0.0).otherwise(
        F.greatest(F.lit(0.0), dot(pred_vector, gold_vector) / scale)
    )


def citations(run_items: DataFrame) -> DataFrame:
    """Cited chunks of each item: (run_id, query_pk, position, chunk_id, text).

    The JSON list holds ids or objects with chunk_id, id or chunkId, and text.
    """
    listed = F.posexplode(F.from_json("citations", "array<string>")).alias("position", "_entry")
    rows = run_items.select("run_id", "query_pk", listed)
    is_object = F.col("_entry").startswith("{")
    field = lambda name: or_null(F.get_json_object("_entry", f"$.{name}"))
    return rows.select(
        "run_id", "query_pk", "position",
        F.when(is_object, F.coalesce(field("chunk_id"), field("id"), field("chunkId")))
        .otherwise(F.col("_entry")).alias("chunk_id"),
        F.when(is_object, field("text")).alias("text"),
    )


def citation_metrics(run_items: DataFrame, cited: DataFrame, qrels: DataFrame) -> DataFrame:
    """citation_recall (no gold: 1, no citation: 0) and citation_precision (no citation: 1), on sets of ids."""
    keys = ["run_id", "query_pk"]
    relevant = qrels.filter(F.col("relevance") > 0).select("query_pk", "chunk_id").distinct()
    gold = relevant.groupBy("query_pk").agg(F.count(F.lit(1)).alias("_gold"))
    once = cited.filter(F.col("chunk_id").isNotNull()).select(*keys, "chunk_id").distinct()
    counted = once.join(relevant.withColumn("_hit", F.lit(1)), ["query_pk", "chunk_id"], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_cited"), F.count("_hit").alias("_hits")
    )
    rows = (
        run_items.select(*keys).join(counted, keys, "left").join(gold, "query_pk", "left")
        .fillna(0, ["_cited", "_hits", "_gold"])
    )
    recall = F.when(F.col("_gold") == 0, 1.0).otherwise(F.col("_hits") / F.nullif("_gold", F.lit(0)))
    precision = F.when(F.col("_cited") == 0, 1.0).otherwise(F.col("_hits") / F.nullif("_cited", F.lit(0)))
    return rows.select(*keys, F.inline(F.array(
        F.struct(F.lit("citation_recall").alias("metric"), recall.alias("value")),
        F.struct(F.lit("citation_precision").alias("metric"), precision.alias("value")),
    )))


def gating_metrics(pairs: DataFrame) -> DataFrame:
    """Recall and precision of predicted lanes, nodes and tasks, and their means, as columns.

    pairs: lane_ids, node_ids, task_names (predicted) and expected_lane_ids, expected_node_ids, expected_task_names.
    """
    kinds = ["lane_ids", "node_ids", "task_names"]
    result = pairs
    for kind in kinds:
        pred, gold = F.array_distinct(kind), F.array_distinct(f"expected_{kind}")
        hits = F.size(F.array_intersect(pred, gold))
        result = result.withColumn(
            f"{kind}_recall", F.when(F.size(gold) == 0, 1.0).otherwise(hits / F.nullif(F.size(gold), F.lit(0)))
        ).withColumn(
            f"{kind}_precision",
            F.when(F.size(pred) > 0, hits / F.nullif(F.size(pred), F.lit(0)))
            .when(F.size(gold) == 0, 1.0).otherwise(0.0),
        )
    for side in ("recall", "precision"):
        total = sum((F.col(f"{kind}_{side}") for kind in kinds), F.lit(0.0))
        result = result.withColumn(f"avg_gating_{side}", total / len(kinds))
    return result
