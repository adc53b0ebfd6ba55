"""The scoring job: which metric applies to which run item, all in one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.text import blank
from ragloom.operators import judging, metrics

# Judge settings of a run's configuration.
DEFAULT_JUDGE_METRICS = '["consistency"]'
SEMANTIC_VERSION = "semantic"
TITLE_VERSION = "1800"


def qrels_version(config_json: Column) -> Column:
    """The gold version that belongs to a run's chunking strategy."""
    strategy = F.get_json_object(config_json, "$.factors.chunking.strategy")
    return F.when(strategy == "semantic", SEMANTIC_VERSION).otherwise(TITLE_VERSION)


def qrels_for_runs(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """Gold of every run: qrels of the version its configuration picks, with run_id."""
    return runs.select("run_id", qrels_version(F.col("config_json")).alias("qrels_version")).join(
        qrels, "qrels_version"
    )


def _long(rows: DataFrame, names: dict[str, Column], details: Column | None = None) -> DataFrame:
    pairs = [
        F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")) for name, value in names.items()
    ]
    kept = rows.select(
        "run_id", "query_pk", (details if details is not None else F.lit(None).cast("string")).alias("details"),
        F.inline(F.array(*pairs)),
    )
    return kept.filter(F.col("value").isNotNull()).select("run_id", "query_pk", "metric", "value", "details")


def score_runs(
    runs: DataFrame,
    run_items: DataFrame,
    logs: DataFrame,
    qrels: DataFrame,
    gold_answers: DataFrame,
    judge_outputs: DataFrame | None = None,
    pair_vectors: DataFrame | None = None,
) -> DataFrame:
    """(run_id, query_pk, metric, value, details) for all run items at once.

    Retrieval metrics need a ranking and gold; text metrics an answer and a gold answer, of which the first is the
    reference; citation metrics an answer. Judge outputs (run_id, query_pk, judge, raw) count if the run's
    configuration enables the judge and its metric, and if their inputs exist. pair_vectors (run_id, query_pk,
    answer_vector, gold_vector) supplies the embeddings of answer and reference.
    """
    keys = ["run_id", "query_pk"]
    # Runs can pick different gold versions, so the query key carries the version.
    versions = runs.select("run_id", qrels_version(F.col("config_json")).alias("qrels_version"))

    def versioned(rows: DataFrame) -> DataFrame:
        if "qrels_version" not in rows.columns:
            rows = rows.join(versions, "run_id")
        return rows.withColumn("query_pk", F.struct("qrels_version", "query_pk")).drop("qrels_version")

    def plain(rows: DataFrame) -> DataFrame:
        return rows.select(
            "run_id", F.col("query_pk.query_pk").alias("query_pk"), "metric", "value",
            F.lit(None).cast("string").alias("details"),
        )

    gold = versioned(qrels.select("qrels_version", "query_pk", "chunk_id", "relevance"))
    ranking = metrics.evaluated_ranking(logs, limit=max(metrics.CUTOFFS)).join(
        run_items.select(*keys), keys, "left_semi"
    )
    parts = [plain(metrics.retrieval_metrics(versioned(ranking), gold))]

    answered = run_items.filter(F.length("answer_text") > 0)
    references = gold_answers.filter(F.size("answers") > 0).select("query_pk", F.col("answers")[0].alias("gold"))
    pairs = answered.join(references.filter(F.length("gold") > 0), "query_pk").select(
        *keys, F.col("answer_text").alias("pred"), "gold"
    )
    texts = {"content_f1": F.col("content_f1"), "rouge_l_recall": F.col("rouge_l_recall")}
    scored = metrics.content_f1(metrics.rouge_l(pairs))
    if pair_vectors is not None:
        scored = scored.join(pair_vectors, keys, "left")
        similarity = metrics.semantic_similarity(
            F.col("answer_vector"), F.col("gold_vector"), F.col("pred"), F.col("gold")
        )
        texts["semantic_sim"] = F.when(F.col("answer_vector").isNotNull(), similarity)
    parts.append(_long(scored, texts))

    cited = metrics.citations(answered)
    parts.append(plain(metrics.citation_metrics(versioned(answered), versioned(cited), gold)))
    if judge_outputs is not None:
        parts += _judged(runs, answered, cited, references, judge_outputs)
    return reduce(DataFrame.unionByName, parts)


def _judged(
    runs: DataFrame, answered: DataFrame, cited: DataFrame, references: DataFrame, judge_outputs: DataFrame
) -> list[DataFrame]:
    keys = ["run_id", "query_pk"]
    config = F.col("config_json")
    enabled = F.coalesce(F.get_json_object(config, "$.factors.evaluation.use_llm_judge"), F.lit("true")) == "true"
    chosen = F.coalesce(F.get_json_object(config, "$.factors.evaluation.llm_metrics"), F.lit(DEFAULT_JUDGE_METRICS))
    active = runs.filter(enabled).select("run_id", F.from_json(chosen, "array<string>").alias("_metrics"))
    with_text = cited.filter(F.length("text") > 0).select(*keys).distinct().withColumn("_texts", F.lit(True))
    hint = F.coalesce(F.get_json_object("meta", "$.gating_hint"), F.lit(""))
    items = (
        answered.select(*keys, hint.alias("hint"))
        .join(active, "run_id")
        .join(with_text, keys, "left")
        .join(references.select("query_pk", F.lit(True).alias("_gold")), "query_pk", "left")
    )
    rows = judging.judge_scores(judging.parse_judge(judge_outputs.join(items, keys)))
    details = F.to_json(F.struct(judging.reasoning(F.col("parsed")).alias("reasoning")))
    has = lambda name: F.array_contains("_metrics", name)
    judge = F.col("judge")
    simple = {
        "answer_relevance": ("llm_answer_relevance", has("relevance")),
        "context_relevance": ("llm_context_relevance", has("relevance") & F.col("_texts")),
        "faithfulness": ("llm_faithfulness", has("faithfulness") & F.col("_texts")),
    }
    parts = [
        _long(
            rows.filter((judge == "consistency") & has("consistency") & F.col("_gold")),
            {"factual_consistency_score": F.col("score"), "factual_consistency_normalized": F.col("normalized")},
            details,
        )
    ]
    parts += [
        _long(rows.filter((judge == name) & condition), {metric: F.col("normalized")}, details)
        for name, (metric, condition) in simple.items()
    ]
    gating = judging.judge_gating(rows.filter((judge == "gating") & ~blank(F.col("hint"))))
    parts.append(_long(gating, {c: F.col(c) for c in gating.columns if c.startswith("h2_")}, details))
    grey = judging.judge_grey_zone(rows.filter((judge == "gray_zone") & has("gray_zone")), F.col("_texts").isNull())
    numeric = [c for c in grey.columns if c.startswith("h3_") and c != "h3_response_type"]
    parts.append(_long(grey, {c: F.col(c) for c in numeric}, details))
    return parts
