"""Evaluation data sets as JSON lines, and keyed upserts into the evaluation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions.scale import top_k

QUERY_FIELDS = """query_id string, text string, process_name string, process_id string, roles array<string>,
current_node_id string, definition_id string, query_type string, expected_source string"""

GATING_FIELDS = "expected_lane_ids expected_node_ids expected_lane_names expected_task_names".split()

QRELS_FIELDS = "query_id string, chunk_id string, relevance variant, gating string"
GATING_TYPE = "struct<{}>".format(", ".join(f"{name}: array<string>" for name in GATING_FIELDS))

# Keys of the evaluation tables, and the columns that keep their old value when an update brings null.
TABLE_KEYS = {
    "runs": ["name"],
    "queries": ["dataset", "query_id"],
    "qrels": ["query_pk", "chunk_id", "qrels_version"],
    "run_items": ["run_id", "query_pk"],
    "retrieval_logs": ["run_id", "query_pk", "rank", "source"],
    "scores": ["run_id", "query_pk", "metric"],
    "aggregates": ["run_id", "metric"],
    "gold_answers": ["query_pk"],
    "gold_gating": ["query_pk"],
}
KEEP_IF_NULL = {"qrels": ["document_id"], "retrieval_logs": ["document_id"]}


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with `_line`, an ordering of the lines inside their file."""
    return spark.read.schema(schema).json(path).select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("_line"),
    )


def read_queries(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Queries of a data set; the last line of a query id wins."""
    lines = _lines(spark, path, QUERY_FIELDS).filter(F.col("query_id").isNotNull())
    latest = top_k(lines, ["query_id"], [F.col("_line").desc()], 1).drop("rank", "_line")
    return latest.select(
        F.xxhash64(F.lit(dataset), "query_id").alias("query_pk"),
        F.lit(dataset).alias("dataset"),
        *[c for c in latest.columns if c not in ("query_type", "expected_source")],
        F.coalesce("query_type", F.lit("mixed")).alias("query_type"),
        F.coalesce("expected_source", F.lit("both")).alias("expected_source"),
    )


def parse_qrels(lines: DataFrame, queries: DataFrame, version: str = "1800") -> tuple[DataFrame, DataFrame]:
    """(qrels, rejected lines) from (query_id, chunk_id, relevance as text or variant[, _line]).

    Lines of unknown queries are rejected. A relevance that is a number loses its fraction, text must be an integer, a
    truth value is 1 or 0; anything else counts as 1, and a negative relevance as 0. Lines without a chunk id carry no
    judgement.
    """
    known = queries.select("query_id", "query_pk")
    rejects = lines.join(known, "query_id", "left_anti").drop("_line")
    graded = lines.join(known, "query_id").filter(F.length("chunk_id") > 0)
    qrels = graded.select(
        "query_pk",
        "chunk_id",
        F.lit(None).cast("string").alias("document_id"),
        F.greatest(F.coalesce(_grade(lines), F.lit(1)), F.lit(0)).alias("relevance"),
        F.lit(version).alias("qrels_version"),
        *(["_line"] if "_line" in lines.columns else []),
    )
    if "_line" in lines.columns:
        qrels = top_k(qrels, TABLE_KEYS["qrels"], [F.col("_line").desc()], 1).drop("rank", "_line")
    return qrels, rejects


def _grade(lines: DataFrame) -> Column:
    """Relevance as an integer, or null where it is none."""
    if dict(lines.dtypes)["relevance"] != "variant":
        return F.expr("try_cast(trim(cast(relevance as string)) as int)")
    return (
        F.when(F.expr("schema_of_variant(relevance) = 'STRING'"), F.expr(
            "try_cast(trim(try_variant_get(relevance, '$', 'string')) as int)"
        ))
        .when(F.expr("schema_of_variant(relevance) = 'BOOLEAN'"), F.expr("try_variant_get(relevance, '$', 'boolean')").cast("int"))
        .otherwise(F.expr("try_cast(try_variant_get(relevance, '$', 'double') as int)"))
    )


def read_qrels(
    spark: SparkSession, path: str, queries: DataFrame, version: str = "1800"
) -> tuple[DataFrame, DataFrame]:
    return parse_qrels(_lines(spark, path, QRELS_FIELDS).drop("gating"), queries, version)


def read_gold_gating(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """Expected gating elements embedded in qrels lines; the first line with a payload that is not empty wins."""
    lines = _lines(spark, path, QRELS_FIELDS).drop("relevance")
    filled = lines.filter(F.col("gating").isNotNull() & ~F.col("gating").rlike(r"^\s*(\{\s*\}|null|false|0|\[\s*\])?\s*$"))
    first = top_k(filled, ["query_id"], [F.col("_line").asc()], 1).withColumn("gating", F.from_json("gating", GATING_TYPE))
    empty = F.array().cast("array<string>")
    return first.join(queries.select("query_id", "query_pk"), "query_id").select(
        "query_pk", *[F.coalesce(F.col(f"gating.{name}"), empty).alias(name) for name in GATING_FIELDS]
    )


def read_answers(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """Gold answers of known queries; the last line of a query wins."""
    lines = _lines(spark, path, "query_id string, answers array<string>, explanation string")
    latest = top_k(lines, ["query_id"], [F.col("_line").desc()], 1)
    return latest.join(queries.select("query_id", "query_pk"), "query_id").select(
        "query_pk", F.coalesce("answers", F.array().cast("array<string>")).alias("answers"), "explanation"
    )


def upsert(
    existing: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    keep_if_null: Sequence[str] = (),
    order: Column | None = None,
) -> DataFrame:
    """Insert or replace rows by key.

    Of several updates of one key the one with the highest `order` wins. With `keep_if_null`, a null in the update
    leaves the stored value; inside one batch the latest non-null value counts.
    """
    names = [c for c in existing.columns if c not in keys]
    if order is not None:
        folded = updates.withColumn("_order", order).groupBy(*keys).agg(
            F.max_by(F.struct(*names), "_order").alias("_new"),
            *[
                F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(f"_kept_{c}")
                for c in keep_if_null
            ],
        )
    else:
        folded = updates.select(
            *keys, F.struct(*names).alias("_new"), *[F.col(c).alias(f"_kept_{c}") for c in keep_if_null]
        )
    old = existing.select(*keys, F.struct(*names).alias("_old"))
    merged = old.join(folded, list(keys), "full_outer")

    def pick(name: str) -> Column:
        if name in keep_if_null:
            return F.coalesce(F.col(f"_kept_{name}"), F.col(f"_old.{name}"))
        return F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(F.col(f"_old.{name}"))

    return merged.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in existing.columns])


def export_testset(samples: DataFrame) -> dict[str, DataFrame]:
    """Queries, answers and qrels (relevance 3) of generated samples.

    samples: query_id, query, reference_answer, reference_chunk_ids.
    """
    return {
        "queries": samples.select(
            "query_id",
            F.col("query").alias("text"),
            F.lit("knowledge").alias("query_type"),
            F.lit("retrieval").alias("expected_source"),
        ),
        "answers": samples.select(
            "query_id",
            F.array("reference_answer").alias("answers"),
            F.lit("generated sample").alias("explanation"),
        ),
        "qrels": samples.select(
            "query_id", F.explode("reference_chunk_ids").alias("chunk_id"), F.lit(3).alias("relevance")
        ),
    }


def write_testset(samples: DataFrame, directory: str, prefix: str = "synthetic") -> None:
    for name, table in export_testset(samples).items():
        suffix = "qrels_semantic" if name == "qrels" else name
        table.write.mode("overwrite").json(f"{directory}/{prefix}_{suffix}.jsonl")
