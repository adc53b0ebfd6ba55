"""Table-level reads and checks, and report exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables an evaluation needs.
REQUIRED_TABLES = (
    "runs queries qrels gold_answers gold_gating run_items scores retrieval_logs aggregates chunks chunk_vectors"
).split()


def sample_chunks(chunks: DataFrame, cap: int, min_len: int = 400) -> DataFrame:
    """A sample of at most `cap` chunks: the first by id, without those shorter than `min_len` characters."""
    return chunks.orderBy("chunk_id").limit(cap).filter(F.length("text") >= min_len)


def audit_tables(
    spark: SparkSession, tables: Mapping[str, DataFrame], required: Sequence[str] = REQUIRED_TABLES
) -> DataFrame:
    """One row per required table: does it exist, and how many rows has it."""
    report = spark.createDataFrame(
        [(name, False, 0) for name in required if name not in tables], "table string, exists boolean, n_rows long"
    )
    for name in required:
        if name in tables:
            counted = tables[name].agg(F.count(F.lit(1)).alias("n_rows"))
            report = report.unionByName(
                counted.select(F.lit(name).alias("table"), F.lit(True).alias("exists"), "n_rows")
            )
    return report


def run_csv(aggregates: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Metric rows of one run as text with six decimals, by metric name.

    aggregates: metric, value, ci_low, ci_high, n.
    """
    def six(name: str):
        return F.format_string("%.6f", F.col(name))

    columns = [
        F.col("metric"),
        six("value").alias("mean"),
        six("ci_low").alias("ci_low"),
        six("ci_high").alias("ci_high"),
        F.col("n"),
    ]
    if baseline is not None:
        aggregates = aggregates.join(baseline.select("metric", F.col("value").alias("_base")), "metric", "left")
        delta = F.col("value") - F.col("_base")
        columns += [
            F.when(F.col("_base").isNotNull(), six("_base")).alias("baseline_mean"),
            F.when(F.col("_base").isNotNull(), F.format_string("%.6f", delta)).alias("delta"),
        ]
    return aggregates.select(*columns).orderBy("metric")


def write_run_csv(aggregates: DataFrame, path: str, baseline: DataFrame | None = None) -> None:
    """Part files in the order of their names hold the rows in order."""
    run_csv(aggregates, baseline).write.mode("overwrite").csv(path, header=True)


def study_csv(aggregates: DataFrame, baseline_run: str, metrics: Sequence[str]) -> DataFrame:
    """One row per run, one text column for each of `metrics`.

    aggregates: run_name, metric, value.
    """
    wide = (
        aggregates.groupBy("run_name")
        .pivot("metric", sorted(metrics))
        .agg(F.format_string("%.6f", F.first("value")))
    )
    names = sorted(c for c in wide.columns if c != "run_name")
    return wide.select(
        "run_name",
        (F.col("run_name") == baseline_run).alias("is_baseline"),
        *[F.coalesce(F.col(f"`{m}`"), F.lit("")).alias(m) for m in names],
    )


def write_study_csv(aggregates: DataFrame, path: str, baseline_run: str, metrics: Sequence[str]) -> None:
    study_csv(aggregates, baseline_run, metrics).orderBy("run_name").write.mode("overwrite").csv(path, header=True)
