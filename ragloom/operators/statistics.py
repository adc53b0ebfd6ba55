"""Aggregates, confidence intervals, bootstrap comparisons and studies over the scores of runs.

Run columns are called `run` here: an id or a name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.scale import (
    blocked_row_number,
    cut_lineage,
    order_statistics,
    percentile_linear,
    value_rank,
)

# Normal quantile, bootstrap bounds and iterations, significance levels, smallest delta worth an arrow.
Z_95 = 1.96
LOWER_BOUND, UPPER_BOUND = 0.025, 0.975
ITERATIONS = 10_000
REPORT_ITERATIONS = 2_000
SEED = 42
LEVELS = [(0.001, "***"), (0.01, "**"), (0.05, "*")]
NO_DELTA = 0.001

#: Differences that are collected at once, slices of these for which a task draws once, and iterations of one task.
SLICE_DIFFS = 2_000_000
PASS_SLICES = 4
TASK_ITERATIONS = 64
#: Counts that a task holds unless STEP_ITERATIONS take more, draws of one iteration it has at once, and digests together.
HELD_DRAWS = 2_000_000
STEP_ITERATIONS = 8
DRAWN = 1 << 18
DIGESTS = 1 << 13

# Metric groups with their primary metric, and metrics of which less is better.
METRIC_GROUPS = {
    "retrieval": (
        "recall@5",
        ["recall@3", "recall@5", "recall@10", "mrr@3", "mrr@5", "mrr@10", "ndcg@3", "ndcg@5", "ndcg@10"],
    ),
    "generation": ("semantic_sim", ["semantic_sim", "rouge_l_recall", "content_f1", "bertscore_f1"]),
    "faithfulness": (
        "factual_consistency_normalized",
        [
            "citation_recall", "citation_precision", "factual_consistency_score", "factual_consistency_normalized",
            "llm_answer_relevance", "llm_context_relevance", "llm_faithfulness",
        ],
    ),
    "h2_gating": ("h2_error_rate", ["h2_error_rate", "llm_answer_relevance"]),
    "h3_gray_zone": (
        "h3_appropriate_handling",
        ["h3_appropriate_handling", "h3_speculation_detected", "h3_uncertainty_expressed", "h3_score"],
    ),
}
LOWER_IS_BETTER = [
    "h2_error_rate", "h2_structure_violation_rate", "h2_hallucination_rate", "h2_scope_violation_rate",
    "output_violation_rate", "output_hallucination_rate",
]
PRIMARY = ["recall@5", "factual_consistency_normalized", "semantic_sim"]
SECONDARY = ["recall@3", "recall@10", "citation_recall"]
SAMPLE_METRICS = ["recall@5", "factual_consistency_normalized", "llm_faithfulness", "semantic_sim"]


def _interval(mean: Column, spread: Column, n: Column) -> list[Column]:
    half = F.when(n > 1, Z_95 * spread / F.sqrt(n)).otherwise(0.0)
    return [(mean - half).alias("ci_low"), (mean + half).alias("ci_high")]


def aggregate_runs(scores: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Mean with 95 % normal interval: (run, metric, value, ci_low, ci_high, n).

    With `metrics`, every run gets a row for each of them; one without scores is 0, 0, 0 with n = 0.
    """
    found = scores.groupBy("run", "metric").agg(
        F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_sd"), F.count("value").alias("n")
    )
    if metrics is not None:
        wanted = F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric")
        found = scores.select("run").distinct().select("run", wanted).join(found, ["run", "metric"], "left")
    n, mean = F.coalesce("n", F.lit(0)), F.coalesce("_mean", F.lit(0.0))
    return found.select(
        "run", "metric", mean.alias("value"), *_interval(mean, F.coalesce("_sd", F.lit(0.0)), n), n.alias("n")
    )


def delta_to_baseline(aggregates: DataFrame, baseline) -> DataFrame:
    """Add baseline_mean and delta; both null for metrics the baseline lacks."""
    base = aggregates.filter(F.col("run") == baseline).select("metric", F.col("value").alias("baseline_mean"))
    return aggregates.join(base, "metric", "left").withColumn("delta", F.col("value") - F.col("baseline_mean"))


def repeat_groups(runs: DataFrame) -> DataFrame:
    """Runs named like `name_r1`, `name_r2`, … with their common name: (run, group)."""
    return runs.filter(F.rlike("run", F.lit(r"_r\d+$"))).select(
        "run", F.regexp_replace("run", r"_r\d+$", "").alias("group")
    )


def aggregate_repeats(aggregates: DataFrame, groups: DataFrame, skip_empty: bool = False) -> DataFrame:
    """Mean, standard deviation and interval over the means of repeated runs.

    A repeat without scores enters as 0 unless `skip_empty`.
    """
    rows = aggregates.filter(F.col("n") > 0) if skip_empty else aggregates
    per = rows.join(groups, "run").groupBy("group", "metric").agg(
        F.avg("value").alias("value"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.count(F.lit(1)).alias("n"),
    )
    return per.select("*", *_interval(F.col("value"), F.col("std"), F.col("n")))


def paired_bootstrap(
    scores: DataFrame, pairs: DataFrame, iters: int = ITERATIONS, seed: int = SEED
) -> DataFrame:
    """Paired bootstrap over common queries: (run_a, run_b, metric, n, delta_mean, p_value, half_width).

    scores: run, query_pk, metric, value; pairs: run_a, run_b, metric. A pair without common queries has n = 0 and
    nulls. Draw j of iteration i takes the difference numbered md5(seed:i:j) modulo n, so that results do not depend
    on partitions. Differences are numbered in the order of md5(query_pk).

    A task draws its iterations once for all pairs and counts how often each number comes; these rows of counts times the
    differences of all pairs with the same n are the sums of the iterations. Differences travel in slices of bounded size.
    """
    keys = ["run_a", "run_b", "metric"]
    side = lambda name: scores.select(
        F.col("run").alias(f"run_{name}"), "metric", "query_pk", F.col("value").alias(f"_{name}")
    )
    asked = pairs.select(*keys).distinct()
    common = side("a").join(asked, ["run_a", "metric"]).join(side("b"), ["run_b", "metric", "query_pk"])
    diffs = cut_lineage(common.select(*keys, "query_pk", (F.col("_b") - F.col("_a")).alias("diff")))
    means = diffs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("diff"), 9).alias("delta_mean"))
    digest = diffs.withColumn("_h", F.md5(F.col("query_pk").cast("string")))
    ranked = blocked_row_number(
        digest, keys, F.substring("_h", 1, 3), [F.col("_h"), F.col("query_pk")], "_place"
    )
    numbered = cut_lineage(
        ranked.join(means.select(*keys, "n"), keys)
        .select(F.xxhash64(*keys).alias("pair"), "n", (F.col("_place") - 1).alias("idx"), "diff")
        .withColumn("part", F.floor(F.col("idx") / SLICE_DIFFS).cast("long"))
    )
    slices = max(1, -(-numbered.count() // SLICE_DIFFS))
    sent = []
    for number in range(slices):
        # About SLICE_DIFFS rows: a pair's differences beyond that are cut by number.
        own = numbered.filter(F.pmod(F.xxhash64("pair", "part"), F.lit(slices)) == number).drop("part").toPandas()
        if len(own):
            sent.append(scores.sparkSession.sparkContext.broadcast(_matrices(own)))
    sums = None
    for first in range(0, len(sent), PASS_SLICES):
        grid = scores.sparkSession.range(0, iters, TASK_ITERATIONS, -(-iters // TASK_ITERATIONS))
        drawn = _iteration_sums(sent[first : first + PASS_SLICES], iters, seed)
        part = grid.mapInArrow(drawn, "pair long, n long, i long, total double")
        sums = part if sums is None else sums.unionByName(part)
    if sums is None:
        sums = scores.sparkSession.createDataFrame([], "pair long, n long, i long, total double")
    if slices > 1:
        sums = sums.groupBy("pair", "n", "i").agg(F.sum("total").alias("total"))
    boots = sums.withColumn("boot", F.round(F.col("total") / F.col("n"), 9))
    # One row per iteration: a group is as large as `iters`, whatever the number of queries.
    ordered = boots.withColumn("_r", F.row_number().over(Window.partitionBy("pair").orderBy("boot", "i")) - 1)
    low, high = int(LOWER_BOUND * iters), int(UPPER_BOUND * iters) - 1
    spread = ordered.groupBy("pair").agg(
        F.count_if(F.col("boot") <= 0).alias("_le"),
        F.count_if(F.col("boot") >= 0).alias("_ge"),
        F.max(F.when(F.col("_r") == low, F.col("boot"))).alias("_lo"),
        F.max(F.when(F.col("_r") == high, F.col("boot"))).alias("_hi"),
    )
    tail = F.when(F.col("delta_mean") >= 0, F.col("_le")).otherwise(F.col("_ge")) / iters
    result = means.withColumn("pair", F.xxhash64(*keys)).join(spread, "pair").select(
        *keys, "n", "delta_mean", F.least(F.lit(1.0), 2.0 * tail).alias("p_value"),
        ((F.col("_hi") - F.col("_lo")) / 2.0).alias("half_width"),
    )
    return asked.join(result, keys, "left").fillna(0, ["n"])


def _matrices(rows) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(n, first number, pairs, differences by number and pair) for the pairs with the same n, from a slice of rows."""
    found = []
    for (n, block), own in rows.assign(block=rows["idx"] // SLICE_DIFFS).groupby(["n", "block"]):
        low = int(own["idx"].min())
        pairs, column = np.unique(own["pair"].to_numpy(), return_inverse=True)
        matrix = np.zeros((int(own["idx"].max()) - low + 1, len(pairs)))
        matrix[own["idx"].to_numpy() - low, column] = own["diff"].to_numpy(float)
        found.append((int(n), low, pairs, matrix))
    return found


class _Draws:
    """First four bytes, as a big-endian number, of md5("seed:i:j") for one i and neighbouring j at a time."""

    def __init__(self, seed: int, low: int, high: int):
        self.seed, self.numbers, self.blocks = seed, [b"%d" % j for j in range(low, high)], {}

    def _block(self, lead: int) -> np.ndarray:
        """The padded messages, which are one md5 block each, with room for `lead` bytes in front."""
        if lead not in self.blocks:
            raw = b"".join(
                bytes(lead) + n + b"\x80" + bytes(55 - lead - len(n)) + (8 * (lead + len(n))).to_bytes(8, "little")
                for n in self.numbers
            )
            self.blocks[lead] = np.frombuffer(bytearray(raw), np.uint8).reshape(-1, 64)
        return self.blocks[lead]

    def of(self, i: int) -> np.ndarray:
        lead = b"%d:%d:" % (self.seed, i)
        if len(lead) + len(self.numbers[-1]) > 55:  # more than one md5 block
            heads = [hashlib.md5(lead + n).digest()[:4] for n in self.numbers]
            return np.frombuffer(b"".join(heads), ">u4").astype(np.int64)
        block = self._block(len(lead))
        block[:, : len(lead)] = np.frombuffer(lead, np.uint8)
        return np.concatenate([_md5_heads(block[k : k + DIGESTS]) for k in range(0, len(block), DIGESTS)]).astype(np.int64)


def _md5_heads(block: np.ndarray) -> np.ndarray:
    """First four bytes of the digests of padded messages, one row each."""
    words = np.ascontiguousarray(block.view("<u4").T)
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _MD5_START)
    for k in range(64):
        if k < 16:
            mixed, word = d ^ (b & (c ^ d)), k
        elif k < 32:
            mixed, word = c ^ (d & (b ^ c)), (5 * k + 1) % 16
        elif k < 48:
            mixed, word = b ^ c ^ d, (3 * k + 5) % 16
        else:
            mixed, word = c ^ (b | ~d), 7 * k % 16
        mixed += a
        mixed += words[word]
        mixed += _MD5_SINES[k]
        turn = _MD5_TURNS[k // 16][k % 4]
        a, d, c, b = d, c, b, b + ((mixed << turn) | (mixed >> (32 - turn)))
    return (a + np.uint32(_MD5_START[0])).byteswap()


_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_SINES = np.array([int(abs(math.sin(k + 1)) * 2**32) for k in range(64)], np.uint32)
_MD5_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)


def _iteration_sums(shared: list, iters: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = [m for one in shared for m in one.value]
        most = max(n for n, *_ in matrices)
        # Counts of all matrices are held for some iterations; draws come in pieces.
        step = max(STEP_ITERATIONS, HELD_DRAWS // sum(len(m) for *_, m in matrices))
        pieces = range(0, most, DRAWN)
        kept = _Draws(seed, 0, most) if len(pieces) == 1 else None
        for batch in batches:
            for first in batch.column("id").to_pylist():
                end = min(first + TASK_ITERATIONS, iters)
                for low in range(first, end, step):
                    high = min(low + step, end)
                    times = [np.zeros((high - low, len(m)), np.int32) for *_, m in matrices]
                    for begin in pieces:
                        draws = kept or _Draws(seed, begin, min(begin + DRAWN, most))
                        for i in range(low, high):
                            drawn = draws.of(i)
                            for (n, start, _, matrix), held in zip(matrices, times, strict=True):
                                at = drawn[: max(0, n - begin)] % n - start
                                if start or len(matrix) < n:
                                    at = at[(at >= 0) & (at < len(matrix))]
                                held[i - low] += np.bincount(at, minlength=len(matrix)).astype(np.int32)
                    for (n, _, pairs, matrix), held in zip(matrices, times, strict=True):
                        sums = held.astype(float) @ matrix
                        count = sums.size
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.tile(pairs, high - low)), pa.array(np.full(count, n)),
                                pa.array(np.repeat(np.arange(low, high), len(pairs))), pa.array(sums.reshape(-1)),
                            ],
                            ["pair", "n", "i", "total"],
                        )

    return run


def higher_is_better(metric: Column) -> Column:
    return ~metric.isin(*LOWER_IS_BETTER)


def significance_mark(p: Column) -> Column:
    mark = F.when(F.lit(False), F.lit(""))
    for level, sign in LEVELS:
        mark = mark.when(p < level, sign)
    return mark.otherwise("")


def delta_label(delta: Column, better_high: Column) -> Column:
    """'≈0', or an arrow for the direction of change with the signed value; an error rate that falls has no sign."""
    value = F.format_string("%.4f", delta)
    up, down = delta > 0, delta < 0
    return (
        F.when(F.abs(delta) < NO_DELTA, "≈0")
        .when(better_high, F.concat(F.when(up, "↑ +").otherwise("↓ "), value))
        .otherwise(F.concat(F.when(down, "↓ ").otherwise("↑ +"), value))
    )


def metric_groups() -> list[tuple[str, str, bool]]:
    """(group, metric, is primary) of every grouped metric."""
    return [(group, m, m == primary) for group, (primary, names) in METRIC_GROUPS.items() for m in names]


def annotate(comparisons: DataFrame) -> DataFrame:
    """Add mark, label and direction to (metric, delta, p_value)."""
    better = higher_is_better(F.col("metric"))
    return (
        comparisons.withColumn("higher_is_better", better)
        .withColumn("mark", significance_mark(F.col("p_value")))
        .withColumn("label", delta_label(F.col("delta"), better))
    )


def study_comparison(
    aggregates: DataFrame,
    scores: DataFrame,
    baseline: str,
    variants: Sequence[str],
    primary: Sequence[str] = PRIMARY,
    secondary: Sequence[str] = SECONDARY,
    iters: int = REPORT_ITERATIONS,
    seed: int = SEED,
) -> DataFrame:
    """Every variant against the baseline, per metric, in one job.

    (variant, metric, is_primary, baseline, value, delta, p_value, mark, label); a missing mean counts as 0.
    """
    spark = aggregates.sparkSession
    cells = spark.createDataFrame(
        [(baseline, v, m, m in set(primary)) for v in variants for m in dict.fromkeys([*primary, *secondary])],
        "run_a string, run_b string, metric string, is_primary boolean",
    )
    means = aggregates.select("run", "metric", "value")
    boots = paired_bootstrap(scores, cells, iters, seed).select("run_a", "run_b", "metric", "p_value")
    rows = (
        cells.join(means.select(F.col("run").alias("run_a"), "metric", F.col("value").alias("baseline")),
                   ["run_a", "metric"], "left")
        .join(means.select(F.col("run").alias("run_b"), "metric", "value"), ["run_b", "metric"], "left")
        .fillna(0.0, ["baseline", "value"])
        .join(boots, ["run_a", "run_b", "metric"], "left")
        .withColumn("delta", F.col("value") - F.col("baseline"))
    )
    return annotate(rows).select(
        F.col("run_b").alias("variant"), "metric", "is_primary", "baseline", "value", "delta", "p_value", "mark", "label"
    )


def rank_runs(aggregates: DataFrame) -> DataFrame:
    """Place of each run per metric, best first in the metric's direction; equal means share a place, nulls are last."""
    signed = F.when(higher_is_better(F.col("metric")), -F.col("value")).otherwise(F.col("value"))
    return value_rank(aggregates.withColumn("_signed", signed), ["metric"], "_signed", "place").drop("_signed")


def repeat_breakdown(
    aggregates: DataFrame, groups: DataFrame, metrics: Sequence[str] = SAMPLE_METRICS
) -> DataFrame:
    """Means of each repeat next to its group's mean, one column per metric: (group, run, …); run null for the group."""
    rows = aggregates.join(groups, "run").filter(F.col("metric").isin(*metrics))
    columns = [F.avg(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    single = rows.groupBy("group", "run").agg(*columns)
    whole = rows.groupBy("group").agg(*columns).withColumn("run", F.lit(None).cast("string"))
    return single.unionByName(whole)


def latency_summary(requests: DataFrame, keys: Sequence[str], total_seconds: Column | None = None) -> DataFrame:
    """Success rate in percent, throughput, mean, extremes, median and p95 (at index int(0.95 n)) of request logs.

    requests: keys, latency, success. total_seconds is an aggregate over a group, for throughput. Without a success
    only the counts and a rate of 0 remain.
    """
    keys = list(keys)
    ok = F.when(F.col("success"), F.col("latency"))
    counts = requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if("success").alias("successful"),
        F.avg(ok).alias("avg_latency"), F.min(ok).alias("min_latency"), F.max(ok).alias("max_latency"),
        (total_seconds if total_seconds is not None else F.lit(None).cast("double")).alias("_seconds"),
    )
    good = requests.filter("success")
    median = percentile_linear(good, keys, "latency", 0.5, "p50_latency")
    p95 = order_statistics(good, keys, "latency", F.lit(0.95) * F.col("n"), "p95_latency")
    return (
        counts.withColumn("failed", F.col("total_requests") - F.col("successful"))
        .withColumn("success_rate", F.col("successful") / F.col("total_requests") * 100)
        .withColumn("throughput", F.when(F.col("successful") > 0, F.col("successful") / F.col("_seconds")))
        .drop("_seconds")
        .join(median, keys, "left")
        .join(p95.select(*keys, "p95_latency"), keys, "left")
    )


def retrieval_logs(hits: DataFrame) -> DataFrame:
    """Log rows of responses: the rerank score unless it is missing or 0, else the fusion score."""
    score = F.coalesce(F.nullif("rerank_score", F.lit(0.0)), F.col("rrf_score"), F.lit(0.0))
    return hits.filter(F.length("chunk_id") > 0).select(
        "run_id", "query_pk", "rank", F.coalesce("source", F.lit("rrf")).alias("source"), "chunk_id",
        F.lit(None).cast("string").alias("document_id"), score.cast("double").alias("score"),
    )
