"""Statistics queries: aggregates, repeats, bootstrap, studies, latencies, report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions.scale import cut_lineage, value_rank
from ragloom.operators import fusion, lexical, metrics, statistics
from ragloom.plans import datasets as data
from ragloom.plans.catalog_metrics import METRICS
from ragloom.plans.catalog_retrieval import _corpus_vectors, _text_queries, hybrid_sql
from ragloom.plans.registry import query
from ragloom.sources import tables

_SCORES = """scores AS (SELECT event_type AS run, user_id AS query_pk, 'value' AS metric, round(avg(value), 9) AS value
  FROM events GROUP BY ALL
  UNION ALL SELECT event_type, user_id, 'h2_error_rate', round(min(value) / 100, 9) FROM events GROUP BY ALL)"""


def _scores(spark, d) -> DataFrame:
    events = data.table(spark, d, "events")
    keys = [F.col("event_type").alias("run"), F.col("user_id").alias("query_pk")]
    parts = events.groupBy(*keys).agg(F.round(F.avg("value"), 9).alias("a"), F.round(F.min("value") / 100, 9).alias("b"))
    pair = lambda m, c: F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"))
    return parts.select("run", "query_pk", F.inline(F.array(pair("value", "a"), pair("h2_error_rate", "b"))))


_AGG = """agg AS (SELECT run, metric, avg(value) AS value, count(*) AS n,
  avg(value) - 1.96 * stddev_samp(value) / sqrt(count(*)) AS ci_low,
  avg(value) + 1.96 * stddev_samp(value) / sqrt(count(*)) AS ci_high FROM scores GROUP BY ALL)"""


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@query(
    "aggregate_runs",
    f"""WITH {_SCORES}, {_AGG}
SELECT run, metric, round(value, 6) AS value, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n FROM agg
UNION ALL SELECT DISTINCT run, 'recall@5', 0, 0, 0, 0 FROM scores""",
)
def aggregate_runs(spark, d) -> DataFrame:
    rows = statistics.aggregate_runs(_scores(spark, d), ["value", "h2_error_rate", "recall@5"])
    return _rounded(rows, "value", "ci_low", "ci_high")


@query(
    "delta_to_baseline",
    f"""WITH {_SCORES}, {_AGG} SELECT a.run, a.metric, round(a.value, 6) AS value, round(b.value, 6) AS baseline_mean,
  round(a.value - b.value, 6) AS delta FROM agg a JOIN agg b ON b.metric = a.metric AND b.run = 'click'""",
)
def delta_to_baseline(spark, d) -> DataFrame:
    rows = statistics.delta_to_baseline(statistics.aggregate_runs(_scores(spark, d)), "click")
    return _rounded(rows.select("run", "metric", "value", "baseline_mean", "delta"), "value", "baseline_mean", "delta")


_REPEATS = """rscores AS (SELECT event_type || '_r' || (user_id % 3 + 1) AS run, user_id AS query_pk, 'recall@5' AS metric,
  round(avg(value), 9) AS value FROM events GROUP BY ALL),
ragg AS (SELECT run, metric, avg(value) AS value, count(*) AS n FROM rscores GROUP BY ALL)"""


def _repeat_aggregates(spark, d) -> tuple[DataFrame, DataFrame]:
    run = F.concat(F.col("event_type"), F.lit("_r"), (F.col("user_id") % 3 + 1).cast("string"))
    scores = data.table(spark, d, "events").groupBy(run.alias("run"), F.col("user_id").alias("query_pk")).agg(
        F.round(F.avg("value"), 9).alias("value")
    ).withColumn("metric", F.lit("recall@5"))
    aggregates = statistics.aggregate_runs(scores)
    return aggregates, statistics.repeat_groups(aggregates.select("run").distinct())


@query(
    "repeat_groups",
    f"""WITH {_REPEATS} SELECT DISTINCT run, regexp_replace(run, '_r\\d+$', '') AS "group" FROM rscores""",
)
def repeat_groups(spark, d) -> DataFrame:
    named = _repeat_aggregates(spark, d)[0].select("run").distinct()
    # Names that only look alike are no repeats.
    decoys = named.withColumn("run", F.replace("run", F.lit("_r"), F.lit("xr")))
    return statistics.repeat_groups(named.unionByName(decoys))


@query(
    "aggregate_repeats",
    f"""WITH {_REPEATS}, g AS (SELECT regexp_replace(run, '_r\\d+$', '') AS "group", metric, avg(value) AS v,
  stddev_samp(value) AS s, count(*) AS n FROM ragg GROUP BY ALL)
SELECT "group", metric, round(v, 6) AS value, round(s, 6) AS std, n, round(v - 1.96 * s / sqrt(n), 6) AS ci_low,
  round(v + 1.96 * s / sqrt(n), 6) AS ci_high FROM g""",
)
def aggregate_repeats(spark, d) -> DataFrame:
    return _rounded(
        statistics.aggregate_repeats(*_repeat_aggregates(spark, d)), "value", "std", "ci_low", "ci_high"
    )


@query(
    "repeat_breakdown",
    f"""WITH {_REPEATS} SELECT regexp_replace(run, '_r\\d+$', '') AS "group", run, round(value, 6) AS "recall@5" FROM ragg
UNION ALL SELECT regexp_replace(run, '_r\\d+$', ''), NULL, round(avg(value), 6) FROM ragg GROUP BY 1""",
)
def repeat_breakdown(spark, d) -> DataFrame:
    rows = statistics.repeat_breakdown(*_repeat_aggregates(spark, d))
    return rows.select("group", "run", F.round("`recall@5`", 6).alias("recall@5"))


ITERS = 10_000
STUDY_ITERS = 2_000


def boot_sql(baseline: str, iters: int = ITERS) -> str:
    """CTEs that end in `res`(run_a, run_b, metric, n, delta, half, p) for `scores`(run, query_pk, metric, value)."""
    return f"""pairs AS (SELECT '{baseline}' AS run_a, run AS run_b, metric FROM (SELECT DISTINCT run, metric FROM scores)
  WHERE run <> '{baseline}'),
diffs AS (SELECT run_a, run_b, p.metric, b.value - a.value AS diff, row_number() OVER (PARTITION BY run_a, run_b, p.metric
   ORDER BY md5(a.query_pk::VARCHAR), a.query_pk) - 1 AS idx FROM pairs p
  JOIN scores a ON a.run = run_a AND a.metric = p.metric
  JOIN scores b ON b.run = run_b AND b.metric = p.metric AND b.query_pk = a.query_pk),
means AS (SELECT run_a, run_b, metric, count(*) AS n, avg(diff) AS delta FROM diffs GROUP BY ALL),
draws AS (SELECT run_a, run_b, metric, i, ('0x' || substr(md5('42:' || i || ':' || j), 1, 8))::BIGINT % n AS idx
  FROM means, range({iters}) x(i), range(n) y(j)),
boots AS (SELECT run_a, run_b, metric, i, round(avg(diff), 9) AS boot FROM draws JOIN diffs USING (run_a, run_b, metric, idx)
  GROUP BY ALL),
ob AS (SELECT *, row_number() OVER (PARTITION BY run_a, run_b, metric ORDER BY boot, i) - 1 AS r FROM boots),
counted AS (SELECT run_a, run_b, metric, count(*) FILTER (boot <= 0) AS le, count(*) FILTER (boot >= 0) AS ge,
  (max(boot) FILTER (r = {int(0.975 * iters) - 1}) - max(boot) FILTER (r = {int(0.025 * iters)})) / 2 AS half
  FROM ob GROUP BY ALL),
res AS (SELECT run_a, run_b, metric, n, delta, half,
  least(1.0, 2.0 * CASE WHEN delta >= 0 THEN le ELSE ge END / {iters})::DOUBLE AS p
  FROM counted JOIN means USING (run_a, run_b, metric))"""


_BOOT = boot_sql("click")


@query(
    "paired_bootstrap",
    f"""WITH {_SCORES}, {_BOOT} SELECT run_a, run_b, metric, n, round(delta, 6) AS delta_mean, round(p, 6) AS p_value,
  round(half, 6) AS half_width FROM res UNION ALL SELECT 'click', 'nothing', 'value', 0, NULL, NULL, NULL""",
)
def paired_bootstrap(spark, d) -> DataFrame:
    scores = _scores(spark, d)
    pairs = scores.select("run", "metric").distinct().filter(F.col("run") != "click").select(
        F.lit("click").alias("run_a"), F.col("run").alias("run_b"), "metric"
    )
    absent = spark.createDataFrame([("click", "nothing", "value")], pairs.schema)
    rows = statistics.paired_bootstrap(scores, pairs.unionByName(absent), ITERS)
    return _rounded(rows, "delta_mean", "p_value", "half_width")


_STUDY = """study AS (SELECT r.run_b AS variant, r.metric, r.metric = 'value' AS is_primary, a.value AS baseline, b.value,
  b.value - a.value AS delta, p,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS mark
  FROM res r JOIN agg a ON a.run = r.run_a AND a.metric = r.metric JOIN agg b ON b.run = r.run_b AND b.metric = r.metric
  ),
labelled AS (SELECT *, CASE WHEN abs(delta) < 0.001 THEN '≈0' WHEN metric <> 'h2_error_rate' THEN
    CASE WHEN delta > 0 THEN '↑ +' ELSE '↓ ' END || printf('%.4f', delta)
  ELSE CASE WHEN delta < 0 THEN '↓ ' ELSE '↑ +' END || printf('%.4f', delta) END AS label FROM study)"""


@query(
    "study_comparison",
    f"""WITH {_SCORES}, {_AGG}, {boot_sql("click", STUDY_ITERS)}, {_STUDY} SELECT variant, metric, is_primary, round(baseline, 6) AS baseline,
  round(value, 6) AS value, round(delta, 6) AS delta, round(p, 6) AS p_value, mark, label FROM labelled
UNION ALL SELECT unnest(['error', 'purchase', 'signup', 'view']), 'recall@5', FALSE, 0, 0, 0, NULL, '', '≈0'""",
)
def study_comparison(spark, d) -> DataFrame:
    scores = _scores(spark, d)
    rows = statistics.study_comparison(
        statistics.aggregate_runs(scores), scores, "click", ["error", "purchase", "signup", "view"], ["value"],
        ["h2_error_rate", "recall@5"], STUDY_ITERS,
    )
    return _rounded(rows, "baseline", "value", "delta", "p_value")


@query(
    "annotate",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'recall@5' ELSE 'h2_error_rate' END AS metric,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS mark,
  CASE WHEN abs(delta) < 0.001 THEN '≈0' WHEN event_id % 2 = 0 THEN CASE WHEN delta > 0 THEN '↑ +' ELSE '↓ ' END
    || printf('%.4f', delta) ELSE CASE WHEN delta < 0 THEN '↓ ' ELSE '↑ +' END || printf('%.4f', delta) END AS label,
  event_id % 2 = 0 AS higher_is_better
FROM (SELECT event_id, (event_id % 97) / 1000.0 AS p, CASE WHEN event_id % 5 = 0 THEN 0 ELSE value - 10 END AS delta
  FROM events)""",
)
def annotate(spark, d) -> DataFrame:
    n = F.col("event_id")
    rows = data.table(spark, d, "events").select(
        n, F.when(n % 2 == 0, "recall@5").otherwise("h2_error_rate").alias("metric"),
        ((n % 97) / 1000.0).alias("p_value"), F.when(n % 5 == 0, 0.0).otherwise(F.col("value") - 10).alias("delta"),
    )
    return statistics.annotate(rows).drop("p_value", "delta")


@query(
    "rank_runs",
    f"""WITH {_SCORES}, {_AGG} SELECT run, metric, rank() OVER (PARTITION BY metric ORDER BY
  CASE WHEN metric = 'h2_error_rate' THEN value ELSE -value END) AS place FROM agg""",
)
def rank_runs(spark, d) -> DataFrame:
    rows = statistics.rank_runs(statistics.aggregate_runs(_scores(spark, d)))
    return rows.select("run", "metric", F.col("place").cast("long").alias("place"))


@query(
    "latency_summary",
    """WITH ok AS (SELECT user_id % 7 AS grp, value, row_number() OVER (PARTITION BY user_id % 7 ORDER BY value) - 1 AS r,
  count(*) OVER (PARTITION BY user_id % 7) AS n FROM events WHERE event_type <> 'error'),
tail AS (SELECT grp, max(value) AS p95 FROM ok WHERE r = floor(0.95 * n) GROUP BY 1)
SELECT user_id % 7 AS grp, count(*) AS total_requests, count(*) FILTER (event_type <> 'error') AS successful,
  count(*) FILTER (event_type = 'error') AS failed,
  round(count(*) FILTER (event_type <> 'error') / count(*) * 100, 6) AS success_rate,
  round(count(*) FILTER (event_type <> 'error') / (epoch(max(ts)) - epoch(min(ts))), 6) AS throughput,
  round(avg(value) FILTER (event_type <> 'error'), 6) AS avg_latency,
  min(value) FILTER (event_type <> 'error') AS min_latency, max(value) FILTER (event_type <> 'error') AS max_latency,
  round(median(value) FILTER (event_type <> 'error'), 6) AS p50_latency, any_value(p95) AS p95_latency
FROM events JOIN tail ON grp = user_id % 7 GROUP BY 1""",
)
def latency_summary(spark, d) -> DataFrame:
    requests = data.table(spark, d, "events").select(
        (F.col("user_id") % 7).alias("grp"), F.col("value").alias("latency"), (F.col("event_type") != "error")
        .alias("success"), F.col("ts").cast("timestamp").cast("double").alias("seconds"),
    )
    rows = statistics.latency_summary(requests, ["grp"], F.max("seconds") - F.min("seconds"))
    return _rounded(rows, "success_rate", "throughput", "avg_latency", "p50_latency")


@query(
    "latency_summary_few_groups",
    """WITH ok AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events
  WHERE event_type <> 'view')
SELECT 'all' AS grp, (SELECT count(*) FROM events) AS total_requests, (SELECT round(median(value), 6) FROM ok) AS p50_latency,
  (SELECT max(value) FROM ok WHERE r = floor(0.95 * n)) AS p95_latency""",
)
def latency_summary_few_groups(spark, d) -> DataFrame:
    requests = data.table(spark, d, "events").select(
        F.lit("all").alias("grp"), F.col("value").alias("latency"), (F.col("event_type") != "view").alias("success")
    )
    rows = statistics.latency_summary(requests, ["grp"])
    return _rounded(rows.select("grp", "total_requests", "p50_latency", "p95_latency"), "p50_latency")


@query(
    "run_csv",
    f"""WITH {_SCORES}, {_AGG} SELECT a.metric, printf('%.6f', a.value) AS mean, printf('%.6f', a.ci_low) AS ci_low,
  printf('%.6f', a.ci_high) AS ci_high, a.n, printf('%.6f', b.value) AS baseline_mean,
  printf('%.6f', a.value - b.value) AS delta FROM agg a JOIN agg b ON b.metric = a.metric AND b.run = 'click'
WHERE a.run = 'view'""",
)
def run_csv(spark, d) -> DataFrame:
    rows = statistics.aggregate_runs(_scores(spark, d))
    return tables.run_csv(rows.filter(F.col("run") == "view"), rows.filter(F.col("run") == "click"))


@query(
    "study_csv",
    f"""WITH {_SCORES}, {_AGG} SELECT run AS run_name, run = 'click' AS is_baseline,
  coalesce(printf('%.6f', max(value) FILTER (metric = 'h2_error_rate')), '') AS h2_error_rate,
  coalesce(printf('%.6f', max(value) FILTER (metric = 'value')), '') AS value FROM agg GROUP BY run""",
)
def study_csv(spark, d) -> DataFrame:
    rows = statistics.aggregate_runs(_scores(spark, d)).withColumnRenamed("run", "run_name")
    return tables.study_csv(rows, "click", ["value", "h2_error_rate"])


_THREE_MODES = f"""{hybrid_sql(10)},
ranking AS (SELECT 'HYBRID' AS run_id, query_pk, chunk_id, rank AS position FROM hybrid
  UNION ALL SELECT 'BM25_ONLY', query_pk, chunk_id, rank FROM bm25 WHERE rank <= 10
  UNION ALL SELECT 'VECTOR_ONLY', query_pk, chunk_id, rank FROM dense WHERE rank <= 10),
gold AS (SELECT query_pk, chunk_id, max(relevance) AS relevance FROM (
  SELECT item_id AS query_pk, doc_id || ':0' AS chunk_id, 3 AS relevance FROM documents d, benchmark b
    WHERE contains(d.text, b.text)
  UNION ALL SELECT query_pk, chunk_id::VARCHAR || ':0', 1 FROM qv JOIN vecs ON label = q_label) GROUP BY ALL),
{METRICS}, scores AS (SELECT run_id AS run, query_pk, metric, value FROM long
  WHERE metric IN ('recall@5', 'ndcg@5', 'mrr@5')), {_AGG}, {boot_sql("HYBRID", STUDY_ITERS)}"""


@query(
    "retrieval_study",
    f"""WITH {_THREE_MODES}, study AS (SELECT r.run_b AS variant, r.metric, a.value AS baseline, b.value, b.value - a.value AS delta, p
  FROM res r JOIN agg a ON a.run = r.run_a AND a.metric = r.metric JOIN agg b ON b.run = r.run_b AND b.metric = r.metric)
SELECT variant, metric, metric <> 'mrr@5' AS is_primary, round(baseline, 6) AS baseline, round(value, 6) AS value,
  round(delta, 6) AS delta, round(p, 6) AS p_value,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS mark,
  CASE WHEN abs(delta) < 0.001 THEN '≈0' ELSE CASE WHEN delta > 0 THEN '↑ +' ELSE '↓ ' END || printf('%.4f', delta) END AS label
FROM study""",
)
def retrieval_study(spark, d) -> DataFrame:
    """Text, vector and hybrid retrieval of the same queries, scored and compared in one plan."""
    asked, index = _text_queries(spark, d), lexical.postings(data.chunks(spark, d))
    corpus = _corpus_vectors(spark, d)
    labelled = data.vectors(spark, d).select(
        F.concat(F.col("chunk_id").cast("string"), F.lit(":0")).alias("chunk_id"), "label"
    )
    verbatim = data.qrels(spark, d).join(asked.select("query_pk"), "query_pk", "left_semi")
    near = data.query_vectors(spark, d).select("query_pk", "label").join(labelled, "label").select(
        "query_pk", "chunk_id", F.lit(1).alias("relevance")
    )
    gold = verbatim.unionByName(near).groupBy("query_pk", "chunk_id").agg(F.max("relevance").alias("relevance"))
    gold = cut_lineage(gold)
    logs = fusion.search_modes(asked, index, corpus, 10).withColumn("source", F.lit("rrf"))
    logs = logs.withColumn("run_id", F.upper("mode"))
    scores = metrics.retrieval_metrics(metrics.evaluated_ranking(logs, limit=10), gold).withColumnRenamed("run_id", "run")
    scores = cut_lineage(scores)
    return _rounded(
        statistics.study_comparison(
            statistics.aggregate_runs(scores), scores, "HYBRID", ["BM25_ONLY", "VECTOR_ONLY"], ["recall@5", "ndcg@5"],
            ["mrr@5"], STUDY_ITERS,
        ),
        "baseline", "value", "delta", "p_value",
    )


@query(
    "retrieval_logs",
    """WITH v AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank, label FROM embeddings)
SELECT label::BIGINT AS query_pk, rank, CASE WHEN vec_id % 4 = 0 THEN 'ce' ELSE 'rrf' END AS source,
  vec_id || ':0' AS chunk_id, round(CASE WHEN vec_id % 4 = 0 AND vec_id % 8 <> 0 THEN (vec_id % 16) / 16
    ELSE 1.0 / (60 + rank) END, 6) AS score FROM v""",
)
def retrieval_logs(spark, d) -> DataFrame:
    v = data.table(spark, d, "embeddings").select("vec_id", "label")
    n = F.col("vec_id")
    hits = fusion.rrf(value_rank(v, ["label"], "vec_id", "rank")).select(
        F.lit(1).alias("run_id"), F.col("label").cast("long").alias("query_pk"), F.col("rank").cast("long").alias("rank"),
        F.when(n % 4 == 0, "ce").alias("source"), F.concat(n.cast("string"), F.lit(":0")).alias("chunk_id"),
        F.when(n % 4 == 0, F.when(n % 8 == 0, 0.0).otherwise((n % 16) / 16)).alias("rerank_score"),
        F.col("weight").alias("rrf_score"),
    )
    rows = statistics.retrieval_logs(hits)
    return rows.select("query_pk", "rank", "source", "chunk_id", F.round("score", 6).alias("score"))
