"""Metric, citation and judge queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions.text import STOP_WORDS
from ragloom.operators import dense, judging, metrics, scoring
from ragloom.plans import datasets as data
from ragloom.plans.catalog_retrieval import dense_sql
from ragloom.plans.registry import query

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"

_LOGS = """logs AS (SELECT list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)::BIGINT AS run_id,
  user_id AS query_pk, event_id AS rank, (event_id % 50) || ':0' AS chunk_id,
  CASE WHEN user_id % 7 = 0 OR event_id % 3 = 2 THEN 'bm25' WHEN event_id % 3 = 1 THEN 'ce' ELSE 'rrf' END AS source
  FROM events),
gold AS (SELECT query_pk, n || ':0' AS chunk_id, n % 4 AS relevance FROM (SELECT DISTINCT user_id AS query_pk FROM events),
  range(50) r(n) WHERE (query_pk + n) % 11 = 0),
placed AS (SELECT *, coalesce(list_position(['ce', 'rrf'], source), 0) AS p,
  max(source <> 'bm25') OVER (PARTITION BY run_id, query_pk) AS pref FROM logs),
ranking AS (SELECT run_id, query_pk, chunk_id, row_number() OVER (PARTITION BY run_id, query_pk ORDER BY p, rank)
  AS position FROM placed WHERE NOT pref OR p > 0)"""

METRICS = """gained AS (SELECT r.*, coalesce(g.relevance, 0) AS rel, CASE WHEN g.relevance > 0
   THEN (pow(2, g.relevance) - 1) / log2(position + 1) ELSE 0 END AS gain
  FROM ranking r LEFT JOIN gold g ON g.query_pk = r.query_pk AND g.chunk_id = r.chunk_id),
ideal AS (SELECT query_pk, row_number() OVER (PARTITION BY query_pk ORDER BY relevance DESC) AS i, relevance FROM gold),
ng AS (SELECT query_pk, count(*) FILTER (relevance > 0) AS n FROM gold GROUP BY 1),
ks AS (SELECT unnest([3, 5, 10]) AS k),
idcg AS (SELECT query_pk, k, sum(CASE WHEN i <= k AND relevance > 0 THEN (pow(2, relevance) - 1) / log2(i + 1) ELSE 0 END)
  AS v FROM ideal, ks GROUP BY ALL),
per AS (SELECT run_id, g.query_pk, k, count(*) FILTER (rel > 0 AND position <= k) AS hits,
  min(position) FILTER (rel > 0) AS first, sum(CASE WHEN position <= k THEN gain ELSE 0 END) AS dcg FROM gained g, ks
  GROUP BY ALL),
vals AS (SELECT run_id, query_pk, k, CASE WHEN n > 0 THEN hits / n ELSE 0 END AS recall,
  CASE WHEN first <= k THEN 1.0 / first ELSE 0 END AS mrr, CASE WHEN v > 0 THEN dcg / v ELSE 0 END AS ndcg
  FROM per JOIN ng USING (query_pk) JOIN idcg USING (query_pk, k)),
long AS (SELECT run_id, query_pk, 'recall@' || k AS metric, recall::DOUBLE AS value FROM vals
  UNION ALL SELECT run_id, query_pk, 'mrr@' || k, mrr FROM vals UNION ALL SELECT run_id, query_pk, 'ndcg@' || k, ndcg FROM vals)"""


@query(
    "evaluated_ranking",
    f"WITH {_LOGS} SELECT run_id, query_pk, position, chunk_id FROM ranking",
)
def evaluated_ranking(spark, d) -> DataFrame:
    return metrics.evaluated_ranking(data.retrieval_logs(spark, d))


def _ranked(spark, d) -> DataFrame:
    return metrics.evaluated_ranking(data.retrieval_logs(spark, d), limit=10)


@query(
    "retrieval_metrics",
    f"WITH {_LOGS}, {METRICS} SELECT run_id, query_pk, metric, round(value, 6) AS value FROM long",
)
def retrieval_metrics(spark, d) -> DataFrame:
    rows = metrics.retrieval_metrics(_ranked(spark, d), data.log_qrels(spark, d))
    return rows.withColumn("value", F.round("value", 6))


for _name, _build in (
    ("recall_at_k", metrics.recall_at_k), ("mrr_at_k", metrics.mrr_at_k), ("ndcg_at_k", metrics.ndcg_at_k)
):
    def _one(spark, d, build=_build) -> DataFrame:
        return build(_ranked(spark, d), data.log_qrels(spark, d), [3, 5]).withColumn("value", F.round("value", 6))

    query(
        _name,
        f"""WITH {_LOGS}, {METRICS} SELECT run_id, query_pk, metric, round(value, 6) AS value FROM long
WHERE metric IN ('{_name.split('_')[0]}@3', '{_name.split('_')[0]}@5')""",
    )(_one)


@query(
    "retrieval_metrics_dense",
    f"""WITH {dense_sql(10)}, ranking AS (SELECT 1 AS run_id, query_pk, chunk_id, rank AS position FROM dense),
gold AS (SELECT query_pk, chunk_id, 1 + chunk_id % 3 AS relevance FROM qv JOIN vecs ON label = q_label), {METRICS}
SELECT query_pk, metric, round(value, 6) AS value FROM long""",
)
def retrieval_metrics_dense(spark, d) -> DataFrame:
    asked, corpus = data.query_vectors(spark, d), data.vectors(spark, d)
    hits = dense.vector_topk(asked, corpus, 10)
    ranking = hits.select(F.lit(1).alias("run_id"), "query_pk", "chunk_id", F.col("rank").alias("position"))
    gold = asked.select("query_pk", "label").join(corpus.select("chunk_id", "label"), "label").select(
        "query_pk", "chunk_id", (1 + F.col("chunk_id") % 3).alias("relevance")
    )
    return metrics.retrieval_metrics(ranking, gold).select("query_pk", "metric", F.round("value", 6).alias("value"))


@query(
    "verbatim_qrels",
    "SELECT item_id AS query_pk, doc_id || ':0' AS chunk_id FROM documents d, benchmark b WHERE contains(d.text, b.text)",
)
def verbatim_qrels(spark, d) -> DataFrame:
    return data.qrels(spark, d).select("query_pk", "chunk_id")


_PAIRS = """pairs AS (SELECT a.conv_id, a.turn, a.text AS pred, u.text AS gold FROM conversations a JOIN conversations u
  ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user'),
words AS (SELECT *, regexp_extract_all(lower(pred), '[\\p{L}\\p{N}_]+') AS pw,
  regexp_extract_all(lower(gold), '[\\p{L}\\p{N}_]+') AS gw FROM pairs)"""

_F1 = f"""f1 AS (SELECT conv_id, turn, CASE WHEN c = 0 THEN 0.0::DOUBLE ELSE 2.0 * (c / np) * (c / ng) / (c / np + c / ng) END AS v
  FROM (SELECT conv_id, turn, len(ps)::DOUBLE AS np, len(gs)::DOUBLE AS ng, len(list_intersect(ps, gs)) AS c FROM (
    SELECT conv_id, turn, list_distinct(list_filter(pw, lambda w: NOT list_contains({_STOP}, w))) AS ps,
      list_distinct(list_filter(gw, lambda w: NOT list_contains({_STOP}, w))) AS gs FROM words)))"""


@query(
    "content_f1",
    f"WITH {_PAIRS}, {_F1} SELECT conv_id, turn, round(v, 6) AS content_f1 FROM f1",
)
def content_f1(spark, d) -> DataFrame:
    scored = metrics.content_f1(data.answer_pairs(spark, d))
    return scored.select("conv_id", "turn", F.round("content_f1", 6).alias("content_f1"))


_LCS = """lcs AS (SELECT conv_id, turn, len(pw)::DOUBLE AS np, len(gw)::DOUBLE AS ng, list_last(list_reduce(
  list_transform(range(1, len(pw) + 1), lambda i: [i]), lambda acc, x: list_transform(range(1, len(gw) + 1),
    lambda j: list_max(list_transform(range(1, j + 1), lambda i: CASE WHEN gw[i] = pw[x[1]]
      THEN coalesce(CASE WHEN i > 1 THEN acc[i - 1] END, 0) + 1 ELSE acc[i] END))),
  list_transform(gw, lambda e: 0::BIGINT)))::DOUBLE AS c FROM words)"""


@query(
    "rouge_l",
    f"""WITH {_PAIRS}, {_LCS}
SELECT conv_id, turn, round(c / np, 6) AS rouge_l_precision, round(c / ng, 6) AS rouge_l_recall,
  round(CASE WHEN c = 0 THEN 0 ELSE 2.0 * (c / np) * (c / ng) / (c / np + c / ng) END, 6) AS rouge_l_f1 FROM lcs""",
)
def rouge_l(spark, d) -> DataFrame:
    scored = metrics.rouge_l(data.answer_pairs(spark, d))
    return scored.select(
        "conv_id", "turn", *[F.round(f"rouge_l_{m}", 6).alias(f"rouge_l_{m}") for m in ("precision", "recall", "f1")]
    )


@query(
    "semantic_similarity",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id AS pair_id, round(CASE WHEN a.vec_id % 10 = 0 THEN 0 ELSE greatest(0, list_dot_product(a.e, b.e)
  / ((sqrt(list_dot_product(a.e, a.e)) + 1e-9) * (sqrt(list_dot_product(b.e, b.e)) + 1e-9))) END, 6) AS semantic_sim
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
)
def semantic_similarity(spark, d) -> DataFrame:
    v = data.table(spark, d, "embeddings")
    follow = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    text = F.when(F.col("vec_id") % 10 == 0, " ").otherwise("x")
    value = metrics.semantic_similarity(F.col("embedding"), F.col("other"), text, F.lit("x"))
    return v.join(follow, "vec_id").select(F.col("vec_id").alias("pair_id"), F.round(value, 6).alias("semantic_sim"))


_ITEMS = """items AS (SELECT conv_id % 3 + 1 AS run_id, conv_id * 100 + turn AS query_pk, conv_id, turn,
  CASE WHEN turn = 7 THEN '' ELSE text END AS answer_text FROM conversations WHERE role = 'assistant'),
cited AS (SELECT run_id, query_pk, 0 AS position, (turn % 5) || ':0' AS chunk_id, NULL AS text FROM items WHERE turn <> 3
  UNION ALL SELECT run_id, query_pk, 1, (conv_id % 5) || ':0', CASE WHEN turn % 4 = 1 THEN 't' END FROM items
  WHERE turn <> 3),
agold AS (SELECT '1800' AS version, query_pk, (query_pk % 5) || ':0' AS chunk_id, 1 + query_pk % 3 AS relevance FROM items
  UNION ALL SELECT 'semantic', query_pk, ((query_pk + 1) % 5) || ':0', 1 + query_pk % 3 FROM items)"""


@query(
    "citations",
    f"WITH {_ITEMS} SELECT run_id, query_pk, position::BIGINT AS position, chunk_id, text FROM cited",
)
def citations(spark, d) -> DataFrame:
    rows = metrics.citations(data.run_items(spark, d))
    return rows.withColumn("position", F.col("position").cast("long"))


_CITATION = """cm AS (SELECT i.run_id, i.query_pk, i.version, count(DISTINCT c.chunk_id) AS n,
  count(DISTINCT g.chunk_id) AS h FROM vi i LEFT JOIN cited c USING (run_id, query_pk)
  LEFT JOIN agold g ON g.version = i.version AND g.query_pk = i.query_pk AND g.chunk_id = c.chunk_id GROUP BY ALL),
citm AS (SELECT run_id, query_pk, 'citation_recall' AS metric, h::DOUBLE AS value FROM cm
  UNION ALL SELECT run_id, query_pk, 'citation_precision', CASE WHEN n = 0 THEN 1 ELSE h / n END FROM cm)"""


@query(
    "citation_metrics",
    f"""WITH {_ITEMS}, vi AS (SELECT *, '1800' AS version FROM items), {_CITATION}
SELECT run_id, query_pk, metric, round(value, 6) AS value FROM citm""",
)
def citation_metrics(spark, d) -> DataFrame:
    items = data.run_items(spark, d)
    gold = data.answer_qrels(spark, d).filter(F.col("qrels_version") == "1800")
    rows = metrics.citation_metrics(items, metrics.citations(items), gold)
    return rows.withColumn("value", F.round("value", 6))


@query(
    "qrels_for_runs",
    f"""WITH {_ITEMS} SELECT r.run_id, version AS qrels_version, query_pk, chunk_id, relevance FROM agold
JOIN (VALUES (1::BIGINT, 'semantic'), (2, '1800'), (3, '1800')) r(run_id, v) ON v = version""",
)
def qrels_for_runs(spark, d) -> DataFrame:
    return scoring.qrels_for_runs(data.runs(spark), data.answer_qrels(spark, d))


@query(
    "gating_metrics",
    """WITH p AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN []::VARCHAR[] ELSE ['a', 'b' || (turn % 3)] END AS pl,
  CASE WHEN turn % 4 = 0 THEN []::VARCHAR[] ELSE ['a', 'b1', 'c'] END AS gl, ['x' || (conv_id % 2), 'x0'] AS pn, ['x0'] AS gn
  FROM conversations),
m AS (SELECT conv_id, turn,
  CASE WHEN len(gl) = 0 THEN 1.0 ELSE len(list_intersect(pl, gl)) / len(gl) END::DOUBLE AS lr,
  CASE WHEN len(pl) > 0 THEN len(list_intersect(pl, gl)) / len(pl) WHEN len(gl) = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS lp,
  1.0::DOUBLE AS nr, 1.0 / len(list_distinct(pn))::DOUBLE AS np FROM p)
SELECT conv_id, turn, round(lr, 6) AS lane_ids_recall, round(lp, 6) AS lane_ids_precision,
  round((lr + nr + 1) / 3, 6) AS avg_gating_recall, round((lp + np + 1) / 3, 6) AS avg_gating_precision FROM m""",
)
def gating_metrics(spark, d) -> DataFrame:
    none = F.array().cast("array<string>")
    turn = F.col("turn")
    rows = data.turns(spark, d).select(
        "conv_id", "turn",
        F.when(turn == 0, none).otherwise(F.array(F.lit("a"), F.concat(F.lit("b"), (turn % 3).cast("string"))))
        .alias("lane_ids"),
        F.when(turn % 4 == 0, none).otherwise(F.array(F.lit("a"), F.lit("b1"), F.lit("c"))).alias("expected_lane_ids"),
        F.array(F.concat(F.lit("x"), (F.col("conv_id") % 2).cast("string")), F.lit("x0")).alias("node_ids"),
        F.array(F.lit("x0")).alias("expected_node_ids"),
        none.alias("task_names"), none.alias("expected_task_names"),
    )
    names = ["lane_ids_recall", "lane_ids_precision", "avg_gating_recall", "avg_gating_precision"]
    return metrics.gating_metrics(rows).select("conv_id", "turn", *[F.round(n, 6).alias(n) for n in names])


# ---- judges --------------------------------------------------------------------------------------------------------

_FORMS = "[" + ", ".join("'" + f + "'" for f in data.JUDGE_FORMS) + "]"
_JUDGES = "[" + ", ".join(f"'{j}'" for j in data.JUDGES) + "]"
# What each of the seven forms says: valid, score, outside, invented, speculation, uncertainty, type, reasoning.
_SAID = f"""said AS (SELECT i.run_id, i.query_pk, judge, (i.query_pk + length(judge)) % 7 AS form,
  {_FORMS}[1 + (i.query_pk + length(judge)) % 7] AS raw FROM items i, (SELECT unnest({_JUDGES}) AS judge)),
meant AS (SELECT *, form IN (0, 1, 3, 4, 5) AS valid, [4.0, 2.0, 3.0, 3.0, 5.0, 1.0, 3.0][1 + form]::DOUBLE AS score,
  CASE form WHEN 1 THEN 1 ELSE 0 END AS outside, CASE form WHEN 1 THEN 2 ELSE 0 END AS invented,
  form = 4 AS speculation, form = 5 AS uncertain,
  CASE form WHEN 4 THEN 'qualified_answer' WHEN 5 THEN 'clarification' ELSE 'unknown' END AS kind,
  CASE form WHEN 0 THEN 'fine' WHEN 1 THEN 'r' ELSE '' END AS reasoning FROM said)"""


@query(
    "parse_judge",
    f"""WITH {_ITEMS}, {_SAID} SELECT run_id, query_pk, judge,
  CASE WHEN valid THEN regexp_extract(raw, '\\{{[^{{}}]*\\}}') END AS parsed,
  CASE WHEN NOT valid THEN 'Could not parse response' END AS error FROM meant""",
)
def parse_judge(spark, d) -> DataFrame:
    return judging.parse_judge(data.judge_outputs(spark, d)).select("run_id", "query_pk", "judge", "parsed", "error")


def _parsed(spark, d) -> DataFrame:
    return judging.parse_judge(data.judge_outputs(spark, d))


@query(
    "judge_scores",
    f"WITH {_ITEMS}, {_SAID} SELECT run_id, query_pk, judge, score, (score - 1) / 4 AS normalized FROM meant",
)
def judge_scores(spark, d) -> DataFrame:
    return judging.judge_scores(_parsed(spark, d)).select("run_id", "query_pk", "judge", "score", "normalized")


@query(
    "judge_gating",
    f"""WITH {_ITEMS}, {_SAID}, g AS (SELECT *, run_id <> 2 AS hinted FROM meant WHERE judge = 'gating')
SELECT run_id, query_pk, CASE WHEN hinted THEN (5 - score) / 4 ELSE 0 END AS h2_error_rate,
  CASE WHEN hinted THEN 1 ELSE 0 END::DOUBLE AS h2_gating_applied, CASE WHEN hinted THEN score END AS h2_score,
  CASE WHEN hinted THEN outside END::BIGINT AS h2_mentions_outside_context,
  CASE WHEN hinted THEN invented END::BIGINT AS h2_hallucinated_steps FROM g""",
)
def judge_gating(spark, d) -> DataFrame:
    rows = _parsed(spark, d).filter(F.col("judge") == "gating")
    scored = judging.judge_gating(rows.withColumn("hint", F.when(F.col("run_id") != 2, "stay").otherwise(" ")))
    return scored.select(
        "run_id", "query_pk", "h2_error_rate", "h2_gating_applied", "h2_score",
        *[F.col(c).cast("long").alias(c) for c in ("h2_mentions_outside_context", "h2_hallucinated_steps")],
    )


@query(
    "judge_grey_zone",
    f"""WITH {_ITEMS}, {_SAID}, g AS (SELECT *, query_pk % 2 = 0 AS bare FROM meant WHERE judge = 'gray_zone')
SELECT run_id, query_pk, CASE WHEN NOT speculation AND kind IN ('qualified_answer', 'clarification', 'escalation')
    AND (uncertain OR kind = 'clarification' OR (NOT bare AND score >= 4)) THEN 1 ELSE 0 END::DOUBLE
    AS h3_appropriate_handling,
  speculation::INT::DOUBLE AS h3_speculation_detected, uncertain::INT::DOUBLE AS h3_uncertainty_expressed,
  score AS h3_score, kind AS h3_response_type FROM g""",
)
def judge_grey_zone(spark, d) -> DataFrame:
    rows = _parsed(spark, d).filter(F.col("judge") == "gray_zone")
    scored = judging.judge_grey_zone(rows, F.col("query_pk") % 2 == 0)
    return scored.select("run_id", "query_pk", *[c for c in scored.columns if c.startswith("h3_")])


@query(
    "judge_by_query_type",
    """WITH p AS (SELECT conv_id, turn, ['structure', 'knowledge', 'mixed'][1 + turn % 3] AS query_type,
  (1 + conv_id % 5)::DOUBLE AS s, turn % 4 AS n FROM conversations)
SELECT conv_id, turn, CASE query_type WHEN 'structure' THEN round((n + 1) / greatest(1, n + 2), 6) END AS structure_violation_rate,
  CASE query_type WHEN 'structure' THEN round(1 / greatest(1, n + 2), 6) END AS hint_adherence,
  round(CASE query_type WHEN 'structure' THEN 1 / (n + 2) WHEN 'mixed' THEN 0 END, 6) AS hallucination_rate,
  CASE query_type WHEN 'knowledge' THEN (5 - s) / 4 END AS knowledge_score,
  CASE query_type WHEN 'knowledge' THEN n END AS context_violation_count,
  CASE query_type WHEN 'mixed' THEN round((s + 3 + 3) / 3, 6) END AS combined_score,
  CASE query_type WHEN 'mixed' THEN CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE END AS scope_violation_rate FROM p""",
)
def judge_by_query_type(spark, d) -> DataFrame:
    score = (1 + F.col("conv_id") % 5).cast("string")
    listed = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit('"t"'), (F.col("turn") % 4).cast("int")), ","), F.lit("]"))
    raw = F.concat(
        F.lit('{"score": '), score, F.lit(', "structure_score": '), score,
        F.lit(', "mentioned_from_hint": ["a"], "hallucinated": ["z"], "mentioned_outside_hint": '), listed,
        F.lit(', "out_of_context_mentions": '), listed, F.lit(', "mentioned_tasks_out_of_scope": '), listed, F.lit("}"),
    )
    kinds = F.array(F.lit("structure"), F.lit("knowledge"), F.lit("mixed"))
    rows = data.turns(spark, d).select(
        "conv_id", "turn", kinds[(F.col("turn") % 3).cast("int")].alias("query_type"), raw.alias("raw")
    )
    scored = judging.judge_by_query_type(judging.parse_judge(rows))
    rates = ["structure_violation_rate", "hint_adherence", "hallucination_rate", "knowledge_score", "combined_score",
             "scope_violation_rate"]
    return scored.select(
        "conv_id", "turn", F.col("context_violation_count").cast("long").alias("context_violation_count"),
        *[F.round(r, 6).alias(r) for r in rates],
    )


@query(
    "score_runs",
    f"""WITH {_ITEMS}, vi AS (SELECT *, CASE run_id WHEN 1 THEN 'semantic' ELSE '1800' END AS version FROM items
  WHERE answer_text <> ''), {_CITATION}, {_PAIRS}, {_F1}, {_LCS}, {_SAID},
ranking AS (SELECT run_id, query_pk AS qpk, CASE run_id WHEN 1 THEN 'semantic' ELSE '1800' END || '|' || query_pk AS query_pk,
  ((query_pk // 100 + i) % 5) || ':0' AS chunk_id, i AS position FROM items, range(1, 6) r(i)),
gold AS (SELECT version || '|' || query_pk AS query_pk, chunk_id, relevance FROM agold), {METRICS},
vecs AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ans AS (SELECT i.*, (SELECT count(*) FROM embeddings) AS nv, EXISTS (SELECT 1 FROM f1 WHERE f1.conv_id = i.conv_id AND f1.turn = i.turn) AS has_gold,
  EXISTS (SELECT 1 FROM cited c WHERE c.query_pk = i.query_pk AND c.text IS NOT NULL) AS texts, conv_id % 2 = 0 AS hinted
  FROM items i WHERE answer_text <> ''),
j AS (SELECT m.*, a.has_gold, a.texts, a.hinted FROM meant m JOIN ans a USING (run_id, query_pk) WHERE run_id <> 3),
judged AS (
  SELECT run_id, query_pk, 'factual_consistency_score' AS metric, score AS value FROM j WHERE judge = 'consistency' AND has_gold
  UNION ALL SELECT run_id, query_pk, 'factual_consistency_normalized', (score - 1) / 4 FROM j
    WHERE judge = 'consistency' AND has_gold
  UNION ALL SELECT run_id, query_pk, 'llm_answer_relevance', (score - 1) / 4 FROM j WHERE judge = 'answer_relevance' AND run_id = 1
  UNION ALL SELECT run_id, query_pk, 'llm_context_relevance', (score - 1) / 4 FROM j
    WHERE judge = 'context_relevance' AND run_id = 1 AND texts
  UNION ALL SELECT run_id, query_pk, 'llm_faithfulness', (score - 1) / 4 FROM j WHERE judge = 'faithfulness' AND run_id = 1 AND texts
  UNION ALL SELECT run_id, query_pk, unnest(['h2_error_rate', 'h2_gating_applied', 'h2_score', 'h2_mentions_outside_context',
    'h2_hallucinated_steps']), unnest([(5 - score) / 4, 1, score, outside, invented]) FROM j WHERE judge = 'gating' AND hinted
  UNION ALL SELECT run_id, query_pk, unnest(['h3_appropriate_handling', 'h3_speculation_detected', 'h3_uncertainty_expressed',
    'h3_score']), unnest([CASE WHEN NOT speculation AND kind <> 'unknown' AND (uncertain OR kind = 'clarification'
    OR (texts AND score >= 4)) THEN 1 ELSE 0 END, speculation::INT, uncertain::INT, score]) FROM j
    WHERE judge = 'gray_zone' AND run_id = 1),
everything AS (SELECT run_id, split_part(query_pk, '|', 2)::BIGINT AS query_pk, metric, value FROM long
  UNION ALL SELECT run_id, query_pk, metric, value FROM citm UNION ALL SELECT * FROM judged
  UNION ALL SELECT a.run_id, a.query_pk, 'content_f1', v FROM f1 JOIN ans a USING (conv_id, turn)
  UNION ALL SELECT a.run_id, a.query_pk, 'rouge_l_recall', coalesce(c / nullif(ng, 0), 0) FROM lcs JOIN ans a USING (conv_id, turn)
  UNION ALL SELECT a.run_id, a.query_pk, 'semantic_sim', CASE WHEN trim(pred) = '' OR trim(gold) = '' THEN 0
    ELSE greatest(0, list_dot_product(x.e, y.e) / ((sqrt(list_dot_product(x.e, x.e)) + 1e-9)
    * (sqrt(list_dot_product(y.e, y.e)) + 1e-9))) END FROM pairs JOIN ans a USING (conv_id, turn)
    JOIN vecs x ON x.vec_id = a.query_pk % a.nv JOIN vecs y ON y.vec_id = (a.query_pk + 1) % a.nv)
SELECT run_id, query_pk, metric, round(value, 6) AS value FROM everything""",
)
def score_runs(spark, d) -> DataFrame:
    rows = scoring.score_runs(
        data.runs(spark), data.run_items(spark, d), data.answer_logs(spark, d), data.answer_qrels(spark, d),
        data.gold_answers(spark, d), data.judge_outputs(spark, d), data.pair_vectors(spark, d),
    )
    return rows.select("run_id", "query_pk", "metric", F.round("value", 6).alias("value"))
