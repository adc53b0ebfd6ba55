"""Retrieval queries: postings, BM25, dense search, fusion, reranking, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions.scale import cut_lineage
from ragloom.operators import dense, fusion, lexical
from ragloom.plans import datasets as data
from ragloom.plans.registry import query

# ---- SQL building blocks -------------------------------------------------------------------------------------------

CHUNKS = """chunks AS (
  SELECT doc_id::VARCHAR || ':0' AS chunk_id, text, source AS process_name, lang AS tags,
         regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS words FROM documents)"""

TERMS = CHUNKS + """, lens AS (SELECT chunk_id, process_name, tags, len(words) AS length FROM chunks),
terms AS (SELECT chunk_id, process_name, tags, length, term, count(*) AS tf FROM (
  SELECT chunk_id, process_name, tags, len(words) AS length, unnest(words) AS term FROM chunks) GROUP BY ALL)"""


def bm25_sql(queries: str, keep: int, name: str = "bm25") -> str:
    """CTEs that end in `name`(query_pk, chunk_id, score, rank) for `queries`(query_pk, text)."""
    return f"""{TERMS}, q AS ({queries}),
qt AS (SELECT query_pk, term, count(*) AS qtf FROM (
  SELECT query_pk, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM q) GROUP BY ALL),
st AS (SELECT count(*)::DOUBLE AS n, avg(length) AS a FROM lens),
dfs AS (SELECT term, count(*)::DOUBLE AS df FROM terms GROUP BY term),
txt AS (SELECT query_pk, chunk_id,
   3.0 * sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / a))) AS s
   FROM qt JOIN terms USING (term) JOIN dfs USING (term), st GROUP BY ALL),
kp AS (SELECT process_name AS v, count(*)::DOUBLE AS df FROM lens GROUP BY 1),
kt AS (SELECT tags AS v, count(*)::DOUBLE AS df FROM lens GROUP BY 1),
allhits AS (
  SELECT query_pk, chunk_id, s FROM txt
  UNION ALL SELECT query_pk, chunk_id, 5.0 * ln(1 + (n - df + 0.5) / (df + 0.5))
    FROM q JOIN kp ON kp.v = q.text JOIN lens ON lens.process_name = q.text, st
  UNION ALL SELECT query_pk, chunk_id, 2.0 * ln(1 + (n - df + 0.5) / (df + 0.5))
    FROM q JOIN kt ON kt.v = q.text JOIN lens ON lens.tags = q.text, st),
best AS (SELECT query_pk, chunk_id, round(max(s), 9) AS score FROM allhits GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_pk ORDER BY score DESC, chunk_id) AS rank
  FROM best) WHERE rank <= {keep})"""


BENCHMARK = "SELECT item_id AS query_pk, text FROM benchmark"

VECTORS = """vecs AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v, label FROM embeddings),
qv AS (SELECT chunk_id AS query_pk, v AS qv, label AS q_label FROM vecs
  WHERE chunk_id IN (SELECT item_id FROM benchmark))"""


def dense_sql(keep: int, name: str = "dense", where: str = "TRUE") -> str:
    return f"""{VECTORS}, sims AS (
  SELECT query_pk, chunk_id, round(list_dot_product(qv, v)
    / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(v, v))), 9) AS score FROM qv, vecs WHERE {where}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_pk ORDER BY score DESC, chunk_id) AS rank
  FROM sims) WHERE rank <= {keep})"""


# ---- queries -------------------------------------------------------------------------------------------------------


@query(
    "postings_term_statistics",
    f"WITH {TERMS} SELECT term, count(*) AS doc_freq, sum(tf)::BIGINT AS total_tf FROM terms GROUP BY term",
)
def postings_term_statistics(spark, d) -> DataFrame:
    index = lexical.postings(data.chunks(spark, d))
    return index.terms.groupBy("term").agg(F.sum("chunks").alias("doc_freq"), F.sum("total_tf").alias("total_tf"))


@query(
    "bm25_topk",
    f"WITH {bm25_sql(BENCHMARK, 10)} SELECT query_pk, chunk_id, round(score, 6) AS score, rank FROM bm25",
)
def bm25_topk(spark, d) -> DataFrame:
    hits = lexical.bm25_topk(data.queries(spark, d), lexical.postings(data.chunks(spark, d)), 10)
    return hits.select("query_pk", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


_KEYWORDS = """SELECT DISTINCT 100000 + substr(source, 4)::BIGINT AS query_pk, source AS text FROM documents
  UNION ALL SELECT DISTINCT 200000 + ascii(lang) AS query_pk, lang AS text FROM documents"""


def _keyword_queries(spark, d) -> DataFrame:
    documents = data.table(spark, d, "documents")
    by_source = documents.select("source").distinct().select(
        (F.substring("source", 4, 10).cast("long") + 100_000).alias("query_pk"), F.col("source").alias("text")
    )
    by_lang = documents.select("lang").distinct().select(
        (F.ascii("lang").cast("long") + 200_000).alias("query_pk"), F.col("lang").alias("text")
    )
    return by_source.unionByName(by_lang)


@query(
    "bm25_keyword_fields",
    f"WITH {bm25_sql(_KEYWORDS, 20)} SELECT query_pk, chunk_id, round(score, 6) AS score, rank FROM bm25",
)
def bm25_keyword_fields(spark, d) -> DataFrame:
    hits = lexical.bm25_topk(_keyword_queries(spark, d), lexical.postings(data.chunks(spark, d)), 20)
    return hits.select("query_pk", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(
    "bm25_filtered",
    f"""WITH {bm25_sql(BENCHMARK, 1000000)}, kept AS (
  SELECT b.*, row_number() OVER (PARTITION BY query_pk ORDER BY score DESC, chunk_id) AS r FROM bm25 b
  JOIN lens USING (chunk_id) WHERE CASE WHEN query_pk % 2 = 0 THEN process_name = 'src' || (query_pk % 20)
    ELSE tags IN ('en', 'de') END)
SELECT query_pk, chunk_id, round(score, 6) AS score, r AS rank FROM kept WHERE r <= 10""",
)
def bm25_filtered(spark, d) -> DataFrame:
    even = F.col("query_pk") % 2 == 0
    asked = (
        data.queries(spark, d)
        .withColumn("filter_process", F.when(even, F.concat(F.lit("src"), (F.col("query_pk") % 20).cast("string"))))
        .withColumn("filter_tags", F.when(~even, F.array(F.lit("en"), F.lit("de"))))
    )
    hits = lexical.bm25_topk(asked, lexical.postings(data.chunks(spark, d)), 10)
    return hits.select("query_pk", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(
    "filter_chunks",
    "SELECT doc_id::VARCHAR || ':0' AS chunk_id FROM documents WHERE source = 'src7' AND lang IN ('en', 'fr')",
)
def filter_chunks(spark, d) -> DataFrame:
    return lexical.filter_chunks(data.chunks(spark, d), "src7", ["en", "fr"]).select("chunk_id")


@query(
    "filter_by_process_scope",
    """SELECT doc_id::VARCHAR || ':0' AS chunk_id FROM documents
WHERE (source = 'src1' AND doc_id % 3 = 1) OR (source = 'src2' AND lang = 'en') OR source = 'src3'""",
)
def filter_by_process_scope(spark, d) -> DataFrame:
    placed = data.table(spark, d, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("chunk_id"),
        F.col("source").alias("process_id"),
        (F.col("doc_id") % 3).cast("string").alias("node_id"),
        F.col("lang").alias("lane_id"),
    )
    scope = spark.createDataFrame(
        [("src1", ["1"], []), ("src2", [], ["en"]), ("src3", None, None)],
        "process_id string, node_ids array<string>, lane_ids array<string>",
    )
    return lexical.filter_by_process_scope(placed, scope).select("chunk_id")


@query(
    "vector_topk",
    f"WITH {dense_sql(10)} SELECT query_pk, chunk_id, round(score, 6) AS score, rank FROM dense",
)
def vector_topk(spark, d) -> DataFrame:
    hits = dense.vector_topk(data.query_vectors(spark, d), data.vectors(spark, d), 10)
    return hits.select("query_pk", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(
    "vector_topk_filtered",
    f"""WITH {dense_sql(10, where="CASE WHEN query_pk % 2 = 0 THEN label = query_pk % 10 ELSE label IN (1, 3) END")}
SELECT query_pk, chunk_id, round(score, 6) AS score, rank FROM dense""",
)
def vector_topk_filtered(spark, d) -> DataFrame:
    even = F.col("query_pk") % 2 == 0
    asked = (
        data.query_vectors(spark, d)
        .withColumn("filter_process", F.when(even, (F.col("query_pk") % 10).cast("string")))
        .withColumn("filter_tags", F.when(~even, F.array(F.lit("1"), F.lit("3"))))
    )
    label = F.col("label").cast("string")
    corpus = data.vectors(spark, d).withColumn("process_name", label).withColumn("tags", label)
    hits = dense.vector_topk(asked, corpus, 10)
    return hits.select("query_pk", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


@query(
    "rrf_weights",
    f"WITH {dense_sql(10)} SELECT query_pk, chunk_id, round(1.0 / (60 + rank), 9) AS weight FROM dense",
)
def rrf_weights(spark, d) -> DataFrame:
    ranked = fusion.rrf(dense.vector_topk(data.query_vectors(spark, d), data.vectors(spark, d), 10), 0)
    return ranked.select("query_pk", "chunk_id", F.round("weight", 9).alias("weight"))


def _text_queries(spark, d) -> DataFrame:
    return data.text_queries(spark, d)


def _corpus_vectors(spark, d) -> DataFrame:
    return data.chunk_vectors(spark, d).select("chunk_id", "embedding")


def hybrid_sql(k: int, fetch: int | None = None, keep: int | None = None) -> str:
    fetch, keep = fetch or 5 * k, keep or k
    return f"""{bm25_sql(BENCHMARK, fetch)}, {VECTORS},
cv AS (SELECT doc_id::VARCHAR || ':0' AS chunk_id, v FROM documents
   JOIN vecs ON vecs.chunk_id = doc_id % (SELECT count(*) FROM vecs)),
tv AS (SELECT item_id AS query_pk, v AS tv FROM benchmark JOIN vecs ON chunk_id = item_id % (SELECT count(*) FROM vecs)),
near AS (SELECT query_pk, chunk_id, round(list_dot_product(tv, v)
   / (sqrt(list_dot_product(tv, tv)) * sqrt(list_dot_product(v, v))), 9) AS score FROM tv, cv),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_pk ORDER BY score DESC, chunk_id) AS rank
   FROM near) WHERE rank <= {fetch}),
fused AS (SELECT coalesce(b.query_pk, e.query_pk) AS query_pk, coalesce(b.chunk_id, e.chunk_id) AS chunk_id,
   b.rank AS br, e.rank AS er,
   coalesce(1.0::DOUBLE / (60 + b.rank), 0) + coalesce(1.0::DOUBLE / (60 + e.rank), 0) AS score
   FROM bm25 b FULL JOIN dense e ON b.query_pk = e.query_pk AND b.chunk_id = e.chunk_id),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_pk
   ORDER BY score DESC, br NULLS LAST, er NULLS LAST) AS rank FROM fused) WHERE rank <= {keep})"""


@query(
    "fuse",
    f"WITH {hybrid_sql(10, 50, 1000000)} SELECT query_pk, chunk_id, br AS bm25_rank, er AS vec_rank, "
    "round(score, 9) AS score FROM hybrid",
)
def fuse(spark, d) -> DataFrame:
    asked = _text_queries(spark, d)
    text = lexical.bm25_topk(asked, lexical.postings(data.chunks(spark, d)), 50)
    near = dense.vector_topk(asked, _corpus_vectors(spark, d), 50)
    return fusion.fuse(text, near).select(
        "query_pk", "chunk_id", F.col("bm25_rank").cast("long"), F.col("vec_rank").cast("long"),
        F.round("score", 9).alias("score"),
    )


@query(
    "hybrid_search",
    f"WITH {hybrid_sql(10)} SELECT query_pk, chunk_id, round(score, 9) AS rrf_score, 'rrf' AS source, rank FROM hybrid",
)
def hybrid_search(spark, d) -> DataFrame:
    hits = fusion.hybrid_search(
        _text_queries(spark, d), lexical.postings(data.chunks(spark, d)), _corpus_vectors(spark, d), 10
    )
    return hits.withColumn("rrf_score", F.round("rrf_score", 9)).withColumn("rank", F.col("rank").cast("long"))


@query(
    "search_bm25_only",
    f"""WITH {bm25_sql(BENCHMARK, 10)}
SELECT query_pk, chunk_id, round(1.0 / (60 + rank), 9) AS rrf_score, 'bm25' AS source, rank FROM bm25""",
)
def search_bm25_only(spark, d) -> DataFrame:
    hits = fusion.hybrid_search(
        _text_queries(spark, d), lexical.postings(data.chunks(spark, d)), None, 10, "bm25_only"
    )
    return hits.withColumn("rrf_score", F.round("rrf_score", 9)).withColumn("rank", F.col("rank").cast("long"))


@query(
    "search_vector_only",
    f"""WITH {hybrid_sql(10)}
SELECT query_pk, chunk_id, round(1.0 / (60 + rank), 9) AS rrf_score, 'vector' AS source, rank
FROM dense WHERE rank <= 10""",
)
def search_vector_only(spark, d) -> DataFrame:
    hits = fusion.hybrid_search(_text_queries(spark, d), None, _corpus_vectors(spark, d), 10, "vector_only")
    return hits.withColumn("rrf_score", F.round("rrf_score", 9)).withColumn("rank", F.col("rank").cast("long"))


def hydrated_sql(where: str = "TRUE") -> str:
    return f""", hydrated AS (
  SELECT query_pk, h.chunk_id, score AS rrf_score, text, process_name,
         row_number() OVER (PARTITION BY query_pk ORDER BY rank) AS rank
  FROM hybrid h JOIN chunks USING (chunk_id) WHERE {where})"""


_HYDRATED = hydrated_sql()


def _hydrated(spark, d, gone: str | None = None, **options) -> DataFrame:
    """Hits with their chunks; with `gone`, the chunks of that process have vanished since they were indexed."""
    hits = fusion.hybrid_search(
        _text_queries(spark, d), lexical.postings(data.chunks(spark, d)), _corpus_vectors(spark, d), 10, **options
    )
    there = data.chunks(spark, d)
    return fusion.hydrate(hits, there if gone is None else there.filter(F.col("process_name") != gone))


@query(
    "hydrate",
    f"""WITH {hybrid_sql(10)}{hydrated_sql("process_name <> 'src3'")}
SELECT query_pk, chunk_id, length(text) AS n_chars, process_name, rank FROM hydrated""",
)
def hydrate(spark, d) -> DataFrame:
    return _hydrated(spark, d, "src3").select(
        "query_pk", "chunk_id", F.length("text").cast("long").alias("n_chars"), "process_name",
        F.col("rank").cast("long"),
    )


def _pair_scores(hits: DataFrame) -> DataFrame:
    """Recorded pair scores: a hash of the pair; queries divisible by five have none."""
    key = F.concat(F.col("query_pk").cast("string"), F.lit("|"), F.col("chunk_id"))
    score = F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("double") / 16777216 * 8 - 4
    return hits.filter(F.col("query_pk") % 5 != 0).select("query_pk", "chunk_id", score.alias("pair_score"))


_RERANKED = f"""{hybrid_sql(10, 50, 50)}{_HYDRATED}, scored AS (
  SELECT *, CASE WHEN query_pk % 5 <> 0 THEN ('0x' || substr(md5(query_pk || '|' || chunk_id), 1, 6))::BIGINT::DOUBLE
    / 16777216 * 8 - 4 END AS pair_score FROM hydrated),
reranked AS (SELECT * FROM (SELECT query_pk, chunk_id, text, process_name, rrf_score, pair_score,
   row_number() OVER (PARTITION BY query_pk ORDER BY coalesce(-pair_score, 0), rank) AS rank FROM scored)
   WHERE rank <= 10),
final AS (SELECT *, coalesce(pair_score, 1.0 - (rank - 1) * 0.1)::DOUBLE AS rerank_score,
   CASE WHEN pair_score IS NULL THEN 'rrf' ELSE 'ce' END AS source FROM reranked)"""


def _reranked(spark, d) -> DataFrame:
    hits = cut_lineage(_hydrated(spark, d, rerank_top_n=50))
    return fusion.rerank(hits, data.queries(spark, d), _pair_scores(hits), 10)


@query(
    "rerank",
    f"WITH {_RERANKED} SELECT query_pk, chunk_id, round(rerank_score, 6) AS rerank_score, source, rank FROM final",
)
def rerank(spark, d) -> DataFrame:
    return _reranked(spark, d).select(
        "query_pk", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "source", F.col("rank").cast("long")
    )


@query(
    "answer_confidence",
    f"""WITH {_RERANKED}, conf AS (SELECT query_pk, max(1.0 / (1.0 + exp(-rerank_score))) AS c FROM final GROUP BY 1)
SELECT query_pk, round(c, 6) AS confidence,
  CASE WHEN c >= 0.75 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM conf
UNION ALL SELECT -1 - item_id, 0, 'low' FROM benchmark""",
)
def answer_confidence(spark, d) -> DataFrame:
    hits = _reranked(spark, d).withColumn("score", F.lit(None).cast("double"))
    asked = data.queries(spark, d).select("query_pk")
    without = asked.select((-1 - F.col("query_pk")).alias("query_pk"))  # queries that nothing was found for
    return fusion.answer_confidence(hits, queries=asked.unionByName(without)).withColumn(
        "confidence", F.round("confidence", 6)
    )


@query(
    "context_block",
    f"""WITH {hybrid_sql(10)}{_HYDRATED}
SELECT query_pk, md5(string_agg('[' || rank || '] (Quelle: ' || chunk_id || ')' || chr(10) || text,
  chr(10) || chr(10) ORDER BY rank)) AS context FROM hydrated GROUP BY 1""",
)
def context_block(spark, d) -> DataFrame:
    return fusion.context_block(_hydrated(spark, d)).withColumn("context", F.md5("context"))


@query(
    "context_block_streamed",
    f"""WITH {hybrid_sql(10)}{_HYDRATED}
SELECT query_pk, md5(string_agg('[Chunk ' || rank || '] Quelle: ' || process_name || '.pdf' || chr(10) || text,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context FROM hydrated GROUP BY 1""",
)
def context_block_streamed(spark, d) -> DataFrame:
    return fusion.context_block(_hydrated(spark, d), streamed=True).withColumn("context", F.md5("context"))


@query(
    "first_confidence",
    f"""WITH {_RERANKED}, first AS (SELECT query_pk, arg_min(rerank_score, rank) FILTER (source = 'ce') AS m FROM final GROUP BY 1)
SELECT f.query_pk, round(CASE WHEN m IS NOT NULL THEN 1.0 / (1.0 + exp(-m)) ELSE greatest(0, least(1, n.score)) END, 6)
  AS confidence FROM first f LEFT JOIN dense n ON n.query_pk = f.query_pk AND n.rank = 1""",
)
def first_confidence(spark, d) -> DataFrame:
    """Queries without a cross-encoder score fall back on their first dense hit."""
    model = _reranked(spark, d).withColumn("rerank_score", F.when(F.col("source") == "ce", F.col("rerank_score")))
    near = dense.vector_topk(_text_queries(spark, d), _corpus_vectors(spark, d), 1)
    none = F.lit(None).cast("double")
    hits = model.select("query_pk", "rank", "rerank_score", none.alias("score")).unionByName(
        near.select("query_pk", "rank", none.alias("rerank_score"), "score")
    )
    return fusion.first_confidence(hits).withColumn("confidence", F.round("confidence", 6))


@query(
    "evidence_rows",
    f"""WITH {_RERANKED}, shown AS (
  SELECT query_pk, rank AS position, chunk_id, substr(text, 1, 300) AS text, round(rrf_score, 4) AS score,
    round(rerank_score, 4) AS rerank_score, process_name, process_name || '.pdf' AS filename,
    (SELECT lang FROM documents WHERE doc_id = split_part(chunk_id, ':', 1)::BIGINT) AS tags FROM final
  UNION ALL SELECT item_id, 0, 'bpmn_' || item_id, 'Prozesskontext', NULL, NULL, 'src' || item_id,
    'BPMN-Prozess: src' || item_id, NULL FROM benchmark WHERE item_id % 3 <> 0)
SELECT query_pk, position, chunk_id, md5(text) AS text, score, rerank_score, process_name, filename, tags,
  NULL::VARCHAR AS page_number, NULL::VARCHAR AS section_title FROM shown""",
)
def evidence_rows(spark, d) -> DataFrame:
    pid = F.col("query_pk").cast("string")
    gated = data.queries(spark, d).select(
        "query_pk",
        F.when(F.col("query_pk") % 3 == 0, "none").when(F.col("query_pk") % 3 == 1, "gating").otherwise("process")
        .alias("mode"),
        pid.alias("process_id"),
        F.concat(F.lit("src"), pid).alias("process_name"),
        F.lit("").alias("hint"),
    )
    rows = fusion.evidence_rows(_reranked(spark, d), gated)
    return rows.select(
        "query_pk", F.col("position").cast("long"), "chunk_id", F.md5("text").alias("text"), "score", "rerank_score",
        "process_name", "filename", "tags", "page_number", "section_title",
    )
