"""Knowledge-graph and test-set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.operators import knowledge
from ragloom.plans import datasets as data
from ragloom.plans.registry import query
from ragloom.sources import evaluation, tables

_SPACE = "' ' || chr(9) || chr(10) || chr(13)"

_WORDS = f"""w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(trim(text, {_SPACE}), '\\s+'), lambda x: x <> '') AS words
  FROM documents)"""


def _joined(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.array_join(c, "|").alias(c) if c in names else F.col(c) for c in df.columns])


@query(
    "fallback_properties",
    f"""WITH {_WORDS}, longs AS (SELECT *, list_transform(list_filter(words, lambda x: length(x) > 4
    AND regexp_matches(x, '^\\p{{Lu}}')), lambda x: trim(x, '.,;:()')) AS terms FROM w),
once AS (SELECT *, list_filter(terms, lambda x, i: list_position(terms, x) = i) AS uniq FROM longs)
SELECT doc_id, md5(CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END) AS title,
  md5(CASE WHEN len(uniq) = 0 THEN 'Dokument' ELSE array_to_string(uniq[1:5], '|') END) AS entities,
  md5(substr(text, 1, 200)) AS summary, md5(substr(text, 1, 40)) AS headlines FROM once""",
)
def fallback_properties(spark, d) -> DataFrame:
    own = knowledge.fallback_properties(F.col("text"))
    rows = data.table(spark, d, "documents").select(
        "doc_id", *[own[c].alias(c) for c in ("title", "entities", "summary", "headlines")]
    )
    rows = _joined(rows, "entities", "headlines")
    return rows.select("doc_id", *[F.md5(c).alias(c) for c in rows.columns[1:]])


@query(
    "node_properties",
    f"""WITH {_WORDS}, longs AS (SELECT *, list_transform(list_filter(words, lambda x: length(x) > 4
    AND regexp_matches(x, '^\\p{{Lu}}')), lambda x: trim(x, '.,;:()')) AS terms,
  list_filter(words[1:20], lambda x: length(x) > 5 AND regexp_matches(x, '^\\p{{Lu}}'))[1:3] AS few FROM w),
once AS (SELECT *, list_filter(terms, lambda x, i: list_position(terms, x) = i)[1:5] AS uniq, doc_id % 4 AS k FROM longs),
p AS (SELECT doc_id, text, k, CASE WHEN k = 0 THEN 'T' || doc_id WHEN k = 1 THEN substr(text, 1, 50)
    WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS title,
  CASE WHEN k = 0 THEN 'one' WHEN k = 1 THEN array_to_string(few, '|') WHEN len(uniq) = 0 THEN 'Dokument'
    ELSE array_to_string(uniq, '|') END AS entities,
  CASE WHEN k = 0 THEN 'th' WHEN k = 1 THEN 'k1|k2' ELSE 'Allgemein' END AS themes,
  CASE WHEN k = 0 THEN 'short' ELSE substr(text, 1, 200) END AS summary FROM once WHERE trim(text, {_SPACE}) <> '')
SELECT doc_id::VARCHAR || ':0' AS chunk_id, md5(title) AS title, md5(entities) AS entities, themes, md5(summary) AS summary,
  md5(text || chr(10) || chr(10) || summary) AS embed_text FROM p""",
)
def node_properties(spark, d) -> DataFrame:
    chunks = data.chunks(spark, d).select("chunk_id", "document_id", "text").filter(
        ~F.rlike("text", F.lit(r"^\s*$"))
    )
    doc, k = F.col("document_id"), F.col("document_id").cast("long") % 4
    raw = (
        F.when(k == 0, F.concat(
            F.lit("<think>{no}</think> here: {\"title\": \"T"), doc,
            F.lit('", "entities": "one", "themes": ["th"], "summary": "short"} end')))
        .when(k == 1, '{"keyphrases": ["k1", "k2", "k3"]}')
        .when(k == 2, "{broken")
    )
    rows = knowledge.node_properties(chunks.select("chunk_id", raw.alias("raw")), chunks)
    rows = _joined(rows.select("chunk_id", "title", "entities", "themes", "summary", "embed_text"), "entities", "themes")
    return rows.select(
        "chunk_id", "themes", *[F.md5(c).alias(c) for c in ("title", "entities", "summary", "embed_text")]
    )


def _nodes(spark, d) -> DataFrame:
    """Nodes with items shared by neighbours; one key phrase is on every third node."""
    n = F.col("vec_id")
    tag = lambda letter, width: F.concat(F.lit(letter), F.floor(n / width).cast("string"))
    return data.table(spark, d, "embeddings").select(
        n.alias("node_id"), "embedding",
        F.array(tag(" E", 7), tag("f", 11), F.lit("")).alias("entities"),
        F.when(n % 3 == 0, F.array(tag("K", 5), tag("w", 9), F.lit("Common")))
        .otherwise(F.array(tag("k", 5), tag("w", 9))).alias("keyphrases"),
    )


_SIMILAR = """sims AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.e, b.e)
  / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 9) AS weight
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a
  JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON a.vec_id < b.vec_id)"""


@query(
    "similarity_edges",
    f"WITH {_SIMILAR} SELECT src, dst, 'cosine_similarity' AS type, round(weight, 6) AS weight FROM sims WHERE weight >= 0.5",
)
def similarity_edges(spark, d) -> DataFrame:
    rows = knowledge.similarity_edges(_nodes(spark, d), knowledge.GENERATOR_THRESHOLD)
    return rows.select("src", "dst", "type", F.round("weight", 6).alias("weight"))


@query(
    "similarity_edges_topics",
    """WITH v AS (SELECT vec_id, list_concat(list_transform(embedding::DOUBLE[], lambda x: x
    / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))),
  list_transform(range(10), lambda i: CASE WHEN label = i THEN 2.0 ELSE 0.0 END)) AS e FROM embeddings),
sims AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.e, b.e)
  / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 9) AS weight FROM v a JOIN v b ON a.vec_id < b.vec_id)
SELECT src, dst, 'cosine_similarity' AS type, round(weight, 6) AS weight FROM sims WHERE weight >= 0.825""",
)
def similarity_edges_topics(spark, d) -> DataFrame:
    """Vectors drawn together by their topic: a cluster a label, with thousands of edges inside."""
    raw = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    topic = F.array(*[F.when(F.col("label") == i, 2.0).otherwise(0.0) for i in range(10)])
    vectors = data.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("node_id"), F.concat(F.transform(raw, lambda x: x / norm), topic).alias("embedding")
    )
    rows = knowledge.similarity_edges(vectors, 0.825)
    return rows.select("src", "dst", "type", F.round("weight", 6).alias("weight"))


def _overlap_sql(items: str, kind: str, least: int) -> str:
    return f"""SELECT src, dst, '{kind}' AS type, count(*)::DOUBLE AS weight, string_agg(item, '|' ORDER BY item) AS items
FROM (SELECT a.vec_id AS src, b.vec_id AS dst, a.item FROM ({items}) a JOIN ({items}) b ON a.item = b.item
  AND a.vec_id < b.vec_id) GROUP BY ALL HAVING count(*) >= {least}"""


_ENTITIES = "SELECT vec_id, unnest(['e' || vec_id // 7, 'f' || vec_id // 11]) AS item FROM embeddings"
_PHRASES = """SELECT vec_id, unnest(['k' || vec_id // 5, 'w' || vec_id // 9]) AS item FROM embeddings
  UNION ALL SELECT vec_id, 'common' FROM embeddings WHERE vec_id % 3 = 0"""


@query("overlap_edges_entities", _overlap_sql(_ENTITIES, "entities_overlap", 1))
def overlap_edges_entities(spark, d) -> DataFrame:
    return _joined(knowledge.overlap_edges(_nodes(spark, d), "entities"), "items")


@query("overlap_edges_keyphrases", _overlap_sql(_PHRASES, "keyphrases_overlap", 2))
def overlap_edges_keyphrases(spark, d) -> DataFrame:
    return _joined(knowledge.overlap_edges(_nodes(spark, d), "keyphrases", 2), "items")


@query(
    "knowledge_graph",
    f"""WITH {_SIMILAR}, ent AS ({_overlap_sql(_ENTITIES, 'entities_overlap', 2)}),
phr AS ({_overlap_sql(_PHRASES, 'keyphrases_overlap', 2)})
SELECT 'cosine_similarity' AS type, count(*) AS n FROM sims WHERE weight >= 0.5 HAVING count(*) > 0
UNION ALL SELECT type, count(*) FROM ent GROUP BY 1 UNION ALL SELECT type, count(*) FROM phr GROUP BY 1""",
)
def knowledge_graph(spark, d) -> DataFrame:
    return knowledge.knowledge_graph(_nodes(spark, d), knowledge.GENERATOR_THRESHOLD, 2)[1]


def _contexts(spark, d) -> DataFrame:
    """Whole texts, long prefixes, texts with a lead-in and short prefixes of all documents."""
    text, k = F.col("text"), F.col("doc_id") % 4
    return data.table(spark, d, "documents").select(
        F.col("doc_id").alias("context_id"),
        F.when(k == 0, text)
        .when(k == 1, F.concat(F.substring(text, 1, 320), F.lit(" and more")))
        .when(k == 2, F.concat(F.lit("xx "), F.substring(text, 1, 150)))
        .otherwise(F.concat(F.substring(text, 1, 60), F.lit(" zzz"))).alias("text"),
    )


@query(
    "match_contexts",
    f"""WITH ctx AS (SELECT doc_id AS context_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, 320) || ' and more'
  WHEN 2 THEN 'xx ' || substr(text, 1, 150) ELSE substr(text, 1, 60) || ' zzz' END AS text FROM documents),
st AS (SELECT doc_id::VARCHAR || ':0' AS chunk_id, text FROM documents WHERE doc_id % 5 <> 0),
kk AS (SELECT chunk_id, s AS slot, trim(CASE s WHEN 0 THEN substr(text, 1, 50) WHEN 1 THEN substr(text, 1, 100)
  WHEN 2 THEN substr(text, 1, 150) WHEN 3 THEN substr(text, 1, 200) ELSE text END, {_SPACE}) AS k FROM st, range(5) r(s)),
ks AS (SELECT k, max(chunk_id) AS chunk_id, min({{'c': chunk_id, 's': slot}}) AS first FROM kk WHERE k <> '' GROUP BY k),
asked AS (SELECT context_id, text, trim(text, {_SPACE}) AS c FROM ctx WHERE trim(text, {_SPACE}) <> ''),
tries AS (SELECT context_id, t, CASE t WHEN 0 THEN c ELSE trim(substr(c, 1, [200, 150, 100, 50][t]), {_SPACE}) END AS k
  FROM asked, range(5) r(t)),
direct AS (SELECT context_id, arg_min(chunk_id, t) AS chunk_id FROM tries JOIN ks USING (k) GROUP BY 1),
heads AS (SELECT substr(k, 1, 80) AS head, arg_min(chunk_id, first) AS chunk_id, min(first) AS first FROM ks
  WHERE length(k) > 100 GROUP BY 1),
win AS (SELECT context_id, substr(c, i::INT, 80) AS head FROM asked, range(1, 122) r(i)
  WHERE i + 79 <= least(length(c), 200) AND context_id NOT IN (SELECT context_id FROM direct)),
inside AS (SELECT context_id, arg_min(chunk_id, first) AS chunk_id FROM win JOIN heads USING (head) GROUP BY 1)
SELECT context_id, coalesce(d.chunk_id, i.chunk_id, 'synth_chunk_' || substr(md5(substr(text, 1, 50)), 1, 8)) AS chunk_id
FROM asked LEFT JOIN direct d USING (context_id) LEFT JOIN inside i USING (context_id)""",
)
def match_contexts(spark, d) -> DataFrame:
    stored = data.chunks(spark, d).filter(F.col("document_id").cast("long") % 5 != 0)
    return knowledge.match_contexts(_contexts(spark, d), stored)


@query(
    "sample_chunks",
    """WITH firsts AS (SELECT doc_id::VARCHAR || ':0' AS chunk_id, text FROM documents ORDER BY chunk_id LIMIT 300)
SELECT chunk_id, length(text) AS n_chars FROM firsts WHERE length(text) >= 400""",
)
def sample_chunks(spark, d) -> DataFrame:
    rows = tables.sample_chunks(data.chunks(spark, d), 300)
    return rows.select("chunk_id", F.length("text").cast("long").alias("n_chars"))


@query(
    "export_testset",
    """WITH s AS (SELECT 'q' || item_id AS query_id, text, substr(text, 1, 20) AS answer, item_id FROM benchmark)
SELECT 'queries' AS part, query_id, md5(text) AS a, 'knowledge/retrieval' AS b FROM s
UNION ALL SELECT 'answers', query_id, md5(answer), 'generated sample' FROM s
UNION ALL SELECT 'qrels', query_id, unnest(['c' || item_id, 'd' || item_id % 3]), '3' FROM s""",
)
def export_testset(spark, d) -> DataFrame:
    n = F.col("item_id").cast("string")
    samples = data.table(spark, d, "benchmark").select(
        F.concat(F.lit("q"), n).alias("query_id"), F.col("text").alias("query"),
        F.substring("text", 1, 20).alias("reference_answer"),
        F.array(F.concat(F.lit("c"), n), F.concat(F.lit("d"), (F.col("item_id") % 3).cast("string")))
        .alias("reference_chunk_ids"),
    )
    parts = evaluation.export_testset(samples)
    return (
        parts["queries"].select(F.lit("queries").alias("part"), "query_id", F.md5("text").alias("a"),
                                F.concat_ws("/", "query_type", "expected_source").alias("b"))
        .unionByName(parts["answers"].select(F.lit("answers").alias("part"), "query_id",
                                             F.md5(F.col("answers")[0]).alias("a"), F.col("explanation").alias("b")))
        .unionByName(parts["qrels"].select(F.lit("qrels").alias("part"), "query_id", F.col("chunk_id").alias("a"),
                                           F.col("relevance").cast("string").alias("b")))
    )
