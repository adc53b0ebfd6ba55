"""Queries for files read back, upserts, qrels parsing, process models, uploads and table audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.scale import cut_lineage, work_path
from ragloom.operators.elements import prepare_elements
from ragloom.plans import catalog_chunking, registry  # noqa: F401
from ragloom.plans import datasets as data
from ragloom.plans.registry import query
from ragloom.sources import evaluation, process_models, tables
from ragloom.streaming import ingest


def _events(spark, d) -> DataFrame:
    return data.table(spark, d, "events")


@query(
    "upsert_scores",
    """WITH old AS (SELECT event_type AS run_id, user_id AS query_pk, count(*)::DOUBLE AS value FROM events
  WHERE user_id % 2 = 0 GROUP BY ALL),
new AS (SELECT event_type AS run_id, user_id AS query_pk, arg_max(value, event_id) AS value FROM events
  WHERE user_id % 3 = 0 GROUP BY ALL)
SELECT coalesce(n.run_id, o.run_id) AS run_id, coalesce(n.query_pk, o.query_pk) AS query_pk, 'value' AS metric,
  coalesce(n.value, o.value) AS value FROM old o FULL JOIN new n ON n.run_id = o.run_id AND n.query_pk = o.query_pk""",
)
def upsert_scores(spark, d) -> DataFrame:
    events = _events(spark, d)
    keys = [F.col("event_type").alias("run_id"), F.col("user_id").alias("query_pk"), F.lit("value").alias("metric")]
    old = events.filter(F.col("user_id") % 2 == 0).groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("value"))
    new = events.filter(F.col("user_id") % 3 == 0).select(*keys, "value", "event_id")
    return evaluation.upsert(old, new, evaluation.TABLE_KEYS["scores"], order=F.col("event_id"))


@query(
    "upsert_keeps_document_id",
    """SELECT user_id AS query_pk, (event_id % 20) || ':0' AS chunk_id, '1800' AS qrels_version,
  coalesce(max(CASE WHEN event_id % 3 = 0 THEN 'new' END), 'old') AS document_id, arg_max(event_id % 4, event_id) AS relevance
FROM events GROUP BY ALL""",
)
def upsert_keeps_document_id(spark, d) -> DataFrame:
    event = F.col("event_id")
    rows = _events(spark, d).select(
        F.col("user_id").alias("query_pk"), F.concat((event % 20).cast("string"), F.lit(":0")).alias("chunk_id"),
        F.lit("1800").alias("qrels_version"), F.when(event % 3 == 0, "new").alias("document_id"),
        (event % 4).alias("relevance"), event,
    )
    keys = evaluation.TABLE_KEYS["qrels"]
    old = rows.select(*keys).distinct().withColumn("document_id", F.lit("old")).withColumn(
        "relevance", F.lit(9).cast("long")
    )
    return evaluation.upsert(old, rows, keys, evaluation.KEEP_IF_NULL["qrels"], event)


#: Key columns of the evaluation tables as columns of the events, in Spark and in SQL alike.
_KEY_OF = {
    "name": "event_type", "dataset": "event_type", "query_id": "user_id", "run_id": "event_type", "query_pk": "user_id",
    "rank": "event_id % 3", "source": "event_type", "metric": "event_type",
}
_UPSERTED = "runs queries run_items retrieval_logs aggregates gold_answers gold_gating".split()


def _upsert_sql(table: str) -> str:
    columns = list(dict.fromkeys(_KEY_OF[k] for k in evaluation.TABLE_KEYS[table]))
    keys = " || '/' || ".join(f"({c})" for c in columns) if len(columns) > 1 else f"({columns[0]})::VARCHAR"
    keeps = table in evaluation.KEEP_IF_NULL
    kept = "coalesce(n.document_id, o.document_id)" if keeps else "CASE WHEN n.k IS NULL THEN o.document_id ELSE n.document_id END"
    fold = "arg_max(doc, event_id)" if keeps else "arg_max_null(doc, event_id)"
    return f"""SELECT '{table}' AS part, coalesce(n.k, o.k) AS key, {kept} AS document_id,
  CASE WHEN n.k IS NULL THEN o.value ELSE n.value END AS value FROM (SELECT {keys} AS k, 'old' AS document_id, -1.0::DOUBLE AS value
  FROM events WHERE user_id % 2 = 0 GROUP BY 1) o FULL JOIN (SELECT k, {fold} AS document_id, arg_max_null(value, event_id) AS value
  FROM (SELECT {keys} AS k, CASE WHEN event_id % 3 = 0 THEN 'new' || event_id END AS doc, value, event_id FROM events
  WHERE user_id % 3 = 0) GROUP BY 1) n ON n.k = o.k"""


@query("upsert_tables", " UNION ALL ".join(_upsert_sql(t) for t in _UPSERTED))
def upsert_tables(spark, d) -> DataFrame:
    """Every other table of the evaluation store, by its own key; logs keep a document id that an update lacks."""
    events, out = _events(spark, d), None
    for table in _UPSERTED:
        keys = evaluation.TABLE_KEYS[table]
        columns = [F.expr(_KEY_OF[k]).alias(k) for k in keys]
        shown = {_KEY_OF[k]: k for k in reversed(keys)}
        order = list(dict.fromkeys(_KEY_OF[k] for k in keys))
        old = events.filter(F.col("user_id") % 2 == 0).select(
            *columns, F.lit("old").alias("document_id"), F.lit(-1.0).alias("value")
        ).distinct()
        new = events.filter(F.col("user_id") % 3 == 0).select(
            *columns, F.expr("CASE WHEN event_id % 3 = 0 THEN concat('new', event_id) END").alias("document_id"), "value",
            F.col("event_id").alias("_event"),
        )
        rows = evaluation.upsert(old, new, keys, evaluation.KEEP_IF_NULL.get(table, ()), F.col("_event")).select(
            F.lit(table).alias("part"),
            F.concat_ws("/", *[F.col(shown[c]).cast("string") for c in order]).alias("key"), "document_id", "value",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _qrels_lines(spark, d) -> DataFrame:
    """Judgement lines per event with every form of relevance; every fifth user is unknown."""
    event = F.col("event_id")
    forms = F.array(*[F.lit(x) for x in ("3", "-2", "high", "0")], F.lit(None).cast("string"))
    return _events(spark, d).select(
        F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("query_id"),
        F.when(event % 11 != 0, F.concat(event.cast("string"), F.lit(":0"))).alias("chunk_id"),
        forms[(event % 5).cast("int")].alias("relevance"),
    )


def _known(spark, d) -> DataFrame:
    return _events(spark, d).select("user_id").distinct().filter(F.col("user_id") % 5 != 0).select(
        F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("query_id"), F.col("user_id").alias("query_pk")
    )


@query(
    "parse_qrels",
    """SELECT user_id AS query_pk, event_id || ':0' AS chunk_id, [3, 0, 1, 0, 1][1 + event_id % 5]::BIGINT AS relevance
FROM events WHERE user_id % 5 <> 0 AND event_id % 11 <> 0""",
)
def parse_qrels(spark, d) -> DataFrame:
    qrels, _ = evaluation.parse_qrels(_qrels_lines(spark, d), _known(spark, d))
    return qrels.select("query_pk", "chunk_id", F.col("relevance").cast("long").alias("relevance"))


@query(
    "parse_qrels_rejects",
    "SELECT 'q' || user_id AS query_id, count(*) AS n FROM events WHERE user_id % 5 = 0 GROUP BY 1",
)
def parse_qrels_rejects(spark, d) -> DataFrame:
    _, rejects = evaluation.parse_qrels(_qrels_lines(spark, d), _known(spark, d))
    return rejects.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "audit_tables",
    """SELECT 'chunks' AS "table", TRUE AS exists, count(*) AS n_rows FROM documents
UNION ALL SELECT 'scores', TRUE, count(*) FROM events UNION ALL SELECT 'runs', FALSE, 0""",
)
def audit_tables(spark, d) -> DataFrame:
    present = {"chunks": data.table(spark, d, "documents"), "scores": _events(spark, d)}
    return tables.audit_tables(spark, present, ["chunks", "scores", "runs"])


# ---- files ---------------------------------------------------------------------------------------------------------


def _lines_file(spark, rows: DataFrame) -> str:
    """Write a text column as lines; a text may hold several lines, which stay together."""
    path = work_path(spark)
    rows.write.text(path)
    return path


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))


def _read_queries(spark, d) -> DataFrame:
    """Benchmark texts as query lines: a first version of each, a blank line, and the final one."""
    n = F.col("item_id")
    query_id = F.concat(F.lit("q"), n.cast("string"))
    old = _json(query_id=query_id, text=F.lit("old"))
    new = _json(
        query_id=query_id, text=F.col("text"), roles=F.array(F.lit("r")), process_name=F.when(n % 3 == 0, "P"),
        query_type=F.when(n % 2 == 0, "structure"),
    )
    lines = data.table(spark, d, "benchmark").select(F.concat_ws("\n", old, F.lit(""), new))
    return evaluation.read_queries(spark, _lines_file(spark, lines), "demo")


@query(
    "read_queries",
    """SELECT 'demo' AS dataset, 'q' || item_id AS query_id, md5(text) AS text, CASE WHEN item_id % 3 = 0 THEN 'P' END AS process_name,
  'r' AS roles, CASE WHEN item_id % 2 = 0 THEN 'structure' ELSE 'mixed' END AS query_type, 'both' AS expected_source
FROM benchmark""",
)
def read_queries(spark, d) -> DataFrame:
    return _read_queries(spark, d).select(
        "dataset", "query_id", F.md5("text").alias("text"), "process_name", F.array_join("roles", ",").alias("roles"),
        "query_type", "expected_source",
    )


def _qrels_path(spark, d) -> str:
    """Per text: an empty gating, a graded line with gating, a second one with other gating, relevances of every kind,
    one of an unknown query.
    """
    n = F.col("item_id")
    query_id = F.concat(F.lit("q"), n.cast("string"))
    gating = lambda lane: F.struct(F.array(lane).alias("expected_lane_ids"))
    nothing = F.struct(F.lit(None).cast("array<string>").alias("expected_lane_ids"))
    lines = F.concat_ws(
        "\n",
        _json(query_id=query_id, chunk_id=F.lit("d"), relevance=F.lit(2.7), gating=nothing),
        _json(query_id=query_id, chunk_id=F.lit("e"), relevance=F.lit("2.7")),
        _json(query_id=query_id, chunk_id=F.lit("f"), relevance=F.lit(2.0)),
        _json(query_id=query_id, chunk_id=F.lit("g"), relevance=F.lit("2")),
        _json(query_id=query_id, chunk_id=F.lit("a"), relevance=n % 4, gating=gating(F.concat(F.lit("L"), query_id))),
        _json(query_id=query_id, chunk_id=F.lit("b"), relevance=F.lit("much"), gating=gating(F.lit("late"))),
        _json(query_id=query_id, chunk_id=F.lit("c"), relevance=F.lit(-1)),
        _json(query_id=F.concat(F.lit("x"), query_id), chunk_id=F.lit("a"), relevance=F.lit(2)),
    )
    return _lines_file(spark, data.table(spark, d, "benchmark").select(lines))


@query(
    "read_qrels",
    """SELECT 'q' || item_id AS query_id, unnest(['a', 'b', 'c', 'd', 'e', 'f', 'g']) AS chunk_id,
  unnest([item_id % 4, 1, 0, 2, 1, 2, 2])::BIGINT AS relevance,
  'semantic' AS qrels_version FROM benchmark
UNION ALL SELECT 'xq' || item_id, 'a', 2, 'rejected' FROM benchmark""",
)
def read_qrels(spark, d) -> DataFrame:
    known = cut_lineage(_read_queries(spark, d))
    qrels, rejects = evaluation.read_qrels(spark, _qrels_path(spark, d), known, "semantic")
    kept = qrels.join(known.select("query_pk", "query_id"), "query_pk").select(
        "query_id", "chunk_id", F.col("relevance").cast("long").alias("relevance"), "qrels_version"
    )
    return kept.unionByName(rejects.select(
        "query_id", "chunk_id", F.expr("variant_get(relevance, '$', 'bigint')").alias("relevance"),
        F.lit("rejected").alias("qrels_version"),
    ))


@query(
    "read_gold_gating",
    """SELECT 'q' || item_id AS query_id, 'Lq' || item_id AS expected_lane_ids, '' AS expected_task_names FROM benchmark""",
)
def read_gold_gating(spark, d) -> DataFrame:
    known = cut_lineage(_read_queries(spark, d))
    gold = evaluation.read_gold_gating(spark, _qrels_path(spark, d), known)
    return gold.join(known.select("query_pk", "query_id"), "query_pk").select(
        "query_id", *[F.array_join(c, ",").alias(c) for c in ("expected_lane_ids", "expected_task_names")]
    )


@query(
    "read_answers",
    """SELECT 'q' || item_id AS query_id, md5(CASE WHEN item_id % 4 = 0 THEN '' ELSE text END) AS answers, 'e' AS explanation
FROM benchmark""",
)
def read_answers(spark, d) -> DataFrame:
    known = cut_lineage(_read_queries(spark, d))
    n = F.col("item_id")
    query_id = F.concat(F.lit("q"), n.cast("string"))
    answers = F.when(n % 4 != 0, F.array("text"))
    lines = F.concat_ws(
        "\n",
        _json(query_id=query_id, answers=F.array(F.lit("old"))),
        _json(query_id=query_id, answers=answers, explanation=F.lit("e")),
        _json(query_id=F.concat(F.lit("x"), query_id), answers=answers),
    )
    path = _lines_file(spark, data.table(spark, d, "benchmark").select(lines))
    rows = evaluation.read_answers(spark, path, known).join(known.select("query_pk", "query_id"), "query_pk")
    return rows.select("query_id", F.md5(F.array_join("answers", "|")).alias("answers"), "explanation")


TURNS_PER_FILE = 1_000


def _model_files(spark, d) -> DataFrame:
    """A process model per conversation and thousand turns; every seventh conversation has a wrong root."""
    turn = data.turns(spark, d)
    key = F.concat_ws("_", "conv_id", F.floor(F.col("turn") / TURNS_PER_FILE))
    n, turn_key = F.col("turn").cast("string"), F.concat_ws(":", "conv_id", "turn")
    tag = F.when(F.col("turn") % 3 == 0, "exclusiveGateway").otherwise("userTask")
    node = F.concat(F.lit("<"), tag, F.lit(' id="'), turn_key, F.lit('" name="'), F.col("role"), F.lit('"/>'))
    following = F.concat_ws(":", F.col("conv_id"), F.col("turn") + 1)
    flow = F.concat(
        F.lit('<b:sequenceFlow id="f'), turn_key, F.lit('" sourceRef="'), turn_key, F.lit('" targetRef="'), following,
        F.lit('"><b:conditionExpression> if '), n, F.lit(" </b:conditionExpression></b:sequenceFlow>"),
    )
    member = F.concat(
        F.lit('<b:lane id="'), turn_key, F.lit('L" name="'), F.col("role"), F.lit('"><b:flowNodeRef>'), turn_key,
        F.lit("</b:flowNodeRef></b:lane>"),
    )
    parts = turn.groupBy(key.alias("file"), F.col("conv_id")).agg(
        F.array_join(F.sort_array(F.collect_list(F.concat(node, flow, member))), "").alias("body")
    )
    root = F.when(F.col("conv_id") % 7 == 0, "b:other").otherwise("b:definitions")
    return parts.select(
        "file",
        F.concat(
            F.lit("<"), root, F.lit(' xmlns:b="urn:x" xmlns="urn:y" id="D'), F.col("file"), F.lit('"><b:process id="P'),
            F.col("file"), F.lit('">'), F.col("body"), F.lit('</b:process><b:collaboration id="C"><b:participant id="X'),
            F.col("file"), F.lit('" processRef="P'), F.col("file"), F.lit('"/></b:collaboration></'), root, F.lit(">"),
        ).alias("xml"),
    )


@query(
    "read_process_models",
    """WITH m AS (SELECT *, conv_id || '_' || turn // 1000 AS file, conv_id || ':' || turn AS k FROM conversations),
ok AS (SELECT * FROM m WHERE conv_id % 7 <> 0)
SELECT DISTINCT 'definitions' AS part, 'D' || file AS id, file AS a, '' AS b FROM ok
UNION ALL SELECT DISTINCT 'processes', 'P' || file, 'D' || file, '' FROM ok
UNION ALL SELECT 'nodes', k, role, CASE WHEN turn % 3 = 0 THEN 'exclusiveGateway' ELSE 'userTask' END FROM ok
UNION ALL SELECT 'flows', 'f' || a.k, b.k, 'if ' || a.turn FROM ok a JOIN ok b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
UNION ALL SELECT 'lanes', k || 'L', role, 'P' || file FROM ok
UNION ALL SELECT 'lane_members', k || 'L', k, '' FROM ok
UNION ALL SELECT DISTINCT 'participants', 'X' || file, 'P' || file, 'D' || file FROM ok
UNION ALL SELECT DISTINCT 'rejects', file, 'missing definitions root', '' FROM m WHERE conv_id % 7 = 0""",
)
def read_process_models(spark, d) -> DataFrame:
    g = process_models.parse_process_models(_model_files(spark, d))
    shape = {
        "definitions": ("definition_id", "filename", F.lit("")),
        "processes": ("process_id", "definition_id", F.lit("")),
        "nodes": ("node_id", "name", F.col("type")),
        "flows": ("flow_id", "target_id", F.col("condition")),
        "lanes": ("lane_id", "name", F.col("process_id")),
        "lane_members": ("lane_id", "node_id", F.lit("")),
        "participants": ("participant_id", "process_id", F.col("definition_id")),
        "rejects": ("file", "error", F.lit("")),
    }
    result = None
    for name, (key, first, second) in shape.items():
        rows = g[name].select(F.lit(name).alias("part"), F.col(key).alias("id"), F.col(first).alias("a"), second.alias("b"))
        result = rows if result is None else result.unionByName(rows)
    return result


def _chunk_counts(name: str, swaps: dict[str, str]) -> str:
    """Chunks per document by the SQL of a chunking query, with the sizes that uploads use."""
    text = registry.ORACLES[name]
    for old, new in swaps.items():
        assert old in text
        text = text.replace(old, new)
    return f"SELECT document_id, '{name.removeprefix('chunk_')}' AS strategy, count(*) AS chunks FROM ({text}) GROUP BY 1"


@query(
    "upload_outcomes",
    f"""WITH e AS (SELECT doc_id, ['by_title', 'semantic', 'sentences', 'by_title'][1 + doc_id % 4] AS strategy,
  doc_id % 10 = 9 AS missing FROM documents),
c AS (SELECT * FROM ({_chunk_counts("chunk_by_title", {"> 500": "> 1800", "> 300": "> 1350", "* 420, 500": "* 1575, 1800",
  "- 80) / 420.0": "- 225) / 1575.0"})})
  UNION ALL SELECT * FROM ({_chunk_counts("chunk_semantic", {"> 600": "> 2400"})})
  UNION ALL SELECT * FROM ({_chunk_counts("chunk_sentences", {"* 500, 500": "* 2400, 2400", "* 500 <": "* 2400 <"})}))
SELECT doc_id AS document_id, CASE WHEN missing THEN 'failed' ELSE 'indexed' END AS outcome,
  CASE WHEN missing THEN 'Upload file missing: f' || doc_id ELSE replace(e.strategy, 'sentences', 'sentence_semantic') END AS detail,
  CASE WHEN NOT missing THEN coalesce(chunks, 0) END::BIGINT AS chunks
FROM e LEFT JOIN c ON c.document_id = doc_id AND c.strategy = e.strategy""",
)
def upload_outcomes(spark, d) -> DataFrame:
    doc = F.col("doc_id")
    path = lambda c: F.concat(F.lit("f"), c.cast("string"))
    names = F.array(*[F.lit(x) for x in ("by_title", "semantic", "sentence_semantic", "else")])
    events = data.table(spark, d, "documents").select(
        doc.alias("document_id"), path(doc).alias("path"), F.lit("P").alias("process_name"), F.lit("").alias("tags"),
        F.lit("f").alias("file_name"), names[(doc % 4).cast("int")].alias("chunking_strategy"),
    )
    parsed = prepare_elements(data.elements(spark, d).filter(F.col("document_id") % 10 != 9))
    embedded = data.with_embeddings(parsed, spark, d).withColumn("path", path(F.col("document_id")))
    read = ["path", "pos", "element_type", "text", "page", "section_title", "table_html", "embedding"]
    _, indexed, failed = ingest.chunk_events(events, embedded.select(*read))
    return indexed.select(
        "document_id", F.lit("indexed").alias("outcome"), F.col("chunking_strategy").alias("detail"), "chunks"
    ).unionByName(failed.select(
        "document_id", F.lit("failed").alias("outcome"), F.col("error").alias("detail"), F.lit(None).cast("long").alias("chunks")
    ))
