"""The library's input tables derived from the given parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions.scale import cut_lineage, fits_broadcast, spread


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, directory: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that several queries read: written once per application to the checkpoint folder."""
    key = (spark.sparkContext.applicationId, directory, name)
    if key not in _STORED:
        _STORED[key] = cut_lineage(build())
    return _STORED[key]


def clear_stored() -> None:
    """Forget the stored tables, so that the next query derives them anew from its inputs."""
    _STORED.clear()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{directory}/{name}.parquet")
    return spread(rows) if name in ("documents", "conversations", "embeddings") else rows


def chunks(spark: SparkSession, directory: str) -> DataFrame:
    """One chunk per document; the process is its source, the tag its language."""
    return table(spark, directory, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("chunk_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.lit(0).alias("pos"),
        "text",
        F.col("source").alias("process_name"),
        F.col("lang").alias("tags"),
        F.concat(F.col("source"), F.lit(".pdf")).alias("file_name"),
        F.lit(None).cast("string").alias("page_number"),
        F.lit(None).cast("string").alias("section_title"),
        F.lit("NarrativeText").alias("element_type"),
    )


def queries(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "benchmark").select(
        F.col("item_id").alias("query_pk"), F.col("item_id").cast("string").alias("query_id"), "text"
    )


def elements(spark: SparkSession, directory: str) -> DataFrame:
    """The lines of each document, as elements without embedding."""
    return (
        table(spark, directory, "documents")
        .select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        .withColumn("element_type", F.when((F.length("text") < 30), "Title").otherwise("NarrativeText"))
        .withColumn("page", (F.floor(F.col("pos") / 5) + 1).cast("int"))
        .withColumn("section_title", F.when(F.col("element_type") == "Title", F.col("text")))
        .withColumn("table_html", F.lit(None).cast("string"))
    )


def with_embeddings(prepared: DataFrame, spark: SparkSession, directory: str) -> DataFrame:
    """Give prepared elements the vector whose id is (document_id + idx) modulo the number of vectors."""
    vectors = table(spark, directory, "embeddings")
    count = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    keyed = prepared.withColumn("vec_id", (F.col("document_id") + F.col("idx")) % count)
    return keyed.join(vectors.select("vec_id", "embedding"), "vec_id").drop("vec_id")


def vectors(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def query_vectors(spark: SparkSession, directory: str) -> DataFrame:
    """The vector of each benchmark text: text n uses vector n."""
    items = table(spark, directory, "benchmark").select(F.col("item_id").alias("vec_id"))
    return table(spark, directory, "embeddings").join(items, "vec_id", "left_semi").select(
        F.col("vec_id").alias("query_pk"), "embedding", "label"
    )


def chunk_vectors(spark: SparkSession, directory: str) -> DataFrame:
    """A vector for every document's chunk: document n uses vector n modulo the number of vectors."""
    return _vector_of(spark, directory, table(spark, directory, "documents").select("doc_id"), "doc_id").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("chunk_id"), "embedding", "label"
    )


def text_queries(spark: SparkSession, directory: str) -> DataFrame:
    """The benchmark texts, each with a vector chosen like those of the chunks."""
    found = _vector_of(spark, directory, queries(spark, directory), "query_pk")
    return found.select("query_pk", "query_id", "text", "embedding")


def _vector_of(spark: SparkSession, directory: str, rows: DataFrame, key: str) -> DataFrame:
    vectors = table(spark, directory, "embeddings")
    count = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.withColumn("vec_id", F.col(key) % count).join(vectors, "vec_id")


def qrels(spark: SparkSession, directory: str) -> DataFrame:
    """Relevance 3 where a document contains a benchmark text verbatim.

    A contained text brings along its inner words, so documents and texts meet on the text's longest inner word before
    the containment itself is tested. Texts of one or two words have no inner one; they are tested against each document
    while it is read.
    """
    words = F.split("text", r"\s+")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)
    items = table(spark, directory, "benchmark").select(
        F.col("item_id").alias("query_pk"), F.col("text").alias("_item"), longest["w"].alias("_word")
    )
    documents = table(spark, directory, "documents").select("doc_id", "text")
    candidates = (
        documents.select("doc_id", F.explode(F.array_distinct(words)).alias("_word"))
        .join(items, "_word")
        .join(documents, "doc_id")
    )
    short = items.filter(F.col("_word").isNull()).select("query_pk", "_item")
    short = F.broadcast(short) if fits_broadcast(short) else short
    candidates = candidates.select("query_pk", "doc_id", "text", "_item").unionByName(
        documents.join(short, F.contains("text", F.col("_item"))).select("query_pk", "doc_id", "text", "_item")
    )
    return candidates.filter(F.contains("text", F.col("_item"))).select(
        "query_pk",
        F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("chunk_id"),
        F.lit(3).alias("relevance"),
    )


def run_scores(spark: SparkSession, directory: str) -> DataFrame:
    """Mean event value per event type (run) and user (query) as metric 'value'."""
    return (
        table(spark, directory, "events")
        .groupBy(F.col("event_type").alias("run_name"), F.col("user_id").alias("query_pk"))
        .agg(F.round(F.avg("value"), 9).alias("value"))
        .withColumn("metric", F.lit("value"))
    )


def turns(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "conversations")


def process_graph(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """A process per conversation: a node per turn, a lane per role, a branch at every third turn."""
    derived = _derived_graph(spark, directory)
    return {
        name: stored(spark, directory, f"graph-{name}", lambda rows=rows: rows) for name, rows in derived.items()
    }


def _derived_graph(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    turn = turns(spark, directory).select(
        F.concat(F.lit("P"), F.col("conv_id").cast("string")).alias("process_id"),
        F.concat(F.lit("D"), (F.col("conv_id") % 10).cast("string")).alias("definition_id"),
        "turn",
        "role",
    )
    node_id = lambda n: F.concat("process_id", F.lit(":"), n.cast("string"))
    lane_id = F.concat("process_id", F.lit(":"), F.col("role"))
    gateway = F.col("turn") % 3 == 0
    last = turn.groupBy("process_id").agg(F.max("turn").alias("_last"))
    steps = turn.join(last, "process_id").withColumn(
        "jump", F.explode(F.when(gateway, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    ).filter(F.col("turn") + F.col("jump") <= F.col("_last"))
    target = F.col("turn") + F.col("jump")
    # A conversation may open with a system turn that has no lane of its own.
    laned = turn.filter(F.col("role") != "system")
    processes = turn.select("definition_id", "process_id").distinct()
    return {
        "definitions": turn.select("definition_id").distinct().select(
            "definition_id",
            F.concat(F.lit("definition "), "definition_id").alias("name"),
            F.concat("definition_id", F.lit(".bpmn")).alias("filename"),
            F.lit(False).alias("has_diagram"),
        ),
        "processes": processes.withColumn("name", F.concat(F.lit("process "), "process_id")),
        "nodes": turn.select(
            "process_id",
            node_id(F.col("turn")).alias("node_id"),
            F.concat("role", F.lit(" "), F.col("turn").cast("string")).alias("name"),
            F.when(gateway, "exclusiveGateway").otherwise("userTask").alias("type"),
            F.lit(None).cast("string").alias("description"),
        ),
        "flows": steps.select(
            F.concat(node_id(F.col("turn")), F.lit(">"), target.cast("string")).alias("flow_id"),
            "process_id",
            node_id(F.col("turn")).alias("source_id"),
            node_id(target).alias("target_id"),
            F.when(F.col("jump") == 2, F.concat(F.lit("skip "), F.col("turn").cast("string"))).alias("condition"),
            F.when(gateway & (F.col("jump") == 1), "next").alias("name"),
        ),
        "lanes": laned.select("process_id", lane_id.alias("lane_id"), F.col("role").alias("name")).distinct(),
        "lane_members": laned.select(lane_id.alias("lane_id"), node_id(F.col("turn")).alias("node_id")),
        "participants": processes.select(
            F.concat(F.lit("part "), "process_id").alias("participant_id"), "process_id", "definition_id"
        ),
    }


def positions(spark: SparkSession, directory: str) -> DataFrame:
    """A request at every node: the asked role is the node's own, in its process."""
    return turns(spark, directory).select(
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("request_id"),
        F.concat(F.lit("P"), F.col("conv_id").cast("string")).alias("process_id"),
        F.concat(F.lit("D"), (F.col("conv_id") % 10).cast("string")).alias("definition_id"),
        F.concat(F.lit("P"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias(
            "current_node_id"
        ),
        F.concat(F.lit("process P"), F.col("conv_id").cast("string")).alias("process_name"),
        F.array("role").alias("roles"),
    )


# ---- evaluation tables ---------------------------------------------------------------------------------------------

RUN_NAMES = ["click", "error", "purchase", "signup", "view"]
CHUNK_POOL = 50


def retrieval_logs(spark: SparkSession, directory: str) -> DataFrame:
    """A logged hit per event: run by event type, query by user, chunks from a pool of 50, three sources.

    Users divisible by seven only have hits of a source that is not preferred.
    """
    run = F.array_position(F.array(*[F.lit(r) for r in RUN_NAMES]), F.col("event_type")).cast("long")
    source = (
        F.when((F.col("user_id") % 7 == 0) | (F.col("event_id") % 3 == 2), "bm25")
        .when(F.col("event_id") % 3 == 1, "ce").otherwise("rrf")
    )
    return table(spark, directory, "events").select(
        run.alias("run_id"), F.col("user_id").alias("query_pk"), F.col("event_id").alias("rank"),
        source.alias("source"), F.concat((F.col("event_id") % CHUNK_POOL).cast("string"), F.lit(":0")).alias("chunk_id"),
    )


def log_qrels(spark: SparkSession, directory: str) -> DataFrame:
    """Graded gold of the logged queries: every eleventh pool chunk, relevance 0..3 by chunk."""
    event = table(spark, directory, "events")
    users = event.select(F.col("user_id").alias("query_pk")).distinct()
    pool = F.sequence(F.lit(0), F.lit(CHUNK_POOL - 1))
    return (
        users.withColumn("n", F.explode(pool))
        .filter((F.col("query_pk") + F.col("n")) % 11 == 0)
        .select("query_pk", F.concat(F.col("n").cast("string"), F.lit(":0")).alias("chunk_id"),
                (F.col("n") % 4).alias("relevance"))
    )


def answer_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """Assistant turns with the preceding user turn as reference: (conv_id, turn, pred, gold)."""
    turn = turns(spark, directory)
    asked = turn.filter(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("gold")
    )
    return turn.filter(F.col("role") == "assistant").join(asked, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("text").alias("pred"), "gold"
    )


def run_items(spark: SparkSession, directory: str) -> DataFrame:
    """Assistant turns as answers of three runs; they cite two chunks, one of them by object with text."""
    answer = turns(spark, directory).filter(F.col("role") == "assistant")
    n = F.col("turn")
    cited = F.concat(
        F.lit('["'), (n % 5).cast("string"), F.lit(':0", {"id": "'), (F.col("conv_id") % 5).cast("string"), F.lit(':0"'),
        F.when(n % 4 == 1, F.lit(', "text": "t"')).otherwise(F.lit("")), F.lit("}]"),
    )
    hint = F.when(F.col("conv_id") % 2 == 0, F.lit('{"gating_hint": "stay inside"}')).otherwise("{}")
    return answer.select(
        (F.col("conv_id") % 3 + 1).alias("run_id"),
        (F.col("conv_id") * 100 + n).alias("query_pk"),
        F.when(n == 7, "").otherwise(F.col("text")).alias("answer_text"),
        F.when(n == 3, "[]").otherwise(cited).alias("citations"),
        hint.alias("meta"),
    )


def runs(spark: SparkSession) -> DataFrame:
    """Run 1: semantic gold, all judge metrics; run 2: defaults; run 3: no judge."""
    settings = [
        (1, "first", '{"factors": {"chunking": {"strategy": "semantic"}, "evaluation": '
                     '{"llm_metrics": ["consistency", "relevance", "faithfulness", "gray_zone"]}}}'),
        (2, "second", "{}"),
        (3, "third", '{"factors": {"evaluation": {"use_llm_judge": false}}}'),
    ]
    return spark.createDataFrame(settings, "run_id long, name string, config_json string")


def answer_qrels(spark: SparkSession, directory: str) -> DataFrame:
    """Two gold versions for the answered queries."""
    items = run_items(spark, directory).select("query_pk")
    version = F.explode(F.array(F.lit("1800"), F.lit("semantic"))).alias("qrels_version")
    both = items.select("query_pk", version)
    n = F.when(F.col("qrels_version") == "1800", F.col("query_pk") % 5).otherwise((F.col("query_pk") + 1) % 5)
    return both.select(
        "qrels_version", "query_pk", F.concat(n.cast("string"), F.lit(":0")).alias("chunk_id"),
        (1 + F.col("query_pk") % 3).alias("relevance"),
    )


def answer_logs(spark: SparkSession, directory: str) -> DataFrame:
    """Five ranked chunks per item; the first depends on the conversation."""
    rank = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank")
    return run_items(spark, directory).select("run_id", "query_pk", rank).select(
        "run_id", "query_pk", "rank", F.lit("rrf").alias("source"),
        F.concat(((F.floor(F.col("query_pk") / 100) + F.col("rank")) % 5).cast("string"), F.lit(":0")).alias("chunk_id"),
    )


JUDGE_FORMS = [
    'Sure: {"score": 4, "reasoning": "fine"} done',
    '{"score": "2", "reasoning": "r", "hallucinated_steps": ["a", "b"], "mentions_outside_context": ["c"]}',
    "no json at all",
    '{"score": "high"}',
    '{"score": 9, "speculation_detected": "true", "response_type": "qualified_answer"}',
    '{"score": 1, "uncertainty_expressed": true, "response_type": " Clarification "}',
    "{broken: json}",
]
JUDGES = ["consistency", "answer_relevance", "context_relevance", "faithfulness", "gating", "gray_zone"]


def judge_outputs(spark: SparkSession, directory: str) -> DataFrame:
    """A recorded output of every judge for each item, in one of seven forms."""
    forms = F.array(*[F.lit(x) for x in JUDGE_FORMS])
    judge = F.explode(F.array(*[F.lit(j) for j in JUDGES])).alias("judge")
    rows = run_items(spark, directory).select("run_id", "query_pk", judge)
    pick = (F.col("query_pk") + F.length("judge")) % len(JUDGE_FORMS)
    return rows.withColumn("raw", forms[pick.cast("int")])


def pair_vectors(spark: SparkSession, directory: str) -> DataFrame:
    """Vectors of each answer and its reference: those numbered query_pk and query_pk + 1, modulo their number."""
    items = run_items(spark, directory).select("run_id", "query_pk", (F.col("query_pk") + 1).alias("_next"))
    answer = _vector_of(spark, directory, items, "query_pk").select(
        "run_id", "query_pk", "_next", F.col("embedding").alias("answer_vector")
    )
    return _vector_of(spark, directory, answer, "_next").select(
        "run_id", "query_pk", "answer_vector", F.col("embedding").alias("gold_vector")
    )


def gold_answers(spark: SparkSession, directory: str) -> DataFrame:
    return answer_pairs(spark, directory).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_pk"), F.array("gold").alias("answers")
    )
