"""JSON lines, upserts, process-model files, exports, audits, streaming."""

import json
import time

import pytest
from pyspark.sql import functions as F

from ragloom.functions.scale import SHUFFLE_CLEANUP, cut_lineage
from ragloom.operators import gating, graph, statistics
from ragloom.sources import evaluation, process_models, tables
from ragloom.streaming import ingest


def _write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines))
    return str(path)


@pytest.fixture()
def queries(spark, tmp_path):
    path = _write(tmp_path / "queries.jsonl", [
        {"query_id": "q1", "text": "first"},
        "",
        {"query_id": "q2", "text": "ä", "roles": ["R"], "query_type": "structure"},
        {"query_id": "q1", "text": "second", "process_name": "P"},
    ])
    return evaluation.read_queries(spark, path, "demo")


def test_queries(queries):
    rows = {r["query_id"]: r for r in queries.collect()}
    assert set(rows) == {"q1", "q2"}
    assert rows["q1"]["text"] == "second" and rows["q1"]["query_type"] == "mixed"
    assert rows["q1"]["expected_source"] == "both" and rows["q2"]["query_type"] == "structure"
    assert rows["q1"]["query_pk"] != rows["q2"]["query_pk"]


def test_qrels_gating_and_answers(spark, tmp_path, queries):
    path = _write(tmp_path / "qrels.jsonl", [
        {"query_id": "q1", "chunk_id": "a", "relevance": 3, "gating": {"expected_lane_ids": ["L"]}},
        {"query_id": "q1", "chunk_id": "b", "relevance": "x", "gating": {"expected_lane_ids": ["M"]}},
        {"query_id": "q1", "chunk_id": "c", "relevance": -4},
        {"query_id": "q1", "chunk_id": "d"},
        {"query_id": "q2"},
        {"query_id": "nobody", "chunk_id": "a", "relevance": 1},
    ])
    qrels, rejects = evaluation.read_qrels(spark, path, queries, "semantic")
    assert {r["chunk_id"]: r["relevance"] for r in qrels.collect()} == {"a": 3, "b": 1, "c": 0, "d": 1}
    assert [r["query_id"] for r in rejects.collect()] == ["nobody"]
    (gold,) = evaluation.read_gold_gating(spark, path, queries).collect()
    assert gold["expected_lane_ids"] == ["L"] and gold["expected_node_ids"] == []
    path = _write(tmp_path / "answers.jsonl", [
        {"query_id": "q2", "answers": ["x", "y"]}, {"query_id": "q1"}, {"query_id": "nobody", "answers": ["z"]},
    ])
    answers = sorted(r["answers"] for r in evaluation.read_answers(spark, path, queries).collect())
    assert answers == [[], ["x", "y"]]


def test_upsert_keeps_document_id_when_null(spark):
    fields = "query_pk long, chunk_id string, document_id string, relevance int, qrels_version string"
    old = spark.createDataFrame([(1, "a", "d1", 1, "v"), (2, "b", "d2", 2, "v")], fields)
    new = spark.createDataFrame([(1, "a", None, 3, "v"), (3, "c", "d3", 1, "v"), (1, "a", None, 2, "v")], fields)
    rows = evaluation.upsert(old, new, evaluation.TABLE_KEYS["qrels"], ["document_id"], F.col("relevance"))
    assert sorted(map(tuple, rows.collect())) == [
        (1, "a", "d1", 3, "v"), (2, "b", "d2", 2, "v"), (3, "c", "d3", 1, "v")
    ]


HEAD = (
    '<bpmn:definitions xmlns:bpmn="http://www.omg.org/spec/BPMN/20100524/MODEL" id="{id}" name="N" '
    'targetNamespace="urn:{id}">'
)

LANED = HEAD.format(id="D1") + """
<bpmn:collaboration id="c"><bpmn:participant id="pool" processRef="P1"/></bpmn:collaboration>
<bpmn:process id="P1" name="Travel">
 <bpmn:laneSet id="ls"><bpmn:lane id="L1" name="Staff"><bpmn:flowNodeRef> S </bpmn:flowNodeRef>
  <bpmn:flowNodeRef>T1</bpmn:flowNodeRef></bpmn:lane>
  <bpmn:lane id="L2" name=""><bpmn:flowNodeRef>T2</bpmn:flowNodeRef></bpmn:lane></bpmn:laneSet>
 <bpmn:startEvent id="S"/><bpmn:userTask id="T1" name="Ask"/><bpmn:exclusiveGateway id="G" name="Ok?"/>
 <bpmn:userTask id="T2" name="Sign"/><bpmn:endEvent id="E" name="Done"/>
 <bpmn:sequenceFlow id="f1" sourceRef="S" targetRef="T1"/><bpmn:sequenceFlow id="f2" sourceRef="T1" targetRef="G"/>
 <bpmn:sequenceFlow id="f3" name="no" sourceRef="G" targetRef="T1"/>
 <bpmn:sequenceFlow id="f4" sourceRef="G" targetRef="T2"><bpmn:conditionExpression> ok </bpmn:conditionExpression>
 </bpmn:sequenceFlow>
 <bpmn:sequenceFlow id="f5" sourceRef="T2" targetRef="E"/><bpmn:sequenceFlow id="f6" sourceRef="T2"/>
 <bpmn:sequenceFlow id="f7" sourceRef="T2" targetRef="missing"/>
</bpmn:process><BPMNDiagram xmlns="x"/></bpmn:definitions>"""
LANELESS = HEAD.format(id="D2") + '<process xmlns="y" id="P2"><task id="A"/><task id="B"/></process></bpmn:definitions>'


@pytest.fixture(scope="module")
def models(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("models")
    for name, xml in {
        "a.bpmn": LANED, "b.bpmn": LANELESS, "root.bpmn": "<other/>", "empty.bpmn": HEAD.format(id="x") + "</bpmn:definitions>",
        "bad.bpmn": "<a", "entity.bpmn": "<!DOCTYPE a><a/>",
    }.items():
        (folder / name).write_text(xml)
    return process_models.read_process_models(spark, str(folder))


def test_process_models(models):
    rejected = {r["file"].rsplit("/", 1)[1] for r in models["rejects"].collect()}
    assert rejected == {"root.bpmn", "empty.bpmn", "bad.bpmn", "entity.bpmn"}
    assert {(r["definition_id"], r["has_diagram"]) for r in models["definitions"].collect()} == {("D1", True), ("D2", False)}
    sources = {r["definition_id"]: (r["target_namespace"], r["xml"]) for r in models["definitions"].collect()}
    assert sources == {"D1": ("urn:D1", LANED), "D2": ("urn:D2", LANELESS)}
    assert {r["node_id"] for r in models["nodes"].collect()} == {"S", "T1", "G", "T2", "E", "A", "B"}
    flows = {r["flow_id"]: (r["condition"], r["name"]) for r in models["flows"].collect()}
    assert set(flows) == {"f1", "f2", "f3", "f4", "f5"} and flows["f4"] == ("ok", None) and flows["f3"] == (None, "no")
    assert {tuple(r) for r in models["lane_members"].select("lane_id", "node_id").collect()} == {
        ("L1", "S"), ("L1", "T1"), ("L2", "T2")
    }
    assert models["participants"].count() == 1


def test_rules_and_positions_of_a_cyclic_model(spark, models):
    rules = gating.default_whitelist(models)
    headers = {(r["lane_id"], r["role"], r["n_nodes"]) for r in gating.list_rules(rules).collect()}
    assert headers == {("L1", "Staff", 2), ("L2", None, 1), ("*", None, 2)}
    near = graph.neighbourhood(models, spark.createDataFrame([("P1", "T1")], "process_id string, node_id string"), 3)
    reached = {(r["side"], r["node_id"]): r["hops"] for r in near.collect()}
    assert reached["successor", "T1"] == 2 and reached["successor", "E"] == 3 and reached["predecessor", "S"] == 1
    requests = spark.createDataFrame(
        [("r1", "P1", "D1", "T1", "Travel", ["Staff"]), ("r2", "P1", "D1", "T1", "Travel", []),
         ("r3", "P1", "D1", "nowhere", "Travel", ["Staff"])],
        "request_id string, process_id string, definition_id string, current_node_id string, process_name string, "
        "roles array<string>",
    )
    gated = gating.gate_positions(requests, models, rules)
    branches = {(r["request_id"], r["node_id"]) for r in gated.view.branches.collect()}
    assert branches == {("r1", "T1"), ("r2", "T1"), ("r2", "T2")}
    hints = {r["request_id"]: r["hint"] for r in gating.gating_hint(gated).collect()}
    assert "    - Falls 'no': → Ask" in hints["r1"] and "Sign" not in hints["r1"]
    assert "    - Falls 'ok': → Sign" in hints["r2"] and hints["r2"].startswith("Kontext: Prozess 'Travel'.")
    assert hints["r1"].endswith(gating.ROLE_TAIL) and not hints["r2"].endswith(gating.ROLE_TAIL)
    assert "Aktueller" not in hints["r3"]
    meta = {r["request_id"]: r for r in gating.gating_metadata(gated).collect()}
    assert meta["r1"]["num_gateways"] == 1 and meta["r3"]["num_successors"] == 0


def test_definition_without_process_counts_zero(spark, models):
    more = spark.createDataFrame([("D9", "zz", "z.bpmn", False, None, None)], models["definitions"].schema)
    rows = graph.list_definitions({**models, "definitions": models["definitions"].unionByName(more)}).collect()
    assert {r["definition_id"]: r["process_count"] for r in rows} == {"D1": 1, "D2": 1, "D9": 0}


def test_paths_do_not_reuse_edges(spark, models):
    allowed = spark.createDataFrame([("P1", "node", "T1")], "process_id string, kind string, id string")
    start = spark.createDataFrame([("r", "P1", "T1")], "request_id string, process_id string, node_id string")
    rows = gating.next_allowed(models, allowed, start, 5).collect()
    assert [(r["node_id"], r["hops"]) for r in rows] == [("T1", 2)]


def _plain_paths(flows, start, depth):
    ends, paths = [], [(start, ())]
    for hop in range(1, depth + 1):
        paths = [(to, used + (f,)) for at, used in paths for f, source, to in flows if source == at and f not in used]
        ends += [(node, hop) for node, _ in paths]
    return ends


def test_next_allowed_on_a_cyclic_graph_with_a_hub(spark):
    """Hub H leads to 400 dead ends; only the cycles through A, B and T come back to an allowed node."""
    flows = [("f1", "A", "H"), ("f2", "H", "A"), ("f3", "H", "B"), ("f4", "B", "T"), ("f5", "T", "A"), ("f6", "B", "B"),
             ("f7", "T", "G")]
    flows += [(f"d{i}", "H", f"D{i}") for i in range(400)] + [(f"e{i}", f"D{i}", f"D{i + 1}") for i in range(399)]
    names = sorted({n for _, a, b in flows for n in (a, b)})
    own = spark.createDataFrame([("P", n, n.lower(), "gate" if n == "G" else "task") for n in names],
                                "process_id string, node_id string, name string, type string")
    edges = spark.createDataFrame([(f, "P", a, b) for f, a, b in flows],
                                  "flow_id string, process_id string, source_id string, target_id string")
    allowed = spark.createDataFrame([("P", "node", "T"), ("P", "node", "A"), ("P", "node", "G"), ("P", "type", "task")],
                                    "process_id string, kind string, id string")
    starts = spark.createDataFrame([(n, "P", n) for n in ("A", "H", "D0", "T")],
                                   "request_id string, process_id string, node_id string")
    models = {"nodes": own, "flows": edges}
    for depth in (1, 4):
        rows = gating.next_allowed(models, allowed, starts, depth).collect()
        expected = [(s, n, h) for s in ("A", "H", "D0", "T") for n, h in _plain_paths(flows, s, depth) if n in ("T", "A")]
        assert sorted((r["request_id"], r["node_id"], r["hops"]) for r in rows) == sorted(expected)
    # No edge into a dead end is followed.
    targets = own.filter("node_id IN ('T', 'A')")
    kept = {r["flow_id"] for r in gating._moves_to(targets, edges, 4).collect()}
    assert kept == {"f1", "f2", "f3", "f4", "f5", "f6"}


def test_exports(spark, tmp_path):
    samples = spark.createDataFrame([("s1", "q", "a", ["c1", "c2"])],
                                    "query_id string, query string, reference_answer string, reference_chunk_ids array<string>")
    evaluation.write_testset(samples, str(tmp_path))
    stored = evaluation.read_queries(spark, f"{tmp_path}/synthetic_queries.jsonl", "synthetic")
    qrels, _ = evaluation.read_qrels(spark, f"{tmp_path}/synthetic_qrels_semantic.jsonl", stored, "semantic")
    assert {(r["chunk_id"], r["relevance"]) for r in qrels.collect()} == {("c1", 3), ("c2", 3)}
    scores = spark.createDataFrame([("a", "m", 1.0), ("a", "m", 2.0), ("b", "m", 4.0)], "run string, metric string, value double")
    agg = statistics.aggregate_runs(scores, ["m", "none"])
    tables.write_run_csv(agg.filter("run = 'a'"), f"{tmp_path}/run", agg.filter("run = 'b'"))
    rows = spark.read.csv(f"{tmp_path}/run", header=True).collect()
    assert [r["metric"] for r in rows] == ["m", "none"]
    assert rows[0]["mean"] == "1.500000" and rows[0]["delta"] == "-2.500000" and rows[1]["n"] == "0"
    tables.write_study_csv(agg.withColumnRenamed("run", "run_name"), f"{tmp_path}/study", "a", ["m", "none"])
    rows = spark.read.csv(f"{tmp_path}/study", header=True).collect()
    assert [(r["run_name"], r["is_baseline"], r["m"]) for r in rows] == [("a", "true", "1.500000"), ("b", "false", "4.000000")]


def test_uploads_are_prepared_once(spark, monkeypatch):
    words = " ".join(["word"] * 60)
    elements = spark.createDataFrame(
        [(p, i, "Title" if i == 0 else "Text", f"{p} {i} {words}", 1, None, None, [float(i), 1.0, float(i * i)])
         for p in ("f1", "f2", "f3", "other") for i in range(6)],
        "path string, pos int, element_type string, text string, page int, section_title string, table_html string, "
        "embedding array<float>",
    )
    events = spark.createDataFrame(
        [("d1", "f1", "by_title"), ("d2", "f2", "semantic"), ("d3", "f3", "sentence_semantic"), ("d4", "f1", "semantic"),
         ("d5", "gone", "by_title"), ("d1", None, "by_title"), (None, "f2", "by_title")],
        "document_id string, path string, chunking_strategy string",
    ).selectExpr("*", "'P' AS process_name", "'' AS tags", "'f' AS file_name")
    prepare, given, dropped = ingest.prepare_elements, [], []
    drop = ingest.drop_work
    monkeypatch.setattr(ingest, "prepare_elements", lambda rows: given.append(rows) or prepare(rows))
    monkeypatch.setattr(ingest, "drop_work", lambda session, path: dropped.append(path) or drop(session, path))
    chunks, indexed, failed = ingest.chunk_events(events, elements)
    # One table of elements for all strategies, with the vectors of those that read them.
    assert len(given) == 1 and "other" not in str(given[0].select("text").collect())
    vectors = given[0].groupBy("chunking_strategy").agg(F.count("embedding").alias("n"))
    assert {r[0]: r[1] for r in vectors.collect()} == {"by_title": 0, "semantic": 12, "sentence_semantic": 6}
    assert len(dropped) == 4  # the elements, and the chunks of each strategy before they were numbered
    counts = {r["document_id"]: r["count"] for r in chunks.groupBy("document_id").count().collect()}
    rows = {r["document_id"]: (r["chunking_strategy"], r["chunks"]) for r in indexed.collect()}
    assert {k: rows[k][0] for k in rows if k} == {"d1": "by_title", "d2": "semantic", "d3": "sentence_semantic", "d4": "semantic"}
    assert all(rows[k][1] == counts[k] > 0 for k in ("d1", "d2", "d3", "d4"))
    assert sorted(r["error"] for r in failed.collect()) == ["Upload file missing: ", "Upload file missing: gone"]


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x for x in disk.getAllBlocks().mkString("\n").splitlines() if x.startswith("shuffle")}
    before = shuffles()
    stored = cut_lineage(spark.range(1_000).repartition(5).withColumn("part", F.col("id") % 2), "part")
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.2)
    assert shuffles() <= before
    assert spark.conf.get(SHUFFLE_CLEANUP, None) is None
    assert stored.columns == ["id", "part"] and stored.filter("part = 1").count() == 500


def test_upload_stream(spark, tmp_path):
    words = " ".join(["word"] * 60)
    elements = spark.createDataFrame(
        [(p, i, "Title" if i == 0 else "Text", f"{p} {i} {words}", 1, None, None, [float(i), 1.0, float(i * i)])
         for p in ("f1", "f2", "f3") for i in range(6)],
        "path string, pos int, element_type string, text string, page int, section_title string, table_html string, "
        "embedding array<float>",
    )
    events = tmp_path / "events"
    events.mkdir()

    def upload(number, strategy, path):
        event = {"document_id": f"doc{number}", "path": path, "process_name": "P", "tags": "", "chunking_strategy": strategy}
        (events / f"{number}.json").write_text(json.dumps(event))

    for number, (strategy, path) in enumerate(
        [("by_title", "f1"), ("semantic", "f2"), ("sentence_semantic", "f3"), ("unknown", "f1"), ("by_title", "gone")]
    ):
        upload(number, strategy, path)
    output, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    ingest.ingest_stream(spark, str(events), elements, output, checkpoint).awaitTermination(300)
    upload(9, "by_title", "f2")
    ingest.ingest_stream(spark, str(events), elements, output, checkpoint).awaitTermination(300)
    indexed = {r["document_id"]: r for r in spark.read.parquet(f"{output}/indexed").collect()}
    assert set(indexed) == {"doc0", "doc1", "doc2", "doc3", "doc9"}
    assert indexed["doc3"]["chunking_strategy"] == "by_title" and indexed["doc1"]["chunking_strategy"] == "semantic"
    failed = spark.read.parquet(f"{output}/failed").collect()
    assert [(r["document_id"], r["error"]) for r in failed] == [("doc4", "Upload file missing: gone")]
    chunks = ingest.latest_chunks(spark, output)
    counts = {r["document_id"]: r["count"] for r in chunks.groupBy("document_id").count().collect()}
    assert counts == {k: r["chunks"] for k, r in indexed.items()}
    first = chunks.filter("chunk_id = 'doc0:0'").first()
    assert first["process_name"] == "P" and first["tags"] is None and first["text"].startswith("f1 0 word")
