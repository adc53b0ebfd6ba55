"""BPMN process-model files to graph tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions.scale import cut_lineage

# The BPMN tags that are flow nodes.
NODE_TAGS = [
    "task", "userTask", "serviceTask", "scriptTask", "manualTask", "receiveTask", "sendTask",
    "businessRuleTask", "callActivity", "subProcess", "startEvent", "endEvent", "intermediateCatchEvent",
    "intermediateThrowEvent", "boundaryEvent", "exclusiveGateway", "parallelGateway", "inclusiveGateway",
    "eventBasedGateway",
]

_ELEMENT_SCHEMA = """file string, kind string, definition_id string, process_id string, id string, name string,
type string, source_id string, target_id string, condition string, filename string, has_diagram boolean, target_namespace string,
xml string, error string"""


def _local(tag: object) -> str:
    return str(tag).rsplit("}", 1)[-1]


def _elements(file: str, xml: str) -> Iterator[dict]:
    """Flat rows of one file: definition, process, node, flow, lane, member, participant - or one reject."""
    if "<!DOCTYPE" in xml or "<!ENTITY" in xml:
        yield {"kind": "reject", "error": "document type declarations are not allowed"}
        return
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError as problem:
        yield {"kind": "reject", "error": f"invalid XML: {problem}"}
        return
    inside = list(root.iter())
    processes = [el for el in inside[1:] if _local(el.tag) == "process"]
    if _local(root.tag) != "definitions" or not processes:
        missing = "definitions root" if _local(root.tag) != "definitions" else "process"
        yield {"kind": "reject", "error": f"missing {missing}"}
        return

    def key(el: ElementTree.Element, prefix: str, place: str) -> str:
        return el.get("id") or prefix + hashlib.md5(f"{file}:{place}".encode()).hexdigest()[:10]

    filename = file.rsplit("/", 1)[-1]
    definition = key(root, "defs_", "root")
    yield {
        "kind": "definition",
        "definition_id": definition,
        "name": root.get("name") or filename,
        "filename": filename,
        "has_diagram": any(_local(el.tag) == "BPMNDiagram" for el in inside),
        "target_namespace": root.get("targetNamespace"),
        "xml": xml,
    }
    for place, el in enumerate(inside):
        if _local(el.tag) == "participant" and el.get("processRef"):
            yield {
                "kind": "participant",
                "definition_id": definition,
                "process_id": el.get("processRef"),
                "id": key(el, "part_", f"participant{place}"),
            }
    for number, process in enumerate(processes):
        pid = key(process, "proc_", f"process{number}")
        yield {"kind": "process", "definition_id": definition, "process_id": pid, "name": process.get("name") or ""}
        for place, el in enumerate(process.iter()):
            tag = _local(el.tag)
            row = {"definition_id": definition, "process_id": pid, "name": el.get("name")}
            where = f"{number}.{place}"
            if tag in NODE_TAGS:
                yield {**row, "kind": "node", "id": key(el, "gen_", where), "type": tag, "name": el.get("name") or ""}
            elif tag == "sequenceFlow" and el.get("sourceRef") and el.get("targetRef"):
                texts = [c.text.strip() for c in el if _local(c.tag) == "conditionExpression" and c.text]
                yield {
                    **row,
                    "kind": "flow",
                    "id": key(el, "sf_", where),
                    "source_id": el.get("sourceRef"),
                    "target_id": el.get("targetRef"),
                    "condition": texts[0] if texts else None,
                }
            elif tag == "lane":
                lane = key(el, "lane_", where)
                yield {**row, "kind": "lane", "id": lane, "name": el.get("name") or ""}
                for ref in el.iter():
                    if _local(ref.tag) == "flowNodeRef" and ref.text:
                        yield {**row, "kind": "member", "id": lane, "target_id": ref.text.strip()}


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in _ELEMENT_SCHEMA.split(",")]
    for batch in batches:
        rows = [{**row, "file": f} for f, xml in zip(batch["file"], batch["xml"]) for row in _elements(f, xml)]
        yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)


def parse_process_models(files: DataFrame) -> dict[str, DataFrame]:
    """Graph tables of (file, xml) rows; one small file per row. Rejected files are in `rejects`.

    Each file is parsed once; its elements are stored and all tables read them.
    """
    parsed = cut_lineage(files.select("file", "xml").mapInPandas(_parse, _ELEMENT_SCHEMA))

    def of(kind: str, *columns) -> DataFrame:
        return parsed.filter(F.col("kind") == kind).select(*columns).distinct()

    nodes = of(
        "node", "process_id", F.col("id").alias("node_id"), "name", "type",
        F.lit(None).cast("string").alias("description"),
    )
    flows = of("flow", F.col("id").alias("flow_id"), "process_id", "source_id", "target_id", "condition", "name")
    members = of("member", F.col("id").alias("lane_id"), F.col("target_id").alias("node_id"))
    known = nodes.select("node_id")
    for end in ("source_id", "target_id"):
        flows = flows.join(known.withColumnRenamed("node_id", end), end, "left_semi")
    return {
        "definitions": of(
            "definition", "definition_id", "name", "filename", "has_diagram", "target_namespace", "xml"
        ),
        "processes": of("process", "definition_id", "process_id", "name"),
        "nodes": nodes,
        "flows": flows.select("flow_id", "process_id", "source_id", "target_id", "condition", "name"),
        "lanes": of("lane", "process_id", F.col("id").alias("lane_id"), "name"),
        "lane_members": members.join(known, "node_id", "left_semi").select("lane_id", "node_id"),
        "participants": of("participant", F.col("id").alias("participant_id"), "process_id", "definition_id"),
        "rejects": parsed.filter(F.col("kind") == "reject").select("file", "error"),
    }


def read_process_models(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("xml")
    )
    return parse_process_models(files)
