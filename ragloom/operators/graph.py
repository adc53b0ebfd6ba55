"""Process graphs as node and edge tables.

A graph is a dict of DataFrames: definitions, processes, nodes, flows, lanes, lane_members, participants (see
`sources.process_models`). Results are long tables, one row per element, so that a process or hub of any size stays
spread over tasks; only what is bounded by a limit is nested. Flows join known nodes only, which the importer sees to.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.scale import top_k
from ragloom.functions.text import or_null

Graph = Mapping[str, DataFrame]

# Hop limits and the number of predecessors shown.
NEIGHBOUR_DEPTH = 3
PREDECESSOR_DEPTH = 2
PREDECESSOR_LIMIT = 5
UNKNOWN_LANE = "Unbekannt"


def node_lanes(graph: Graph) -> DataFrame:
    """Every node with its lane, if it has one: one row per (node, lane)."""
    lanes = graph["lanes"].select("lane_id", F.col("name").alias("lane_name"))
    members = graph["lane_members"].join(lanes, "lane_id")
    return graph["nodes"].join(members, "node_id", "left")


def import_summary(graph: Graph, rules: DataFrame | None = None) -> DataFrame:
    """Element counts per definition: processes, nodes, flows, lanes, rules."""
    owner = graph["processes"].select("process_id", "definition_id")
    summary = graph["definitions"].select("definition_id", "filename", "has_diagram")

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("definition_id").agg(F.count(F.lit(1)).alias(name))

    parts = [counted(owner, "processes")]
    parts += [counted(graph[name].join(owner, "process_id"), name) for name in ("nodes", "flows", "lanes")]
    if rules is not None:
        parts.append(counted(rules, "rules"))
    for part in parts:
        summary = summary.join(part, "definition_id", "left")
    return summary.fillna(0, [p.columns[1] for p in parts])


def list_definitions(graph: Graph) -> DataFrame:
    """Definitions with their process count and one row per process; sort by name, definition_id, process_id.

    A definition without a process has count 0 and one row with null process columns.
    """
    processes = graph["processes"].select("definition_id", "process_id", F.col("name").alias("process_name"))
    counts = processes.groupBy("definition_id").agg(F.count(F.lit(1)).alias("process_count"))
    return (
        graph["definitions"]
        .select("definition_id", "name", "filename")
        .join(counts, "definition_id", "left")
        .fillna(0, ["process_count"])
        .join(processes, "definition_id", "left")
    )


def process_nodes_lanes(graph: Graph) -> dict[str, DataFrame]:
    """Lanes per process, and nodes per process with their lane id."""
    nodes = node_lanes(graph).select("process_id", "node_id", "name", "type", "lane_id").distinct()
    return {"lanes": graph["lanes"].select("process_id", "lane_id", "name").distinct(), "nodes": nodes}


def lane_task_counts(graph: Graph) -> DataFrame:
    """User tasks per lane; lanes without one are left out."""
    tasks = node_lanes(graph).filter((F.col("type") == "userTask") & F.col("lane_id").isNotNull())
    counts = tasks.groupBy("process_id", "lane_id").agg(F.count_distinct("node_id").alias("task_count"))
    return graph["lanes"].distinct().join(counts, ["process_id", "lane_id"])


def process_graph(graph: Graph) -> dict[str, DataFrame]:
    """Node list (one row per lane of a node) and edge list per process."""
    return {
        "nodes": node_lanes(graph).select("process_id", "node_id", "name", "type", "lane_id"),
        "edges": graph["flows"].select("process_id", "flow_id", "source_id", "target_id"),
    }


def labels(graph: Graph, ids: DataFrame) -> DataFrame:
    """Names of the given lanes and nodes. ids: process_id, kind ('lane' or 'node'), id."""
    lanes = graph["lanes"].select(
        "process_id", F.lit("lane").alias("kind"), F.col("lane_id").alias("id"), "name",
        F.lit(None).cast("string").alias("type"),
    )
    nodes = graph["nodes"].select(
        "process_id", F.lit("node").alias("kind"), F.col("node_id").alias("id"), "name", "type"
    )
    return lanes.unionByName(nodes).join(ids, ["process_id", "kind", "id"], "left_semi")


def _hops(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Nodes reached from (start, at) over (at, to) in 1..depth hops, with the fewest hops.

    Each step joins once: edges that stay where they are keep what was reached before.
    """
    reached = starts.join(edges, "at").select("start", F.col("to").alias("at"), F.lit(1).alias("hops")).distinct()
    ends = edges.select("at").union(edges.select("to")).distinct()
    moves = edges.select("at", "to", F.lit(1).alias("cost")).union(ends.select("at", "at", F.lit(0)))
    for _ in range(depth - 1):
        reached = (
            reached.join(moves, "at")
            .groupBy("start", F.col("to").alias("at"))
            .agg(F.min(F.col("hops") + F.col("cost")).alias("hops"))
        )
    return reached.select("start", F.col("at").alias("node_id"), "hops")


def neighbourhood(graph: Graph, starts: DataFrame, depth: int = NEIGHBOUR_DEPTH) -> DataFrame:
    """Current node, predecessors and successors within `depth` hops.

    starts: process_id, node_id. Returns (start, side, hops, node_id, name, type, lane_id, lane_name); a side without
    nodes simply has no rows.
    """
    centre = starts.join(graph["nodes"].select("process_id", "node_id"), ["process_id", "node_id"]).select(
        F.col("node_id").alias("start"), F.col("node_id").alias("at")
    ).distinct()
    flows = graph["flows"]
    forward = flows.select(F.col("source_id").alias("at"), F.col("target_id").alias("to")).distinct()
    backward = flows.select(F.col("target_id").alias("at"), F.col("source_id").alias("to")).distinct()
    sides = (
        centre.select("start", F.col("at").alias("node_id"), F.lit(0).alias("hops"), F.lit("current").alias("side"))
        .unionByName(_hops(centre, forward, depth).withColumn("side", F.lit("successor")))
        .unionByName(_hops(centre, backward, depth).withColumn("side", F.lit("predecessor")))
    )
    return sides.join(node_lanes(graph).drop("process_id", "description"), "node_id")


class PositionView(NamedTuple):
    """Surroundings of requests, keyed by request_id."""

    current: DataFrame
    predecessors: DataFrame  # at most 5 per request, `position` from 1
    successors: DataFrame
    branches: DataFrame  # outgoing paths of gateway successors, keyed also by gateway_id


def position_view(graph: Graph, requests: DataFrame) -> PositionView:
    """Where requests (request_id, process_id, current_node_id) stand in their process.

    Direct successors carry the flow's condition; a gateway successor brings its outgoing branches. Predecessors are
    the first five within two hops by hop, then id.
    """
    located = requests.select("request_id", "process_id", F.col("current_node_id").alias("node_id"))
    details = node_lanes(graph).drop("process_id")
    centre = located.join(graph["nodes"].select("process_id", "node_id"), ["process_id", "node_id"])
    current = centre.drop("process_id").join(details, "node_id")

    flows = graph["flows"]
    outgoing = flows.select(
        "source_id", F.col("target_id").alias("node_id"), "condition", F.col("name").alias("condition_name")
    )
    successors = (
        centre.select("request_id", F.col("node_id").alias("source_id"))
        .join(outgoing, "source_id")
        .drop("source_id")
        .join(details, "node_id")
        .withColumn("is_gateway", F.contains("type", F.lit("Gateway")))
    )
    gateways = successors.filter("is_gateway").select("request_id", F.col("node_id").alias("gateway_id")).distinct()
    branches = (
        gateways.join(outgoing.withColumnRenamed("source_id", "gateway_id"), "gateway_id").join(details, "node_id")
    )

    # Requests at one node share their predecessors, so these are searched once per node.
    backward = flows.select(F.col("target_id").alias("at"), F.col("source_id").alias("to")).distinct()
    nodes = centre.select(F.col("node_id").alias("start"), F.col("node_id").alias("at")).distinct()
    near = _hops(nodes, backward, PREDECESSOR_DEPTH).join(details, "node_id")
    order = [F.col("hops"), F.col("node_id"), F.col("lane_id").asc_nulls_last()]
    first = top_k(near, ["start"], order, PREDECESSOR_LIMIT, "position")
    predecessors = centre.select("request_id", F.col("node_id").alias("start")).join(first, "start").drop("start")
    return PositionView(current, predecessors, successors, branches)


def overview(graph: Graph) -> DataFrame:
    """Lanes and nodes of each process: (process_id, process_name, kind, id, name, type)."""
    processes = graph["processes"].select("process_id", F.col("name").alias("process_name"))
    lanes = graph["lanes"].select(
        "process_id", F.lit("lane").alias("kind"), F.col("lane_id").alias("id"), "name",
        F.lit(None).cast("string").alias("type"),
    )
    nodes = graph["nodes"].select(
        "process_id", F.lit("node").alias("kind"), F.col("node_id").alias("id"), "name", "type"
    )
    return processes.join(lanes.unionByName(nodes).distinct(), "process_id")


def _shown(name: Column, identifier: Column) -> Column:
    return F.coalesce(or_null(name), identifier)


def overview_full(graph: Graph) -> dict[str, DataFrame]:
    """Everything about each process: lanes with nodes, nodes without lane, flows and gateway branches by name."""
    nodes = graph["nodes"]
    lane_nodes = (
        graph["lanes"].distinct()
        .select("process_id", "lane_id", F.col("name").alias("lane_name"))
        .join(graph["lane_members"], "lane_id", "left")
        .join(nodes.select("node_id", "name", "type"), "node_id", "left")
    )
    own_lanes = graph["lanes"].select("process_id", "lane_id").join(graph["lane_members"], "lane_id")
    names = nodes.select("node_id", _shown(F.col("name"), F.col("node_id")).alias("_name"))
    flows = (
        graph["flows"]
        .join(nodes.select(F.col("node_id").alias("source_id"), F.col("process_id").alias("_owner")), "source_id")
        .join(names.select(F.col("node_id").alias("source_id"), F.col("_name").alias("from")), "source_id")
        .join(names.select(F.col("node_id").alias("target_id"), F.col("_name").alias("to")), "target_id")
        .select(
            F.col("_owner").alias("process_id"), "flow_id", "source_id", "target_id", "from", "to",
            F.coalesce(or_null(F.col("name")), F.col("condition")).alias("condition"),
        )
    )
    gateways = nodes.filter(F.contains("type", F.lit("Gateway"))).select(
        "process_id", F.col("node_id").alias("gateway_id"), "name", "type"
    )
    branches = flows.select(F.col("source_id").alias("gateway_id"), "flow_id", F.col("to").alias("target"), "condition")
    return {
        "processes": graph["processes"].select(
            "process_id", _shown(F.col("name"), F.col("process_id")).alias("name")
        ),
        "lane_nodes": lane_nodes,
        "nodes_without_lane": nodes.join(own_lanes, ["process_id", "node_id"], "left_anti"),
        "flows": flows,
        "gateways": gateways.join(branches, "gateway_id", "left"),
    }


def process_tasks(graph: Graph) -> DataFrame:
    """Named tasks (no gateways, no events) per process and lane; a task without lane has a default label."""
    kind = F.col("type")
    tasks = node_lanes(graph).filter(
        ~F.contains(kind, F.lit("Gateway")) & ~F.contains(kind, F.lit("Event")) & (F.length("name") > 0)
    )
    lane = F.coalesce(or_null(F.col("lane_name")), F.lit(UNKNOWN_LANE))
    return tasks.select("process_id", lane.alias("lane_name"), F.col("name").alias("task_name")).distinct()


def delete_definitions(graph: Graph, ids: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(remaining graph, counts). ids: definition_id; none deletes everything.

    The counts have one row per asked id with `found`, or one row for all. Rules and whitelists are included when the
    graph carries them as `rules` (definition_id) and `whitelists` (definition_id).
    """
    owners = graph["processes"].select("process_id", "definition_id").distinct()
    lane_owner = graph["lanes"].select("lane_id", "process_id").join(owners, "process_id").select(
        "lane_id", "definition_id"
    )
    keyed = {
        "whitelist_rules": graph.get("rules"),
        "whitelists": graph.get("whitelists"),
        "participants": graph["participants"],
        "nodes": graph["nodes"].join(owners, "process_id"),
        "lanes": graph["lanes"].join(owners, "process_id"),
        "processes": graph["processes"],
        "definitions": graph["definitions"],
    }
    keyed = {name: rows for name, rows in keyed.items() if rows is not None}
    if ids is None:
        kept = {name: rows.limit(0) for name, rows in graph.items()}
        counts = None
        for name, rows in keyed.items():
            one = rows.agg(F.count(F.lit(1)).alias(name)).withColumn("all", F.lit(True))
            counts = one if counts is None else counts.join(one, "all")
        return kept, counts.drop("all")
    asked = ids.select("definition_id").distinct()
    counts = asked
    for name, rows in keyed.items():
        per = rows.join(asked, "definition_id", "left_semi").groupBy("definition_id").agg(
            F.count(F.lit(1)).alias(name)
        )
        counts = counts.join(per, "definition_id", "left")
    counts = counts.fillna(0).withColumn("found", F.col("definitions") > 0)
    gone = owners.join(asked, "definition_id", "left_semi").select("process_id")
    gone_nodes = graph["nodes"].join(gone, "process_id", "left_semi").select("node_id")
    gone_lanes = lane_owner.join(asked, "definition_id", "left_semi").select("lane_id")
    kept = {}
    for name, rows in graph.items():
        if "definition_id" in rows.columns:
            kept[name] = rows.join(asked, "definition_id", "left_anti")
        elif name == "lane_members":
            kept[name] = rows.join(gone_lanes, "lane_id", "left_anti").join(gone_nodes, "node_id", "left_anti")
        elif name == "flows":
            for end in ("source_id", "target_id"):
                rows = rows.join(gone_nodes.withColumnRenamed("node_id", end), end, "left_anti")
            kept[name] = rows.select(*graph["flows"].columns)
        else:
            kept[name] = rows.join(gone, "process_id", "left_anti")
    return kept, counts
