"""Process-graph, whitelist and gating queries over the graph derived from conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.operators import gating, graph
from ragloom.plans import datasets as data
from ragloom.plans.registry import query

GRAPH = """t AS (SELECT 'P' || conv_id AS process_id, 'D' || (conv_id % 10) AS definition_id, turn, role
  FROM conversations),
ends AS (SELECT process_id, max(turn) AS last FROM t GROUP BY 1),
procs AS (SELECT DISTINCT definition_id, process_id, 'process ' || process_id AS name FROM t),
defs AS (SELECT DISTINCT definition_id, 'definition ' || definition_id AS name, definition_id || '.bpmn' AS filename
  FROM t),
nodes AS (SELECT process_id, process_id || ':' || turn AS node_id, role || ' ' || turn AS name,
  CASE WHEN turn % 3 = 0 THEN 'exclusiveGateway' ELSE 'userTask' END AS type FROM t),
flows AS (SELECT process_id || ':' || turn || '>' || (turn + j) AS flow_id, process_id,
  process_id || ':' || turn AS source_id, process_id || ':' || (turn + j) AS target_id,
  CASE WHEN j = 2 THEN 'skip ' || turn END AS condition, CASE WHEN turn % 3 = 0 AND j = 1 THEN 'next' END AS name
  FROM t JOIN ends USING (process_id), (VALUES (1), (2)) s(j) WHERE (j = 1 OR turn % 3 = 0) AND turn + j <= last),
lanes AS (SELECT DISTINCT process_id, process_id || ':' || role AS lane_id, role AS name FROM t WHERE role <> 'system'),
members AS (SELECT process_id || ':' || role AS lane_id, process_id || ':' || turn AS node_id FROM t
  WHERE role <> 'system'),
nl AS (SELECT n.*, m.lane_id, l.name AS lane_name FROM nodes n LEFT JOIN members m USING (node_id)
  LEFT JOIN lanes l USING (lane_id))"""


def _long(df: DataFrame, *names: str) -> DataFrame:
    """Integer columns as long, as SQL counts are."""
    return reduce(lambda d, n: d.withColumn(n, F.col(n).cast("long")), names, df)


@query(
    "import_summary",
    f"""WITH {GRAPH} SELECT definition_id, filename, FALSE AS has_diagram,
  (SELECT count(*) FROM procs p WHERE p.definition_id = d.definition_id) AS processes,
  (SELECT count(*) FROM nodes JOIN procs p USING (process_id) WHERE p.definition_id = d.definition_id) AS nodes,
  (SELECT count(*) FROM flows JOIN procs p USING (process_id) WHERE p.definition_id = d.definition_id) AS flows,
  (SELECT count(*) FROM lanes JOIN procs p USING (process_id) WHERE p.definition_id = d.definition_id) AS lanes,
  (SELECT count(*) FROM lanes JOIN procs p USING (process_id) WHERE p.definition_id = d.definition_id) AS rules
FROM defs d""",
)
def import_summary(spark, d) -> DataFrame:
    g = data.process_graph(spark, d)
    return graph.import_summary(g, gating.default_whitelist(g).headers)


@query(
    "list_definitions",
    f"""WITH {GRAPH} SELECT definition_id, d.name, filename, count(*) OVER (PARTITION BY definition_id) AS process_count,
  process_id, p.name AS process_name FROM defs d JOIN procs p USING (definition_id)""",
)
def list_definitions(spark, d) -> DataFrame:
    return graph.list_definitions(data.process_graph(spark, d))


@query(
    "process_nodes_lanes",
    f"""WITH {GRAPH} SELECT 'node' AS kind, process_id, node_id AS id, name, type, lane_id FROM nl
  UNION ALL SELECT 'lane', process_id, lane_id, name, NULL, NULL FROM lanes""",
)
def process_nodes_lanes(spark, d) -> DataFrame:
    parts = graph.process_nodes_lanes(data.process_graph(spark, d))
    none = F.lit(None).cast("string")
    nodes = parts["nodes"].select(
        F.lit("node").alias("kind"), "process_id", F.col("node_id").alias("id"), "name", "type", "lane_id"
    )
    lanes = parts["lanes"].select(
        F.lit("lane").alias("kind"), "process_id", F.col("lane_id").alias("id"), "name", none.alias("type"),
        none.alias("lane_id"),
    )
    return nodes.unionByName(lanes)


@query(
    "lane_task_counts",
    f"""WITH {GRAPH} SELECT l.process_id, lane_id, l.name, count(*) AS task_count FROM lanes l JOIN members USING (lane_id)
JOIN nodes n USING (node_id) WHERE n.type = 'userTask' GROUP BY ALL""",
)
def lane_task_counts(spark, d) -> DataFrame:
    return graph.lane_task_counts(data.process_graph(spark, d))


@query(
    "process_graph",
    f"""WITH {GRAPH} SELECT process_id, 'edge' AS kind, flow_id AS id, source_id AS a, target_id AS b FROM flows
  UNION ALL SELECT process_id, 'node', node_id, type, lane_id FROM nl""",
)
def process_graph(spark, d) -> DataFrame:
    parts = graph.process_graph(data.process_graph(spark, d))
    edges = parts["edges"].select(
        "process_id", F.lit("edge").alias("kind"), F.col("flow_id").alias("id"), F.col("source_id").alias("a"),
        F.col("target_id").alias("b"),
    )
    nodes = parts["nodes"].select(
        "process_id", F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.col("type").alias("a"),
        F.col("lane_id").alias("b"),
    )
    return edges.unionByName(nodes)


@query(
    "labels",
    f"""WITH {GRAPH} SELECT process_id, 'node' AS kind, node_id AS id, name, type FROM nodes WHERE type = 'userTask'
  UNION ALL SELECT process_id, 'lane', lane_id, name, NULL FROM lanes WHERE name = 'user'""",
)
def labels(spark, d) -> DataFrame:
    g = data.process_graph(spark, d)
    nodes = g["nodes"].filter(F.col("type") == "userTask").select(
        "process_id", F.lit("node").alias("kind"), F.col("node_id").alias("id")
    )
    lanes = g["lanes"].filter(F.col("name") == "user").select(
        "process_id", F.lit("lane").alias("kind"), F.col("lane_id").alias("id")
    )
    return graph.labels(g, nodes.unionByName(lanes))


_REACH = """fwd AS (
  SELECT source_id AS start, target_id AS cur, 1 AS h FROM flows
  UNION ALL SELECT a.start, f.target_id, h + 1 FROM fwd a JOIN flows f ON f.source_id = a.cur WHERE h < {depth})"""


@query(
    "neighbourhood",
    f"""WITH RECURSIVE {GRAPH}, {_REACH.format(depth=3)},
sides AS (SELECT node_id AS start, 'current' AS side, 0 AS hops, node_id FROM nodes
  UNION ALL SELECT start, 'successor', min(h), cur FROM fwd GROUP BY start, cur
  UNION ALL SELECT cur, 'predecessor', min(h), start FROM fwd GROUP BY start, cur)
SELECT start, side, hops::BIGINT AS hops, node_id, name, type, lane_id, lane_name FROM sides JOIN nl USING (node_id)""",
)
def neighbourhood(spark, d) -> DataFrame:
    g = data.process_graph(spark, d)
    return _long(graph.neighbourhood(g, g["nodes"].select("process_id", "node_id"), 3), "hops")


@query(
    "position_successors",
    f"""WITH {GRAPH}, succ AS (
  SELECT c.node_id AS cur, f.target_id AS node_id, f.condition, f.name AS condition_name FROM nodes c
  JOIN flows f ON f.source_id = c.node_id),
br AS (SELECT DISTINCT s.cur, s.node_id, f.target_id, f.condition, f.name FROM succ s JOIN nodes n USING (node_id)
  JOIN flows f ON f.source_id = s.node_id WHERE n.type LIKE '%Gateway%'),
brs AS (SELECT cur, node_id, string_agg(target_id || '|' || coalesce(condition, '') || '|' || coalesce(name, ''), ';'
  ORDER BY target_id) AS branches FROM br GROUP BY ALL)
SELECT replace(substr(s.cur, 2), ':', '/') AS request_id, s.node_id, nl.name, nl.type, nl.lane_id, s.condition,
  s.condition_name, nl.type LIKE '%Gateway%' AS is_gateway, coalesce(branches, '') AS branches
FROM succ s JOIN nl USING (node_id) LEFT JOIN brs ON brs.cur = s.cur AND brs.node_id = s.node_id""",
)
def position_successors(spark, d) -> DataFrame:
    view = graph.position_view(data.process_graph(spark, d), data.positions(spark, d))
    text = F.concat_ws("|", "node_id", F.coalesce("condition", F.lit("")), F.coalesce("condition_name", F.lit("")))
    branches = view.branches.groupBy("request_id", "gateway_id").agg(
        F.array_join(F.array_sort(F.collect_list(text)), ";").alias("branches")
    )
    return (
        view.successors.join(branches.withColumnRenamed("gateway_id", "node_id"), ["request_id", "node_id"], "left")
        .select("request_id", "node_id", "name", "type", "lane_id", "condition", "condition_name", "is_gateway",
                F.coalesce("branches", F.lit("")).alias("branches"))
    )


_PREDECESSORS = f"""{_REACH.format(depth=2)},
preds AS (SELECT *, row_number() OVER (PARTITION BY cur ORDER BY hops, start) AS position FROM (
  SELECT cur, start, min(h) AS hops FROM fwd GROUP BY ALL))"""


@query(
    "position_predecessors",
    f"""WITH RECURSIVE {GRAPH}, {_PREDECESSORS}
SELECT replace(substr(cur, 2), ':', '/') AS request_id, start AS node_id, name, type, lane_name, position
FROM preds JOIN nl ON nl.node_id = start WHERE position <= 5""",
)
def position_predecessors(spark, d) -> DataFrame:
    view = graph.position_view(data.process_graph(spark, d), data.positions(spark, d))
    return _long(view.predecessors.select("request_id", "node_id", "name", "type", "lane_name", "position"), "position")


@query(
    "position_current",
    f"""WITH {GRAPH} SELECT replace(substr(node_id, 2), ':', '/') AS request_id, node_id, name, type, lane_id, lane_name
FROM nl""",
)
def position_current(spark, d) -> DataFrame:
    view = graph.position_view(data.process_graph(spark, d), data.positions(spark, d))
    return view.current.select("request_id", "node_id", "name", "type", "lane_id", "lane_name")


@query(
    "overview",
    f"""WITH {GRAPH}, parts AS (SELECT process_id, 'node' AS kind, node_id AS id, name, type FROM nodes
  UNION ALL SELECT process_id, 'lane', lane_id, name, NULL FROM lanes)
SELECT process_id, p.name AS process_name, kind, id, s.name, type FROM parts s JOIN procs p USING (process_id)""",
)
def overview(spark, d) -> DataFrame:
    return graph.overview(data.process_graph(spark, d))


@query(
    "overview_full_flows",
    f"""WITH {GRAPH} SELECT f.process_id, flow_id, a.name AS "from", b.name AS "to", coalesce(f.name, condition) AS condition
FROM flows f JOIN nodes a ON a.node_id = source_id JOIN nodes b ON b.node_id = target_id""",
)
def overview_full_flows(spark, d) -> DataFrame:
    return graph.overview_full(data.process_graph(spark, d))["flows"].select(
        "process_id", "flow_id", "from", "to", "condition"
    )


@query(
    "overview_full_gateways",
    f"""WITH {GRAPH} SELECT g.process_id, g.node_id AS gateway_id, g.name, b.name AS target,
  coalesce(f.name, condition) AS condition FROM nodes g LEFT JOIN flows f ON f.source_id = g.node_id
  LEFT JOIN nodes b ON b.node_id = f.target_id WHERE g.type LIKE '%Gateway%'""",
)
def overview_full_gateways(spark, d) -> DataFrame:
    return graph.overview_full(data.process_graph(spark, d))["gateways"].select(
        "process_id", "gateway_id", "name", "target", "condition"
    )


@query(
    "overview_full_lanes",
    f"""WITH {GRAPH} SELECT process_id, lane_id, lane_name, node_id, name, type FROM nl""",
)
def overview_full_lanes(spark, d) -> DataFrame:
    full = graph.overview_full(data.process_graph(spark, d))
    columns = ["process_id", "lane_id", "lane_name", "node_id", "name", "type"]
    none = F.lit(None).cast("string")
    loose = full["nodes_without_lane"].withColumn("lane_id", none).withColumn("lane_name", none)
    return full["lane_nodes"].select(*columns).unionByName(loose.select(*columns))


@query(
    "process_tasks",
    f"""WITH {GRAPH} SELECT DISTINCT process_id, coalesce(lane_name, 'Unbekannt') AS lane_name, name AS task_name FROM nl
WHERE type NOT LIKE '%Gateway%' AND type NOT LIKE '%Event%'""",
)
def process_tasks(spark, d) -> DataFrame:
    return graph.process_tasks(data.process_graph(spark, d))


_GONE = "SELECT unnest(['D1', 'D3', 'DX']) AS definition_id"


def _doomed(spark) -> DataFrame:
    return spark.createDataFrame([("D1",), ("D3",), ("DX",)], "definition_id string")


@query(
    "delete_definitions_counts",
    f"""WITH {GRAPH}, asked AS ({_GONE})
SELECT definition_id, (SELECT count(*) FROM procs p WHERE p.definition_id = a.definition_id) AS processes,
  (SELECT count(*) FROM procs p WHERE p.definition_id = a.definition_id) AS participants,
  (SELECT count(*) FROM nodes JOIN procs p USING (process_id) WHERE p.definition_id = a.definition_id) AS nodes,
  (SELECT count(*) FROM lanes JOIN procs p USING (process_id) WHERE p.definition_id = a.definition_id) AS lanes,
  (SELECT count(*) FROM lanes JOIN procs p USING (process_id) WHERE p.definition_id = a.definition_id)
    AS whitelist_rules,
  (SELECT count(*) FROM defs x WHERE x.definition_id = a.definition_id) AS definitions,
  a.definition_id <> 'DX' AS found FROM asked a""",
)
def delete_definitions_counts(spark, d) -> DataFrame:
    g = data.process_graph(spark, d)
    return graph.delete_definitions({**g, "rules": gating.default_whitelist(g).headers}, _doomed(spark))[1]


@query(
    "delete_definitions_kept",
    f"""WITH {GRAPH}, kept AS (SELECT process_id FROM procs WHERE definition_id NOT IN ('D1', 'D3'))
SELECT 'nodes' AS element, count(*) AS n FROM nodes SEMI JOIN kept USING (process_id)
UNION ALL SELECT 'flows', count(*) FROM flows SEMI JOIN kept USING (process_id)
UNION ALL SELECT 'lanes', count(*) FROM lanes SEMI JOIN kept USING (process_id)
UNION ALL SELECT 'lane_members', count(*) FROM members JOIN nodes USING (node_id) SEMI JOIN kept USING (process_id)
UNION ALL SELECT 'processes', count(*) FROM kept
UNION ALL SELECT 'participants', count(*) FROM kept
UNION ALL SELECT 'definitions', count(*) FROM defs WHERE definition_id NOT IN ('D1', 'D3')""",
)
def delete_definitions_kept(spark, d) -> DataFrame:
    kept = graph.delete_definitions(data.process_graph(spark, d), _doomed(spark))[0]
    counts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("element"), "n")
              for name, rows in kept.items()]
    return reduce(DataFrame.unionByName, counts)


# ---- whitelists ----------------------------------------------------------------------------------------------------


@query(
    "default_whitelist_rules",
    f"""WITH {GRAPH} SELECT definition_id, process_id, lane_id, l.name AS role, count(*) AS n_nodes FROM lanes l
JOIN procs USING (process_id) JOIN members USING (lane_id) GROUP BY ALL""",
)
def default_whitelist_rules(spark, d) -> DataFrame:
    return gating.list_rules(gating.default_whitelist(data.process_graph(spark, d)))


@query(
    "default_whitelist_without_lanes",
    f"""WITH {GRAPH} SELECT definition_id, process_id, '*' AS lane_id, NULL::VARCHAR AS role, count(*) AS n_nodes
FROM nodes JOIN procs USING (process_id) WHERE definition_id IN ('D2', 'D5') GROUP BY ALL
UNION ALL SELECT definition_id, process_id, lane_id, l.name, count(*) FROM lanes l
JOIN procs USING (process_id) JOIN members USING (lane_id) WHERE definition_id NOT IN ('D2', 'D5') GROUP BY ALL""",
)
def default_whitelist_without_lanes(spark, d) -> DataFrame:
    g = data.process_graph(spark, d)
    laneless = g["processes"].filter(F.col("definition_id").isin("D2", "D5")).select("process_id")
    return gating.list_rules(
        gating.default_whitelist({**g, "lanes": g["lanes"].join(laneless, "process_id", "left_anti")})
    )


@query(
    "allowed_for_roles",
    f"""WITH {GRAPH} SELECT DISTINCT definition_id, l.name AS roles_key, 'lane' AS kind, lane_id AS id FROM lanes l
  JOIN procs USING (process_id)
UNION ALL SELECT DISTINCT definition_id, l.name, 'node', node_id FROM lanes l JOIN procs USING (process_id)
  JOIN members USING (lane_id)
UNION ALL SELECT DISTINCT definition_id, 'assistant+user', 'lane', lane_id FROM lanes l JOIN procs USING (process_id)
UNION ALL SELECT DISTINCT definition_id, 'assistant+user', 'node', node_id FROM lanes l JOIN procs USING (process_id)
  JOIN members USING (lane_id)""",
)
def allowed_for_roles(spark, d) -> DataFrame:
    g = data.process_graph(spark, d)
    single = data.positions(spark, d).select("definition_id", "roles")
    both = g["definitions"].select(
        "definition_id", F.array(F.lit("user"), F.lit("assistant"), F.lit("user")).alias("roles")
    )
    rows = gating.allowed_for_roles(gating.default_whitelist(g), single.unionByName(both))
    return rows.withColumn("roles_key", F.replace("roles_key", F.lit("\u001f"), F.lit("+")))


def _whitelists(spark, d) -> DataFrame:
    """Two whitelists per process: 'a' lists every fourth turn's node and one type, 'b' the user lane."""
    turn = data.turns(spark, d)
    process = F.concat(F.lit("P"), F.col("conv_id").cast("string"))
    node = F.concat(process, F.lit(":"), F.col("turn").cast("string"))
    by_node = turn.groupBy(process.alias("process_id")).agg(
        F.sort_array(F.collect_list(F.when(F.col("turn") % 4 == 1, node))).alias("allow_nodes")
    )
    none = F.array().cast("array<string>")
    a = by_node.select(
        F.concat("process_id", F.lit("-a")).alias("id"), F.lit("by node").alias("name"), "process_id", "allow_nodes",
        none.alias("allow_lanes"), F.array(F.lit("userTask")).alias("allow_types"), none.alias("principals"),
    )
    b = by_node.select(
        F.concat("process_id", F.lit("-b")).alias("id"), F.lit("by lane").alias("name"), "process_id",
        none.alias("allow_nodes"), F.array(F.concat("process_id", F.lit(":user"))).alias("allow_lanes"),
        none.alias("allow_types"), none.alias("principals"),
    )
    return a.unionByName(b)


@query(
    "upsert_whitelist",
    f"""WITH {GRAPH} SELECT process_id || s AS id, CASE WHEN s = '-a' THEN 'renamed' ELSE
  CASE WHEN s = '-b' THEN 'by lane' ELSE 'new' END END AS name,
  CASE WHEN s = '-a' THEN 'userTask,callActivity' ELSE '' END AS allow_types
FROM procs, (VALUES ('-a'), ('-b'), ('-c')) v(s)""",
)
def upsert_whitelist(spark, d) -> DataFrame:
    stored = _whitelists(spark, d)
    renamed = stored.filter(F.col("name") == "by node").withColumn("name", F.lit("renamed")).withColumn(
        "allow_types", F.array(F.lit("userTask"), F.lit("callActivity"))
    )
    added = renamed.withColumn("id", F.replace("id", F.lit("-a"), F.lit("-c"))).withColumn(
        "name", F.lit("new")
    ).withColumn("allow_types", F.lit(None).cast("array<string>"))
    return gating.upsert_whitelist(stored, renamed.unionByName(added)).select(
        "id", "name", F.array_join("allow_types", ",").alias("allow_types")
    )


_ALLOWED = """allowed AS (SELECT process_id, node_id AS id FROM nodes WHERE split_part(node_id, ':', 2)::INT % 4 = 1
  UNION SELECT process_id, node_id FROM nl WHERE lane_name = 'user')"""


def _both_lists(spark, d) -> DataFrame:
    return _whitelists(spark, d).select("process_id", "id")


@query(
    "allowed_union",
    f"""WITH {GRAPH}, {_ALLOWED} SELECT process_id, 'node' AS kind, id FROM allowed
UNION ALL SELECT process_id, 'type', 'userTask' FROM procs""",
)
def allowed_union(spark, d) -> DataFrame:
    return gating.allowed_union(_whitelists(spark, d), data.process_graph(spark, d), _both_lists(spark, d))


@query(
    "next_allowed",
    f"""WITH RECURSIVE {GRAPH}, {_ALLOWED}, fwd AS (SELECT source_id AS start, target_id AS cur, 1 AS h, [flow_id] AS used FROM flows
  UNION ALL SELECT a.start, f.target_id, h + 1, list_append(used, flow_id) FROM fwd a JOIN flows f ON f.source_id = a.cur
  WHERE h < 3 AND NOT list_contains(used, flow_id))
SELECT replace(substr(start, 2), ':', '/') AS request_id, n.process_id, cur AS node_id, name, type, h::BIGINT AS hops
FROM fwd JOIN allowed ON id = cur JOIN nodes n ON n.node_id = cur WHERE type = 'userTask'""",
)
def next_allowed(spark, d) -> DataFrame:
    g = data.process_graph(spark, d)
    allowed = gating.allowed_union(_whitelists(spark, d), g, _both_lists(spark, d))
    positions = data.positions(spark, d).select(
        "request_id", "process_id", F.col("current_node_id").alias("node_id")
    )
    return _long(gating.next_allowed(g, allowed, positions, 3), "hops")


# ---- gating --------------------------------------------------------------------------------------------------------


@query(
    "gating_mode",
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'gating' WHEN role = 'user' THEN 'process' ELSE 'none' END AS mode,
  CASE WHEN turn = 5 THEN 'NONE' WHEN turn % 2 = 0 OR role = 'assistant' THEN 'DOCS_ONLY'
       WHEN turn % 3 = 1 THEN 'GATING_ENABLED' ELSE 'PROCESS_CONTEXT' END AS client_mode FROM conversations""",
)
def gating_mode(spark, d) -> DataFrame:
    turn = data.turns(spark, d)
    node = F.when(F.col("turn") % 3 == 1, F.lit("n")).otherwise("")
    scope = F.when(F.col("turn") % 2 == 0, "docs").otherwise("step")
    process = F.when(F.col("turn") != 5, "p")
    return turn.select(
        "conv_id", "turn", gating.gating_mode(node, F.col("role") == "user").alias("mode"),
        gating.mode_for_scope(process, F.col("role") != "assistant", scope, F.length(node) > 0).alias("client_mode"),
    )


_GATED = f"""{_PREDECESSORS},
req AS (SELECT conv_id || '/' || turn AS request_id, 'P' || conv_id AS process_id, 'D' || (conv_id % 10) AS definition_id,
  'P' || conv_id || ':' || turn AS cur, role FROM conversations),
rl AS (SELECT definition_id, l.name AS role, lane_id FROM lanes l JOIN procs USING (process_id)),
rn AS (SELECT definition_id, role, node_id FROM rl JOIN members USING (lane_id)),
cnt AS (SELECT r.request_id, (SELECT count(*) FROM rl WHERE rl.definition_id = r.definition_id AND rl.role = r.role) AS n_lanes,
  (SELECT count(*) FROM rn WHERE rn.definition_id = r.definition_id AND rn.role = r.role) AS n_nodes FROM req r),
gs AS (SELECT r.request_id, f.target_id AS node_id, nl.name, nl.type, nl.lane_name, f.condition, f.name AS condition_name
  FROM req r JOIN flows f ON f.source_id = r.cur JOIN nl ON nl.node_id = f.target_id JOIN cnt USING (request_id)
  LEFT JOIN rn ON rn.definition_id = r.definition_id AND rn.role = r.role AND rn.node_id = f.target_id
  LEFT JOIN rl ON rl.definition_id = r.definition_id AND rl.role = r.role AND rl.lane_id = nl.lane_id
  WHERE nl.type LIKE '%Gateway%' OR n_nodes = 0 OR rn.node_id IS NOT NULL OR rl.lane_id IS NOT NULL),
gb AS (SELECT g.request_id, g.node_id, f.target_id, n.name, f.condition, f.name AS condition_name FROM gs g
  JOIN req r USING (request_id) JOIN cnt USING (request_id) JOIN flows f ON f.source_id = g.node_id
  JOIN nodes n ON n.node_id = f.target_id
  LEFT JOIN rn ON rn.definition_id = r.definition_id AND rn.role = r.role AND rn.node_id = f.target_id
  WHERE g.type LIKE '%Gateway%' AND (n_nodes = 0 OR rn.node_id IS NOT NULL)),
gp AS (SELECT r.request_id, start AS node_id, n.name, n.type, position FROM req r JOIN preds USING (cur)
  JOIN nodes n ON n.node_id = start WHERE position <= 3 AND n.type NOT LIKE '%Gateway%')"""


def _gated(spark, d) -> gating.GatedPosition:
    g = data.process_graph(spark, d)
    rules = gating.default_whitelist(g)
    kept = gating.Rules(
        data.stored(spark, d, "rule-headers", lambda: rules.headers), data.stored(spark, d, "rule-nodes", lambda: rules.nodes)
    )
    return gating.gate_positions(data.stored(spark, d, "positions", lambda: data.positions(spark, d)), g, kept)


@query(
    "gate_positions",
    f"""WITH RECURSIVE {GRAPH}, {_GATED}
SELECT request_id, 'successor' AS part, node_id AS a, coalesce(condition, condition_name, '') AS b FROM gs
UNION ALL SELECT request_id, 'branch', node_id || '>' || target_id, coalesce(condition, condition_name, '') FROM gb
UNION ALL SELECT request_id, 'predecessor', node_id, position::VARCHAR FROM gp""",
)
def gate_positions(spark, d) -> DataFrame:
    view = _gated(spark, d).view
    label = F.coalesce("condition", "condition_name", F.lit("")).alias("b")
    return (
        view.successors.select("request_id", F.lit("successor").alias("part"), F.col("node_id").alias("a"), label)
        .unionByName(view.branches.select(
            "request_id", F.lit("branch").alias("part"), F.concat_ws(">", "gateway_id", "node_id").alias("a"), label))
        .unionByName(view.predecessors.select(
            "request_id", F.lit("predecessor").alias("part"), F.col("node_id").alias("a"),
            F.col("position").cast("string").alias("b")))
    )


@query(
    "gating_metadata",
    f"""WITH RECURSIVE {GRAPH}, {_GATED}
SELECT request_id, 'gating' AS context_type, n_lanes AS num_allowed_lanes, n_nodes AS num_allowed_nodes,
  (SELECT count(*) FROM gs WHERE gs.request_id = r.request_id) AS num_successors,
  (SELECT count(*) FROM gs WHERE gs.request_id = r.request_id AND type LIKE '%Gateway%') AS num_gateways,
  nl.name AS current_node, nl.lane_name AS current_lane
FROM req r JOIN cnt USING (request_id) JOIN nl ON nl.node_id = r.cur""",
)
def gating_metadata(spark, d) -> DataFrame:
    return gating.gating_metadata(_gated(spark, d))


@query(
    "overview_metadata",
    f"""WITH {GRAPH} SELECT process_id, 'overview' AS context_type,
  (SELECT count(*) FROM lanes l WHERE l.process_id = p.process_id) AS num_lanes,
  (SELECT count(*) FROM nodes n WHERE n.process_id = p.process_id AND type LIKE '%Gateway%') AS num_decisions,
  (SELECT count(*) FROM nodes n WHERE n.process_id = p.process_id) AS num_steps FROM procs p""",
)
def overview_metadata(spark, d) -> DataFrame:
    return gating.overview_metadata(graph.overview_full(data.process_graph(spark, d)))


_TYPE = "CASE {0} WHEN 'userTask' THEN ' (manuelle Aufgabe)' ELSE ' (Entscheidung)' END"


@query(
    "gating_hint",
    f"""WITH RECURSIVE {GRAPH}, {_GATED},
before AS (SELECT request_id, string_agg('''' || name || '''' || {_TYPE.format('type')}, ' → ' ORDER BY position) AS v FROM (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY position) AS r FROM gp) WHERE r <= 2 GROUP BY 1),
brs AS (SELECT request_id, node_id, string_agg(chr(10) || '    - Falls ''' || coalesce(condition_name, condition, 'Standard')
  || ''': → ' || name, '' ORDER BY target_id) AS v FROM gb GROUP BY ALL),
after AS (SELECT request_id, string_agg(CASE WHEN type LIKE '%Gateway%' THEN '  - Entweder-Oder ''' || name || ''':'
  || coalesce(brs.v, '') ELSE '  - ''' || name || ''' (manuelle Aufgabe)' || coalesce(' [' || lane_name || ']', '') END,
  chr(10) ORDER BY node_id) AS v FROM gs LEFT JOIN brs USING (request_id, node_id) GROUP BY 1)
SELECT request_id, md5(concat_ws(chr(10),
  'Der Nutzer fragt als **' || r.role || '** im Prozess ''process ' || r.process_id || '''.',
  '**Aktueller Schritt**: ''' || nl.name || '''' || {_TYPE.format('nl.type')}
    || coalesce(', Zuständigkeit: ' || lane_name, ''),
  '**Vorherige Schritte**: ' || before.v, '**Nächste Schritte**:' || chr(10) || after.v,
  chr(10) || '{gating.POSITION_TAIL.strip()}',
  CASE WHEN n_lanes + n_nodes > 0 THEN '{gating.ROLE_TAIL}' END)) AS hint
FROM req r JOIN cnt USING (request_id) JOIN nl ON nl.node_id = r.cur LEFT JOIN before USING (request_id)
LEFT JOIN after USING (request_id)""",
)
def gating_hint(spark, d) -> DataFrame:
    return gating.gating_hint(_gated(spark, d)).withColumn("hint", F.md5("hint"))


@query(
    "overview_hint",
    f"""WITH {GRAPH},
lt AS (SELECT process_id, string_agg(chr(10) || '- **' || lane_name || '**: ' || v, '' ORDER BY lane_name, lane_id) AS v FROM (
  SELECT process_id, lane_id, lane_name, string_agg('''' || name || '''' || {_TYPE.format('type')}, ', ' ORDER BY node_id) AS v
  FROM nl WHERE lane_id IS NOT NULL GROUP BY ALL) GROUP BY 1),
ft AS (SELECT f.process_id, string_agg('''' || a.name || ''' → ''' || b.name || ''''
  || coalesce(' (wenn: ' || coalesce(f.name, condition) || ')', ''), '; ' ORDER BY flow_id) AS v
  FROM flows f JOIN nodes a ON a.node_id = source_id JOIN nodes b ON b.node_id = target_id GROUP BY 1),
gt AS (SELECT process_id, string_agg(chr(10) || '- **' || name || '** (Entweder-Oder)' || coalesce(': ' || v, ''), ''
  ORDER BY node_id) AS v FROM (
  SELECT g.process_id, g.node_id, g.name, string_agg(coalesce('''' || coalesce(f.name, condition) || ''' → ', '→ ')
    || b.name, '; ' ORDER BY flow_id) AS v FROM nodes g LEFT JOIN flows f ON f.source_id = g.node_id
    LEFT JOIN nodes b ON b.node_id = f.target_id WHERE g.type LIKE '%Gateway%' GROUP BY ALL) GROUP BY 1)
SELECT 'none' || conv_id AS process_id, md5('Die Frage bezieht sich auf den Prozess ''lost ' || conv_id || '''.') AS hint
FROM conversations GROUP BY conv_id UNION ALL
SELECT process_id, md5(concat_ws(chr(10), '## Prozess: ' || p.name, chr(10) || '### Rollen und ihre Aufgaben:' || lt.v,
  chr(10) || '### Prozessablauf:' || chr(10) || ft.v, chr(10) || '### Entscheidungspunkte:' || gt.v,
  chr(10) || '{gating.OVERVIEW_TAIL.strip()}')) AS hint
FROM procs p LEFT JOIN lt USING (process_id) LEFT JOIN ft USING (process_id) LEFT JOIN gt USING (process_id)""",
)
def overview_hint(spark, d) -> DataFrame:
    full = graph.overview_full(data.process_graph(spark, d))
    conversation = F.col("conv_id").cast("string")
    lost = data.turns(spark, d).select(
        F.concat(F.lit("none"), conversation).alias("process_id"), F.concat(F.lit("lost "), conversation).alias("name")
    ).distinct()
    return gating.overview_hint(full, lost).withColumn("hint", F.md5("hint"))


@query(
    "predicted_gating",
    """SELECT conv_id, turn, 'L' || (turn % 2) || ',L9' AS lane_ids,
  CASE WHEN turn % 2 = 0 THEN 'N' || turn || ',x' ELSE 'x' END AS node_ids,
  CASE WHEN turn % 2 = 0 THEN 'a,' || role ELSE 'a' END AS task_names FROM conversations""",
)
def predicted_gating(spark, d) -> DataFrame:
    turn = F.col("turn").cast("string")
    lane = F.concat(F.lit("L"), (F.col("turn") % 2).cast("string"))
    named = F.when(
        F.col("turn") % 2 == 0,
        F.concat(F.lit(', {"id": "N'), turn, F.lit('", "name": "'), F.col("role"), F.lit('"}')),
    ).otherwise("")
    meta = F.concat(
        F.lit('{"gating_metadata": {"allowed_lane_ids": ["'), lane, F.lit('"], "allowed_task_names": ["a"], '),
        F.lit('"allowed_lanes": ["L9", {"id": "'), lane, F.lit('"}], "allowed_nodes": ["x"'), named, F.lit("]}}"),
    )
    rows = gating.predicted_gating(data.turns(spark, d).select("conv_id", "turn", meta.alias("meta")))
    return rows.select(
        "conv_id", "turn", *[F.array_join(c, ",").alias(c) for c in ("lane_ids", "node_ids", "task_names")]
    )
