"""Role whitelists, gated positions and their hint texts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions.scale import cut_lineage, top_k
from ragloom.functions.text import joined_in_order, or_null
from ragloom.operators.graph import Graph, PositionView, position_view
from ragloom.sources.evaluation import upsert

# Limits of a gated position and of its hint.
SHOWN_PREDECESSORS = 3
SHOWN_SUCCESSORS = 5
HINT_PREDECESSORS = 2
HINT_SUCCESSORS = 4

# Labels of node and gateway types.
TYPE_LABELS = {
    "userTask": "manuelle Aufgabe",
    "serviceTask": "automatisch",
    "task": "Aufgabe",
    "callActivity": "Unterprozess",
    "startEvent": "Start",
    "endEvent": "Ende",
    "exclusiveGateway": "Entscheidung",
    "parallelGateway": "parallel",
    "inclusiveGateway": "optional",
    "intermediateCatchEvent": "wartet",
    "intermediateThrowEvent": "sendet",
    "boundaryEvent": "Ereignis",
}
GATEWAY_LABELS = {
    "exclusiveGateway": "Entweder-Oder",
    "parallelGateway": "Parallel",
    "inclusiveGateway": "Mehrfachauswahl",
    "eventBasedGateway": "Ereignisbasiert",
}
OTHER_GATEWAY = "Verzweigung"

# Wording of the hints.
UNNAMED_ROLE = "Unbenannte Rolle"
DEFAULT_BRANCH = "Standard"
NO_OVERVIEW = "Die Frage bezieht sich auf den Prozess '"
OVERVIEW_HEAD = "## Prozess: "
OVERVIEW_LANES = "\n### Rollen und ihre Aufgaben:"
OVERVIEW_FLOWS = "\n### Prozessablauf:"
OVERVIEW_GATEWAYS = "\n### Entscheidungspunkte:"
OVERVIEW_TAIL = (
    "\nBeantworte die Frage basierend auf den Dokumenten und dem gesamten Prozesskontext. "
    "Du kannst alle Aspekte des Prozesses, aller Rollen und aller Schritte beschreiben."
)
POSITION_TAIL = (
    "\nBeantworte die Frage aus Sicht dieser Position im Prozess. "
    "Bei Entscheidungspunkten erkläre die möglichen Pfade und deren Bedingungen."
)
ROLE_TAIL = (
    "Fokussiere auf die Aufgaben deiner Rolle. "
    "Erwähne Schritte anderer Rollen nur, wenn sie direkt relevant sind."
)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


# ---- whitelists ----------------------------------------------------------------------------------------------------


def upsert_whitelist(whitelists: DataFrame, specs: DataFrame) -> DataFrame:
    """Store named whitelists by id; missing lists become empty."""
    lists = [c for c, t in specs.dtypes if t.startswith("array")]
    filled = specs.select(
        *[F.coalesce(c, F.array().cast("array<string>")).alias(c) if c in lists else F.col(c) for c in specs.columns]
    )
    return upsert(whitelists, filled, ["id"])


class Rules(NamedTuple):
    """Whitelist rules: one header per (definition, process, lane), and the nodes of each in long form."""

    headers: DataFrame  # definition_id, process_id, lane_id, role
    nodes: DataFrame  # definition_id, process_id, lane_id, node_id


def default_whitelist(graph: Graph) -> Rules:
    """One rule per lane, for the role named like the lane; a definition without lanes gets one rule per process.

    A blank lane name allows no role; the lane of a process-wide rule is '*'.
    """
    owners = graph["processes"].select("process_id", "definition_id")
    lanes = graph["lanes"].join(owners, "process_id")
    by_lane = lanes.select("definition_id", "process_id", "lane_id", or_null(F.col("name")).alias("role")).distinct()
    lane_nodes = by_lane.drop("role").join(graph["lane_members"], "lane_id").join(
        graph["nodes"].select("node_id"), "node_id", "left_semi"
    )
    laneless = owners.join(lanes.select("definition_id"), "definition_id", "left_anti").join(
        graph["nodes"].select("process_id"), "process_id", "left_semi"
    )
    by_process = laneless.select(
        "definition_id", "process_id", F.lit("*").alias("lane_id"), F.lit(None).cast("string").alias("role")
    )
    process_nodes = by_process.drop("role").join(graph["nodes"].select("process_id", "node_id"), "process_id")
    return Rules(
        by_lane.unionByName(by_process),
        lane_nodes.select("definition_id", "process_id", "lane_id", "node_id").distinct().unionByName(
            process_nodes.select("definition_id", "process_id", "lane_id", "node_id").distinct()
        ),
    )


def list_rules(rules: Rules) -> DataFrame:
    """Rules by process and lane with the number of their nodes."""
    counts = rules.nodes.groupBy("definition_id", "process_id", "lane_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return (
        rules.headers.join(counts, ["definition_id", "process_id", "lane_id"], "left")
        .fillna(0, ["n_nodes"])
        .orderBy("definition_id", "process_id", "lane_id")
    )


def allowed_for_roles(rules: Rules, principals: DataFrame) -> DataFrame:
    """Lanes and nodes open to sets of roles: (definition_id, roles_key, kind, id), distinct.

    principals: definition_id, roles. Equal role sets of a definition share one `roles_key`. All matching rules are
    united; no roles allow nothing.
    """
    key = roles_key(F.col("roles"))
    asked = principals.filter(F.size("roles") > 0).select("definition_id", key.alias("roles_key"), "roles")
    asked = asked.dropDuplicates(["definition_id", "roles_key"]).withColumn("role", F.explode("roles")).drop("roles")
    matched = (
        rules.headers.join(asked, ["definition_id", "role"])
        .select("definition_id", "roles_key", "process_id", "lane_id")
        .distinct()
    )
    lanes = matched.select("definition_id", "roles_key", F.lit("lane").alias("kind"), F.col("lane_id").alias("id"))
    nodes = matched.join(rules.nodes, ["definition_id", "process_id", "lane_id"]).select(
        "definition_id", "roles_key", F.lit("node").alias("kind"), F.col("node_id").alias("id")
    )
    return lanes.distinct().unionByName(nodes.distinct())


def roles_key(roles: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(roles)), "\u001f")


def allowed_union(whitelists: DataFrame, graph: Graph, ids: DataFrame) -> DataFrame:
    """Nodes and types open to each (process_id, whitelist id) of `ids`: (process_id, kind, id), distinct.

    Nodes come directly or through an allowed lane, and must belong to the process.
    """
    chosen = whitelists.join(ids.select("process_id", "id").distinct(), ["process_id", "id"], "left_semi")
    own = graph["nodes"].select("process_id", "node_id")

    def exploded(column: str, name: str) -> DataFrame:
        return chosen.select("process_id", F.explode(column).alias(name)).distinct()

    direct = exploded("allow_nodes", "node_id").join(own, ["process_id", "node_id"], "left_semi")
    lanes = exploded("allow_lanes", "lane_id").join(
        graph["lanes"].select("process_id", "lane_id"), ["process_id", "lane_id"], "left_semi"
    )
    via = lanes.join(graph["lane_members"], "lane_id").select("process_id", "node_id").join(
        own, ["process_id", "node_id"], "left_semi"
    )
    nodes = direct.unionByName(via).select("process_id", F.lit("node").alias("kind"), F.col("node_id").alias("id"))
    types = exploded("allow_types", "id").select("process_id", F.lit("type").alias("kind"), "id")
    return nodes.unionByName(types).distinct()


def next_allowed(graph: Graph, allowed: DataFrame, positions: DataFrame, max_depth: int = 1) -> DataFrame:
    """Allowed nodes within 1..max_depth hops, one row per path; order by hops, name.

    allowed: see `allowed_union`; positions: request_id, process_id, node_id. A path uses no edge twice. Where types
    are listed for the process, only those pass. Only edges that can still lead to such a node are followed.
    """
    own = graph["nodes"].select("process_id", "node_id")
    nodes = allowed.filter(F.col("kind") == "node").select("process_id", F.col("id").alias("node_id"))
    typed = allowed.filter(F.col("kind") == "type")
    restricted = typed.select("process_id", F.lit(True).alias("_restricted")).distinct()
    matching = typed.select("process_id", F.col("id").alias("type"), F.lit(True).alias("_listed"))
    targets = (
        graph["nodes"].select("process_id", "node_id", "name", "type")
        .join(nodes, ["process_id", "node_id"], "left_semi")
        .join(restricted, "process_id", "left")
        .join(matching, ["process_id", "type"], "left")
        .filter(F.col("_restricted").isNull() | F.col("_listed"))
        .select("process_id", "node_id", "name", "type")
    )
    paths = positions.join(own, ["process_id", "node_id"], "left_semi").select(
        "request_id", "process_id", F.col("node_id").alias("at"), F.array().cast("array<string>").alias("used")
    )
    moves = _moves_to(targets, graph["flows"], max_depth)
    found = None
    for hop in range(1, max_depth + 1):
        paths = (
            paths.join(moves.filter(F.col("left") <= max_depth - hop), ["process_id", "at"])
            .filter(~F.array_contains("used", F.col("flow_id")))
            .select(
                "request_id", "process_id", F.col("to").alias("at"), F.array_append("used", F.col("flow_id")).alias("used")
            )
        )
        ends = paths.select("request_id", "process_id", F.col("at").alias("node_id"), F.lit(hop).alias("hops"))
        found = ends if found is None else found.unionByName(ends)
    return found.join(targets, ["process_id", "node_id"]).select(
        "request_id", "process_id", "node_id", "name", "type", "hops"
    )


def _moves_to(targets: DataFrame, flows: DataFrame, max_depth: int) -> DataFrame:
    """Edges from which a target may still be reached: process_id, at, to, flow_id, left (fewest edges from `to`).

    The sets grow backwards from the targets, one join a hop, and hold each node once per process; a path follows only
    edges whose `left` fits into the hops it has, so paths that lead nowhere are never built.
    """
    edges = flows.select(F.col("source_id").alias("at"), F.col("target_id").alias("to"), "flow_id")
    ahead = targets.select("process_id", F.col("node_id").alias("to"), F.lit(0).alias("left")).distinct()
    ends = edges.select("at").union(edges.select("to")).distinct()
    back = edges.select("at", "to", F.lit(1).alias("cost")).distinct().union(ends.select("at", "at", F.lit(0)))
    for _ in range(max_depth - 1):
        ahead = (
            ahead.join(back, "to")
            .groupBy("process_id", F.col("at").alias("to"))
            .agg(F.min(F.col("left") + F.col("cost")).alias("left"))
        )
    moves = edges.join(ahead, "to").select("process_id", "at", "to", "flow_id", "left")
    return moves if max_depth == 1 else cut_lineage(moves)


# ---- gating --------------------------------------------------------------------------------------------------------


def gating_mode(current_node_id: Column, force_process_context: Column) -> Column:
    """A selected node means gating; otherwise forced context means process; otherwise none."""
    return (
        F.when(F.length(current_node_id) > 0, "gating")
        .when(F.coalesce(force_process_context, F.lit(False)), "process")
        .otherwise("none")
    )


def mode_for_scope(process: Column, has_model: Column, scope: Column, has_task: Column) -> Column:
    """Mode of a client's selection: no process, documents only, overview, or a step."""
    return (
        F.when(F.coalesce(F.length(process), F.lit(0)) == 0, "NONE")
        .when((scope == "docs") | ~F.coalesce(has_model, F.lit(False)), "DOCS_ONLY")
        .when((scope == "step") & F.coalesce(has_task, F.lit(False)), "GATING_ENABLED")
        .otherwise("PROCESS_CONTEXT")
    )


class GatedPosition(NamedTuple):
    """A position view after the whitelist; `requests` carries the allowed counts."""

    requests: DataFrame  # request_id, process_name, roles, n_lanes, n_nodes
    view: PositionView


def gate_positions(requests: DataFrame, graph: Graph, rules: Rules) -> GatedPosition:
    """Apply the rules of each request's roles to its position.

    requests: request_id, process_id, definition_id, current_node_id, process_name, roles. Of the first three
    predecessors gateways are removed. A successor passes if its node or lane is allowed, or if no node is listed at
    all; gateways always pass with their branches filtered by node. At most five successors remain, by flow order of
    their id.
    """
    # Read three times below, and far smaller than the requests.
    allowed = cut_lineage(allowed_for_roles(rules, requests))
    keys = ["definition_id", "roles_key"]
    counts = allowed.groupBy(*keys).agg(
        F.count_if(F.col("kind") == "lane").alias("n_lanes"), F.count_if(F.col("kind") == "node").alias("n_nodes")
    )
    keyed = requests.withColumn("roles_key", roles_key(F.col("roles")))
    asked = keyed.join(counts, keys, "left").fillna(0, ["n_lanes", "n_nodes"])
    view = position_view(graph, requests)

    context = asked.select("request_id", *keys, "n_lanes", "n_nodes")
    nodes = allowed.filter(F.col("kind") == "node").select(*keys, F.col("id").alias("node_id"), F.lit(True).alias("_n"))
    lanes = allowed.filter(F.col("kind") == "lane").select(*keys, F.col("id").alias("lane_id"), F.lit(True).alias("_l"))

    predecessors = view.predecessors.filter(
        (F.col("position") <= SHOWN_PREDECESSORS) & ~F.contains("type", F.lit("Gateway"))
    )
    judged = (
        view.successors.join(context, "request_id")
        .join(nodes, [*keys, "node_id"], "left")
        .join(lanes, [*keys, "lane_id"], "left")
    )
    free = (F.col("n_nodes") == 0)
    passing = judged.filter(F.col("is_gateway") | free | F.col("_n") | F.col("_l")).drop(
        *keys, "n_lanes", "n_nodes", "_n", "_l"
    )
    order = [F.col("node_id"), F.col("condition").asc_nulls_first(), F.col("condition_name").asc_nulls_first(),
             F.col("lane_id").asc_nulls_first()]
    successors = top_k(passing, ["request_id"], order, SHOWN_SUCCESSORS, "position")
    branches = (
        view.branches.join(context, "request_id")
        .join(nodes, [*keys, "node_id"], "left")
        .filter(free | F.col("_n"))
        .drop(*keys, "n_lanes", "n_nodes", "_n")
        .join(successors.select("request_id", F.col("node_id").alias("gateway_id")), ["request_id", "gateway_id"],
              "left_semi")
    )
    return GatedPosition(
        asked.select("request_id", "process_name", "roles", "n_lanes", "n_nodes"),
        PositionView(view.current, predecessors, successors, branches),
    )


def gating_metadata(gated: GatedPosition) -> DataFrame:
    """Counts and labels of a gated position, one row per request."""
    following = gated.view.successors.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("num_successors"), F.count_if("is_gateway").alias("num_gateways")
    )
    current = gated.view.current.groupBy("request_id").agg(
        F.min(F.coalesce(or_null(F.col("name")), F.col("node_id"))).alias("current_node"),
        F.min("lane_name").alias("current_lane"),
    )
    return (
        gated.requests.select(
            "request_id", F.lit("gating").alias("context_type"),
            F.col("n_lanes").alias("num_allowed_lanes"), F.col("n_nodes").alias("num_allowed_nodes"),
        )
        .join(following, "request_id", "left")
        .fillna(0, ["num_successors", "num_gateways"])
        .join(current, "request_id", "left")
    )


def overview_metadata(overview: dict[str, DataFrame]) -> DataFrame:
    """Counts of a process overview, one row per process."""
    lanes = overview["lane_nodes"].groupBy("process_id").agg(
        F.count_distinct("lane_id").alias("num_lanes"), F.count("node_id").alias("_laned")
    )
    loose = overview["nodes_without_lane"].groupBy("process_id").agg(F.count(F.lit(1)).alias("_loose"))
    gateways = overview["gateways"].groupBy("process_id").agg(F.count_distinct("gateway_id").alias("num_decisions"))
    rows = overview["processes"].select("process_id", F.lit("overview").alias("context_type"))
    for part in (lanes, loose, gateways):
        rows = rows.join(part, "process_id", "left")
    rows = rows.fillna(0)
    return rows.withColumn("num_steps", F.col("_laned") + F.col("_loose")).drop("_laned", "_loose")


def _quoted(name: Column) -> Column:
    return F.concat(F.lit("'"), name, F.lit("'"))


def _typed(kind: Column) -> Column:
    """' (label)' of a node type, or nothing."""
    label = _lookup(TYPE_LABELS, kind)
    return F.coalesce(F.concat(F.lit(" ("), label, F.lit(")")), F.lit(""))


def _display() -> Column:
    return F.coalesce(or_null(F.col("name")), F.col("node_id"))


def _gateway_label(kind: Column) -> Column:
    return F.coalesce(_lookup(GATEWAY_LABELS, kind), F.lit(OTHER_GATEWAY))


def gating_hint(gated: GatedPosition) -> DataFrame:
    """Hint text per request: role, current step, up to two predecessors and four successors with branches."""
    roles = F.array_join("roles", ", ")
    process = F.coalesce("process_name", F.lit("None"))
    head = F.when(
        F.size("roles") > 0,
        F.concat(F.lit("Der Nutzer fragt als **"), roles, F.lit("** im Prozess '"), process, F.lit("'.")),
    ).otherwise(F.concat(F.lit("Kontext: Prozess '"), process, F.lit("'.")))

    lane = F.coalesce(F.concat(F.lit(", Zuständigkeit: "), or_null(F.col("lane_name"))), F.lit(""))
    about = F.coalesce(F.concat(F.lit(". "), or_null(F.col("description"))), F.lit(""))
    current = gated.view.current.groupBy("request_id").agg(
        F.min(
            F.concat(F.lit("**Aktueller Schritt**: "), _quoted(_display()), _typed(F.col("type")), lane, about)
        ).alias("_current")
    )
    # The two first of those left after gateways were taken out.
    ranked = top_k(
        gated.view.predecessors.withColumnRenamed("position", "_place"), ["request_id"], [F.col("_place")],
        HINT_PREDECESSORS, "position",
    )
    before = ranked.groupBy("request_id").agg(
        joined_in_order(F.col("position"), F.concat(_quoted(_display()), _typed(F.col("type"))), " → ").alias("_before")
    )
    branch = F.concat(
        F.lit("\n    - Falls '"),
        F.coalesce(or_null(F.col("condition_name")), or_null(F.col("condition")), F.lit(DEFAULT_BRANCH)),
        F.lit("': → "), _display(),
    )
    branch_order = F.struct(
        "node_id", F.coalesce("condition", F.lit("")).alias("c"), F.coalesce("condition_name", F.lit("")).alias("n")
    )
    branches = gated.view.branches.groupBy("request_id", F.col("gateway_id").alias("node_id")).agg(
        joined_in_order(branch_order, branch, "").alias("_branches")
    )
    shown = gated.view.successors.filter(F.col("position") <= HINT_SUCCESSORS).join(
        branches, ["request_id", "node_id"], "left"
    )
    lane_hint = F.coalesce(F.concat(F.lit(" ["), or_null(F.col("lane_name")), F.lit("]")), F.lit(""))
    line = F.when(
        F.col("is_gateway"),
        F.concat(F.lit("  - "), _gateway_label(F.col("type")), F.lit(" "), _quoted(_display()), F.lit(":"),
                 F.coalesce("_branches", F.lit(""))),
    ).otherwise(F.concat(F.lit("  - "), _quoted(_display()), _typed(F.col("type")), lane_hint))
    after = shown.groupBy("request_id").agg(joined_in_order(F.col("position"), line, "\n").alias("_after"))
    rows = gated.requests
    for part in (current, before, after):
        rows = rows.join(part, "request_id", "left")
    restricted = (F.col("n_lanes") > 0) | (F.col("n_nodes") > 0)
    return rows.select(
        "request_id",
        F.concat_ws(
            "\n",
            head,
            "_current",
            F.concat(F.lit("**Vorherige Schritte**: "), F.col("_before")),
            F.concat(F.lit("**Nächste Schritte**:\n"), F.col("_after")),
            F.lit(POSITION_TAIL),
            F.when(restricted, F.lit(ROLE_TAIL)),
        ).alias("hint"),
    )


def overview_hint(overview: dict[str, DataFrame], asked: DataFrame | None = None) -> DataFrame:
    """Hint text per process from `graph.overview_full`; one text is one prompt, so a process is put together whole.

    The heading of the lanes is there as soon as the process has one, with or without tasks. `asked` (process_id, name)
    names further processes; those without an overview get a sentence with their name.
    """
    entry = F.concat(_quoted(_display()), _typed(F.col("type")))
    lanes = (
        overview["lane_nodes"].filter(F.col("node_id").isNotNull())
        .groupBy("process_id", "lane_id", "lane_name")
        .agg(joined_in_order(F.col("node_id"), entry, ", ").alias("_tasks"))
    )
    role = F.coalesce(or_null(F.col("lane_name")), F.lit(UNNAMED_ROLE))
    lane_line = F.concat(F.lit("\n- **"), role, F.lit("**: "), F.col("_tasks"))
    lane_text = lanes.groupBy("process_id").agg(
        joined_in_order(F.struct("lane_name", "lane_id"), lane_line, "").alias("_lanes")
    )
    condition = F.coalesce(F.concat(F.lit(" (wenn: "), or_null(F.col("condition")), F.lit(")")), F.lit(""))
    step = F.concat(_quoted(F.col("from")), F.lit(" → "), _quoted(F.col("to")), condition)
    flow_text = overview["flows"].groupBy("process_id").agg(
        joined_in_order(F.col("flow_id"), step, "; ").alias("_flows")
    )
    path = F.concat(
        F.coalesce(F.concat(_quoted(or_null(F.col("condition"))), F.lit(" → ")), F.lit("→ ")), F.col("target")
    )
    decisions = overview["gateways"].groupBy("process_id", "gateway_id", "name", "type").agg(
        joined_in_order(F.col("flow_id"), path, "; ").alias("_paths")
    )
    decision = F.concat(
        F.lit("\n- **"), F.coalesce(or_null(F.col("name")), F.col("gateway_id")), F.lit("** ("),
        _gateway_label(F.col("type")), F.lit(")"),
        F.coalesce(F.concat(F.lit(": "), or_null(F.col("_paths"))), F.lit("")),
    )
    gateway_text = decisions.groupBy("process_id").agg(
        joined_in_order(F.col("gateway_id"), decision, "").alias("_gateways")
    )
    with_lanes = overview["lane_nodes"].filter(F.col("lane_id").isNotNull()).select("process_id").distinct().withColumn(
        "_has_lanes", F.lit(True)
    )
    rows = overview["processes"]
    for part in (lane_text, flow_text, gateway_text, with_lanes):
        rows = rows.join(part, "process_id", "left")
    hints = rows.select(
        "process_id",
        F.concat_ws(
            "\n",
            F.concat(F.lit(OVERVIEW_HEAD), F.col("name")),
            F.when(F.col("_has_lanes"), F.concat(F.lit(OVERVIEW_LANES), F.coalesce("_lanes", F.lit("")))),
            F.concat(F.lit(OVERVIEW_FLOWS + "\n"), F.col("_flows")),
            F.concat(F.lit(OVERVIEW_GATEWAYS), F.col("_gateways")),
            F.lit(OVERVIEW_TAIL),
        ).alias("hint"),
    )
    if asked is None:
        return hints
    unknown = asked.select("process_id", "name").join(hints.select("process_id"), "process_id", "left_anti")
    sentence = F.concat(F.lit(NO_OVERVIEW), F.col("name"), F.lit("'."))
    return hints.unionByName(unknown.select("process_id", sentence.alias("hint")))


_PREDICTED = """allowed_lane_ids array<string>, allowed_node_ids array<string>, allowed_task_names array<string>,
allowed_lanes array<string>, allowed_nodes array<string>"""


def predicted_gating(run_items: DataFrame, meta: str = "meta") -> DataFrame:
    """Gating elements named in recorded response metadata, without duplicates.

    Reads `gating_metadata` of the JSON column `meta`; the entries of allowed_lanes and allowed_nodes are ids or
    objects with id and name. Adds lane_ids, node_ids, task_names.
    """
    parsed = F.from_json(F.get_json_object(meta, "$.gating_metadata"), _PREDICTED)
    none = F.array().cast("array<string>")

    def listed(name: str) -> Column:
        return F.coalesce(parsed[name], none)

    def object_field(items: Column, field: str) -> Column:
        return F.transform(items, lambda x: or_null(F.get_json_object(x, f"$.{field}")))

    def ids(items: Column) -> Column:
        return F.transform(
            items, lambda x: F.when(x.startswith("{"), or_null(F.get_json_object(x, "$.id"))).otherwise(or_null(x))
        )

    def union(*parts: Column) -> Column:
        return F.array_sort(F.array_distinct(F.array_compact(F.concat(*parts))))

    return run_items.select(
        "*",
        union(listed("allowed_lane_ids"), ids(listed("allowed_lanes"))).alias("lane_ids"),
        union(listed("allowed_node_ids"), ids(listed("allowed_nodes"))).alias("node_ids"),
        union(listed("allowed_task_names"), object_field(listed("allowed_nodes"), "name")).alias("task_names"),
    )
