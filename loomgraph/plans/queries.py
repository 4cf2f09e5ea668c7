"""The registered queries of the graph engine with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.operators import budget, corpus as co, diff, graph, text, validate
from loomgraph.operators.corpus import Corpus
from loomgraph.plans.projections import duck, projected

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def small(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus of conversations."""
    t = lambda n: projected(spark, sf_dir, f"w_{n}")
    return Corpus(t("nodes"), t("edges"), t("registry"), t("ports"), t("depends"), t("failures"), t("variables"), t("contexts"))


_FIRST = "fn AS (SELECT doc_id, id, arg_min(type, ord) AS type, min(ord) AS ord FROM w_nodes GROUP BY doc_id, id)"
_SOUND = f"{_FIRST}, sound AS (SELECT e.*, s.type AS st, t.type AS tt, s.ord AS so, t.ord AS t_o FROM w_edges e JOIN fn s ON e.doc_id = s.doc_id AND e.source = s.id JOIN fn t ON e.doc_id = t.doc_id AND e.target = t.id)"


@query(f"WITH {duck('w_nodes')} SELECT doc_id, ord, id, type, 'entry' AS role FROM w_nodes WHERE type = 'input' UNION ALL SELECT doc_id, ord, id, type, 'terminal' FROM w_nodes WHERE type = 'output' UNION ALL SELECT doc_id, ord, id, type, 'agent or llm' FROM w_nodes WHERE type IN ('agent', 'llm')")
def f3_nodes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = projected(spark, sf_dir, "w_nodes").select("doc_id", "ord", "id", "type")
    parts = [(co.entry_points(nodes), "entry"), (co.terminals(nodes), "terminal"), (co.nodes_of_type(nodes, "agent", "llm"), "agent or llm")]
    out = [df.withColumn("role", F.lit(role)) for df, role in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {duck('w_nodes', 'w_edges')} SELECT e.doc_id, e.ord, e.id, e.source, e.target, e.type FROM w_edges e WHERE e.type IN ('calls', 'passes') AND EXISTS (SELECT 1 FROM w_nodes n WHERE n.doc_id = e.doc_id AND n.id = e.source AND n.type = 'input')")
def f5_out_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = projected(spark, sf_dir, "w_nodes"), projected(spark, sf_dir, "w_edges")
    return co.edges_of(edges, "source", co.entry_points(nodes), "calls", "passes").select("doc_id", "ord", "id", "source", "target", "type")


@query(f"WITH {duck('w_nodes')} SELECT doc_id, id, coalesce(method = 'ai_inference', FALSE) AS inferred, coalesce(method <> 'ai_inference', TRUE) OR reviewed_by IS NOT NULL AS trusted FROM w_nodes")
def f7_trust_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = projected(spark, sf_dir, "w_nodes")
    inferred = F.coalesce(graph.is_inferred(), F.lit(False))
    return nodes.select("doc_id", "id", inferred.alias("inferred"), (~inferred | F.col("reviewed_by").isNotNull()).alias("trusted"))


@query(f"""WITH {duck('r_nodes', 'r_registry')}, k AS (SELECT n.*, CASE type WHEN 'llm' THEN 'models' WHEN 'tool' THEN 'tools' WHEN 'prompt' THEN 'prompts' END AS registry FROM r_nodes n)
    SELECT k.doc_id, k.ord, k.id, k.type, k.ref, k.registry, r.id AS entry FROM k LEFT JOIN (SELECT DISTINCT doc_id, registry, id FROM r_registry) r ON r.doc_id = k.doc_id AND r.registry = k.registry AND r.id = k.ref""")
def j1_resolved_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.resolved_refs(projected(spark, sf_dir, "r_nodes"), projected(spark, sf_dir, "r_registry"))


@query(f"WITH {duck('w_nodes', 'w_edges')}, {_FIRST} SELECT e.doc_id, e.ord, e.source, e.target, n.id AS node, n.type AS node_type FROM w_edges e LEFT JOIN fn n ON n.doc_id = e.doc_id AND n.id = e.target")
def j2_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = small(spark, sf_dir)
    return co.neighbours(c.edges, c.nodes).select("doc_id", "ord", "source", "target", "node", "node_type")


@query(f"WITH RECURSIVE {duck('w_nodes', 'w_edges')}, reach AS (SELECT doc_id, id FROM w_nodes WHERE type = 'input' UNION SELECT e.doc_id, e.target FROM reach r JOIN w_edges e ON e.doc_id = r.doc_id AND e.source = r.id) SELECT doc_id, id FROM reach")
def g1_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = small(spark, sf_dir)
    return graph.reachable_from(c.edges, co.entry_points(c.nodes))


@query(f"WITH RECURSIVE {duck('e_nodes', 'e_edges')}, reach AS (SELECT doc_id, id FROM e_nodes WHERE type = 'input' UNION SELECT e.doc_id, e.target FROM reach r JOIN e_edges e ON e.doc_id = r.doc_id AND e.source = r.id) SELECT doc_id, id FROM reach")
def g1_reachable_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable_from(projected(spark, sf_dir, "e_edges"), co.entry_points(projected(spark, sf_dir, "e_nodes")))


@query(f"WITH RECURSIVE {duck('w_nodes', 'w_edges')}, reach AS (SELECT doc_id, id FROM w_nodes WHERE type = 'input' UNION SELECT e.doc_id, e.target FROM reach r JOIN w_edges e ON e.doc_id = r.doc_id AND e.source = r.id) SELECT n.doc_id, n.ord, n.id, n.type FROM w_nodes n WHERE EXISTS (SELECT 1 FROM w_nodes i WHERE i.doc_id = n.doc_id AND i.type = 'input') AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.doc_id = n.doc_id AND r.id = n.id)")
def g2_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = small(spark, sf_dir)
    return graph.unreachable(c.nodes, c.edges).select("doc_id", "ord", "id", "type")


_PATHS = f"""{duck('w_nodes', 'w_edges')}, walk AS (
      SELECT i.doc_id, i.ord AS so, o.ord AS go, o.id AS goal, i.id AS cur, [i.id] AS nodes, CAST([] AS VARCHAR[]) AS eids, CAST([] AS BIGINT[]) AS ords FROM w_nodes i JOIN w_nodes o ON i.doc_id = o.doc_id AND i.type = 'input' AND o.type = 'output'
      UNION ALL SELECT w.doc_id, w.so, w.go, w.goal, e.target, list_append(w.nodes, e.target), list_append(w.eids, e.id), list_append(w.ords, e.ord) FROM walk w JOIN w_edges e ON e.doc_id = w.doc_id AND e.source = w.cur WHERE w.cur <> w.goal AND NOT list_contains(w.nodes, e.target)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY so, go, ords) AS place FROM walk WHERE cur = goal)"""


@query(f"WITH RECURSIVE {_PATHS} SELECT doc_id, place, array_to_string(nodes, '>') AS nodes, array_to_string(eids, '>') AS edges FROM placed WHERE place <= 1000")
def g4_paths_to_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = small(spark, sf_dir)
    found = graph.paths_to_outputs(c.nodes, c.edges)
    return found.select("doc_id", "place", F.array_join("nodes", ">").alias("nodes"), F.array_join("edge_ids", ">").alias("edges"))


@query(f"""WITH RECURSIVE {_PATHS}, {_FIRST}, fe AS (SELECT doc_id, id, arg_min(type, ord) AS type FROM w_edges GROUP BY doc_id, id),
    x AS (SELECT doc_id, place, unnest(range(1, len(nodes) + 1)) AS i, nodes, eids FROM placed WHERE place <= 1000)
    SELECT x.doc_id, x.place, string_agg(coalesce(n.id || '(' || n.type || ')', x.nodes[x.i]) || CASE WHEN x.i <= len(x.eids) THEN ' --' || coalesce(e.type, '?') || '-->' ELSE '' END, ' ' ORDER BY x.i) AS text
    FROM x LEFT JOIN fn n ON n.doc_id = x.doc_id AND n.id = x.nodes[x.i] LEFT JOIN fe e ON e.doc_id = x.doc_id AND e.id = x.eids[x.i] GROUP BY x.doc_id, x.place""")
def g5_rendered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = small(spark, sf_dir)
    return graph.rendered_paths(graph.stored(graph.paths_to_outputs(c.nodes, c.edges)), c.nodes, c.edges)


@query(f"WITH {duck('w_nodes', 'w_edges')}, ends AS (SELECT doc_id, source AS id FROM w_edges WHERE type = 'retrieves' UNION SELECT doc_id, target FROM w_edges WHERE type = 'retrieves') SELECT doc_id, ord, id, type FROM w_nodes n WHERE type IN ('retriever', 'vector_store') OR EXISTS (SELECT 1 FROM ends e WHERE e.doc_id = n.doc_id AND e.id = n.id)")
def g6_rag_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = small(spark, sf_dir)
    return graph.rag_components(c.nodes, c.edges).select("doc_id", "ord", "id", "type")


@query(f"""WITH RECURSIVE {duck('w_nodes', 'w_edges')}, {_FIRST}, reach AS (
      SELECT doc_id, id AS agent, id, 'seed' AS type FROM fn WHERE type = 'agent'
      UNION SELECT r.doc_id, r.agent, n.id, n.type FROM reach r JOIN w_edges e ON e.doc_id = r.doc_id AND e.source = r.id JOIN fn n ON n.doc_id = e.doc_id AND n.id = e.target WHERE r.type <> 'agent' AND n.id <> r.agent)
    SELECT doc_id, agent, id AS tool FROM reach WHERE type = 'tool'""")
def g7_agents_using_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = small(spark, sf_dir)
    return graph.agents_using_tools(c.nodes, c.edges)


@query(f"WITH {duck('w_failures')} SELECT doc_id, carrier, carrier_ord, ord, carrier_id AS subject, description AS detail, source, inferred FROM w_failures WHERE handled = FALSE OR (handled IS NULL AND coalesce(handler_node, '') = '')")
def g8_unhandled_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unhandled_failures(projected(spark, sf_dir, "w_failures"))


@query(f"""WITH {duck('w_nodes', 'w_edges', 'w_registry', 'w_contexts')}, el AS (
      SELECT doc_id, 'node' AS kind, id, method, confidence, has_evidence, reviewed_by, NULL AS notes FROM w_nodes UNION ALL SELECT doc_id, 'edge', id, method, confidence, has_evidence, reviewed_by, NULL FROM w_edges
      UNION ALL SELECT doc_id, left(registry, length(registry) - 1), id, method, confidence, has_evidence, reviewed_by, NULL FROM w_registry UNION ALL SELECT doc_id, kind || '.ai_context', id, method, confidence, has_evidence, reviewed_by, notes FROM w_contexts)
    SELECT doc_id, kind || ':' || id AS subject, concat_ws('; ', CASE WHEN confidence < 0.6 THEN 'low confidence' END, CASE WHEN NOT has_evidence THEN 'no evidence' END) AS detail, notes AS source
    FROM el WHERE method = 'ai_inference' AND coalesce(reviewed_by, '') = '' AND (confidence < 0.6 OR NOT has_evidence)""")
def g9_low_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.low_trust(small(spark, sf_dir))


@query(f"""WITH RECURSIVE {duck('w_nodes', 'w_edges')}, targets AS (SELECT DISTINCT doc_id, id FROM w_nodes WHERE type IN ('vector_store', 'tool', 'llm')), reach AS (
      SELECT doc_id, id AS failed, id FROM targets UNION SELECT t.doc_id, t.id, e.source FROM targets t JOIN w_edges e ON e.doc_id = t.doc_id AND e.target = t.id AND e.type IN ('retrieves', 'uses')
      UNION SELECT r.doc_id, r.failed, e.target FROM reach r JOIN w_edges e ON e.doc_id = r.doc_id AND e.source = r.id)
    SELECT r.doc_id, r.failed, n.id, n.type, n.ord FROM (SELECT DISTINCT * FROM reach) r JOIN w_nodes n ON n.doc_id = r.doc_id AND n.id = r.id WHERE r.failed <> r.id""")
def g10_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = small(spark, sf_dir)
    return graph.impact_of(c.nodes, c.edges, co.nodes_of_type(c.nodes, "vector_store", "tool", "llm"))


@query(f"""WITH RECURSIVE {_PATHS.replace(duck('w_nodes', 'w_edges'), duck('w_nodes', 'w_edges', 'w_registry'))}, docs AS (SELECT DISTINCT doc_id FROM w_nodes),
    nt AS (SELECT doc_id, string_agg(type || '=' || c, ',' ORDER BY type || '=' || c) AS v FROM (SELECT doc_id, type, count(*) AS c FROM w_nodes GROUP BY ALL) GROUP BY doc_id),
    et AS (SELECT doc_id, string_agg(type || '=' || c, ',' ORDER BY type || '=' || c) AS v FROM (SELECT doc_id, type, count(*) AS c FROM w_edges GROUP BY ALL) GROUP BY doc_id)
    SELECT d.doc_id, (SELECT count(*) FROM w_nodes n WHERE n.doc_id = d.doc_id) AS nodes, (SELECT count(*) FROM w_edges e WHERE e.doc_id = d.doc_id) AS edges,
      coalesce(nt.v, '') AS node_types, coalesce(et.v, '') AS edge_types,
      coalesce((SELECT string_agg(id, ',' ORDER BY ord) FROM w_nodes n WHERE n.doc_id = d.doc_id AND type = 'input'), '') AS entry_points,
      coalesce((SELECT string_agg(id, ',' ORDER BY ord) FROM w_nodes n WHERE n.doc_id = d.doc_id AND type = 'output'), '') AS terminals,
      (SELECT count(*) FROM placed p WHERE p.doc_id = d.doc_id AND p.place <= 1000) AS paths_to_output,
      (SELECT count(*) FROM w_registry r WHERE r.doc_id = d.doc_id AND registry = 'prompts') AS prompts, (SELECT count(*) FROM w_registry r WHERE r.doc_id = d.doc_id AND registry = 'models') AS models,
      (SELECT count(*) FROM w_registry r WHERE r.doc_id = d.doc_id AND registry = 'tools') AS tools, (SELECT count(*) FROM w_registry r WHERE r.doc_id = d.doc_id AND registry = 'data_sources') AS data_sources,
      (SELECT count(*) FROM w_nodes n WHERE n.doc_id = d.doc_id AND method = 'ai_inference') + (SELECT count(*) FROM w_edges e WHERE e.doc_id = d.doc_id AND method = 'ai_inference') AS inferred_elements
    FROM docs d LEFT JOIN nt ON nt.doc_id = d.doc_id LEFT JOIN et ON et.doc_id = d.doc_id""")
def a1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.summary(small(spark, sf_dir))


_RULES_SQL = " UNION ALL ".join(f"SELECT '{e}' AS etype, '{side}' AS side, '{n}' AS ntype" for side, t in (("source", rules.EDGE_SOURCES), ("target", rules.EDGE_TARGETS)) for e, ns in t.items() for n in ns)
_V = {
    "duplicate_ids": """SELECT doc_id, 1 AS rule_ord, ord AS item_ord, 'AF201' AS code, '$[''nodes''][' || ord || ']' AS path FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY ord) AS n FROM w_nodes) WHERE n > 1
        UNION ALL SELECT doc_id, 2, ord, 'AF202', '$[''edges''][' || ord || ']' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY ord) AS n FROM w_edges) WHERE n > 1
        UNION ALL SELECT doc_id, 3, place, 'AF203', '$[''' || registry || '''][' || place || ']' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, registry, id ORDER BY ord, place) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, registry ORDER BY ord, id) - 1 AS place FROM w_registry)) WHERE n > 1""",
    "broken_refs": """SELECT doc_id, 4 AS rule_ord, ord AS item_ord, CASE WHEN registry IS NULL THEN 'AF221' ELSE 'AF220' END AS code, '$[''nodes''][' || ord || '][''ref'']' AS path
        FROM (SELECT *, CASE type WHEN 'llm' THEN 'models' WHEN 'tool' THEN 'tools' WHEN 'prompt' THEN 'prompts' WHEN 'vector_store' THEN 'data_sources' WHEN 'retriever' THEN 'data_sources' END AS registry FROM w_nodes WHERE ref IS NOT NULL) n
        WHERE registry IS NULL OR NOT EXISTS (SELECT 1 FROM w_registry r WHERE r.doc_id = n.doc_id AND r.registry = n.registry AND r.id = n.ref)""",
    "broken_links": """SELECT doc_id, 5 AS rule_ord, node_ord AS item_ord, 'AF260' AS code, '$[''nodes''][' || node_ord || '][''depends_on''][' || ord || ']' AS path FROM w_depends d WHERE NOT EXISTS (SELECT 1 FROM w_nodes n WHERE n.doc_id = d.doc_id AND n.id = d.node)
        UNION ALL SELECT doc_id, 6, carrier_ord, 'AF271', '$[''nodes''][' || carrier_ord || '][''ai_context''][''failure_modes''][' || ord || '][''handler_node'']' FROM w_failures d WHERE carrier = 'nodes' AND handler_node IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w_nodes n WHERE n.doc_id = d.doc_id AND n.id = d.handler_node)
        UNION ALL SELECT doc_id, 7, prompt_ord, 'AF270', '$[''prompts''][' || prompt_ord || '][''variables''][' || ord || '][''source_node'']' FROM w_variables d WHERE source_node IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w_nodes n WHERE n.doc_id = d.doc_id AND n.id = d.source_node)""",
    "broken_edges": """SELECT e.doc_id, 8 AS rule_ord, e.ord AS item_ord, 'AF210' AS code, '$[''edges''][' || e.ord || '][''source'']' AS path FROM w_edges e WHERE NOT EXISTS (SELECT 1 FROM fn n WHERE n.doc_id = e.doc_id AND n.id = e.source)
        UNION ALL SELECT e.doc_id, 8, e.ord, 'AF211', '$[''edges''][' || e.ord || '][''target'']' FROM w_edges e WHERE NOT EXISTS (SELECT 1 FROM fn n WHERE n.doc_id = e.doc_id AND n.id = e.target)
        UNION ALL SELECT e.doc_id, 8, e.ord, 'AF230', '$[''edges''][' || e.ord || '][''source'']' FROM sound e WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.side = 'source' AND a.etype = e.type AND a.ntype = e.st)
        UNION ALL SELECT e.doc_id, 8, e.ord, 'AF230', '$[''edges''][' || e.ord || '][''target'']' FROM sound e WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.side = 'target' AND a.etype = e.type AND a.ntype = e.tt)
        UNION ALL SELECT e.doc_id, 8, e.ord, 'AF240', '$[''edges''][' || e.ord || '][''source_port'']' FROM sound e WHERE source_port IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w_ports p WHERE p.doc_id = e.doc_id AND p.node_ord = e.so AND direction = 'outputs' AND p.name = e.source_port)
        UNION ALL SELECT e.doc_id, 8, e.ord, 'AF241', '$[''edges''][' || e.ord || '][''target_port'']' FROM sound e WHERE target_port IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w_ports p WHERE p.doc_id = e.doc_id AND p.node_ord = e.t_o AND direction = 'inputs' AND p.name = e.target_port)""",
    "branch_discipline": """SELECT doc_id, 9 AS rule_ord, ord AS item_ord, unnest(list_filter([CASE WHEN routes < 2 THEN 'AF250' END, CASE WHEN defaults > 1 THEN 'AF251' END], lambda x: x IS NOT NULL)) AS code, 'node:' || id AS path
        FROM (SELECT n.doc_id, n.ord, n.id, count(e.id) AS routes, count(e.id) FILTER (e.is_default) AS defaults FROM fn n LEFT JOIN sound e ON e.doc_id = n.doc_id AND e.source = n.id AND e.type = 'routes_to' WHERE n.type = 'condition' GROUP BY n.doc_id, n.ord, n.id)""",
    "reachability": """SELECT doc_id, 10 AS rule_ord, 0 AS item_ord, 'AF282' AS code, '$[''nodes'']' AS path FROM per WHERE ins = 0 UNION ALL SELECT doc_id, 10, 0, 'AF283', '$[''nodes'']' FROM per WHERE outs = 0
        UNION ALL SELECT n.doc_id, 11, n.ord, 'AF280', 'node:' || n.id FROM fn n JOIN per USING (doc_id) WHERE ins > 0 AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.doc_id = n.doc_id AND r.id = n.id)
        UNION ALL SELECT doc_id, 12, 0, 'AF281', '$[''edges'']' FROM per WHERE ins > 0 AND outs > 0 AND NOT EXISTS (SELECT 1 FROM reach r JOIN fn n ON n.doc_id = r.doc_id AND n.id = r.id WHERE r.doc_id = per.doc_id AND n.type = 'output')""",
    "provenance_discipline": """SELECT doc_id, 13 AS rule_ord, CAST(k AS BIGINT) * 1000000000 + ord AS item_ord, unnest(list_filter([CASE WHEN confidence < 0.6 THEN 'AF290' END, CASE WHEN NOT has_evidence AND coalesce(reviewed_by, '') = '' THEN 'AF291' END], lambda x: x IS NOT NULL)) AS code, '$[''' || kind || '''][' || ord || '][''provenance'']' AS path
        FROM (SELECT doc_id, 'nodes' AS kind, 0 AS k, ord, method, confidence, has_evidence, reviewed_by FROM w_nodes UNION ALL SELECT doc_id, 'edges', 1, ord, method, confidence, has_evidence, reviewed_by FROM w_edges
          UNION ALL SELECT doc_id, registry, 1 + list_position(['prompts', 'models', 'tools', 'data_sources'], registry), row_number() OVER (PARTITION BY doc_id, registry ORDER BY ord, id) - 1, method, confidence, has_evidence, reviewed_by FROM w_registry) WHERE method = 'ai_inference'""",
}
_ALL = ["w_nodes", "w_edges", "w_registry", "w_ports", "w_depends", "w_failures", "w_variables"]
_V_HEAD = f"""WITH RECURSIVE {duck(*_ALL)}, {_SOUND}, allowed AS ({_RULES_SQL}), per AS (SELECT doc_id, count(*) FILTER (type = 'input') AS ins, count(*) FILTER (type = 'output') AS outs FROM fn GROUP BY doc_id),
    reach AS (SELECT doc_id, id FROM fn WHERE type = 'input' UNION SELECT e.doc_id, e.target FROM reach r JOIN sound e ON e.doc_id = r.doc_id AND e.source = r.id)"""
_SEVERITY = "CASE WHEN code IN (" + ", ".join(f"'{c}'" for c in sorted(rules.WARNINGS)) + ") THEN 'warning' ELSE 'error' END AS severity"


def _v_sql(*names: str) -> str:
    found = " UNION ALL ".join(f"SELECT * FROM ({_V[n]})" for n in names)
    return f"{_V_HEAD}, f AS ({found}) SELECT doc_id, CAST(rule_ord AS INTEGER) AS rule_ord, CAST(item_ord AS BIGINT) AS item_ord, code, {_SEVERITY}, path FROM f"


def _rule(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(validate, name)(small(spark, sf_dir))

    run.__name__ = f"v_{name}"
    query(_v_sql(name))(run)


for _name in _V:
    _rule(_name)


@query(_v_sql(*_V))
def v_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate_semantic(small(spark, sf_dir))


@query(f"SELECT d.doc_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS codes, count(*) FILTER (severity = 'error') > 0 AS failed FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations) d LEFT JOIN ({_v_sql(*_V)}) f ON f.doc_id = d.doc_id GROUP BY d.doc_id")
def a3_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = small(spark, sf_dir)
    return validate.verdicts(validate.validate_semantic(c), c.nodes)


_D = f"""{duck('d_old', 'd_new')}, ids AS (SELECT DISTINCT kind, id FROM d_old WHERE kind <> 'document'), nids AS (SELECT DISTINCT kind, id FROM d_new WHERE kind <> 'document'),
    ch AS (SELECT kind, 'added' AS op, id, NULL AS field, NULL AS before, NULL AS after FROM nids WHERE (kind, id) NOT IN (SELECT kind, id FROM ids) UNION ALL SELECT kind, 'removed', id, NULL, NULL, NULL FROM ids WHERE (kind, id) NOT IN (SELECT kind, id FROM nids)
      UNION ALL SELECT coalesce(o.kind, n.kind), 'modified', coalesce(o.id, n.id), coalesce(o.field, n.field), o.value, n.value FROM d_old o FULL JOIN d_new n ON o.kind = n.kind AND o.id = n.id AND o.field = n.field
        WHERE o.value IS DISTINCT FROM n.value AND (coalesce(o.kind, n.kind) = 'document' OR ((coalesce(o.kind, n.kind), coalesce(o.id, n.id)) IN (SELECT kind, id FROM ids) AND (coalesce(o.kind, n.kind), coalesce(o.id, n.id)) IN (SELECT kind, id FROM nids))))"""


@query(f"WITH {_D} SELECT kind, op, id, field, before, after FROM ch")
def d1_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.changes(projected(spark, sf_dir, "d_old"), projected(spark, sf_dir, "d_new"))


@query(f"WITH {_D} SELECT kind, count(*) FILTER (op = 'added') AS added, count(*) FILTER (op = 'removed') AS removed, count(*) FILTER (op = 'modified') AS modified FROM ch GROUP BY kind")
def a2_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.change_counts(diff.changes(projected(spark, sf_dir, "d_old"), projected(spark, sf_dir, "d_new")))


@query(f"WITH {duck('l_calls')}, r AS (SELECT day, user_id, call_id, row_number() OVER (PARTITION BY day, user_id ORDER BY ts, call_id) AS n FROM l_calls) SELECT day, user_id, call_id, n AS nth, n > 1 AS refused FROM r")
def e4_daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.admitted(projected(spark, sf_dir, "l_calls"), "user_id", limit=1)


@query(f"WITH {duck('l_calls')}, d AS (SELECT day, count(*) AS used FROM l_calls GROUP BY day) SELECT day, used, greatest(0, 50 - used) AS remaining FROM d WHERE day >= (SELECT max(day) FROM d) - 30")
def a8_ledger_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.ledger(projected(spark, sf_dir, "l_calls"))


@query(f"""WITH {duck('t_texts')} SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(template, '\\{{\\{{\\s*[A-Za-z_][A-Za-z0-9_]*\\s*\\}}\\}}|\\{{[A-Za-z_][A-Za-z0-9_]*\\}}'), lambda x: regexp_replace(x, '[{{}}\\s]', '', 'g')))), ',') AS variables,
    regexp_replace(secret_text, '\\bsk-[A-Za-z0-9_-]{{8,}}', 'sk-[redacted]', 'g') AS redacted, CASE WHEN regexp_matches(url, '^https?://') THEN url END AS link FROM t_texts""")
def t_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = projected(spark, sf_dir, "t_texts")
    return t.select("id", F.array_join(text.template_variables("template"), ",").alias("variables"), text.redacted("secret_text").alias("redacted"), text.safe_link("url").alias("link"))


_QUESTIONS = """SELECT doc_id, turn AS question_id, CASE turn % 6 WHEN 0 THEN 'Where does retrieval happen?' WHEN 1 THEN concat('If the N', CAST(turn AS STRING), ' fails, what then?')
    WHEN 2 THEN 'Which tools can agents call?' WHEN 3 THEN 'Please find missing error handling' WHEN 4 THEN concat('Describe step-', CAST(turn AS STRING), '?') ELSE 'How many parts are there?' END AS question FROM w_turns"""


@query(f"""WITH RECURSIVE {duck('w_turns', 'w_nodes', 'w_edges', 'w_failures')}, {_FIRST}, q AS ({_QUESTIONS}),
    targets AS (SELECT doc_id, 'n' || question_id AS id FROM q WHERE question_id % 6 = 1), reach AS (
      SELECT doc_id, id AS failed, id FROM targets UNION SELECT t.doc_id, t.id, e.source FROM targets t JOIN w_edges e ON e.doc_id = t.doc_id AND e.target = t.id AND e.type IN ('retrieves', 'uses')
      UNION SELECT r.doc_id, r.failed, e.target FROM reach r JOIN w_edges e ON e.doc_id = r.doc_id AND e.source = r.id),
    hit AS (SELECT r.doc_id, r.failed, n.id, n.ord FROM (SELECT DISTINCT * FROM reach) r JOIN w_nodes n ON n.doc_id = r.doc_id AND n.id = r.id WHERE r.failed <> r.id),
    ends AS (SELECT doc_id, source AS id FROM w_edges WHERE type = 'retrieves' UNION SELECT doc_id, target FROM w_edges WHERE type = 'retrieves'),
    rag AS (SELECT DISTINCT doc_id, id FROM w_nodes n WHERE type IN ('retriever', 'vector_store') OR EXISTS (SELECT 1 FROM ends e WHERE e.doc_id = n.doc_id AND e.id = n.id)),
    walk AS (SELECT doc_id, id AS agent, id, 'seed' AS type FROM fn WHERE type = 'agent' UNION SELECT r.doc_id, r.agent, n.id, n.type FROM walk r JOIN w_edges e ON e.doc_id = r.doc_id AND e.source = r.id JOIN fn n ON n.doc_id = e.doc_id AND n.id = e.target WHERE r.type <> 'agent' AND n.id <> r.agent),
    used AS (SELECT doc_id, agent AS id FROM walk WHERE type = 'tool' UNION SELECT doc_id, id FROM walk WHERE type = 'tool'),
    bad AS (SELECT DISTINCT doc_id, carrier_id AS id FROM w_failures WHERE handled = FALSE OR (handled IS NULL AND coalesce(handler_node, '') = ''))
    SELECT q.doc_id, q.question_id, CASE question_id % 6 WHEN 0 THEN 'rag' WHEN 1 THEN 'impact' WHEN 2 THEN 'tools' WHEN 3 THEN 'failures' WHEN 4 THEN NULL ELSE 'summary' END AS matched,
      CAST(CASE question_id % 6 WHEN 0 THEN (SELECT count(*) FROM rag r WHERE r.doc_id = q.doc_id) WHEN 1 THEN (SELECT CASE WHEN count(*) = 0 THEN 0 ELSE 1 + count(DISTINCT id) END FROM hit h WHERE h.doc_id = q.doc_id AND h.failed = 'n' || q.question_id)
        WHEN 2 THEN (SELECT count(*) FROM used u WHERE u.doc_id = q.doc_id) WHEN 3 THEN (SELECT count(*) FROM bad b WHERE b.doc_id = q.doc_id) ELSE 0 END AS BIGINT) AS cited FROM q""")
def q_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.operators import questions

    asked = spark.sql(_QUESTIONS.replace("w_turns", "{turns}"), turns=projected(spark, sf_dir, "w_turns"))
    found = questions.answers(asked, small(spark, sf_dir))
    return found.select("doc_id", "question_id", "matched", F.size(F.array_distinct("cites")).cast("long").alias("cited"))


@query()
def y4_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.operators import layout

    return layout.laid_out(projected(spark, sf_dir, "w_nodes"), projected(spark, sf_dir, "w_edges"))


@query()
def k5_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.operators import sinks

    return sinks.svg(projected(spark, sf_dir, "w_nodes"), projected(spark, sf_dir, "w_edges"))


_SURE = "CASE conv_id % 5 WHEN 0 THEN 'maybe' WHEN 1 THEN CAST(length(text) AS STRING) WHEN 2 THEN '-1' WHEN 3 THEN concat('0.', CAST(100 + length(text) % 900 AS STRING)) ELSE 'NaN' END"


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 4 < 3 AND text IS NOT NULL THEN text END AS parsed, CAST(CASE conv_id % 5 WHEN 1 THEN least(1, length(text)) WHEN 2 THEN 0 WHEN 3 THEN round(CAST({_SURE.replace('STRING', 'VARCHAR')} AS DECIMAL(9, 3)), 2) ELSE 0.5 END AS DOUBLE) AS confidence FROM conversations""")
def e7_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given turns as replies of a model: plain, in a fence, amid prose, or cut off."""
    from loomgraph.functions.canonical import members, quoted
    from loomgraph.operators import enrich

    told = members(a=quoted(F.col("text")))
    forms = [told, F.concat(F.lit("Sure:\n```json\n"), told, F.lit("\n```")), F.concat(F.lit("It is "), told, F.lit(" I think")), F.left(told, F.length(told) - 1)]
    reply = F.element_at(F.array(*forms), (F.col("turn") % 4 + 1).cast("int"))
    rows = projected(spark, sf_dir, "conversations").select("conv_id", "turn", reply.alias("reply"), F.expr(_SURE).alias("sure")).withColumn("v", enrich.lenient_json("reply"))
    return rows.select("conv_id", "turn", F.expr("try_variant_get(v, '$.a', 'string')").alias("parsed"), enrich.confidence("sure").alias("confidence"))
