"""Findings of source analysis derived from the events, and the queries that assemble documents of them.

Every user is a project and every event a finding, so projects grow with the table; names
come from small pools, so that references meet, collide and miss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import assemble, minting
from loomgraph.plans.projections import PROJECTIONS, duck, projected
from loomgraph.plans.queries import query

_CLASSES = "Planner,Answerer,planner_2,Critic,Writer,Searcher,Reader"
_LABELS = "plan,answer,Plan,check,plan_2,store,fork,lost"


def _pool(words: str, n: str) -> str:
    return f"split_part('{words}', ',', CAST(1 + ({n}) % {words.count(',') + 1} AS INT))"


def _text(words: str) -> str:
    return f"concat('{words}', CAST({{}} AS STRING))"


def _for(**kinds: str) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in kinds.items()) + " END"


PROJECTIONS |= {
    "b_events": "SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS ord, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v FROM {events}",
    "b_kinds": """SELECT doc_id, ord, k, v, kind FROM (SELECT doc_id, ord, k, v, CASE event_type WHEN 'signup' THEN split_part('entrypoint,instance,model,fw_entry,fw_terminal', ',', CAST(1 + k % 5 AS INT)) WHEN 'error' THEN split_part('vector_store,tool,prompt', ',', CAST(1 + k % 3 AS INT))
        WHEN 'view' THEN split_part('retrieval,retriever,agent', ',', CAST(1 + k % 3 AS INT)) WHEN 'click' THEN split_part('llm,fw_node', ',', CAST(1 + k % 2 AS INT)) ELSE split_part('fw_edge,fw_branch', ',', CAST(1 + k % 2 AS INT)) END AS kind FROM {b_events}) AS e
        WHERE NOT (doc_id % 3 = 0 AND kind LIKE 'fw%') AND NOT (doc_id % 9 = 4 AND kind = 'fw_entry')""",
    "b_findings": f"""SELECT doc_id, ord, kind, concat('app', CAST(k % 3 AS STRING), '.py') AS file, CAST((k + v) % 100 AS DOUBLE) / 100 AS confidence,
        {_for(prompt=_pool('ASK_PROMPT,AskPrompt,ask_prompt_2,Rules,9lives', 'v'), tool=_pool('search,Search,sendMail,HTTPGet', 'v'), vector_store=_pool('docs,Docs,docs_2', 'v'), agent=_pool(_CLASSES, 'v'), retriever=_pool('Searcher,Reader,Answerer,Finder', 'v'), instance=_text('obj').format('v % 5'), entrypoint=_text('handle_').format('v % 4'), llm="'call'")} AS name,
        {_for(llm=_text('llm').format('v % 9'), vector_store=_text('store').format('v % 4'))} AS key,
        CASE WHEN kind IN ('llm', 'retrieval') AND v % 4 <> 3 THEN concat({_pool('Planner,Answerer,Critic,Searcher,Reader,step_a,step_b', 'v + k')}, '.run') END AS scope,
        {_for(model="concat('gpt-', CAST(v % 5 AS STRING), '.0')", llm="CASE WHEN k % 4 = 0 THEN concat('gpt-', CAST(v % 7 AS STRING), '.0') END", fw_node="CASE WHEN v % 5 = 1 THEN concat('gpt-', CAST(k % 8 AS STRING), '.0') END")} AS model,
        {_for(model=_text('MODEL_').format('v % 4'))} AS const, {_for(llm="CASE WHEN v % 3 = 0 THEN concat('MODEL_', CAST(k % 6 AS STRING)) END")} AS model_const, 'own' AS provider,
        {_for(llm="CASE WHEN v % 2 = 0 THEN concat('v', CAST(k % 5 AS STRING)) END")} AS var, {_for(fw_node="CASE WHEN v % 4 = 1 THEN concat('v', CAST(k % 7 AS STRING)) END")} AS bound, {_for(instance=_pool(_CLASSES, 'k'))} AS class,
        {_for(retrieval=_text('store').format('k % 6'))} AS store, {_for(retrieval="CASE WHEN v % 2 = 0 THEN 'index' END")} AS receiver, {_for(agent="'An agent.'")} AS description, {_for(entrypoint="CASE WHEN v % 2 = 0 THEN '/ask' END")} AS route, {_for(entrypoint="'http'")} AS entry_kind,
        {_for(fw_node=_pool(_LABELS[:_LABELS.index(',fork')], 'v'), fw_entry=_pool(_LABELS, 'v'), fw_terminal=_pool(_LABELS, 'v'))} AS label, {_for(fw_node="CASE WHEN v % 3 > 0 THEN " + _pool('step_a,step_b,Searcher', 'k') + " END", fw_edge=_pool(_LABELS, 'v'))} AS target, {_for(fw_node="CASE WHEN v % 6 = 2 THEN 'tool' END")} AS node_type,
        {_for(fw_edge=_pool(_LABELS, 'v + 1 + k'), fw_branch=_pool(_LABELS + ',split', 'v + k'))} AS source, {_for(fw_branch="CASE WHEN v % 2 = 0 THEN 'pick_route' END")} AS router, k % 5 = 0 AS partial,
        {_for(agent=f"concat({_pool('AskPrompt,Rules,search,HTTPGet,Reader', 'v')}, ',', {_pool('ASK_PROMPT,Searcher,sendMail', 'k')}, ',', {_pool('AskPrompt,Finder,none', 'k + v')})")} AS refs, {_for(agent=f"concat('llm', CAST(k % 9 AS STRING), ',llm', CAST(v % 12 AS STRING))")} AS llm_calls,
        {_for(llm=_pool('Rules,AskPrompt,nothing', 'k'), fw_node=_pool('Rules,9lives,nothing', 'k'))} AS prompts, {_for(fw_node="concat(" + _pool('search,HTTPGet,none', 'v') + ", ',', " + _pool('sendMail,Search', 'k') + ")")} AS tools, {_for(fw_node=_text('store').format('v % 7'))} AS stores,
        {_for(fw_branch=f"concat('yes>', {_pool(_LABELS, 'k')}, ',it''s>', {_pool(_LABELS + ',split', 'v')})")} AS routes FROM {{b_kinds}}""",
    "b_statements": f"""SELECT f.doc_id, f.ord, e.ord - f.ord AS pos, 10 + (e.ord - f.ord) * 2 + e.k % 4 AS line, {_pool('obj0,obj1,obj2,obj3,Planner,Answerer,Searcher,nobody', 'e.v')} AS receiver, 'run' AS method,
        concat('x', CAST(e.k % 3 AS STRING), ',x', CAST(e.v % 3 AS STRING)) AS uses, concat('x', CAST((e.k + 1) % 3 AS STRING)) AS assigns FROM {{b_findings}} f JOIN {{b_events}} e ON e.doc_id = f.doc_id AND e.ord > f.ord AND e.ord <= f.ord + 7 WHERE f.kind = 'entrypoint'""",
}


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = projected(spark, sf_dir, "b_findings")
    lists = {c: F.split(c, ",") for c in ("refs", "llm_calls", "prompts", "tools", "stores")}
    routes = F.transform(F.split("routes", ","), lambda x: F.struct(F.substring_index(x, ">", 1).alias("when"), F.substring_index(x, ">", -1).alias("target")))
    return f.withColumns(lists | {"routes": routes})


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir, "b_statements").withColumns({c: F.split(c, ",") for c in ("uses", "assigns")})


def _named(kind: str, column: str, role: str, pick: str = "max") -> str:
    return f"SELECT doc_id, {column} AS called, '{role}:' || {pick}(ord) AS handle, {pick}(ord) AS ord, min(ord) AS since FROM b_findings WHERE kind = '{kind}' AND {column} <> '' GROUP BY ALL"


_NAMES = f"""prompts AS ({_named('prompt', 'name', 'prompt')}), tools AS ({_named('tool', 'name', 'tool', 'min')}), stores AS ({_named('vector_store', 'key', 'store')}), agents AS ({_named('agent', 'name', 'agent')}),
    retrievers AS ({_named('retriever', 'name', 'retriever')}), llms AS ({_named('llm', 'key', 'llm')}), vars AS ({_named('llm', 'var', 'llm')}), consts AS ({_named('model', 'const', 'model')}), literals AS ({_named('model', 'model', 'model')})"""
_EDGES = ["doc_id", "ord", "type", "source", "target"]


@query(f"""WITH {duck('b_findings')}, {_NAMES}, own AS (SELECT a.doc_id, a.ord, a.handle, f.refs, f.llm_calls FROM agents a JOIN b_findings f ON f.doc_id = a.doc_id AND f.ord = a.ord),
    named AS (SELECT DISTINCT doc_id, ord, handle, unnest(string_split(refs, ',')) AS called FROM own), called AS (SELECT doc_id, ord, handle, unnest(string_split(llm_calls, ',')) AS called FROM own)
    SELECT doc_id, f.ord, 'model' AS type, 'llm:' || f.ord AS source, coalesce(c.handle, l.handle, 'unnamed:' || f.ord) AS target FROM b_findings f LEFT JOIN consts c USING (doc_id) LEFT JOIN literals l USING (doc_id) WHERE FALSE
    UNION ALL SELECT f.doc_id, f.ord, 'model', 'llm:' || f.ord, coalesce((SELECT handle FROM consts c WHERE c.doc_id = f.doc_id AND c.called = f.model_const), (SELECT handle FROM literals l WHERE l.doc_id = f.doc_id AND l.called = f.model), 'unnamed:' || f.ord) FROM b_findings f WHERE kind = 'llm'
    UNION ALL SELECT c.doc_id, c.ord, 'calls', c.handle, l.handle FROM called c JOIN llms l ON l.doc_id = c.doc_id AND l.called = c.called
    UNION ALL SELECT c.doc_id, c.ord, 'uses', c.handle, l.handle FROM named c JOIN prompts l ON l.doc_id = c.doc_id AND l.called = c.called
    UNION ALL SELECT c.doc_id, c.ord, 'calls', c.handle, l.handle FROM named c JOIN tools l ON l.doc_id = c.doc_id AND l.called = c.called
    UNION ALL SELECT c.doc_id, c.ord, 'retrieves', c.handle, l.handle FROM named c JOIN retrievers l ON l.doc_id = c.doc_id AND l.called = c.called
    UNION ALL SELECT f.doc_id, f.ord, 'retrieves', r.handle, s.handle FROM b_findings f JOIN retrievers r ON r.doc_id = f.doc_id AND r.called = split_part(f.scope, '.', 1) JOIN stores s ON s.doc_id = f.doc_id AND s.called = f.store WHERE f.kind = 'retrieval'""")
def j10_finding_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    models = assemble.model_refs(f).select("doc_id", "ord", F.lit("model").alias("type"), F.concat(F.lit("llm:"), "ord").alias("source"), F.col("ref").alias("target"))
    return models.unionByName(assemble.class_edges(f).select(*_EDGES))


_SNAKE = "lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_'))"


@query(f"""WITH RECURSIVE {duck('b_findings')}, b AS (SELECT doc_id, ord, {_SNAKE} AS s, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM b_findings WHERE name IS NOT NULL),
    r AS (SELECT doc_id, ord, n, CASE WHEN s SIMILAR TO '[a-z].*' THEN s ELSE 'n_' || s END AS base FROM b),
    m AS (SELECT doc_id, ord, n, base, base AS id, [base] AS taken FROM r WHERE n = 1
      UNION ALL SELECT r.doc_id, r.ord, r.n, r.base, (list_filter(list_concat([r.base], list_transform(range(2, 400), lambda i: r.base || '_' || i)), lambda c: NOT list_contains(m.taken, c)))[1] AS id,
        list_append(m.taken, (list_filter(list_concat([r.base], list_transform(range(2, 400), lambda i: r.base || '_' || i)), lambda c: NOT list_contains(m.taken, c)))[1]) FROM m JOIN r ON r.doc_id = m.doc_id AND r.n = m.n + 1)
    SELECT doc_id, ord, base, id FROM m""")
def b2_minted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = findings(spark, sf_dir).where("name is not null").select("doc_id", "ord", F.col("ord").alias("seq"), minting.base_of("", F.col("name")).alias("base"))
    return minting.minted(named).select("doc_id", "ord", "base", "id")


@query(f"""WITH {duck('b_statements')}, u AS (SELECT doc_id, ord, pos, unnest(string_split(uses, ',')) AS variable FROM b_statements), c AS (
      SELECT DISTINCT u.doc_id, u.ord, u.pos, d.receiver AS source FROM u JOIN b_statements d ON d.doc_id = u.doc_id AND d.ord = u.ord AND d.assigns = u.variable AND d.pos = (SELECT max(x.pos) FROM b_statements x WHERE x.doc_id = u.doc_id AND x.ord = u.ord AND x.assigns = u.variable AND x.pos < u.pos))
    SELECT s.doc_id, s.ord, CAST(row_number() OVER (PARTITION BY s.doc_id, s.ord ORDER BY line, s.pos) AS INTEGER) AS step, receiver, coalesce((SELECT string_agg(source, ',' ORDER BY source) FROM c WHERE c.doc_id = s.doc_id AND c.ord = s.ord AND c.pos = s.pos), '') AS consumes FROM b_statements s""")
def p15_consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.consumed(statements(spark, sf_dir)).select("doc_id", "ord", "step", "receiver", F.array_join("consumes", ",").alias("consumes"))


_FLOW = f"""{_NAMES}, framed AS (SELECT DISTINCT doc_id FROM b_findings WHERE kind = 'fw_node'), classes AS (SELECT doc_id, called AS class, arg_min(handle, rank) AS handle FROM (SELECT *, 0 AS rank FROM agents UNION ALL SELECT *, 1 FROM retrievers) AS x GROUP BY ALL),
    objects AS (SELECT doc_id, name, arg_max(class, ord) AS class FROM b_findings WHERE kind = 'instance' GROUP BY ALL), known AS (SELECT o.doc_id, o.name AS receiver, c.handle FROM objects o JOIN classes c USING (doc_id, class) UNION ALL SELECT doc_id, class, handle FROM classes c WHERE NOT EXISTS (SELECT 1 FROM objects o WHERE o.doc_id = c.doc_id AND o.name = c.class))"""
_CONSUMED = """u AS (SELECT doc_id, ord, pos, unnest(string_split(uses, ',')) AS variable FROM b_statements), c AS (
      SELECT DISTINCT u.doc_id, u.ord, u.pos, d.receiver AS upstream FROM u JOIN b_statements d ON d.doc_id = u.doc_id AND d.ord = u.ord AND d.assigns = u.variable AND d.pos = (SELECT max(x.pos) FROM b_statements x WHERE x.doc_id = u.doc_id AND x.ord = u.ord AND x.assigns = u.variable AND x.pos < u.pos)),
    flow AS (SELECT s.doc_id, s.ord, s.pos, k.handle, row_number() OVER (PARTITION BY s.doc_id, s.ord ORDER BY line, s.pos) AS step FROM b_statements s JOIN known k ON k.doc_id = s.doc_id AND k.receiver = s.receiver WHERE s.doc_id NOT IN (SELECT doc_id FROM framed))"""


@query(f"""WITH {duck('b_findings', 'b_statements')}, {_FLOW}, {_CONSUMED}
    SELECT doc_id, ord, 'passes' AS type, 'in:' || ord AS source, handle AS target FROM flow WHERE step = 1
    UNION ALL SELECT f.doc_id, f.ord, 'passes', k.handle, f.handle FROM flow f JOIN c ON c.doc_id = f.doc_id AND c.ord = f.ord AND c.pos = f.pos JOIN known k ON k.doc_id = c.doc_id AND k.receiver = c.upstream WHERE f.step > 1 AND k.handle <> f.handle
    UNION ALL SELECT doc_id, ord, 'produces', arg_max(handle, step), 'out:' || ord FROM flow GROUP BY doc_id, ord""")
def b11_entry_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.entry_flows(findings(spark, sf_dir), statements(spark, sf_dir))[1].select(*_EDGES)


@query(f"""WITH {duck('b_findings')}, inside AS (SELECT doc_id, split_part(scope, '.', 1) AS owner, bool_or(kind = 'llm') AS calls, bool_or(kind = 'retrieval') AS reads FROM b_findings WHERE kind IN ('llm', 'retrieval') AND scope <> '' GROUP BY ALL)
    SELECT f.doc_id, f.ord, f.label, coalesce(f.node_type, CASE WHEN reads AND NOT calls THEN 'retriever' ELSE 'agent' END) AS type FROM b_findings f LEFT JOIN inside i ON i.doc_id = f.doc_id AND i.owner = coalesce(nullif(f.target, ''), f.label) WHERE f.kind = 'fw_node'""")
def b8_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.steps(findings(spark, sf_dir)).select("doc_id", "ord", "label", "type")


_STEP_EDGES = """steps AS (SELECT *, 'step:' || ord AS handle, coalesce(nullif(target, ''), label) AS owner FROM b_findings WHERE kind = 'fw_node'),
    inside AS (SELECT s.handle, f.* FROM steps s JOIN b_findings f ON f.doc_id = s.doc_id AND f.kind IN ('llm', 'retrieval') AND split_part(f.scope, '.', 1) = s.owner),
    step_edges AS (
      SELECT i.doc_id, i.ord, 'calls' AS type, i.handle AS source, l.handle AS target FROM inside i JOIN llms l ON l.doc_id = i.doc_id AND l.called = i.key WHERE i.kind = 'llm'
      UNION ALL SELECT i.doc_id, i.ord, 'uses', i.handle, p.handle FROM (SELECT doc_id, ord, handle, unnest(string_split(prompts, ',')) AS called FROM inside WHERE kind = 'llm') i JOIN prompts p ON p.doc_id = i.doc_id AND p.called = i.called
      UNION ALL SELECT i.doc_id, i.ord, 'retrieves', i.handle, l.handle FROM inside i JOIN stores l ON l.doc_id = i.doc_id AND l.called = i.store WHERE i.kind = 'retrieval'
      UNION ALL SELECT i.doc_id, i.ord, 'calls', i.handle, p.handle FROM (SELECT doc_id, ord, handle, unnest(string_split(tools, ',')) AS called FROM steps) i JOIN tools p ON p.doc_id = i.doc_id AND p.called = i.called
      UNION ALL SELECT i.doc_id, i.ord, 'uses', i.handle, p.handle FROM (SELECT doc_id, ord, handle, unnest(string_split(prompts, ',')) AS called FROM steps) i JOIN prompts p ON p.doc_id = i.doc_id AND p.called = i.called
      UNION ALL SELECT i.doc_id, i.ord, 'retrieves', i.handle, p.handle FROM (SELECT doc_id, ord, handle, unnest(string_split(stores, ',')) AS called FROM steps) i JOIN stores p ON p.doc_id = i.doc_id AND p.called = i.called
      UNION ALL SELECT s.doc_id, s.ord, 'calls', s.handle, coalesce(v.handle, 'stepllm:' || s.ord) FROM steps s LEFT JOIN vars v ON v.doc_id = s.doc_id AND v.called = s.bound WHERE v.handle IS NOT NULL OR coalesce(s.model, '') <> '')"""
_BRANCHES = """own AS (SELECT doc_id, label AS called, 'step:' || max(ord) AS handle, -1 AS since, min(ord) AS place, 0 AS kind FROM b_findings WHERE kind = 'fw_node' GROUP BY ALL),
    roots AS (SELECT doc_id, source AS called, 'cond:' || min(ord) AS handle, min(ord) AS since, min(ord) AS place, 1 AS kind FROM b_findings f WHERE kind = 'fw_branch' AND NOT EXISTS (SELECT 1 FROM own o WHERE o.doc_id = f.doc_id AND o.called = f.source) GROUP BY ALL),
    labels AS (SELECT * FROM own UNION ALL SELECT * FROM roots), framed AS (SELECT DISTINCT doc_id FROM own),
    br AS (SELECT *, 'cond:' || ord AS cond FROM b_findings WHERE kind = 'fw_branch' AND doc_id IN (SELECT doc_id FROM framed)),
    ways AS (SELECT doc_id, ord, cond, unnest(string_split(routes, ',')) AS way FROM br),
    branch_edges AS (SELECT b.doc_id, b.ord, 'passes' AS type, l.handle AS source, b.cond AS target, NULL AS "when" FROM br b JOIN labels l ON l.doc_id = b.doc_id AND l.called = b.source AND l.handle <> b.cond
      UNION ALL SELECT w.doc_id, w.ord, 'routes_to', w.cond, l.handle, 'route == ' || CASE WHEN contains(way, '''') THEN '"' || split_part(way, '>', 1) || '"' ELSE '''' || split_part(way, '>', 1) || '''' END FROM ways w JOIN labels l ON l.doc_id = w.doc_id AND l.called = split_part(way, '>', 2) AND l.since <= w.ord),
    sequence_edges AS (SELECT f.doc_id, f.ord, 'passes' AS type, a.handle AS source, b.handle AS target FROM b_findings f JOIN labels a ON a.doc_id = f.doc_id AND a.called = f.source JOIN labels b ON b.doc_id = f.doc_id AND b.called = f.target WHERE f.kind = 'fw_edge' AND f.doc_id IN (SELECT doc_id FROM framed))"""


@query(f"""WITH {duck('b_findings')}, {_NAMES}, {_STEP_EDGES}, {_BRANCHES} SELECT doc_id, ord, type, source, target, NULL AS "when" FROM step_edges UNION ALL SELECT * FROM branch_edges UNION ALL SELECT *, NULL FROM sequence_edges""")
def b9_framework_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.framework_edges(findings(spark, sf_dir)).select(*_EDGES, "when")


@query(f"""WITH {duck('b_findings')}, {_NAMES}, {_STEP_EDGES}, {_BRANCHES}, own2 AS (SELECT a.doc_id, f.refs FROM agents a JOIN b_findings f ON f.doc_id = a.doc_id AND f.ord = a.ord),
    reached AS (SELECT doc_id, target FROM step_edges UNION SELECT doc_id, target FROM branch_edges UNION SELECT doc_id, target FROM sequence_edges),
    first AS (SELECT doc_id, min(ord) AS ord FROM b_findings WHERE kind = 'entrypoint' GROUP BY doc_id)
    SELECT f.doc_id, f.ord, l.handle AS at FROM labels l JOIN first f USING (doc_id) WHERE f.doc_id IN (SELECT doc_id FROM framed) AND f.doc_id NOT IN (SELECT doc_id FROM b_findings WHERE kind = 'fw_entry') AND NOT EXISTS (SELECT 1 FROM reached r WHERE r.doc_id = l.doc_id AND r.target = l.handle)""")
def b10_headless(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return assemble.headless(f, assemble.class_edges(f).unionByName(assemble.framework_edges(f))).select("doc_id", "ord", "at")


_FRAMEWORKS = "alpha,beta,gamma,delta"
PROJECTIONS |= {
    "b_reports": f"SELECT doc_id, ord AS file_ord, concat({_pool(_FRAMEWORKS, 'k')}, ',', {_pool(_FRAMEWORKS, 'v')}) AS frameworks, CASE WHEN v % 3 = 0 THEN concat('file ', CAST(ord AS STRING), ' has no syntax,second') END AS notes FROM {{b_events}} WHERE event_type = 'view' AND k % 8 = 1",
    "b_adapters": f"SELECT doc_id, ord, concat('adapter-', {_pool(_FRAMEWORKS, 'k')}) AS name, {_pool(_FRAMEWORKS, 'k')} AS framework, v % 2 = 0 AS found, CASE WHEN k % 5 = 0 THEN concat('not literal ', CAST(v AS STRING)) END AS notes FROM {{b_events}} WHERE event_type = 'click' AND k % 8 = 2",
}


@query(f"""WITH {duck('b_reports', 'b_adapters')}, used AS (SELECT doc_id, framework AS name, arg_max(name, ord) AS adapter FROM b_adapters WHERE found GROUP BY ALL),
    named AS (SELECT DISTINCT doc_id, unnest(string_split(frameworks, ',')) AS name FROM b_reports),
    said AS (SELECT doc_id, 0 AS part, file_ord AS ord, unnest(string_split(notes, ',')) AS note, generate_subscripts(string_split(notes, ','), 1) AS i FROM b_reports UNION ALL SELECT doc_id, 1, ord, notes, 1 FROM b_adapters WHERE notes IS NOT NULL)
    SELECT doc_id, count(*) AS files, (SELECT string_agg(n.name || ':' || coalesce(u.adapter, '-'), ' ' ORDER BY n.name) FROM named n LEFT JOIN used u ON u.doc_id = n.doc_id AND u.name = n.name WHERE n.doc_id = r.doc_id) AS frameworks,
      coalesce((SELECT string_agg(note, '; ' ORDER BY part, ord, i) FROM said s WHERE s.doc_id = r.doc_id), '') AS notes FROM b_reports r GROUP BY doc_id""")
def a9_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = projected(spark, sf_dir, "b_reports").withColumns({c: F.split(c, ",") for c in ("frameworks", "notes")})
    adapters = projected(spark, sf_dir, "b_adapters").withColumn("notes", F.split("notes", ","))
    found = assemble.projects(reports, adapters)
    shown = F.array_join(F.transform("frameworks", lambda x: F.concat(x["name"], F.lit(":"), F.coalesce(x["adapter"], F.lit("-")))), " ")
    return found.select("doc_id", "files", shown.alias("frameworks"), F.coalesce(F.array_join("notes", "; "), F.lit("")).alias("notes"))


@query()
def b12_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All elements with their ids; tests hold them against names given one by one."""
    made = assemble.assembled(findings(spark, sf_dir), statements(spark, sf_dir))
    part = lambda df, kind, *cols: df.select("doc_id", F.lit(kind).alias("kind"), "ord", "id", *cols)
    none = F.lit(None).cast("string")
    out = part(made.nodes, "nodes", "type", none.alias("source"), F.col("ref").alias("target"))
    out = out.unionByName(part(made.edges, "edges", "type", "source", "target"))
    return out.unionByName(part(made.registry, "registry", F.col("registry").alias("type"), none.alias("source"), none.alias("target")))
