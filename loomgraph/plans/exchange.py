"""Registered queries over whole documents: drift, digests and payloads, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import drift, graph, payload
from loomgraph.plans.enriching import _quoted
from loomgraph.plans.projections import PROJECTIONS, duck, projected
from loomgraph.plans.queries import _PATHS, ORACLE, query, small

PROJECTIONS |= {
    "j_again": r"""SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN replace(raw, '"type":"agent"', '"type":"llm"') WHEN 2 THEN replace(raw, '"symbol":"f"', concat('"symbol":"{{', chr(92), '"start_line', chr(92), '":9}}"')) WHEN 3 THEN replace(raw, '"id":"n2"', '"id":"n2b"') WHEN 4 THEN replace(raw, '"parts":4', '"parts":5') ELSE raw END AS raw
        FROM (SELECT doc_id, replace(replace(replace(replace(raw, '"start_line":3', '"start_line":7,"end_line":9'), '"generated_at":"today"', '"generated_at":"later"'), 'abcdef1', 'fedcba9'), '"project":{{"name":"c', '"project":{{"name":"z') AS raw FROM {j_docs}) AS x""",
}

_ELEMENTS = " UNION ALL ".join(f"SELECT doc_id, v, '{k}' AS kind, unnest(CAST(d->'$.{k}' AS JSON[])) AS e, generate_subscripts(CAST(d->'$.{k}' AS JSON[]), 1) AS ord FROM parsed WHERE json_type(d, '$.{k}') = 'ARRAY'" for k in ("nodes", "edges", "prompts", "models", "tools", "data_sources"))
_NO_LINES = """'{"start_line":null,"end_line":null}'"""


def _lineless(v: str) -> str:
    one = f"CASE WHEN json_type(x) = 'OBJECT' THEN json_merge_patch(x, {_NO_LINES}) ELSE x END"
    return f"CASE json_type({v}) WHEN 'ARRAY' THEN to_json(list_transform(CAST({v} AS JSON[]), lambda x: {one})) WHEN 'OBJECT' THEN json_merge_patch({v}, {_NO_LINES}) ELSE {v} END"


_DRIFT = f"""{duck('j_again')}, parsed AS (SELECT doc_id, 'old' AS v, CAST(raw AS JSON) AS d FROM j_docs WHERE json_valid(raw) UNION ALL SELECT doc_id, 'new', CAST(raw AS JSON) FROM j_again WHERE json_valid(raw)),
    els AS (SELECT doc_id, v, kind, e->>'$.id' AS id, arg_max(e, ord) AS e FROM ({_ELEMENTS}) GROUP BY ALL), raw_fields AS (SELECT doc_id, v, kind, id, e, unnest(json_keys(e)) AS field FROM els WHERE id IS NOT NULL),
    fields AS (SELECT doc_id, v, kind, id, field, json_extract(e, '$."' || field || '"') AS x FROM raw_fields
      UNION ALL SELECT doc_id, v, 'document', 'project.' || field, field, json_extract(CASE WHEN field = 'name' THEN (SELECT o.d FROM parsed o WHERE o.doc_id = p.doc_id AND o.v = 'old') ELSE d END, '$.project."' || field || '"') FROM (SELECT *, unnest(json_keys(d, '$.project')) AS field FROM parsed) p WHERE field NOT IN ('commit', 'repository')
      UNION ALL SELECT doc_id, v, 'document', 'version', 'version', d->'$.version' FROM parsed UNION ALL SELECT doc_id, v, 'document', 'metadata', 'metadata', json_merge_patch(d->'$.metadata', '{{"generated_at":null,"files_analyzed":null,"skipped":null}}') FROM parsed),
    told AS (SELECT doc_id, v, kind, id, field, CAST(CASE WHEN kind <> 'document' AND (field = 'source_ref' OR (field = 'source' AND kind <> 'edges')) THEN {_lineless('x')}
      WHEN kind <> 'document' AND field = 'provenance' AND json_type(x) = 'OBJECT' THEN CASE WHEN json_exists(x, '$.evidence') THEN json_merge_patch(json_merge_patch(x, '{{"generated_at":null}}'), json_object('evidence', {_lineless("x->'$.evidence'")})) ELSE json_merge_patch(x, '{{"generated_at":null}}') END ELSE x END AS VARCHAR) AS value FROM fields),
    o AS (SELECT * FROM told WHERE v = 'old'), n AS (SELECT * FROM told WHERE v = 'new'), oid AS (SELECT DISTINCT doc_id, kind, id FROM o WHERE kind <> 'document'), nid AS (SELECT DISTINCT doc_id, kind, id FROM n WHERE kind <> 'document')"""


@query(f"""WITH {_DRIFT} SELECT doc_id, kind, 'removed' AS op, id, NULL AS field FROM oid WHERE (doc_id, kind, id) NOT IN (SELECT doc_id, kind, id FROM nid) UNION ALL SELECT doc_id, kind, 'added', id, NULL FROM nid WHERE (doc_id, kind, id) NOT IN (SELECT doc_id, kind, id FROM oid)
    UNION ALL SELECT coalesce(o.doc_id, n.doc_id), coalesce(o.kind, n.kind), 'modified', coalesce(o.id, n.id), coalesce(o.field, n.field) FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.kind = n.kind AND o.id = n.id AND o.field = n.field
      WHERE o.value IS DISTINCT FROM n.value AND (coalesce(o.kind, n.kind) = 'document' OR ((coalesce(o.doc_id, n.doc_id), coalesce(o.kind, n.kind), coalesce(o.id, n.id)) IN (SELECT doc_id, kind, id FROM oid) AND (coalesce(o.doc_id, n.doc_id), coalesce(o.kind, n.kind), coalesce(o.id, n.id)) IN (SELECT doc_id, kind, id FROM nid)))""")
def d5_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made anew on other lines, at another time and commit, under another name, and some with real changes."""
    return drift.drift(projected(spark, sf_dir, "j_docs"), projected(spark, sf_dir, "j_again")).select("doc_id", "kind", "op", "id", "field")


LIMITS = [20_000, 4_000, 1_500]
_KNOWN = "known AS (SELECT DISTINCT n.doc_id, n.ord FROM w_described n JOIN w_registry r ON r.doc_id = n.doc_id AND r.id = n.ref AND r.registry = CASE n.type WHEN 'llm' THEN 'models' WHEN 'tool' THEN 'tools' WHEN 'prompt' THEN 'prompts' WHEN 'vector_store' THEN 'data_sources' WHEN 'retriever' THEN 'data_sources' END)"
_OPEN = "handled = FALSE OR (handled IS NULL AND coalesce(handler_node, '') = '')"


@query(f"""WITH RECURSIVE {_PATHS.replace(duck('w_nodes', 'w_edges'), duck('w_nodes', 'w_edges', 'w_described', 'w_registry', 'w_failures'))}, {_KNOWN},
    nj AS (SELECT n.doc_id, n.ord, '{{' || concat_ws(', ', '"id": ' || {_quoted('n.id')}, '"type": ' || {_quoted('n.type')}, CASE WHEN n.name <> '' THEN '"name": ' || {_quoted('n.name')} END, CASE WHEN n.description <> '' THEN '"description": ' || {_quoted('n.description')} END,
      CASE WHEN k.ord IS NOT NULL THEN '"definition": {{"id": ' || {_quoted('n.ref')} || '}}' END) AS head, CASE WHEN n.ord % 2 = 0 THEN ', "source": "app.py:' || n.ord || '"' ELSE '' END AS source FROM w_described n LEFT JOIN known k ON k.doc_id = n.doc_id AND k.ord = n.ord),
    ns AS (SELECT doc_id, string_agg(head || source || '}}', ', ' ORDER BY ord) AS f, string_agg(head || '}}', ', ' ORDER BY ord) AS s FROM nj GROUP BY doc_id),
    es AS (SELECT doc_id, string_agg('{{"id": ' || {_quoted('id')} || ', "type": ' || {_quoted('type')} || ', "from": ' || {_quoted('source')} || ', "to": ' || {_quoted('target')} || '}}', ', ' ORDER BY ord) AS x FROM w_edges GROUP BY doc_id),
    ps AS (SELECT doc_id, string_agg('[' || array_to_string(list_transform(nodes, lambda n: '"' || n || '"'), ', ') || ']', ', ' ORDER BY place) AS x FROM placed WHERE place <= 12 GROUP BY doc_id),
    fs AS (SELECT doc_id, string_agg('{{"component": ' || {_quoted('carrier_id')} || ', "detail": ' || {_quoted('description')} || ', "inferred": ' || CASE WHEN inferred THEN 'true' ELSE 'false' END || '}}', ', ' ORDER BY carrier_ord, ord) AS x FROM w_failures WHERE {_OPEN} GROUP BY doc_id),
    t AS (SELECT ns.doc_id, '{{"nodes": [' AS a, f, s, '], "edges": [' || coalesce(es.x, '') || '], "analysis": {{' AS b, '"paths": [' || coalesce(ps.x, '') || '], ' AS p, '"unhandled_failures": [' || coalesce(fs.x, '') || ']}}}}' AS c FROM ns LEFT JOIN es USING (doc_id) LEFT JOIN ps USING (doc_id) LEFT JOIN fs USING (doc_id))
    SELECT doc_id, most, CASE WHEN length(a || f || b || p || c) <= most THEN a || f || b || p || c WHEN length(a || s || b || p || c) <= most THEN a || s || b || p || c ELSE a || s || b || c END AS digest FROM t, (SELECT unnest({LIMITS}) AS most) AS m""")
def q13_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document under three limits."""
    t = lambda n: projected(spark, sf_dir, n)
    nodes = t("w_described").withColumn("source", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("app.py:"), "ord")))
    failures = graph.stored(graph.unhandled_failures(t("w_failures")))
    out = None
    for most in LIMITS:
        one = payload.digest(nodes, t("w_edges"), t("w_registry"), failures, most).select("doc_id", F.lit(most).alias("most"), "digest")
        out = one if out is None else out.unionByName(one)
    return out


def _list(ids: str) -> str:
    return f"'[' || array_to_string(list_transform({ids}, lambda i: '\"' || i || '\"'), ',') || ']'"


def _cte(name: str) -> str:
    """The SQL of another query without its own WITH, as a table of its rows."""
    return f"(SELECT * FROM ({ORACLE[name]}))"


@query(f"""WITH ds AS (SELECT doc_id, raw FROM {_cte('k1_encoded')}), su AS {_cte('a1_summary')}, pa AS {_cte('g4_paths_to_outputs')}, ra AS {_cte('g6_rag_components')}, un AS {_cte('g2_unreachable')}, ag AS {_cte('g7_agents_using_tools')}, uh AS {_cte('g8_unhandled_failures')}, lo AS {_cte('g9_low_trust')}, al AS {_cte('f3_nodes_by_type')},
    p AS (SELECT doc_id, string_agg('{{"nodes":' || {_list("string_split(nodes, '>')")} || ',"edges":' || {_list("string_split(edges, '>')")} || '}}', ',' ORDER BY place) AS x FROM pa GROUP BY doc_id), r AS (SELECT doc_id, string_agg('"' || id || '"', ',' ORDER BY ord) AS x FROM ra GROUP BY doc_id), u AS (SELECT doc_id, string_agg('"' || id || '"', ',' ORDER BY ord) AS x FROM un GROUP BY doc_id),
    ao AS (SELECT doc_id, id, min(ord) AS ord FROM al WHERE role = 'agent or llm' AND type = 'agent' GROUP BY ALL), a AS (SELECT doc_id, string_agg(x, ',' ORDER BY ord, x) AS x FROM (SELECT ag.doc_id, ao.ord, '"' || agent || '":[' || string_agg('"' || tool || '"', ',' ORDER BY tool) || ']' AS x FROM ag JOIN ao ON ao.doc_id = ag.doc_id AND ao.id = ag.agent GROUP BY ag.doc_id, agent, ao.ord) GROUP BY doc_id),
    h AS (SELECT doc_id, string_agg('{{' || concat_ws(',', '"subject":"' || subject || '"', '"detail":"' || detail || '"', '"source":"' || source || '"') || '}}', ',' ORDER BY carrier_ord, ord) AS x FROM uh GROUP BY doc_id), l AS (SELECT doc_id, string_agg('{{"subject":"' || subject || '","detail":"' || detail || '"}}', ',' ORDER BY subject, detail) AS x FROM lo GROUP BY doc_id)
    SELECT ds.doc_id, '{{"document":' || raw || ',"analysis":{{"summary":{{"nodes":' || su.nodes || ',"edges":' || su.edges || ',"paths_to_output":' || paths_to_output || ',"inferred_elements":' || inferred_elements || ',"entry_points":' || CASE WHEN entry_points = '' THEN '[]' ELSE {_list("string_split(entry_points, ',')")} END || ',"terminals":' || CASE WHEN terminals = '' THEN '[]' ELSE {_list("string_split(terminals, ',')")} END
      || '}},"paths":[' || coalesce(p.x, '') || '],"rag":[' || coalesce(r.x, '') || '],"agents_using_tools":{{' || coalesce(a.x, '') || '}},"unhandled":[' || coalesce(h.x, '') || '],"low_trust":[' || coalesce(l.x, '') || '],"unreachable":[' || coalesce(u.x, '') || ']}}}}' AS payload
    FROM ds LEFT JOIN su USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN u USING (doc_id)""")
def k4_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with all analyses of its graph."""
    return payload.payload(projected(spark, sf_dir, "j_sound"), small(spark, sf_dir))


_ASKED = ["Where does retrieval happen?", "If the N1 fails, what then?", "Which tools can agents call?", "Please find missing error handling", "Show every flow end-to-end", "What was inferred or guessed?", "What is the blast radius of n2?", "What depends on n3?", "What is again?", "Tell me about the step", "Give an overview"]
_KINDS = ["rag", "impact", "tools", "failures", "paths", "trust", "impact", "impact", "describe", "describe", "summary"]
_LINE = "chr(10) || '  ' || "


def _answer(i: int, found: str, none: str) -> str:
    """Question `i` of every document: text and cites of `found` (doc_id, text, cites), else `none`."""
    return f"SELECT d.doc_id, {i} AS question_id, '{_KINDS[i]}' AS matched, coalesce(f.text, '{none}') AS text, coalesce(f.cites, '') AS cites FROM docs d LEFT JOIN ({found}) f ON f.doc_id = d.doc_id"


@query(f"""WITH RECURSIVE {duck('w_turns', 'w_nodes', 'w_edges', 'w_failures', 'w_registry', 'w_contexts')}, docs AS (SELECT DISTINCT doc_id FROM w_turns), fn AS (SELECT doc_id, id, arg_min(type, ord) AS type, min(ord) AS ord FROM w_nodes GROUP BY doc_id, id),
    targets AS (SELECT DISTINCT doc_id, id FROM w_nodes WHERE id IN ('n1', 'n2', 'n3')), reach AS (
      SELECT doc_id, id AS failed, id FROM targets UNION SELECT t.doc_id, t.id, e.source FROM targets t JOIN w_edges e ON e.doc_id = t.doc_id AND e.target = t.id AND e.type IN ('retrieves', 'uses')
      UNION SELECT r.doc_id, r.failed, e.target FROM reach r JOIN w_edges e ON e.doc_id = r.doc_id AND e.source = r.id),
    hit AS (SELECT r.doc_id, r.failed, n.id, n.ord, n.type FROM (SELECT DISTINCT * FROM reach) r JOIN w_nodes n ON n.doc_id = r.doc_id AND n.id = r.id WHERE r.failed <> r.id),
    hits AS (SELECT doc_id, failed, count(*) AS n, string_agg({_LINE} id || ' (' || type || ')', '' ORDER BY ord) AS x, string_agg(id, ',' ORDER BY ord, id) AS ids, string_agg(id, ', ' ORDER BY ord, id) FILTER (type = 'output') AS ends FROM hit GROUP BY doc_id, failed),
    ra AS {_cte('g6_rag_components')}, ag AS {_cte('g7_agents_using_tools')}, uh AS {_cte('g8_unhandled_failures')}, gp AS {_cte('g5_rendered_paths')}, su AS {_cte('a1_summary')}, p4 AS {_cte('g4_paths_to_outputs')}, lo AS {_cte('g9_low_trust')},
    claims AS (SELECT doc_id, id FROM w_nodes WHERE method = 'ai_inference' UNION SELECT doc_id, id FROM w_edges WHERE method = 'ai_inference' UNION SELECT doc_id, id FROM w_contexts WHERE kind = 'node' AND method = 'ai_inference'),
    impacts AS (SELECT t.doc_id, t.id, CASE WHEN h.n IS NULL THEN 'No other part needs ' || t.id || '.' ELSE 'Without ' || t.id || ' (' || f.type || ') ' || h.n || ' others stop working:' || h.x || coalesce(chr(10) || '  No other way leads to ' || h.ends, '') END AS text, CASE WHEN h.n IS NULL THEN '' ELSE t.id || ',' || h.ids END AS cites FROM targets t JOIN fn f ON f.doc_id = t.doc_id AND f.id = t.id LEFT JOIN hits h ON h.doc_id = t.doc_id AND h.failed = t.id),
    named AS (
      SELECT d.doc_id, 8 AS q, 'again' AS t FROM docs d UNION ALL SELECT d.doc_id, 9, 'step' FROM docs d),
    met AS (SELECT a.doc_id, a.q, n.id, n.type, n.ord, CASE WHEN lower(n.id) = t THEN 0 WHEN lower(coalesce(n.name, '')) = t THEN 1 ELSE 2 END AS rank FROM named a JOIN w_nodes n ON n.doc_id = a.doc_id AND (lower(n.id) = t OR lower(coalesce(n.name, '')) = t OR contains(lower(n.id), t) OR contains(lower(coalesce(n.name, '')), t))),
    best AS (SELECT doc_id, q, arg_min(id, rank * 1000 + ord) AS id, arg_min(type, rank * 1000 + ord) AS type, min(rank) AS rank, count(*) AS n FROM met GROUP BY doc_id, q HAVING min(rank) < 2 OR count(*) = 1),
    ends AS (SELECT doc_id, source AS id, 1 AS side, ord, 'goes --' || type || '--> ' || target AS x FROM w_edges UNION ALL SELECT doc_id, target, 0, ord, 'gets ' || source || ' --' || type || '-->' FROM w_edges), lines AS (SELECT doc_id, id, string_agg({_LINE} x, '' ORDER BY side, ord) AS x FROM ends GROUP BY doc_id, id),
    defined AS (SELECT n.doc_id, n.id, min(r.id) AS entry FROM w_nodes n JOIN w_registry r ON r.doc_id = n.doc_id AND r.id = n.ref AND r.registry = CASE n.type WHEN 'llm' THEN 'models' WHEN 'tool' THEN 'tools' WHEN 'prompt' THEN 'prompts' WHEN 'vector_store' THEN 'data_sources' WHEN 'retriever' THEN 'data_sources' END GROUP BY n.doc_id, n.id),
    said AS ({_answer(0, f"SELECT doc_id, 'Components that take part in retrieval:' || string_agg({_LINE} id || ' (' || type || ')', '' ORDER BY ord) AS text, (SELECT string_agg(id, ',' ORDER BY o) FROM (SELECT doc_id, id, min(ord) AS o FROM ra GROUP BY doc_id, id) z WHERE z.doc_id = ra.doc_id) AS cites FROM ra GROUP BY doc_id", 'Nothing retrieves here.')}
      UNION ALL {_answer(2, f"SELECT g.doc_id, 'Tools within reach of each agent:' || string_agg({_LINE} agent || ' -> ' || tools, '' ORDER BY f.ord) AS text, NULL AS cites FROM (SELECT doc_id, agent, string_agg(tool, ', ' ORDER BY tool) AS tools FROM ag GROUP BY doc_id, agent) g JOIN fn f ON f.doc_id = g.doc_id AND f.id = g.agent GROUP BY g.doc_id", 'No agent has a tool within reach.')}
      UNION ALL {_answer(3, f"SELECT doc_id, 'Failures that nothing handles:' || string_agg({_LINE} subject || CASE WHEN inferred THEN ' [inferred]' ELSE '' END || ': ' || detail || coalesce(' (' || source || ')', ''), '' ORDER BY carrier, carrier_ord) || CASE WHEN bool_or(inferred) THEN {_LINE} 'What is marked [inferred] was said by a model, not read from code.' ELSE '' END AS text, NULL AS cites FROM uh GROUP BY doc_id", 'Every failure is handled.')}
      UNION ALL {_answer(5, f"SELECT doc_id, 'Claims that were inferred stand on:' || string_agg({_LINE} x, '' ORDER BY part, id, x) AS text, NULL AS cites FROM (SELECT doc_id, 0 AS part, id, id AS x FROM claims UNION ALL SELECT l.doc_id, 1, NULL, 'to review: ' || subject || ': ' || detail FROM lo l WHERE l.doc_id IN (SELECT doc_id FROM claims)) GROUP BY doc_id", 'No claim was inferred.')}
      UNION ALL {_answer(4, f"SELECT doc_id, count(*) || ' ways lead from an input to an output:' || string_agg({_LINE} place || '. ' || text, '' ORDER BY place) AS text, (SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT doc_id, unnest(string_split(nodes, '>')) AS x FROM p4) u WHERE u.doc_id = gp.doc_id) AS cites FROM gp GROUP BY doc_id", 'No way leads from an input to an output.')}
      UNION ALL SELECT doc_id, 10, 'summary', nodes || ' nodes, ' || edges || ' edges, ' || paths_to_output || ' ways to an output.' || chr(10) || '  nodes: ' || node_types || chr(10) || '  edges: ' || edge_types, '' FROM su
      UNION ALL SELECT i.doc_id, CASE i.id WHEN 'n1' THEN 1 WHEN 'n2' THEN 6 ELSE 7 END, 'impact', i.text, i.cites FROM impacts i
      UNION ALL SELECT b.doc_id, b.q, 'describe', b.id || ' (' || b.type || ')' || coalesce(chr(10) || '  Defined as ' || f.entry, '') || coalesce(l.x, ''), b.id FROM best b LEFT JOIN lines l ON l.doc_id = b.doc_id AND l.id = b.id LEFT JOIN defined f ON f.doc_id = b.doc_id AND f.id = b.id)
    SELECT doc_id, CAST(question_id AS BIGINT) AS question_id, matched, text, CASE WHEN matched IN ('tools', 'failures', 'trust') THEN NULL ELSE cites END AS cites FROM said""")
def q_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in full, questions for every rule; what cannot be resolved has no row."""
    from loomgraph.operators import questions

    docs = projected(spark, sf_dir, "w_turns").select("doc_id").distinct()
    asked = docs.select("doc_id", F.posexplode(F.array(*map(F.lit, _ASKED))).alias("question_id", "question")).withColumn("question_id", F.col("question_id").cast("long"))
    found = questions.answers(asked, small(spark, sf_dir)).where("matched is not null")
    cites = F.when(~F.col("matched").isin("tools", "failures", "trust"), F.array_join("cites", ","))
    return found.select("doc_id", "question_id", "matched", "text", cites.alias("cites"))


PROJECTIONS |= {
    "y_refs": """SELECT page_id AS id, CASE page_id % 5 WHEN 0 THEN concat('http://github.com/', split_part(url, '/', 3), '/p', CAST(page_id AS STRING), '/') WHEN 1 THEN concat('https://github.com/own/', split_part(url, '/', 3), '.git') WHEN 2 THEN concat('https://example.org/', CAST(page_id AS STRING)) WHEN 3 THEN concat('https://github.com/own/a/b', CAST(page_id AS STRING)) ELSE concat('https://github.com/own/r', CAST(page_id AS STRING)) END AS repository,
        CASE WHEN page_id % 7 > 0 THEN left(md5(url), 12) END AS revision, CASE page_id % 3 WHEN 0 THEN 'src//' WHEN 1 THEN '' END AS root, concat('m', CAST(page_id AS STRING), '.py') AS file, CASE WHEN page_id % 4 > 0 THEN page_id % 50 + 1 END AS line, CASE WHEN page_id % 6 > 1 THEN page_id % 50 + page_id % 6 - 1 END AS upto,
        CASE WHEN page_id % 11 = 0 THEN url WHEN page_id % 11 = 1 THEN concat('javascript:', url) END AS own FROM {pages}""",
}


@query(f"""WITH {duck('y_refs')} SELECT id, CASE WHEN own <> '' THEN CASE WHEN regexp_matches(own, '^https?://') THEN own END
      WHEN revision <> '' AND regexp_matches(repository, '^https?://github\\.com/[^/]+/[^/]+?(\\.git)?/?$') THEN 'https://github.com/' || regexp_extract(repository, '^https?://github\\.com/([^/]+/[^/]+?)(\\.git)?/?$', 1) || '/blob/' || revision || '/' || CASE WHEN root <> '' THEN rtrim(root, '/') || '/' ELSE '' END || file
        || CASE WHEN line > 0 THEN '#L' || line || CASE WHEN upto > 0 AND upto <> line THEN '-L' || upto ELSE '' END ELSE '' END END AS link FROM y_refs""")
def y5_permalinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.operators.text import permalink

    link = permalink(*map(F.col, ("repository", "revision", "root", "file", "line", "upto", "own")))
    return projected(spark, sf_dir, "y_refs").select("id", link.alias("link"))


@query(f"""WITH {duck('w_nodes', 'w_edges', 'w_registry')} SELECT doc_id, 'node' AS kind, id, min(ord) AS ord, arg_min(type, ord) AS told FROM w_nodes WHERE id = 'n1' GROUP BY doc_id, id UNION ALL SELECT doc_id, 'edge', id, min(ord), arg_min(type, ord) FROM w_edges WHERE id = 'e4' GROUP BY doc_id, id
    UNION ALL SELECT doc_id, 'models', id, min(ord), arg_min(coalesce(method, '-'), ord) FROM w_registry WHERE registry = 'models' GROUP BY doc_id, id""")
def f1_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first node and edge of an id in every document, and the entries of one registry."""
    from loomgraph.operators.corpus import first_by_id

    c = small(spark, sf_dir)
    part = lambda rows, kind, told: rows.select("doc_id", F.lit(kind).alias("kind"), "id", "ord", told.alias("told"))
    out = part(first_by_id(c.nodes).where("id = 'n1'"), "node", F.col("type")).unionByName(part(first_by_id(c.edges).where("id = 'e4'"), "edge", F.col("type")))
    return out.unionByName(part(first_by_id(c.registry.where("registry = 'models'"), "registry"), "models", F.coalesce("method", F.lit("-"))))


@query(f"WITH {duck('w_nodes')} SELECT doc_id, type, count(*) AS nodes FROM w_nodes GROUP BY doc_id, type")
def a5_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small(spark, sf_dir).nodes.groupBy("doc_id", "type").agg(F.count("*").alias("nodes"))


@query(f"""WITH RECURSIVE {duck('w_nodes', 'w_edges')}, pairs AS (SELECT DISTINCT a.doc_id, a.id AS start, b.id AS goal FROM w_nodes a JOIN w_nodes b ON a.doc_id = b.doc_id AND a.type = 'agent' AND b.type IN ('output', 'tool')),
    walk AS (SELECT doc_id, start, goal, start AS cur, [start] AS nodes, CAST([] AS VARCHAR[]) AS eids, CAST([] AS BIGINT[]) AS ords FROM pairs
      UNION ALL SELECT w.doc_id, w.start, w.goal, e.target, list_append(w.nodes, e.target), list_append(w.eids, e.id), list_append(w.ords, e.ord) FROM walk w JOIN w_edges e ON e.doc_id = w.doc_id AND e.source = w.cur WHERE w.cur <> w.goal AND NOT list_contains(w.nodes, e.target)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start, goal ORDER BY ords) AS place FROM walk WHERE cur = goal)
    SELECT doc_id, start, goal, place, array_to_string(nodes, '>') AS nodes, array_to_string(eids, '>') AS edges FROM placed WHERE place <= 3""")
def g3_simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three paths from each agent to each tool and output."""
    c = small(spark, sf_dir)
    agents = c.nodes.where("type = 'agent'").select("doc_id", F.col("id").alias("start"))
    goals = c.nodes.where("type in ('output', 'tool')").select("doc_id", F.col("id").alias("goal"))
    found = graph.simple_paths(c.edges, graph.stored(agents.join(goals, "doc_id").distinct()), 3)
    return found.select("doc_id", "start", "goal", "place", F.array_join("nodes", ">").alias("nodes"), F.array_join("edge_ids", ">").alias("edges"))
