"""Corpora derived from the given tables by plain SQL that Spark and DuckDB both run.

The tables given hold no workflow graphs.  Each projection makes such tables of theirs, so
that every operator runs over data that grows with them: `w_*` small graphs, one for each
conversation; `e_*` long chains, one for each user; `r_*` references into registries from
line items; `d_*` two versions of the orders; `l_*` a ledger of calls from events; `t_*`
texts from pages; `j_*` JSON documents of the small graphs, about half of them with a defect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TYPE = "CASE {n} WHEN 0 THEN 'agent' WHEN 1 THEN 'llm' WHEN 2 THEN 'tool' WHEN 3 THEN 'prompt' WHEN 4 THEN 'retriever' WHEN 5 THEN 'vector_store' ELSE 'condition' END"
_EDGE = "CASE {n} WHEN 0 THEN 'calls' WHEN 1 THEN 'uses' WHEN 2 THEN 'retrieves' WHEN 3 THEN 'passes' WHEN 4 THEN 'produces' ELSE 'routes_to' END"
_METHOD = "CASE ({n}) % 4 WHEN 0 THEN 'ai_inference' WHEN 1 THEN 'static_analysis' WHEN 2 THEN 'human' ELSE NULL END"


def _trust(n: str) -> str:
    return f"{_METHOD.format(n=n)} AS method, CAST((({n}) * 13) % 100 AS DOUBLE) / 100 AS confidence, ({n}) % 3 <> 0 AS has_evidence, CASE WHEN ({n}) % 9 = 0 THEN 'lee' WHEN ({n}) % 9 = 4 THEN '' END AS reviewed_by"


#: In order: each may use those before it, written {name}.
PROJECTIONS: dict[str, str] = {
    "w_turns": "SELECT DISTINCT conv_id AS doc_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM {conversations}",
    "w_nodes": f"""SELECT doc_id, turn AS ord, concat('n', CAST(turn AS STRING)) AS id,
        CASE WHEN turn = 0 THEN 'input' WHEN turn = last THEN 'output' ELSE {_TYPE.format(n="(doc_id + turn * 3) % 7")} END AS type,
        CASE WHEN turn % 2 = 0 THEN concat('Step ', CAST(turn AS STRING)) END AS name,
        CASE WHEN (doc_id + turn) % 4 = 3 THEN NULL ELSE concat('m', CAST((doc_id + turn) % 5 AS STRING)) END AS ref,
        {_trust("doc_id * 3 + turn")} FROM {{w_turns}}
        UNION ALL SELECT doc_id, last + 1 AS ord, 'n1' AS id, 'agent' AS type, 'again' AS name, NULL AS ref,
        NULL AS method, CAST(NULL AS DOUBLE) AS confidence, FALSE AS has_evidence, NULL AS reviewed_by FROM {{w_turns}} WHERE turn = 0 AND doc_id % 23 = 5 AND last > 1""",
    "w_edges": f"""SELECT doc_id, ord, concat('e', CAST(CASE WHEN ord = 5 AND doc_id % 29 = 3 THEN 4 ELSE ord END AS STRING)) AS id, type, source, target,
        CASE WHEN (doc_id + ord) % 13 = 0 THEN 'lost' WHEN (doc_id + ord) % 7 = 0 THEN 'out' END AS source_port,
        CASE WHEN (doc_id + ord) % 11 = 0 THEN 'in' END AS target_port, (doc_id + ord) % 3 = 0 AS is_default, {_trust("doc_id + ord")}
        FROM (
          SELECT doc_id, turn * 4 AS ord, {_EDGE.format(n="(doc_id + turn) % 6")} AS type, concat('n', CAST(turn AS STRING)) AS source, concat('n', CAST(turn + 1 AS STRING)) AS target FROM {{w_turns}} WHERE turn < last AND (doc_id + turn) % 17 <> 4
          UNION ALL SELECT doc_id, turn * 4 + 1, {_EDGE.format(n="(doc_id + turn * 5) % 6")}, concat('n', CAST(turn AS STRING)), concat('n', CAST(turn + 2 AS STRING)) FROM {{w_turns}} WHERE turn + 2 <= last AND (doc_id + turn) % 2 = 0
          UNION ALL SELECT doc_id, turn * 4 + 2, 'passes', concat('n', CAST(turn AS STRING)), concat('n', CAST(turn - 1 AS STRING)) FROM {{w_turns}} WHERE turn > 1 AND (doc_id + turn) % 5 = 0
          UNION ALL SELECT doc_id, turn * 4 + 3, 'calls', CASE WHEN doc_id % 2 = 0 THEN 'nowhere' ELSE 'n0' END, CASE WHEN doc_id % 3 = 0 THEN 'ghost' ELSE 'n1' END FROM {{w_turns}} WHERE turn = 0 AND doc_id % 11 = 0
        ) AS e""",
    "w_registry": f"""SELECT doc_id, registry, ord, concat('m', CAST(CASE WHEN ord = 3 AND doc_id % 7 = 2 THEN 0 ELSE ord END AS STRING)) AS id, {_trust("doc_id + ord * 5")}
        FROM (SELECT doc_id, CASE turn % 4 WHEN 0 THEN 'prompts' WHEN 1 THEN 'models' WHEN 2 THEN 'tools' ELSE 'data_sources' END AS registry, (turn * 3 + doc_id) % 4 AS ord FROM {{w_turns}}
          UNION SELECT doc_id, 'models' AS registry, 3 AS ord FROM {{w_turns}} UNION SELECT doc_id, 'models' AS registry, 0 AS ord FROM {{w_turns}}) AS r""",
    "w_ports": "SELECT doc_id, turn AS node_ord, 'outputs' AS direction, 'out' AS name FROM {w_turns} WHERE turn % 3 <> 2 UNION ALL SELECT doc_id, turn AS node_ord, 'inputs' AS direction, 'in' AS name FROM {w_turns} WHERE turn % 2 = 0",
    "w_depends": "SELECT doc_id, turn AS node_ord, CAST(0 AS BIGINT) AS ord, CASE WHEN (doc_id + turn) % 10 = 0 THEN 'gone' ELSE concat('n', CAST(turn - 1 AS STRING)) END AS node FROM {w_turns} WHERE turn > 0 AND turn % 3 = 1",
    "w_failures": """SELECT doc_id, CASE turn % 3 WHEN 0 THEN 'nodes' WHEN 1 THEN 'tools' ELSE 'data_sources' END AS carrier, turn AS carrier_ord, concat('n', CAST(turn AS STRING)) AS carrier_id, CAST(0 AS BIGINT) AS ord,
        concat('failure ', CAST(turn AS STRING)) AS description, CASE (doc_id + turn) % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS handled,
        CASE WHEN (doc_id * 3 + turn) % 4 = 0 THEN 'n0' WHEN (doc_id * 3 + turn) % 4 = 1 THEN 'nobody' END AS handler_node, concat('app.py:', CAST(turn + 1 AS STRING)) AS source, turn % 2 = 0 AS inferred FROM {w_turns} WHERE turn % 2 = 0 OR turn % 3 = 0""",
    "w_variables": "SELECT doc_id, turn AS prompt_ord, CAST(0 AS BIGINT) AS ord, CASE WHEN (doc_id + turn) % 6 = 0 THEN 'unknown' WHEN (doc_id + turn) % 6 < 4 THEN 'n0' END AS source_node FROM {w_turns} WHERE turn % 4 = 0",
    "w_contexts": f"SELECT doc_id, 'node' AS kind, turn AS ord, concat('n', CAST(turn AS STRING)) AS id, {_trust('doc_id * 5 + turn')}, concat('note ', CAST(turn AS STRING)) AS notes FROM {{w_turns}} WHERE turn % 2 = 1",
    "e_nodes": """SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS ord, concat('v', CAST(event_id AS STRING)) AS id,
        CASE event_type WHEN 'signup' THEN 'input' WHEN 'purchase' THEN 'output' WHEN 'error' THEN 'condition' WHEN 'click' THEN 'agent' ELSE 'tool' END AS type FROM {events}""",
    "e_edges": """SELECT a.doc_id, a.ord, concat('x', CAST(a.ord AS STRING)) AS id, CASE a.ord % 3 WHEN 0 THEN 'calls' WHEN 1 THEN 'passes' ELSE 'routes_to' END AS type, a.id AS source, b.id AS target
        FROM {e_nodes} a JOIN {e_nodes} b ON a.doc_id = b.doc_id AND b.ord = a.ord + 1 WHERE a.ord % 12 <> 11""",
    "r_nodes": """SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS ord, concat('n', CAST(l_linenumber AS STRING)) AS id,
        CASE l_linenumber % 4 WHEN 0 THEN 'llm' WHEN 1 THEN 'tool' WHEN 2 THEN 'prompt' ELSE 'agent' END AS type, concat('p', CAST(l_partkey % 40 AS STRING)) AS ref FROM {lineitem}""",
    "r_registry": """SELECT DISTINCT l_orderkey AS doc_id, CASE l_suppkey % 3 WHEN 0 THEN 'models' WHEN 1 THEN 'tools' ELSE 'prompts' END AS registry, l_partkey % 40 AS ord, concat('p', CAST(l_partkey % 40 AS STRING)) AS id FROM {lineitem} WHERE l_partkey % 7 <> 0""",
    "d_old": """SELECT 'nodes' AS kind, CAST(o_orderkey AS STRING) AS id, 'status' AS field, o_orderstatus AS value FROM {orders} WHERE o_orderkey % 2 = 0
        UNION ALL SELECT 'nodes', CAST(o_orderkey AS STRING), 'priority', o_orderpriority FROM {orders} WHERE o_orderkey % 2 = 0
        UNION ALL SELECT 'edges', CAST(o_orderkey AS STRING), 'target', CAST(o_custkey AS STRING) FROM {orders} WHERE o_orderkey % 2 = 1
        UNION ALL SELECT 'document', 'version', 'version', '1.0' FROM {region} WHERE r_regionkey = 0
        UNION ALL SELECT 'document', concat('project.', r_name), r_name, 'a' FROM {region}""",
    "d_new": """SELECT kind, CASE WHEN kind <> 'document' AND CAST(id AS BIGINT) % 17 = 3 THEN concat(id, '0000000') ELSE id END AS id, field,
        CASE WHEN kind <> 'document' AND CAST(id AS BIGINT) % 5 = 1 THEN concat(value, '!') WHEN kind = 'document' AND field <> 'AFRICA' THEN concat(value, '1') ELSE value END AS value
        FROM {d_old} WHERE kind = 'document' OR (CAST(id AS BIGINT) % 13 <> 4 AND NOT (field = 'priority' AND CAST(id AS BIGINT) % 19 = 6))""",
    "l_calls": "SELECT CAST(ts AS DATE) AS day, ts, event_id AS call_id, user_id FROM {events}",
    "t_texts": """SELECT page_id AS id, url, concat('You are ', split_part(url, '/', 3), '. Answer {{question}} from {{{{ context }}}} with {{', split_part(url, '/', 4), '}} in ', url) AS template,
        concat('Authorization: Bearer sk-', md5(url), ' for ', url) AS secret_text,
        concat('get', upper(substr(split_part(url, '.', 2), 1, 1)), substr(split_part(url, '.', 2), 2), 'HTTPResponse', CAST(page_id AS STRING), ' v-', split_part(url, '/', 4)) AS label FROM {pages}""",
}


def _json_trust(p: str) -> str:
    """The member `provenance` of an element; manual ones state no confidence."""
    method = f"CASE {p}method WHEN 'human' THEN 'manual' ELSE {p}method END"
    sure = f"CASE WHEN {p}method <> 'human' THEN concat(',\"confidence\":', CAST({p}confidence AS STRING)) ELSE '' END"
    shown = f"CASE WHEN {p}has_evidence THEN ',\"evidence\":[{{{{\"file\":\"app.py\",\"start_line\":3}}}}]' ELSE '' END"
    read = f"CASE WHEN {p}reviewed_by IS NOT NULL THEN concat(',\"reviewed_by\":\"', {p}reviewed_by, '\"') ELSE '' END"
    return f"CASE WHEN {p}method IS NOT NULL THEN concat(',\"provenance\":{{{{\"method\":\"', {method}, '\"', {sure}, {shown}, {read}, '}}}}') ELSE '' END"


_SAID = "replace(replace(replace(replace(replace(t.text, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n')), chr(9), ' '), chr(13), ' ')"
_ENTRIES = {
    "prompts": """concat('{{"id":"', id, '","role":"user","template_format":"f-string","variables":[{{"name":"question","source_node":"n', CAST(ord AS STRING), '"}}]', {trust}, '}}')""",
    "models": """concat('{{"id":"', id, '","provider":"own","model":"small","parameters":{{"max_tokens":100,"stop":["x"],"temperature":0.5}}', {trust}, '}}')""",
    "tools": """concat('{{"id":"', id, '","name":"tool ', id, '","kind":"function","returns":{{"type":"string"}},"idempotent":true', {trust}, '}}')""",
    "data_sources": """concat('{{"id":"', id, '","kind":"vector_store","config":{{"dimensions":8,"metric":"cosine"}}', {trust}, '}}')""",
}
#: Defects by the remainder of the document's id, one for each group of structural rules.
DEFECTS = [
    ('"version":"1.1"', '"version":"2.0"'), ('"source":"n0"', '"source":"0n"'), ('"commit":"abcdef1"', '"commit":"XYZ"'), ('"start_line":3', '"start_line":0.5'),
    ('"method":"manual"', '"method":"robot"'), ('"method":"manual"', '"method":"ai_inference"'), ('"name":"out"', '"title":"out"'), ('"description":"failure', '"about":"failure'),
    ('"type":"output"', '"type":"robot"'), ('"type":"input"', '"type":"input","ref":null'), ('"type":"output"', '"type":"tool"'), ('"payload":{{', '"payload":{{"more":1,'),
    ('"when":', '"label":'), ('"role":"user"', '"role":"king"'), ('"max_tokens":100', '"max_tokens":0'), ('"kind":"function"', '"kind":"magic"'), ('"metric":"cosine"', '"metric":"far"'),
    ('"extensions":{{"x":1}}', '"extensions":[1]'),
]
_BROKEN = " ".join(f"WHEN {i} THEN replace(raw, '{a}', '{b}')" for i, (a, b) in enumerate(DEFECTS, 1))
_LISTED = "SELECT doc_id, LISTAGG(x, ',') WITHIN GROUP (ORDER BY ord) AS x FROM "
PROJECTIONS |= {
    "j_nodes": f"""SELECT n.doc_id, n.ord, concat('{{{{"id":"', n.id, '","type":"', n.type, '"', CASE WHEN n.name IS NOT NULL THEN concat(',"name":"', n.name, '"') ELSE '' END, CASE WHEN t.text IS NOT NULL THEN concat(',"description":"', {_SAID}, '"') ELSE '' END,
        CASE WHEN n.type IN ('llm', 'tool', 'prompt', 'vector_store') OR (n.type = 'retriever' AND n.ref IS NOT NULL) THEN concat(',"ref":"', coalesce(n.ref, 'm9'), '"') ELSE '' END,
        CASE WHEN n.ord % 2 = 0 THEN ',"inputs":[{{{{"name":"in"}}}}]' ELSE '' END, CASE WHEN n.ord % 3 <> 2 THEN ',"outputs":[{{{{"name":"out","required":true}}}}]' ELSE '' END,
        CASE WHEN n.ord % 3 = 1 THEN concat(',"depends_on":["n', CAST(n.ord - 1 + n.doc_id % 3 AS STRING), '"]') ELSE '' END, CASE WHEN n.ord % 4 = 0 THEN concat(',"source":[{{{{"file":"app.py","start_line":', CAST(n.ord + 1 AS STRING), ',"symbol":"f"}}}}]') ELSE '' END,
        CASE WHEN n.ord % 2 = 1 THEN concat(',"ai_context":{{{{"summary":"', coalesce(t.role, 'none'), '","failure_modes":[{{{{"description":"failure ', CAST(n.ord AS STRING), '","handled":', CASE WHEN n.ord % 3 = 0 THEN 'true' ELSE 'false' END, ',"handler_node":"n', CAST(n.ord + n.doc_id % 4 AS STRING), '"}}}}]}}}}') ELSE '' END,
        {_json_trust("n.")}, '}}}}') AS x FROM {{w_nodes}} n LEFT JOIN (SELECT conv_id, turn, min(text) AS text, min(role) AS role FROM {{conversations}} GROUP BY conv_id, turn) t ON t.conv_id = n.doc_id AND t.turn = n.ord""",
    "j_edges": f"""SELECT doc_id, ord, concat('{{{{"id":"', id, '","type":"', type, '","source":"', source, '","target":"', target, '"', CASE WHEN source_port IS NOT NULL THEN concat(',"source_port":"', source_port, '"') ELSE '' END, CASE WHEN target_port IS NOT NULL THEN concat(',"target_port":"', target_port, '"') ELSE '' END,
        CASE WHEN type = 'routes_to' AND NOT is_default THEN ',"when":"route"' ELSE '' END, CASE WHEN is_default THEN ',"default":true' ELSE '' END, CASE WHEN type = 'passes' THEN ',"payload":{{{{"type":"text"}}}}' ELSE '' END, {_json_trust("")}, '}}}}') AS x FROM {{w_edges}}""",
    "j_entries": " UNION ALL ".join(f"SELECT doc_id, '{k}' AS registry, ord, {x.replace('{trust}', _json_trust(''))} AS x FROM {{w_registry}} WHERE registry = '{k}'" for k, x in _ENTRIES.items()),
    "j_sound": f"""SELECT d.doc_id, concat('{{{{"format":"flow","version":"1.1","project":{{{{"name":"c', CAST(d.doc_id AS STRING), '","commit":"abcdef1","frameworks":[{{{{"name":"own","version":"1"}}}}]}}}},"nodes":[', n.x, '],"edges":[', coalesce(e.x, ''), '],"prompts":[', coalesce(p.x, ''), '],"models":[', coalesce(m.x, ''), '],"tools":[', coalesce(u.x, ''), '],"data_sources":[', coalesce(s.x, ''),
        '],"metadata":{{{{"generated_at":"today","stats":{{{{"parts":4}}}}}}}},"extensions":{{{{"x":1}}}}}}}}') AS raw FROM (SELECT DISTINCT doc_id FROM {{w_turns}}) d JOIN ({_LISTED} {{j_nodes}} GROUP BY doc_id) n ON n.doc_id = d.doc_id LEFT JOIN ({_LISTED} {{j_edges}} GROUP BY doc_id) e ON e.doc_id = d.doc_id """
    + " ".join(f"LEFT JOIN ({_LISTED} {{j_entries}} WHERE registry = '{k}' GROUP BY doc_id) {a} ON {a}.doc_id = d.doc_id" for a, k in zip("pmus", _ENTRIES, strict=True)),
    "j_nulls": """SELECT doc_id, replace(raw, '[{{"description":"failure', '[{{"source":null,"description":"failure') AS raw FROM {j_sound}""",
    "j_docs": f"SELECT doc_id, CASE doc_id % 40 {_BROKEN} WHEN 19 THEN left(raw, 40) ELSE raw END AS raw FROM {{j_sound}}",
}


def _names(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"(?<!\{)\{([a-z_]+)\}(?!\})", sql)) if n in PROJECTIONS or n in TABLES]


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def projected(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The projection or given table of that name."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, using = PROJECTIONS[name], {}
    for n in _names(sql):
        view = f"{n}_{abs(hash(sf_dir))}"
        projected(spark, sf_dir, n).createOrReplaceTempView(view)
        using[n] = view
    return spark.sql(_filled(sql, using))


def _filled(sql: str, names: dict[str, str]) -> str:
    for n, view in names.items():
        sql = sql.replace("{" + n + "}", view)
    return sql.replace("{{", "{").replace("}}", "}")


def duck(*names: str) -> str:
    """Common table expressions of the projections named and all that they use, for DuckDB."""
    wanted: dict[str, str] = {}

    def add(n: str) -> None:
        if n in PROJECTIONS and n not in wanted:
            for used in _names(PROJECTIONS[n]):
                add(used)
            told = _filled(PROJECTIONS[n], {u: u for u in _names(PROJECTIONS[n])})
            wanted[n] = re.sub(r"LISTAGG\((\w+), ','\) WITHIN GROUP \(ORDER BY (\w+)\)", r"string_agg(\1, ',' ORDER BY \2)", told)

    for n in names:
        add(n)
    return ",\n".join(f"{n} AS ({sql})" for n, sql in wanted.items())
