"""Registered queries over raw JSON documents, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.structure import KINDS, NEED_REF, NO_REF, OPEN
from loomgraph.operators import budget, corpus as co, diff, enrich, structure, text, validate
from loomgraph.plans.projections import duck, projected
from loomgraph.plans.queries import _ALL, _V, _v_sql, query
from loomgraph.sources import documents

FORMAT = "flow"


def _listed(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _properties() -> str:
    rows = []
    for kind, properties in KINDS.items():
        for key, told in properties.items():
            holds = told.removesuffix(" !").removeprefix("list of ")
            choices = holds.removeprefix("one of ").split() if holds.startswith("one of ") else []
            rows.append(f"('{kind}', '{key}', {told.startswith('list of ')}, '{'choice' if choices else holds}', CAST({choices} AS VARCHAR[]), {told.endswith('!')})")
    return "props(kind, key, many, holds, choices, needed) AS (VALUES " + ", ".join(rows) + ")"


#: `val`: each place of each document with what it should hold; `l1`: the places that do not fit.
_L1 = f"""{_properties()}, val AS (
      SELECT doc_id, '$' AS path, 'document' AS holds, FALSE AS many, CAST([] AS VARCHAR[]) AS choices, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS v FROM j_docs
      UNION ALL SELECT * FROM (
        SELECT doc_id, path || '[''' || p.key || ''']', p.holds, p.many, p.choices, json_extract(v, '$."' || p.key || '"') FROM val JOIN props p ON p.kind = val.holds WHERE NOT val.many AND json_type(v) = 'OBJECT' AND list_contains(json_keys(v), p.key)
        UNION ALL SELECT doc_id, path || '[' || i || ']', holds, FALSE, choices, json_extract(v, '$[' || i || ']') FROM (SELECT *, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS i FROM val WHERE many AND json_type(v) = 'ARRAY'))),
    told AS (SELECT *, coalesce(json_type(v), 'NONE') AS t, v->>'$' AS s FROM val),
    fits AS (SELECT *, CASE WHEN many THEN t = 'ARRAY' WHEN holds = 'string' THEN t = 'VARCHAR' WHEN holds = 'boolean' THEN t = 'BOOLEAN' WHEN holds = 'format' THEN t = 'VARCHAR' AND s = '{FORMAT}' WHEN holds = 'choice' THEN t = 'VARCHAR' AND list_contains(choices, s)
      WHEN holds = 'id' THEN t = 'VARCHAR' AND regexp_full_match(s, '[A-Za-z][A-Za-z0-9_.:-]{{0,127}}') WHEN holds = 'commit' THEN t = 'VARCHAR' AND regexp_full_match(s, '[0-9a-f]{{7,40}}') WHEN holds = 'version' THEN t = 'VARCHAR' AND regexp_full_match(s, '1[.][0-9]+')
      WHEN holds IN ('number', 'share', 'count') THEN t IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND CASE holds WHEN 'share' THEN TRY_CAST(s AS DOUBLE) BETWEEN 0 AND 1 WHEN 'count' THEN TRY_CAST(s AS DOUBLE) >= 1 AND TRY_CAST(s AS DOUBLE) = floor(TRY_CAST(s AS DOUBLE)) ELSE TRUE END
      ELSE t = 'OBJECT' END AS fit FROM told),
    obj AS (SELECT doc_id, path, holds AS kind, v, json_keys(v) AS keys FROM fits WHERE fit AND NOT many AND holds IN (SELECT kind FROM props)),
    l1 AS (SELECT doc_id, path FROM fits WHERE NOT fit
      UNION ALL SELECT DISTINCT doc_id, path FROM (SELECT doc_id, path, kind, unnest(keys) AS key FROM obj WHERE kind NOT IN {_listed(OPEN)}) k WHERE NOT EXISTS (SELECT 1 FROM props p WHERE p.kind = k.kind AND p.key = k.key)
      UNION ALL SELECT doc_id, path FROM obj JOIN props p ON p.kind = obj.kind AND p.needed WHERE NOT list_contains(keys, p.key)
      UNION ALL SELECT doc_id, path FROM obj WHERE kind = 'provenance' AND v->>'$.method' = 'ai_inference' AND NOT list_contains(keys, 'confidence')
      UNION ALL SELECT doc_id, path || '[''ref'']' FROM obj WHERE kind = 'node' AND v->>'$.type' IN {_listed(NO_REF)} AND list_contains(keys, 'ref')
      UNION ALL SELECT doc_id, path FROM obj WHERE kind = 'node' AND v->>'$.type' IN {_listed(NEED_REF)} AND NOT list_contains(keys, 'ref')
      UNION ALL SELECT doc_id, path FROM obj WHERE kind = 'edge' AND v->>'$.type' = 'routes_to' AND NOT list_contains(keys, 'when') AND coalesce(v->>'$.default', 'false') <> 'true')"""


@query(f"WITH RECURSIVE {duck('j_docs')}, {_L1} SELECT doc_id, 'AF100' AS code, 'error' AS severity, path FROM l1")
def l1_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.validate_structural(projected(spark, sf_dir, "j_docs"), FORMAT)


def _items(kind: str, inner: str = "") -> str:
    """SQL for (doc_id, i, x): the items of a list of each sound document; with `inner`, (doc_id, i, j, y) of a list within."""
    sql = f"SELECT doc_id, i, json_extract(d, '$.{kind}[' || i || ']') AS x FROM (SELECT doc_id, d, unnest(range(CAST(json_array_length(d, '$.{kind}') AS BIGINT))) AS i FROM jd)"
    return f"SELECT doc_id, i, j, json_extract(x, '$.{inner}[' || j || ']') AS y FROM (SELECT doc_id, i, x, unnest(range(CAST(json_array_length(x, '$.{inner}') AS BIGINT))) AS j FROM ({sql}) WHERE json_exists(x, '$.{inner}'))" if inner else sql


_TRUST = "x->>'$.provenance.method' AS method, CAST(x->>'$.provenance.confidence' AS DOUBLE) AS confidence, coalesce(json_array_length(x, '$.provenance.evidence'), 0) > 0 AS has_evidence, x->>'$.provenance.reviewed_by' AS reviewed_by"
_TABLES = f"""jd AS (SELECT doc_id, CAST(raw AS JSON) AS d FROM j_docs WHERE doc_id NOT IN (SELECT doc_id FROM l1)),
    w_nodes AS (SELECT doc_id, i AS ord, x->>'$.id' AS id, x->>'$.type' AS type, x->>'$.name' AS name, x->>'$.ref' AS ref, {_TRUST} FROM ({_items("nodes")})),
    w_edges AS (SELECT doc_id, i AS ord, x->>'$.id' AS id, x->>'$.type' AS type, x->>'$.source' AS source, x->>'$.target' AS target, x->>'$.source_port' AS source_port, x->>'$.target_port' AS target_port, coalesce(x->>'$.default' = 'true', FALSE) AS is_default, {_TRUST} FROM ({_items("edges")})),
    w_registry AS ({" UNION ALL ".join(f"SELECT doc_id, '{k}' AS registry, i AS ord, x->>'$.id' AS id, {_TRUST} FROM ({_items(k)})" for k in ("prompts", "models", "tools", "data_sources"))}),
    w_ports AS ({" UNION ALL ".join(f"SELECT doc_id, i AS node_ord, '{k}' AS direction, y->>'$.name' AS name FROM ({_items('nodes', k)})" for k in ("inputs", "outputs"))}),
    w_depends AS (SELECT doc_id, i AS node_ord, j AS ord, y->>'$' AS node FROM ({_items("nodes", "depends_on")})),
    w_failures AS (SELECT doc_id, 'nodes' AS carrier, i AS carrier_ord, j AS ord, y->>'$.handler_node' AS handler_node FROM ({_items("nodes", "ai_context.failure_modes")})),
    w_variables AS (SELECT doc_id, i AS prompt_ord, j AS ord, y->>'$.source_node' AS source_node FROM ({_items("prompts", "variables")}))"""
#: As the tables of the documents have the names of those that the documents are made of, the latter stay inside.
_DOCS = f"j_docs AS (WITH {duck('j_docs')} SELECT doc_id, raw FROM j_docs)"
_SEMANTIC = _v_sql(*_V).replace(duck(*_ALL), f"{_DOCS}, {_L1}, {_TABLES}")


@query(f"""SELECT * FROM ({_SEMANTIC}) UNION ALL SELECT * FROM (WITH RECURSIVE {_DOCS}, {_L1}
    SELECT doc_id, CAST(0 AS INTEGER) AS rule_ord, CAST(0 AS BIGINT) AS item_ord, 'AF100' AS code, 'error' AS severity, path FROM l1 UNION ALL SELECT DISTINCT doc_id, 0, 0, 'AF002', 'warning', '$' FROM l1)""")
def v_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(projected(spark, sf_dir, "j_docs"), FORMAT)


@query(f"WITH {duck('j_sound')} SELECT doc_id, raw FROM j_sound")
def k1_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.encoded(projected(spark, sf_dir, "j_nulls"))


@query(rf"""WITH {duck('t_texts')}, s AS (SELECT id, trim(lower(regexp_replace(regexp_replace(regexp_replace(label, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '_') AS snake FROM t_texts)
    SELECT id, CASE WHEN snake = '' THEN 'x' ELSE snake END AS snake FROM s""")
def b1_snake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir, "t_texts").select("id", text.snake("label").alias("snake"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 90 THEN left(text, 89) || '…' ELSE text END AS brief FROM conversations")
def d7_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projected(spark, sf_dir, "conversations").select("conv_id", "turn", diff.brief("text").alias("brief"))


_NEEDLES = "SELECT DISTINCT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('STEP ', CAST(doc_id % 5 AS STRING)) ELSE concat('N', CAST(doc_id % 4 AS STRING)) END AS needle FROM w_turns"


@query(f"WITH {duck('w_turns', 'w_nodes')}, k AS ({_NEEDLES}) SELECT n.doc_id, n.ord, n.id, n.name, k.needle FROM w_nodes n JOIN k ON k.doc_id = n.doc_id WHERE contains(lower(n.id), lower(k.needle)) OR contains(lower(n.name), lower(k.needle))")
def f9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    needles = spark.sql(_NEEDLES.replace("w_turns", "{turns}"), turns=projected(spark, sf_dir, "w_turns"))
    return co.search(projected(spark, sf_dir, "w_nodes").select("doc_id", "ord", "id", "name"), needles)


@query(f"""WITH {duck('r_nodes', 'r_registry')}, k AS (SELECT doc_id, CASE type WHEN 'llm' THEN 'models' WHEN 'tool' THEN 'tools' WHEN 'prompt' THEN 'prompts' END AS registry, ref FROM r_nodes)
    SELECT r.doc_id, r.registry, r.id, count(k.ref) AS uses FROM (SELECT DISTINCT doc_id, registry, id FROM r_registry) r LEFT JOIN k ON k.doc_id = r.doc_id AND k.registry = r.registry AND k.ref = r.id GROUP BY ALL""")
def f9_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.usage(projected(spark, sf_dir, "r_nodes"), projected(spark, sf_dir, "r_registry"))


@query(f"""WITH {duck('w_nodes', 'w_edges', 'w_depends')}, known AS (SELECT doc_id, id FROM w_nodes UNION SELECT doc_id, id FROM w_edges), c AS (SELECT doc_id, node AS id, node_ord AS place FROM w_depends UNION ALL SELECT doc_id, target, ord FROM w_edges)
    SELECT doc_id, id, place FROM c WHERE (doc_id, id) IN (SELECT doc_id, id FROM known)""")
def j8_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = projected(spark, sf_dir, "w_nodes"), projected(spark, sf_dir, "w_edges")
    cites = projected(spark, sf_dir, "w_depends").select("doc_id", F.col("node").alias("id"), F.col("node_ord").alias("place"))
    return enrich.cited(cites.unionByName(edges.select("doc_id", F.col("target").alias("id"), F.col("ord").alias("place"))), nodes, edges)


@query(f"""WITH {duck('w_nodes', 'w_edges')}, asked AS (SELECT DISTINCT doc_id, ord % 3 AS batch, id FROM w_nodes WHERE type <> 'input')
    SELECT e.doc_id, e.ord % 3 AS batch, e.target AS id, e.ord AS place FROM w_edges e JOIN asked a ON a.doc_id = e.doc_id AND a.batch = e.ord % 3 AND a.id = e.target""")
def j9_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = projected(spark, sf_dir, "w_nodes"), projected(spark, sf_dir, "w_edges")
    batch = (F.col("ord") % 3).alias("batch")
    replies = edges.select("doc_id", batch, F.col("target").alias("id"), F.col("ord").alias("place"))
    return enrich.grounded(replies, nodes, nodes.where("type <> 'input'").select("doc_id", batch, "id"))


@query("""WITH r AS (SELECT conv_id, turn, sha256(coalesce(text, '')) AS key FROM conversations), c AS (SELECT sha256(coalesce(text, '')) AS key, arg_max(role, conv_id * 1000 + turn) AS response FROM conversations WHERE turn % 2 = 0 GROUP BY 1)
    SELECT r.conv_id, r.turn, r.key, c.response FROM r LEFT JOIN c ON c.key = r.key""")
def j11_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = projected(spark, sf_dir, "conversations").withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    cache = said.where("turn % 2 = 0").select("key", F.col("role").alias("response"), (F.col("conv_id") * 1000 + F.col("turn")).alias("stored_at"))
    return budget.hits_and_misses(said.select("conv_id", "turn", "key"), cache)
