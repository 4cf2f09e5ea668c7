"""Registered queries of enrichment and of what outlives a run, with DuckDB SQL for those SQL can express."""

from __future__ import annotations

import json
import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import budget, enrich, enrichment, stores
from loomgraph.operators.graph import shared_folder
from loomgraph.plans.projections import PROJECTIONS, duck, projected
from loomgraph.plans.queries import query
from loomgraph.sources import documents, files

PROJECTIONS |= {
    "w_described": """SELECT n.doc_id, n.ord, n.id, n.type, n.name, n.ref, t.text AS description FROM {w_nodes} n LEFT JOIN (SELECT conv_id, turn, min(text) AS text FROM {conversations} GROUP BY conv_id, turn) t ON t.conv_id = n.doc_id AND t.turn = n.ord""",
    "w_replies": "SELECT concat(role, ' ', CAST(conv_id % 50 AS STRING)) AS key, text AS response, conv_id * 100 + turn AS moment, conv_id % 2 AS run FROM {conversations}",
}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _quoted(x: str) -> str:
    """DuckDB SQL for a JSON string of printable ASCII."""
    one = "CASE WHEN c = chr(92) THEN repeat(chr(92), 2) WHEN c = '\"' THEN chr(92) || '\"' WHEN c = chr(10) THEN chr(92) || 'n' WHEN c = chr(9) THEN chr(92) || 't' WHEN c = chr(13) THEN chr(92) || 'r' WHEN unicode(c) > 126 OR unicode(c) < 32 THEN chr(92) || 'u' || format('{:04x}', unicode(c)) ELSE c END"
    return f"'\"' || coalesce(list_aggregate(list_transform(string_split({x}, ''), lambda c: {one}), 'string_agg', ''), '') || '\"'"


_DESCRIBED = f"""{duck('w_described', 'w_registry', 'w_edges')}, lines AS (SELECT doc_id, target AS id, 'in' AS side, string_agg({_quoted("source || ' --' || type || '-->'")}, ', ' ORDER BY ord) AS x FROM w_edges GROUP BY doc_id, target
      UNION ALL SELECT doc_id, source, 'out', string_agg({_quoted("'--' || type || '--> ' || target")}, ', ' ORDER BY ord) FROM w_edges GROUP BY doc_id, source),
    known AS (SELECT DISTINCT n.doc_id, n.ord FROM w_described n JOIN w_registry r ON r.doc_id = n.doc_id AND r.id = n.ref AND r.registry = CASE n.type WHEN 'llm' THEN 'models' WHEN 'tool' THEN 'tools' WHEN 'prompt' THEN 'prompts' WHEN 'vector_store' THEN 'data_sources' WHEN 'retriever' THEN 'data_sources' END),
    described AS (SELECT n.doc_id, n.ord, n.id, '{{' || concat_ws(', ', '"id": ' || {_quoted('n.id')}, '"type": ' || {_quoted('n.type')}, CASE WHEN n.name <> '' THEN '"name": ' || {_quoted('n.name')} END, CASE WHEN n.description <> '' THEN '"description": ' || {_quoted('n.description')} END,
        CASE WHEN k.ord IS NOT NULL THEN '"definition": {{"id": ' || {_quoted('n.ref')} || '}}' END, CASE WHEN n.ord % 4 = 0 THEN '"source": ["app.py:' || n.ord || '"]' END, '"incoming": [' || i.x || ']', '"outgoing": [' || o.x || ']') || '}}' AS description
      FROM w_described n LEFT JOIN known k ON k.doc_id = n.doc_id AND k.ord = n.ord LEFT JOIN lines i ON i.doc_id = n.doc_id AND i.id = n.id AND i.side = 'in' LEFT JOIN lines o ON o.doc_id = n.doc_id AND o.id = n.id AND o.side = 'out')"""
_BATCHED = f"""{_DESCRIBED}, i AS (SELECT *, length(description) AS chars, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM described),
    f AS (SELECT doc_id, ord, id, description, k, CAST(0 AS BIGINT) AS batch, 1 AS n, chars AS held FROM i WHERE k = 1
      UNION ALL SELECT i.doc_id, i.ord, i.id, i.description, i.k, CASE WHEN f.n >= 5 OR f.held + i.chars > 4000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.n >= 5 OR f.held + i.chars > 4000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 5 OR f.held + i.chars > 4000 THEN i.chars ELSE f.held + i.chars END
        FROM f JOIN i ON i.doc_id = f.doc_id AND i.k = f.k + 1)"""


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = projected(spark, sf_dir, "w_described")
    sourced = nodes.withColumn("sources", F.when(F.col("ord") % 4 == 0, F.array(F.concat(F.lit("app.py:"), "ord"))))
    return enrichment.described(sourced, projected(spark, sf_dir, "w_registry"), projected(spark, sf_dir, "w_edges"))


@query(f"WITH {_DESCRIBED} SELECT * FROM described")
def e1_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir)


@query(f"WITH RECURSIVE {_BATCHED} SELECT doc_id, ord, id, batch FROM f")
def e2_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = described(spark, sf_dir).select("doc_id", "ord", "id", F.length("description").alias("chars"))
    placed = enrich.batches(items.withColumn("id", F.col("ord").cast("string")))
    return placed.select("doc_id", F.col("id").cast("long").alias("ord"), "batch").join(items, ["doc_id", "ord"]).select("doc_id", "ord", "id", "batch")


@query(f"""WITH RECURSIVE {_BATCHED} SELECT doc_id, batch, count(*) AS asked, sha256('[' || {_quoted("'own'")} || ',' || {_quoted("'1'")} || ',[' || string_agg(description, ',' ORDER BY ord) || ']]') AS key FROM f GROUP BY doc_id, batch""")
def e3_request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.planned(described(spark, sf_dir), "own").select("doc_id", "batch", F.size("ids").cast("long").alias("asked"), "key")


def answer(request: str) -> tuple[str, str]:
    """A stand-in for a model, for want of a network: says something of every node but those that it forgets."""
    nodes = json.loads(request)
    said = {n["id"]: {"summary": f"{n['type']} {n['id']}", "confidence": len(n.get("incoming", [])) / 4, "failure_modes": [{"description": "late", "handled": True}, ""]} for n in nodes if n["type"] != "condition"}
    if len(request) % 5 == 3:
        return json.dumps({"nodes": said})[:-9], "length"
    return f"Here it is:\n```json\n{json.dumps({'nodes': said | {'invented': {'summary': 'x'}}})}\n```", "stop"


def run_enrichment(spark: SparkSession, sf_dir: str, folder: str, limit: int = 1 << 40) -> enrichment.Enriched:
    plan = enrichment.planned(described(spark, sf_dir), "own")
    return enrichment.enriched(plan, stores.replies(spark, f"{folder}/replies"), stores.Ledger(spark, f"{folder}/ledger", limit), answer, date(2026, 1, 2), datetime(2026, 1, 2, 3))


@query()
def e6_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What enrichment gives of each node: a context or why there is none.  Tests count the calls of a second run."""
    found = run_enrichment(spark, sf_dir, scratch(spark, "enrich"))
    none = F.lit(None)
    given = found.contexts.select("doc_id", "batch", "id", "summary", F.array_join("failure_modes", ";").alias("failures"), "confidence", none.cast("string").alias("reason"))
    return given.unionByName(found.skipped.select("doc_id", "batch", "id", none.cast("string").alias("summary"), none.cast("string").alias("failures"), none.cast("double").alias("confidence"), "reason"))


@query(f"WITH {duck('l_calls')}, r AS (SELECT day, call_id, row_number() OVER (PARTITION BY day ORDER BY ts, call_id) AS nth FROM l_calls) SELECT day, call_id, nth, nth > 50 AS refused FROM r")
def e4_daily_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all users together, fifty a day."""
    return budget.admitted(projected(spark, sf_dir, "l_calls"))


@query(f"WITH {duck('l_calls')} SELECT day, count(*) AS calls FROM l_calls WHERE day >= (SELECT max(day) FROM l_calls) - 10 GROUP BY day")
def k7_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of ten days that was written in three runs, days of the second also in the first."""
    calls = projected(spark, sf_dir, "l_calls").select("day", F.lit(1).alias("calls"), "call_id")
    last = calls.agg(F.max("day")).first()[0]
    ledger = stores.Ledger(spark, scratch(spark, "ledger"), days=10)
    if last is None:
        return calls.select("day", F.lit(0).cast("long").alias("calls")).limit(0)
    for rows, days_ago in ((calls.where(F.col("call_id") % 2 == 0), 9), (calls.where(F.col("call_id") % 2 == 1), 4)):
        today = spark.range(1).select(F.date_sub(F.lit(last), days_ago)).first()[0]
        ledger.record(rows.where(F.col("day") <= F.lit(today)).select("day", "calls"), today)
        calls = calls.join(rows.where(F.col("day") <= F.lit(today)).select("call_id"), "call_id", "left_anti")
    ledger.record(calls.select("day", "calls"), last)
    return ledger.used(last)


@query(f"WITH {duck('w_replies')} SELECT key, arg_max(response, moment) AS response FROM w_replies GROUP BY key")
def k7_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of replies that was written in two runs."""
    rows = projected(spark, sf_dir, "w_replies").withColumn("stored_at", F.timestamp_seconds("moment"))
    store = stores.replies(spark, scratch(spark, "replies"))
    for run in (0, 1):
        store.put(rows.where(F.col("run") == run).select("key", "response", "stored_at"))
    return store.rows().select("key", "response")


@query(f"WITH {duck('j_sound')} SELECT CAST(doc_id AS VARCHAR) AS name, raw FROM j_sound")
def k2_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document saved as a file of its own, and read back."""
    folder = scratch(spark, "files")
    files.save(documents.encoded(projected(spark, sf_dir, "j_nulls")), folder)
    back = files.saved(spark, folder).withColumnRenamed("name", "doc_id")
    return documents.encoded(back).withColumnRenamed("doc_id", "name")
