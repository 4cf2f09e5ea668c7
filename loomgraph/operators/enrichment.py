"""Enrichment of nodes by a model: what is asked, what it costs, what is called, and what replies give.

Nodes become descriptions, descriptions of a document batches, and a batch is known by a key
over all that can change its reply.  Only batches that the store of replies lacks are sent
to a client, once for equal ones, after the budget has been asked; the replies go into the
store by key, so a run that is repeated, or a task that runs twice, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.canonical import items, members, quoted, some
from loomgraph.operators import enrich
from loomgraph.operators.corpus import resolved_refs
from loomgraph.operators.graph import stored
from loomgraph.operators.stores import KeyedStore, Ledger

#: Fixed value: how much of a definition's or a reply's text is kept.
DEFINITION, SAID = 400, 200

#: A client takes a request (JSON text) and gives the reply's text and why it ended.
Client = Callable[[str], tuple[str, str]]


def described(nodes: DataFrame, registry: DataFrame, edges: DataFrame, overwrite: bool = False) -> DataFrame:
    """(doc_id, ord, id, description): all that a model may reason from about a node, as JSON text.

    nodes(doc_id, ord, id, type, name, ref and, if there are any, description, sources,
    has_context); registry as in a corpus and, if there are any, name, provider, model, kind,
    description, template.  Nodes with a context are left out unless `overwrite`.
    """
    if "has_context" in nodes.columns and not overwrite:
        nodes = nodes.where(~F.coalesce("has_context", F.lit(False)))
    text = lambda df, c, most=None: quoted(F.left(F.col(c), F.lit(most)) if most else F.col(c)) if c in df.columns else F.lit(None).cast("string")
    spaced = {"comma": ", ", "colon": ": "}
    told = {c: text(registry, c, DEFINITION) for c in ("provider", "model", "kind", "name", "description", "template")}
    entry = registry.select("doc_id", "registry", F.col("id").alias("entry_id"), F.col("ord").alias("entry_ord"), members(id=quoted(F.col("id")), **told, **spaced).alias("definition"))
    first = entry.groupBy("doc_id", "registry", "entry_id").agg(F.min_by("definition", "entry_ord").alias("definition"))
    refs = resolved_refs(nodes, registry).where("entry is not null").select("doc_id", "ord", "registry", F.col("ref").alias("entry_id"))
    defined = refs.join(first, ["doc_id", "registry", "entry_id"]).select("doc_id", "ord", "definition")
    line = lambda end, shape: edges.groupBy("doc_id", F.col(end).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", shape.alias("x")))), lambda e: quoted(e["x"])).alias(f"{end}_lines"))
    incoming = line("target", F.concat("source", F.lit(" --"), "type", F.lit("-->")))
    outgoing = line("source", F.concat(F.lit("--"), "type", F.lit("--> "), "target"))
    met = nodes.join(defined, ["doc_id", "ord"], "left").join(incoming, ["doc_id", "id"], "left").join(outgoing, ["doc_id", "id"], "left")
    has = lambda c: F.when(F.col(c) != "", quoted(F.col(c))) if c in nodes.columns else F.lit(None).cast("string")
    sources = items(F.transform(some(F.col("sources")), quoted), ", ") if "sources" in nodes.columns else F.lit(None).cast("string")
    parts = {"id": quoted(F.col("id")), "type": quoted(F.col("type")), "name": has("name"), "description": has("description"), "definition": F.col("definition"), "source": sources, "incoming": items(F.col("target_lines"), ", "), "outgoing": items(F.col("source_lines"), ", ")}
    return met.select("doc_id", "ord", "id", members(**parts, **spaced).alias("description"))


def key_of(model: Column, version: Column, payload: Column) -> Column:
    """SHA-256 of model, prompt version and payload (JSON text) as one JSON array."""
    return F.sha2(items(F.array(quoted(model), quoted(version), payload)), 256)


def planned(descriptions: DataFrame, model: str, version: str = "1", limit: int | None = None) -> DataFrame:
    """(doc_id, batch, ids, request, key) of each batch of descriptions; `limit` batches of a document at most."""
    # by place, as ids may repeat
    sized = descriptions.select("doc_id", "ord", F.col("ord").cast("string").alias("id"), F.length("description").alias("chars"))
    placed = enrich.batches(sized).select("doc_id", F.col("id").cast("long").alias("ord"), "batch").join(descriptions, ["doc_id", "ord"])
    if limit is not None:
        placed = placed.where(F.col("batch") < limit)
    per = placed.groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "description"))).alias("m"))
    whole = per.select("doc_id", "batch", F.transform("m", lambda x: x["id"]).alias("ids"), items(F.transform("m", lambda x: x["description"])).alias("request"))
    return whole.withColumn("key", key_of(F.lit(model), F.lit(version), F.col("request")))


def called(requests: DataFrame, client: Client) -> DataFrame:
    """(key, reply, finish) of each of `requests` (key, request); one call for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [client(r) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in told], pa.string()), pa.array([f for _, f in told], pa.string())], names=["key", "reply", "finish"])

    return requests.select("key", "request").mapInArrow(run, "key string, reply string, finish string")


def _strings(payload: Column, name: str) -> Column:
    """The texts and numbers of a list in a reply, cut; null if there are none or it is no list."""
    raw = F.try_variant_get(payload, f"$.{name}", "array<variant>")
    plain = F.filter(raw, lambda x: F.schema_of_variant(x).rlike("^(STRING|BIGINT|DOUBLE|DECIMAL|BOOLEAN)"))
    texts = F.transform(plain, lambda x: F.when(F.schema_of_variant(x) == "BOOLEAN", F.initcap(x.cast("string"))).otherwise(x.cast("string")))
    return some(F.transform(F.filter(texts, lambda x: F.trim(x) != ""), lambda x: F.left(x, F.lit(SAID))))


def _text(payload: Column, name: str) -> Column:
    value = F.try_variant_get(payload, f"$.{name}", "variant")
    return F.when((F.schema_of_variant(value) == "STRING") & (F.trim(value.cast("string")) != ""), F.left(value.cast("string"), F.lit(SAID)))


def contexts(replied: DataFrame) -> DataFrame:
    """(doc_id, batch, id, summary, intent, failure_modes, invariants, side_effects, confidence) of `replied` (doc_id, batch, id, payload).

    Whether failures are handled is not taken from a model.  A payload that says nothing gives no row.
    """
    p = F.col("payload")
    modes = F.try_variant_get(p, "$.failure_modes", "array<variant>")
    said = F.transform(modes, lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string")).otherwise(_string_member(x)))
    failures = some(F.transform(F.filter(said, lambda x: F.trim(x) != ""), lambda x: F.left(F.trim(x), F.lit(SAID))))
    out = replied.select("doc_id", "batch", "id", _text(p, "summary").alias("summary"), _text(p, "intent").alias("intent"), failures.alias("failure_modes"), _strings(p, "invariants").alias("invariants"), _strings(p, "side_effects").alias("side_effects"), enrich.confidence(F.try_variant_get(p, "$.confidence", "string")).alias("confidence"))
    return out.where(F.coalesce("summary", "intent", F.array_join("failure_modes", ""), F.array_join("invariants", ""), F.array_join("side_effects", "")).isNotNull())


def _string_member(x: Column) -> Column:
    value = F.try_variant_get(x, "$.description", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


@dataclass
class Enriched:
    """contexts as `contexts` gives them; skipped(doc_id, batch, id, reason); versions(doc_id, version) of changed documents."""

    contexts: DataFrame
    skipped: DataFrame
    versions: DataFrame
    batches: int
    calls: int
    hits: int


def enriched(plan: DataFrame, cache: KeyedStore, ledger: Ledger | None = None, client: Client | None = None, today: date | None = None, now: datetime | None = None) -> Enriched | dict[str, int]:
    """Ask about every batch of `plan` that `cache` lacks, and read all replies.

    Without a client nothing is called, and the numbers of batches, calls and hits are all
    that comes back.  More calls than the day has left raise BudgetExceeded before the first.
    A reply that is no JSON is not kept, and its nodes are skipped with the reason.
    """
    plan = stored(plan)
    missing = stored(plan.join(cache.rows().select("key"), "key", "left_anti").select("key", "request").groupBy("key").agg(F.min("request").alias("request")))
    batches, calls = plan.count(), missing.count()
    hits = batches - plan.join(missing.select("key"), "key", "left_semi").count()
    if client is None:
        return {"batches": batches, "calls": calls, "hits": hits}
    moment = now or datetime.now()
    day = today or moment.date()
    if ledger is not None:
        ledger.check(calls, day)
    told = stored(called(missing, client).withColumn("v", enrich.lenient_json("reply")).withColumn("response", F.to_json("v")).drop("v"))
    if ledger is not None and calls:
        ledger.record(told.groupBy().agg(F.count("*").alias("calls")).select(F.lit(day).alias("day"), "calls"), day)
    cache.put(told.where("response is not null").select("key", "response", F.lit(moment).cast("timestamp").alias("stored_at")))
    answers = cache.rows().select("key", "response")
    lost = told.where("response is null").select("key", F.when(F.col("finish") == "length", "truncated").otherwise("no JSON").alias("lost"))
    met = stored(plan.join(answers, "key", "left").join(lost, "key", "left").withColumn("nodes", F.try_variant_get(F.try_parse_json("response"), "$.nodes", "map<string,variant>")))
    asked = met.select("doc_id", "batch", F.explode("ids").alias("id"), F.coalesce("lost", F.when(F.col("nodes").isNull(), "no nodes")).alias("lost"), F.try_element_at("nodes", F.col("id")).alias("payload"))
    asked = stored(asked.withColumn("is_object", F.schema_of_variant("payload").startswith("OBJECT")))
    given = contexts(asked.where("is_object"))
    silent = F.when(F.col("payload").isNull(), "not in the reply").when(~F.col("is_object"), "no object").otherwise("says nothing")
    skipped = asked.join(given.select("doc_id", "batch", "id"), ["doc_id", "batch", "id"], "left_anti").select("doc_id", "batch", "id", F.coalesce("lost", silent).alias("reason"))
    return Enriched(given, skipped, given.select("doc_id").distinct().withColumn("version", F.lit("1.1")), batches, calls, hits)
