"""Workflow documents as JSON: reading them into a corpus and writing a corpus as them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.structure import KINDS, OPEN
from loomgraph.operators.corpus import Corpus

_REF = "struct<file string, start_line int, end_line int, symbol string, url string>"
_PROVENANCE = f"struct<method string, confidence double, evidence array<{_REF}>, reviewed_by string, notes string>"
_CONTEXT = f"struct<summary string, failure_modes array<struct<description string, handled boolean, handler_node string, source {_REF}>>, provenance {_PROVENANCE}>"
_PORT = "array<struct<name string>>"
SCHEMA = f"""format string, version string,
nodes array<struct<id string, type string, name string, description string, ref string, inputs {_PORT}, outputs {_PORT}, depends_on array<string>, ai_context {_CONTEXT}, provenance {_PROVENANCE}>>,
edges array<struct<id string, type string, source string, target string, source_port string, target_port string, `when` string, `default` boolean, ai_context {_CONTEXT}, provenance {_PROVENANCE}>>,
prompts array<struct<id string, name string, template string, variables array<struct<name string, source_node string>>, ai_context {_CONTEXT}, provenance {_PROVENANCE}>>,
models array<struct<id string, provider string, model string, provenance {_PROVENANCE}>>,
tools array<struct<id string, name string, kind string, ai_context {_CONTEXT}, provenance {_PROVENANCE}>>,
data_sources array<struct<id string, name string, kind string, provider string, ai_context {_CONTEXT}, provenance {_PROVENANCE}>>"""


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file, raw): one row for each file; the id follows from the file's name."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    return files.select(F.xxhash64("file").alias("doc_id"), "file", "raw")


def corpus_of(documents: DataFrame) -> Corpus:
    """The corpus of `documents` (doc_id, raw JSON text); absent arrays are empty."""
    d = documents.select("doc_id", F.from_json("raw", SCHEMA).alias("d")).select("doc_id", "d.*")
    items = {k: d.select("doc_id", F.posexplode(k).alias("ord", "x")).withColumn("ord", F.col("ord").cast("long")) for k in ("nodes", "edges", "prompts", "models", "tools", "data_sources")}
    trust = lambda p: [F.col(f"{p}.method").alias("method"), F.col(f"{p}.confidence").alias("confidence"), (F.coalesce(F.size(f"{p}.evidence"), F.lit(0)) > 0).alias("has_evidence"), F.col(f"{p}.reviewed_by").alias("reviewed_by")]
    n, e = items["nodes"], items["edges"]
    nodes = n.select("doc_id", "ord", "x.id", "x.type", "x.name", "x.ref", *trust("x.provenance"))
    edges = e.select("doc_id", "ord", "x.id", "x.type", "x.source", "x.target", "x.source_port", "x.target_port", F.coalesce("x.default", F.lit(False)).alias("is_default"), *trust("x.provenance"))
    registry = contexts = failures = None
    for kind, rows in items.items():
        if kind not in ("nodes", "edges"):
            more = rows.select("doc_id", F.lit(kind).alias("registry"), "ord", "x.id", *trust("x.provenance"))
            registry = more if registry is None else registry.unionByName(more)
        if kind != "models":
            more = rows.where("x.ai_context.provenance is not null").select("doc_id", F.lit(kind[:-1]).alias("kind"), "ord", "x.id", *trust("x.ai_context.provenance"), F.col("x.ai_context.provenance.notes").alias("notes"))
            contexts = more if contexts is None else contexts.unionByName(more)
            at = F.concat_ws(":", "f.source.file", F.concat_ws("-", F.col("f.source.start_line").cast("string"), F.when(F.col("f.source.end_line") != F.col("f.source.start_line"), F.col("f.source.end_line").cast("string"))))
            inferred = F.coalesce((F.col("x.ai_context.provenance.method") == "ai_inference") & (F.coalesce("x.ai_context.provenance.reviewed_by", F.lit("")) == ""), F.lit(False))
            more = rows.select("doc_id", F.lit(kind).alias("carrier"), F.col("ord").alias("carrier_ord"), F.col("x.id").alias("carrier_id"), inferred.alias("inferred"), F.posexplode("x.ai_context.failure_modes").alias("o", "f"))
            more = more.select("doc_id", "carrier", "carrier_ord", "carrier_id", F.col("o").cast("long").alias("ord"), "f.description", "f.handled", "f.handler_node", F.when(F.col("f.source").isNotNull(), at).alias("source"), "inferred")
            failures = more if failures is None else failures.unionByName(more)
    ports = None
    for side in ("inputs", "outputs"):
        more = n.select("doc_id", F.col("ord").alias("node_ord"), F.lit(side).alias("direction"), F.explode(f"x.{side}").alias("p")).select("doc_id", "node_ord", "direction", "p.name")
        ports = more if ports is None else ports.unionByName(more)
    depends = n.select("doc_id", F.col("ord").alias("node_ord"), F.posexplode("x.depends_on").alias("o", "node")).select("doc_id", "node_ord", F.col("o").cast("long").alias("ord"), "node")
    variables = items["prompts"].select("doc_id", F.col("ord").alias("prompt_ord"), F.posexplode("x.variables").alias("o", "v")).select("doc_id", "prompt_ord", F.col("o").cast("long").alias("ord"), "v.source_node")
    return Corpus(nodes, edges, registry, ports, depends, failures, variables, contexts)


def _type(holds: str) -> str:
    """The SQL type of what a property holds; what may hold more than is known stays a variant."""
    holds = holds.removesuffix(" !")
    if holds.startswith("list of "):
        return f"array<{_type(holds.removeprefix('list of '))}>"
    if holds in KINDS and holds not in OPEN:
        return "struct<" + ", ".join(f"`{k}`: {_type(v)}" for k, v in KINDS[holds].items()) + ">"
    if holds in OPEN or holds in ("object", "number"):
        return "variant"
    return {"share": "double", "count": "bigint", "boolean": "boolean"}.get(holds, "string")


def typed(documents: DataFrame) -> DataFrame:
    """(doc_id, d): `documents` (doc_id, raw JSON text) with every property of the format and nothing lost of sound ones."""
    return documents.select("doc_id", F.from_json("raw", _type("document")).alias("d"))


def encoded(documents: DataFrame) -> DataFrame:
    """(doc_id, raw): sound `documents` written anew, properties in the order of the format, absent values left out."""
    return typed(documents).select("doc_id", F.to_json("d").alias("raw"))


def documents_of(nodes: DataFrame, edges: DataFrame, format_name: str, version: str = "1.1") -> DataFrame:
    """(doc_id, raw): JSON documents of the columns given, absent values left out, in document order."""
    listed = lambda df, name: df.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*[c for c in df.columns if c not in ("doc_id", "ord")]).alias("x")))), lambda s: s["x"]).alias(name))
    both = listed(nodes, "nodes").join(listed(edges, "edges"), "doc_id", "full_outer")
    kind = {f.name: f.dataType for f in both.schema}
    none = lambda name: F.coalesce(name, F.array().cast(kind[name]))
    return both.select("doc_id", F.to_json(F.struct(F.lit(format_name).alias("format"), F.lit(version).alias("version"), none("nodes").alias("nodes"), none("edges").alias("edges"))).alias("raw"))
