"""A corpus of workflow graphs as flat tables keyed by document.

Every table carries `doc_id` and an order (`ord`) within its parent, so that document order
and first-by-id rules can be told.  All operators run over all documents at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Corpus:
    """nodes(doc_id, ord, id, type, name, ref, method, confidence, has_evidence, reviewed_by)
    edges(doc_id, ord, id, type, source, target, source_port, target_port, is_default, + provenance)
    registry(doc_id, registry, ord, id, + provenance)
    ports(doc_id, node_ord, direction, name)
    depends(doc_id, node_ord, ord, node)
    failures(doc_id, carrier, carrier_ord, carrier_id, ord, description, handled, handler_node, source, inferred)
    variables(doc_id, prompt_ord, ord, source_node)
    contexts(doc_id, kind, kind_ord, ord, id, method, confidence, has_evidence, reviewed_by, notes)
    """

    nodes: DataFrame
    edges: DataFrame
    registry: DataFrame | None = None
    ports: DataFrame | None = None
    depends: DataFrame | None = None
    failures: DataFrame | None = None
    variables: DataFrame | None = None
    contexts: DataFrame | None = None
    #: Edges with the types of their ends, where they have been found already.
    ends: DataFrame | None = None


def first_by_id(rows: DataFrame, *by: str) -> DataFrame:
    """The first of all rows that share a document and an id, in document order."""
    keys = ["doc_id", *by, "id"]
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("__r")).select(*keys, "__r.*").select(*rows.columns)


def nodes_of_type(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("type").isin(*types))


def entry_points(nodes: DataFrame) -> DataFrame:
    return nodes_of_type(nodes, "input")


def terminals(nodes: DataFrame) -> DataFrame:
    return nodes_of_type(nodes, "output")


def edges_of(edges: DataFrame, end: str, ids: DataFrame, *types: str) -> DataFrame:
    """Edges whose `end` (source or target) is among `ids` (doc_id, id), of the types if any are named."""
    some = edges.where(F.col("type").isin(*types)) if types else edges
    return some.join(ids.select("doc_id", F.col("id").alias(end)).distinct(), ["doc_id", end], "left_semi").select(*edges.columns)


def neighbours(edges: DataFrame, nodes: DataFrame, end: str = "target") -> DataFrame:
    """Each edge with the node at its `end`; null where that node is not declared."""
    n = first_by_id(nodes).select("doc_id", F.col("id").alias(end), F.col("id").alias("node"), F.col("type").alias("node_type"))
    return edges.join(n, ["doc_id", end], "left")


def resolved_refs(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """(doc_id, ord, id, type, ref, registry, entry): the registry entry of each reference, null if there is none."""
    from loomgraph.functions.rules import ref_registries

    kinds = F.broadcast(ref_registries(nodes.sparkSession))
    entries = registry.select("doc_id", "registry", F.col("id").alias("ref"), F.col("id").alias("entry")).distinct()
    with_kind = nodes.where(F.col("ref").isNotNull()).join(kinds, "type", "left")
    return with_kind.join(entries, ["doc_id", "registry", "ref"], "left").select("doc_id", "ord", "id", "type", "ref", "registry", "entry")


def duplicates(rows: DataFrame, *by: str) -> DataFrame:
    """Every repeat of an id but the first, in its document (and `by`)."""
    w = Window.partitionBy("doc_id", *by, "id").orderBy("ord")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n > 1").drop("__n")


def search(nodes: DataFrame, needles: DataFrame) -> DataFrame:
    """Nodes with the `needle` that `needles` (doc_id, needle) names for their document in their id or name, whatever its case."""
    low = F.lower("needle")
    met = nodes.join(needles, "doc_id").where(F.contains(F.lower("id"), low) | F.coalesce(F.contains(F.lower("name"), low), F.lit(False)))
    return met.select(*nodes.columns, "needle")


def usage(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """(doc_id, registry, id, uses): how many nodes refer to each entry, 0 for those that none does."""
    used = resolved_refs(nodes, registry).where(F.col("entry").isNotNull()).groupBy("doc_id", "registry", F.col("entry").alias("id")).agg(F.count("*").alias("uses"))
    return registry.select("doc_id", "registry", "id").distinct().join(used, ["doc_id", "registry", "id"], "left").fillna(0, ["uses"])
