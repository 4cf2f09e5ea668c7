"""Fixed values of the workflow format: types, registries, compatibility, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values, as the format states them.
NODE_TYPES = ["agent", "llm", "tool", "prompt", "retriever", "vector_store", "input", "output", "condition"]
EDGE_TYPES = ["calls", "uses", "retrieves", "passes", "produces", "routes_to"]
REGISTRIES = ["prompts", "models", "tools", "data_sources"]
REF_REGISTRY = {"llm": "models", "tool": "tools", "prompt": "prompts", "vector_store": "data_sources", "retriever": "data_sources"}
EDGE_SOURCES = {
    "calls": ["agent", "condition", "input"],
    "uses": ["agent", "llm", "tool", "retriever"],
    "retrieves": ["agent", "llm", "retriever"],
    "passes": ["agent", "llm", "tool", "prompt", "retriever", "vector_store", "input", "condition"],
    "produces": ["agent", "llm", "tool", "retriever", "condition"],
    "routes_to": ["condition"],
}
EDGE_TARGETS = {
    "calls": ["agent", "llm", "tool"],
    "uses": ["prompt", "tool", "vector_store"],
    "retrieves": ["retriever", "vector_store"],
    "passes": ["agent", "llm", "tool", "prompt", "retriever", "vector_store", "output", "condition"],
    "produces": ["output"],
    "routes_to": ["agent", "llm", "tool", "retriever", "condition", "output"],
}
LOW_CONFIDENCE = 0.60
MAX_PATHS = 1000
DAILY_CALLS = 50
WARNINGS = {"AF002", "AF250", "AF280", "AF282", "AF283", "AF290", "AF291"}


def edge_rules(spark: SparkSession) -> DataFrame:
    """(edge_type, side, node_type): every allowed end of every edge type; a small dimension."""
    rows = [(e, side, n) for side, table in (("source", EDGE_SOURCES), ("target", EDGE_TARGETS)) for e, types in table.items() for n in types]
    return spark.createDataFrame(rows, "edge_type string, side string, node_type string")


def ref_registries(spark: SparkSession) -> DataFrame:
    """(type, registry): where references of a node type are looked up."""
    return spark.createDataFrame(list(REF_REGISTRY.items()), "type string, registry string")
