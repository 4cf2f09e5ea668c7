"""Drift of documents: what differs between those committed and those made anew, leaving out what every run changes.

Documents are taken apart as variants: into elements, and elements into fields whose values
are JSON text with sorted keys.  What is volatile is taken out of the values by building
them anew without it, at its place only, so texts that look like JSON stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.canonical import items, quoted
from loomgraph.operators import diff
from loomgraph.operators.graph import stored

#: What runs change in a project, in metadata, and in references to sources.
PROJECT, METADATA, LINES = ["commit", "repository"], ["generated_at", "files_analyzed", "skipped"], ["start_line", "end_line"]


def _object(v: Column) -> Column:
    """The members of an object by key, keys sorted; null for anything else."""
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))


def _array(v: Column) -> Column:
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def _without(v: Column, keys: list[str], inner=None) -> Column:
    """The JSON text of an object without `keys`, members changed by `inner` (key, value); of anything else as it is."""
    text = inner or (lambda k, x: F.to_json(x))
    entries = F.filter(F.map_entries(_object(v)), lambda e: ~e["key"].isin(keys))
    made = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), text(e["key"], e["value"]))), ","), F.lit("}"))
    return F.coalesce(made, F.to_json(v))


def _lineless(v: Column) -> Column:
    """A reference to a source, or a list of them, without line numbers."""
    return F.coalesce(items(F.transform(_array(v), lambda x: _without(x, LINES))), _without(v, LINES))


def _timeless(v: Column) -> Column:
    """A provenance without its time, its evidence without line numbers."""
    return _without(v, ["generated_at"], lambda k, x: F.when(k == "evidence", _lineless(x)).otherwise(F.to_json(x)))


def fields(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, id, field, v) of `documents` (doc_id, raw): every field of every element, of the project, and version and metadata.

    Of elements that share an id the last counts.  What is no JSON object has no rows.
    """
    d = documents.select("doc_id", F.try_parse_json("raw").alias("d"))
    get = lambda path: F.try_variant_get("d", path, "variant")
    lists = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), _array(get(f"$.{kind}")).alias("elements")) for kind in diff.KINDS[:-1]]))
    rows = d.select("doc_id", lists.alias("l")).select("doc_id", "l.kind", F.posexplode("l.elements").alias("ord", "e"))
    rows = rows.select("doc_id", "kind", F.try_variant_get("e", "$.id", "string").alias("id"), "ord", "e").where("id is not null")
    last = rows.groupBy("doc_id", "kind", "id").agg(F.max_by("e", "ord").alias("e"))
    elements = last.select("doc_id", "kind", "id", F.explode(_object(F.col("e"))).alias("field", "v"))
    field = lambda id_, name, v: F.struct(id_.alias("id"), name.alias("field"), v.alias("v"))
    project = F.transform(F.map_entries(_object(get("$.project"))), lambda e: field(F.concat(F.lit("project."), e["key"]), e["key"], e["value"]))
    whole = F.array(*[field(F.lit(k), F.lit(k), get(f"$.{k}")) for k in ("version", "metadata")])
    own = d.select("doc_id", F.explode(F.concat(F.coalesce(project, F.filter(whole, lambda x: F.lit(False))), whole)).alias("f")).where("f.v is not null")
    return elements.unionByName(own.select("doc_id", F.lit("document").alias("kind"), "f.id", "f.field", "f.v"))


def plain(rows: DataFrame) -> DataFrame:
    """`fields` with values as JSON text."""
    return rows.withColumn("value", F.to_json("v")).drop("v")


def normalised(rows: DataFrame) -> DataFrame:
    """`fields` with values as JSON text, without what every run changes.

    Lines of `source` and `source_ref` and of the provenance's evidence, and its time; an
    edge's `source` is an id.  What a model said of an element stays whole.
    """
    element = F.col("kind") != "document"
    lines = element & (F.col("field") == "source_ref") | (F.col("field") == "source") & element & (F.col("kind") != "edges")
    value = F.when(lines, _lineless(F.col("v"))).when(element & (F.col("field") == "provenance"), _timeless(F.col("v"))).when(F.col("id") == "metadata", _without(F.col("v"), METADATA)).otherwise(F.to_json("v"))
    kept = ~((F.col("kind") == "document") & F.col("id").isin([f"project.{k}" for k in PROJECT]))
    return rows.where(kept).withColumn("value", value).drop("v")


def drift(committed: DataFrame, regenerated: DataFrame) -> DataFrame:
    """(doc_id, kind, op, id, field, before, after): what the documents made anew say otherwise than those committed (doc_id, raw).

    They go by the committed project's name.
    """
    old, new = (stored(normalised(fields(stored(docs.select("doc_id", "raw"))))) for docs in (committed, regenerated))
    named = (F.col("kind") == "document") & (F.col("id") == "project.name")
    new = new.where(~named).unionByName(old.where(named).join(new.select("doc_id").distinct(), "doc_id", "left_semi"))
    return diff.changes(old, new, "doc_id")
