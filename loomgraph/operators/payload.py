"""Documents with their analyses as JSON text: the payload of a viewer, and digests of a bounded size for models.

Every part of a document, whatever analysis it comes from, is a row (doc_id, part, a, b, x);
one grouping by document nests them all, in place of a join for each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.canonical import items, members, quoted
from loomgraph.functions.rules import MAX_PATHS
from loomgraph.operators import graph
from loomgraph.operators.corpus import Corpus, first_by_id, resolved_refs

#: Characters and paths of a digest.
DIGEST_CHARS, DIGEST_PATHS = 20_000, 12


def _part(rows: DataFrame, part: str, x: Column, a: Column | str | None = None, b: Column | str | None = None, **more: Column) -> DataFrame:
    number = lambda c: (F.lit(0) if c is None else F.col(c) if isinstance(c, str) else c).cast("long")
    none = F.lit("")
    return rows.select("doc_id", F.lit(part).alias("part"), number(a).alias("a"), number(b).alias("b"), x.alias("x"), more.get("source", none).alias("source"), more.get("after", none).alias("after"))


def nested(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """(doc_id, one column for each of `names`): arrays of struct(x, source, after), in the order of a, b, x."""
    rows = reduce(DataFrame.unionByName, parts)
    one = lambda name: F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("a", "b", "x", "source", "after"))))
    return rows.groupBy("doc_id").agg(*[one(n).alias(n) for n in names])


def _texts(column: str) -> Column:
    return F.transform(column, lambda p: p["x"])


def _quoted_items(ids: Column, comma: str = ",") -> Column:
    return items(F.transform(ids, quoted), comma)


def payload(documents: DataFrame, corpus: Corpus, limit: int = MAX_PATHS) -> DataFrame:
    """(doc_id, payload): each of `documents` (doc_id, raw) with all analyses of its graph.

    Members in fixed order, absent ones left out; `</` is left to who embeds it in a page.
    """
    nodes, edges = corpus.nodes, corpus.edges
    c = F.col
    counts = F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), c(n).cast("string")) for n in ("nodes", "edges", "paths_to_output", "inferred_elements")])
    listed = lambda n: F.when(c(n) != "", _quoted_items(F.split(n, ","))).otherwise("[]")
    summary = F.concat(F.lit("{"), counts, *[x for n in ("entry_points", "terminals") for x in (F.lit(f',"{n}":'), listed(n))], F.lit("}"))
    parts = [
        _part(documents, "document", c("raw")),
        _part(graph.summary(corpus), "summary", summary),
        _part(graph.paths_to_outputs(nodes, edges, limit), "paths", members(nodes=_quoted_items(c("nodes")), edges=_quoted_items(c("edge_ids"))), "place"),
        _part(graph.rag_components(nodes, edges), "rag", quoted(c("id")), "ord"),
        _part(graph.unreachable(nodes, edges), "unreachable", quoted(c("id")), "ord"),
    ]
    tools = graph.agents_using_tools(nodes, edges).join(first_by_id(nodes).select("doc_id", c("id").alias("agent"), "ord"), ["doc_id", "agent"])
    by_agent = tools.groupBy("doc_id", "agent", "ord").agg(F.array_sort(F.collect_set("tool")).alias("tools"))
    parts.append(_part(by_agent, "agents", F.concat(quoted(c("agent")), F.lit(":"), _quoted_items(c("tools"))), "ord"))
    if corpus.failures is not None:
        parts.append(_part(graph.unhandled_failures(corpus.failures), "unhandled", members(subject=quoted(c("subject")), detail=quoted(c("detail")), source=quoted(c("source"))), "carrier_ord", "ord"))
    parts.append(_part(graph.low_trust(corpus), "low_trust", members(subject=quoted(c("subject")), detail=quoted(c("detail")))))
    names = ["document", "summary", "paths", "rag", "agents", "unhandled", "low_trust", "unreachable"]
    whole = nested(parts, names)
    first = lambda n: F.try_element_at(_texts(n), F.lit(1))
    analysis = members(summary=first("summary"), paths=items(_texts("paths")), rag=items(_texts("rag")), agents_using_tools=F.concat(F.lit("{"), F.array_join(_texts("agents"), ","), F.lit("}")), unhandled=items(_texts("unhandled")), low_trust=items(_texts("low_trust")), unreachable=items(_texts("unreachable")))
    return whole.select("doc_id", members(document=first("document"), analysis=analysis).alias("payload"))


def digest(nodes: DataFrame, edges: DataFrame, registry: DataFrame, failures: DataFrame, limit: int | Column = DIGEST_CHARS, most_paths: int = DIGEST_PATHS) -> DataFrame:
    """(doc_id, digest): a description of each document for a model, of `limit` characters if leaving things out can do it.

    Beyond the limit the nodes' sources go, and, if it is still longer, the paths.  Lengths
    are added up, so nothing is built twice.  nodes(doc_id, ord, id, type, name, ref and, if
    there are any, description, source, context as JSON text); edges with `when`, if there is
    any; failures as `graph.unhandled_failures` gives them.
    """
    spaced = {"comma": ", ", "colon": ": "}
    c = F.col
    has = lambda df, name: F.when(c(name) != "", quoted(c(name))) if name in df.columns else F.lit(None).cast("string")
    told = members(id=quoted(c("id")), **{n: has(registry, n) for n in ("provider", "model", "kind")}, **spaced)
    entries = registry.select("doc_id", "registry", c("id").alias("ref"), "ord", told.alias("x")).groupBy("doc_id", "registry", "ref").agg(F.min_by("x", "ord").alias("definition"))
    refs = resolved_refs(nodes, registry).where("entry is not null").select("doc_id", "ord", "registry", "ref").join(entries, ["doc_id", "registry", "ref"]).select("doc_id", "ord", "definition")
    met = nodes.join(refs, ["doc_id", "ord"], "left")
    head = members(id=quoted(c("id")), type=quoted(c("type")), name=has(nodes, "name"), description=has(nodes, "description"), definition=c("definition"), **spaced)
    source = F.coalesce(F.concat(F.lit(', "source": '), has(nodes, "source")), F.lit(""))
    context = F.coalesce(F.concat(F.lit(', "context": '), c("context")), F.lit("")) if "context" in nodes.columns else F.lit("")
    when = has(edges, "when")
    shown = graph.paths_to_outputs(nodes, edges).where(c("place") <= most_paths)
    bit = F.when(F.coalesce(c("inferred"), F.lit(False)), "true").otherwise("false")
    parts = [
        _part(met, "nodes", F.substring(head, F.lit(1), F.length(head) - 1), "ord", source=source, after=F.concat(context, F.lit("}"))),
        _part(edges, "edges", members(id=quoted(c("id")), type=quoted(c("type")), **{"from": quoted(c("source")), "to": quoted(c("target"))}, when=when, **spaced), "ord"),
        _part(shown, "paths", _quoted_items(c("nodes"), ", "), "place"),
        _part(failures, "failures", members(component=quoted(c("subject")), detail=F.coalesce(quoted(c("detail")), F.lit("null")), inferred=bit, **spaced), "carrier_ord", "ord"),
    ]
    whole = nested(parts, ["nodes", "edges", "paths", "failures"])
    slim = F.array_join(F.transform("nodes", lambda p: F.concat(p["x"], p["after"])), ", ")
    full = F.array_join(F.transform("nodes", lambda p: F.concat(p["x"], p["source"], p["after"])), ", ")
    whole = whole.select("doc_id", "nodes", slim.alias("slim"), F.aggregate("nodes", F.lit(0), lambda n, p: n + F.length(p["source"])).alias("sources"), F.concat(F.lit('"paths": '), items(_texts("paths"), ", "), F.lit(", ")).alias("ways"), F.concat(F.lit('], "edges": '), items(_texts("edges"), ", "), F.lit(', "analysis": {')).alias("middle"), F.concat(F.lit('"unhandled_failures": '), items(_texts("failures"), ", "), F.lit("}}")).alias("tail"))
    limit = F.lit(limit) if isinstance(limit, int) else limit
    start = F.lit('{"nodes": [')
    length = F.length(start) + F.length("slim") + F.length("middle") + F.length("ways") + F.length("tail")
    with_sources, with_paths = length + c("sources") <= limit, length <= limit
    return whole.select("doc_id", F.concat(start, F.when(with_sources, full).otherwise(c("slim")), "middle", F.when(with_paths, c("ways")).otherwise(""), "tail").alias("digest"))
