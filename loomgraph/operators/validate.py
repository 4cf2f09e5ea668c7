"""Referential validation of a corpus: coded findings, in rule order, then document order.

Every rule is a join or a window over the corpus tables; `validate_semantic` unions them.
Findings: (doc_id, rule_ord, item_ord, code, severity, path).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.rules import LOW_CONFIDENCE, REGISTRIES, WARNINGS, edge_rules
from loomgraph.operators.corpus import Corpus, duplicates, entry_points, first_by_id, resolved_refs, terminals
from loomgraph.operators.graph import reachable_from, stored
from loomgraph.operators.structure import validate_structural
from loomgraph.sources.documents import corpus_of


def finding(rows: DataFrame, rule: int, code: str, path: Column, item: Column | None = None) -> DataFrame:
    item = F.lit(0) if item is None else item
    severity = "warning" if code in WARNINGS else "error"
    return rows.select("doc_id", F.lit(rule).alias("rule_ord"), item.cast("long").alias("item_ord"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), path.alias("path"))


def _at(kind: str, ord_: str, *more: str | Column) -> Column:
    parts = [F.lit(f"$['{kind}']["), F.col(ord_).cast("string"), F.lit("]")]
    return F.concat(*parts, *[F.lit(m) if isinstance(m, str) else m for m in more])


def duplicate_ids(c: Corpus) -> DataFrame:
    """AF201, AF202, AF203: each repeat of an id of nodes, edges, or within one registry."""
    out = finding(duplicates(c.nodes), 1, "AF201", _at("nodes", "ord"), F.col("ord"))
    out = out.unionByName(finding(duplicates(c.edges), 2, "AF202", _at("edges", "ord"), F.col("ord")))
    if c.registry is not None:
        w = Window.partitionBy("doc_id", "registry", "id").orderBy("ord", "place")
        placed = c.registry.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "registry").orderBy("ord", "id")) - 1)
        again = placed.withColumn("n", F.row_number().over(w)).where("n > 1")
        out = out.unionByName(finding(again, 3, "AF203", F.concat(F.lit("$['"), "registry", F.lit("']["), F.col("place").cast("string"), F.lit("]")), F.col("place")))
    return out


def broken_refs(c: Corpus) -> DataFrame:
    """AF220: a reference that its registry lacks; AF221: a reference on a type that takes none."""
    refs = resolved_refs(c.nodes, c.registry)
    lost = refs.where(F.col("registry").isNotNull() & F.col("entry").isNull())
    out = finding(lost, 4, "AF220", _at("nodes", "ord", "['ref']"), F.col("ord"))
    return out.unionByName(finding(refs.where(F.col("registry").isNull()), 4, "AF221", _at("nodes", "ord", "['ref']"), F.col("ord")))


def broken_links(c: Corpus) -> DataFrame:
    """AF260, AF271, AF270: dependencies, failure handlers and prompt variables that name no node."""
    ids = c.nodes.select("doc_id", "id").distinct()
    lost = lambda df, col: df.where(F.col(col).isNotNull()).join(ids.withColumnRenamed("id", col), ["doc_id", col], "left_anti")
    at = lambda a, mid, b, end="]": F.concat(a, F.lit(mid), F.col(b).cast("string"), F.lit(end))
    out = []
    if c.depends is not None:
        out.append(finding(lost(c.depends, "node"), 5, "AF260", at(_at("nodes", "node_ord"), "['depends_on'][", "ord"), F.col("node_ord")))
    if c.failures is not None:
        out.append(finding(lost(c.failures.where("carrier = 'nodes'"), "handler_node"), 6, "AF271", at(_at("nodes", "carrier_ord"), "['ai_context']['failure_modes'][", "ord", "]['handler_node']"), F.col("carrier_ord")))
    if c.variables is not None:
        out.append(finding(lost(c.variables, "source_node"), 7, "AF270", at(_at("prompts", "prompt_ord"), "['variables'][", "ord", "]['source_node']"), F.col("prompt_ord")))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def _ends(c: Corpus) -> DataFrame:
    """Edges with the type and position of the node at either end, null where there is none."""
    if c.ends is not None:
        return c.ends
    n = first_by_id(c.nodes).select("doc_id", "id", F.col("type").alias("t"), F.col("ord").alias("o"))
    named = lambda end: n.select("doc_id", F.col("id").alias(end), F.col("t").alias(f"{end}_type"), F.col("o").alias(f"{end}_ord"))
    return c.edges.join(named("source"), ["doc_id", "source"], "left").join(named("target"), ["doc_id", "target"], "left")


def sound_edges(c: Corpus) -> DataFrame:
    """Edges whose ends are both declared; the further edge rules see only these."""
    return _ends(c).where("source_type is not null and target_type is not null")


def broken_edges(c: Corpus) -> DataFrame:
    """AF210, AF211: undeclared ends; AF230: types that do not fit; AF240, AF241: ports that are missing."""
    ends, sound = _ends(c), sound_edges(c)
    rules = F.broadcast(edge_rules(c.edges.sparkSession))
    known = F.broadcast(edge_rules(c.edges.sparkSession).select("edge_type").distinct())
    out = finding(ends.where("source_type is null"), 8, "AF210", _at("edges", "ord", "['source']"), F.col("ord"))
    out = out.unionByName(finding(ends.where("target_type is null"), 8, "AF211", _at("edges", "ord", "['target']"), F.col("ord")))
    ruled = sound.join(known.withColumnRenamed("edge_type", "type"), "type", "left_semi")
    for end in ("source", "target"):
        allowed = rules.where(F.col("side") == end).select(F.col("edge_type").alias("type"), F.col("node_type").alias(f"{end}_type"))
        out = out.unionByName(finding(ruled.join(allowed, ["type", f"{end}_type"], "left_anti"), 8, "AF230", _at("edges", "ord", f"['{end}']"), F.col("ord")))
    if c.ports is not None:
        for end, direction, code in (("source", "outputs", "AF240"), ("target", "inputs", "AF241")):
            ports = c.ports.where(F.col("direction") == direction).select("doc_id", F.col("node_ord").alias(f"{end}_ord"), F.col("name").alias(f"{end}_port"))
            bound = sound.where(F.col(f"{end}_port").isNotNull()).join(ports, ["doc_id", f"{end}_ord", f"{end}_port"], "left_anti")
            out = out.unionByName(finding(bound, 8, code, _at("edges", "ord", f"['{end}_port']"), F.col("ord")))
    return out


def branch_discipline(c: Corpus) -> DataFrame:
    """AF250: conditions with fewer than two routes; AF251: with more than one default."""
    routes = sound_edges(c).where("type = 'routes_to'").groupBy("doc_id", F.col("source").alias("id")).agg(F.count("*").alias("routes"), F.count_if("is_default").alias("defaults"))
    conditions = first_by_id(c.nodes).where("type = 'condition'").join(routes, ["doc_id", "id"], "left").fillna(0, ["routes", "defaults"])
    path = F.concat(F.lit("node:"), "id")
    out = finding(conditions.where("routes < 2"), 9, "AF250", path, F.col("ord"))
    return out.unionByName(finding(conditions.where("defaults > 1"), 9, "AF251", path, F.col("ord")))


def reachability(c: Corpus) -> DataFrame:
    """AF282, AF283: no input, no output; AF280: nodes that no input reaches; AF281: no output is reached."""
    known = first_by_id(c.nodes)
    per = known.groupBy("doc_id").agg(F.count_if(F.col("type") == "input").alias("ins"), F.count_if(F.col("type") == "output").alias("outs"))
    out = finding(per.where("ins = 0"), 10, "AF282", F.lit("$['nodes']"))
    out = out.unionByName(finding(per.where("outs = 0"), 10, "AF283", F.lit("$['nodes']")))
    live = reachable_from(sound_edges(c), entry_points(known))
    with_input = per.where("ins > 0").select("doc_id")
    dead = known.join(with_input, "doc_id", "left_semi").join(live, ["doc_id", "id"], "left_anti")
    out = out.unionByName(finding(dead, 11, "AF280", F.concat(F.lit("node:"), "id"), F.col("ord")))
    ended = terminals(known).join(live, ["doc_id", "id"], "left_semi").select("doc_id").distinct()
    return out.unionByName(finding(per.where("ins > 0 and outs > 0").join(ended, "doc_id", "left_anti"), 12, "AF281", F.lit("$['edges']")))


def provenance_discipline(c: Corpus) -> DataFrame:
    """AF290: inferred with low confidence; AF291: inferred without evidence or reviewer."""
    parts = [c.nodes.withColumn("kind", F.lit("nodes")).withColumn("k", F.lit(0)), c.edges.withColumn("kind", F.lit("edges")).withColumn("k", F.lit(1))]
    if c.registry is not None:
        place = F.row_number().over(Window.partitionBy("doc_id", "registry").orderBy("ord", "id")) - 1
        k = F.array_position(F.array(*map(F.lit, REGISTRIES)), F.col("registry")) + 1
        parts.append(c.registry.withColumn("ord", place.cast("long")).withColumn("kind", F.col("registry")).withColumn("k", k.cast("int")))
    columns = ["doc_id", "kind", "k", "ord", "method", "confidence", "has_evidence", "reviewed_by"]
    rows = parts[0].select(*columns)
    for more in parts[1:]:
        rows = rows.unionByName(more.select(*columns))
    inferred = rows.where("method = 'ai_inference'")
    path = F.concat(F.lit("$['"), "kind", F.lit("']["), F.col("ord").cast("string"), F.lit("]['provenance']"))
    item = F.col("k").cast("long") * 1_000_000_000 + F.col("ord")
    out = finding(inferred.where(F.col("confidence") < LOW_CONFIDENCE), 13, "AF290", path, item)
    bare = ~F.coalesce("has_evidence", F.lit(False)) & (F.coalesce("reviewed_by", F.lit("")) == "")
    return out.unionByName(finding(inferred.where(bare), 13, "AF291", path, item))


def validate_semantic(c: Corpus) -> DataFrame:
    """All findings of the corpus, whose tables and edges with their ends are set down once for all rules."""
    c = Corpus(*[t if t is None else stored(t) for t in (c.nodes, c.edges, c.registry, c.ports, c.depends, c.failures, c.variables, c.contexts)])
    c.ends = stored(_ends(c))
    out = duplicate_ids(c)
    rules = [broken_edges, branch_discipline, reachability, provenance_discipline]
    if c.registry is not None:
        rules.append(broken_refs)
    if c.depends is not None or c.failures is not None or c.variables is not None:
        rules.append(broken_links)
    for rule in rules:
        out = out.unionByName(rule(c))
    return out


def validate(documents: DataFrame, format_name: str) -> DataFrame:
    """All findings of `documents` (doc_id, raw JSON text), structure first.

    A document that breaks the structure has AF100 for each place and one AF002, which says
    that its references were not looked at; of all others the references are validated.
    """
    broken = stored(validate_structural(documents, format_name))
    docs = broken.select("doc_id").distinct()
    out = broken.select("doc_id", F.lit(0).alias("rule_ord"), F.lit(0).cast("long").alias("item_ord"), "code", "severity", "path")
    out = out.unionByName(finding(docs, 0, "AF002", F.lit("$")))
    return out.unionByName(validate_semantic(corpus_of(stored(documents.join(docs, "doc_id", "left_anti")))))


def verdicts(findings: DataFrame, documents: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, errors, warnings, codes, failed) of every document."""
    per = findings.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    out = documents.select("doc_id").distinct().join(per, "doc_id", "left").fillna(0, ["errors", "warnings"]).fillna("", ["codes"])
    return out.withColumn("failed", (F.col("errors") > 0) | (F.lit(strict) & (F.col("warnings") > 0)))
