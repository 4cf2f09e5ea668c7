"""Questions in plain words, routed to graph queries over a corpus.

A question meets every rule whose pattern it matches; each kind of answer is computed once
for all questions that want it, and of a question's answers that of the earliest rule stays.
A rule that names a part of the workflow answers only if the name can be resolved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import graph
from loomgraph.operators.corpus import Corpus, first_by_id, resolved_refs

# Fixed values: (kind of answer, pattern, group that holds a name), the earliest match counts.
RULES = [
    ("impact", r"\bif\s+(?:the\s+)?([\w.:-]{2,})\s+(?:fails?|breaks?|errors?|goes? down|is (?:down|unavailable|unreachable))", 1),
    ("impact", r"\b(?:blast radius|impact|downstream)\s+(?:of|from)\s+(?:the\s+)?([\w.:-]{2,})", 1),
    ("impact", r"\bwhat (?:depends on|breaks without)\s+(?:the\s+)?([\w.:-]{2,})", 1),
    ("failures", r"\b(?:missing|no|without|find).{0,20}error handling\b|\bunhandled\b|\bwhat can (?:go wrong|fail)\b|\bfailure modes?\b", 0),
    ("rag", r"\b(?:rag|retriev\w*|vector (?:db|store|database)|embedding)\b", 0),
    ("tools", r"\btools?\b", 0),
    ("paths", r"\b(?:paths?|routes?|flow|end.to.end|reach the (?:output|response|answer))\b", 0),
    ("trust", r"\b(?:inferred|guess\w*|hallucinat\w*|trust\w*|confidence|provenance)\b", 0),
    ("describe", r"^\s*(?:what|which) (?:is|are|does)\s+(?:the\s+)?([\w.:-]{3,})", 1),
    ("describe", r"\b(?:explain|describe|tell me about)\s+(?:the\s+)?([\w.:-]{3,})", 1),
    ("summary", r"\b(?:summar\w+|overview|how many|what.s in|structure)\b", 0),
]


def routed(questions: DataFrame) -> DataFrame:
    """(doc_id, question_id, priority, kind, target): every rule that each question matches."""
    hits = [F.when(F.col("question").rlike(f"(?i){p}"), F.struct(F.lit(i).alias("priority"), F.lit(kind).alias("kind"), (F.regexp_replace(F.regexp_extract("question", f"(?i){p}", g), r"^[?.'\"`]+|[?.'\"`]+$", "") if g else F.lit(None).cast("string")).alias("target"))) for i, (kind, p, g) in enumerate(RULES)]
    return questions.select("doc_id", "question_id", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select("doc_id", "question_id", "h.*")


def resolved(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """`named` (doc_id, ..., target) with the node meant (`id`, `type`): by id, else by name, whatever their case,
    else the one node that holds the text in its id or name; unresolved rows go."""
    low, ident, name = F.lower("target"), F.lower("id"), F.lower(F.coalesce("name", F.lit("")))
    rank = F.when(ident == low, 0).when(name == low, 1).when(F.contains(ident, low) | F.contains(name, low), 2)
    keys = named.columns
    met = named.join(nodes.select("doc_id", "id", "type", "name", "ord"), "doc_id").withColumn("rank", rank).where("rank is not null")
    best = met.groupBy(*keys).agg(F.min(F.struct("rank", "ord", "id", "type")).alias("b"), F.count("*").alias("n"))
    return best.where("b.rank < 2 or n = 1").select(*keys, "b.id", "b.type")


def answers(questions: DataFrame, c: Corpus) -> DataFrame:
    """(doc_id, question_id, matched, text, cites) of `questions` (doc_id, question_id, question).

    One row for each question; what no rule answers has null in matched and text.
    """
    wanted = graph.stored(routed(questions))
    of = lambda kind: wanted.where(F.col("kind") == kind).select("doc_id", "question_id", "priority", "kind")
    ordered = lambda *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, "id"))), lambda x: x["id"])
    lines = lambda head, *by: F.concat(head, F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, "line"))), lambda x: F.concat(F.lit("\n  "), x["line"])), ""))
    key = ["doc_id", "question_id", "priority", "kind"]

    def listed(kind: str, rows: DataFrame, head: str, none: str, *by: str) -> DataFrame:
        """Answers made of rows (doc_id, id, line, *by) of the question's document."""
        per = rows.groupBy("doc_id").agg(lines(F.lit(head), *by).alias("text"), F.array_compact(F.array_distinct(ordered(*by))).alias("cites"))
        return of(kind).join(per, "doc_id", "left").select(*key, F.coalesce("text", F.lit(none)).alias("text"), F.coalesce("cites", F.array().cast("array<string>")).alias("cites"))

    shown = F.concat("id", F.lit(" ("), "type", F.lit(")"))
    out = [listed("rag", graph.rag_components(c.nodes, c.edges).withColumn("line", shown), "Components that take part in retrieval:", "Nothing retrieves here.", "ord")]
    used = graph.agents_using_tools(c.nodes, c.edges).groupBy("doc_id", "agent").agg(F.array_sort(F.collect_set("tool")).alias("tools"))
    used = used.join(first_by_id(c.nodes).select("doc_id", F.col("id").alias("agent"), "ord"), ["doc_id", "agent"])
    used = used.withColumn("line", F.concat("agent", F.lit(" -> "), F.array_join("tools", ", "))).withColumn("id", F.concat(F.array("agent"), "tools"))
    per = used.groupBy("doc_id").agg(lines(F.lit("Tools within reach of each agent:"), "ord").alias("text"), F.array_distinct(F.flatten(ordered("ord"))).alias("cites"))
    out.append(of("tools").join(per, "doc_id", "left").select(*key, F.coalesce("text", F.lit("No agent has a tool within reach.")).alias("text"), F.coalesce("cites", F.array().cast("array<string>")).alias("cites")))
    if c.failures is not None:
        open_ = graph.unhandled_failures(c.failures).withColumnRenamed("subject", "id")
        mark = F.when(F.col("inferred"), F.lit(" [inferred]")).otherwise(F.lit(""))
        open_ = open_.withColumn("line", F.concat("id", mark, F.lit(": "), "detail", F.coalesce(F.concat(F.lit(" ("), "source", F.lit(")")), F.lit(""))))
        # one line more where a model said so
        note = open_.where("inferred").select("doc_id", F.lit("zz").alias("carrier"), F.lit(0).cast("long").alias("carrier_ord"), F.lit("What is marked [inferred] was said by a model, not read from code.").alias("line")).distinct()
        open_ = open_.select("doc_id", "carrier", "carrier_ord", "id", "line").unionByName(note, allowMissingColumns=True)
        out.append(listed("failures", open_, "Failures that nothing handles:", "Every failure is handled.", "carrier", "carrier_ord"))
    paths = graph.stored(graph.paths_to_outputs(c.nodes, c.edges))
    told = graph.rendered_paths(paths, c.nodes, c.edges).withColumnRenamed("text", "line").join(paths.select("doc_id", "place", F.explode("nodes").alias("id")), ["doc_id", "place"])
    per = told.groupBy("doc_id").agg(F.concat(F.countDistinct("place").cast("string"), F.lit(" ways lead from an input to an output:"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("place", "line"))), lambda x: F.concat(F.lit("\n  "), x["place"].cast("string"), F.lit(". "), x["line"])), "")).alias("text"), F.array_sort(F.collect_set("id")).alias("cites"))
    out.append(of("paths").join(per, "doc_id", "left").select(*key, F.coalesce("text", F.lit("No way leads from an input to an output.")).alias("text"), F.coalesce("cites", F.array().cast("array<string>")).alias("cites")))
    claims = graph.elements(c).where(graph.is_inferred() & F.col("kind").isin("node", "edge", "node.ai_context"))
    claims = claims.select("doc_id", F.lit(0).alias("part"), F.col("id").alias("at"), "id", F.col("id").alias("line")).distinct()
    weak = graph.low_trust(c).join(claims.select("doc_id").distinct(), "doc_id", "left_semi")
    weak = weak.select("doc_id", F.lit(1).alias("part"), *[F.lit(None).cast("string").alias(x) for x in ("at", "id")], F.concat(F.lit("to review: "), "subject", F.lit(": "), "detail").alias("line"))
    out.append(listed("trust", claims.unionByName(weak), "Claims that were inferred stand on:", "No claim was inferred.", "part", "at"))
    s = graph.summary(c)
    text = F.concat(F.col("nodes").cast("string"), F.lit(" nodes, "), F.col("edges").cast("string"), F.lit(" edges, "), F.col("paths_to_output").cast("string"), F.lit(" ways to an output.\n  nodes: "), "node_types", F.lit("\n  edges: "), "edge_types")
    out.append(of("summary").join(s.select("doc_id", text.alias("text")), "doc_id").select(*key, "text", F.array().cast("array<string>").alias("cites")))

    found = graph.stored(resolved(wanted.where("target is not null"), c.nodes))
    targets = found.where("kind = 'impact'").select("doc_id", "id").distinct()
    hit = graph.impact_of(c.nodes, c.edges, targets).withColumn("line", shown)
    ends = F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "output", F.struct("ord", "id")))), lambda e: e["id"])
    per = hit.groupBy("doc_id", "failed").agg(F.count("*").alias("n"), lines(F.lit(""), "ord").alias("list"), ordered("ord").alias("affected"), F.array_join(ends, ", ").alias("ends"))
    impact = found.where("kind = 'impact'").join(per.withColumnRenamed("failed", "id"), ["doc_id", "id"], "left")
    told = F.when(F.col("n").isNull(), F.concat(F.lit("No other part needs "), "id", F.lit("."))).otherwise(F.concat(F.lit("Without "), "id", F.lit(" ("), "type", F.lit(") "), F.col("n").cast("string"), F.lit(" others stop working:"), "list", F.when(F.col("ends") != "", F.concat(F.lit("\n  No other way leads to "), "ends")).otherwise("")))
    # a workflow part on which nothing depends is the answer itself: nothing else is cited
    cites = F.when(F.col("n").isNull(), F.array().cast("array<string>")).otherwise(F.concat(F.array("id"), "affected"))
    out.append(impact.select(*key, told.alias("text"), cites.alias("cites")))
    e = c.edges.select("doc_id", F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("side"), F.concat(F.lit("goes --"), "type", F.lit("--> "), "target").alias("line")), F.struct(F.col("target").alias("id"), F.lit(0).alias("side"), F.concat(F.lit("gets "), "source", F.lit(" --"), "type", F.lit("-->")).alias("line")))).alias("x"), "ord").select("doc_id", "x.*", "ord")
    per = e.groupBy("doc_id", "id").agg(lines(F.lit(""), "side", "ord").alias("list"))
    describe = found.where("kind = 'describe'").join(per, ["doc_id", "id"], "left")
    if c.registry is not None:
        refs = resolved_refs(c.nodes, c.registry).where("entry is not null").groupBy("doc_id", "id").agg(F.min("entry").alias("entry"))
        describe = describe.join(refs, ["doc_id", "id"], "left").withColumn("defined", F.coalesce(F.concat(F.lit("\n  Defined as "), "entry"), F.lit("")))
    else:
        describe = describe.withColumn("defined", F.lit(""))
    out.append(describe.select(*key, F.concat(shown, "defined", F.coalesce("list", F.lit(""))).alias("text"), F.array("id").alias("cites")))

    best = reduce(DataFrame.unionByName, out).groupBy("doc_id", "question_id").agg(F.min_by(F.struct(F.col("kind").alias("matched"), "text", "cites"), "priority").alias("a"))
    return questions.select("doc_id", "question_id").join(best, ["doc_id", "question_id"], "left").select("doc_id", "question_id", "a.matched", "a.text", F.coalesce("a.cites", F.array().cast("array<string>")).alias("cites"))
