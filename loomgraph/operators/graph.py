"""Graph queries over a corpus: reachability, paths, attribution, failures, trust, summary.

Documents are small graphs: those of at most `group_edges` edges are gathered by document in
one shuffle and walked inside tasks, many documents to a batch.  Larger ones are walked hop
by hop, all together: each hop joins the frontier with the edges and drops what was seen,
and is cut off from the plan of the hops before in the shared folder; paths stop at their
cap there too.  Results are the same.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.rules import LOW_CONFIDENCE, MAX_PATHS
from loomgraph.operators.corpus import Corpus, entry_points, first_by_id, nodes_of_type, terminals

#: Edges of the largest documents that are gathered whole.
GROUP_EDGES = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only on one machine, if none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, and read back."""
    path = f"{shared_folder(df.sparkSession)}/hop-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_by_size(edges: DataFrame, group_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """`edges` of documents that are gathered whole, and of larger ones (None if there are none)."""
    large = stored(edges.groupBy("doc_id").count().where(F.col("count") > group_edges).select("doc_id"))
    if large.isEmpty():
        return edges, None
    return edges.join(large, "doc_id", "left_anti"), edges.join(large, "doc_id", "left_semi")


def gathered(*tables: tuple[str, DataFrame]) -> DataFrame:
    """One row for each document: the rows of each named table as an array of structs, null where it has none."""
    out = None
    for name, df in tables:
        one = df.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "doc_id"])).alias(name))
        out = one if out is None else out.join(one, "doc_id", "left")
    return out


def by_document(docs: DataFrame, work, columns: str, rows: int = 1 << 14) -> DataFrame:
    """(doc_id, `columns`) of `work`, which gives tuples for a document's gathered tables; `rows` bounds what a batch holds."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema, held = None, []
            for doc in batch.to_pylist():
                key = doc.pop("doc_id")
                held += [(key, *x) for x in work(*[v or [] for v in doc.values()])]
                if len(held) > rows:
                    yield pa.RecordBatch.from_pydict({n: [x[i] for x in held] for i, n in enumerate(names)}, schema=schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_pydict({n: [x[i] for x in held] for i, n in enumerate(names)}, schema=schema)

    return docs.mapInArrow(run, f"doc_id {kind}, {columns}")


def reachable_from(edges: DataFrame, seeds: DataFrame, *labels: str, stop: DataFrame | None = None, group_edges: int = GROUP_EDGES) -> DataFrame:
    """(doc_id, *labels, id) of all that `seeds` (same columns) reach, themselves included.

    Targets that no node declares count; rows of `stop` (doc_id, id) are reached but not
    gone past, unless they are seeds.
    """
    keys = ["doc_id", *labels, "id"]
    step = stored(edges.select("doc_id", F.col("source").alias("id"), F.col("target").alias("to")).distinct())
    seeds = seeds.select(*keys).distinct()
    small, large = split_by_size(step, group_edges)

    def walk(started: list[dict], steps: list[dict], stops: list[dict] = ()) -> Iterator[tuple]:
        onward = defaultdict(list)
        for x in steps:
            onward[x["id"]].append(x["to"])
        halts = {x["id"] for x in stops}
        groups = defaultdict(list)
        for x in started:
            groups[tuple(x[c] for c in labels)].append(x["id"])
        for label, ids in groups.items():
            seen, todo = set(ids), list(ids)
            while todo:
                for to in onward.get(todo.pop(), ()):
                    if to not in seen:
                        seen.add(to)
                        if to not in halts:
                            todo.append(to)
            for x in seen:
                yield (*label, x)

    begin = seeds if large is None else seeds.join(large.select("doc_id").distinct(), "doc_id", "left_anti")
    tables = [("seeds", begin), ("steps", small)] + ([("stops", stop.select("doc_id", "id"))] if stop is not None else [])
    found = by_document(gathered(*tables), walk, ", ".join(f"{c} string" for c in keys[1:]))
    if large is None:
        return found
    seen = frontier = stored(seeds.join(large.select("doc_id").distinct(), "doc_id", "left_semi"))
    onward = frontier
    while not onward.isEmpty():
        more = onward.join(large, ["doc_id", "id"]).select("doc_id", *labels, F.col("to").alias("id")).distinct()
        frontier = stored(more.join(seen, keys, "left_anti"))
        seen = seen.unionByName(frontier)
        onward = frontier if stop is None else frontier.join(stop, ["doc_id", "id"], "left_anti")
    return found.unionByName(seen)


def unreachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no input reaches, of documents that have an input."""
    live = reachable_from(edges, entry_points(nodes))
    with_input = entry_points(nodes).select("doc_id").distinct()
    return nodes.join(with_input, "doc_id", "left_semi").join(live, ["doc_id", "id"], "left_anti").select(*nodes.columns)


def simple_paths(edges: DataFrame, pairs: DataFrame, limit: int = MAX_PATHS, *by: str) -> DataFrame:
    """(doc_id, start, goal, place, nodes, edge_ids): the first `limit` simple paths of each of `pairs`, or in all of those that share the columns `by`.

    pairs(doc_id, start, goal and, if they have an order, start_ord, goal_ord).  Paths come in
    the order of their pair, then depth first in the order of edges; parallel edges give paths
    of their own, and start = goal is one path without edges.  Only nodes from which a goal
    can be reached are walked.

    Of the beginnings found so far each round prolongs the first `limit` of a group only and
    leaves the others standing; a group is done when `limit` whole paths come before all
    beginnings that are left.  So a round costs what the limit allows, however many paths
    there are, and there are about as many rounds as a path has edges.
    """
    by = by or ("doc_id", "start", "goal")
    useful = reachable_from(edges.select("doc_id", F.col("target").alias("source"), F.col("source").alias("target")), pairs.select("doc_id", F.col("goal").alias("id")))
    step = edges.join(useful.withColumnRenamed("id", "target"), ["doc_id", "target"], "left_semi")
    step = stored(step.select("doc_id", F.col("source").alias("at"), F.col("target").alias("to"), F.col("id").alias("eid"), F.col("ord").cast("long").alias("o")))
    first = F.array(*[F.col(c).cast("long") if c in pairs.columns else F.lit(0).cast("long") for c in ("start_ord", "goal_ord")])
    begun = pairs.select("doc_id", "start", "goal", first.alias("order"), F.col("start").alias("at"), F.array("start").alias("nodes"), F.array().cast("array<string>").alias("edge_ids")).distinct()
    columns, in_order, whole = begun.columns, Window.partitionBy(*by).orderBy("order"), F.col("at") == F.col("goal")
    upto, ahead = (in_order.rowsBetween(Window.unboundedPreceding, x) for x in (Window.currentRow, -1))
    ranked = lambda rows: rows.withColumn("place", F.row_number().over(in_order).cast("long")).withColumn("open", F.count_if(~whole).over(upto)).withColumn("full", F.count_if(whole).over(ahead)).where(F.col("full") < limit)
    rows = stored(ranked(begun))
    while True:
        grow = rows.where(~whole & (F.col("open") <= limit))
        if grow.isEmpty():
            return rows.where(whole & (F.col("place") <= limit)).select("doc_id", "start", "goal", "place", "nodes", "edge_ids")
        more = grow.join(step, ["doc_id", "at"]).where(~F.array_contains("nodes", F.col("to")))
        more = more.select("doc_id", "start", "goal", F.concat("order", F.array("o")).alias("order"), F.col("to").alias("at"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edge_ids", F.array("eid")).alias("edge_ids"))
        rows = stored(ranked(rows.where(whole | (F.col("open") > limit)).select(*columns).unionByName(more)))


def first_paths(entries: list[dict], exits: list[dict], edges: list[dict], limit: int) -> Iterator[tuple[int, list[str], list[str]]]:
    """(place, nodes, edge ids) of the first `limit` simple paths of one document, depth first in the order of its edges."""
    onward, back = defaultdict(list), defaultdict(set)
    for e in sorted(edges, key=lambda e: e["ord"]):
        onward[e["source"]].append((e["target"], e["id"]))
        back[e["target"]].add(e["source"])
    useful: dict[str, set[str]] = {}
    for x in exits:  # what can reach the goal at all
        seen = useful.setdefault(x["id"], {x["id"]})
        todo = [x["id"]] if len(seen) == 1 else []
        while todo:
            for n in back[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
    place = 0
    for start in sorted(entries, key=lambda x: x["ord"]):
        for goal in sorted(exits, key=lambda x: x["ord"]):
            nodes, via = [start["id"]], []
            open_ = [iter(onward[start["id"]])] if start["id"] in useful[goal["id"]] else []
            while open_:
                if nodes[-1] == goal["id"]:
                    place += 1
                    yield place, list(nodes), list(via)
                    if place == limit:
                        return
                    step = None
                else:
                    step = next(((n, e) for n, e in open_[-1] if n in useful[goal["id"]] and n not in nodes), None)
                if step:
                    nodes.append(step[0])
                    via.append(step[1])
                    open_.append(iter(onward[step[0]]))
                else:
                    open_.pop()
                    nodes.pop()
                    if via:
                        via.pop()


def paths_to_outputs(nodes: DataFrame, edges: DataFrame, limit: int = MAX_PATHS, group_edges: int = GROUP_EDGES) -> DataFrame:
    """(doc_id, place, nodes, edge_ids): paths from inputs to outputs, at most `limit` for each document.

    In the order of entries, then terminals, then edges as the document lists them.
    """
    small, large = split_by_size(stored(edges.select("doc_id", "ord", "id", "source", "target")), group_edges)
    ends = [(name, df.select("doc_id", "ord", "id")) for name, df in (("entries", entry_points(nodes)), ("exits", terminals(nodes)))]
    some = ends if large is None else [(name, df.join(large.select("doc_id").distinct(), "doc_id", "left_anti")) for name, df in ends]
    found = by_document(gathered(*some, ("edges", small)), lambda *parts: first_paths(*parts, limit), "place long, nodes array<string>, edge_ids array<string>")
    if large is None:
        return found
    start, goal = (df.join(large.select("doc_id").distinct(), "doc_id", "left_semi") for _, df in ends)
    pairs = start.withColumnsRenamed({"id": "start", "ord": "start_ord"}).join(goal.withColumnsRenamed({"id": "goal", "ord": "goal_ord"}), "doc_id")
    return found.unionByName(simple_paths(large, stored(pairs), limit, "doc_id").select("doc_id", "place", "nodes", "edge_ids"))


def rendered_paths(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, place, text): `a(input) --calls--> b(agent) ...`; undeclared nodes go bare, undeclared edges as `?`."""
    kinds = first_by_id(nodes).select("doc_id", F.col("id").alias("item"), F.concat("id", F.lit("("), "type", F.lit(")")).alias("text"))
    arrows = first_by_id(edges).select("doc_id", F.col("id").alias("item"), F.concat(F.lit("--"), "type", F.lit("-->")).alias("text"))
    at = paths.select("doc_id", "place", F.posexplode("nodes").alias("pos", "item")).join(kinds, ["doc_id", "item"], "left")
    at = at.select("doc_id", "place", (F.col("pos") * 2).alias("pos"), F.coalesce("text", "item").alias("text"))
    by = paths.select("doc_id", "place", F.posexplode("edge_ids").alias("pos", "item")).join(arrows, ["doc_id", "item"], "left")
    by = by.select("doc_id", "place", (F.col("pos") * 2 + 1).alias("pos"), F.coalesce("text", F.lit("--?-->")).alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return at.unionByName(by).groupBy("doc_id", "place").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def rag_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Retrievers and stores, and both ends of every retrieval."""
    r = edges.where("type = 'retrieves'")
    ends = r.select("doc_id", F.col("source").alias("id")).unionByName(r.select("doc_id", F.col("target").alias("id"))).distinct()
    by_end = nodes.join(ends.withColumn("hit", F.lit(True)), ["doc_id", "id"], "left")
    return by_end.where(F.col("type").isin("retriever", "vector_store") | F.col("hit")).select(*nodes.columns)


def agents_using_tools(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, agent, tool): tools that an agent reaches without going past another agent."""
    known = first_by_id(nodes)
    inner = edges.join(known.select("doc_id", F.col("id").alias("target")), ["doc_id", "target"], "left_semi")
    agents = nodes_of_type(known, "agent").select("doc_id", F.col("id").alias("agent"), "id").distinct()
    found = reachable_from(inner, agents, "agent", stop=agents.select("doc_id", "id"))
    tools = nodes_of_type(known, "tool").select("doc_id", "id")
    return found.where("agent <> id").join(tools, ["doc_id", "id"], "left_semi").select("doc_id", "agent", F.col("id").alias("tool"))


def impact_of(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, failed, id, type, ord): what stops working when each of `targets` (doc_id, id) fails.

    All downstream of it, and all that those who retrieve from it or use it reach, themselves
    included; declared nodes only.
    """
    own = targets.select("doc_id", F.col("id").alias("failed"), "id").distinct()
    users = edges.where(F.col("type").isin("retrieves", "uses")).select("doc_id", F.col("target").alias("id"), F.col("source").alias("user"))
    seeds = own.unionByName(own.join(users, ["doc_id", "id"]).select("doc_id", "failed", F.col("user").alias("id")))
    hit = reachable_from(edges, seeds, "failed").where("failed <> id")
    return hit.join(nodes.select("doc_id", "id", "type", "ord"), ["doc_id", "id"]).select("doc_id", "failed", "id", "type", "ord")


def unhandled_failures(failures: DataFrame) -> DataFrame:
    """Failure modes said to be unhandled, or about whose handling nothing is said."""
    open_ = (F.col("handled") == F.lit(False)) | (F.col("handled").isNull() & (F.coalesce("handler_node", F.lit("")) == ""))
    return failures.where(open_ & F.col("carrier").isin("nodes", "tools", "data_sources")).select("doc_id", "carrier", "carrier_ord", "ord", F.col("carrier_id").alias("subject"), F.col("description").alias("detail"), "source", "inferred")


def elements(corpus: Corpus) -> DataFrame:
    """(doc_id, kind, id, method, confidence, has_evidence, reviewed_by, notes) of every claim in the corpus."""
    part = ["doc_id", "kind", "id", "method", "confidence", "has_evidence", "reviewed_by", "notes"]
    fill = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in part])
    out = fill(corpus.nodes.withColumn("kind", F.lit("node"))).unionByName(fill(corpus.edges.withColumn("kind", F.lit("edge"))))
    if corpus.registry is not None:
        out = out.unionByName(fill(corpus.registry.withColumn("kind", F.expr("left(registry, length(registry) - 1)"))))
    if corpus.contexts is not None:
        out = out.unionByName(fill(corpus.contexts.withColumn("kind", F.concat("kind", F.lit(".ai_context")))))
    return out


def is_inferred() -> Column:
    return F.col("method") == "ai_inference"


def is_trusted() -> Column:
    """Not inferred, or reviewed by someone (an empty name counts here)."""
    return ~is_inferred() | F.col("reviewed_by").isNotNull()


def low_trust(corpus: Corpus, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """(doc_id, subject, detail, source): inferred and unreviewed claims of low confidence or without evidence."""
    weak = F.when(F.col("confidence") < threshold, F.lit("low confidence"))
    bare = F.when(~F.coalesce("has_evidence", F.lit(False)), F.lit("no evidence"))
    open_ = is_inferred() & (F.coalesce("reviewed_by", F.lit("")) == "")
    claims = elements(corpus).where(open_ & (weak.isNotNull() | bare.isNotNull()))
    return claims.select("doc_id", F.concat_ws(":", "kind", "id").alias("subject"), F.concat_ws("; ", weak, bare).alias("detail"), F.col("notes").alias("source"))


def summary(corpus: Corpus) -> DataFrame:
    """One row for each document: counts of nodes, edges, types, registries, entries, terminals, paths, inferred elements."""
    counted = lambda df, name: df.groupBy("doc_id", "type").count().groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "type", "count"))), ",").alias(name))
    listed = lambda df, name: df.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]), ",").alias(name))
    nodes, edges = corpus.nodes, corpus.edges
    out = nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.count_if(is_inferred()).alias("inferred_nodes"))
    out = out.join(edges.groupBy("doc_id").agg(F.count("*").alias("edges"), F.count_if(is_inferred()).alias("inferred_edges")), "doc_id", "full_outer")
    paths = paths_to_outputs(nodes, edges).groupBy("doc_id").agg(F.count("*").alias("paths_to_output"))
    for more in (counted(nodes, "node_types"), counted(edges, "edge_types"), listed(entry_points(nodes), "entry_points"), listed(terminals(nodes), "terminals"), paths):
        out = out.join(more, "doc_id", "left")
    if corpus.registry is not None:
        sizes = corpus.registry.groupBy("doc_id").pivot("registry", ["prompts", "models", "tools", "data_sources"]).count()
        out = out.join(sizes, "doc_id", "left")
    numbers = ["nodes", "edges", "paths_to_output", "inferred_nodes", "inferred_edges", *(["prompts", "models", "tools", "data_sources"] if corpus.registry is not None else [])]
    out = out.fillna(0, numbers).fillna("", ["node_types", "edge_types", "entry_points", "terminals"])
    return out.withColumn("inferred_elements", F.col("inferred_nodes") + F.col("inferred_edges")).drop("inferred_nodes", "inferred_edges")
