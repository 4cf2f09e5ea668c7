"""Documents assembled from findings: registries, nodes and edges of many projects at once.

findings(doc_id, ord, kind, name, key, scope, confidence, and by kind: model, const,
provider, model_const, var, class, store, receiver, description, route, entry_kind, label,
target, node_type, source, router, partial, bound; arrays: refs, llm_calls, prompts, tools,
stores, routes of (when, target)); `ord` is unique in a project.  Kinds: prompt, model, tool,
vector_store, agent, retriever, llm, retrieval, instance, entrypoint, and from adapters
fw_node, fw_edge, fw_branch, fw_entry, fw_terminal.

What findings say of each other by name becomes joins by (doc_id, name); elements are told by
handles `role:ord` until their ids are minted, nodes before edges: generic ones first, then
those of adapters.  `seq` tells the order in which elements come, and ids with them.

Defined results: of equal prompt, agent, retriever names, keys, variables and constants the
last finding is meant, of tools the first; references to what is not found make no edge;
null names resolve to nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.corpus import Corpus
from loomgraph.operators.graph import stored
from loomgraph.operators.minting import base_of, minted

_NODE = "doc_id seq handle prefix title type ref name description method ord notes".split()
_EDGE = "doc_id seq type source target ord notes method when label before of after".split()
_ENTRY = "doc_id seq handle registry prefix title name provider model ord method notes".split()


def _seq(*parts: Column | int) -> Column:
    return F.array(*[(F.lit(p) if isinstance(p, int) else p).cast("long") for p in parts])


def _handle(role: str, ord_: Column | str = "ord") -> Column:
    return F.concat(F.lit(f"{role}:"), (F.col(ord_) if isinstance(ord_, str) else ord_).cast("string"))


def _of(f: DataFrame, kind: str) -> DataFrame:
    return f.where(F.col("kind") == kind)


def _filled(df: DataFrame, columns: list[str], **values: Column | str | None) -> DataFrame:
    """`columns` of `df`, those named in `values` as given and absent ones null."""
    get = lambda c: (values[c] if isinstance(values[c], Column) else F.lit(values[c])) if c in values else F.col(c) if c in df.columns else F.lit(None)
    kinds = {"seq": "array<long>", "doc_id": "long", "ord": "long"}
    return df.select(*[get(c).cast(kinds.get(c, "string")).alias(c) for c in columns])


def by_name(f: DataFrame, kind: str, column: str, role: str, first: bool = False) -> DataFrame:
    """(doc_id, called, handle, ord, since): what a name means in a project; since: its first finding's place."""
    pick = F.min if first else F.max
    some = _of(f, kind).where(F.col(column).isNotNull() & (F.col(column) != ""))
    return some.groupBy("doc_id", F.col(column).alias("called")).agg(pick("ord").alias("ord"), F.min("ord").alias("since")).withColumn("handle", _handle(role))


def scope_head(column: str = "scope") -> Column:
    """The class or function that a scope begins with; null if there is none."""
    return F.when(F.col(column) != "", F.substring_index(column, ".", 1))


def _meant(rows: DataFrame, column: str, names: DataFrame, to: str) -> DataFrame:
    """`rows` with the handle that `column` means, null if none, as `to`, and its place as `to`_since."""
    known = names.select("doc_id", F.col("called").alias(column), F.col("handle").alias(to), F.col("since").alias(f"{to}_since"))
    return rows.join(known, ["doc_id", column], "left")


# ------------------------------------------------------------------ references between findings


def model_refs(f: DataFrame) -> DataFrame:
    """(doc_id, ord, ref, via) of each llm finding: its model by constant, else by literal, else a new one."""
    consts = by_name(f, "model", "const", "model").select("doc_id", F.col("called").alias("model_const"), F.col("handle").alias("by_const"))
    literals = by_name(f, "model", "model", "model").select("doc_id", F.col("called").alias("model"), F.col("handle").alias("by_literal"))
    met = _of(f, "llm").select("doc_id", "ord", "model_const", "model").join(consts, ["doc_id", "model_const"], "left").join(literals, ["doc_id", "model"], "left")
    via = F.when(F.col("by_const").isNotNull(), "const").when(F.col("by_literal").isNotNull(), "literal").otherwise("new")
    return met.select("doc_id", "ord", F.coalesce("by_const", "by_literal", _handle("unnamed")).alias("ref"), via.alias("via"))


def _listed(rows: DataFrame, array: str) -> DataFrame:
    """A row for each member of an array, as `called`, with its position `at`."""
    return rows.select("*", F.posexplode(array).alias("at", "called"))


def class_edges(f: DataFrame) -> DataFrame:
    """Edges of agents to the llms, prompts, tools and retrievers that their classes name, and of retrievers to stores."""
    agents = by_name(f, "agent", "name", "agent")
    own = agents.join(_of(f, "agent").select("doc_id", "ord", "llm_calls", F.array_distinct("refs").alias("refs")), ["doc_id", "ord"])
    own = own.select("doc_id", "ord", F.col("since").alias("agent_since"), F.col("handle").alias("source"), "llm_calls", "refs")
    edge = lambda rows, kind, at, note: _filled(rows.where("target is not null"), _EDGE, type=kind, seq=_seq(8, F.col("agent_since"), *at), notes=note, method="static_analysis")
    called = _meant(_listed(own, "llm_calls"), "called", by_name(f, "llm", "key", "llm"), "target")
    out = edge(called, "calls", (0, F.col("at")), "model call inside the class")
    named = _listed(own, "refs")
    for i, (kind, role, first, verb, note) in enumerate([("prompt", "prompt", False, "uses", "prompt named in the class"), ("tool", "tool", True, "calls", "tool named in the class"), ("retriever", "retriever", False, "retrieves", "retriever made in the class")], 1):
        out = out.unionByName(edge(_meant(named, "called", by_name(f, kind, "name", role, first), "target"), verb, (i, F.col("target_since")), note))
    reads = _of(f, "retrieval").withColumn("owner", scope_head())
    reads = _meant(_meant(reads, "owner", by_name(f, "retriever", "name", "retriever"), "source_"), "store", by_name(f, "vector_store", "key", "store"), "target_")
    reads = reads.where("source_ is not null and target_ is not null")
    note = F.concat(F.lit("retrieval call on "), F.coalesce(F.when(F.col("receiver") != "", F.col("receiver")), F.lit("the store")))
    return out.unionByName(_filled(reads, _EDGE, type="retrieves", source=F.col("source_"), target=F.col("target_"), seq=_seq(9, F.col("ord")), notes=note, method="static_analysis"))


# ------------------------------------------------------------------ steps and branches of adapters


def steps(f: DataFrame) -> DataFrame:
    """(doc_id, ord, handle, label, target, type) of the steps that adapters declare.

    A step whose type is not declared retrieves, if the function that handles it does so and
    calls no model, else it is an agent.
    """
    own = _of(f, "fw_node").select("doc_id", "ord", "label", F.coalesce(F.when(F.col("target") != "", F.col("target")), F.col("label")).alias("target"), F.when(F.col("node_type") != "", F.col("node_type")).alias("node_type"))
    inside = f.where(F.col("kind").isin("llm", "retrieval")).select("doc_id", scope_head().alias("target"), "kind").groupBy("doc_id", "target").agg(F.bool_or(F.col("kind") == "llm").alias("calls"), F.bool_or(F.col("kind") == "retrieval").alias("reads"))
    met = own.join(inside, ["doc_id", "target"], "left")
    kind = F.coalesce("node_type", F.when(F.col("reads") & ~F.col("calls"), "retriever").otherwise("agent"))
    return met.select("doc_id", "ord", _handle("step").alias("handle"), "label", "target", kind.alias("type"))


def labels(f: DataFrame) -> DataFrame:
    """(doc_id, called, handle, ord, since, kind): what a label means to edges: the last step of that label, else the first branch that starts there.

    since: from which branch on it is known, -1 for steps.
    """
    own = by_name(f, "fw_node", "label", "step").select("doc_id", "called", "handle", F.col("since").alias("ord"), F.lit(-1).cast("long").alias("since"), F.lit(0).alias("kind"))
    roots = by_name(f, "fw_branch", "source", "cond", first=True).join(own.select("doc_id", "called"), ["doc_id", "called"], "left_anti")
    return own.unionByName(roots.select("doc_id", "called", "handle", "ord", F.col("ord").alias("since"), F.lit(1).alias("kind")))


def framed(f: DataFrame) -> DataFrame:
    """(doc_id) of the projects whose graph an adapter knows."""
    return _of(f, "fw_node").select("doc_id").distinct()


def step_edges(f: DataFrame) -> DataFrame:
    """Edges of steps to the models, prompts, tools and stores that their handlers use or their declarations bind."""
    own = steps(f).select("doc_id", F.col("ord").alias("step_ord"), F.col("handle").alias("source"), F.col("target").alias("owner"))
    out = None

    def add(rows: DataFrame, kind: str, *at: Column | int, note: str) -> None:
        nonlocal out
        made = _filled(rows.where("target is not null"), _EDGE, type=kind, seq=_seq(10, F.col("step_ord"), *at), notes=note, method="static_analysis")
        out = made if out is None else out.unionByName(made)

    inside = f.where(F.col("kind").isin("llm", "retrieval")).withColumn("owner", scope_head()).drop("source", "target").join(own, ["doc_id", "owner"])
    calls = _of(inside, "llm")
    stores, prompts, tools = by_name(f, "vector_store", "key", "store"), by_name(f, "prompt", "name", "prompt"), by_name(f, "tool", "name", "tool", first=True)
    add(_meant(calls, "key", by_name(f, "llm", "key", "llm"), "target"), "calls", 0, F.col("ord"), 0, note="model call inside the step's handler")
    add(_meant(_listed(calls, "prompts"), "called", prompts, "target"), "uses", 0, F.col("ord"), F.col("at") + 1, note="prompt named by the step's handler")
    add(_meant(_of(inside, "retrieval"), "store", stores, "target"), "retrieves", 0, F.col("ord"), 0, note="retrieval call inside the step's handler")
    declared = _of(f, "fw_node").drop("source", "target").withColumn("step_ord", F.col("ord")).withColumn("source", _handle("step"))
    for i, (array, names, kind, note) in enumerate([("tools", tools, "calls", "tool bound to the step"), ("prompts", prompts, "uses", "prompt bound to the step"), ("stores", stores, "retrieves", "store bound to the step")], 1):
        add(_meant(_listed(declared, array), "called", names, "target"), kind, i, F.col("at"), note=note)
    bound = inline_models(f)
    add(bound.withColumn("step_ord", F.col("ord")).withColumn("source", _handle("step")), "calls", 4, note="model bound to the step")
    return out


def inline_models(f: DataFrame) -> DataFrame:
    """(doc_id, ord, label, target, ref, provider, model) of the steps that bind a model.

    target: the llm of the variable that they name, else `stepllm` of their own (ref: its
    model, the literal's or, new, that of the first step that names it).
    """
    own = _meant(_of(f, "fw_node").select("doc_id", "ord", "label", "bound", "model", "provider"), "bound", by_name(f, "llm", "var", "llm"), "by_var")
    own = _meant(own, "model", by_name(f, "model", "model", "model"), "known").where("by_var is not null or coalesce(model, '') <> ''")
    new = F.col("by_var").isNull() & F.col("known").isNull()
    first = F.min(F.when(new, F.col("ord"))).over(Window.partitionBy("doc_id", "model"))
    ref = F.when(F.col("by_var").isNull(), F.coalesce("known", _handle("inline", first)))
    return own.select("doc_id", "ord", "label", F.coalesce("by_var", _handle("stepllm")).alias("target"), ref.alias("ref"), "provider", "model")


def _quoted(text: str) -> Column:
    """A label as it stands in a condition: in single quotes, in double ones where it has single ones only."""
    c = F.replace(F.col(text), F.lit("\\"), F.lit("\\\\"))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'")))


def branch_edges(f: DataFrame) -> DataFrame:
    """Edges into conditions from the steps that they follow, and out of them to the labels of their routes.

    A branch that follows no step is a root, and stands for its label from then on.
    """
    own = _of(f, "fw_branch").select("doc_id", "ord", "source", "routes").join(framed(f), "doc_id", "left_semi").withColumn("cond", _handle("cond"))
    known = labels(f).select("doc_id", F.col("called"), F.col("handle").alias("from"), F.col("since"))
    into = own.join(known, (own["doc_id"] == known["doc_id"]) & (own["source"] == known["called"]) & (known["from"] != own["cond"])).select(own["doc_id"], "ord", "cond", F.col("source").alias("stem"), F.col("from"))
    out = _filled(into, _EDGE, type="passes", source=F.col("from"), target=F.col("cond"), seq=_seq(11, F.col("ord"), 0), method="framework_adapter", before=F.concat("stem", F.lit("_to_")), of=F.col("cond"), notes=None)
    ways = own.select("doc_id", "ord", "cond", F.posexplode("routes").alias("at", "way")).select("doc_id", "ord", "cond", "at", F.col("way.when").alias("word"), F.col("way.target").alias("called"))
    ways = ways.join(known, ["doc_id", "called"]).where(F.col("since") <= F.col("ord"))
    return out.unionByName(_filled(ways, _EDGE, type="routes_to", source=F.col("cond"), target=F.col("from"), seq=_seq(11, F.col("ord"), F.col("at") + 1), method="framework_adapter", when=F.concat(F.lit("route == "), _quoted("word")), label=F.col("word"), of=F.col("cond"), after=F.concat(F.lit("_"), "word"), notes=None))


def sequence_edges(f: DataFrame) -> DataFrame:
    """Edges between labels that adapters declare to follow each other."""
    known = labels(f)
    own = _of(f, "fw_edge").select("doc_id", "ord", F.col("source").alias("a"), F.col("target").alias("b")).join(framed(f), "doc_id", "left_semi")
    met = _meant(_meant(own, "a", known, "source"), "b", known, "target").where("source is not null and target is not null")
    return _filled(met, _EDGE, type="passes", seq=_seq(12, F.col("ord")), method="static_analysis", notes="one step after the other")


def _ends(f: DataFrame, kind: str) -> DataFrame:
    """(doc_id, ord, label, at) of the entries or terminals whose label is known."""
    own = _of(f, kind).select("doc_id", "ord", "label").join(framed(f), "doc_id", "left_semi")
    return _meant(own, "label", labels(f), "at").where("at is not null")


def headless(f: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, ord, at, kind, since) of projects whose adapter names no entry at all: the first entrypoint, and each step or root branch that no edge reaches."""
    first = _of(f, "entrypoint").groupBy("doc_id").agg(F.min("ord").alias("ord"))
    open_ = framed(f).join(_of(f, "fw_entry").select("doc_id").distinct(), "doc_id", "left_anti").join(first, "doc_id")
    reached = edges.select("doc_id", F.col("target").alias("handle")).distinct()
    roots = labels(f).select("doc_id", "handle", "kind", F.col("ord").alias("since")).join(reached, ["doc_id", "handle"], "left_anti")
    return roots.join(open_, "doc_id").select("doc_id", "ord", F.col("handle").alias("at"), "kind", "since")


# ------------------------------------------------------------------ dataflow of entrypoints


def consumed(statements: DataFrame) -> DataFrame:
    """(doc_id, ord, step, receiver, method, consumes) of statements (doc_id, ord, pos, line, receiver, method, uses, assigns).

    A statement consumes what the receivers returned that last assigned the variables it
    uses, before it (an as-of join by variable and position; what it assigns itself counts
    for later ones only).  Steps are numbered by line, then position.
    """
    at = ["doc_id", "ord", "pos"]
    defs = statements.select(*at, F.explode("assigns").alias("variable"), F.lit(1).alias("kind"), "receiver").distinct()
    uses = statements.select(*at, F.explode(F.array_distinct("uses")).alias("variable"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("receiver"))
    before = Window.partitionBy("doc_id", "ord", "variable").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = defs.unionByName(uses).withColumn("from", F.last("receiver", ignorenulls=True).over(before)).where("kind = 0 and from is not null")
    per = found.groupBy(*at).agg(F.array_sort(F.collect_set("from")).alias("consumes"))
    step = F.row_number().over(Window.partitionBy("doc_id", "ord").orderBy("line", "pos"))
    return statements.withColumn("step", step).join(per, at, "left").select("doc_id", "ord", "step", "receiver", "method", F.coalesce("consumes", F.array().cast("array<string>")).alias("consumes"))


def components(f: DataFrame) -> DataFrame:
    """(doc_id, receiver, component): the agent or retriever that a variable or class name stands for."""
    classes = by_name(f, "agent", "name", "agent").select("doc_id", F.col("called").alias("class"), F.col("handle").alias("component"), F.lit(0).alias("rank"))
    classes = classes.unionByName(by_name(f, "retriever", "name", "retriever").select("doc_id", F.col("called").alias("class"), F.col("handle").alias("component"), F.lit(1).alias("rank")))
    one = classes.groupBy("doc_id", "class").agg(F.min_by("component", "rank").alias("component"))
    last = by_name(f, "instance", "name", "instance").join(_of(f, "instance").select("doc_id", "ord", "class"), ["doc_id", "ord"]).select("doc_id", F.col("called").alias("receiver"), "class")
    plain = one.select("doc_id", F.col("class").alias("receiver"), "component").join(last.select("doc_id", "receiver"), ["doc_id", "receiver"], "left_anti")
    return last.join(one, ["doc_id", "class"]).select("doc_id", "receiver", "component").unionByName(plain)


def entry_flows(f: DataFrame, statements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, ord) of the entrypoints that reach a component, and the edges from their inputs through components to their outputs.

    Only in projects whose graph no adapter knows.
    """
    known = components(f)
    open_ = _of(f, "entrypoint").select("doc_id", "ord").join(framed(f), "doc_id", "left_anti")
    flow = stored(consumed(statements).join(open_, ["doc_id", "ord"], "left_semi").join(known, ["doc_id", "receiver"]))
    ends = flow.groupBy("doc_id", "ord").agg(F.min("step").alias("first"), F.min_by("component", "step").alias("head"), F.max_by("component", "step").alias("tail"))
    out = _filled(ends, _EDGE, type="passes", source=_handle("in"), target=F.col("head"), seq=_seq(16, F.col("ord"), 1), method="static_analysis", notes="first component of the entrypoint")
    later = flow.join(ends.select("doc_id", "ord", "first"), ["doc_id", "ord"]).where("step > first").select("*", F.posexplode("consumes").alias("at", "upstream"))
    later = later.join(known.select("doc_id", F.col("receiver").alias("upstream"), F.col("component").alias("from")), ["doc_id", "upstream"]).where("from <> component")
    note = F.concat("receiver", F.lit("."), "method", F.lit("() consumes a value of "), "upstream")
    out = out.unionByName(_filled(later, _EDGE, type="passes", source=F.col("from"), target=F.col("component"), seq=_seq(16, F.col("ord"), 2, F.col("step"), F.col("at")), method="static_analysis", notes=note))
    out = out.unionByName(_filled(ends, _EDGE, type="produces", source=F.col("tail"), target=_handle("out"), seq=_seq(16, F.col("ord"), 3), method="static_analysis", notes="last component of the entrypoint"))
    return ends.select("doc_id", "ord"), out


# ------------------------------------------------------------------ whole documents


def entries(f: DataFrame) -> DataFrame:
    """Registry entries by handle: prompts, models (also unnamed and inline ones), tools (the first of a name), stores."""
    own = lambda kind, n, role, registry, prefix, title, **more: _filled(_of(f, kind) if kind != "tool" else _first_tools(f), _ENTRY, seq=_seq(n, F.col("ord"), 0), handle=_handle(role), registry=registry, prefix=prefix, title=title, method="static_analysis", **more)
    dotless = lambda c: F.replace(c, F.lit("."), F.lit("_"))
    out = own("prompt", 1, "prompt_entry", "prompts", "p_", F.col("name"), provider=None, model=None, notes=None)
    out = out.unionByName(own("model", 2, "model", "models", "m_", dotless(F.col("model")), notes=None))
    out = out.unionByName(own("tool", 3, "tool_entry", "tools", "t_", F.col("name"), provider=None, model=None, notes=None))
    out = out.unionByName(own("vector_store", 4, "store_entry", "data_sources", "ds_", F.col("name"), model=None, notes=None))
    unnamed = _of(f, "llm").join(model_refs(f).where("via = 'new'").select("doc_id", "ord"), ["doc_id", "ord"], "left_semi")
    out = out.unionByName(_filled(unnamed, _ENTRY, seq=_seq(7, F.col("ord"), 0), handle=_handle("unnamed"), registry="models", prefix="m_", title=F.concat("provider", F.lit("_unresolved")), model="unknown", method="static_analysis", notes="the model is neither a literal nor a known constant"))
    inline = inline_models(f).where(F.col("ref") == _handle("inline"))
    return out.unionByName(_filled(inline, _ENTRY, seq=_seq(10, F.col("ord"), 1), handle=_handle("inline"), registry="models", prefix="m_", title=dotless(F.col("model")), provider=F.coalesce("provider", F.lit("unknown")), name=None, method="framework_adapter", notes="named on the declaration"))


def _first_tools(f: DataFrame) -> DataFrame:
    return _of(f, "tool").join(by_name(f, "tool", "name", "tool", first=True).select("doc_id", "ord"), ["doc_id", "ord"], "left_semi")


def nodes_by_handle(f: DataFrame, adapter_ends: DataFrame, flows: DataFrame) -> DataFrame:
    """All nodes by handle; `adapter_ends`: first entrypoints of headless graphs, `flows`: entrypoints of generic ones (doc_id, ord)."""
    own = lambda rows, n, role, prefix, title, kind, sub=1, **more: _filled(rows, _NODE, seq=_seq(n, F.col("ord"), sub), handle=_handle(role), prefix=prefix, title=title, type=kind, **({"method": "static_analysis", "ref": None, "notes": None, "description": None} | more))
    c = F.col
    out = own(_of(f, "prompt"), 1, "prompt", "prompt_", c("name"), "prompt", ref=_handle("prompt_entry"))
    out = out.unionByName(own(_first_tools(f), 3, "tool", "tool_", c("name"), "tool", ref=_handle("tool_entry")))
    out = out.unionByName(own(_of(f, "vector_store"), 4, "store", "vs_", c("name"), "vector_store", ref=_handle("store_entry")))
    for n, kind in ((5, "agent"), (6, "retriever")):
        out = out.unionByName(own(_of(f, kind), n, kind, "", c("name"), kind, description=c("description")))
    llms = _of(f, "llm").join(model_refs(f).select("doc_id", "ord", "ref"), ["doc_id", "ord"])
    owner = F.coalesce(scope_head(), F.when(c("var") != "", c("var")), c("file"))
    out = out.unionByName(own(llms, 7, "llm", "llm_", owner, "llm", ref=c("ref")))
    kinds = steps(f).select("doc_id", "ord", c("type").alias("kind_"), c("target").alias("by"))
    framework = {"method": "framework_adapter"}
    out = out.unionByName(own(_of(f, "fw_node").join(kinds, ["doc_id", "ord"]), 10, "step", "", c("label"), c("kind_"), 0, name=c("label"), notes=F.concat(F.lit("step handled by "), "by"), **framework))
    inline = inline_models(f).where(c("target") == _handle("stepllm"))
    out = out.unionByName(own(inline, 10, "stepllm", "llm_", c("label"), "llm", 2, name=F.concat("label", F.lit(" model")), ref=c("ref"), **framework))
    some = lambda kind: _of(f, kind).join(framed(f), "doc_id", "left_semi")
    router = F.when(c("router") != "", c("router"))
    out = out.unionByName(own(some("fw_branch"), 11, "cond", "cond_", F.coalesce(router, F.concat("source", F.lit("_branch"))), "condition", 0, name=F.coalesce(router, F.lit("branch")), description=F.when(c("partial"), "Some branch targets were no literals and are missing here."), **framework))
    out = out.unionByName(own(_ends(f, "fw_entry"), 13, "entry", "in_", F.concat("label", F.lit("_entry")), "input", 0, name="Graph entry", **framework))
    out = out.unionByName(own(_ends(f, "fw_terminal"), 15, "terminal", "out_", F.concat("label", F.lit("_result")), "output", 0, name="Graph result", **framework))
    entry = _of(f, "entrypoint")
    told = F.concat(F.coalesce("entry_kind", F.lit("entry")), F.lit(" entrypoint"), F.coalesce(F.when(c("route") != "", F.concat(F.lit(" "), "route")), F.lit("")))
    for n, rows in ((14, adapter_ends), (16, flows)):
        out = out.unionByName(own(entry.join(rows.select("doc_id", "ord").distinct(), ["doc_id", "ord"], "left_semi"), n, "in", "in_", c("name"), "input", 0, description=told))
    return out.unionByName(own(entry.join(flows, ["doc_id", "ord"], "left_semi"), 16, "out", "out_", c("name"), "output", 4, name=F.concat("name", F.lit(" response"))))


def framework_edges(f: DataFrame) -> DataFrame:
    """The edges that adapters know, by handle, without entries and terminals."""
    return step_edges(f).join(framed(f), "doc_id", "left_semi").select(*_EDGE).unionByName(branch_edges(f)).unionByName(sequence_edges(f))


def end_edges(f: DataFrame, heads: DataFrame) -> DataFrame:
    """Edges from the entries of adapters' graphs, from the entrypoint of headless ones, and to their terminals."""
    out = _filled(_ends(f, "fw_entry"), _EDGE, type="passes", source=_handle("entry"), target=F.col("at"), seq=_seq(13, F.col("ord"), 1), method="static_analysis", notes="entry of the graph")
    out = out.unionByName(_filled(heads, _EDGE, type="passes", source=_handle("in"), target=F.col("at"), seq=_seq(14, F.col("ord"), 1, F.col("kind"), F.col("since")), method="static_analysis", notes="entrypoint to a component that nothing reaches"))
    return out.unionByName(_filled(_ends(f, "fw_terminal"), _EDGE, type="produces", source=F.col("at"), target=_handle("terminal"), seq=_seq(15, F.col("ord"), 1), method="framework_adapter", before=F.concat("label", F.lit("_produces")), notes=None))


@dataclass
class Assembled:
    """nodes, edges and registry of all projects, with their ids, in document order `ord`."""

    nodes: DataFrame
    edges: DataFrame
    registry: DataFrame

    def corpus(self) -> Corpus:
        """For the graph operators and for validation: every element has its finding as evidence."""
        trust = {"has_evidence": F.lit(True), "reviewed_by": F.lit(None).cast("string")}
        none = {"source_port": F.lit(None).cast("string"), "target_port": F.lit(None).cast("string"), "is_default": F.lit(False)}
        return Corpus(self.nodes.withColumns(trust), self.edges.withColumns(trust | none), self.registry.withColumns(trust))


def assembled(findings: DataFrame, statements: DataFrame) -> Assembled:
    """The documents of all projects; `statements` as `consumed` takes them, by entrypoint finding."""
    f = stored(findings)
    sure = f.select("doc_id", "ord", F.round("confidence", 2).alias("confidence"))
    flows, flow_edges = entry_flows(f, statements)
    generic, framework = stored(class_edges(f)), stored(framework_edges(f))
    heads = stored(headless(f, generic.unionByName(framework)))
    things = stored(nodes_by_handle(f, heads, flows).withColumn("registry", F.lit(None).cast("string")).unionByName(entries(f), allowMissingColumns=True))
    things = things.withColumn("base", base_of(F.col("prefix"), F.col("title")))
    early = F.col("seq")[0] < 10
    first = minted(things.where(early))

    def named(edges: DataFrame, handles: DataFrame, taken: DataFrame) -> DataFrame:
        ids = handles.select("doc_id", "handle", "id")
        for end in ("source", "target", "of"):
            edges = edges.join(ids.select("doc_id", F.col("handle").alias(end), F.col("id").alias(f"{end}_id")), ["doc_id", end], "left")
        stem = F.coalesce(F.concat(F.coalesce("before", F.lit("")), F.coalesce("of_id", F.lit("")), F.coalesce("after", F.lit(""))), F.lit(""))
        plain = F.concat_ws("_", "source_id", "type", "target_id")
        made = edges.withColumn("base", base_of("e_", F.when(F.col("before").isNull() & F.col("of").isNull(), plain).otherwise(stem)))
        return minted(made.drop("source", "target", "of").withColumnsRenamed({"source_id": "source", "target_id": "target"}), taken).drop("of_id")

    edges = named(generic, first, first)
    late = minted(things.where(~early), first.select("doc_id", "id").unionByName(edges.select("doc_id", "id")))
    handles = stored(first.unionByName(late))
    taken = handles.select("doc_id", "id").unionByName(edges.select("doc_id", "id"))
    edges = edges.unionByName(named(framework.unionByName(end_edges(f, heads)).unionByName(flow_edges), handles, taken))
    order = lambda df: df.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")).cast("long") - 1)
    placed = lambda df, *cols: order(df).join(sure, ["doc_id", "ord"], "left").select("doc_id", F.col("place").alias("ord"), *cols, "method", "confidence", "notes")
    ids = handles.select("doc_id", F.col("handle").alias("ref"), F.col("id").alias("ref_id"))
    nodes = handles.where("registry is null").join(ids, ["doc_id", "ref"], "left").drop("ref").withColumnRenamed("ref_id", "ref")
    registry = handles.where("registry is not null")
    place = F.row_number().over(Window.partitionBy("doc_id", "registry").orderBy("seq")).cast("long") - 1
    registry = registry.withColumn("place", place).join(sure, ["doc_id", "ord"], "left").select("doc_id", "registry", F.col("place").alias("ord"), "id", "name", "provider", "model", "method", "confidence", "notes")
    return Assembled(stored(placed(nodes, "id", "type", "name", "ref", "description")), stored(placed(edges, "id", "type", "source", "target", "when", "label")), stored(registry))


def projects(reports: DataFrame, adapters: DataFrame) -> DataFrame:
    """(doc_id, files, frameworks, notes) of reports (doc_id, file_ord, frameworks, notes) and adapters (doc_id, ord, name, framework, found, notes).

    frameworks: (name, adapter) sorted by name, the adapter where it found something; notes:
    those of files in their order, then those of adapters.
    """
    used = adapters.where("found").groupBy("doc_id", F.col("framework").alias("name")).agg(F.max_by("name", "ord").alias("adapter"))
    named = reports.select("doc_id", F.explode("frameworks").alias("name")).distinct().join(used, ["doc_id", "name"], "left")
    frameworks = named.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("name", "adapter"))).alias("frameworks"))
    said = reports.select("doc_id", F.lit(0).alias("part"), F.col("file_ord").alias("ord"), F.posexplode("notes").alias("at", "note")).unionByName(adapters.select("doc_id", F.lit(1).alias("part"), "ord", F.posexplode("notes").alias("at", "note")))
    notes = said.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "ord", "at", "note"))), lambda x: x["note"]).alias("notes"))
    files = reports.groupBy("doc_id").agg(F.count("*").alias("files"))
    return files.join(frameworks, "doc_id", "left").join(notes, "doc_id", "left")
