"""Assembly of documents from findings: ids, references, branches, dataflow, and that the whole is sound."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF
from loomgraph.operators import assemble, graph, minting, validate
from loomgraph.plans import findings as given


def one_by_one(bases, taken=()):
    """Ids given in order, each the first free of base, base_2, ..."""
    taken, out = set(taken), []
    for base in bases:
        n, name = 1, base
        while name in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name)
        out.append(name)
    return out


@pytest.mark.parametrize(
    "bases",
    [["a", "a_2", "a"], ["a", "a", "a_2", "a_2", "a"], ["a_2", "a", "a"], ["a_2_2", "a_2", "a", "a_2", "a"], ["x"] * 9 + ["x_3", "x_3"]],
)
def test_chained_collisions(spark, bases):
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate(bases)], "doc_id long, seq long, base string")
    assert [r["id"] for r in minting.minted(df).orderBy("seq").collect()] == one_by_one(bases)


def test_ids_of_random_names_in_one_namespace(spark):
    rng = random.Random(5)
    names = ["a", "a_2", "a_3", "a_2_2", "b", "b_2", "a_4"]
    docs = {d: [rng.choice(names) for _ in range(25)] for d in range(12)}
    df = spark.createDataFrame([(d, i, b) for d, bs in docs.items() for i, b in enumerate(bs)], "doc_id long, seq long, base string")
    taken = spark.createDataFrame([(d, x) for d in docs for x in ("a", "a_3")], "doc_id long, id string")
    got = {(r["doc_id"], r["seq"]): r["id"] for r in minting.minted(df, taken).collect()}
    assert got == {(d, i): x for d, bs in docs.items() for i, x in enumerate(one_by_one(bs, ("a", "a_3")))}


def test_bases(spark):
    names = ["ROUTER_PROMPT", "HTTPGet", "9lives", "", "Ünï!", "a" * 300]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(minting.base_of("", F.col("n")).alias("b"), minting.base_of("t_", F.col("n")).alias("t"))
    assert [tuple(r) for r in df.collect()] == [("router_prompt", "t_router_prompt"), ("http_get", "t_http_get"), ("n_9lives", "t_9lives"), ("x", "t_x"), ("n", "t_n"), ("a" * 120, "t_" + "a" * 118)]


KINDS = {c: "string" for c in "kind name key file scope model const provider model_const var class store receiver description route entry_kind label target node_type source router bound".split()}
KINDS |= {"doc_id": "long", "ord": "long", "confidence": "double", "partial": "boolean", "routes": "array<struct<when:string,target:string>>"} | {c: "array<string>" for c in "refs llm_calls prompts tools stores".split()}


def table(spark, rows):
    rows = [{"doc_id": 1, "ord": i, "confidence": 0.9, "provider": "own", "file": "app.py"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(c) for c in KINDS) for r in rows], ", ".join(f"`{c}` {k}" for c, k in KINDS.items()))


STATEMENT = "doc_id long, ord long, pos long, line long, receiver string, method string, uses array<string>, assigns array<string>"


def whole(spark, rows, statements=()):
    made = assemble.assembled(table(spark, rows), spark.createDataFrame([(1, *s) for s in statements], STATEMENT))
    nodes = {r["id"]: r for r in made.nodes.collect()}
    edges = [(r["source"], r["type"], r["target"]) for r in made.edges.orderBy("ord").collect()]
    return made, nodes, edges


def test_model_references_by_precedence(spark):
    rows = [
        {"kind": "model", "model": "m-1", "const": "A"}, {"kind": "model", "model": "m-1", "const": "B"}, {"kind": "llm", "key": "k1", "model_const": "A", "model": "m-1"},
        {"kind": "llm", "key": "k2", "model_const": "none", "model": "m-1"}, {"kind": "llm", "key": "k3", "var": "v"}, {"kind": "llm", "key": "k4", "scope": "C.run"},
    ]
    made, nodes, _ = whole(spark, rows)
    assert {i: n["ref"] for i, n in nodes.items()} == {"llm_app_py": "m_m_1", "llm_app_py_2": "m_m_1_2", "llm_v": "m_own_unresolved", "llm_c": "m_own_unresolved_2"}
    assert [r["model"] for r in made.registry.orderBy("ord").collect()] == ["m-1", "m-1", "unknown", "unknown"]


def test_entrypoint_dataflow(spark):
    """First and last component by line; redefinitions, ties and self use by position; receivers that are no component are left out."""
    rows = [
        {"kind": "agent", "name": "Planner"}, {"kind": "agent", "name": "Writer"}, {"kind": "retriever", "name": "Reader"}, {"kind": "instance", "name": "p", "class": "Planner"},
        {"kind": "instance", "name": "w", "class": "none"}, {"kind": "instance", "name": "w", "class": "Writer"}, {"kind": "entrypoint", "name": "main", "entry_kind": "cli"},
    ]
    statements = [
        (6, 0, 10, "p", "plan", ["q"], ["x", "y"]), (6, 1, 12, "Reader", "read", ["x"], ["x"]), (6, 2, 14, "log", "log", ["x"], ["z"]),
        (6, 3, 16, "w", "write", ["x", "y", "x"], ["x"]), (6, 4, 11, "p", "again", ["x", "z"], []), (6, 5, 20, "nobody", "run", ["x"], []),
    ]
    made, nodes, edges = whole(spark, rows, statements)
    assert edges == [
        ("in_main", "passes", "planner"), ("writer", "passes", "planner"), ("planner", "passes", "reader"), ("reader", "passes", "writer"), ("planner", "passes", "writer"), ("writer", "produces", "out_main"),
    ]
    assert nodes["in_main"]["description"] == "cli entrypoint" and nodes["out_main"]["name"] == "main response"


def test_steps_branches_and_ends(spark):
    rows = [
        {"kind": "fw_node", "label": "plan", "target": "do_plan"}, {"kind": "fw_node", "label": "find", "target": "do_find"}, {"kind": "fw_node", "label": "say", "node_type": "tool", "model": "m.1"}, {"kind": "fw_node", "label": "say it", "model": "m.1"},
        {"kind": "llm", "key": "k", "scope": "do_plan.x", "prompts": ["ASK"], "model": "m.2"}, {"kind": "retrieval", "store": "s", "scope": "do_find"}, {"kind": "vector_store", "key": "s", "name": "docs"}, {"kind": "prompt", "name": "ASK"},
        {"kind": "fw_branch", "source": "plan", "router": "pick", "routes": [("a", "find"), ("it's", "say"), ("b", "lost"), ("early", "root")]},
        {"kind": "fw_branch", "source": "root", "routes": [("self", "root")], "partial": True}, {"kind": "fw_branch", "source": "root", "routes": []},
        {"kind": "fw_edge", "source": "find", "target": "say"}, {"kind": "fw_edge", "source": "find", "target": "lost"}, {"kind": "fw_entry", "label": "plan"}, {"kind": "fw_entry", "label": "lost"}, {"kind": "fw_terminal", "label": "say"}, {"kind": "entrypoint", "name": "main"},
    ]
    made, nodes, edges = whole(spark, rows)
    assert {i: n["type"] for i, n in nodes.items() if i in ("plan", "find", "say", "say_it", "cond_pick")} == {"plan": "agent", "find": "retriever", "say": "tool", "say_it": "agent", "cond_pick": "condition"}
    assert edges == [
        ("plan", "calls", "llm_do_plan"), ("plan", "uses", "prompt_ask"), ("find", "retrieves", "vs_docs"), ("say", "calls", "llm_say"), ("say_it", "calls", "llm_say_it"),
        ("plan", "passes", "cond_pick"), ("cond_pick", "routes_to", "find"), ("cond_pick", "routes_to", "say"), ("cond_root_branch", "routes_to", "cond_root_branch"), ("cond_root_branch", "passes", "cond_root_branch_2"),
        ("find", "passes", "say"), ("in_plan_entry", "passes", "plan"), ("say", "produces", "out_say_result"),
    ]
    assert nodes["llm_say"]["ref"] == nodes["llm_say_it"]["ref"] == "m_m_1" and nodes["llm_do_plan"]["ref"] == "m_own_unresolved"
    assert {r["when"] for r in made.edges.collect()} == {None, "route == 'a'", 'route == "it\'s"', "route == 'self'"}
    assert {r["id"] for r in made.edges.collect()} >= {"e_plan_to_cond_pick", "e_cond_pick_a", "e_say_produces"}
    assert "main" not in "".join(nodes)


def test_headless_graphs_take_the_first_entrypoint(spark):
    rows = [{"kind": "fw_node", "label": "a"}, {"kind": "fw_node", "label": "b"}, {"kind": "fw_node", "label": "c"}, {"kind": "fw_edge", "source": "a", "target": "b"}, {"kind": "entrypoint", "name": "go", "route": "/x"}, {"kind": "entrypoint", "name": "later"}]
    _, nodes, edges = whole(spark, rows)
    assert edges == [("a", "passes", "b"), ("in_go", "passes", "a"), ("in_go", "passes", "c")]
    assert nodes["in_go"]["description"] == "entry entrypoint /x"


def test_nothing_found(spark):
    made = assemble.assembled(table(spark, []), spark.createDataFrame([], STATEMENT))
    assert made.nodes.count() == made.edges.count() == made.registry.count() == 0


def test_documents_are_sound_and_named_in_order(spark):
    """All projects of the given events: one namespace, no loose ends, nothing that validation calls broken, and traversals run over them."""
    made = assemble.assembled(given.findings(spark, SF), given.statements(spark, SF))
    ids = made.nodes.select("doc_id", "id").unionByName(made.edges.select("doc_id", "id")).unionByName(made.registry.select("doc_id", "id"))
    assert ids.count() == ids.distinct().count() > 1000
    corpus = made.corpus()
    broken = validate.duplicate_ids(corpus).unionByName(validate.broken_refs(corpus)).unionByName(validate.broken_edges(corpus).where("code = 'AF210' or code = 'AF211'"))
    assert [r for r in broken.collect() if r["severity"] == "error"] == []
    assert graph.paths_to_outputs(made.nodes, made.edges).count() > 0
