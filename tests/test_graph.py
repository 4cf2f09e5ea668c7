"""Graph operators on hand-made and random graphs against a plain model."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import graph, validate
from loomgraph.operators.corpus import Corpus
from loomgraph.functions import rules

NODE = "doc_id long, ord long, id string, type string, name string, ref string, method string, confidence double, has_evidence boolean, reviewed_by string"
EDGE = "doc_id long, ord long, id string, type string, source string, target string, source_port string, target_port string, is_default boolean, method string, confidence double, has_evidence boolean, reviewed_by string"


def tables(spark, nodes, edges):
    n = spark.createDataFrame([(d, i, x, t, None, None, None, None, None, None) for d, i, x, t in nodes], NODE)
    e = spark.createDataFrame([(d, i, x, t, a, b, None, None, None, None, None, None, None) for d, i, x, t, a, b in edges], EDGE)
    return n, e


def test_paths_reach_and_cycles(spark):
    nodes = [(1, 0, "in", "input"), (1, 1, "a", "agent"), (1, 2, "b", "agent"), (1, 3, "out", "output"), (1, 4, "lone", "tool")]
    edges = [(1, 0, "e0", "calls", "in", "a"), (1, 1, "e1", "calls", "a", "b"), (1, 2, "e2", "calls", "b", "a"), (1, 3, "e3", "produces", "b", "out"), (1, 4, "e4", "produces", "a", "out"), (1, 5, "e5", "produces", "a", "out"), (1, 6, "e6", "calls", "a", "a")]
    n, e = tables(spark, nodes, edges)
    found = [(r["nodes"], r["edge_ids"]) for r in graph.paths_to_outputs(n, e).orderBy("place").collect()]
    assert found == [(["in", "a", "b", "out"], ["e0", "e1", "e3"]), (["in", "a", "out"], ["e0", "e4"]), (["in", "a", "out"], ["e0", "e5"])]
    assert [r["place"] for r in graph.paths_to_outputs(n, e, limit=2).collect()] == [1, 2]
    assert [r["id"] for r in graph.unreachable(n, e).collect()] == ["lone"]
    itself = spark.createDataFrame([(1, "a", "a")], "doc_id long, start string, goal string")
    assert [(r["nodes"], r["edge_ids"]) for r in graph.simple_paths(e, itself).collect()] == [(["a"], [])]


def test_random_graphs(spark):
    rng = random.Random(5)
    nodes, edges = [], []
    for d in range(40):
        for i in range(6):
            nodes.append((d, i, f"n{i}", rng.choice(rules.NODE_TYPES)))
        for k in range(9):
            edges.append((d, k, f"e{k}", rng.choice(rules.EDGE_TYPES), f"n{rng.randrange(7)}", f"n{rng.randrange(7)}"))
    n, e = tables(spark, nodes, edges)
    kind = {(d, x): t for d, _, x, t in nodes}

    def walk(d, seeds, stop=lambda x: False):
        seen, todo = set(seeds), list(seeds)
        while todo:
            at = todo.pop()
            for d2, _, _, _, a, b in edges:
                if d2 == d and a == at and b not in seen:
                    seen.add(b)
                    if not stop(b):
                        todo.append(b)
        return seen

    want = {(d, x) for d in range(40) for x in walk(d, [y for (d2, y), t in kind.items() if d2 == d and t == "input"])}
    got = {(r["doc_id"], r["id"]) for r in graph.reachable_from(e, n.where("type = 'input'")).collect()}
    assert got == want
    want = set()
    for (d, a), t in kind.items():
        if t == "agent":
            seen, todo = {a}, [a]
            while todo:
                at = todo.pop()
                for d2, _, _, _, s, b in edges:
                    if d2 == d and s == at and (d, b) in kind and b not in seen:
                        seen.add(b)
                        if kind[d, b] == "agent":
                            continue
                        if kind[d, b] == "tool":
                            want.add((d, a, b))
                        todo.append(b)
    assert {tuple(r) for r in graph.agents_using_tools(n, e).collect()} == want


def test_whole_matrix_as_one_job(spark):
    """AF230 fires for an edge exactly when its types do not fit: all 486 combinations."""
    nodes, edges, wrong = [], [], set()
    d = 0
    for e in rules.EDGE_TYPES:
        for s in rules.NODE_TYPES:
            for t in rules.NODE_TYPES:
                nodes += [(d, 0, "s", s), (d, 1, "t", t)]
                edges.append((d, 0, "e", e, "s", "t"))
                if s not in rules.EDGE_SOURCES[e]:
                    wrong.add((d, "$['edges'][0]['source']"))
                if t not in rules.EDGE_TARGETS[e]:
                    wrong.add((d, "$['edges'][0]['target']"))
                d += 1
    n, e = tables(spark, nodes, edges)
    assert d == 486
    assert {(r["doc_id"], r["path"]) for r in validate.broken_edges(Corpus(n, e)).where("code = 'AF230'").collect()} == wrong


def test_empty_tables(spark):
    n, e = tables(spark, [], [])
    assert graph.reachable_from(e, n.where("type = 'input'")).count() == 0
    assert graph.paths_to_outputs(n, e).count() == 0
    assert validate.validate_semantic(Corpus(n, e)).count() == 0


def test_paths_stop_at_the_cap(spark):
    """Twenty diamonds in a row: 2^20 paths, of which the first thousand are walked."""
    nodes, edges = [(1, 0, "i", "input"), (1, 99, "o", "output")], []
    for k in range(20):
        at = "i" if k == 0 else f"j{k}"
        to = "o" if k == 19 else f"j{k + 1}"
        for side in "ab":
            edges += [(1, len(edges), f"{at}{side}", at, f"{side}{k}"), (1, len(edges) + 1, f"{side}{to}", f"{side}{k}", to)]
    n = spark.createDataFrame(nodes, "doc_id long, ord long, id string, type string")
    e = spark.createDataFrame([(*x, "passes") for x in edges], "doc_id long, ord long, id string, source string, target string, type string")
    got = {r["place"]: r["nodes"] for r in graph.paths_to_outputs(n, e).collect()}
    large = {r["place"]: r["nodes"] for r in graph.paths_to_outputs(n, e, limit=30, group_edges=10).collect()}
    assert large == {place: got[place] for place in range(1, 31)}
    assert sorted(got) == list(range(1, 1001))
    for place in (1, 2, 1000):  # in the order of edges: the last diamond turns fastest
        turns = [x[0] for x in got[place] if x[0] in "ab"]
        assert int("".join("01"["ab".index(t)] for t in turns), 2) == place - 1


def test_large_documents_give_the_same(spark):
    rng = random.Random(5)
    nodes = [(d, i, f"n{i}", rng.choice(["input", "output", "agent", "tool", "llm"])) for d in range(6) for i in range(9)]
    edges = [(d, i, f"e{i}", f"n{rng.randrange(10)}", f"n{rng.randrange(10)}", rng.choice(["passes", "uses"])) for d in range(6) for i in range(4 + 3 * d)]
    n = spark.createDataFrame(nodes, "doc_id long, ord long, id string, type string")
    e = spark.createDataFrame(edges, "doc_id long, ord long, id string, source string, target string, type string")
    agents = n.where("type = 'agent'").select("doc_id", F.col("id").alias("agent"), "id")
    stop = agents.select("doc_id", "id")
    rows = lambda df: sorted(map(repr, df.collect()))
    for limit in (1, 9):
        assert rows(graph.reachable_from(e, agents, "agent", stop=stop, group_edges=limit)) == rows(graph.reachable_from(e, agents, "agent", stop=stop))
        assert rows(graph.paths_to_outputs(n, e, group_edges=limit)) == rows(graph.paths_to_outputs(n, e))
    for most in (1, 2, 5):
        assert rows(graph.paths_to_outputs(n, e, most, group_edges=1)) == rows(graph.paths_to_outputs(n, e, most))
