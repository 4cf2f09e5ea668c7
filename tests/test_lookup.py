"""Search, registry use and citations on a few rows, nulls among them."""

from loomgraph.operators import corpus as co, enrich


def test_search_use_and_citations(spark):
    nodes = spark.createDataFrame([(1, 0, "Ask", "llm", None, "big"), (1, 1, "b", "llm", "the ASK step", "gone"), (2, 0, "ask", "llm", None, None)], "doc_id long, ord long, id string, type string, name string, ref string")
    needles = spark.createDataFrame([(1, "aSk"), (2, None)], "doc_id long, needle string")
    assert sorted((r.doc_id, r.id) for r in co.search(nodes, needles).collect()) == [(1, "Ask"), (1, "b")]
    registry = spark.createDataFrame([(1, "models", "big"), (1, "models", "big"), (1, "models", "idle"), (2, "models", "big")], "doc_id long, registry string, id string")
    assert sorted((r.doc_id, r.id, r.uses) for r in co.usage(nodes, registry).collect()) == [(1, "big", 1), (1, "idle", 0), (2, "big", 0)]
    edges = spark.createDataFrame([(1, "e")], "doc_id long, id string")
    cites = spark.createDataFrame([(1, "e", 0), (1, "e", 1), (2, "e", 0), (1, None, 0), (2, "ask", 5)], "doc_id long, id string, place int")
    assert sorted((r.doc_id, r.id, r.place) for r in enrich.cited(cites, nodes, edges).collect()) == [(1, "e", 0), (1, "e", 1), (2, "ask", 5)]
    assert co.search(nodes.limit(0), needles).count() == co.usage(nodes.limit(0), registry.limit(0)).count() == 0
