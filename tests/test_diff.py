"""Differences and drift on small tables."""

import json

from loomgraph.operators import diff, drift, payload

FIELDS = "kind string, id string, field string, value string, ord int"


def test_elements_that_share_an_id(spark):
    old = spark.createDataFrame([("nodes", "a", "name", '"x"', 1), ("nodes", "a", "name", '"b"', 2), ("nodes", "a", "type", '"llm"', 1)], FIELDS)
    new = spark.createDataFrame([("nodes", "a", "name", '"c"', 1), ("nodes", "a", "type", '"llm"', 1), ("nodes", "b", "type", '"tool"', 1)], FIELDS)
    got = {(r["op"], r["id"], r["field"], r["before"], r["after"]) for r in diff.changes(old, new).collect()}
    assert got == {("modified", "a", "name", '"b"', '"c"'), ("added", "b", None, None, None)}
    assert diff.changes(old.drop("ord"), old.drop("ord")).count() == 0
    assert [tuple(r) for r in diff.change_counts(diff.changes(old, new)).collect()] == [("nodes", 1, 0, 1)]


def test_volatile_values_go_and_strings_stay(spark):
    ref = {"start_line": 3, "end_line": 4, "file": "a"}
    tricky = {"file": 'b,"start_line":5}', "symbol": '{"end_line":1}', "end_line": None}
    values = {
        "source": [ref, tricky, {"start_line": 1}, "text"], "source_ref": ref, "config": {"start_line": 1, "generated_at": "kept"}, "ai_context": {"provenance": {"generated_at": "kept", "evidence": [ref]}},
        "provenance": {"method": "m", "generated_at": 'at "noon", {', "note": 'x,"generated_at":"y"} z', "evidence": [ref, tricky], "generator": {"name": "g", "start_line": 9}},
    }
    doc = {"version": "1.0", "project": {"name": "p", "commit": "c", "repository": "r", "root": "."}, "metadata": {"generated_at": "t", "files_analyzed": 3, "skipped": [], "stats": {"generated_at": 1}}, "nodes": [{"id": "n"} | values], "edges": [{"id": "e", "source": "n", "start_line": 2}]}
    docs = spark.createDataFrame([(1, json.dumps(doc)), (2, "no json"), (3, "[1]"), (4, None), (5, '{"nodes": {"id": "x"}, "edges": [1, {"id": null}, {"no": "id"}], "project": 3}')], "doc_id long, raw string")
    got = {(r["kind"], r["id"], r["field"]): json.loads(r["value"]) for r in drift.normalised(drift.fields(docs)).collect() if r["doc_id"] == 1}
    lineless = lambda r: {k: v for k, v in r.items() if k not in ("start_line", "end_line")}
    want = {("nodes", "n", k): v for k, v in values.items()} | {("nodes", "n", "id"): "n", ("edges", "e", "id"): "e", ("edges", "e", "source"): "n", ("edges", "e", "start_line"): 2}
    want |= {("nodes", "n", "source"): [lineless(ref), lineless(tricky), {}, "text"], ("nodes", "n", "source_ref"): lineless(ref)}
    want["nodes", "n", "provenance"] = {k: v for k, v in values["provenance"].items() if k != "generated_at"} | {"evidence": [lineless(ref), lineless(tricky)]}
    want |= {("document", "project.name", "name"): "p", ("document", "project.root", "root"): ".", ("document", "version", "version"): "1.0", ("document", "metadata", "metadata"): {"stats": {"generated_at": 1}}}
    assert got == want


def test_drift_is_what_was_really_changed(spark):
    base = {"version": "1.0", "project": {"name": "mine", "commit": "a"}, "nodes": [{"id": "n1", "type": "llm", "source": [{"file": "f.py", "start_line": 1}]}, {"id": "n2", "type": "agent"}, {"id": "n2", "type": "tool"}], "edges": []}
    again = {"version": "1.0", "project": {"name": "yours", "commit": "b", "root": "x"}, "nodes": [{"id": "n1", "type": "llm", "source": [{"file": "f.py", "start_line": 8}]}, {"id": "n2", "type": "prompt"}], "edges": [{"id": "e"}]}
    frame = lambda *docs: spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "doc_id long, raw string")
    got = {tuple(r) for r in drift.drift(frame(base, base), frame(again, base)).collect()}
    assert got == {(0, "nodes", "modified", "n2", "type", '"tool"', '"prompt"'), (0, "edges", "added", "e", None, None, None), (0, "document", "modified", "project.root", "root", None, '"x"')}
    back = {tuple(r)[:5] for r in drift.drift(frame(again), frame(base)).collect()}
    assert back == {(0, "nodes", "modified", "n2", "type"), (0, "edges", "removed", "e", None), (0, "document", "modified", "project.root", "root")}


def test_digests_leave_out_what_they_can_spare(spark):
    """Sources go first, then paths; what is left may still be longer than the limit."""
    nodes = spark.createDataFrame([(1, i, f"n{i}", t, None, "said é", f"f.py:{i}") for i, t in enumerate(["input", "agent", "output"])], "doc_id long, ord long, id string, type string, ref string, description string, source string")
    edges = spark.createDataFrame([(1, 0, "e0", "passes", "n0", "n1", "x > 1"), (1, 1, "e1", "produces", "n1", "n2", None)], "doc_id long, ord long, id string, type string, source string, target string, when string")
    registry = spark.createDataFrame([], "doc_id long, registry string, ord long, id string")
    failures = spark.createDataFrame([(1, "nodes", 1, 0, "n1", "late", None, True)], "doc_id long, carrier string, carrier_ord long, ord long, subject string, detail string, source string, inferred boolean")
    made = lambda most: payload.digest(nodes, edges, registry, failures, most).first()["digest"]
    full = made(20_000)
    want = {"nodes": [{"id": f"n{i}", "type": t, "description": "said é", "source": f"f.py:{i}"} for i, t in enumerate(["input", "agent", "output"])], "edges": [{"id": "e0", "type": "passes", "from": "n0", "to": "n1", "when": "x > 1"}, {"id": "e1", "type": "produces", "from": "n1", "to": "n2"}]}
    want["analysis"] = {"paths": [["n0", "n1", "n2"]], "unhandled_failures": [{"component": "n1", "detail": "late", "inferred": True}]}
    assert full == json.dumps(want) and made(len(full)) == full
    for n in want["nodes"]:
        del n["source"]
    slim = json.dumps(want)
    assert made(len(full) - 1) == slim == made(len(slim))
    del want["analysis"]["paths"]
    assert made(len(slim) - 1) == made(1) == json.dumps(want)
