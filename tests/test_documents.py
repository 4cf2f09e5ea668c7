"""Documents in and out, and what structural validation finds in them."""

import json

from loomgraph.operators import graph, structure, validate
from loomgraph.sources import documents

FORMAT = "flow"


def sound():
    return {
        "format": FORMAT, "version": "1.1", "project": {"name": "p", "commit": "abcdef1", "frameworks": [{"name": "own"}]},
        "nodes": [
            {"id": "ask", "type": "input", "outputs": [{"name": "q"}]},
            {"id": "lead", "type": "agent", "inputs": [{"name": "q"}], "depends_on": ["ask"], "ai_context": {"summary": "s", "failure_modes": [{"description": "slow"}, {"description": "late", "handled": True}], "provenance": {"method": "ai_inference", "confidence": 0.4}}},
            {"id": "m", "type": "llm", "ref": "big"},
            {"id": "end", "type": "output", "config": {"any": [1, None]}},
        ],
        "edges": [
            {"id": "a", "type": "passes", "source": "ask", "target": "lead", "source_port": "q", "target_port": "q"},
            {"id": "b", "type": "calls", "source": "lead", "target": "m"},
            {"id": "c", "type": "produces", "source": "lead", "target": "end", "provenance": {"method": "manual", "evidence": [{"file": "x.py", "start_line": 1.0}]}},
        ],
        "models": [{"id": "big", "provider": "p", "model": "m", "parameters": {"temperature": 1, "more": True}}],
    }


def edit(f):
    d = sound()
    f(d)
    return d


DEFECTS = {
    "$": [lambda d: d.pop("format"), lambda d: d.update(extra=1)],
    "$['version']": [lambda d: d.update(version="2.0"), lambda d: d.update(version="1.0\n")],
    "$['format']": [lambda d: d.update(format="other")],
    "$['nodes']": [lambda d: d.update(nodes={})],
    "$['nodes'][0]": [lambda d: d["nodes"][0].pop("id"), lambda d: d["nodes"][0].update(colour="red")],
    "$['nodes'][0]['id']": [lambda d: d["nodes"][0].update(id="1x"), lambda d: d["nodes"][0].update(id=5), lambda d: d["nodes"][0].update(id="x" * 129)],
    "$['nodes'][0]['type']": [lambda d: d["nodes"][0].update(type="robot")],
    "$['nodes'][1]['ref']": [lambda d: d["nodes"][1].update(ref="big")],
    "$['nodes'][2]": [lambda d: d["nodes"][2].pop("ref"), lambda d: d["nodes"].__setitem__(2, "text")],
    "$['nodes'][1]['ai_context']['provenance']": [lambda d: d["nodes"][1]["ai_context"]["provenance"].pop("confidence")],
    "$['nodes'][1]['ai_context']['provenance']['confidence']": [lambda d: d["nodes"][1]["ai_context"]["provenance"].update(confidence=1.5)],
    "$['nodes'][1]['ai_context']['failure_modes'][0]": [lambda d: d["nodes"][1]["ai_context"]["failure_modes"][0].pop("description")],
    "$['nodes'][1]['depends_on'][0]": [lambda d: d["nodes"][1].update(depends_on=[None])],
    "$['edges'][1]": [lambda d: d["edges"][1].update(type="routes_to")],
    "$['edges'][1]['default']": [lambda d: d["edges"][1].update(default="yes")],
    "$['edges'][2]['provenance']['evidence'][0]['start_line']": [lambda d: d["edges"][2]["provenance"]["evidence"][0].update(start_line=1.5)],
    "$['models'][0]['parameters']['temperature']": [lambda d: d["models"][0]["parameters"].update(temperature="hot")],
    "$['project']['commit']": [lambda d: d["project"].update(commit="XYZ")],
    "$['project']['frameworks'][0]": [lambda d: d["project"]["frameworks"][0].pop("name")],
}


def test_each_defect_has_its_place(spark):
    cases = [(path, edit(f)) for path, fs in DEFECTS.items() for f in fs]
    rows = [(i, json.dumps(d)) for i, (_, d) in enumerate(cases)] + [(900, json.dumps(sound())), (901, "{"), (902, "[]"), (903, json.dumps(edit(lambda d: d["edges"][1].update(type="routes_to", default=True))))]
    found = {}
    for r in structure.validate_structural(spark.createDataFrame(rows, "doc_id long, raw string"), FORMAT).collect():
        found.setdefault(r["doc_id"], []).append(r["path"])
    assert {i: found.get(i) for i in range(len(cases))} == {i: [p] for i, (p, _) in enumerate(cases)}
    assert 900 not in found and 903 not in found and found[901] == found[902] == ["$"]


def test_corpus_of_documents(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(sound()))
    docs = documents.read_documents(spark, str(tmp_path))
    c = documents.corpus_of(docs)
    assert [r["code"] for r in validate.validate_semantic(c).collect()] == []
    assert [(r["subject"], r["detail"], r["inferred"]) for r in graph.unhandled_failures(c.failures).collect()] == [("lead", "slow", True)]
    assert sorted((r["subject"], r["detail"]) for r in graph.low_trust(c).collect()) == [("node.ai_context:lead", "low confidence; no evidence")]
    raw = documents.documents_of(c.nodes.select("doc_id", "ord", "id", "type", "ref"), c.edges.select("doc_id", "ord", "id", "type", "source", "target"), FORMAT)
    back = json.loads(raw.first()["raw"])
    assert [n["id"] for n in back["nodes"]] == ["ask", "lead", "m", "end"] and "ref" not in back["nodes"][0]
    assert structure.validate_structural(raw, FORMAT).count() == 0
