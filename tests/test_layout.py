"""Layout and drawings: order, space, cycles, escaping."""

import pytest

from test_graph import tables
from loomgraph.operators import layout, sinks


def test_forward_edges_lead_on_and_nothing_overlaps(spark):
    nodes = [(1, i, x, "agent") for i, x in enumerate(["in", "a", "b", "c", "out"])] + [(2, 0, "x", "agent"), (2, 1, "y", "agent"), (3, 0, "alone", "input")]
    edges = [(1, i, f"e{i}", "calls", a, b) for i, (a, b) in enumerate([("in", "a"), ("in", "b"), ("a", "c"), ("b", "c"), ("c", "out"), ("c", "c"), ("c", "ghost")])] + [(2, 0, "f", "calls", "x", "y"), (2, 1, "g", "calls", "y", "x")]
    n, e = tables(spark, nodes, edges)
    for across in (True, False):
        at = {(r["doc_id"], r["id"]): r for r in layout.laid_out(n, e, across).collect()}
        assert len(at) == 8
        for d, _, _, _, a, b in edges[:5]:
            assert at[d, a]["layer"] < at[d, b]["layer"]
        boxes = [(r["x"], r["y"]) for (d, _), r in at.items() if d == 1]
        for i, (x, y) in enumerate(boxes):
            for u, v in boxes[:i]:
                assert abs(x - u) >= layout.WIDTH or abs(y - v) >= layout.HEIGHT
        assert all(0 <= r["x"] <= r["width"] - layout.WIDTH and 0 <= r["y"] <= r["height"] - layout.HEIGHT for r in at.values())
    assert {at[2, "x"]["layer"], at[2, "y"]["layer"]} == {0, 1}


def test_drawings_escape(spark):
    n, e = tables(spark, [(1, 0, "<script>", "input"), (1, 1, "b", "output")], [(1, 0, "e", "passes", "<script>", "b")])
    drawn = sinks.svg(n, e, "dark")
    text = drawn.first()["svg"]
    assert "&lt;script&gt;" in text and "<script>" not in text and text.count("<rect") == 3
    page = sinks.html(spark.createDataFrame([(1, "<b>", '{"a": "</script>"}')], "doc_id long, title string, raw string"), drawn).first()["html"]
    assert "<title>&lt;b&gt;</title>" in page and page.count("</script>") == 1
    with pytest.raises(ValueError):
        sinks.svg(n, e, "pink")
