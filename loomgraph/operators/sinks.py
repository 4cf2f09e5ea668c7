"""Pictures and pages of every document.  Content is untrusted: all of it is escaped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.corpus import first_by_id
from loomgraph.operators.layout import HEIGHT, WIDTH, laid_out
from loomgraph.operators.text import escaped

# Colours: background, box, line, text.
THEMES = {"light": ("#ffffff", "#f4f6f8", "#5b6672", "#1d2329"), "dark": ("#14181d", "#232a32", "#8b98a5", "#e8edf2")}


def svg(nodes: DataFrame, edges: DataFrame, theme: str = "light", across: bool = True) -> DataFrame:
    """(doc_id, svg): one drawing for each document; an unknown theme is an error."""
    if theme not in THEMES:
        raise ValueError(f"unknown theme {theme!r}; there are {', '.join(THEMES)}")
    back, box, line, ink = THEMES[theme]
    at = laid_out(nodes, edges, across)
    known = first_by_id(nodes).select("doc_id", "id", "type", "name")
    number = lambda c: F.format_string("%.1f", c)
    boxes = at.join(known, ["doc_id", "id"]).select(
        "doc_id", F.lit(1).alias("part"), F.col("layer").alias("a"), F.col("place").alias("b"),
        F.concat(F.lit('<rect x="'), number(F.col("x")), F.lit('" y="'), number(F.col("y")), F.lit(f'" width="{WIDTH}" height="{HEIGHT}" rx="6" fill="{box}" stroke="{line}"/><text x="'), number(F.col("x") + 10), F.lit('" y="'), number(F.col("y") + 23), F.lit(f'" fill="{ink}">'), escaped(F.left(F.coalesce("name", "id"), F.lit(24))), F.lit(f'</text><text x="'), number(F.col("x") + 10), F.lit('" y="'), number(F.col("y") + 41), F.lit(f'" fill="{line}">'), escaped("type"), F.lit("</text>")).alias("text"),
    )
    end = lambda c: at.select("doc_id", F.col("id").alias(c), (F.col("x") + WIDTH / 2).alias(f"{c}_x"), (F.col("y") + HEIGHT / 2).alias(f"{c}_y"))
    drawn = edges.join(end("source"), ["doc_id", "source"]).join(end("target"), ["doc_id", "target"])
    lines = drawn.select("doc_id", F.lit(0).alias("part"), F.col("ord").cast("int").alias("a"), F.lit(0).alias("b"), F.concat(F.lit('<path d="M'), number(F.col("source_x")), F.lit(" "), number(F.col("source_y")), F.lit(" L"), number(F.col("target_x")), F.lit(" "), number(F.col("target_y")), F.lit(f'" stroke="{line}" fill="none"/>')).alias("text"))
    body = lines.unionByName(boxes).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "a", "b", "text"))), lambda p: p["text"]), "").alias("body"))
    size = at.groupBy("doc_id").agg(F.max("width").alias("w"), F.max("height").alias("h"))
    box_ = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), number(F.col("w")), F.lit(" "), number(F.col("h")), F.lit(f'" font-family="sans-serif" font-size="13"><rect width="100%" height="100%" fill="{back}"/>'))
    return size.join(body, "doc_id").select("doc_id", F.concat(box_, "body", F.lit("</svg>")).alias("svg"))


def html(documents: DataFrame, drawings: DataFrame) -> DataFrame:
    """(doc_id, html): a page with the drawing and the document (doc_id, title, raw) as data that cannot close its script."""
    data = F.replace(F.col("raw"), F.lit("</"), F.lit("<\\/"))
    return documents.join(drawings, "doc_id").select("doc_id", F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), escaped("title"), F.lit("</title></head><body>"), "svg", F.lit('<script type="application/json" id="document">'), data, F.lit("</script></body></html>")).alias("html"))
