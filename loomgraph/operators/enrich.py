"""Preparing model calls that annotate nodes, and reading what models reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batches(items: DataFrame, most_items: int = 5, most_chars: int = 4000) -> DataFrame:
    """(doc_id, id, batch): `items` (doc_id, ord, id, chars) of each document in order, filled greedily.

    A batch closes when a further item would make it more than `most_items` items or
    `most_chars` characters; an item that is longer has a batch of its own.
    """
    per = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", F.col("chars").cast("long").alias("chars")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<struct<id:string,batch:bigint>>").alias("out"))

    def put(state: Column, item: Column) -> Column:
        full = (state["n"] > 0) & ((state["n"] >= most_items) | (state["chars"] + item["chars"] > most_chars))
        batch = state["batch"] + F.when(full, 1).otherwise(0)
        n = F.when(full, F.lit(1)).otherwise(state["n"] + 1).cast("long")
        chars = F.when(full, item["chars"]).otherwise(state["chars"] + item["chars"])
        return F.struct(batch.cast("long").alias("batch"), n.alias("n"), chars.alias("chars"), F.concat(state["out"], F.array(F.struct(item["id"].alias("id"), batch.cast("long").alias("batch")))).alias("out"))

    placed = per.select("doc_id", F.explode(F.aggregate("items", start, put, lambda s: s["out"])).alias("x"))
    return placed.select("doc_id", "x.id", "x.batch")


def lenient_json(text: str | Column) -> Column:
    """The JSON in a reply as a variant: all of it, else what is fenced, else from the first brace to the last."""
    c = F.col(text) if isinstance(text, str) else text
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    parsed = lambda x: F.try_parse_json(F.when(F.trim(x) != "", x))
    return F.coalesce(parsed(c), parsed(fenced), parsed(braces))


def confidence(value: str | Column) -> Column:
    """A model's own confidence between 0 and 1 to two digits, 0.5 if it is no number."""
    c = F.col(value) if isinstance(value, str) else value
    number = c.try_cast("double")
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(number, F.lit(0.5)), F.lit(0.5)))), 2)


def grounded(replies: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of `replies` (doc_id, batch, id, ...) about nodes that were asked for and exist."""
    real = replies.join(asked.select("doc_id", "batch", "id").distinct(), ["doc_id", "batch", "id"], "left_semi")
    return real.join(nodes.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_semi")


def cited(cites: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of `cites` (doc_id, id, ...) that name a node or an edge of their document."""
    known = nodes.select("doc_id", "id").unionByName(edges.select("doc_id", "id")).distinct()
    return cites.join(known, ["doc_id", "id"], "left_semi").select(*cites.columns)
