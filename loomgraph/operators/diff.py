"""Differences by id between two versions, given as (kind, id, field, value) rows.

`value` is canonical JSON text, so equal values have equal text.  The rows of both versions
meet once, by kind and id, and fields are compared within.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The order in which kinds are reported.
KINDS = ["nodes", "edges", "prompts", "models", "tools", "data_sources", "document"]

def changes(old: DataFrame, new: DataFrame, *by: str) -> DataFrame:
    """(*by, kind, op, id, field, before, after): what was added, removed or modified, in each group of the columns `by`.

    Of the document itself only fields are compared.  An absent field reads as null.  Where
    elements share an id the last one counts, by a column `ord` if there is one, else the
    value that sorts last.
    """
    keys = [*by, "kind", "id"]

    def grouped(df: DataFrame) -> DataFrame:
        last = F.max_by("value", F.struct("ord", "value")) if "ord" in df.columns else F.max("value")
        one = df.groupBy(*keys, "field").agg(last.alias("value"))
        return one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))

    met = grouped(old).withColumnRenamed("m", "o").join(grouped(new).withColumnRenamed("m", "n"), keys, "full_outer")
    gone = (F.col("kind") != "document") & (F.col("o").isNull() | F.col("n").isNull())
    whole = met.where(gone).select(*by, "kind", F.when(F.col("o").isNull(), "added").otherwise("removed").alias("op"), "id", *[F.lit(None).cast("string").alias(c) for c in ("field", "before", "after")])
    none = F.expr("cast(map() as map<string, string>)")
    both = met.where(~gone).select(*keys, F.coalesce("o", none).alias("o"), F.coalesce("n", none).alias("n"))
    fields = both.select(*keys, "o", "n", F.explode(F.array_distinct(F.concat(F.map_keys("o"), F.map_keys("n")))).alias("field"))
    compared = fields.select(*by, "kind", F.lit("modified").alias("op"), "id", "field", F.col("o")[F.col("field")].alias("before"), F.col("n")[F.col("field")].alias("after"))
    return whole.unionByName(compared.where(~F.col("before").eqNullSafe(F.col("after"))))


def in_order(found: DataFrame) -> DataFrame:
    """Kinds in their fixed order; added, removed, modified; then id and field."""
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    op = F.array_position(F.array(F.lit("added"), F.lit("removed"), F.lit("modified")), F.col("op"))
    return found.orderBy(kind, op, "id", "field")


def change_counts(found: DataFrame) -> DataFrame:
    """(kind, added, removed, modified)."""
    return found.groupBy("kind").pivot("op", ["added", "removed", "modified"]).count().fillna(0)


def brief(value: str, most: int = 90):
    """A one-line rendering of a value column."""
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most - 1)), F.lit("…"))).otherwise(F.col(value))
