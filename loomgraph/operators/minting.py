"""Identifiers made from names, in one namespace for each document.

Names are served in order, and each gets the first of base, base_2, base_3, ... that no
earlier one has.  That is what requests reach that all propose their first choice, where an
id keeps the earliest of its proposers and the others go on to their next choice; every
round is one window over proposals, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import stored
from loomgraph.operators.text import snake

#: Fixed value: the length of an identifier before its suffix.
MOST = 120


def base_of(prefix: str | Column, name: Column) -> Column:
    """What an identifier begins with: `prefix` and the name in snake case, never starting with a digit."""
    base = F.left(F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, snake(name)), F.lit(MOST))
    return F.when(base.rlike("^[A-Za-z]"), base).otherwise(F.concat(F.lit("n_"), base))


def minted(requests: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """`requests` (doc_id, seq, base, ...) with `id`, given in the order of `seq` (any sortable type, distinct in a document).

    `taken` (doc_id, id): ids that are in use already.  The rounds end when no id has two
    proposers; there are as many as ids are passed on from base to base, few as a rule.
    """
    by_base = Window.partitionBy("doc_id", "base", "__held").orderBy("seq")
    # of equal bases the k-th can have no choice before the k-th
    rows = requests.withColumn("__held", F.lit(False))
    if taken is not None:
        rows = rows.unionByName(taken.select("doc_id", F.col("id").alias("base")).distinct().withColumn("__held", F.lit(True)), allowMissingColumns=True)
    rows = rows.withColumn("__k", F.row_number().over(by_base)).withColumn("__n", F.col("__k"))
    while True:
        named = rows.withColumn("id", F.when(F.col("__n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.col("__n").cast("string"))))
        rank = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy(F.desc("__held"), "seq"))
        rows = stored(named.withColumn("__lost", (rank > 1).cast("int")))
        if rows.where("__lost = 1").isEmpty():
            return rows.where(~F.col("__held")).drop("__held", "__k", "__n", "__lost")
        # later ones of a base stay behind earlier ones
        ahead = F.max(F.col("__n") + F.col("__lost") - F.col("__k")).over(by_base.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("__n", (ahead + F.col("__k")).cast("int")).drop("id", "__lost")
