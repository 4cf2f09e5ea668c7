"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target number of words.  Whole copies of the source are taken as often
as they fit; the budget that remains is fitted with further documents: they are counted
by exact length, the bulk of a large budget is dealt to all lengths in proportion, and the
rest is filled by bounded-knapsack dynamic programming over the lengths left.  Documents
are then drawn by length count in the order of a seeded hash.

Only (source, length, count) rows reach a single task for a source.  With W words in a
source there are at most sqrt(2 W) distinct lengths, so that table stays small where the
documents do not.

Defined results: a null text has size 0; a null source is a source of its own, ranked
last; documents of size 0 take part and are taken for 0 words; repeated rows are documents
of their own; a source whose sizes sum to 0 has target 0; extra columns are not passed on.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stash


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, source_size, target: `share` of all words dealt by weight, none above `most` of its own.

    With sources sorted by the level at which they fill up (most * size / weight), those
    below some place are full and the rest share what is left; that place is found from
    running sums over one row for each source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # rank of each source in code-point order without one task for all: counts of ranges, then ranks within
    ranged = per.where(F.col("source").isNotNull()).repartitionByRange(F.col("source")).withColumn("part", F.spark_partition_id())
    ranged = stash(ranged)
    before = ranged.groupBy("part").count().withColumn("offset", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("part").orderBy("source"))
    named = ranged.withColumn("within", within).join(F.broadcast(before.select("part", F.coalesce("offset", F.lit(0)).alias("offset"))), "part")
    named = named.select("source", "source_size", (F.col("offset") + F.col("within") - 1).alias("place"))
    unnamed = per.where(F.col("source").isNull()).withColumn("place", F.lit(ranged.count()))
    ranked = named.unionByName(unnamed)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = stash(ranked.withColumn("weight", weight).withColumn("limit", F.lit(float(most)) * F.col("source_size")))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double")).first()[0]
    budget, full = share * total, -1.0
    while True:  # each round fills at least one more level; rounds follow the levels, not the data
        open_ = ranked.where(F.col("limit") / F.col("weight") > F.lit(full))
        filled = ranked.where(F.col("limit") / F.col("weight") <= F.lit(full))
        taken = filled.agg(F.coalesce(F.sum("limit"), F.lit(0.0))).first()[0]
        open_weight = open_.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
        if not open_weight:
            level = float("inf")
            break
        level = (budget - taken) / open_weight
        if level <= full or not ranked.where((F.col("limit") / F.col("weight") > F.lit(full)) & (F.col("limit") / F.col("weight") < F.lit(level))).take(1):
            break
        full = level
    return ranked.select("source", "source_size", F.least(F.col("limit"), F.lit(level) * F.col("weight")).alias("target"))


def fit_lengths(lengths: list[int], counts: list[int], budget: int, window: int = 1 << 16) -> list[int]:
    """How many of each length to take so that their sum comes as near `budget` as found.

    What the budget has beyond `window` words goes to all lengths in proportion, then to the
    longest; the rest is a bounded knapsack (counts split in powers of two, one bitset of
    reachable sums for each item) that finds the reachable sum nearest to it, the lower of
    two.  Budgets within the window are fitted by the knapsack alone, so as well as can be.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget <= 0 or not total:
        return [0] * len(lengths)
    take = [c * max(0, budget - window) // total if n else 0 for n, c in zip(lengths, counts, strict=True)]
    rest = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if rest <= window:
            break
        if lengths[i]:
            more = min(counts[i] - take[i], (rest - window) // lengths[i] + 1, rest // lengths[i])
            take[i] += more
            rest -= more * lengths[i]
    items, reach = [], [1]
    mask = (1 << (rest + min(rest, max(lengths)) + 1)) - 1  # some way beyond, for a nearer sum above
    for i, n in sorted(enumerate(lengths), key=lambda x: -x[1]):
        left = min(counts[i] - take[i], 2 * rest // n) if n else 0
        part = 1
        while left > 0 and not reach[-1] >> rest & 1:
            some = min(part, left)
            items.append((i, some))
            reach.append((reach[-1] | reach[-1] << (some * n)) & mask)
            left -= some
            part *= 2
    below = (reach[-1] & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach[-1] >> rest
    above = rest + (above & -above).bit_length() - 1 if above else below
    at = above if abs(above - rest) < rest - below else below
    for (i, some), before in zip(reversed(items), reversed(reach[:-1]), strict=True):
        if not before >> at & 1:
            take[i] += some
            at -= some * lengths[i]
    return take


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1, lane_rows: int = 512, row: str | None = None) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken) for each document, and `row` if named.

    `weights` are dealt to the sources in code-point order, repeating.  `lane_rows` is the
    usual size of the groups in which documents of one source and length are ranked: only
    the one group at the border is ranked row by row, the others are taken or left whole.
    `row` names a column that tells repeated rows apart.
    """
    kept = [key, row] if row else [key]
    sized = docs.select(*kept, F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(text)).alias("order"))
    sized = stash(sized)
    targets = stash(source_targets(sized, weights, share, most))
    counted = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    of_source = targets.withColumnRenamed("source", "of_source")
    budgeted = counted.join(of_source, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        words, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        whole = int(target // words) if words else 0
        budget = round(target - whole * words)
        extra = fit_lengths(group["size"].tolist(), group["n"].tolist(), budget) if words else [0] * len(group)
        return group.assign(whole=whole, extra=extra)

    plan = budgeted.groupBy("source").applyInPandas(fit, "source string, size long, n long, source_size long, target double, whole int, extra long")
    plan = stash(plan.withColumn("lanes", F.ceil(F.col("n") / F.lit(lane_rows)).cast("long")))
    # lanes below the border are taken whole, the lane at the border by rank, the rest are left
    of_length = plan.withColumnsRenamed({"source": "of_source", "size": "of_size"}).drop("n")
    laned = sized.join(of_length, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))).drop("of_source", "of_size").withColumn("lane", F.pmod("order", "lanes"))
    lane_n = laned.where("extra > 0").groupBy("source", "size", "lane", "extra").agg(F.count("*").alias("lane_n"))
    upto = F.sum("lane_n").over(Window.partitionBy("source", "size").orderBy("lane"))
    border = lane_n.withColumn("upto", upto).where("upto >= extra").groupBy("source", "size").agg(F.min(F.struct("lane", "upto", "lane_n", "extra")).alias("b"))
    border = border.select(F.col("source").alias("of_source"), F.col("size").alias("of_size"), F.col("b.lane").alias("border"), (F.col("b.extra") - F.col("b.upto") + F.col("b.lane_n")).alias("inside"))
    marked = laned.join(border, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size")), "left").drop("of_source", "of_size")
    clear = marked.where("border is null or lane <> border").withColumn("more", F.when(F.col("lane") < F.col("border"), 1).otherwise(0))
    rank = F.row_number().over(Window.partitionBy("source", "size").orderBy("order", key))
    split = marked.where("lane = border").withColumn("rank", rank).withColumn("more", F.when(F.col("rank") <= F.col("inside"), 1).otherwise(0)).drop("rank")
    copies = (F.col("whole") + F.col("more")).cast("int")
    return clear.unionByName(split).select(*kept, "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of `docs` that the mix takes, each as often as it takes them.

    Rows are stored with a number of their own first, so rows of null key and repeated rows
    are each taken as often as planned.
    """
    stored = stash(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")))
    sized = stored.select("row", F.col(f"doc.{key}").alias("key"), F.col(f"doc.{text}").alias("text"), F.col(f"doc.{source}").alias("source"))
    copies = mix(sized, weights, key="key", row="row", **options).where("copies > 0").select("row", "copies")
    taken = stored.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("doc.*")
