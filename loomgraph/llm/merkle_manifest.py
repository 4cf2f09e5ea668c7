"""Merkle manifest of a dataset: digests of all rows, of groups of them, and of the whole.

Leaves are ranked in their group.  A node covers an interval [lo, hi) of leaf ranks; on
level k intervals begin at multiples of arity^k.  The intervals are the labels by which
everything else is found: a node's ancestor one level up is the node of the bucket
lo / arity^(k+1) whose interval contains its own, and its siblings are what the parent's
interval holds beyond its own, to the left and to the right of it.  Containment joins go
down level by level, so each parent meets at most `arity` rows whatever the groups' sizes,
and hands its children the siblings on the way to the root.

Groups are combined in the same way: their roots are the leaves of one more tree.

Ranks come from a range partitioning (`running.numbered`), so no group stands in one task.
Every level is stored in the shared folder; the number of levels grows with the logarithm
of the largest group.

Defined results: an absent (null) group is a group of its own and the first one; null keys
come first in their group, equal keys by digest; repeated rows are leaves each, with
siblings of their own place; empty tables have no rows and no root; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash
from .running import numbered

_NODE = ["group", "lo", "hi", "digest"]


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value in a leaf: `-` if null, else its length in UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _bucketed(nodes: DataFrame, width: int) -> DataFrame:
    return nodes.withColumn("bucket", F.floor(F.col("lo") / F.lit(width)).cast("long"))


def _levels(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Nodes by level, level 0 the leaves (group, lo, hi, digest), above with `children`; and (group, digest, level) of each group's root."""
    levels, tops, k = [leaves.select(*_NODE)], None, 0
    while True:
        child = F.struct("lo", "hi", "digest")
        runs = _bucketed(levels[-1], arity ** (k + 1)).groupBy("group", "bucket").agg(F.array_sort(F.collect_list(child)).alias("children"))  # at most `arity`
        made = runs.select("group", F.col("children")[0]["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), F.sha2(F.array_join("children.digest", ""), 256).alias("digest"), "children")
        made = stash(made.withColumn("alone", (F.col("lo") == 0) & (F.size("children") == 1)))
        top = made.where("alone").select("group", F.col("children")[0]["digest"].alias("digest"), F.lit(k).alias("level"))
        tops = top if tops is None else tops.unionByName(top)
        parents = made.where(~F.col("alone")).drop("alone")
        if parents.isEmpty():
            return levels, tops
        levels.append(parents)
        k += 1


def _attached(nodes: DataFrame, parents: DataFrame, width: int) -> DataFrame:
    """`nodes` with what their parents carry; `path` grows by the siblings to the left and right of each node.

    `parents` have intervals of `width` ranks; the last of a group may have fewer.
    """
    n, p = _bucketed(nodes, width).alias("n"), _bucketed(parents, width).alias("p")
    inside = (F.col("n.group") == F.col("p.group")) & (F.col("n.bucket") == F.col("p.bucket")) & (F.col("p.lo") <= F.col("n.lo")) & (F.col("n.hi") <= F.col("p.hi"))
    beyond = lambda keep: F.array_join(F.transform(F.filter("p.children", keep), lambda c: c["digest"]), "")
    siblings = F.struct(beyond(lambda c: c["hi"] <= F.col("n.lo")).alias("left"), beyond(lambda c: c["lo"] >= F.col("n.hi")).alias("right"))
    return n.join(p, inside).select(*[F.col(f"n.{c}") for c in nodes.columns], F.concat(F.array(siblings), F.col("p.path")).alias("path"), "p.subroot", "p.root")


def _paths(levels: list[DataFrame], tops: DataFrame, leaves: DataFrame, arity: int) -> DataFrame:
    """`leaves` with path, subroot and root; `tops` (group, level, subroot, root, path) of each group is where paths end."""
    known = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k] if k else leaves
        own = nodes.join(tops.where(F.col("level") == k).drop("level"), "group").select(*nodes.columns, "path", "subroot", "root")
        known = own if known is None else own.unionByName(_attached(nodes, known, arity ** (k + 1)))
    return known


def manifest(leaves: DataFrame, arity: int = 16) -> DataFrame:
    """`leaves` (group, key, digest, ...) with subroot, root and path: the siblings from the leaf's level up to the root.

    path: an array of (left, right), the digests beside the node on each level, joined as
    text.  The leaf's column `digest` is what its ancestors are made of.
    """
    named = leaves.withColumn("group", F.coalesce(F.concat(F.lit("s"), F.col("group").cast("string")), F.lit("")))
    ranked = numbered(named, "group", ["key", "digest"], "lo").withColumn("hi", F.col("lo") + 1)
    levels, tops = _levels(ranked, arity)
    # the groups' roots are the leaves of the last tree, in the order of the groups
    roots = numbered(stash(tops).select(F.lit("").alias("group"), F.col("group").alias("of"), "digest", "level"), "group", ["of"], "lo").withColumn("hi", F.col("lo") + 1)
    above, whole = _levels(roots, arity)
    ends = whole.select("group", "level", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    placed = _paths(above, ends, roots, arity)
    tops = stash(placed.select(F.col("of").alias("group"), "level", F.col("digest").alias("subroot"), "root", "path"))
    return _paths(levels, tops, ranked, arity).drop("group", "lo", "hi")


def proof(path: Column) -> Column:
    """SHA-256 of all digests on `path`, level by level, left to right."""
    return F.sha2(F.aggregate(path, F.lit(""), lambda acc, s: F.concat(acc, s["left"], s["right"])), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that `leaf` and the siblings on `path` give."""
    return F.aggregate(path, leaf, lambda acc, s: digest(s["left"], acc, s["right"]))
