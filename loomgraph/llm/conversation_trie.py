"""Prefix trie of conversations, with subtree totals by time-forward processing.

A conversation is a sequence of turns (role, text); every distinct sequence of its first d
turns is a node of depth d, from the root of depth 0 that all share.  A node is told by
its depth and by the XOR of two 63-bit digests of each turn and its place, so the key of a
prefix is a running total and no conversation stands in one task.  The node carries the
smallest conversation that begins with it: (conv_id, depth) names it, and the nodes of one
conv_id form a chain that hangs on a node of a smaller conv_id.

Subtree totals go bottom up.  Nodes are dealt to shards, each a block of conversation ids
and depths, and sorted by reverse level order, deepest first.  One pass over a shard sends
each node's totals to its parent through a priority queue that is ordered like the nodes
and spills to disk; a parent finds its messages at the head of the queue when its turn
comes.  What shard roots send to parents in other shards is summed by parent and goes out
in rounds: in each, the shards with mail pass what is new up to their own roots.  There
are as many rounds as a path changes shards.  Every node is one row however many
conversations share it, so hot prefixes make no shard large.

Defined results: rows of null conversation id belong to no conversation and are left out;
turns of a conversation come by turn, null first, then by role and text, so repeated rows
are turns each; null roles and texts count as empty; an empty table has no nodes, not even
the root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, stash, tidy
from .running import numbered, running

_KEY = ["depth", "x", "y"]


class SpillingQueue:
    """A priority queue of tuples that holds at most about `held` in memory; the rest waits in sorted runs on disk."""

    def __init__(self, held: int = 1 << 16):
        self.most, self.heap, self.runs, self.heads = held, [], [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            run = tempfile.TemporaryFile()  # noqa: SIM115  has no name, so it goes with the task
            for x in sorted(self.heap):
                pickle.dump(x, run)
            run.seek(0)
            self.heap = []
            self.runs.append(run)
            self._next(len(self.runs) - 1)

    def _next(self, i: int) -> None:
        try:
            heapq.heappush(self.heads, (pickle.load(self.runs[i]), i))
        except EOFError:
            self.runs[i].close()

    def peek(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, i = heapq.heappop(self.heads)
            self._next(i)
            return item
        return heapq.heappop(self.heap)


def _turn_digest(seed: int):
    """63 bits of a digest of a turn's place, role and text."""
    whole = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), F.octet_length("role").cast("string"), F.col("role"), F.col("text")), 256)
    return F.conv(F.substring(whole, 1 + 16 * seed, 15), 16, 10).cast("long")


def ordered_turns(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, role, text): the turns of every conversation, numbered from 1."""
    rows = conversations.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return numbered(rows, "conv_id", ["turn", "role", "text"], "depth").select("conv_id", (F.col("depth") + 1).alias("depth"), "role", "text")


def spliced(turns: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with shared beginnings: (conv_id, length) and (conv_id, depth, role, text).

    Conversation c takes the first h turns of conversation c - c % block (all, if it has
    fewer; none, if there is no such one), h being CRC-32 of c's digits modulo `most`, and
    goes on with its own turns after the first h.  `turns` as `ordered_turns` gives them.
    """
    have = turns.groupBy("conv_id").agg(F.max("depth").alias("have"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(most)).cast("long")
    heads = have.select(F.col("conv_id").alias("of"), F.least("have", F.lit(most - 1).cast("long")).alias("offered"))
    plan = have.select("conv_id", "have", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % F.lit(block)).alias("of"))
    plan = plan.join(heads, "of", "left").select("conv_id", "of", "h", F.least("h", F.coalesce("offered", F.lit(0))).alias("taken"), F.greatest(F.col("have") - F.col("h"), F.lit(0)).alias("own"))
    plan = stash(plan)
    # a head serves at most 2 * block conversations, with fewer than `most` turns
    first = turns.where(F.col("depth") < most).withColumnRenamed("conv_id", "of").join(plan, "of").where(F.col("depth") <= F.col("taken"))
    shift = plan.select("conv_id", "h", "taken")
    rest = turns.join(shift, "conv_id").where(F.col("depth") > F.col("h")).withColumn("depth", F.col("depth") - F.col("h") + F.col("taken"))
    cols = ["conv_id", "depth", "role", "text"]
    return plan.select("conv_id", (F.col("taken") + F.col("own")).alias("length")), first.select(*cols).unionByName(rest.select(*cols))


def prefixes(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, x, y, px, py, words, ends): every prefix of every conversation by the key of its node and of the parent's.

    words: of the last turn's text; ends: 1 where the conversation has no more turns.
    """
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    rows = turns.select("conv_id", "depth", _turn_digest(0).alias("x"), _turn_digest(1).alias("y"), words.alias("words"))
    summed = running(rows, "conv_id", ["depth"], ["x", "y"], "xor")
    inner = summed.select("conv_id", "depth", F.col("run_x").alias("x"), F.col("run_y").alias("y"), F.col("run_x").bitwiseXOR(F.col("x")).alias("px"), F.col("run_y").bitwiseXOR(F.col("y")).alias("py"), "words")
    zero = F.lit(0).cast("long")
    root = lengths.select("conv_id", *[zero.alias(c) for c in ("depth", "x", "y", "px", "py", "words")])
    with_length = inner.join(lengths, "conv_id").unionByName(root.join(lengths, "conv_id"))
    return with_length.select("conv_id", "depth", "x", "y", "px", "py", "words", (F.col("depth") == F.col("length")).cast("long").alias("ends"))


def _nodes(rows: DataFrame, heavy: int = 1024, salts: int = 32) -> DataFrame:
    """(conv_id, parent, depth, x, y, n_convs, leaf, saved) of each node; parent: conv_id of the parent node, null at the root."""
    made = rows.groupBy(*_KEY, "px", "py").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.sum("ends").alias("ends"))
    made = stash(made.withColumn("leaf", (F.col("ends") == F.col("n_convs")).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))
    # a parent has no more children than conversations: those with many meet their children in several tasks
    above = made.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent"), "n_convs")
    many = above.where(F.col("n_convs") > heavy).drop("n_convs").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    few = above.where(F.col("n_convs") <= heavy).drop("n_convs").withColumnRenamed("parent", "other")
    at = ["depth", "px", "py"]
    first = stash(made.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(salts)).cast("int")).join(many, [*at, "salt"], "left").drop("salt"))
    rest = first.where("parent is null").join(few, at, "left").withColumn("parent", F.col("other")).select(*first.columns)
    return first.where("parent is not null").unionByName(rest).select("conv_id", "parent", "depth", "x", "y", "n_convs", "leaf", "saved")


def _time_forward(held: int):
    """For mapInArrow over rows (shard, depth, conv_id, mail, parent, inside, children, leaves, saved), sorted by shard, reverse depth, id, mail first.

    Gives (conv_id, depth, to, children, leaves, saved): what is new of each node's totals (`to`
    null), and what shard roots send to the parent `to` in another shard.  `inside`: whether
    the parent is in the same shard.  Children of a node's own row count once, by its `mail`.
    """
    names = ["conv_id", "depth", "to", "children", "leaves", "saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard = SpillingQueue(held), None
        mailed = (0, 0, 0)
        for batch in batches:
            out: list[tuple] = []
            for now, depth, conv, mail, parent, inside, children, leaves, saved in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != shard:
                    shard, mailed = now, (0, 0, 0)
                if mail:
                    mailed = (children, leaves, saved)
                    continue
                counts = children  # 1 in the round in which a node is first seen
                children, leaves, saved = mailed[0], leaves + mailed[1], saved + mailed[2]
                mailed = (0, 0, 0)
                while (head := queue.peek()) and head[:2] == (-depth, conv):
                    _, _, c, le, s = queue.pop()
                    children, leaves, saved = children + c, leaves + le, saved + s
                if counts or children or leaves or saved:
                    out.append((conv, depth, None, children, leaves, saved))
                    if parent is not None and (counts or leaves or saved):
                        if inside:
                            queue.push((1 - depth, parent, counts, leaves, saved))
                        else:
                            out.append((parent, depth - 1, parent, counts, leaves, saved))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(6)], names=names)

    return run


def subtree_totals(nodes: DataFrame, block: int = 1 << 10, band: int = 1 << 12, held: int = 1 << 16) -> DataFrame:
    """(conv_id, depth, n_children, n_leaves, saved_tokens) of each of `nodes` (conv_id, parent, depth, leaf, saved).

    Shards are `block` conversation ids by `band` depths; a queue holds `held` messages in memory.
    """
    shard = lambda conv, depth: F.struct(F.floor(conv / block).cast("long").alias("b"), F.floor(depth / band).cast("long").alias("d"))
    one = lambda conv, depth: F.xxhash64(shard(conv, depth))
    n = lambda v: F.lit(v).cast("long")
    own = stash(nodes.select(one(F.col("conv_id"), F.col("depth")).alias("shard"), "depth", "conv_id", F.lit(False).alias("mail"), "parent", (shard(F.col("parent"), F.col("depth") - 1) == shard(F.col("conv_id"), F.col("depth"))).alias("inside"), n(1).alias("children"), F.col("leaf").alias("leaves"), "saved"))
    again = own.withColumn("children", n(0)).withColumn("leaves", n(0)).withColumn("saved", n(0))
    rows, parts = own, []
    while True:
        dealt = rows.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "conv_id", F.desc("mail"))
        passed = stash(dealt.mapInArrow(tidy(_time_forward(held)), "conv_id long, depth long, to long, children long, leaves long, saved long"))
        parts.append(passed.where("to is null").drop("to"))
        sent = stash(passed.where("to is not null").groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")]))
        if sent.isEmpty():
            break
        mail = sent.select(one(F.col("conv_id"), F.col("depth")).alias("shard"), "depth", "conv_id", F.lit(True).alias("mail"), n(None).alias("parent"), F.lit(None).cast("boolean").alias("inside"), "children", "leaves", "saved")
        rows = again.join(mail.select("shard").distinct(), "shard", "left_semi").unionByName(mail)
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy("conv_id", "depth").agg(F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _joined_ids(most: int = 1 << 16):
    """For mapInArrow over rows (depth, x, y, conv_id, part) sorted by all: the ids of each node joined by commas, in pieces of about `most` characters."""
    names = ["depth", "x", "y", "part", "piece", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size, piece, part = None, [], 0, 0, 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal ids, size, piece
            if ids:
                out.append((*node, part, piece, ",".join(ids)))
                ids, size, piece = [], 0, piece + 1

        def batch_of() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i < 5 else pa.string()) for i in range(6)], names=names)
            out.clear()
            return done

        for batch in batches:
            for depth, x, y, conv, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, x, y) != node:
                    close()
                    node, piece = (depth, x, y), 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
                if size > most:
                    close()
            yield batch_of()
        close()
        yield batch_of()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, x, y, sha256) from pieces (depth, x, y, part, piece, ids) sorted by all."""
    import hashlib

    node, state = None, None
    for batch in batches:
        out = []
        for depth, x, y, _, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (depth, x, y) != node:
                if state:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, x, y), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i < 3 else pa.string()) for i in range(4)], names=["depth", "x", "y", "sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in node] + [pa.array([state.hexdigest()])], names=["depth", "x", "y", "sha256"])


def end_digests(rows: DataFrame) -> DataFrame:
    """(depth, x, y, sha256): SHA-256 of the ids of the conversations that end at a node, ascending, joined by commas.

    Ids are joined where a range of them stands; only the joined pieces of a node meet.
    """
    ends = rows.where("ends = 1").select(*_KEY, "conv_id")
    dealt = ends.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id").withColumn("part", F.spark_partition_id().cast("long"))
    pieces = dealt.mapInArrow(tidy(_joined_ids()), "depth long, x long, y long, part long, piece long, ids string")
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "part", "piece").mapInArrow(tidy(_hashed), "depth long, x long, y long, sha256 string")


def prefix_trie(lengths: DataFrame, turns: DataFrame, **options) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `lengths` (conv_id, length) names all conversations, `turns` (conv_id, depth, role, text)
    their turns from 1 to length.  saved_tokens: words that sharing the subtree's nodes saves.
    """
    rows = stash(prefixes(lengths, turns))
    nodes = stash(_nodes(rows))
    totals = subtree_totals(nodes, **options)
    named = nodes.join(totals, ["conv_id", "depth"]).join(end_digests(rows), _KEY, "left")
    return named.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
