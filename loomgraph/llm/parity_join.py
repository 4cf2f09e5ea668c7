"""N-gram Jaccard join by parity sketches.

A document is its set of word shingles.  Two documents of sizes m and n link at similarity
t when they share at least t of their union, so that they differ in at most
(m + n) (1 - t) / (1 + t) shingles.

Every shingle flips one bit of a sketch of 2^52 bits, so the Hamming distance of two
sketches is at most the number of shingles in which the sets differ.  In a band of sizes
all sketches are cut into equally many segments, about one for two shingles of the largest
sets.  A shingle in which two sets differ changes one segment, so of the segments that a set
fills all but d agree with those of a set that differs in d shingles (pigeonhole): the
first d + 1 filled segments, in an order common to all, must meet those of the other set.
A join key is a segment's place and the XOR of the hashes of its set bits.  Sets whose shingles
crowd into d segments or fewer give all of them, which meets every set that is not crowded;
crowded ones meet each other by segments of one shingle each.  Bands span a factor of
four; sets near a border also join in a band around it.

The common order puts segments last that hold only shingles shared by documents that are
read together in a task, marked in a bitmap of bounded size.  That keeps passages that many
documents share out of the keys.  It is an order only: what the bitmap has or lacks changes
the work, never the links.

Keys with the same members count as one.  Each document is first compared with one other,
the one that it shares most keys with.  Where members of a key are then still in different
components, they meet in blocks of bounded size: a second sketch, of four to eight bits for
each shingle, tells which pairs may link.  Of those, as many are compared as would join all;
where some do not link after all, the sets of the documents left meet in their blocks.
A block never gives more pairs than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_in, stash, tidy, without
from .components import components
from .textnum import HASH_BITS, mix, set_digests, shingle_sets, slices

_GROWTH = 4


def _marked(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; `bitmap` has a power of two of bits."""
    p = h & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _load(t: tuple[int, int]) -> float:
    """Shingles for a segment, in the largest sets of a band: as many as leave enough segments filled."""
    num, den = t
    load = 2.0
    while load > 0.25 and (1 - np.exp(-load)) / load < 1.25 * (den - num) / num:
        load /= 2
    return load


def _first(sets: np.ndarray, common: np.ndarray, n: int, most: np.ndarray) -> np.ndarray:
    """Which tokens come first in their set: `most` of each, common ones last.  `sets`: the set of each token, ascending."""
    filled = np.bincount(sets, minlength=n)
    begin = np.cumsum(filled) - filled
    rare = np.cumsum(~common)
    rare_before = np.concatenate([[0], rare])[begin[sets]]
    seen = rare - rare_before  # rare tokens of this set so far, this one included
    rares = np.bincount(sets, weights=~common, minlength=n).astype(np.int64)
    rank = np.where(common, rares[sets] + np.arange(len(sets)) - begin[sets] - seen, seen - 1)
    return rank < most[sets]


def _keys(h: np.ndarray, per: np.ndarray, hot: np.ndarray, t: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of set, join key, whether common) of all sets; hot: bitmap of common shingles; t: the similarity as a fraction."""
    num, den = t
    marked = _marked(hot, h)
    ends = np.cumsum(per)
    load = _load(t)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool))]
    some = per * (den - num) >= num  # smaller sets link with equal ones only, and those are one already
    top = int(per.max(initial=0))
    low, band = 1, 0
    while low <= top:
        high = low * _GROWTH
        # inside [low, high); around `high`: sizes that have a partner on its other side
        around = (per >= -(-high * num // den)) & (per < -(-high * den // num))
        upto = np.minimum(per * den // num, high - 1)
        beyond = np.where(per < high, per * den // num, high - 1)
        for kind, members, partner, most in ((0, (per >= low) & (per < high), upto, high), (1, around, beyond, -(-high * den // num))):
            chosen = np.flatnonzero(members & some)
            if not len(chosen):
                continue
            size = per[chosen]
            n = len(chosen)
            need = (size + partner[chosen]) * (den - num) // (den + num) + 1
            bits = max(1, int(np.ceil(np.log2(most / load))))
            begin = np.cumsum(size) - size
            at = np.arange(int(size.sum())) + np.repeat(ends[chosen] - size - begin, size)
            hh, cc, tt = h[at], marked[at], np.repeat(np.arange(n), size)
            segment = hh >> np.uint64(HASH_BITS - bits)  # hashes are sorted within a set, and so are the segments
            new = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (tt[1:] != tt[:-1])]))
            token, where, common = np.bitwise_xor.reduceat(hh, new), tt[new], np.logical_and.reduceat(cc, new)
            keep = _first(where, common, n, need)
            salt = np.uint64(((4 * band + 2 * kind + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
            out.append((chosen[where[keep]], mix(mix(token[keep]) ^ mix(segment[new][keep] + salt)), common[keep]))
            crowded = np.bincount(where, minlength=n) < need
            if crowded.any():
                use = crowded[tt]
                hh, cc, tt = hh[use], cc[use], tt[use]
                keep = _first(tt, cc, n, need)
                salt += np.uint64(1)
                out.append((chosen[tt[keep]], mix(mix(hh[keep]) + salt), cc[keep]))
        low, band = high, band + 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bits(n: np.ndarray) -> np.ndarray:
    """Bits of the second sketch of a set of each size: a power of two, four to eight for each shingle, at least eight bytes."""
    return np.left_shift(4, np.ceil(np.log2(np.maximum(n, 16))).astype(np.int64))


def _read(docs: DataFrame, key: str, text: str, width: int, held: int = 1 << 21) -> DataFrame:
    """(id, n, digest, sketch, h, c) of two kinds: a row for each of `docs`, and (h, c) for the
    shingles that c documents were seen to share.

    sketch: the parity of the shingles at each bit.  A task counts what it holds of about
    `held` shingles at a time and passes on only those seen twice, so next to nothing is
    shuffled; a passage of many documents is seen in some task, one of few costs little
    where it is missed.
    """
    names = ["id", "n", "digest", "sketch", "h", "c"]
    none = lambda n, kind: pa.nulls(n, kind)

    def shared(parts: list[np.ndarray]) -> pa.RecordBatch:
        h = np.concatenate(parts)
        h.sort()
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        c = np.diff(edge)
        h, c = h[edge[:-1]][c > 1], c[c > 1]
        return pa.RecordBatch.from_arrays([none(len(h), pa.int64()), none(len(h), pa.int64()), none(len(h), pa.binary()), none(len(h), pa.binary()), pa.array(h.view(np.int64)), pa.array(c, pa.int64())], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for lo, rows in slices(batch.column(1)):
                h, per = shingle_sets(batch.column(1).slice(lo, rows), width)
                digest = set_digests(h, per)
                bits = _bits(per)
                begin = np.cumsum(bits) - bits
                place = np.repeat(begin, per) + (h & np.repeat(bits - 1, per).astype(np.uint64)).astype(np.int64)
                sketch = np.packbits(np.bincount(place, minlength=int(bits.sum())) & 1, bitorder="little").tobytes()
                sketches = [sketch[x // 8 : y // 8] for x, y in zip(begin.tolist(), (begin + bits).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), pa.array(per, pa.int64()), pa.array([x.tobytes() for x in digest], pa.binary()), pa.array(sketches, pa.binary()), none(rows, pa.int64()), none(rows, pa.int64())], names=names)
                parts.append(h)
                size += len(h)
                if size > held:
                    yield shared(parts)
                    parts, size = [], 0
        if size:
            yield shared(parts)

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text)).mapInArrow(tidy(read), "id long, n long, digest binary, sketch binary, h long, c long")


def _bitmap(seen: DataFrame, often: int, bits: int) -> np.ndarray:
    """Bitmap of 2^`bits` bits of the shingles that at least `often` documents are seen to share (h, c)."""
    kept = seen.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= often)
    # rows of 2^15 bits each; as many as the bitmap has, however many shingles there are
    p = kept.select(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).alias("p")).select(F.shiftright("p", 15).alias("row"), (F.col("p").bitwiseAND(F.lit((1 << 15) - 1)) + 1).alias("bit"))
    rows = p.groupBy("row").agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        bitmap[r["row"] * 4096 : (r["row"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bitmap


def _buckets(docs: DataFrame, key: str, text: str, width: int, t: tuple[int, int], hot: np.ndarray, salts: int = 32) -> DataFrame:
    """(sig, id): the keys of `docs`, less most of those that one document has alone.

    Tasks drop keys without a second document; common keys, which very many may have, are
    dealt to `salts` tasks and kept.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()  # sets that this task has emitted: copies need not meet again
        for batch in batches:
            for lo, n in slices(batch.column(1)):
                h, per = shingle_sets(batch.column(1).slice(lo, n), width)
                first = np.zeros(n, bool)
                for i, (x, y) in enumerate(set_digests(h, per).tolist()):
                    if (digest := x << 64 | y) not in known:
                        first[i] = True
                        known.add(digest)
                if len(known) > 1 << 18:
                    known.clear()
                where, sig, common = _keys(h[np.repeat(first, per)], np.where(first, per, 0), hot, t)
                ids = batch.column(0).slice(lo, n).to_numpy(zero_copy_only=False)[where]
                salt = np.where(common, mix(ids.astype(np.uint64)) % np.uint64(salts) + np.uint64(1), np.uint64(0))
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(ids, pa.int64()), pa.array(salt.astype(np.int8))], names=["sig", "id", "salt"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row of a batch waits for the next, as its key may go on
        last, held = None, np.empty((3, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])], axis=1)
            if not rows.shape[1]:
                continue
            again = np.concatenate([[False], (rows[:, 1:] == rows[:, :-1]).all(axis=0)])
            rows = rows[:, ~again]
            same = rows[0, 1:] == rows[0, :-1]
            keep = np.concatenate([[last is not None and last == int(rows[0, 0])], same]) | np.concatenate([same, [False]]) | (rows[2] > 0)
            last = int(rows[0, -2]) if rows.shape[1] > 1 else last
            held = rows[:, -1:]
            yield pa.RecordBatch.from_arrays([pa.array(rows[i, :-1][keep[:-1]]) for i in (0, 1)], names=["sig", "id"])
        if held.shape[1]:
            keep = (held[2] > 0) | np.array([last is not None and last == int(held[0, 0])])
            yield pa.RecordBatch.from_arrays([pa.array(held[i][keep]) for i in (0, 1)], names=["sig", "id"])

    keyed = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text)).mapInArrow(tidy(emit), "sig long, id long, salt byte")
    return keyed.repartition("sig", "salt").sortWithinPartitions("sig", "salt", "id").mapInArrow(tidy(walk), "sig long, id long")


def _groups(buckets: DataFrame) -> DataFrame:
    """(sig, hub, id, keys) of the keys that at least two ids have, one for each set of members;
    hub: the smallest of them, keys: how many keys have these members."""
    members = stash(buckets.distinct())
    of = members.groupBy("sig").agg(F.count("*").alias("size"), F.min("id").alias("hub"), F.max("id").alias("upto"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(5))).alias("y")).where("hub < upto")
    one = of.groupBy("size", "hub", "upto", "x", "y").agg(F.min("sig").alias("sig"), F.count("*").alias("keys"))
    return members.join(one.select("sig", "hub", "keys"), "sig").select("sig", "hub", "id", "keys")


def _near(pairs: DataFrame, sketches: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Those of `pairs` (a, b) whose sizes and second sketches allow a link."""
    num, den = t
    of = lambda x: sketches.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    met = met.where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num).select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * (den - num) // (den + num)
            keep = [_distance(x, y) <= d for d, x, y in zip(most.tolist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(tidy(sift), "a long, b long")


def _folded(sketch: bytes, size: int) -> int:
    """The sketch of the same set with `size` bytes."""
    v, n = int.from_bytes(sketch, "little"), len(sketch)
    while n > size:
        n //= 2
        v = (v >> (8 * n)) ^ (v & ((1 << (8 * n)) - 1))
    return v


def _distance(x: bytes, y: bytes) -> int:
    size = min(len(x), len(y))
    return (_folded(x, size) ^ _folded(y, size)).bit_count()


def _sets(docs: DataFrame, ids: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, set): sorted shingle hashes of the documents that `ids` (id) names.

    Of several texts of one id the one of least bytes of hashes counts.
    """
    some = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    some = maybe_in(some, F.col("id"), ids).where("__maybe").select("id", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n in slices(batch.column(1)):
                h, per = shingle_sets(batch.column(1).slice(lo, n), width)
                offsets = np.concatenate([[0], np.cumsum(per * 8)]).astype(np.int32)
                sets = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(h.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), sets], names=["id", "set"])

    return some.mapInArrow(tidy(read), "id long, set binary").join(ids.distinct(), "id").groupBy("id").agg(F.min("set").alias("set"))


def _shared_by(x: np.ndarray, y: np.ndarray) -> int:
    """Elements that two sorted arrays without repeats have in common."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0


def _linked(x: np.ndarray, y: np.ndarray, t: tuple[int, int]) -> bool:
    both = _shared_by(x, y)
    return t[1] * both >= t[0] * (len(x) + len(y) - both) > 0


def _verified(pairs: DataFrame, sets: DataFrame, t: tuple[int, int], group: int = 256) -> DataFrame:
    """The pairs (a, b) whose sets (id, set) link.

    Each `a` meets its partners in groups of about `group`; a task keeps one set at a time.
    """
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(group)).cast("int").alias("groups"))
    dealt = pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g"))
    roles = dealt.select(F.col("b").alias("id"), "a", "g", F.lit(1).alias("role"))
    heads = size.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(0).alias("role"))
    met = roles.unionByName(heads).join(sets, "id").repartition("a", "g").sortWithinPartitions("a", "g", "role", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for i, a, role, own in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3)), strict=True):
                own = np.frombuffer(own, np.uint64)
                if role == 0:
                    head = own
                elif _linked(head, own, t):
                    found.append((a, i))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return met.select("id", "a", "role", "set").mapInArrow(tidy(compare), "a long, b long")


def _candidates(n: np.ndarray, root: np.ndarray, own: np.ndarray, sketch: list[bytes], t: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of a block, or of two blocks, whose roots differ and whose sizes and sketches allow a link."""
    num, den = t
    size = np.array([len(x) for x in sketch])
    cross = bool((own != own[0]).any())  # two blocks: only pairs between them, each block has met itself
    for la in np.unique(size).tolist():
        for lb in (la, 2 * la):
            xa, xb = np.flatnonzero(size == la), np.flatnonzero(size == lb)
            if not len(xb) or (la == lb and len(xa) < 2):
                continue
            ma = np.frombuffer(b"".join(sketch[i] for i in xa), np.uint64).reshape(len(xa), -1)
            mb = np.frombuffer(b"".join(sketch[i] for i in xb), np.uint64).reshape(len(xb), -1)
            if lb > la:
                half = mb.shape[1] // 2
                mb = mb[:, :half] ^ mb[:, half:]
            some = max(1, (1 << 21) // max(1, mb.size))
            for lo in range(0, len(xa), some):
                part = xa[lo : lo + some]
                i, j = part[:, None], xb[None, :]
                near = (root[i] != root[j]) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)
                if la == lb:
                    near &= i < j
                if cross:
                    near &= own[i] != own[j]
                if near.any():
                    apart = np.bitwise_count(ma[lo : lo + some, None, :] ^ mb[None, :, :]).sum(axis=2, dtype=np.int64)
                    x, y = np.nonzero(near & (apart <= (n[i] + n[j]) * (den - num) // (den + num)))
                    yield part[x], xb[y]


def _by_block(keys: int, work, names: list[str]):
    """A function for mapInArrow over rows sorted by their first `keys` columns: `work` on each block of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple[int, ...] | None = None
        done = lambda: pa.RecordBatch.from_pydict(dict(zip(names, work(pa.Table.from_batches(held).combine_chunks()), strict=True)))
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(keys)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                now = tuple(int(c[lo]) for c in cols)
                if last is not None and now != last:
                    yield done()
                    held.clear()
                last = now
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield done()

    return run


def _sifted(groups: DataFrame, label: DataFrame, sketches: DataFrame, t: tuple[int, int], block: int = 1024) -> DataFrame:
    """(sig, i, j, own, id, root, n, sketch) of the members of a key that may link with one in another component (`label`: id, root).

    The members of a key meet in blocks of about `block`, two blocks (i, j) in a task at a time.
    """
    named = groups.join(label, "id").select("sig", "id", "root")
    open_ = named.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")).where("lo < hi")
    full = named.join(open_.select("sig", "blocks"), "sig").withColumn("own", F.pmod(F.xxhash64("id", F.lit(31)), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = full.join(sketches, "id").withColumn("other", other).select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "root", "n", "sketch")

    def sift(rows: pa.Table) -> list[pa.Array]:
        own, root, n = (rows.column(i).to_numpy() for i in (3, 5, 6))
        hit = np.zeros(len(rows), bool)
        for x, y in _candidates(n, root, own, rows.column(7).to_pylist(), t):
            hit[x] = hit[y] = True
        return [c.combine_chunks() for c in rows.filter(pa.array(hit)).columns]

    met = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "id")
    return met.mapInArrow(tidy(_by_block(3, sift, dealt.columns)), "sig long, i int, j int, own int, id long, root long, n long, sketch binary")


def _spanning(blocks: DataFrame, t: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) that join all components that may link within each of `blocks`, as `_sifted` gives them.

    With a column `set` only pairs that do link count, else all that the sketches allow.
    """

    def join(rows: pa.Table) -> list[pa.Array]:
        own, ids, root, n = (rows.column(i).to_numpy() for i in (3, 4, 5, 6))
        sets = [np.frombuffer(x, np.uint64) for x in rows.column(8).to_pylist()] if rows.num_columns > 8 else None
        head = {r: r for r in root.tolist()}

        def top(r: int) -> int:
            while head[r] != r:
                head[r] = r = head[head[r]]
            return r

        near = list(_candidates(n, root, own, rows.column(7).to_pylist(), t))
        x, y = (np.concatenate([p[i] for p in near]) if near else np.empty(0, np.int64) for i in (0, 1))
        x, y = np.minimum(x, y), np.maximum(x, y)  # rows are sorted by id, so blocks agree on the pairs to try first
        found = []
        for i in np.lexsort((y, x)).tolist():
            u, v = int(x[i]), int(y[i])
            a, b = top(int(root[u])), top(int(root[v]))
            if a != b and (sets is None or _linked(sets[u], sets[v], t)):
                head[a] = b
                found.append((int(ids[u]), int(ids[v])))
        return [pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)]

    met = blocks.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "id")
    return met.mapInArrow(tidy(_by_block(3, join, ["a", "b"])), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: tuple[int, int] = (3, 4), often: int = 3, order_bits: int = 25) -> DataFrame:
    """(key, n_shingles, component_id) of every row of `docs`.

    Two documents link when their sets of `width`-word shingles share at least `similarity`
    (a fraction above 1/2) of their union; component_id is the smallest key reachable by
    links.  `often` and `order_bits` bound the bitmap that orders join keys (see the
    module); they have no effect on results.

    Defined results: a null text, or one without words, has no shingles and links with
    nothing, nor does any row of a null key (its component is null); fewer words than
    `width` make one shingle; repeated rows of one key each get the key's component, and of
    different texts of one key the one of fewest shingles counts for links (then that of
    lowest digest); other columns are ignored, whatever their names.
    """
    num, den = similarity
    if not 0 < num <= den < 2 * num:
        raise ValueError("similarity must be above 1/2, and 1 at most")
    found = stash(_read(docs, key, text, width))
    members = found.where("n is not null").select("id", "n", "digest", "sketch")
    counted = members.where("n > 0 and id is not null").groupBy("id").agg(F.min(F.struct("n", "digest", "sketch")).alias("m")).select("id", "m.*")
    reps = stash(counted.groupBy("n", "digest").agg(F.min("id").alias("rep"), F.min("sketch").alias("sketch")))
    sketches = reps.select(F.col("rep").alias("id"), "n", "sketch")
    of = stash(counted.drop("sketch").join(reps.select("n", "digest", "rep"), ["n", "digest"]).select("id", "rep"))
    hot = _bitmap(found.where("n is null").select("h", "c"), often, order_bits)
    # by representative: keys held by copies of one set alone drop out
    groups = stash(_groups(_buckets(docs, key, text, width, similarity, hot).join(of, "id").select("sig", F.col("rep").alias("id"))))

    own = of.select(F.col("rep").alias("id")).distinct()
    label = lambda links: stash(own.join(components(links).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root")))
    # each member with the one hub that it shares most keys with
    shared = groups.where("hub <> id").groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.sum("keys").alias("keys"))
    chosen = shared.groupBy("b").agg(F.max_by("a", F.struct("keys", -F.col("a"))).alias("a")).select("a", "b")
    pairs = stash(_near(chosen, sketches, similarity))
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    links = stash(_verified(pairs, stash(_sets(docs, ids, key, text, width)), similarity))
    roots = label(links)
    # whatever is still apart: first the pairs that would do if all that may link did, then all others
    left = stash(_sifted(groups, roots, sketches, similarity))
    sets = stash(_sets(docs, left.select("id").distinct(), key, text, width))
    more = stash(_verified(_spanning(left, similarity), sets, similarity))
    # labels are made anew only for new links: each time takes dozens of jobs, which the driver has to hold
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = label(links)
        left = left.drop("root").join(roots, "id").select(*left.columns)
    open_ = left.groupBy("sig", "i", "j").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("sig", "i", "j")
    rest = left.join(open_, ["sig", "i", "j"]).join(sets, "id").select(*left.columns, "set")
    more = stash(_spanning(rest, similarity))
    if not more.isEmpty():
        roots = label(links.unionByName(more))
    named = of.join(roots.withColumnRenamed("id", "rep"), "rep").select("id", F.col("root").alias("component_id"))
    return members.select("id", "n").join(named, "id", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` without the near duplicates of others: of each component the smallest key stays."""
    found = near_duplicates(docs, key, text, **options)
    return without(docs, key, stash(found.where(F.col("component_id") != F.col(key)).select(key)))
