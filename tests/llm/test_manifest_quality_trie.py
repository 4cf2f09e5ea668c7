"""Merkle manifest, quality by multiple instances, conversation trie: brute force, planted cases, awkward input."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF
from loomgraph.llm import conversation_trie, merkle_manifest, quality_mil, running
from loomgraph.llm.queries import QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long, group string, key long, lo long, digest string, y int, depth long"
TURN = "conv_id long, turn long, role string, text string, depth long, x long, parent string, shard long"


@pytest.fixture(params=[(1, True), (8, False), (64, False)], ids=["1", "8-plain", "64-plain"])
def dealt(spark, request):
    """The session with other numbers of partitions, adaptive execution off in two."""
    n, adaptive = request.param
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.enabled", str(adaptive).lower())
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ------------------------------------------------------------------ running totals


@pytest.mark.parametrize("how", ["add", "xor"])
def test_running_totals_of_a_hot_group(dealt, how):
    rng = random.Random(3)
    rows = [(rng.choice("aaaaabcd"), i, rng.randrange(-(1 << 40), 1 << 40)) for i in range(400)]
    df = dealt.createDataFrame(rows, "g string, i long, v long").repartition(7)
    got = {(r["g"], r["i"]): r["run_v"] for r in running.running(df, "g", ["i"], ["v"], how).collect()}
    want, total = {}, defaultdict(int)
    for g, i, v in sorted(rows):
        total[g] = total[g] + v if how == "add" else total[g] ^ v
        want[g, i] = total[g]
    assert got == want
    ranks = running.numbered(df, "g", ["i"]).collect()
    assert all(sum(1 for g, i, _ in rows if g == r["g"] and i < r["i"]) == r["rank"] for r in ranks)


# ------------------------------------------------------------------ 11


def tree(digests):
    """Levels of the 16-ary tree over digests."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def steps(levels, i):
    for level in levels[:-1]:
        lo = i // 16 * 16
        yield "".join(level[lo:i]), "".join(level[i + 1 : lo + 16])
        i //= 16


def manifest_of(docs):
    """Brute force of op11 over (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = defaultdict(list)
    for r in docs:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = [*steps(trees[s], i), *steps(top, j)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = leaf((*r[:4], lower(r[4]))) if changed else leaf(r)
            for left, right in path:
                fold = sha(left, fold, right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha(*(x + y for x, y in path)), fold, fold == top[-1][0]))
    return sorted(map(repr, out))


def run_op11(spark, docs, folder):
    spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "x", 3, 1, "y", 0, 2) for r in docs], DOC).write.parquet(f"{folder}/documents.parquet")
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(repr(tuple(r)) for r in QUERIES["op11_merkle_manifest"](spark, str(folder)).select(*cols).collect())


def test_manifest_is_that_of_brute_force(dealt, tmp_path):
    """A hot source of 300 rows, 40 sources (two levels above them), a lone row, nulls in every column, repeated rows and keys, empty and long texts."""
    rng = random.Random(11)
    docs = [(i, "hot", "en", i, rng.choice(["Some Text", "plain", "", None, "ÄÖ Ünï"])) for i in range(300)]
    docs += [(1000 + i, f"s{i % 40}", None, None, "Title") for i in range(90)]
    docs += [(7, None, "de", 5, "Null Source"), (None, None, None, None, None), (None, "hot", "x", 1, "A"), (12, "hot", "en", 12, "Other text of one key"), (5000, "", "en", 1, "Long " * 30_000), (5001, "é", "en", 1, "lone")]
    docs += [docs[3]] * 40 + [(None, "hot", "x", 1, "A")]
    assert run_op11(dealt, docs, tmp_path) == manifest_of(docs)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 273])
def test_sizes_at_the_borders_of_levels(spark, tmp_path, n):
    docs = [(i, "one", "en", 1, f"Text {i}") for i in range(n)]
    got = run_op11(spark, docs, tmp_path)
    assert got == manifest_of(docs)
    assert sum("False" in r for r in got) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(n))


def test_manifest_of_nothing(spark, tmp_path):
    assert run_op11(spark, [], tmp_path) == []


def test_siblings_are_what_the_parent_covers_beyond_the_node(spark):
    leaves = spark.createDataFrame([("g", i, chr(97 + i)) for i in range(5)], "group string, key long, digest string")
    found = {r["key"]: [(s["left"], s["right"]) for s in r["path"]] for r in merkle_manifest.manifest(leaves, arity=2).collect()}
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ab, cd, e1 = h("ab"), h("cd"), h("e")
    assert found[2] == [("", "d"), (ab, ""), ("", h(e1))]
    assert found[4] == [("", ""), ("", ""), (h(ab + cd), "")]


# ------------------------------------------------------------------ 12


def test_gradient_is_that_of_differences():
    rng = np.random.default_rng(1)
    numbers, bag, y = rng.normal(size=(9, 5)), np.array([0, 0, 0, 1, 1, 2, 2, 2, 2]), np.array([1.0, 0, 1])
    net = quality_mil.Network.fresh(numbers, 4, 3, rng)
    _, grads = net.gradient(numbers, bag, y)
    for w, g in zip(net.weights, grads, strict=True):
        for at in itertools.product(*map(range, w.shape)):
            keep, diffs = w[at], []
            for d in (1e-5, -1e-5):
                w[at] = keep + d
                diffs.append(net.gradient(numbers, bag, y)[0])
            w[at] = keep
            assert abs((diffs[0] - diffs[1]) / 2e-5 - g[at]) < 1e-6


def test_passages_cover_whole_texts():
    texts = [None, "", " \n ", "One two!! three", " ".join(f"w{i}" for i in range(1000)) + " END!!", "a b"]
    numbers, count = quality_mil.passages(pa.array(texts), 64)
    assert count.tolist() == [1, 1, 1, 1, 16, 1] and len(numbers) == 21
    assert not numbers[:3].any()
    alone = [quality_mil.passages(pa.array([t], pa.string()), 64)[0] for t in texts]
    assert np.allclose(np.concatenate(alone), numbers)  # whatever stands beside a text
    kinds = numbers[:, : quality_mil._KINDS] ** 2
    assert np.allclose(kinds[3:].sum(axis=1), 1)
    assert kinds[3, 0] == np.float32(2 / 15) or abs(kinds[3, 0] - 2 / 15) < 1e-6  # "!" in "One two!! three"
    assert kinds[19, 0] > 0  # the last passage of the long text sees its last word
    split = quality_mil.passages(pa.array([texts[4]]), 8)
    assert split[1].tolist() == [126]


def test_scores_do_not_depend_on_slices():
    rng = np.random.default_rng(2)
    numbers = rng.normal(size=(20_000, 6))
    net = quality_mil.Network.fresh(numbers, 4, 3, rng)
    count = np.array([15_000, 1, 4_999])
    whole = net.scores(numbers, count)
    _, h = net.encoded(numbers)
    p = np.exp(net.gated(h)[2])
    for i, (lo, hi) in enumerate([(0, 15_000), (15_000, 15_001), (15_001, 20_000)]):
        z = (p[lo:hi, None] * h[lo:hi]).sum(axis=0) / p[lo:hi].sum()
        assert abs(whole[i] - 1 / (1 + np.exp(-(z @ net.weights[5] + net.weights[6][0])))) < 1e-9


def test_held_out_quality_of_given_labels(spark):
    sf = SF.replace("0.001", "0.01")
    got = {r["doc_id"]: r for r in QUERIES["op12_quality_mil"](spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["predicted"], labels[i]) for i, r in got.items() if r["held_out"] and i in labels]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    low = [p for p, y in held if y == 0]
    assert len(low) > 10 and low.count(1) <= 1
    assert sum(p != y for p, y in held) <= 0.03 * len(held)


def test_attention_finds_the_passage_that_counts():
    """Documents of eight passages, of which one at most tells the label."""
    rng = np.random.default_rng(4)
    numbers = rng.normal(size=(600 * 8, 6)).astype(np.float32)
    y = rng.integers(0, 2, 600).astype(float)
    spot = rng.integers(0, 8, 600)
    numbers[np.arange(600) * 8 + spot, 0] += np.where(y == 0, 6, 0)
    count = np.full(600, 8)
    net = quality_mil.learn(numbers[: 400 * 8], count[:400], y[:400], steps=1200)
    assert ((net.scores(numbers[400 * 8 :], count[400:]) > 0.5) == y[400:]).mean() > 0.95


def test_quality_of_awkward_input(spark):
    good = "A plain sentence of several words, and another one. "
    texts = [good * (i % 5 + 1) if i % 2 else f"@@ ## {i} $$ ||| !!! " * 9 for i in range(60)] + [None, "", " \t", "x", "日本語", "long " * 200_000]
    rows = [(i, t, None, None, None, "g", i, 0, "d", 1, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3], (None, "null key", None, None, None, None, None, None, None, None, None)], DOC)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (5, None), (6, 7), (7, 0)], "doc_id long, quality int")
    model = quality_mil.fit(docs, labels, F.lit(True))
    got = model.score(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert all((by[i] > 0.5) == bool(i % 2) for i in range(40, 60))
    assert [r["score"] for r in got].count(by[3]) >= 2  # repeated rows score alike
    one = quality_mil.fit(docs, labels.where("quality = 1 and doc_id <> 7"), F.lit(True))
    assert {r["score"] for r in one.score(docs).collect()} == {1.0}
    none = quality_mil.fit(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in none.score(docs).collect()} == {0.0}
    assert model.score(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ 13


def trie_of(rows):
    """Brute force of op13 over (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(head, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len([w for w in _words(q[-1][1])]) for q in below if q)
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in below), len(leaves), saved, sha(ends)))
    return sorted(map(repr, out))


def _words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talks():
    rng = random.Random(13)
    rows = []
    for c in [*range(0, 70), *range(205, 215), -3, -25, 1000]:
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hello there", "one\ttwo  three", "", "a b c d", "x"])))
    rows += [(300 + c, t, "user", "same words here") for c in range(40) for t in range(3)]  # copies
    rows += [(500, t, "user", f"turn {t % 7}") for t in range(120)]  # one long conversation
    rows += [(501, 0, None, None), (501, None, "user", "first"), (501, 1, "", None), (None, 0, "user", "no id"), (502, 2, "user", "tie"), (502, 2, "assistant", "tie"), (502, 2, "user", "tie"), (503, 0, "user", "long " * 40_000)]
    rng.shuffle(rows)
    return rows


def test_trie_is_that_of_brute_force(dealt, tmp_path):
    rows = talks()
    dealt.createDataFrame([(*r, 4, 5, "p", 6) for r in rows], TURN).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_conversation_trie"](dealt, str(tmp_path)).select(*COLS).collect()
    assert sorted(repr(tuple(r)) for r in got) == trie_of(rows)


def test_small_shards_and_queues_give_the_same(spark):
    """Shards of four conversations by two depths, so that a path changes shards often, and queues that spill at once."""
    rows = talks()
    turns = conversation_trie.ordered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").where("conv_id <> 500"))
    found = conversation_trie.prefix_trie(*conversation_trie.spliced(turns), block=4, band=2, held=2)
    assert sorted(repr(tuple(r)) for r in found.select(*COLS).collect()) == trie_of([r for r in rows if r[0] != 500])


def test_hot_parents_meet_their_children_in_several_tasks(spark):
    rows = [(i * 20, t, "user", "begin" if t == 0 else f"own {i}") for i in range(60) for t in range(2)]
    turns = conversation_trie.ordered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    prefixes = conversation_trie.prefixes(*conversation_trie.spliced(turns))
    get = lambda n: sorted(map(repr, (tuple(r) for r in n.collect())))
    assert get(conversation_trie._nodes(prefixes, heavy=3, salts=4)) == get(conversation_trie._nodes(prefixes))


def test_trie_of_nothing(spark, tmp_path):
    spark.createDataFrame([(None, 1, "user", "no id", 1, 1, "", 1)], TURN).write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op13_conversation_trie"](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("held", [1, 3, 100])
def test_queue_spills_in_order(held):
    rng = random.Random(held)
    queue, model, out = conversation_trie.SpillingQueue(held), [], []
    for _ in range(500):
        if model and rng.random() < 0.45:
            out.append((queue.pop(), model.pop(model.index(min(model)))))
        else:
            item = (rng.randrange(-9, 9), rng.randrange(30))
            queue.push(item)
            model.append(item)
        assert queue.peek() == (min(model) if model else None)
    assert all(a == b for a, b in out)
