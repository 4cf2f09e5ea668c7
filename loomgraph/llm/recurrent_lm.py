"""Document scores by a gated recurrent language model.

The model reads words one after another and carries its state through the whole document,
window by window.  A word's probability is factored: a softmax over classes from the
state, times the word's share of its class.  Frequent words (`shortlist`) form classes by
frequency, with a second softmax from the state inside each; all others fall into classes
by their last letters, where their share comes from their count in the corpus, plus one,
with one more share for words never seen.  So the words known grow with the corpus, the
network does not.

Word counts cover all training documents.  Every document is encoded once, two bytes for a
word, and stored.  The network is trained by truncated backpropagation over every word of
every training document: first on a sample of about `first_words` words, drawn by hash, from
which all shards start; then once over each shard, after which the weights are averaged by
words read.  Shards hold about `shard_words` words and are made by a hash of key and text, so
neither weights nor scores depend on how the input is split.  Weights meet element by
element in a grouped sum, and only one set returns to the driver.

Counts of the `frequent` most frequent words go to every task; the words beyond meet their
counts in a join.

Defined results: a null or empty text is the end token alone; a row of null key is a
training row where `training` says so; repeated rows (of one key and text) are counted and
trained on each, and scored once for all; without training documents every token is unknown
and score equals base_score, both 0; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Stands for the end of a document; no word holds a space.
END = b" "


def tokens(text: str | bytes | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.split() parts at exactly the six white-space bytes."""
    return (text if isinstance(text, bytes) else (text or "").encode()).lower().split()


def tail_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-2:]) % classes


@dataclass
class Vocabulary:
    """The frequent words, and what a task needs to know about all others."""

    words: list[bytes]  # by count, most frequent first; END among them
    counts: np.ndarray
    shortlist: int  # the first so many have weights of their own
    head_classes: int
    tail_classes: int
    tail_total: np.ndarray  # of each tail class: words counted, and one for each known word and one unknown
    n: int  # training tokens
    v: int  # distinct ones
    index: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.index = {w: i for i, w in enumerate(self.words)}
        s = self.shortlist
        mass = np.sqrt(self.counts[:s].astype(float)) if s else np.empty(0)
        share = (np.cumsum(mass) - mass) / max(1e-9, mass.sum())
        self.head_of = np.minimum((share * self.head_classes).astype(int), self.head_classes - 1)
        self.begin = np.searchsorted(self.head_of, np.arange(self.head_classes), side="left")
        self.until = np.searchsorted(self.head_of, np.arange(self.head_classes), side="right")
        tails = np.array([self.head_classes + tail_class(w, self.tail_classes) for w in self.words[s:]], int)
        self.class_of = np.concatenate([self.head_of, tails]).astype(np.int32)
        #: what the network reads: a shortlist word itself, or a tail class; the last is the start
        self.input_of = np.concatenate([np.arange(s), s + tails - self.head_classes]).astype(np.int32)
        self.start = s + self.tail_classes
        self.class_of_input = np.concatenate([self.head_of, self.head_classes + np.arange(self.tail_classes)]).astype(np.int32)
        self.log_tail = np.log10(self.tail_total)
        # by place among the frequent words, and last (-1) for all beyond: log10 (count + 1), and the part of it that stands in a tail class
        self.log_count = np.append(np.log10(self.counts + 1.0), 0.0)
        self.log_inside = np.append(np.where(np.arange(len(self.words)) < s, 0.0, self.log_count[:-1]), 0.0)
        self.log_inside[s:-1] -= self.log_tail[tails - self.head_classes]

    @property
    def classes(self) -> int:
        return self.head_classes + self.tail_classes

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places among the frequent words (-1: beyond), inputs, classes, and where words beyond stand."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        inputs, classes = self.input_of[at], self.class_of[at]
        beyond = np.flatnonzero(at < 0)
        if len(beyond):
            ends = [words[i][-2:] for i in beyond.tolist()]
            of = {end: tail_class(end, self.tail_classes) for end in set(ends)}
            tail = np.fromiter(map(of.__getitem__, ends), np.int32, len(beyond))
            inputs[beyond] = self.shortlist + tail
            classes[beyond] = self.head_classes + tail
        return at, inputs, classes, beyond


class GatedNetwork:
    """A gated recurrent unit over word inputs with a class-factored softmax."""

    def __init__(self, vocabulary: Vocabulary, hidden: int, params: list[np.ndarray] | None = None, seed: int = 1):
        self.v, self.h = vocabulary, hidden
        if params is None:
            rng = np.random.default_rng(seed)
            s = vocabulary.shortlist
            small = lambda *shape: rng.normal(0, 0.1, shape)
            mass = np.zeros(vocabulary.classes)
            np.add.at(mass, vocabulary.head_of, vocabulary.counts[:s])
            mass[vocabulary.head_classes :] = vocabulary.tail_total
            # biases at the corpus's own frequencies: training starts from the plain counts
            params = [small(vocabulary.start + 1, 3 * hidden), small(hidden, 3 * hidden), small(hidden, vocabulary.classes) * 0.1, np.log(mass + 0.5), small(s, hidden) * 0.1, np.log(vocabulary.counts[:s] + 1.0)]
        self.p = [np.array(x, np.float32) for x in params]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """What inputs (time, lane) add to the gates: (time, 3 hidden, lane)."""
        return np.ascontiguousarray(self.p[0][x].transpose(0, 2, 1))

    def step(self, e: np.ndarray, h: np.ndarray, g: np.ndarray | None = None) -> np.ndarray:
        """The next states (hidden, lane).  What the inputs add, `e` (3 hidden, lane), becomes the gates z and r and
        the candidate in place; `g` takes what the state adds."""
        k = self.h
        g = np.matmul(self.p[1].T, h, out=g)
        gates, n = e[: 2 * k], e[2 * k :]
        gates += g[: 2 * k]
        gates *= 0.5  # the logistic function by way of tanh
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        n += gates[k:] * g[2 * k :]
        np.tanh(n, out=n)
        out = h - n
        out *= gates[:k]
        out += n
        return out

    def log_probs(self, h: np.ndarray, classes: np.ndarray, words: np.ndarray, grads: bool = False):
        """Natural log of P(class) and, for shortlist words, of P(word | class), summed, for the
        states (hidden, place); with `grads` also the gradients of the negated sum over places
        by h, wc, bc, wo and bo."""
        _, _, wc, bc, wo, bo = self.p
        order = np.argsort(classes.astype(np.int16), kind="stable")
        c, w = classes[order], words[order]
        edges, places = np.searchsorted(c, np.arange(self.v.head_classes + 1)), np.arange(len(c))
        # a last row of ones: products with weights whose last column is the bias add it, and give its gradient
        states = np.ones((self.h + 1, len(c)), h.dtype)
        np.take(h, order, axis=1, out=states[:-1], mode="clip")
        by_class, by_word = np.concatenate([wc, bc[None]]).T, np.concatenate([wo, bo[:, None]], axis=1)
        out, dh = np.empty(len(c), h.dtype), np.empty_like(h)
        d_class, d_word = np.zeros_like(by_class, order="C"), np.zeros_like(by_word)
        reach = max(states.max(initial=1), -states.min(initial=-1))

        def far(weights: np.ndarray) -> bool:
            """Whether sums could leave the range of exp(); elsewhere their largest need not be taken off."""
            return bool(np.abs(weights).sum(axis=1).max(initial=0) * reach > 60)

        def softmax(weights: np.ndarray, part: slice, target: np.ndarray, away: bool) -> tuple[np.ndarray, ...]:
            """Log-probabilities of the targets; with `grads` gradients by the states and by the weights."""
            x = states[:, part]
            z = weights @ x
            if away:
                z -= z.max(axis=0)
            at = places[: len(target)]
            hit = z[target, at]
            np.exp(z, out=z)
            total = z.sum(axis=0)
            hit -= np.log(total)
            if not grads:
                return (hit,)
            z[target, at] -= total  # times `share`: all probabilities less one at the target
            share = 1 / total
            back = weights[:, :-1].T @ z
            back *= share
            return hit, back, z @ (x * share).T

        away = far(by_class)
        for lo in range(0, len(c), 384):  # so few places at a time stay in the cache, and products take the way for small ones
            part = slice(lo, lo + 384)
            out[part], *d = softmax(by_class, part, c[part], away)
            if grads:
                dh[:, part] = d[0]
                d_class += d[1]
        away = far(by_word)
        for i in range(self.v.head_classes):
            part, lo, hi = slice(edges[i], edges[i + 1]), self.v.begin[i], self.v.until[i]
            if edges[i] == edges[i + 1] or hi - lo < 2:
                continue
            hit, *d = softmax(by_word[lo:hi], part, w[part] - lo, away)
            out[part] += hit
            if grads:
                dh[:, part] += d[0]
                d_word[lo:hi] = d[1]
        back = np.empty_like(order)
        back[order] = places
        if not grads:
            return out[back]
        return out[back], np.take(dh, back, axis=1, mode="clip"), *(np.ascontiguousarray(d) for d in (d_class[:, :-1].T, d_class[:, -1], d_word[:, :-1], d_word[:, -1]))

    def score(self, docs: list[np.ndarray], lanes: int = 256, window: int = 32) -> np.ndarray:
        """Sum of log10 of the state-dependent probabilities of each document (its inputs), read to its end."""
        laid = Lanes(docs, lanes, self.v.start)
        lp = np.zeros(len(laid.inputs))
        h = np.zeros((self.h, len(laid.length)), np.float32)
        for at, valid in laid.windows(window):
            states, x = np.empty((self.h, *at.shape), np.float32), laid.previous[at]
            e, fresh, live = self.inputs(x), x == self.v.start, valid.sum(axis=1)
            for t in range(len(at)):
                if live[t] < h.shape[1]:
                    h = np.ascontiguousarray(h[:, : live[t]])
                if fresh[t, : live[t]].any():
                    h[:, fresh[t, : live[t]]] = 0
                h = self.step(e[t, :, : live[t]], h)
                states[:, t, : live[t]] = h
            some, states = at[valid], states.reshape(self.h, -1)
            states = states if len(some) == at.size else states[:, valid.ravel()]
            lp[some] = self.log_probs(states, self.v.class_of_input[laid.inputs[some]], laid.inputs[some])
        return laid.sums(lp) / math.log(10.0)

    def train(self, docs: list[np.ndarray], lanes: int = 256, window: int = 32, rate: float = 0.01, epochs: int = 1, most: int = 1 << 13) -> int:
        """Truncated backpropagation (Adam) over every word of the documents; words seen.

        State, weights and moments carry on from window to window.  Documents of more than
        `most` words are parted, so that lanes share them; a part starts without state.
        """
        laid = Lanes([d[lo : lo + most] for d in docs for lo in range(0, len(d), most)], lanes, self.v.start)
        adam, seen, total = Adam(self), 0, epochs * len(laid.inputs)
        for _ in range(epochs):
            h = np.zeros((self.h, len(laid.length)), np.float32)
            for at, valid in laid.windows(window):
                x, w, whole = laid.previous[at], laid.inputs[at], bool(valid.all())
                count = at.size if whole else int(valid.sum())
                # windows of few words move the weights by their share of a full one
                now = rate * (1 - 0.9 * seen / total) * count / (len(laid.length) * window)
                h = adam.window(x, x == self.v.start, w, self.v.class_of_input[w], h[:, : at.shape[1]], now, None if whole else valid)
                seen += count
        return seen


class Lanes:
    """Documents (their inputs) laid end to end in lanes of about equal length, the longest lane first."""

    def __init__(self, docs: list[np.ndarray], lanes: int, start: int):
        sizes = np.array([len(d) for d in docs], np.int64)
        ends = [(0, i) for i in range(min(lanes, len(docs)))]
        lane, held = np.zeros(len(docs), np.int64), np.zeros(len(ends), np.int64)
        for i in np.argsort(-sizes, kind="stable").tolist():
            size, to = ends[0]
            lane[i] = to
            heapq.heapreplace(ends, (size + len(docs[i]), to))
        np.add.at(held, lane, sizes)
        by_length = np.argsort(-held, kind="stable")
        place = np.empty_like(by_length)
        place[by_length] = np.arange(len(by_length))
        self.order = np.argsort(place[lane], kind="stable") if len(docs) else lane
        self.begin = np.cumsum(sizes[self.order]) - sizes[self.order]
        self.inputs = np.concatenate([docs[i] for i in self.order]).astype(np.int32) if len(docs) else np.empty(0, np.int32)
        self.previous = np.roll(self.inputs, 1)
        self.previous[self.begin] = start
        self.length = held[by_length]
        self.lane_begin = np.cumsum(self.length) - self.length

    def windows(self, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(time, lane) places in the inputs, and where there is a word; lanes that have ended are left out."""
        for t0 in range(0, int(self.length.max(initial=0)), width):
            t = np.arange(t0, min(t0 + width, int(self.length[0])))[:, None]
            live = int(np.searchsorted(-self.length, -t0, side="left"))
            valid = t < self.length[None, :live]
            yield np.minimum(self.lane_begin[None, :live] + t, len(self.inputs) - 1), valid

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values of each document, in the order they came in."""
        out = np.zeros(len(self.order))
        if len(out):
            out[self.order] = np.add.reduceat(values, self.begin)
        return out


class Adam:
    """Updates of a network's weights by windows of lanes; moments carry on between them."""

    def __init__(self, net: GatedNetwork):
        self.net, self.steps = net, 0
        self.m, self.s = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p]

    def window(self, x: np.ndarray, fresh: np.ndarray, words: np.ndarray, classes: np.ndarray, h: np.ndarray, rate: float, valid: np.ndarray | None = None) -> np.ndarray:
        """One update; arrays are (time, lane), states (hidden, lane).  `fresh`: the state starts anew there; `valid`:
        where there is a word, which only the ends of lanes lack.  The states at the end."""
        net = self.net
        k, u = net.h, net.p[1]
        span, lanes = x.shape
        kind = net.p[1].dtype
        hidden, before, added = (np.empty((span, n * k, lanes), kind) for n in (1, 1, 3))
        past = net.inputs(x)
        anew = fresh.any(axis=1)
        for t in range(span):
            if anew[t]:
                h = np.where(fresh[t], kind.type(0), h)
            before[t] = h
            hidden[t] = h = net.step(past[t], h, added[t])
        wide = lambda a: np.ascontiguousarray(a.transpose(1, 0, 2)).reshape(a.shape[1], -1)  # noqa: E731  (time, n, lane) to (n, place)
        at = slice(None) if valid is None else np.flatnonzero(valid.ravel())
        flat_c, flat_w = classes.ravel()[at], words.ravel()[at]
        _, dh, dwc, dbc, dwo, dbo = net.log_probs(wide(hidden)[:, at], flat_c, flat_w, grads=True)
        if valid is not None:
            some, dh = dh, np.zeros((k, span * lanes), kind)
            dh[:, at] = some
        dh = dh.reshape(k, span, lanes)
        # of the error of a state: the shares that go to the candidate, to z, and from the candidate to r
        gates, z, r, n = past[:, : 2 * k], past[:, :k], past[:, k : 2 * k], past[:, 2 * k :]
        dg, dn = np.empty((span, 3 * k, lanes), kind), 1 - n * n
        dn *= 1 - z
        np.multiply(gates, gates, out=dg[:, : 2 * k])
        np.subtract(gates, dg[:, : 2 * k], out=dg[:, : 2 * k])
        before_n = before - n
        dg[:, :k] *= before_n
        dg[:, k : 2 * k] *= added[:, 2 * k :]
        carry = np.zeros((k, lanes), kind)
        for t in range(span - 1, -1, -1):
            carry += dh[:, t]
            dn[t] *= carry
            dg[t, :k] *= carry
            dg[t, k : 2 * k] *= dn[t]
            np.multiply(dn[t], r[t], out=dg[t, 2 * k :])
            carry *= z[t]
            carry += u @ dg[t]
            if anew[t]:
                carry[:, fresh[t]] = 0
        du = np.matmul(before, dg.transpose(0, 2, 1)).sum(axis=0)
        at, dtable = x.ravel().astype(np.intp), np.empty((3 * k, len(net.p[0])), kind)
        for i in range(3 * k):  # what the inputs add to the candidate is not gated
            dtable[i] = np.bincount(at, (dg[:, i] if i < 2 * k else dn[:, i - 2 * k]).ravel(), len(net.p[0]))
        dtable = np.ascontiguousarray(dtable.T)
        self.steps += 1
        # moments are kept without their factors 0.1 and 0.01, which stand in the rate and in what is added to the root
        low, high = 1 - 0.9**self.steps, math.sqrt(0.01 / (1 - 0.99**self.steps))
        for i, g in enumerate((dtable, du, dwc, dbc, dwo, dbo)):
            g *= kind.type(1 / len(flat_c))
            np.clip(g, -0.1, 0.1, out=g)
            self.m[i] *= kind.type(0.9)
            self.m[i] += g
            self.s[i] *= kind.type(0.99)
            g *= g
            self.s[i] += g
            np.sqrt(self.s[i], out=g)
            g += kind.type(1e-6 / high)
            np.divide(self.m[i], g, out=g)
            g *= kind.type(rate * 0.1 / (low * high))
            net.p[i] -= g
        return h


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all `docs`; END counts their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda seen: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(tokens(t))
            seen[END] += batch.num_rows
            if len(seen) > 1 << 19:
                yield rows(seen)
                seen.clear()
        if seen:
            yield rows(seen)

    return docs.select(F.col(text).cast("binary")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def vocabulary(counts: DataFrame, frequent: int, shortlist: int, head_classes: int, tail_classes: int) -> Vocabulary | None:
    """From stored `counts`; None if they are empty.  Collects at most about `frequent` words."""
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not n:
        return None
    # one row for each distinct count: at most sqrt(2 n)
    level = 0
    if v > frequent:
        by = counts.groupBy("n").count().toPandas().sort_values("n", ascending=False)
        fits = by["n"][by["count"].cumsum() <= frequent]
        level = int(fits.iloc[-1]) if len(fits) else int(by["n"].iloc[0]) + 1
    top = counts.where((F.col("n") >= level) | (F.col("word") == F.lit(END))).toPandas().sort_values(["n", "word"], ascending=[False, True])
    words = [bytes(w) for w in top["word"]]
    amounts = top["n"].to_numpy(np.int64)
    shortlist = min(shortlist, len(words))
    end = words.index(END)
    if end >= shortlist:  # the end always has weights of its own
        words.insert(0, words.pop(end))
        amounts = np.concatenate([amounts[end : end + 1], np.delete(amounts, end)])

    @F.pandas_udf("int")
    def of(word: pd.Series) -> pd.Series:
        return pd.Series([tail_class(bytes(w), tail_classes) for w in word], dtype="int32")

    # all words but the shortlist, by class: all of them less the shortlist's
    sums = np.ones(tail_classes)
    for r in counts.groupBy(of("word").alias("c")).agg((F.sum("n") + F.count("*")).alias("s")).collect():
        sums[r["c"]] += r["s"]
    for w, c in zip(words[:shortlist], amounts[:shortlist].tolist(), strict=True):
        sums[tail_class(w, tail_classes)] -= c + 1
    return Vocabulary(words, amounts, shortlist, head_classes, tail_classes, np.maximum(sums, 1.0), int(n), int(v))


def encoded(docs: DataFrame, vocab: Vocabulary, key: str, text: str, training: Column) -> DataFrame:
    """One stored row for each key, text and `training`: (row, key, h, training, rows, n_tokens, seen, logs, inside, inputs, rare, times).

    inputs: what the network reads, two bytes for a word; rare, times: the words beyond the
    frequent ones; logs, inside: sums over the frequent ones.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "h", "training", "n_tokens", "seen", "logs", "inside", "inputs", "rare", "times"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                words, edges = [], [0]
                for t in some.column(3).to_pylist():
                    words += tokens(t)
                    words.append(END)
                    edges.append(len(words))
                at, inputs, classes, beyond = vocab.encode(words)
                begin, n = np.array(edges[:-1], np.int64), np.diff(edges)
                s, logs, own = np.add.reduceat((at >= 0).astype(np.int64), begin), np.add.reduceat(vocab.log_count[at], begin), vocab.log_inside[at]
                own[beyond] = -vocab.log_tail[classes[beyond] - vocab.head_classes]
                data = inputs.astype("<u2").tobytes()
                inputs_ = [data[2 * x : 2 * y] for x, y in zip(edges[:-1], edges[1:], strict=True)]
                far, rares, times, until = [words[i] for i in beyond.tolist()], [], [], [0]
                here = np.searchsorted(beyond, edges).tolist()
                for x, y in zip(here[:-1], here[1:], strict=True):
                    if y > x:
                        seen = Counter(far[x:y])
                        rares += seen
                        times += seen.values()
                    until.append(len(rares))
                lists = [pa.ListArray.from_arrays(pa.array(until, pa.int32()), x) for x in (pa.array(rares, pa.binary()), pa.array(times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(n, pa.int64()), pa.array(s), pa.array(logs), pa.array(np.add.reduceat(own, begin)), pa.array(inputs_, pa.binary()), *lists], names=names)

    narrow = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("h"), F.coalesce(training, F.lit(False)).alias("training"), F.col(text).cast("binary").alias("text"))
    each = narrow.mapInArrow(read, f"key {kind}, h long, training boolean, n_tokens long, seen long, logs double, inside double, inputs binary, rare array<binary>, times array<bigint>")
    one = each.groupBy("key", "h", "training").agg(F.count("*").alias("rows"), *[F.first(c).alias(c) for c in names[3:]])
    return stash(one.withColumn("row", F.monotonically_increasing_id()))


def fitted(docs: DataFrame, vocab: Vocabulary, hidden: int, first_words: int, shard_words: int) -> GatedNetwork:
    """The network trained on the training rows of `docs`, as `encoded` gives them, in two rounds (see the module)."""
    sizes = [p.size for p in GatedNetwork(vocab, hidden).p]
    h = F.xxhash64("key", "h", "copy")
    copies = docs.where("training").select("key", "h", "inputs", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"))
    network = GatedNetwork(vocab, hidden)

    def trained(rows: DataFrame, start: list[np.ndarray], epochs: int) -> list[np.ndarray]:
        """Weights trained from `start` on each shard of `rows` (shard, h, inputs), averaged by words."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, words, held, last = np.zeros(sum(sizes)), 0, [], None

            def done() -> None:
                nonlocal total, words
                net = GatedNetwork(vocab, hidden, start)
                seen = net.train(held, epochs=epochs)
                total, words = total + np.concatenate([p.ravel() for p in net.p]).astype(np.float64) * seen, words + seen
                held.clear()

            for batch in batches:
                for shard, inputs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if held and shard != last:
                        done()
                    last = shard
                    held.append(np.frombuffer(inputs.as_py(), "<u2"))
            if held:
                done()
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total), pa.array(np.full(len(total), words), pa.int64())], names=["i", "w", "n"])

        got = rows.select("shard", "inputs").mapInArrow(work, "i int, w double, n long").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).toPandas().sort_values("i")
        if len(got) != sum(sizes):
            return start
        return [x.reshape(p.shape).astype(np.float32) for x, p in zip(np.split(got["w"].to_numpy(), np.cumsum(sizes)[:-1]), start, strict=True)]

    share = max(1, vocab.n // first_words)
    first = copies.where(F.pmod(h, F.lit(share)) == 0).select(F.lit(0).alias("shard"), "h", "inputs").repartition(1).sortWithinPartitions("h")
    pretrained = trained(first, network.p, max(1, min(4, first_words // vocab.n)))
    shards = max(1, round(vocab.n / shard_words))
    dealt = copies.withColumn("shard", F.pmod(F.xxhash64("key", "h", "copy", F.lit(4)), F.lit(shards)))
    dealt = dealt.repartition(2 * shards, "shard").sortWithinPartitions("shard", "h")
    return GatedNetwork(vocab, hidden, trained(dealt, pretrained, 1))


def score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", frequent: int = 1 << 17, shortlist: int = 1024, head_classes: int = 24, tail_classes: int = 64, hidden: int = 24, first_words: int = 400_000, shard_words: int = 1 << 22) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs`.

    `training` says of which rows to learn.  base_score is the unigram score of the
    corpus's counts plus one; both scores are log10 probabilities of the whole text.
    """
    counts = stash(word_counts(docs.where(training), text))
    vocab = vocabulary(counts, frequent, shortlist, head_classes, tail_classes)
    if vocab is None:
        n = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1
        return docs.select(F.col(key), n.alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    rows = encoded(docs, vocab, key, text, training)
    params = fitted(rows, vocab, hidden, first_words, shard_words).p
    floor = math.log10(vocab.n + vocab.v + 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = GatedNetwork(vocab, hidden, params)
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sums = net.score([np.frombuffer(x.as_py(), "<u2") for x in table.column(1)])
            held.clear()
            return pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), pa.array(sums)], names=["row", "net"])

        words = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                held.append(batch.slice(lo, 256))
                words += sum(len(x.as_py()) // 2 for x in held[-1].column(1))
                if words > 1 << 22:  # lanes are filled from about so many words at a time
                    yield done()
                    words = 0
        if held:
            yield done()

    scored = rows.select("row", "inputs").mapInArrow(read, "row long, net double")
    known = rows.select("row", "key", "rows", "n_tokens", "seen", "logs", "inside").join(scored, "row")
    more, logs = F.lit(0), F.lit(0.0)
    if vocab.v > len(vocab.words):
        each = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
        rare = each.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_logs"))
        known = known.join(rare, "row", "left")
        more, logs = F.coalesce("more", F.lit(0)), F.coalesce("rare_logs", F.lit(0.0))
    known = known.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return known.select(
        F.col("key").alias(key), "n_tokens", (F.col("seen") + more).alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n_tokens") * F.lit(floor)).alias("base_score"), (F.col("net") + F.col("inside") + logs).alias("score"),
    )
