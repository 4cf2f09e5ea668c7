"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of `words` words each, together the whole text.  Every
passage becomes numbers (rates of kinds of bytes, word lengths and shapes, repeats, hashed
words), and a hidden layer encodes them.  Labels are known for documents only, so the
network learns which passages count: a gated attention, tanh(V h) * sigmoid(U h), weighs
the encoded passages of a document against each other, and the weighted sum of them is what
the output scores.

Learning takes a bounded sample: documents of lowest hash, `sample_rows` at most, with
`sample_passages` passages in all; a document of more than an eighth of these passages does
not teach, but is scored like all others.  It runs in one task over these numbers.  Scoring is one pass
over all texts, in slices of bounded size, with sums of weighted passages carried along
within a text.

Defined results: null and empty texts, and those without words, have one passage of zeros
and are scored by it; labels other than 0 and 1, or null, are ignored; of several labels of
a key the lowest counts; of several texts of a key each teaches; without labels of both
kinds every score is the share of label 1 (0 without any); repeated rows score alike; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash, tidy
from .textnum import flat, slices, word_hashes

#: Kinds of bytes: each listed sign has its own, then letters, digits and the rest.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_KINDS = len(_SIGNS) + 6
_KIND = np.full(256, _KINDS - 1, np.uint8)
_KIND[[ord(c) for c in _SIGNS]] = np.arange(len(_SIGNS))
_KIND[ord("a") : ord("z") + 1] = len(_SIGNS)
_KIND[ord("A") : ord("Z") + 1] = len(_SIGNS) + 1
_KIND[ord("0") : ord("9") + 1] = len(_SIGNS) + 2
_KIND[10] = len(_SIGNS) + 3
_KIND[[9, 11, 12, 13, 32]] = len(_SIGNS) + 4
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_HASHED = 32
#: Numbers of a passage: kinds of bytes, hashed words, and eight of its words as a whole.
WIDTH = _KINDS + _HASHED + 8


def passages(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, count): the numbers of every passage of every text, text after text, and how many passages each text has."""
    data, offsets = flat(column)
    hashes, per = word_hashes(column)
    count = np.maximum(1, -(-per // words))
    out = np.zeros((int(count.sum()), WIDTH), np.float32)
    if not len(hashes):
        return out, count
    first = np.cumsum(count) - count
    begin = np.cumsum(per) - per
    text = np.repeat(np.arange(len(per)), per)
    where = first[text] + (np.arange(len(hashes)) - begin[text]) // words  # passage of each word
    # where words begin and end
    inside = ~_SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    s = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | border[:-1]))
    e = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | border[1:])) + 1
    n = np.bincount(where, minlength=len(out)).astype(np.float64)
    some = np.maximum(n, 1)
    size = (e - s).astype(np.float64)
    # each byte belongs to the passage of the last word begun; bytes before the first word of a text to its first
    owner = np.cumsum(np.bincount(s, minlength=len(data)))[: len(data)] - 1
    last = np.repeat(np.arange(len(per)), np.diff(offsets))
    owner = np.where((owner >= 0) & (text[np.maximum(owner, 0)] == last), where[np.maximum(owner, 0)], first[last])
    kinds = np.bincount(owner * _KINDS + _KIND[data], minlength=len(out) * _KINDS).reshape(-1, _KINDS)
    out[:, :_KINDS] = np.sqrt(kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1))
    hashed = np.bincount(where * _HASHED + (hashes >> np.uint64(59)).astype(np.int64), minlength=len(out) * _HASHED).reshape(-1, _HASHED)
    out[:, _KINDS : _KINDS + _HASHED] = np.sqrt(hashed / some[:, None])
    order = np.lexsort((hashes, where))
    edge = np.flatnonzero(np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (where[order][1:] != where[order][:-1])]))
    times = np.diff(np.concatenate([edge, [len(hashes)]]))
    at = where[order][edge]
    distinct = np.bincount(at, minlength=len(out))
    most = np.zeros(len(out))
    np.maximum.at(most, at, times)
    ending, lead = _KIND[data[e - 1]], _KIND[data[s]]
    mean = np.bincount(where, weights=size, minlength=len(out)) / some
    more = [
        np.log1p(n) / 4, mean / 10, np.sqrt(np.maximum(np.bincount(where, weights=size**2, minlength=len(out)) / some - mean**2, 0)) / 10, distinct / some, most / some,
        np.bincount(where, weights=ending < len(_SIGNS), minlength=len(out)) / some, np.bincount(where, weights=lead == len(_SIGNS) + 1, minlength=len(out)) / some, np.bincount(where, weights=lead < len(_SIGNS), minlength=len(out)) / some,
    ]
    out[:, _KINDS + _HASHED :] = np.stack(more, axis=1)
    out[(n == 0)] = 0
    return out, count


@dataclass
class Network:
    """Encoder, gated attention and output, with the means and scales of their input."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]  # encoder W, b; attention V, U, w; output c, c0

    @staticmethod
    def fresh(numbers: np.ndarray, hidden: int, attention: int, rng: np.random.Generator) -> Network:
        d = numbers.shape[1]
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        return Network(numbers.mean(axis=0), numbers.std(axis=0) + 0.05, [draw(d, hidden), np.zeros(hidden), draw(hidden, attention), draw(hidden, attention), draw(attention), draw(hidden), np.zeros(1)])

    def encoded(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input clipped to its usual range, and the hidden layer."""
        x = np.clip((numbers - self.mean) / self.scale, -6, 6)
        return x, np.tanh(x @ self.weights[0] + self.weights[1])

    def gated(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two gates, and the attention's logits, which are bounded as tanh and sigmoid are."""
        t, g = np.tanh(h @ self.weights[2]), 1 / (1 + np.exp(-(h @ self.weights[3])))
        return t, g, (t * g) @ self.weights[4]

    def gradient(self, numbers: np.ndarray, bag: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of bags (`bag`: that of each passage, ascending) and its gradient."""
        w1, _, v, u, w, c, c0 = self.weights
        x, h = self.encoded(numbers)
        t, g, a = self.gated(h)
        n = len(y)
        p = np.exp(a - a.max())
        p /= np.bincount(bag, weights=p, minlength=n)[bag]
        z = np.stack([np.bincount(bag, weights=p * h[:, j], minlength=n) for j in range(h.shape[1])], axis=1)
        logit = z @ c + c0[0]
        q = 1 / (1 + np.exp(-logit))
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        dlogit = (q - y) / n
        dz = dlogit[:, None] * c
        dp = np.einsum("ij,ij->i", h, dz[bag])
        da = p * (dp - np.bincount(bag, weights=p * dp, minlength=n)[bag])
        dt, dg = da[:, None] * w * g * (1 - t * t), da[:, None] * w * t * g * (1 - g)
        dh = p[:, None] * dz[bag] + dt @ v.T + dg @ u.T
        dx = dh * (1 - h * h)
        return loss, [x.T @ dx, dx.sum(axis=0), h.T @ dt, h.T @ dg, (t * g).T @ da, z.T @ dlogit, np.array([dlogit.sum()])]

    def scores(self, numbers: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each text; a bounded number of passages at a time."""
        n, hidden = len(count), len(self.weights[5])
        bag = np.repeat(np.arange(n), count)
        weight, total = np.zeros(n), np.zeros((n, hidden))
        for lo in range(0, len(numbers), 8192):
            own = bag[lo : lo + 8192]
            _, h = self.encoded(numbers[lo : lo + 8192])
            p = np.exp(self.gated(h)[2])  # bounded, so sums of parts need no common shift
            weight += np.bincount(own, weights=p, minlength=n)
            at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            total[own[at]] += np.add.reduceat(p[:, None] * h, at, axis=0)
        return 1 / (1 + np.exp(-(total / weight[:, None] @ self.weights[5] + self.weights[6][0])))


def learn(numbers: np.ndarray, count: np.ndarray, y: np.ndarray, hidden: int = 24, attention: int = 12, steps: int = 1500, bags: int = 64, rate: float = 4e-3, decay: float = 1e-3, seed: int = 12) -> Network:
    """A network fitted to bags of passages by Adam, `bags` at a time."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(numbers, hidden, attention, rng)
    end = np.cumsum(count)
    m, v = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    order = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < bags:
            order = np.concatenate([order, rng.permutation(len(y))])
        chosen, order = np.sort(order[:bags]), order[bags:]
        rows = np.concatenate([np.arange(end[i] - count[i], end[i]) for i in chosen])
        _, grads = net.gradient(numbers[rows], np.repeat(np.arange(len(chosen)), count[chosen]), y[chosen])
        speed = rate * (1 - (step - 1) / steps)
        for i, g in enumerate(grads):
            g = g + decay * net.weights[i] * (net.weights[i].ndim == 2)
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            net.weights[i] = net.weights[i] - speed * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return net


@dataclass
class QualityModel:
    network: Network | None
    base: float
    words: int

    def score(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, score) of every row."""
        if self.network is None:
            return docs.select(F.col(key), F.lit(self.base).alias("score"))
        network, words = self.network, self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, n in slices(batch.column(1)):
                    found = network.scores(*passages(batch.column(1).slice(lo, n), words))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(found)], names=["key", "score"])

        narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        return narrow.mapInArrow(tidy(run), f"key {narrow.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "quality", words: int = 64, sample_rows: int = 12_000, sample_passages: int = 1 << 18, seed: int = 12) -> QualityModel:
    """Fit on the labelled rows of lowest hash where `usable` holds of the key column, within both bounds."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & usable).groupBy(F.col(key).alias("__key")).agg(F.min(label).cast("int").alias("y"))
    known = known.withColumn("__h", F.xxhash64("__key", F.lit(seed)))
    first = stash(known.orderBy("__h", "__key").limit(sample_rows))  # bounded, so every task can have it

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n in slices(batch.column(2)):
                numbers, count = passages(batch.column(2).slice(lo, n), words)
                offsets = np.concatenate([[0], np.cumsum(count * numbers.shape[1] * 4)]).astype(np.int32)
                rows = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(numbers.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(count, pa.int64()), rows], names=["h", "y", "n", "numbers"])

    narrow = docs.select(F.col(key).alias("__key"), F.col(text).alias("text"))
    labelled = narrow.join(F.broadcast(first), "__key").select("__h", "y", "text")
    bags = stash(labelled.mapInArrow(tidy(read), "h long, y int, n long, numbers binary").where(F.col("n") <= sample_passages // 8))
    # keys in order of hash as long as all passages so far are within the bound; at most sample_rows of them
    sums = W.orderBy("h", "n").rowsBetween(W.unboundedPreceding, W.currentRow)
    per = bags.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") <= sample_passages // 8).withColumn("upto", F.sum("n").over(sums)).where(F.col("upto") <= sample_passages)
    bags = stash(bags.join(F.broadcast(per.select("h")), "h", "left_semi"))
    yes, total = bags.agg(F.sum("y"), F.count("*")).first()
    base = float(yes or 0) / total if total else 0.0
    if base in (0.0, 1.0):
        return QualityModel(None, base, words)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, count, y = [], [], []
        for batch in batches:
            count += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
            numbers += [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in batch.column(2).to_pylist()]
        net = learn(np.concatenate(numbers), np.array(count), np.array(y, np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((net.mean, net.scale, net.weights))], pa.binary())], names=["net"])

    one = bags.repartition(1).sortWithinPartitions("h", "numbers").select("n", "y", "numbers")
    return QualityModel(Network(*pickle.loads(bytes(one.mapInArrow(tidy(train), "net binary").first()["net"]))), base, words)
