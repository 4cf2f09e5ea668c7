"""Toxicity scores: gradient-boosted trees over dense features, calibrated isotonically.

A lexicon of words and word beginnings is learned from labelled texts: those that occur in
far more texts of label 1.  Every text then becomes a few numbers: lexicon densities, how
near lexicon words stand to second-person words, rates of capitals, punctuation and
obfuscation.  Trees are boosted on some labelled rows and calibrated on others, none of
them those that taught the lexicon.

The labelled sample is bounded (`sample_rows`), so it can be sent to every task and no
text is ever shuffled; the lexicon is bounded by `lexicon_size`.  Scoring is one pass over
all texts.

Defined results: null and empty texts are scored by their features, which are all zero;
labels other than 0 and 1, or null, are ignored; of several labels of a key the highest
counts; without labels of both kinds every score is the share of label 1 (0 without any);
repeated rows score alike; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, tidy

#: Second-person words of the languages in use.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus tuyo vosotros usted ustedes os".split())
#: Signs that stand for letters in obfuscated words.
LEET = str.maketrans("013457@$!", "oieastasi")

FEATURES = ["log_words", "density", "log_hits", "weight_rate", "top_weight", "second_top_weight", "distinct_hits", "person_rate", "near_person", "capitals", "shouted", "exclaims", "punctuation", "symbols", "digits", "obfuscated", "revealed", "stretched"]

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"(?<![^\s])[^\W\d_]+(?:[\d@$!*_.\-]+[^\W\d_]+)+(?![^\s.,;:!?])")
_STRETCH = re.compile(r"([^\W\d_])\1\1")
_SHOUT = re.compile(r"\b[A-ZÀ-Þ]{3,}\b")
#: How many words beginnings have, marked so that they differ from words.
_STEMS = (4, 5, 6)


def terms(word: str) -> list[str]:
    """The word, and its beginnings marked with a trailing `-`."""
    return [word, *(word[:n] + "-" for n in _STEMS if len(word) >= n)]


class Lexicon(dict):
    """Weight of a word by its heaviest term, 0 if it has none; a bounded memo of words."""

    def __init__(self, weights: dict[str, float], most: int = 1 << 17):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> float:
        w = max((self.weights.get(t, 0.0) for t in terms(word)), default=0.0)
        if len(self) < self.most:
            self[word] = w
        return w


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The numbers named in FEATURES; the same for any text, none of them by prefix."""
    if not text:
        return [0.0] * len(FEATURES)
    words = _WORD.findall(text.lower())
    n = max(1, len(words))
    weights = list(map(lexicon.__getitem__, words))
    hits = [i for i, w in enumerate(weights) if w]
    person = [i for i, w in enumerate(words) if w in SECOND_PERSON] if hits else []
    near = 0
    if person and hits:
        at = np.searchsorted(person, hits)
        p = np.asarray(person)
        gap = np.minimum(np.abs(p[np.minimum(at, len(p) - 1)] - hits), np.abs(p[np.maximum(at - 1, 0)] - hits))
        near = int((gap <= 5).sum())
    kinds = sorted({words[i]: weights[i] for i in hits}.values(), reverse=True)
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=128)
    chars = len(text)
    mixed = _MIXED.findall(text.lower()) if raw[48:58].any() or raw[[33, 36, 42, 45, 46, 64, 95]].any() else []
    revealed = sum(1 for m in mixed if lexicon[re.sub(r"[*_.\-!@$]", "", m.translate(LEET))] or lexicon["".join(_WORD.findall(m))])
    letters = max(1, int(raw[65:91].sum() + raw[97:123].sum()))
    return [
        math.log1p(len(words)), len(hits) / n, math.log1p(len(hits)), sum(weights) / math.sqrt(n),
        kinds[0] if kinds else 0.0, kinds[1] if len(kinds) > 1 else 0.0, math.log1p(len(kinds)),
        len(person) / n, near / n, float(raw[65:91].sum()) / letters, len(_SHOUT.findall(text)) / n if raw[65:91].sum() > 2 else 0.0,
        float(raw[33]) / n, float(raw[[33, 44, 46, 58, 59, 63]].sum()) / chars, float(raw[[35, 36, 37, 38, 42, 64, 94, 95, 126]].sum()) / chars,
        float(raw[48:58].sum()) / chars, len(mixed) / n, math.log1p(revealed), float(bool(_STRETCH.search(text))),
    ]


def learn_lexicon(labelled: DataFrame, size: int, least: int = 5, odds: float = 3.0) -> dict[str, float]:
    """Weights of the terms whose share of label-1 texts is at least `odds` times that of the others.

    `labelled`: (text, toxic).  The `size` terms of most evidence are kept.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(seen: Counter[tuple[str, int]]) -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in keys], pa.string()), pa.array([y for _, y in keys], pa.int32()), pa.array(seen.values(), pa.int64())], names=["term", "toxic", "n"])

        seen: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((t, y) for t in {t for w in set(_WORD.findall((text or "").lower())) for t in terms(w)})
                if len(seen) > 1 << 18:
                    yield rows(seen)
                    seen.clear()
        yield rows(seen)

    totals = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return {}
    by = labelled.select("text", "toxic").mapInArrow(tidy(count), "term string, toxic int, n long").groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("no"))
    lift = F.log((F.col("yes") + 0.5) / (totals[1] + 1.0)) - F.log((F.col("no") + 0.5) / (totals[0] + 1.0))
    best = by.where(F.col("yes") >= least).withColumn("weight", lift).where(F.col("weight") >= math.log(odds))
    best = best.orderBy(F.desc(F.col("weight") * F.sqrt("yes")), "term").limit(size)
    return {r["term"]: r["weight"] for r in best.select("term", "weight").collect()}


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base: float

    def featured(self, docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
        """`keep` columns of `docs` with the features of their texts."""
        weights, kept = self.lexicon, len(keep)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = Lexicon(weights)
            for whole in batches:
                for lo in range(0, whole.num_rows, 512):
                    batch = whole.slice(lo, 512)
                    rows = [features(t or "", lexicon) for t in batch.column(kept).to_pylist()]
                    cols = np.asarray(rows, np.float64).reshape(len(rows), len(FEATURES)).T
                    yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *map(pa.array, cols)], names=[*keep, *FEATURES])

        narrow = docs.select(*[F.col(k) for k in keep], F.col(text).alias("__text"))
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]]
        return narrow.mapInArrow(tidy(read), ", ".join([*kinds, *(f"{f} double" for f in FEATURES)]))

    def raw(self, featured: DataFrame) -> DataFrame:
        """`featured` with the trees' own probability as `raw`, features dropped."""
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="__x").transform(featured).drop(*FEATURES)
        return self.trees.transform(vectors).withColumn("raw", vector_to_array("probability")[1]).drop("__x", "probability", "rawPrediction", "prediction")

    def score(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, score) of every row."""
        if self.trees is None:
            return docs.select(F.col(key), F.lit(self.base).alias("score"))
        keyed = docs.select(F.col(key).alias("__key"), F.col(text).alias("text"))
        scored = self.calibration.transform(self.raw(self.featured(keyed, "text", ["__key"])))
        return scored.select(F.col("__key").alias(key), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))

    def clean(self, docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
        """The rows of `docs` that score below `threshold`, with all their columns."""
        if self.trees is None:
            return docs if self.base < threshold else docs.limit(0)
        whole = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("text"))
        scored = self.calibration.transform(self.raw(self.featured(whole, "text", ["__row"])))
        return scored.where(F.col("score") < threshold).select("__row.*")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = 40_000, lexicon_size: int = 4096, rounds: int = 20, depth: int = 4, seed: int = 7) -> ToxicityModel:
    """Fit on at most about `sample_rows` labelled rows, those of lowest hash, where `usable` holds of the key column."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & usable).groupBy(F.col(key).alias("__key")).agg(F.max(label).cast("int").alias("toxic"))
    known = known.withColumn("__h", F.pmod(F.xxhash64("__key", F.lit(seed)), F.lit(1 << 30)))
    n = known.count()
    if n > sample_rows:
        known = known.where(F.col("__h") < int(sample_rows / n * (1 << 30)))
    # bounded by sample_rows, so every task can have it
    labelled = stash(docs.join(F.broadcast(known), F.col(key) == F.col("__key")).select(F.col(text).alias("text"), "toxic", F.pmod(F.xxhash64("__key", F.lit(seed + 1)), F.lit(20)).alias("part")))
    yes, total = labelled.agg(F.sum("toxic"), F.count("*")).first()
    base = float(yes or 0) / total if total else 0.0
    model = ToxicityModel({}, None, None, base)
    if not total or base in (0.0, 1.0):
        return model
    model.lexicon = learn_lexicon(labelled.where("part < 9"), lexicon_size)
    rows = stash(model.featured(labelled.where("part >= 9"), "text", ["toxic", "part"]))
    train = VectorAssembler(inputCols=FEATURES, outputCol="__x").transform(rows.where("part < 15"))
    if train.select("toxic").distinct().count() < 2:
        return model
    model.trees = GBTClassifier(featuresCol="__x", labelCol="toxic", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=seed).fit(train)
    held = model.raw(rows.where("part >= 15")).withColumn("toxic", F.col("toxic").cast("double"))
    if held.isEmpty():
        held = model.raw(rows).withColumn("toxic", F.col("toxic").cast("double"))
    model.calibration = IsotonicRegression(featuresCol="raw", labelCol="toxic", predictionCol="score").fit(held)
    return model
