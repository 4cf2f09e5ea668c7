"""Substring dedup by hashing lines, paragraphs or sentences.

Texts fall into units, units of every length are normalised and hashed to 128 bits, the
hashes are grouped over all documents (counted and reduced before they are shuffled), and
of every unit that occurs again all but the earliest ranked occurrence are repeats.  Repeats
that follow each other make a run; runs of at least `min_words` words are given as spans to
remove, unit by unit, with their offsets in the original text.  Shorter ones are taken for
chance and stay.

Units end at every newline; paragraphs at runs of two or more; sentences also behind `.`,
`!` or `?` where a space or tab follows, so that a passage put amid a line is found by the
sentences inside it.  Spans leave out white space at both ends.

Defined results: null and empty texts have no units; documents of equal rank follow their
key, nulls first; repeated rows of one key and text count as one document, whose spans are
given once; other texts of the same key are documents of their own; very long texts are
read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

_SPACE = " \t\n\r\x0b\x0c"
_BORDER = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n{2,}"), "sentence": re.compile(r"\n|(?<=[.!?])(?=[ \t])")}


def spans_of(text: str, border: re.Pattern[str]) -> Iterator[tuple[int, int]]:
    """(start, end) of each unit, without white space around it; none that is empty."""
    at = 0
    for m in [*border.finditer(text), None]:
        to, after = (m.start(), m.end()) if m else (len(text), len(text))
        unit = text[at:to]
        short = unit.lstrip(_SPACE)
        start = to - len(short)
        if short := short.rstrip(_SPACE):
            yield start, start + len(short)
        at = after


def unit_table(docs: DataFrame, key: str, text: str, rank: Column, unit: str) -> DataFrame:
    """(key, digest, rank, place, start, end, words, h1, h2): every unit of every text; digest: of the text, place: of the unit in it."""
    border = _BORDER[unit]
    names = ["key", "digest", "rank", "place", "start", "end", "words", "h1", "h2"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                rows, places, starts, ends, sizes, digests = [], [], [], [], [], []
                for i, t in enumerate(some.column(3).to_pylist()):
                    for place, (start, end) in enumerate(spans_of(t or "", border)):
                        words = t[start:end].encode().lower().split()
                        rows.append(i)
                        places.append(place)
                        starts.append(start)
                        ends.append(end)
                        sizes.append(len(words))
                        digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                take = pa.array(rows, pa.int64())
                h1 = pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64())
                h2 = pa.array([int.from_bytes(d[8:], "little", signed=True) for d in digests], pa.int64())
                counted = [pa.array(x, pa.int64()) for x in (places, starts, ends, sizes)]
                yield pa.RecordBatch.from_arrays([*(some.column(i).take(take) for i in range(3)), *counted, h1, h2], names=names)

    narrow = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("digest"), rank.alias("rank"), F.col(text).alias("text"))
    kind = {f.name: f.dataType.simpleString() for f in narrow.schema}
    return narrow.mapInArrow(read, f"key {kind['key']}, digest long, rank {kind['rank']}, place long, start long, end long, words long, h1 long, h2 long")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", rank: Column | None = None, unit: str = "sentence", min_words: int = 20) -> DataFrame:
    """One row for each span to remove: key, start, end (exclusive, in characters), and the
    occurrence that stays (kept_key, kept_start), with the number of occurrences, the words
    of the run, and the digest of the text that the span is of.

    `rank` orders documents, lowest first; by default their key does.
    """
    units = stash(unit_table(docs, key, text, F.col(key) if rank is None else rank, unit))
    here = F.struct("rank", "key", "start", "digest")
    # set down, so that the rows of one very common unit can be dealt to several tasks where the two meet
    first = stash(units.groupBy("h1", "h2").agg(F.min(here).alias("kept"), F.count("*").alias("copies")).where("copies > 1"))
    again = units.join(first, ["h1", "h2"]).where(~here.eqNullSafe(F.col("kept")))
    in_text = Window.partitionBy("key", "digest").orderBy("place")
    once = again.withColumn("before", F.lag("place").over(in_text)).withColumn("run", F.col("place") - F.dense_rank().over(in_text)).where("before is null or before < place")
    runs = once.withColumn("run_words", F.sum("words").over(Window.partitionBy("key", "digest", "run"))).where(F.col("run_words") >= min_words)
    return runs.select(F.col("key").alias(key), "start", "end", F.col("kept.key").alias(f"kept_{key}"), F.col("kept.start").alias("kept_start"), "copies", "run_words", "digest")


def without_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the spans, as `repeated_spans` gives them, taken out of their texts; white space around a span stays."""
    gone = spans.groupBy(F.col(key).alias("__key"), F.col("digest").alias("__digest")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__gone"))
    ends = F.concat(F.transform("__gone", lambda s: s["start"]), F.array(F.length(text).cast("long")))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("__gone", lambda s: s["end"]))
    pieces = F.zip_with(begins, ends, lambda b, e: F.substring(F.col(text), (b + 1).cast("int"), (e - b).cast("int")))
    cleaned = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(pieces, ""))
    met = docs.join(gone, F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(F.col(text)) == F.col("__digest")), "left")
    return met.withColumn(text, cleaned).select(*docs.columns)
