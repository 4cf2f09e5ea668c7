"""Bounded-space online best-fit packing of token sequences.

Documents become token ids plus an end id; only those longer than a sequence are cut, into
full pieces after a first one that may be shorter.  Pieces then meet a fixed number of open
bins, found by free space in a bitset: a piece goes to the bin that it fills best; if none
has room and all are in use, the fullest closes.  Only (document, piece, length) rows are
shuffled for packing, never ids, and each task packs its stream with that fixed state.
At most that number of sequences is left unfilled when a task ends.

Defined results: a null or empty text is the end id alone, one piece of length 1; repeated
rows are documents of their own and are packed each; ids of null keys are kept; extra
columns of the input are not passed on.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, those that the `tokenizers` file gives.

    `ranks_file` holds the same byte-level vocabulary as ranks for a faster library; it is
    used for texts on which both agree by construction: of letters up to U+024F (the split
    into words knows the same letters, numbers and white space there), without the
    special token's string, and not of extraordinary length.  Others take the slower way.
    """

    _ODD = re.compile("[^\x00-\u024f]")
    _made: dict[tuple[str, str | None], Encoder] = {}

    def __init__(self, tokenizer_file: str, ranks_file: str | None, most_chars: int = 1 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most_chars, self.fast = most_chars, None
        if ranks_file:
            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def get(cls, tokenizer_file: str, ranks_file: str | None) -> Encoder:
        """One for each Python worker, whatever the number of its tasks."""
        if (tokenizer_file, ranks_file) not in cls._made:
            cls._made[tokenizer_file, ranks_file] = cls(tokenizer_file, ranks_file)
        return cls._made[tokenizer_file, ranks_file]

    def encode(self, text: str) -> bytes:
        plain = self.fast is not None and len(text) <= self.most_chars and not any(s in text for s in self.specials) and not self._ODD.search(text)
        ids = self.fast.encode_ordinary(text) if plain else self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of `n` ids: a first one that may be shorter, then full ones."""
    head = n % size or size
    return [(0, min(head, n))] + [(at, size) for at in range(head, n, size)]


class OpenBins:
    """At most `most` open bins of `size`; place() says where a piece goes."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.by_space: dict[int, list[int]] = defaultdict(list)
        self.bits = 0  # bit f: some open bin has f free
        self.count = self.made = 0

    def _pop(self, free: int) -> int:
        bins = self.by_space[free]
        b = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            b = self._pop(free)
        else:
            if self.count >= self.most:  # the fullest: least free space
                self._pop((self.bits & -self.bits).bit_length() - 1)
            free, b = self.size, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_space[left].append(b)
            self.bits |= 1 << left
            self.count += 1
        return b, self.size - free


def token_pieces(docs: DataFrame, tokenizer_file: str, ranks_file: str | None, size: int, end_id: int, key: str, text: str) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document; `size` bounds length."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(tokenizer_file, ranks_file)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                source, numbers = [], []
                for row, t in enumerate(some.column(1).to_pylist()):
                    ids = encoder.encode(t or "") + end
                    for piece, (start, length) in enumerate(cut(len(ids) // 4, size)):
                        source.append(row)
                        numbers.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                cols = zip(*numbers, strict=True) if numbers else [(), (), (), ()]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(source, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[key, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(tidy(pieces), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(pieces: DataFrame, size: int, open_bins: int, order: list[str], parts: int) -> DataFrame:
    """`pieces` with sequence_id and offset; each of `parts` tasks packs its own stream."""
    columns = pieces.columns
    dealt = pieces.repartition(parts, *[F.col(c) for c in order]).sortWithinPartitions(F.xxhash64(*order), *order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(size, open_bins), None
        for batch in batches:
            if not batch.num_rows:
                continue
            if base is None:  # the task's number in the high bits keeps its sequences apart
                base = batch.column(len(columns))[0].as_py() << 40
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.withColumn("part", F.spark_partition_id()).mapInArrow(tidy(pack), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_file: str, ranks_file: str | None = None, size: int = 2048, end_id: int = 0, open_bins: int = 256, key: str = "doc_id", text: str = "text", docs_per_task: int = 16384) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    `tokenizer_file` and `ranks_file` are paths that every executor has.  `docs_per_task` sets how many
    documents share a stream; at most `open_bins` sequences of each stream end unfilled.
    """
    parts = max(1, -(-docs.count() // docs_per_task))
    pieces = token_pieces(docs, tokenizer_file, ranks_file, size, end_id, key, text)
    return best_fit(pieces, size, open_bins, [key, "piece"], parts)
