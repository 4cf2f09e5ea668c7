"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed into multiword Shift-And masks; one pass over the bytes of each
canonical URL simulates every rule at once, vectorised over all URLs of an Arrow batch.

A canonical URL is `.host#path`: `#` can stand in neither part, so a rule cannot match
across the border, and the leading dot lets `*.net` fit `net` and all its subdomains.

Defined results: a null URL, or one without `://`, has an empty host and path and fits no
rule with a host; ties between rules of one length go to the longer host, then to the
earlier rule; no fitting rule gives a null rule and `default`; repeated rows are judged
each by itself; extra columns of the input are not passed on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`verdict` for URLs of `host` and its subdomains whose path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"

    @property
    def glob(self) -> str:
        escaped = "".join(f"\\{c}" if c in "*?\\" else c for c in f".{self.host}#{self.path}")
        return f"*{escaped}*"


class GlobAutomaton:
    """All globs at once.  `*`: any run of bytes, `?`: one byte, `\\`: the next one literally.

    Each glob takes a start bit and one bit for each byte it consumes.  `step[c]` has the
    bits that byte `c` may enter, `stay` those before a `*`, which any byte leaves as is.
    """

    def __init__(self, globs: Iterable[str]):
        cells: list[tuple[int, int | None]] = []  # (bit, byte or None for any)
        stay, start, accept, bit = [], [], [], 0
        for glob in globs:
            start.append(bit)
            raw, i = glob.encode(), 0
            while i < len(raw):
                c = raw[i]
                if c == ord("*"):
                    stay.append(bit)
                else:
                    if c == ord("\\") and i + 1 < len(raw):
                        i += 1
                        c = raw[i]
                    elif c == ord("?"):
                        c = None
                    bit += 1
                    cells.append((bit, c))
                i += 1
            accept.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.accept = accept
        self.start, self.stay = self._mask(start), self._mask(stay)
        self.step = np.zeros((256, self.words), np.uint64)
        for b, c in cells:
            rows = slice(None) if c is None else c
            self.step[rows, b // 64] |= np.uint64(1 << (b % 64))

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def run(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix: text x glob."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        sorted_lengths = lengths[order]
        for pos in range(int(sorted_lengths[0]) if len(texts) else 0):
            live = int(np.searchsorted(-sorted_lengths, -pos, side="left"))
            d = state[:live]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[flat[begin[:live] + pos]]) | (d & self.stay)
        out = np.zeros((len(texts), len(self.accept)), bool)
        for g, b in enumerate(self.accept):
            out[order, g] = (state[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1) == 1
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without `://`."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.encode().lower().decode(), path


def judge_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """`key`, host, path, rule, verdict for each row of `pages`; a map without any shuffle."""
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), -len(rules[i].host), i))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton([rules[i].glob for i in ranked])
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            hits = automaton.run([f".{h}#{p}".encode() for h, p in parts])
            if ranked:
                first = np.where(hits.any(axis=1), hits.argmax(axis=1), len(ranked))
            else:
                first = np.zeros(len(parts), int)
            chosen = [rules[ranked[i]] if i < len(ranked) else None for i in first.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([r.name if r else None for r in chosen], pa.string()),
                    pa.array([r.verdict if r else default for r in chosen], pa.string()),
                ],
                names=[key, "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[key].dataType.simpleString()
    narrow = pages.select(F.col(key), F.col(url))
    return narrow.mapInArrow(judge, f"`{key}` {kind}, host string, path string, rule string, verdict string")
