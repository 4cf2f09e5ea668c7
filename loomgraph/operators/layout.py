"""Layered layout of every graph of a corpus.

Each document is laid out by itself, so documents are dealt out by id and a task holds one
at a time: back edges are turned round, nodes ranked by the longest path to them, and each
layer ordered by the mean place of its neighbours in sweeps down and up.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sizes in pixels, and sweeps.
WIDTH, HEIGHT, LAYER_GAP, NODE_GAP, MARGIN, SWEEPS = 172, 54, 88, 30, 48, 6


def back_edges(order: list[str], out: dict[str, list[str]]) -> set[tuple[str, str]]:
    """Edges that lead to a node still being visited, depth first in document order, without recursion."""
    state: dict[str, int] = {}
    back: set[tuple[str, str]] = set()
    for start in order:
        if start in state:
            continue
        state[start] = 1
        stack = [(start, iter(out[start]))]
        while stack:
            at, onward = stack[-1]
            for to in onward:
                if state.get(to) == 1:
                    back.add((at, to))
                elif to not in state:
                    state[to] = 1
                    stack.append((to, iter(out[to])))
                    break
            else:
                state[at] = 2
                stack.pop()
    return back


def ranks(order: list[str], forward: set[tuple[str, str]]) -> dict[str, int]:
    """Longest path to each node over edges without cycles."""
    into, out = defaultdict(int), defaultdict(list)
    for a, b in sorted(forward):
        into[b] += 1
        out[a].append(b)
    rank = dict.fromkeys(order, 0)
    ready = [n for n in order if not into[n]]
    while ready:
        at = ready.pop()
        for to in out[at]:
            rank[to] = max(rank[to], rank[at] + 1)
            into[to] -= 1
            if not into[to]:
                ready.append(to)
    return rank


def layers(order: list[str], rank: dict[str, int], forward: set[tuple[str, str]]) -> list[list[str]]:
    """Nodes by rank, those near one another close together."""
    rows: list[list[str]] = [[] for _ in range(max(rank.values(), default=-1) + 1)]
    for n in order:
        rows[rank[n]].append(n)
    near: dict[bool, dict[str, list[str]]] = {True: defaultdict(list), False: defaultdict(list)}
    for a, b in forward:
        near[True][b].append(a)
        near[False][a].append(b)
    for sweep in range(SWEEPS):
        down = sweep % 2 == 0
        place = {n: i for row in rows for i, n in enumerate(row)}
        for row in rows if down else reversed(rows):
            mean = {n: sum(place[m] for m in near[down][n]) / len(near[down][n]) if near[down][n] else place[n] for n in row}
            row.sort(key=lambda n: mean[n])
            place.update((n, i) for i, n in enumerate(row))
    return rows


def laid_out(nodes: DataFrame, edges: DataFrame, across: bool = True) -> DataFrame:
    """(doc_id, id, layer, place, x, y, width, height): where each node stands and how large its document's canvas is.

    `across`: layers run from left to right, else from top to bottom.  Edges to undeclared
    nodes and loops are ignored; of nodes of one id the first counts.
    """

    def one(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        order = list(dict.fromkeys(n.sort_values("ord")["id"]))
        known, out = set(order), defaultdict(list)
        for a, b in zip(e.sort_values("ord")["source"], e.sort_values("ord")["target"], strict=True) if len(e) else ():
            if a in known and b in known and a != b:
                out[a].append(b)
        back = back_edges(order, out)
        forward = {(b, a) if (a, b) in back else (a, b) for a in out for b in out[a]}
        forward = {(a, b) for a, b in forward if (b, a) not in back or (a, b) not in back}
        rows = layers(order, ranks(order, forward), forward)
        doc = n["doc_id"].iloc[0] if len(n) else 0
        longest = max(map(len, rows), default=0)
        size = [2 * MARGIN + len(rows) * (WIDTH if across else HEIGHT) + max(0, len(rows) - 1) * LAYER_GAP, 2 * MARGIN + longest * (HEIGHT if across else WIDTH) + max(0, longest - 1) * NODE_GAP]
        result = []
        for layer, row in enumerate(rows):
            span = len(row) * (HEIGHT if across else WIDTH) + (len(row) - 1) * NODE_GAP
            for place, node in enumerate(row):
                along = MARGIN + layer * ((WIDTH if across else HEIGHT) + LAYER_GAP)
                beside = (size[1] - span) / 2 + place * ((HEIGHT if across else WIDTH) + NODE_GAP)
                x, y = (along, beside) if across else (beside, along)
                w, h = size if across else size[::-1]
                result.append((doc, node, layer, place, float(x), float(y), float(w), float(h)))
        return pd.DataFrame(result, columns=["doc_id", "id", "layer", "place", "x", "y", "width", "height"])

    n, e = nodes.select("doc_id", "ord", "id"), edges.select("doc_id", "ord", "source", "target")
    return n.groupBy("doc_id").cogroup(e.groupBy("doc_id")).applyInPandas(one, "doc_id long, id string, layer int, place int, x double, y double, width double, height double")
