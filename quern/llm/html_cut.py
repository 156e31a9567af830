"""Minimum-cut labelling of page blocks: content on the source's side, boilerplate on the sink's."""

from __future__ import annotations

import numpy as np

from quern.llm.html_blocks import Block, blocks_of, features_of
from quern.llm.html_weights import WEIGHTS

NEXT_COST = 0.5  # blocks next to each other in the page
NEXT_SECTION_COST = 0.1  # the same, across the border of a section
SIBLING_COST = 0.4  # one block and the next with the same parent section


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: adjacency in page order and proximity in the document tree."""
    edges, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEXT_COST if blocks[i - 1].section == block.section else NEXT_SECTION_COST))
        if block.section in last and last[block.section] != i - 1:
            edges.append((last[block.section], i, SIBLING_COST))
        last[block.section] = i
    return edges


def min_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling that minimizes sum over nodes labelled against their gain of |gain|, plus the costs of edges whose ends differ.

    A node whose gain outweighs all its edges has the label of its gain in every minimum; such nodes are
    labelled first and pass their edges on to their neighbours' gains, again and again. Max-flow decides the rest.
    On ties a node is no content.
    """
    n = len(gains)
    gains = list(gains)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, cost in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + cost
            near[b][a] = near[b].get(a, 0.0) + cost
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if label[i] is not None or abs(gains[i]) <= sum(near[i].values()):
            continue
        label[i] = gains[i] > 0
        for j, cost in near[i].items():
            del near[j][i]
            gains[j] += cost if label[i] else -cost
            todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i in _source_side(rest, gains, near):
            label[i] = True
    return [bool(x) for x in label]


def _source_side(nodes: list[int], gains: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that the source reaches in the residual graph of a maximum flow, found by Dinic's algorithm."""
    source, sink = -1, -2
    capacity: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in nodes:
        capacity[i] = dict(near[i])
    for i in nodes:
        if gains[i] > 0:
            capacity[source][i], capacity[i][source] = gains[i], 0.0
        elif gains[i] < 0:
            capacity[i][sink], capacity[sink][i] = -gains[i], 0.0
    tiny = 1e-12
    while True:
        level, queue = {source: 0}, [source]
        for u in queue:
            for v, c in capacity[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return {u for u in level if u >= 0}
        rest = {u: iter(list(capacity[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                pairs = list(zip(path, path[1:]))
                flow = min(capacity[a][b] for a, b in pairs)
                for a, b in pairs:
                    capacity[a][b] -= flow
                    capacity[b][a] = capacity[b].get(a, 0.0) + flow
                cut = next(k for k, (a, b) in enumerate(pairs) if capacity[a][b] <= tiny)
                del path[cut + 1 :]
                continue
            for v in rest[u]:
                if capacity[u][v] > tiny and level.get(v, -1) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()
                if path:
                    level[u] = -1


def label_blocks(blocks: list[Block]) -> list[bool]:
    gains = (np.array([features_of(b) for b in blocks], dtype=float) @ np.array(WEIGHTS)).tolist() if blocks else []
    return min_cut(gains, edges_of(blocks))


def main_text(page: str | None) -> str:
    """The text of a page's content blocks, one line each, in page order; "" for an empty page or one without content."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks)) if keep)
