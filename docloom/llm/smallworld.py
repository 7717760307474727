"""A hierarchical navigable small-world graph over the vectors of one shard, in flat arrays.

Nodes are numbered so that those of a layer are the first ones: layer ``l`` has every ``LINKS ** l``-th
part of the nodes, node 0 is in all of them and is where every walk starts. A layer's links are one array,
a row for each node, -1 where a link is free; the lowest layer has twice as many for a node.

Nodes are put in by batches, and the walks of a batch (or of a batch of queries) go in step: each step takes
the nearest node not yet left of every walk, measures its neighbours, and keeps the ``width`` nearest seen.
Nodes of one batch meet each other by measuring all of them.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Links of a node in upper layers; twice as many in the lowest. Also the ratio of the layers' sizes.
LINKS = 16
#: Nodes that a walk keeps while nodes are put in.
BUILD_WIDTH = 64
#: Nodes or queries that walk in step.
BATCH = 256


class Graph(NamedTuple):
    sizes: list[int]
    links: list[np.ndarray]

    def flat(self) -> bytes:
        return b"".join(a.tobytes() for a in self.links)


def layer_sizes(n: int) -> list[int]:
    """Nodes of each layer from the lowest, the highest having fewer than ``LINKS`` (one layer for few nodes)."""
    sizes = [n]
    while sizes[-1] >= LINKS * 2:
        sizes.append(sizes[-1] // LINKS)
    return sizes


def from_flat(sizes: list[int], raw: bytes) -> Graph:
    """The graph whose arrays ``Graph.flat`` has joined."""
    links, at, values = [], 0, np.frombuffer(raw, dtype="<i4")
    for layer, n in enumerate(sizes):
        wide = LINKS * (1 if layer else 2)
        links.append(values[at : at + n * wide].reshape(n, wide))
        at += n * wide
    return Graph(sizes, links)


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors to walk by: single precision, the largest component about one, so that squares stay finite."""
    most = np.abs(x).max(initial=0.0)
    return (x / most if most > 0 else x).astype(np.float32)


def _squares(x: np.ndarray, nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = x[nodes] - q
    return np.einsum("ij,ij->i", gap, gap)


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, width) nodes found near each row of ``q``, nearest first, and their squared distances; -1 and inf where fewer.

    ``start`` has the node that each walk begins at.
    """
    rows = len(q)
    seen = np.zeros((rows, len(links) + 1), dtype=bool)  # the last place is that of free links
    seen[:, -1] = True
    ids = np.full((rows, width), -1, dtype=np.int32)
    dist = np.full((rows, width), np.inf, dtype=np.float32)
    left = np.zeros((rows, width), dtype=bool)
    ids[:, 0], dist[:, 0] = start, _squares(x, start, q)
    seen[np.arange(rows), start] = True
    going = np.arange(rows)
    while len(going):
        open_ = ~left[going] & (ids[going] >= 0)
        at = open_.argmax(axis=1)
        more = open_[np.arange(len(going)), at]
        going, at = going[more], at[more]
        if not len(going):
            break
        left[going, at] = True
        near = links[ids[going, at]]
        fresh = ~seen[going[:, None], near]
        seen[going[:, None], near] = True
        r, c = np.nonzero(fresh)
        new = np.full(near.shape, np.inf, dtype=np.float32)
        new[r, c] = _squares(x, near[r, c], q[going[r]])
        better = (new < dist[going, -1][:, None]).any(axis=1)
        rows_, near, new = going[better], near[better], new[better]
        if len(rows_):
            all_dist = np.concatenate((dist[rows_], new), axis=1)
            order = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
            dist[rows_] = np.take_along_axis(all_dist, order, axis=1)
            ids[rows_] = np.where(
                np.isinf(dist[rows_]), -1, np.take_along_axis(np.concatenate((ids[rows_], near), axis=1), order, axis=1)
            )
            left[rows_] = np.take_along_axis(np.concatenate((left[rows_], np.zeros(near.shape, dtype=bool)), axis=1), order, axis=1)
    return ids, dist


def _chosen(x: np.ndarray, q: np.ndarray, ids: np.ndarray, dist: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's candidates (nearest first) at most ``keep``: those nearer to ``q`` than to one chosen before, then the nearest others."""
    gap = x[ids] - q[:, None, :]
    dist = np.where(ids >= 0, dist, np.inf)
    apart = np.where(np.isfinite(dist), dist, 0)
    apart = apart[:, :, None] + apart[:, None, :] - 2 * np.matmul(gap, gap.transpose(0, 2, 1))
    good = np.isfinite(dist)
    blocked = np.zeros(ids.shape, dtype=bool)
    taken = np.zeros(ids.shape, dtype=bool)
    for c in range(ids.shape[1]):
        now = good[:, c] & ~blocked[:, c] & (taken.sum(axis=1) < keep)
        taken[:, c] = now
        blocked |= now[:, None] & (apart[:, c, :] < dist)
    order = np.argsort(np.where(taken, 0, np.where(good, 1, 2)), axis=1, kind="stable")[:, :keep]
    ids, dist = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)
    return np.where(np.isfinite(dist), ids, -1), dist


def _link_back(x: np.ndarray, links: np.ndarray, to: np.ndarray, node: np.ndarray, dist: np.ndarray) -> None:
    """Adds the links ``to`` -> ``node``; a full row keeps the choice of ``_chosen``."""
    known = (links[to] == node[:, None]).any(axis=1)
    to, node, dist = to[~known], node[~known], dist[~known]
    order = np.lexsort((dist, to))
    to, node, dist = to[order], node[order], dist[order]
    wide = links.shape[1]
    while len(to):
        first = np.r_[True, to[1:] != to[:-1]]
        place = np.arange(len(to)) - np.maximum.accumulate(np.where(first, np.arange(len(to)), 0))
        now = place < wide
        owners, row = np.unique(to[now], return_inverse=True)
        new = np.full((len(owners), wide), -1, dtype=np.int32)
        gap = np.full((len(owners), wide), np.inf, dtype=np.float32)
        new[row, place[now]], gap[row, place[now]] = node[now], dist[now]
        full = (links[owners] >= 0).sum(axis=1) + (new >= 0).sum(axis=1) > wide
        for k in np.flatnonzero(~full):
            own = links[owners[k]]
            free, add = np.flatnonzero(own < 0), new[k][new[k] >= 0]
            own[free[: len(add)]] = add
        for part in np.array_split(np.flatnonzero(full), 1 + full.sum() // BATCH):
            if not len(part):
                continue
            u = owners[part]
            old = links[u]
            far = np.where(old >= 0, ((x[old] - x[u][:, None, :]) ** 2).sum(axis=2), np.inf).astype(np.float32)
            ids, all_dist = np.concatenate((old, new[part]), axis=1), np.concatenate((far, gap[part]), axis=1)
            by = np.argsort(all_dist, axis=1, kind="stable")
            links[u] = _chosen(x, x[u], np.take_along_axis(ids, by, axis=1), np.take_along_axis(all_dist, by, axis=1), wide)[0]
        to, node, dist = to[~now], node[~now], dist[~now]


def build(x: np.ndarray) -> Graph:
    """The graph of the scaled vectors ``x``, whose order should be random."""
    sizes = layer_sizes(len(x))
    links = [np.full((n, LINKS * (1 if layer else 2)), -1, dtype=np.int32) for layer, n in enumerate(sizes)]
    done = 0
    while done < len(x):
        q = x[done : done + min(BATCH, max(64, done))]
        n = len(q)
        start = np.zeros(n, dtype=np.int32)
        inner = np.stack([((q - v) ** 2).sum(axis=1) for v in q])
        np.fill_diagonal(inner, np.inf)
        for layer in reversed(range(len(sizes))):
            own = min(n, max(0, sizes[layer] - done))
            if done and own < n:
                start[own:] = walk(x, links[layer], q[own:], start[own:], 1)[0][:, 0]
            if not own:
                continue
            mates = np.argsort(inner[:own, :own], axis=1, kind="stable")[:, : BUILD_WIDTH // 2].astype(np.int32)
            dist = np.take_along_axis(inner[:own, :own], mates, axis=1)
            ids = mates + done
            if done:
                found, far = walk(x, links[layer], q[:own], start[:own], BUILD_WIDTH)
                start[:own] = found[:, 0]
                ids, dist = np.concatenate((found, ids), axis=1), np.concatenate((far, dist), axis=1)
                order = np.argsort(dist, axis=1, kind="stable")
                ids, dist = np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)
            ids, dist = _chosen(x, q[:own], ids, dist, LINKS)
            # A node of the batch may have been linked back already by one before it: rows are written before that.
            links[layer][done : done + own, : ids.shape[1]] = ids
            i, j = np.nonzero(ids >= 0)
            _link_back(x, links[layer], ids[i, j], (done + i).astype(np.int32), dist[i, j])
        done += n
    return Graph(sizes, links)


def nearest(x: np.ndarray, graph: Graph, q: np.ndarray, width: int) -> np.ndarray:
    """(rows, width) nodes that walks from the top find near each row of ``q``; -1 where fewer."""
    out = []
    for at in range(0, len(q), BATCH):
        part = q[at : at + BATCH]
        start = np.zeros(len(part), dtype=np.int32)
        for links in reversed(graph.links[1:]):
            start = walk(x, links, part, start, 1)[0][:, 0]
        out.append(walk(x, graph.links[0], part, start, width)[0])
    return np.concatenate(out) if out else np.empty((0, width), dtype=np.int32)
