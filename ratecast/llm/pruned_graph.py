"""Directed graphs over vectors with pruned edges, built and searched in
batches with numpy: a step of every search at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FIRST = 1024       # nodes that start a graph
BATCH = 512
Start = Callable[[np.ndarray], np.ndarray]  # queries to a node each


def _squares(x: np.ndarray, ids: np.ndarray, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its nodes ``ids``, up to rounding."""
    return norm[ids] - 2 * np.einsum("bcd,bd->bc", x[ids], q) + np.einsum("bd,bd->b", q, q)[:, None]


class Graph:
    """``near`` holds each node's neighbours, -1 where there are fewer."""

    def __init__(self, v: np.ndarray, near: np.ndarray | None = None, medoid: int = 0):
        top = np.abs(v).max() if v.size else 1.0
        self.x = (v / (top or 1.0)).astype(np.float32)
        self.top = top or 1.0
        self.norm = np.einsum("nd,nd->n", self.x, self.x)
        self.near, self.medoid = near, medoid

    def build(self, degree: int, alpha: float, beam: int, order: np.ndarray | None = None, start: Start | None = None, again: bool = True) -> Graph:
        """Nodes enter in ``order`` (else the medoid and then at random) in
        growing batches; searches begin at the first node and at those that
        ``start`` names for the queries.  ``again``: a second round over all
        nodes searches the finished graph."""
        n = len(self.x)
        self.near = np.full((n, degree), -1, np.int32)
        if order is None:
            self.medoid = int(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1).argmin())
            order = np.random.default_rng(n).permutation(n)
            order = np.concatenate([[self.medoid], order[order != self.medoid]])
        order = order.astype(np.int32)
        self.medoid = int(order[0])
        first = order[:FIRST]
        cross = self.norm[first][None] - 2 * self.x[first] @ self.x[first].T
        nearest = np.argsort(cross, axis=1, kind="stable")[:, :beam + 1]
        self._enter(first, first[nearest], alpha)
        at = len(first)
        while at < n:
            size = max(FIRST // 4, at // 8)
            self._enter(order[at:at + size], None, alpha, beam, start)
            at += size
        for i in range(0, n if again and n > FIRST else 0, 1024):
            self._enter(order[i:i + 1024], None, alpha, beam, start)
        return self

    def _enter(self, nodes: np.ndarray, proposed: np.ndarray | None, alpha: float, beam: int = 0, start: Start | None = None) -> None:
        if proposed is None:
            q = [self.x[nodes[i:i + BATCH]] for i in range(0, len(nodes), BATCH)]
            found = np.concatenate([self.search(x, beam, start(x) if start else None)[0] for x in q])
            proposed = np.concatenate([found, self.near[nodes]], axis=1)
        for i in range(0, len(nodes), BATCH):
            self.near[nodes[i:i + BATCH]] = self._prune(nodes[i:i + BATCH], proposed[i:i + BATCH], alpha)
        self._back(nodes, alpha)

    def _prune(self, nodes: np.ndarray, ids: np.ndarray, alpha: float) -> np.ndarray:
        """Neighbours kept for each node of ``ids`` (-1, the node itself and repeats do not count)."""
        degree = self.near.shape[1]
        ids = np.sort(np.where(ids == nodes[:, None], -1, ids), axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        safe = np.maximum(ids, 0)
        d = np.where(ids < 0, np.inf, _squares(self.x, safe, self.x[nodes], self.norm))
        pick = np.argsort(d, axis=1, kind="stable")
        ids, d = np.take_along_axis(ids, pick, 1), np.take_along_axis(d, pick, 1)
        safe = np.maximum(ids, 0)
        v, norm = self.x[safe], self.norm[safe]
        between = norm[:, :, None] + norm[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        alive, rows = ids >= 0, np.arange(len(nodes))
        out = np.full((len(nodes), degree), -1, np.int32)
        for j in range(degree):
            best = alive.argmax(axis=1)  # nearest left
            has = alive[rows, best]
            if not has.any():
                break
            out[has, j] = ids[rows[has], best[has]]
            alive &= ~((alpha * alpha * between[rows, best] <= d) & has[:, None])
            alive[rows, best] = False
        return out

    def _back(self, nodes: np.ndarray, alpha: float) -> None:
        """Edges back to ``nodes`` from the neighbours they have kept."""
        to, degree = self.near[nodes], self.near.shape[1]
        source, target = np.broadcast_to(nodes[:, None], to.shape)[to >= 0], to[to >= 0]
        known = (self.near[target] == source[:, None]).any(axis=1)
        source, target = source[~known], target[~known]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        who, begin, count = np.unique(target, return_index=True, return_counts=True)
        # nodes with few new edges are not padded to those with many
        for low, high in ((0, 32), (32, 128), (128, len(self.x))):
            some = np.flatnonzero((count > low) & (count <= high))
            for i in range(0, len(some), BATCH if high <= 128 else 16):
                w = some[i:i + (BATCH if high <= 128 else 16)]
                place = np.arange(count[w].max())
                add = np.where(place < count[w][:, None], source[np.minimum(begin[w][:, None] + place, len(source) - 1)], -1)
                both = np.concatenate([self.near[who[w]], add], axis=1)
                full = (both >= 0).sum(axis=1) > degree
                self.near[who[w[~full]]] = -np.sort(-both[~full], axis=1)[:, :degree]
                if full.any():
                    self.near[who[w[full]]] = self._prune(who[w[full]], both[full], alpha)

    def search(self, q: np.ndarray, beam: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes found for each query (scaled as ``x``),
        nearest first, -1 where fewer; and their squared distances.  Searches
        begin at the medoid and, per query, at the node in ``start``."""
        n = len(q)
        ids = np.full((n, beam), -1, np.int32)
        val = np.full((n, beam), np.inf, np.float32)
        todo = np.zeros((n, beam), bool)
        ids[:, 0], todo[:, 0] = self.medoid, True
        val[:, 0] = _squares(self.x, ids[:, :1], q, self.norm)[:, 0]
        seen = np.zeros((n, len(self.x)), bool)
        seen[:, self.medoid] = True
        live = np.arange(n)
        if start is not None and beam > 1:
            other = np.flatnonzero(start != self.medoid)
            ids[other, 1], todo[other, 1], seen[other, start[other]] = start[other], True, True
            val[other, 1] = _squares(self.x, ids[other, 1:2], q[other], self.norm)[:, 0]
            swap = np.argsort(val[:, :2], axis=1, kind="stable")
            for a in (ids, val, todo):
                a[:, :2] = np.take_along_axis(a[:, :2], swap, 1)
        while len(live):
            best = todo[live].argmax(axis=1)  # kept in order: the nearest not yet expanded
            has = todo[live, best]
            live, best = live[has], best[has]
            if not len(live):
                break
            todo[live, best] = False
            step = self.near[ids[live, best]]
            fresh = (step >= 0) & ~seen[live[:, None], step]
            r, c = np.nonzero(fresh)
            node = step[r, c]
            seen[live[r], node] = True
            value = np.full(step.shape, np.inf, np.float32)
            value[r, c] = self.norm[node] - 2 * np.einsum("nd,nd->n", self.x[node], q[live[r]])
            value += np.einsum("bd,bd->b", q[live], q[live])[:, None]
            all_val = np.concatenate([val[live], value], axis=1)
            pick = np.argsort(all_val, axis=1, kind="stable")[:, :beam]
            val[live] = np.take_along_axis(all_val, pick, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, step, -1)], axis=1), pick, 1)
            todo[live] = np.take_along_axis(np.concatenate([todo[live], fresh], axis=1), pick, 1)
        return ids, val

    def exact(self, q: np.ndarray, k: int) -> np.ndarray:
        """The ``k`` nearest nodes by distance to all."""
        d = self.norm[None] - 2 * q @ self.x.T
        return np.argsort(d, axis=1, kind="stable")[:, :k]
