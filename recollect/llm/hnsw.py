"""Hierarchical navigable small-world graphs in numpy, built and searched many vectors at a time.

All searches of a block advance in step: each expands its best unexpanded
candidates, and one array operation scores all their neighbours. Layers are
built from the top down; a layer's vectors are inserted in growing blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LINKS = 16
EXPANDED = 3
#: Vectors whose neighbours are compared with each other at a time.
SPREAD_BLOCK = 256


@dataclass
class Graph:
    vectors: np.ndarray  # float32, of unit length
    layers: list[tuple[np.ndarray, np.ndarray]]  # from the top: members, and their neighbours (-1: none) by vector

    def search(self, queries: np.ndarray, beam: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """For each query the vectors of its beam and their cosines, -1 where it has fewer."""
        ids, cosines = [np.empty((0, beam), np.int64)], [np.empty((0, beam), np.float32)]
        for i in range(0, len(queries), block):
            q = queries[i : i + block]
            start = np.full((len(q), 1), self.layers[0][0][0])
            for _, links in self.layers[:-1]:
                start = _walk(self.vectors, links, q, start, 4)[0]
            a, b = _walk(self.vectors, self.layers[-1][1], q, start, beam)
            ids.append(a)
            cosines.append(b)
        return np.concatenate(ids), np.concatenate(cosines)


def _walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(q)
    seen = np.zeros((n, len(x)), bool)
    ids = np.full((n, beam), -1, np.int64)
    cos = np.full((n, beam), -2, np.float32)
    done = np.ones((n, beam), bool)
    live = np.arange(n)
    fresh = start
    while len(live):
        fresh = np.sort(fresh, axis=1)
        ok = fresh >= 0
        ok[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
        r, c = np.nonzero(ok)
        unseen = ~seen[live[r], fresh[r, c]]
        r, c = r[unseen], c[unseen]
        new = fresh[r, c]
        seen[live[r], new] = True
        score = np.full(fresh.shape, -2, np.float32)
        score[r, c] = np.einsum("ij,ij->i", q[live[r]], x[new])
        all_cos = np.concatenate([cos[live], score], axis=1)
        all_ids = np.concatenate([ids[live], np.where(score > -2, fresh, -1)], axis=1)
        all_done = np.concatenate([done[live], score == -2], axis=1)
        top = np.argpartition(-all_cos, beam - 1, axis=1)[:, :beam]
        cos[live], ids[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_cos, all_ids, all_done))
        open_ = np.where(done[live], np.float32(-3), cos[live])
        k = min(EXPANDED, beam)
        best = np.argpartition(-open_, k - 1, axis=1)[:, :k]
        use = np.take_along_axis(open_, best, 1) > -3
        alive = use.any(axis=1)
        live, best, use = live[alive], best[alive], use[alive]
        done[live[:, None], best] = True
        chosen = ids[live[:, None], best]
        fresh = np.where(use[:, :, None], links[np.where(use, chosen, 0)], -1).reshape(len(live), -1) if len(live) else fresh[:0]
    return ids, cos


def _spread(x: np.ndarray, of: np.ndarray, ids: np.ndarray, cos: np.ndarray, most: int) -> np.ndarray:
    """Neighbours that are nearer to the vector than to each other first, then the nearest of the rest."""
    if len(ids) > SPREAD_BLOCK:
        return np.concatenate([_spread(x, of[i : i + SPREAD_BLOCK], ids[i : i + SPREAD_BLOCK], cos[i : i + SPREAD_BLOCK], most) for i in range(0, len(ids), SPREAD_BLOCK)])
    order = np.argsort(-cos, axis=1, kind="stable")
    ids, cos = np.take_along_axis(ids, order, 1), np.take_along_axis(cos, order, 1)
    valid = (ids >= 0) & (ids != of[:, None])
    v = x[np.maximum(ids, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    kept = np.zeros(ids.shape, bool)
    count = np.zeros(len(ids), np.int64)
    for j in range(ids.shape[1]):
        near = (kept[:, :j] & (between[:, j, :j] > cos[:, j, None])).any(axis=1)
        kept[:, j] = valid[:, j] & ~near & (count < most)
        count += kept[:, j]
    rank = np.where(kept, 0, np.where(valid, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(ids, order, 1), -1)


def build(vectors: np.ndarray, keys: np.ndarray, links: int = LINKS, beam: int = 48) -> Graph:
    """``keys``: a hash for each vector, which settles its highest layer."""
    n = len(vectors)
    x = np.ascontiguousarray(vectors, np.float32)
    u = ((keys.astype(np.uint64) >> np.uint64(11)).astype(float) + 1) / 2.0**53
    level = np.floor(-np.log(u) / np.log(links)).astype(int)
    # the top layer has a few vectors at least to choose from
    tops = [top for top in range(level.max(initial=0), -1, -1) if (level >= top).sum() >= min(n, links)]
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    for layer in tops:
        width = 4 * links if layer == 0 else 2 * links
        order = np.flatnonzero(level >= layer)
        order = order[np.argsort(-level[order], kind="stable")]
        table = np.full((n, width), -1, np.int32)
        used = np.zeros(n, np.int32)
        done = 0
        while done < len(order):
            new = order[done : done + max(32, min(512, done // 2))]
            if done == 0:
                ids = np.broadcast_to(new, (len(new), len(new))).copy()
                cos = x[new] @ x[new].T
            else:
                start = np.full((len(new), 1), order[0])
                for _, upper in layers:
                    start = _walk(x, upper, x[new], start, 4)[0]
                start = np.where(used[np.maximum(start, 0)] > 0, start, -1)
                ids, cos = _walk(x, table, x[new], np.hstack([start, np.full((len(new), 1), order[0])]), beam)
                # vectors of a block find each other, too
                own = x[new] @ x[new].T
                np.fill_diagonal(own, -2)
                near = np.argpartition(-own, min(8, len(new) - 1), axis=1)[:, :8]
                ids = np.hstack([ids, new[near]])
                cos = np.hstack([cos, np.take_along_axis(own, near, 1)])
            chosen = _spread(x, new, ids, cos, width // 2)
            _link(x, table, used, np.repeat(new, chosen.shape[1]), chosen.ravel(), width)
            _link(x, table, used, chosen.ravel(), np.repeat(new, chosen.shape[1]), width)
            done += len(new)
        layers.append((order, table))
    return Graph(x, layers)


def _link(x: np.ndarray, table: np.ndarray, used: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> None:
    """Adds b to a's neighbours; a list that is full is cut to its half that spreads best."""
    ok = (a >= 0) & (b >= 0)
    a, b = a[ok], b[ok]
    while len(a):
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        first = np.concatenate([[True], a[1:] != a[:-1]])
        begin = np.flatnonzero(first)
        place = np.arange(len(a)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(a)]]))) + used[a]
        fits = place < width
        known = (table[a] == b[:, None]).any(axis=1)
        table[a[fits & ~known], place[fits & ~known]] = b[fits & ~known]
        nodes = a[first]
        _compact(table, used, nodes)
        a, b = a[~fits & ~known], b[~fits & ~known]
        full = np.unique(a)
        if len(full):
            ids = table[full].astype(np.int64)
            cos = np.where(ids >= 0, np.einsum("ij,ikj->ik", x[full], x[np.maximum(ids, 0)]), -2)
            table[full] = -1
            table[full, : width // 2] = _spread(x, full, ids, cos, width // 2)
            _compact(table, used, full)


def _compact(table: np.ndarray, used: np.ndarray, nodes: np.ndarray) -> None:
    rows = table[nodes]
    order = np.argsort(rows < 0, axis=1, kind="stable")
    table[nodes] = np.take_along_axis(rows, order, 1)
    used[nodes] = (rows >= 0).sum(axis=1)
