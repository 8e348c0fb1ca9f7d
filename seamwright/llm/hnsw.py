"""Hierarchical navigable small-world graphs as flat neighbour arrays, built and searched in batches.

A graph holds the vectors of one shard.  Node levels are geometric (by a hash of the id, so
that a repeated task gives the same graph).  The nodes above level 0 are few and are linked
exactly; the others are inserted in batches of at most ``batch`` nodes: a batch is searched
for in the graph built so far and compared with itself, gets diverse neighbours, and is
linked back.  What is asked of a graph is always searched for in the finished graph.  All
distance work is done for whole batches with numpy.
"""

from __future__ import annotations

import numpy as np


def _top(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest per row, descending."""
    if sims.shape[1] > k:
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        sims, ids = np.take_along_axis(sims, at, 1), np.take_along_axis(ids, at, 1)
    at = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(sims, at, 1), np.take_along_axis(ids, at, 1)


class Graph:
    """``x``: unit vectors (n, d) float32; ``seeds``: an integer per vector that fixes its level."""

    def __init__(self, x: np.ndarray, seeds: np.ndarray, m: int = 16, ef: int = 128, batch: int = 512):
        self.x, self.m, self.m0, self.ef = x, m, 2 * m, ef
        n = len(x)
        u = (_mix(seeds.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
        level = np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(m)).astype(int) if n else np.zeros(0, int)
        order = np.lexsort((_mix(seeds.astype(np.uint64) + np.uint64(7)), -level))
        self.layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (nodes, position of node or -1, neighbours)
        for lv in range(1, int(level.max(initial=0)) + 1):
            nodes = order[level[order] >= lv]
            if len(nodes) < 2 * m and self.layers:
                break
            pos = np.full(n, -1, np.int32)
            pos[nodes] = np.arange(len(nodes), dtype=np.int32)
            self.layers.append((nodes, pos, self._exact(nodes, m)))
        self.nbr = np.full((n, self.m0), -1, np.int32)
        self.deg = np.zeros(n, np.int32)
        done = 0
        upper = int((level > 0).sum())
        while done < n:
            new = order[done : done + (max(upper, 32) if done == 0 else min(done, batch))]
            self._insert(new, done)
            done += len(new)

    # -- building ----------------------------------------------------------------
    def _exact(self, nodes: np.ndarray, m: int) -> np.ndarray:
        """Diverse neighbours of a few nodes among themselves, as node numbers."""
        out = np.full((len(nodes), m), -1, np.int32)
        for a in range(0, len(nodes), 2048):
            part = nodes[a : a + 2048]
            sims = self.x[part] @ self.x[nodes].T
            sims[np.arange(len(part)), a + np.arange(len(part))] = -2
            s, at = _top(sims, np.broadcast_to(nodes, sims.shape), min(3 * m, len(nodes)))
            out[a : a + 2048] = self._diverse(s, at, m)
        return out

    def _diverse(self, sims: np.ndarray, ids: np.ndarray, m: int) -> np.ndarray:
        """Per row, up to m of the candidates (descending) none of which is nearer to one
        chosen before than to the row's own vector; filled up with the nearest others."""
        rows, c = ids.shape
        out = np.full((rows, m), -1, np.int32)
        for a in range(0, rows, 1024):
            s, i = sims[a : a + 1024], ids[a : a + 1024]
            v = self.x[np.maximum(i, 0)]
            between = np.matmul(v, v.transpose(0, 2, 1))
            ok = (i >= 0) & (s > -1.5)
            chosen = np.zeros_like(ok)
            count = np.zeros(len(i), int)
            for j in range(c):
                near = np.where(chosen, between[:, :, j], -2).max(1)
                take = ok[:, j] & (near < s[:, j]) & (count < m)
                chosen[:, j] = take
                count += take
            rank = np.where(chosen, 0, np.where(ok, 1, 2)) * c + np.arange(c)
            at = np.argsort(rank, axis=1, kind="stable")[:, :m]
            got = np.take_along_axis(i, at, 1)
            got[~np.take_along_axis(ok, at, 1)] = -1
            out[a : a + 1024, : got.shape[1]] = got
        return out

    def _insert(self, new: np.ndarray, done: int) -> None:
        c = min(self.ef, 3 * self.m)
        linked: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(new), 1024):
            part = new[a : a + 1024]
            sims = self.x[part] @ self.x[new].T
            sims[np.arange(len(part)), a + np.arange(len(part))] = -2
            s, i = _top(sims, np.broadcast_to(new, sims.shape), min(c, len(new)))
            if done:
                s2, i2 = self.search(self.x[part], c)
                s, i = _top(np.hstack([s, s2]), np.hstack([i, i2]), c)
            linked.append((part, self._diverse(s, i, self.m)))
        for part, links in linked:
            self.nbr[part, : links.shape[1]] = links
            self.deg[part] = (links >= 0).sum(1)
        part = np.concatenate([p for p, _ in linked])
        links = np.concatenate([x for _, x in linked])
        src = np.repeat(part, links.shape[1]).reshape(links.shape)
        keep = links >= 0
        self._link_back(links[keep], src[keep])

    def _link_back(self, to: np.ndarray, new: np.ndarray) -> None:
        """Adds ``new`` to the neighbours of ``to``; lists that are full are chosen anew."""
        sims = np.einsum("ij,ij->i", self.x[to], self.x[new])
        at = np.lexsort((new, -sims, to))
        to, new, sims = to[at], new[at], sims[at]
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, int)
        rank = np.arange(len(to)) - np.repeat(first, np.diff(np.r_[first, len(to)]))
        # already linked the other way
        linked = (self.nbr[to] == new[:, None]).any(1)
        slot = self.deg[to] + rank
        fits = (slot < self.m0) & ~linked
        full = np.unique(to[(slot >= self.m0) & ~linked])
        easy = fits & ~np.isin(to, full)
        self.nbr[to[easy], slot[easy]] = new[easy]
        np.add.at(self.deg, to[easy], 1)
        self._compact(np.unique(to[easy]))
        if len(full):
            width = 2 * self.m0
            for a in range(0, len(full), 2048):
                some = full[a : a + 2048]
                row = np.full(len(self.x), -1, np.int32)
                row[some] = np.arange(len(some), dtype=np.int32)
                mine = (row[to] >= 0) & ~linked & (rank < width)
                cand = np.full((len(some), self.m0 + width), -1, np.int32)
                cand[:, : self.m0] = self.nbr[some]
                cand[row[to[mine]], self.m0 + rank[mine]] = new[mine]
                s = np.einsum("ijk,ik->ij", self.x[np.maximum(cand, 0)], self.x[some])
                s[cand < 0] = -2
                s, i = _top(s, cand, cand.shape[1])
                chosen = self._diverse(s[:, : 3 * self.m], i[:, : 3 * self.m], self.m0)
                self.nbr[some] = chosen
                self.deg[some] = (chosen >= 0).sum(1)

    def _compact(self, nodes: np.ndarray) -> None:
        """Neighbours to the front of their rows."""
        if len(nodes):
            rows = self.nbr[nodes]
            at = np.argsort(rows < 0, axis=1, kind="stable")
            self.nbr[nodes] = np.take_along_axis(rows, at, 1)
            self.deg[nodes] = (rows >= 0).sum(1)

    # -- searching ---------------------------------------------------------------
    def search(self, q: np.ndarray, k: int, ef: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, nodes), both (len(q), k) and descending; -1 where there are fewer."""
        ef = max(k, ef or self.ef)
        n = len(self.x)
        out_s = np.full((len(q), k), -2, np.float32)
        out_i = np.full((len(q), k), -1, np.int32)
        if not n:
            return out_s, out_i
        step = max(64, min(1024, 40_000_000 // n))
        for a in range(0, len(q), step):
            part = q[a : a + step]
            start: np.ndarray | None = None
            for nodes, pos, nbr in reversed(self.layers):
                if start is None:
                    _, start = _top(part @ self.x[nodes].T, np.broadcast_to(nodes, (len(part), len(nodes))), min(2, len(nodes)))
                else:
                    _, start = self._beam(part, start, 4, pos, nbr)
            if start is None:
                start = np.zeros((len(part), 1), np.int64)
            s, i = self._beam(part, start, ef, None, self.nbr)
            w = min(k, s.shape[1])
            out_s[a : a + step, :w], out_i[a : a + step, :w] = s[:, :w], i[:, :w]
        return out_s, out_i

    def _beam(self, q: np.ndarray, start: np.ndarray, ef: int, pos: np.ndarray | None, nbr: np.ndarray):
        """The ``ef`` best nodes met from ``start`` on; the best open nodes of each beam are followed, several at once."""
        b, n, m = len(q), len(self.x), nbr.shape[1]
        wide = max(1, min(4, ef // 4))
        seen = np.zeros((b, n + 1), bool)
        ids = np.full((b, ef), -1, np.int32)
        sims = np.full((b, ef), -2, np.float32)
        w = min(ef, start.shape[1])
        ids[:, :w] = start[:, :w]
        r, c = np.nonzero(ids >= 0)
        sims[r, c] = np.einsum("ij,ij->i", q[r], self.x[ids[r, c]])
        seen[r, ids[r, c]] = True
        open_ = ids >= 0
        rows = np.arange(b)
        while True:
            rows = rows[open_[rows].any(1)]
            if not len(rows):
                break
            score = np.where(open_[rows], sims[rows], -3)
            best = np.argpartition(-score, wide - 1, axis=1)[:, :wide] if ef > wide else np.broadcast_to(np.arange(ef), score.shape)
            live = np.take_along_axis(score, best, 1) > -3
            node = np.take_along_axis(ids[rows], best, 1)
            open_[rows[:, None], best] = False
            near = nbr[node if pos is None else pos[node]]
            near[~live] = -1
            near = near.reshape(len(rows), -1)
            near.sort(axis=1)
            fresh = (near >= 0) & ~seen[rows[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            r, c = np.nonzero(fresh)
            if not len(r):
                continue
            other = near[r, c]
            at = rows[r]
            seen[at, other] = True
            s = np.einsum("ij,ij->i", q[at], self.x[other])
            use = s > sims[rows].min(1)[r]
            r, other, s = r[use], other[use], s[use]
            if not len(r):
                continue
            # only beams that take something in are sorted anew
            first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            count = np.diff(np.r_[first, len(r)])
            col = np.arange(len(r)) - np.repeat(first, count)
            line = np.repeat(np.arange(len(first)), count)
            t = rows[r[first]]
            width = int(count.max())
            all_s = np.full((len(t), ef + width), -2, np.float32)
            all_i = np.full((len(t), ef + width), -1, np.int32)
            all_o = np.zeros((len(t), ef + width), bool)
            all_s[:, :ef], all_i[:, :ef], all_o[:, :ef] = sims[t], ids[t], open_[t]
            all_s[line, ef + col], all_i[line, ef + col], all_o[line, ef + col] = s, other, True
            keep = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            sims[t] = np.take_along_axis(all_s, keep, 1)
            ids[t] = np.take_along_axis(all_i, keep, 1)
            open_[t] = np.take_along_axis(all_o, keep, 1)
        return _top(sims, ids, ef)

    def neighbours(self, k: int, ef: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, other, similarity): the k best others of each node, searched for in the finished graph from the node on."""
        n = len(self.x)
        ef = max(k + 1, ef or self.ef)
        step = max(64, min(1024, 40_000_000 // max(1, n)))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, n, step):
            me = np.arange(a, min(a + step, n), dtype=np.int32)
            s, i = self._beam(self.x[me], me[:, None], min(ef, n), None, self.nbr)
            ok = (i >= 0) & (i != me[:, None])
            ok &= np.cumsum(ok, axis=1) <= k
            r, c = np.nonzero(ok)
            out.append((me[r].astype(np.int64), i[r, c].astype(np.int64), s[r, c]))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(0, np.float32)
        return tuple(np.concatenate([o[j] for o in out]) for j in range(3))


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
