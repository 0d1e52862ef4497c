"""A robust-pruned directed graph over unit vectors, built and searched in batches.

Points are inserted batch by batch: a greedy beam search through the graph so far proposes neighbours, relaxed distance
pruning (a neighbour is dropped if a kept one is closer to it than the point, by the factor ``alpha``) keeps diverse ones,
and edges back are added under the same rule.  Everything works on whole batches of points with numpy.
"""

from __future__ import annotations

import numpy as np


class Graph:
    def __init__(self, vectors: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, batch: int = 512, seed: int = 7):
        """``vectors``: unit vectors, one a row."""
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.n, self.degree, self.alpha = len(self.x), degree, alpha
        # Lists may grow to twice the degree before they are thinned again, so that few are thinned at each batch.
        self.edges = np.full((self.n, 2 * degree), -1, np.int32)
        order = np.random.default_rng(seed).permutation(self.n).astype(np.int32)
        self.entries = order[: min(16, self.n)]
        done = min(self.n, max(batch // 2, degree + 1))
        first = order[:done]
        self._insert_exact(first)
        while done < self.n:
            size = min(batch, done, self.n - done)
            self._insert(order[done : done + size], beam)
            done += size
        long = np.flatnonzero((self.edges >= 0).sum(1) > degree).astype(np.int32)
        if len(long):
            self._thin(long, self.edges[long])
        self.edges = np.ascontiguousarray(self.edges[:, :degree])

    def _set(self, nodes: np.ndarray, ids: np.ndarray) -> None:
        self.edges[nodes] = -1
        self.edges[nodes, : ids.shape[1]] = ids

    def _thin(self, nodes: np.ndarray, ids: np.ndarray) -> None:
        """Prunes candidate lists that come in no order and may hold repeats."""
        for at in range(0, len(nodes), 512):
            t, c = nodes[at : at + 512], ids[at : at + 512]
            sims = np.einsum("bcd,bd->bc", self.x[np.maximum(c, 0)], self.x[t])
            sims[c < 0] = -3
            by = np.argsort(-sims, axis=1)
            self._set(t, self._prune(t, np.take_along_axis(c, by, 1), np.take_along_axis(sims, by, 1)))

    def _insert_exact(self, nodes: np.ndarray) -> None:
        s = self.x[nodes] @ self.x[nodes].T
        np.fill_diagonal(s, -2)
        k = min(len(nodes) - 1, 3 * self.degree)
        if k <= 0:
            return
        near = np.argsort(-s, axis=1, kind="stable")[:, :k]
        self._set(nodes, self._prune(nodes, nodes[near], np.take_along_axis(s, near, 1)))
        self._link_back(nodes)

    def _insert(self, nodes: np.ndarray, beam: int) -> None:
        ids, sims = self.search(self.x[nodes], beam, beam)
        s = self.x[nodes] @ self.x[nodes].T
        np.fill_diagonal(s, -2)
        k = min(16, len(nodes) - 1)
        if k > 0:  # points of one batch do not find each other through the graph
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            ids = np.concatenate([ids, nodes[near]], 1)
            sims = np.concatenate([sims, np.take_along_axis(s, near, 1)], 1)
        by = np.argsort(-sims, axis=1, kind="stable")
        self._set(nodes, self._prune(nodes, np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)))
        self._link_back(nodes)

    def _prune(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Candidates (-1: none), nearest first, thinned to at most ``degree`` diverse ones."""
        out = np.full((len(nodes), self.degree), -1, np.int32)
        for at in range(0, len(nodes), 256):
            c, s = ids[at : at + 256], sims[at : at + 256]
            alive = (c >= 0) & (c != nodes[at : at + 256, None])
            v = self.x[np.maximum(c, 0)]
            between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
            to = 2 - 2 * s
            rows = np.arange(len(c))
            for j in range(self.degree):
                pick = alive.argmax(1)
                ok = alive[rows, pick]
                if not ok.any():
                    break
                out[at : at + 256][ok, j] = c[rows, pick][ok]
                alive &= ~(self.alpha * between[rows, pick] <= to)
                alive[rows, pick] = False
                alive &= c != c[rows, pick][:, None]
        return out

    def _link_back(self, nodes: np.ndarray) -> None:
        e = self.edges[nodes, : self.degree]
        src, dst = np.repeat(nodes, self.degree), e.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(dst):
            return
        near = np.concatenate([np.einsum("ij,ij->i", self.x[src[i : i + 65536]], self.x[dst[i : i + 65536]]) for i in range(0, len(src), 65536)])
        by = np.lexsort((-near, dst))  # the nearest first, should more come than are looked at
        src, dst = src[by], dst[by]
        targets, starts, counts = np.unique(dst, return_index=True, return_counts=True)
        most = int(min(counts.max(), 3 * self.degree))
        new = np.full((len(targets), most), -1, np.int32)
        place = np.arange(len(dst)) - np.repeat(starts, counts)
        keep = place < most
        new[np.repeat(np.arange(len(targets)), counts)[keep], place[keep]] = src[keep]
        old = self.edges[targets]
        for j in range(most):  # no node twice in a list, or a search would meet it twice
            new[(old == new[:, j : j + 1]).any(1), j] = -1
        all_ids = np.concatenate([old, new], 1)
        width = self.edges.shape[1]
        room = (all_ids >= 0).sum(1) <= width
        if room.any():
            packed = np.take_along_axis(all_ids[room], np.argsort(all_ids[room] < 0, axis=1, kind="stable"), 1)
            self._set(targets[room], packed[:, :width])
        if not room.all():
            self._thin(targets[~room], all_ids[~room])

    def search(self, queries: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best nodes a beam search finds for each query, nearest first (-1: none), and their similarities."""
        out_i, out_s = np.full((len(queries), k), -1, np.int32), np.full((len(queries), k), -3, np.float32)
        size = max(64, min(1024, 32_000_000 // max(1, self.n)))
        for at in range(0, len(queries), size):
            i, s = self._search(np.ascontiguousarray(queries[at : at + size], np.float32), beam)
            m = min(k, i.shape[1])
            out_i[at : at + size, :m], out_s[at : at + size, :m] = i[:, :m], s[:, :m]
        return out_i, out_s

    def _search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        b, e = len(q), self.entries
        seen = np.zeros((b, self.n), bool)
        seen[:, e] = True
        wide = max(beam, len(e))
        ids = np.full((b, wide), -1, np.int32)
        sims = np.full((b, wide), -3, np.float32)
        ids[:, : len(e)] = e
        sims[:, : len(e)] = q @ self.x[e].T
        waiting = np.where(ids >= 0, sims, np.float32(-4))  # similarities of what is not yet expanded
        worst = sims.min(1)
        active = np.arange(b)
        while True:
            at = waiting[active].argmax(1)
            ok = waiting[active, at] > -3.5
            active, at = active[ok], at[ok]
            if not len(active):
                break
            waiting[active, at] = -4
            near = self.edges[ids[active, at]]
            fresh = near >= 0
            fresh &= ~seen[active[:, None], near]
            r, c = np.nonzero(fresh)
            rr, nn = active[r], near[r, c]
            seen[rr, nn] = True
            s = np.einsum("ij,ij->i", self.x[nn], q[rr])
            ok = s > worst[rr]
            r, nn, s = r[ok], nn[ok], s[ok]
            if not len(nn):
                continue
            counts = np.bincount(r, minlength=len(active))
            rows = np.flatnonzero(counts)
            counts = counts[rows]
            most = int(counts.max())
            line = np.repeat(np.arange(len(rows)), counts)
            place = np.arange(len(nn)) - np.repeat(np.cumsum(counts) - counts, counts)
            new_s = np.full((len(rows), most), -3, np.float32)
            new_i = np.full((len(rows), most), -1, np.int32)
            new_s[line, place], new_i[line, place] = s, nn
            touched = active[rows]
            all_s = np.concatenate([sims[touched], new_s], 1)
            keep = np.argpartition(all_s, most - 1, axis=1)[:, most:] if most else slice(None)
            sims[touched] = kept = np.take_along_axis(all_s, keep, 1)
            ids[touched] = np.take_along_axis(np.concatenate([ids[touched], new_i], 1), keep, 1)
            open_s = np.where(new_i >= 0, new_s, np.float32(-4))
            waiting[touched] = np.take_along_axis(np.concatenate([waiting[touched], open_s], 1), keep, 1)
            worst[touched] = kept.min(1)
        by = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
