"""A hierarchical navigable small-world graph over unit vectors, built and searched in NumPy for many queries at once."""

from __future__ import annotations

import pickle

import numpy as np

#: Neighbours of a node in the upper layers and in the lowest; beam while building; nodes expanded at a time.
M, M0, EF_BUILD, EXPAND = 12, 24, 48, 4
#: A vector this close to a node joins the node's bucket instead of being a node.
BUCKET = 0.97


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, whatever their magnitude."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Graph:
    """Vectors are float32 for steering; callers verify in double precision."""

    def __init__(self, dim: int, room: int):
        self.x = np.zeros((room, dim), np.float32)
        self.n = 0
        self.levels: list[np.ndarray] = [np.full((room, M0), -1, np.int32)]
        self.level_of = np.zeros(room, np.int8)
        self.entry = 0

    # ------------------------------------------------------------ search

    def _greedy(self, q: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        links = self.levels[level]
        best = np.einsum("bd,bd->b", q, self.x[at])
        while True:
            near = links[at]
            sims = np.einsum("bd,bmd->bm", q, self.x[near])
            sims[near < 0] = -2
            k = sims.argmax(1)
            top = sims[np.arange(len(at)), k]
            better = top > best
            if not better.any():
                return at
            at = np.where(better, near[np.arange(len(at)), k], at)
            best = np.where(better, top, best)

    def _beam(self, q: np.ndarray, at: np.ndarray, level: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the ef best nodes found for each query, best first; -1 where there are fewer."""
        links, b = self.levels[level], len(q)
        rows = np.arange(b)[:, None]
        ids, sims = np.full((b, ef), -1, np.int32), np.full((b, ef), -2, np.float32)
        done = np.ones((b, ef), bool)
        seen = np.zeros((b, self.n), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = at, np.einsum("bd,bd->b", q, self.x[at]), False
        seen[np.arange(b), at] = True
        live = np.arange(b)
        while len(live):
            open_sims = np.where(done[live], -3, sims[live])
            take = np.argsort(-open_sims, axis=1)[:, :EXPAND]
            r = np.arange(len(live))[:, None]
            usable = open_sims[r, take] > -3
            go = usable.any(1)
            live, take, usable = live[go], take[go], usable[go]
            if not len(live):
                break
            r = rows[: len(live)]
            who = np.where(usable, ids[live[:, None], take], 0)
            done[live[:, None], take] = True
            near = links[who].reshape(len(live), -1)
            fresh = (near >= 0) & np.repeat(usable, links.shape[1], axis=1)
            safe = np.where(fresh, near, 0)
            fresh &= ~seen[live[:, None], safe]
            # the same node may come from two of those expanded
            order = np.argsort(np.where(fresh, safe, -1), axis=1, kind="stable")
            sorted_ids = np.take_along_axis(np.where(fresh, safe, -1), order, 1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
            fresh &= ~twice
            s = np.full(near.shape, -2, np.float32)
            k, c = np.nonzero(fresh)
            s[k, c] = np.einsum("nd,nd->n", q[live[k]], self.x[safe[k, c]])
            seen[live[k], safe[k, c]] = True
            every_s = np.concatenate([sims[live], s], 1)
            every_i = np.concatenate([ids[live], np.where(fresh, safe, -1).astype(np.int32)], 1)
            every_d = np.concatenate([done[live], ~fresh], 1)
            top = np.argpartition(-every_s, ef - 1, axis=1)[:, :ef]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(every_s, top, 1), axis=1, kind="stable"), 1)
            ids[live], sims[live], done[live] = (np.take_along_axis(a, top, 1) for a in (every_i, every_s, every_d))
        return ids, sims

    def search(self, q: np.ndarray, ef: int, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
        ef = max(1, min(ef, self.n))
        found = []
        for a in range(0, len(q), at_once):
            part = np.ascontiguousarray(q[a : a + at_once], np.float32)
            at = np.full(len(part), self.entry)
            for level in range(len(self.levels) - 1, 0, -1):
                at = self._greedy(part, at, level)
            found.append(self._beam(part, at, 0, ef))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    # ------------------------------------------------------------ building

    def _choose(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` neighbours for each row, best first: those closer to it than to any chosen before, then the closest others."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        b, c = ids.shape
        v = self.x[np.maximum(ids, 0)]
        between = np.einsum("bcd,bed->bce", v, v)
        keep = np.zeros((b, c), bool)
        for k in range(c):
            nearest = np.where(keep, between[:, k, :], -2).max(1)
            keep[:, k] = (ids[:, k] >= 0) & (nearest < sims[:, k]) & (keep.sum(1) < most)
        rank = np.where(ids < 0, 3 * c, np.where(keep, 0, c) + np.arange(c))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(ids, order, 1)

    def _connect(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, level: int) -> None:
        links = self.levels[level]
        most = links.shape[1]
        chosen = self._choose(self.x[nodes], ids, sims, min(most, M))
        links[nodes[:, None], np.arange(chosen.shape[1])] = chosen
        back_to, come = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        ok = back_to >= 0
        back_to, come = back_to[ok], come[ok]
        order = np.argsort(back_to, kind="stable")
        back_to, come = back_to[order], come[order]
        first = np.flatnonzero(np.concatenate([[True], back_to[1:] != back_to[:-1]])) if len(back_to) else []
        count = np.diff(np.append(first, len(back_to)))
        for a in range(0, len(first), 256):
            f, cnt = first[a : a + 256], np.minimum(count[a : a + 256], 4 * most)
            who = back_to[f]
            new = np.full((len(f), int(cnt.max())), -1, np.int64)
            r = np.repeat(np.arange(len(f)), cnt)
            place = np.arange(len(r)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
            new[r, place] = come[np.repeat(f, cnt) + place]
            old = links[who].astype(np.int64)
            new[(new[:, :, None] == old[:, None, :]).any(2)] = -1
            every = np.concatenate([old, new], 1)
            s = np.einsum("bd,bcd->bc", self.x[who], self.x[np.maximum(every, 0)])
            s[every < 0] = -2
            full = (every >= 0).sum(1) > most
            tidy = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable"), 1)[:, :most]
            if full.any():
                tidy[full] = self._choose(self.x[who[full]], every[full], s[full], most)
            links[who[:, None], np.arange(tidy.shape[1])] = tidy

    def insert(self, x: np.ndarray, level: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> None:
        """Add a batch; found: its beam in the graph as it is."""
        a, z = self.n, self.n + len(x)
        self.x[a:z], self.level_of[a:z] = x, level
        nodes = np.arange(a, z)
        own = x.astype(np.float32) @ x.astype(np.float32).T
        np.fill_diagonal(own, -2)
        near = np.argsort(-own, axis=1)[:, :M]
        ids = np.concatenate([found[0], near + a], 1).astype(np.int64) if len(x) > 1 else found[0].astype(np.int64)
        sims = np.concatenate([found[1], np.take_along_axis(own, near, 1)], 1) if len(x) > 1 else found[1]
        while len(self.levels) <= int(level.max()):
            self.levels.append(np.full((len(self.x), M), -1, np.int32))
        self.n = z
        self._connect(nodes, ids, np.where(ids < 0, -2, sims), 0)
        for k in range(1, len(self.levels)):
            here = np.flatnonzero(self.level_of[: self.n] >= k)
            mine = nodes[level >= k]
            if len(mine) and len(here) > 1:
                s = self.x[mine] @ self.x[here].T
                s[mine[:, None] == here[None, :]] = -2
                top = np.argsort(-s, axis=1)[:, : 2 * M]
                self._connect(mine, here[top], np.take_along_axis(s, top, 1), k)
        highest = int(self.level_of[: self.n].max())
        self.entry = int(np.flatnonzero(self.level_of[: self.n] == highest)[0])


class Index:
    """Graph over one vector of each bucket; a bucket holds the vectors within BUCKET of its node."""

    def __init__(self, vectors: np.ndarray, seed: int = 1):
        """vectors: unit rows, double precision."""
        self.vectors = vectors
        n, dim = vectors.shape
        self.graph, self.node_vector = Graph(dim, n), np.zeros(n, np.int64)
        bucket = np.full(n, -1, np.int64)
        rng = np.random.default_rng(seed)
        at = 0
        while at < n:
            to = min(n, at + max(32, min(256, self.graph.n)))
            batch = np.arange(at, to)
            x = vectors[batch]
            if self.graph.n:
                ids, sims = self.graph.search(x, EF_BUILD)
                best = np.take_along_axis(ids, sims.argmax(1)[:, None], 1)[:, 0]
                exact = np.einsum("bd,bd->b", x, vectors[self.node_vector[best]])
                joined = exact >= BUCKET
                bucket[batch[joined]] = best[joined]
            else:
                ids, sims, joined = np.full((len(x), 1), -1), np.full((len(x), 1), -2.0), np.zeros(len(x), bool)
            rest = np.flatnonzero(~joined)
            close = np.triu(x[rest] @ x[rest].T >= BUCKET, 1)
            leader = np.full(len(rest), -1)
            for k in np.flatnonzero(close.any(1)):
                if leader[k] < 0:
                    leader[close[k] & (leader < 0)] = k
            lead = leader < 0
            number = self.graph.n + np.cumsum(lead) - 1
            new = rest[lead]
            self.node_vector[self.graph.n : self.graph.n + len(new)] = batch[new]
            bucket[batch[new]] = number[lead]
            bucket[batch[rest[~lead]]] = number[leader[~lead]]
            if len(new):
                level = np.minimum(np.floor(-np.log(rng.random(len(new))) / np.log(M)), 8).astype(np.int8)
                self.graph.insert(x[new], level, (ids[new], sims[new]))
            at = to
        self.order = np.argsort(bucket, kind="stable")
        self.edge = np.searchsorted(bucket[self.order], np.arange(self.graph.n + 1))

    def dumps(self) -> bytes:
        g = self.graph
        keep = {"x": g.x[: g.n], "levels": [a[: g.n] for a in g.levels], "level_of": g.level_of[: g.n], "entry": g.entry}
        return pickle.dumps((self.vectors, self.node_vector[: g.n], self.order, self.edge, keep), protocol=5)

    @classmethod
    def loads(cls, raw: bytes) -> Index:
        self = cls.__new__(cls)
        self.vectors, self.node_vector, self.order, self.edge, keep = pickle.loads(raw)
        g = self.graph = Graph.__new__(Graph)
        g.x, g.levels, g.level_of, g.entry, g.n = keep["x"], keep["levels"], keep["level_of"], keep["entry"], len(keep["x"])
        return self

    def within(self, q: np.ndarray, least: float, ef: int):
        """(query row, vectors) for all found with cosine >= least in double precision; beams widen while their worst is near enough to matter."""
        angle = min(np.pi, np.arccos(least) + np.arccos(BUCKET))
        reach = float(np.cos(angle)) - 1e-4
        todo = np.arange(len(q))
        while len(todo):
            ids, sims = self.graph.search(q[todo], ef)
            full = (sims[:, -1] >= reach) & (ids[:, -1] >= 0) if ids.shape[1] < self.graph.n else np.zeros(len(todo), bool)
            for k in np.flatnonzero(~full):
                nodes = ids[k][(sims[k] >= reach) & (ids[k] >= 0)]
                if len(nodes):
                    members = np.concatenate([self.order[self.edge[i] : self.edge[i + 1]] for i in nodes])
                    hit = members[self.vectors[members] @ q[todo[k]] >= least]
                    if len(hit):
                        yield int(todo[k]), hit
            todo, ef = todo[full], 2 * ef

    def audit(self, least: float, ef: int, n: int = 96, seed: int = 7) -> float:
        """Share of vectors that a query turned away from them, to a cosine just above ``least``, finds."""
        rng = np.random.default_rng(seed)
        pick = rng.choice(len(self.vectors), min(n, len(self.vectors)), replace=False)
        x = self.vectors[pick]
        side = rng.standard_normal(x.shape)
        side -= (side * x).sum(1, keepdims=True) * x
        size = np.linalg.norm(side, axis=1, keepdims=True)
        c = least + (1 - least) * 0.1
        q = c * x + np.sqrt(1 - c * c) * side / np.maximum(size, 1e-12)
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        found = {k: set(hit.tolist()) for k, hit in self.within(q, least, ef)}
        return sum(int(p) in found.get(k, ()) for k, p in enumerate(pick)) / max(1, len(pick))
