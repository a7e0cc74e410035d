"""A hierarchical navigable small-world graph in numpy, built and searched many vectors at a time."""

from __future__ import annotations

import numpy as np

DEGREE = 16
BUILD_BEAM = 64
BATCH = 256


class Graph:
    """Unit vectors with links on levels; level 0 holds all, each higher one about 1 in DEGREE.

    Vectors are inserted in batches that double in size, the highest levels first. A batch searches
    the graph so far and its own members, keeps for each vector the neighbours that are nearer to it
    than to any neighbour kept before, and fills up with the nearest of the others.
    """

    def __init__(self, vectors: np.ndarray, heights: np.ndarray):
        self.x = vectors
        n = len(vectors)
        order = np.argsort(-heights, kind="stable")
        self.links = [np.full((n, DEGREE * (2 if level == 0 else 1)), -1, np.int32) for level in range(int(heights.max(initial=0)) + 1)]
        self.entry = int(order[0]) if n else -1
        done = 1
        while done < n:
            batch = order[done : done + min(done, BATCH)]
            self.insert(batch, order[:done], heights)
            done += len(batch)

    @classmethod
    def stored(cls, vectors: np.ndarray, heights: np.ndarray, links: np.ndarray, levels: int) -> Graph:
        """A graph from its links, level by level from the lowest, as they were built."""
        out, n, at = cls.__new__(cls), len(vectors), 0
        out.x, out.links = vectors, []
        for level in range(levels):
            width = DEGREE * (2 if level == 0 else 1)
            out.links.append(links[at : at + n * width].reshape(n, width))
            at += n * width
        out.entry = int(np.argsort(-heights, kind="stable")[0])
        return out

    def insert(self, batch: np.ndarray, there: np.ndarray, heights: np.ndarray) -> None:
        starts = np.full(len(batch), self.entry)
        for level in range(len(self.links) - 1, -1, -1):
            here = heights[batch] >= level
            known, _ = self.beam(self.x[batch], starts[:, None], level, BUILD_BEAM if here.any() else 1)
            starts = np.where(known[:, 0] >= 0, known[:, 0], starts)
            own = batch[here]
            if not len(own):
                continue
            # Members of the batch see each other as well.
            peers = np.broadcast_to(own, (len(own), len(own)))
            candidates = np.where(np.concatenate([known[here], peers], 1) == own[:, None], -1, np.concatenate([known[here], peers], 1))
            self.links[level][own] = self.choose(own, candidates, self.links[level].shape[1])
            self.link_back(own, level)

    def cosines(self, queries: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Each query's cosines with its row of places."""
        return (self.x[places] @ queries[:, :, None])[:, :, 0]

    def choose(self, nodes: np.ndarray, candidates: np.ndarray, width: int) -> np.ndarray:
        """For each node up to ``width`` of its candidates, diverse ones first."""
        likeness = self.cosines(self.x[nodes], candidates)
        likeness[candidates < 0] = -np.inf
        some = min(candidates.shape[1], 2 * width)
        best = np.argsort(-likeness, 1, kind="stable")[:, :some]
        candidates, likeness = np.take_along_axis(candidates, best, 1), np.take_along_axis(likeness, best, 1)
        near = self.x[candidates]
        between = near @ near.transpose(0, 2, 1)
        kept = np.zeros(candidates.shape, bool)
        for c in range(some):
            nearest = np.where(kept, between[:, c], -np.inf).max(1)
            kept[:, c] = (likeness[:, c] > nearest) & (likeness[:, c] > -np.inf) & (kept.sum(1) < width)
        rank = np.argsort(~kept, 1, kind="stable")[:, :width]
        out = np.take_along_axis(np.where(likeness > -np.inf, candidates, -1), rank, 1)
        return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)

    def link_back(self, nodes: np.ndarray, level: int) -> None:
        links = self.links[level]
        target, source = links[nodes].ravel(), np.repeat(nodes, links.shape[1])
        target, source = target[target >= 0], source[target >= 0]
        order = np.lexsort((-np.einsum("nd,nd->n", self.x[target], self.x[source]), target))
        target, source = target[order], source[order]
        owners, begin, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(begin, count)
        new = np.full((len(owners), links.shape[1]), -1, np.int32)
        fits = place < links.shape[1]
        new[np.repeat(np.arange(len(owners)), count)[fits], place[fits]] = source[fits]
        for i in range(0, len(owners), BATCH):
            part = owners[i : i + BATCH]
            both = np.concatenate([links[part], new[i : i + BATCH]], 1)
            both.sort(1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            links[part] = self.choose(part, both, links.shape[1])

    def beam(self, queries: np.ndarray, starts: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``width`` vectors met on one level and their cosines, best first, -1 where fewer were met."""
        n, rows = len(queries), np.arange(len(queries))[:, None]
        seen = np.zeros((n, len(self.x)), bool)
        seen[rows, starts] = True
        ids = np.full((n, width), -1, np.int64)
        cosines = np.full((n, width), -np.inf)
        take = min(width, starts.shape[1])
        first = self.cosines(queries, starts)
        best = np.argsort(-first, 1, kind="stable")[:, :take]
        ids[:, :take], cosines[:, :take] = np.take_along_axis(starts, best, 1), np.take_along_axis(first, best, 1)
        open_ = ids >= 0
        several = max(2, width // 16)
        while open_.any():
            active = np.flatnonzero(open_.any(1))
            # Rows are sorted: the first open entries are the best.
            at = np.argsort(~open_[active], 1, kind="stable")[:, :several]
            chosen = np.take_along_axis(open_[active], at, 1)
            open_[active[:, None], at] = False
            near = self.links[level][np.take_along_axis(ids[active], at, 1)].astype(np.int64)
            near[~chosen] = -1
            near = near.reshape(len(active), -1)
            near[seen[active[:, None], near]] = -1
            near.sort(1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            valid = near >= 0
            near = near[:, valid.any(0)] if valid.any() else near[:, :1]
            valid = near >= 0
            seen[np.broadcast_to(active[:, None], near.shape)[valid], near[valid]] = True
            cos = self.cosines(queries[active], near)
            cos[~valid] = -np.inf
            all_ids, all_cos = np.concatenate([ids[active], near], 1), np.concatenate([cosines[active], cos], 1)
            all_open = np.concatenate([open_[active], valid], 1)
            best = np.argsort(-all_cos, 1, kind="stable")[:, :width]
            ids[active], cosines[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_cos, best, 1)
            open_[active] = np.take_along_axis(all_open, best, 1) & (cosines[active] > -np.inf)
        ids[cosines == -np.inf] = -1
        return ids, cosines

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``width`` vectors for each query and their cosines."""
        starts = np.full((len(queries), 1), self.entry)
        for level in range(len(self.links) - 1, 0, -1):
            found, _ = self.beam(queries, starts, level, 1)
            starts = found[:, :1]
        return self.beam(queries, starts, 0, width)
