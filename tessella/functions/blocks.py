"""Symmetric systems of small dense blocks, of which most are zero: one block per photo and per pair of photos."""

from __future__ import annotations

import heapq

import numpy as np


def least_degree_order(near: list[set[int]]) -> list[int]:
    """An order of elimination: the vertex of fewest neighbours first, whose neighbours then all become neighbours."""
    near = [set(n) for n in near]
    heap = [(len(n), i) for i, n in enumerate(near)]
    heapq.heapify(heap)
    done, order = [False] * len(near), []
    while heap:
        degree, i = heapq.heappop(heap)
        if done[i] or degree != len(near[i]):
            continue
        done[i] = True
        order.append(i)
        for j in near[i]:
            near[j] |= near[i]
            near[j] -= {i, j}
            heapq.heappush(heap, (len(near[j]), j))
    return order


class BlockSystem:
    """``H x = -g`` with H symmetric; blocks are numbered and have sizes of their own."""

    def __init__(self, sizes: list[int]):
        self.sizes = sizes
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(int)
        self.blocks: dict[tuple[int, int], np.ndarray] = {(i, i): np.zeros((n, n)) for i, n in enumerate(sizes)}
        self.side = np.zeros(self.starts[-1])
        self._order: list[int] | None = None

    def add(self, i: int, j: int, block: np.ndarray) -> None:
        """Adds to block (i, j); of i and j only i >= j is kept, the other follows by symmetry."""
        if i < j:
            return
        if (i, j) in self.blocks:
            self.blocks[i, j] = self.blocks[i, j] + block
        else:
            self.blocks[i, j] = block.copy()
            self._order = None

    def add_side(self, i: int, part: np.ndarray) -> None:
        self.side[self.starts[i] : self.starts[i + 1]] += part

    def diagonal(self) -> np.ndarray:
        return np.concatenate([np.diag(self.blocks[i, i]) for i in range(len(self.sizes))]) if self.sizes else np.zeros(0)

    def solved(self, extra: np.ndarray | float = 0.0) -> np.ndarray:
        """x for H with ``extra`` on the diagonal, by Cholesky factors of fronts; LinAlgError if that isn't positive."""
        n = len(self.sizes)
        if not n:
            return np.zeros(0)
        near: list[set[int]] = [set() for _ in range(n)]
        for i, j in self.blocks:
            if i != j:
                near[i].add(j)
                near[j].add(i)
        if self._order is None:
            self._order = least_degree_order(near)
        place = {k: at for at, k in enumerate(self._order)}
        spread = np.broadcast_to(np.asarray(extra, dtype=float), self.side.shape)
        index = [np.arange(self.starts[i], self.starts[i + 1]) for i in range(n)]
        waiting: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]  # updates by the block that takes them in
        factors: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        right = -self.side.copy()
        where = np.empty(len(self.side), dtype=int)
        fill: list[set[int]] = [set(x) for x in near]
        for k in self._order:
            rest = sorted((j for j in fill[k] if place[j] > place[k]), key=place.__getitem__)
            own, others = index[k], np.concatenate([index[j] for j in rest]) if rest else np.empty(0, int)
            every = np.concatenate([own, others])
            where[every] = np.arange(len(every))
            front = np.zeros((len(every),) * 2)
            m = len(own)
            front[:m, :m] = self.blocks[k, k] + np.diag(spread[own])
            for j in rest:
                if (block := self.blocks.get((j, k))) is not None:
                    front[where[index[j]][:, None], np.arange(m)] += block
                elif (block := self.blocks.get((k, j))) is not None:
                    front[where[index[j]][:, None], np.arange(m)] += block.T
            for rows, update in waiting[k]:
                at = where[rows]
                front[np.ix_(at, at)] += update
            waiting[k] = []
            corner = np.linalg.cholesky(front[:m, :m])
            below = np.linalg.solve(corner, front[m:, :m].T).T if rest else np.zeros((0, m))
            right[own] = np.linalg.solve(corner, right[own])
            right[others] -= below @ right[own]
            factors.append((own, others, corner, below))
            if rest:
                waiting[rest[0]].append((others, front[m:, m:] - below @ below.T))
                fill[rest[0]] |= set(rest[1:])
        x = right
        for own, others, corner, below in reversed(factors):
            x[own] = np.linalg.solve(corner.T, x[own] - below.T @ x[others])
        return x

    def solved_safely(self, extra: np.ndarray | float = 0.0) -> np.ndarray:
        """As ``solved``; where H is singular to rounding its diagonal is raised until it isn't."""
        ridge = 0.0
        mean = float(np.mean(np.abs(self.diagonal()))) if self.sizes else 0.0
        for _ in range(12):
            try:
                return self.solved(np.asarray(extra) + ridge)
            except np.linalg.LinAlgError:
                ridge = max(ridge * 100, 1e-12 * max(mean, 1e-300))
        raise np.linalg.LinAlgError("the system is not positive")
