"""Forward and backward recursions of linear chains over many sequences at once.

Sequences of one batch stand one after the other. Each is cut into blocks; the
product of a block's step matrices is taken for all blocks side by side, and a
short recursion over blocks gives the exact vectors at their borders. Every
value is rescaled, so no length underflows, and no sequence is cut short.

A step is ``vector @ transition * potential``; a sequence's first step is
``initial * potential``.
"""

from __future__ import annotations

import numpy as np

BLOCK = 32
RESCALE = 8  # steps between rescalings inside a block


class Blocks:
    """The blocks of sequences with bounds ``first`` (each has a token at least, or none)."""

    def __init__(self, first: np.ndarray):
        length = np.diff(first)
        self.n_rows = len(length)
        per_row = -(-length // BLOCK)
        row = np.repeat(np.arange(self.n_rows), per_row)
        place = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        start = first[row] + place * BLOCK
        size = np.minimum(first[row + 1] - start, BLOCK)
        order = np.argsort(-size, kind="stable")
        self.row, self.place, self.start, self.size = row[order], place[order], start[order], size[order]
        self.active = np.searchsorted(-self.size, -np.arange(BLOCK), side="left")  # blocks longer than k
        # blocks by place, for the recursion over blocks
        self.by_place = np.argsort(self.place, kind="stable")
        self.place_bounds = np.searchsorted(self.place[self.by_place], np.arange(int(per_row.max(initial=0)) + 1))

    def products(self, potential: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each block's matrix, scaled to a maximum of 1, and the log of the scale."""
        s = transition.shape[0]
        m = np.broadcast_to(np.eye(s), (len(self.row), s, s)).copy()
        log_scale = np.zeros(len(m))
        opening = self.place == 0
        for k in range(BLOCK):
            n = self.active[k]
            if not n:
                break
            step = (m[:n].reshape(-1, s) @ transition).reshape(n, s, s)
            if k == 0:
                step[opening[:n]] = m[:n][opening[:n]]
            step *= potential[self.start[:n] + k][:, None, :]
            m[:n] = step
            if k % RESCALE == RESCALE - 1:
                self._rescale(m, log_scale, n)
        self._rescale(m, log_scale, len(m))
        return m, log_scale

    @staticmethod
    def _rescale(m: np.ndarray, log_scale: np.ndarray, n: int) -> None:
        scale = m[:n].max(axis=(1, 2))
        m[:n] /= scale[:, None, None]
        log_scale[:n] += np.log(scale)

    def likelihood(self, potential: np.ndarray, transition: np.ndarray, initial: np.ndarray) -> np.ndarray:
        """Natural log of the sum over all paths, per sequence; 0 for one without tokens."""
        return self._borders(potential, transition, initial)[0]

    def _borders(self, potential, transition, initial):
        m, log_scale = self.products(potential, transition)
        s = len(initial)
        before = np.zeros((len(self.row), s))
        vector = np.tile(initial, (self.n_rows, 1)).astype(float)
        total = np.bincount(self.row, log_scale, minlength=self.n_rows)
        for a, b in zip(self.place_bounds, self.place_bounds[1:]):
            at = self.by_place[a:b]
            rows = self.row[at]
            before[at] = vector[rows]
            new = np.einsum("ns,nst->nt", vector[rows], m[at])
            norm = new.sum(axis=1)
            vector[rows] = new / norm[:, None]
            total[rows] += np.log(norm)
        return total, before, m

    def posteriors(self, potential: np.ndarray, transition: np.ndarray, initial: np.ndarray):
        """Log sums, state probabilities per token, expected transitions (summed), first-state counts."""
        total, before, m = self._borders(potential, transition, initial)
        s = len(initial)
        after = np.ones((len(self.row), s))
        vector = np.full((self.n_rows, s), 1.0)
        for a, b in reversed(list(zip(self.place_bounds, self.place_bounds[1:]))):
            at = self.by_place[a:b]
            rows = self.row[at]
            after[at] = vector[rows]
            new = np.einsum("nst,nt->ns", m[at], vector[rows])
            vector[rows] = new / new.max(axis=1, keepdims=True)
        alpha = np.empty_like(potential)
        opening = self.place == 0
        state = before
        for k in range(BLOCK):
            n = self.active[k]
            if not n:
                break
            new = state[:n] @ transition
            if k == 0:
                new[opening[:n]] = state[:n][opening[:n]]
            new *= potential[self.start[:n] + k]
            new /= new.sum(axis=1, keepdims=True)
            alpha[self.start[:n] + k] = new
            state = new
        gamma = np.empty_like(potential)
        xi = np.zeros((s, s))
        beta = after.copy()
        for k in range(BLOCK - 1, -1, -1):
            n = self.active[k]
            if not n:
                continue
            t = self.start[:n] + k
            g = alpha[t] * beta[:n]
            gamma[t] = g / g.sum(axis=1, keepdims=True)
            right = potential[t] * beta[:n]
            left = alpha[t - 1] if k else before[:n]
            inner = ~opening[:n] if k == 0 else slice(None)
            l, r = left[inner], right[inner]
            norm = np.einsum("ns,ns->n", l @ transition, r)
            xi += (l / norm[:, None]).T @ r
            new = right @ transition.T
            beta[:n] = new / new.max(axis=1, keepdims=True)
        first = self.start[opening]
        return total, gamma, xi * transition, gamma[first].sum(axis=0) if len(first) else np.zeros(s)
