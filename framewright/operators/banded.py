"""Least-squares systems of trajectories, solved for many blocks of frames at a time.

Arrays have a row a frame and a column a block; measurements have an axis more. A clip longer than a block is taken apart
at the last frames of its blocks: what is between them is eliminated in each block by itself, the last frames meet in a small system,
and each block is put back from its neighbours' last frames.
"""

from __future__ import annotations

import numpy as np


def five_banded(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves the symmetric systems with diagonal d0[i], d1[i] between i and i + 1, and d2[i] between i and i + 2."""
    n = len(d0)
    pivot, one, two, x = d0.copy(), np.zeros_like(d0), np.zeros_like(d0), right.astype(float).copy()
    for i in range(1, n):
        across = d1[i - 1].copy()
        if i > 1:
            two[i] = d2[i - 2] / pivot[i - 2]
            across -= d2[i - 2] * one[i - 1]
            pivot[i] -= two[i] * d2[i - 2]
        one[i] = across / pivot[i - 1]
        pivot[i] -= one[i] * across
        x[i] -= one[i][:, None] * x[i - 1]
        if i > 1:
            x[i] -= two[i][:, None] * x[i - 2]
    x /= pivot[:, :, None]
    for i in range(n - 2, -1, -1):
        x[i] -= one[i + 1][:, None] * x[i + 1]
        if i + 2 < n:
            x[i] -= two[i + 2][:, None] * x[i + 2]
    return x


class Smooth:
    """Data terms, first and second differences: sum w |s - m|^2 + v sum |s_i - s_{i-1}|^2 + a sum |s_{i+1} - 2 s_i + s_{i-1}|^2."""

    edge = 2

    def __init__(self, velocity: float, acceleration: float):
        self.v, self.a = velocity, acceleration

    def bands(self, w: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bands of blocks that begin at frame `first` of clips of n frames."""
        i = np.arange(len(w))[:, None] + first
        inner = (i >= 1) & (i <= n - 2)
        d0 = w + self.v * ((i >= 1) * 1.0 + (i <= n - 2)) + self.a * ((i <= n - 3) + 4.0 * inner + (i >= 2))
        d1 = np.where(i <= n - 2, -self.v - 2 * self.a * (inner * 1.0 + (i <= n - 3)), 0.0)
        return d0, d1, np.where(i <= n - 3, self.a, 0.0)

    def _eliminated(self, w, m, first, n, size):
        """Of each block, the solutions for the measurements and for unit values of the four frames around its inside."""
        rows, blocks, axes = m.shape
        d0, d1, d2 = self.bands(w, first, n)
        inside = np.where(first + size < n, size - 2, size)  # the last two frames of a block that another follows are edges
        at = np.arange(rows)[:, None]
        own, edges = at < inside, (at >= inside) & (at < size)
        sides = np.zeros((rows, blocks, 4))  # two frames before the inside, two after it
        before = np.flatnonzero(first > 0)
        e1, e2 = self._side(first[before] - 1, n[before]), self._side(first[before] - 2, n[before])
        sides[0, before, 0], sides[0, before, 1] = e2[1], e1[0]
        two = before[inside[before] > 1]
        sides[min(1, rows - 1), two, 1] = self._side(first[two] - 1, n[two])[1]
        after = np.flatnonzero(inside < size)
        last = inside[after] - 1
        sides[last, after, 2], sides[last, after, 3] = d1[last, after], d2[last, after]
        sides[last - 1, after, 2] += d2[last - 1, after]
        keep1, keep2 = own & np.roll(own, -1, 0), own & np.roll(own, -2, 0)
        keep1[-1:], keep2[-2:] = False, False
        right = np.concatenate((np.where(own, w, 0.0)[:, :, None] * m, sides), 2)
        x = five_banded(np.where(own, d0, 1.0), np.where(keep1, d1, 0.0), np.where(keep2, d2, 0.0), right)
        return x[:, :, :axes], x[:, :, axes:], sides, (d0, d1), inside, edges

    def _side(self, i, n):
        """Bands one and two beside the diagonal at frame i."""
        inner = (i >= 1) & (i <= n - 2)
        return np.where(i <= n - 2, -self.v - 2 * self.a * (inner * 1.0 + (i <= n - 3)), 0.0), np.where(i <= n - 3, self.a, 0.0)

    def reduce(self, w, m, first, n, size) -> np.ndarray:
        """A row a block: what it adds to the system of edges (4 x 4 and 4 an axis), and its own edge's part (2 x 2 and 2 an axis)."""
        x, across, sides, (d0, d1), inside, _ = self._eliminated(w, m, first, n, size)
        matrix = np.einsum("ibk,ibl->bkl", sides, across)
        right = np.einsum("ibk,iba->bka", sides, x)
        blocks, axes = m.shape[1:]
        own, rhs = np.zeros((blocks, 2, 2)), np.zeros((blocks, 2, axes))
        b = np.flatnonzero(inside < size)
        for k in range(2):
            at = inside[b] + k
            own[b, k, k] = d0[at, b]
            rhs[b, k] = w[at, b][:, None] * m[at, b]
        own[b, 0, 1] = own[b, 1, 0] = d1[inside[b], b]
        return np.concatenate([p.reshape(blocks, -1) for p in (matrix, right, own, rhs)], 1)

    def edges(self, parts: np.ndarray, axes: int) -> np.ndarray:
        """parts: reduce's rows of a clip's blocks in order -> the values of each block's last two frames (blocks - 1, 2, axes)."""
        k = len(parts)
        cut = np.cumsum([0, 16, 4 * axes, 4, 2 * axes])
        matrix, right, own, rhs = (parts[:, a:b] for a, b in zip(cut[:-1], cut[1:]))
        matrix, right, own, rhs = matrix.reshape(k, 4, 4), right.reshape(k, 4, axes), own.reshape(k, 2, 2), rhs.reshape(k, 2, axes)
        diagonal = [own[j] - matrix[j, 2:, 2:] - matrix[j + 1, :2, :2] for j in range(k - 1)]
        value = [rhs[j] - right[j, 2:] - right[j + 1, :2] for j in range(k - 1)]
        upper = [-matrix[j + 1, :2, 2:] for j in range(k - 2)]
        for j in range(1, k - 1):
            f = np.linalg.solve(diagonal[j - 1], upper[j - 1]).T
            diagonal[j] = diagonal[j] - f @ upper[j - 1]
            value[j] = value[j] - f @ value[j - 1]
        out = np.zeros((k - 1, 2, axes))
        for j in range(k - 2, -1, -1):
            out[j] = np.linalg.solve(diagonal[j], value[j] - (upper[j] @ out[j + 1] if j < k - 2 else 0))
        return out

    def expand(self, w, m, first, n, size, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The solution of each block; left and right are the values of the edges around its inside (blocks, 2, axes)."""
        x, across, *_, inside, edges = self._eliminated(w, m, first, n, size)
        x = x - np.einsum("ibk,bka->iba", across[:, :, :2], left) - np.einsum("ibk,bka->iba", across[:, :, 2:], right)
        at = np.arange(len(w))[:, None] - inside
        return np.where(edges[:, :, None], np.where((at == 0)[:, :, None], right[:, 0], right[:, 1]), x)


class Chain:
    """Anchors and steps: sum w |p_i - m_i|^2 + sum b_i |p_i - p_{i-1}|^2; steps that were measured are taken off beforehand.

    Only sums, products and quotients of positive numbers occur, so weights may differ by many orders of magnitude.
    """

    edge = 1

    @staticmethod
    def _forward(w, h, b):
        """Weight and weighted measurement that each frame has from itself and all before it."""
        a, g = w.copy(), h.copy()
        for i in range(1, len(w)):
            share = b[i] / (a[i - 1] + b[i])
            a[i] += a[i - 1] * share
            g[i] += share[:, None] * g[i - 1]
        return a, g

    @classmethod
    def solve(cls, w, h, b) -> np.ndarray:
        a, g = cls._forward(w, h, b)
        x = g.copy()
        x[-1] /= a[-1][:, None]
        for i in range(len(w) - 2, -1, -1):
            x[i] = (g[i] + b[i + 1][:, None] * x[i + 1]) / (a[i] + b[i + 1])[:, None]
        return x

    def reduce(self, w, m, b, first, n, size) -> np.ndarray:
        """A row a block that reaches from the last frame before it to its own last frame: weights at both ends, the step's weight
        between them, and the weighted measurements at both ends."""
        blocks, axes = m.shape[1:]
        h = w[:, :, None] * m
        near, across, g_near = np.zeros(blocks), np.where(first > 0, b[0], 0.0), np.zeros((blocks, axes))
        far, g_far = w[0].copy(), h[0].copy()
        for i in range(1, len(w)):  # the frame at the far end is eliminated and the next one takes its place
            on = i < size
            whole = far + across + b[i]
            near = np.where(on, near + across * far / whole, near)
            new_far, new_across = b[i] * far / whole + w[i], across * b[i] / whole
            new_near_g, new_far_g = g_near + (across / whole)[:, None] * g_far, (b[i] / whole)[:, None] * g_far + h[i]
            g_near, g_far = np.where(on[:, None], new_near_g, g_near), np.where(on[:, None], new_far_g, g_far)
            far, across = np.where(on, new_far, far), np.where(on, new_across, across)
        return np.concatenate((near[:, None], far[:, None], across[:, None], g_near, g_far), 1)

    def edges(self, parts: np.ndarray, axes: int) -> np.ndarray:
        """The values of each block's last frame (blocks, 1, axes)."""
        near, far, across, g_near, g_far = parts[:, 0], parts[:, 1], parts[:, 2], parts[:, 3 : 3 + axes], parts[:, 3 + axes :]
        w, h = far.copy(), g_far.copy()
        w[:-1] += near[1:]
        h[:-1] += g_near[1:]
        b = across.copy()
        b[0] = 0.0
        return self.solve(w[:, None], h[:, None, :], b[:, None])

    def expand(self, w, m, b, first, n, size, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """left, right: the values of the frames before each block and at its end (blocks, 1, axes)."""
        h = w[:, :, None] * m
        w, b = w.copy(), b.copy()
        before = first > 0
        w[0] += np.where(before, b[0], 0.0)
        h[0] += np.where(before, b[0], 0.0)[:, None] * left[:, 0]
        b[0] = 0.0
        at, blocks = size - 1, np.arange(len(size))
        cut = np.flatnonzero(first + size < n)
        a, g = self._forward(w, h, b)
        x = np.zeros_like(h)
        value = g[at, blocks] / a[at, blocks][:, None]
        value[cut] = right[cut, 0]
        x[at, blocks] = value
        for i in range(len(w) - 2, -1, -1):
            on = i < at
            new = (g[i] + b[i + 1][:, None] * x[i + 1]) / (a[i] + b[i + 1])[:, None]
            x[i] = np.where(on[:, None], new, x[i])
        return x
