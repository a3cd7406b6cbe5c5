"""Singular values and right singular vectors of a small triangular factor.

Householder reflections bring the factor to bidiagonal form, dqds finds the
squared singular values of the bidiagonal to high relative accuracy, and
twisted factorisations of its shifted product give their vectors.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
#: Values closer than this, relative to each other, count as a cluster.
CLUSTER = 1e-3


def bidiagonalised(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and orthogonal v with r = u @ B @ v.T for some orthogonal u."""
    x = np.array(r, dtype=float)
    n = x.shape[1]
    v = np.eye(n)

    def reflector(c: np.ndarray) -> np.ndarray | None:
        """Unit h so that c - 2 h (h.c) has its mass in the first place; None if it has already."""
        if len(c) < 2 or not c[1:].any():
            return None
        scale = np.abs(c).max()
        h = c / scale
        h[0] += np.copysign(np.sqrt(h @ h), h[0])
        return h / np.sqrt(h @ h)

    for i in range(n):
        h = reflector(x[i:, i])
        if h is not None:
            x[i:, i:] -= 2.0 * np.outer(h, h @ x[i:, i:])
        h = reflector(x[i, i + 1:])
        if h is not None:
            x[i:, i + 1:] -= 2.0 * np.outer(x[i:, i + 1:] @ h, h)
            v[:, i + 1:] -= 2.0 * np.outer(v[:, i + 1:] @ h, h)
    return np.diagonal(x).copy(), np.diagonal(x, 1).copy(), v


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, int]:
    """One shifted differential quotient-difference transform: new q and e, the least d, and its place."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least, where = d, 0
    for i in range(n - 1):
        new_q[i] = d + e[i]
        if new_q[i] == 0.0:
            return new_q, new_e, -1.0, i
        ratio = q[i + 1] / new_q[i]
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
        if d < least:
            least, where = d, i + 1
    new_q[n - 1] = d
    return new_q, new_e, least, where


def squared_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values, falling, of the bidiagonal with diagonal ``a`` and superdiagonal ``b``, none of them 0."""
    q, e = [float(x) ** 2 for x in a], [float(x) ** 2 for x in b]
    found: list[float] = []
    base, guess = 0.0, 0.0      # all values of (q, e) are short by ``base``; ``guess`` bounds the least of them
    while q:
        n = len(q)
        if n == 1:
            found.append(base + q.pop())
        elif e[-1] <= EPS * EPS * (base + q[-1]) or e[-1] <= EPS * EPS * q[-1]:
            found.append(base + q.pop())
            e.pop()
            guess = 0.0
        elif n == 2:
            # eigenvalues of [[q1, sqrt(q1 e1)], [sqrt(q1 e1), q2 + e1]]: the larger without cancellation, the other by the product
            half = 0.5 * (q[0] + e[0] - q[1])
            high = q[1] + half + float(np.hypot(half, np.sqrt(q[1]) * np.sqrt(e[0]))) if half >= 0 else (
                q[0] + e[0] - half + float(np.hypot(half, np.sqrt(q[1]) * np.sqrt(e[0]))))
            found += [base + high, base + (q[0] / high) * q[1]]
            q, e = [], []
        else:
            if q[0] < q[-1]:    # graded upwards: turn around, so that small values are found at the end
                q, e = _turned(q, e)
            shift = guess
            while True:
                new_q, new_e, least, where = _dqds_step(q, e, shift)
                if least >= 0.0:
                    break
                # the failure at the last place says how far the shift was too large
                late = shift + least if where == n - 1 else 0.0
                shift = late if 0.0 < late < shift else (shift * 0.25 if shift > EPS * base else 0.0)
            q, e, base = new_q, new_e, base + shift
            gap = np.sqrt(q[-1]) * np.sqrt(e[-1]) if e else 0.0
            guess = max(0.0, least - float(gap)) if where == n - 1 else 0.25 * least
    return np.array(sorted(found, reverse=True))


def _turned(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The same values with q and e of the bidiagonal read from its other end."""
    # a lower bidiagonal read backwards is upper; one plain transform makes an upper one of it
    d, n = q[-1], len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    for k, i in enumerate(range(n - 2, -1, -1)):
        new_q[k] = d + e[i]
        ratio = q[i] / new_q[k] if new_q[k] else 0.0
        new_e[k] = e[i] * ratio
        d = d * ratio
    new_q[n - 1] = d
    return new_q, new_e


class Twisted:
    """Stationary and progressive factors of B'B - value, and the twist where they meet best."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: float):
        n = len(a)
        tiny = EPS * EPS * max(value, float(np.max(a * a)))
        self.plus, self.minus = np.zeros(n), np.zeros(n)          # pivots from above, from below
        self.low, self.up = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
        d, l = a * a, b / a[:-1]                                  # B'B = L D L'
        s = -value
        above = np.zeros(n)
        for i in range(n):
            above[i] = s
            self.plus[i] = s + d[i] or tiny
            if i < n - 1:
                self.low[i] = d[i] * l[i] / self.plus[i]
                s = self.low[i] * l[i] * s - value
        p = d[n - 1] - value
        below = np.zeros(n)
        below[n - 1] = p
        for i in range(n - 2, -1, -1):
            self.minus[i + 1] = d[i] * l[i] * l[i] + p or tiny
            ratio = d[i] / self.minus[i + 1]
            self.up[i] = l[i] * ratio
            p = p * ratio - value
            below[i] = p
        self.minus[0] = p
        gamma = above + below + value
        self.twist = int(np.argmin(np.abs(gamma)))
        self.gamma = float(gamma[self.twist]) or tiny

    def solved(self, y: np.ndarray) -> np.ndarray:
        """x with (B'B - value) x = y."""
        k, n = self.twist, len(y)
        x = np.array(y, dtype=float)
        for i in range(1, k + 1):
            x[i] -= self.low[i - 1] * x[i - 1]
        for i in range(n - 2, k - 1, -1):
            x[i] -= self.up[i] * x[i + 1]
        if 0 < k < n - 1:      # the twist's place is reached from both ends
            x[k] = y[k] - self.low[k - 1] * x[k - 1] - self.up[k] * x[k + 1]
        x[:k] /= self.plus[:k]
        x[k + 1:] /= self.minus[k + 1:]
        x[k] /= self.gamma
        return self._spread(x)

    def _spread(self, x: np.ndarray) -> np.ndarray:
        for i in range(self.twist - 1, -1, -1):
            x[i] -= self.low[i] * x[i + 1]
        for i in range(self.twist, len(x) - 1):
            x[i + 1] -= self.up[i] * x[i]
        return x

    def vector(self) -> np.ndarray:
        """The solution for the unit vector of the twist, scaled to length 1."""
        z = np.zeros(len(self.plus))
        z[self.twist] = 1.0
        return _unit(self._spread(z))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def _block_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors of an unreduced block, a column for each of the falling ``values``."""
    out = np.zeros((len(a), len(values)))
    first = 0
    noise = np.random.default_rng(len(a))
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * values[j - 1]:
            first = j
        factors = Twisted(a, b, float(value) * (1.0 - 2.0 * EPS * (j - first)))
        z = factors.vector()
        # within a cluster: inverse iteration, orthogonal to the vectors before
        for _ in range(4 if j > first else 0):
            before = out[:, first:j]
            z = z - before @ (before.T @ z)
            if np.abs(z).max() < 1e-3:
                z = noise.standard_normal(len(a))
                z = z - before @ (before.T @ z)
            z = _unit(factors.solved(_unit(z)))
            z = z - before @ (before.T @ z)
            z = z - before @ (before.T @ z)
            z = _unit(z)
        out[:, j] = z
    return out


def right_vectors(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of ``r``, falling, and its right singular vectors as columns.

    Singular values below rounding of the largest come out as about that.
    """
    n = r.shape[1]
    if not n or not r.any():
        return np.zeros(n), np.eye(n)
    a, b, v = bidiagonalised(r)
    size = max(np.abs(a).max(), np.abs(b).max() if n > 1 else 0.0)
    a = np.where(np.abs(a) < EPS * 1e-2 * size, EPS * 1e-2 * size, a) / size
    b = b / size
    ends = [0, *(i + 1 for i in range(n - 1) if abs(b[i]) <= EPS * min(abs(a[i]), abs(a[i + 1]))), n]
    values, vectors = np.zeros(n), np.zeros((n, n))
    for low, high in zip(ends, ends[1:]):
        found = squared_values(a[low:high], b[low:high - 1])
        values[low:high] = found
        vectors[low:high, low:high] = _block_vectors(a[low:high], b[low:high - 1], found)
    order = np.argsort(-values, kind="stable")
    vectors = v @ vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)])
    return values[order] * size * size, vectors * signs
