"""Leading eigenpairs of a symmetric matrix that fits one machine: its side is a vector's length, not the corpus.

Householder reflections make the matrix tridiagonal, Sturm counts bisect for the leading eigenvalues, and inverse
iteration finds their vectors; vectors of a cluster of eigenvalues are orthogonalised against each other.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
# Eigenvalues closer than this share of the matrix's size are one cluster.
CLUSTER = 1e-3
ITERATIONS = 5


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, reflectors): row i of the reflectors is the unit vector that clears column i."""
    a, n = np.array(matrix, float), len(matrix)
    reflectors = np.zeros((max(n - 2, 0), n))
    for i in range(n - 2):
        x = a[i + 1:, i].copy()
        size = np.abs(x).max()
        if not np.abs(x[1:]).max() > 0:
            continue
        x /= size
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        v = x / np.linalg.norm(x)
        reflectors[i, i + 1:] = v
        # (1 - 2vv')A(1 - 2vv') as one symmetric update of rank two.
        part = a[i + 1:, i + 1:]
        p = part @ v
        w = 2 * (p - (v @ p) * v)
        part -= np.outer(v, w) + np.outer(w, v)
        a[i + 1:, i] -= 2 * v * (v @ a[i + 1:, i])
        a[i, i + 1:] = a[i + 1:, i]
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def _below(diagonal: np.ndarray, squares: np.ndarray, x: np.ndarray, tiny: float) -> np.ndarray:
    """Eigenvalues less than each x, by the signs of the Sturm sequence."""
    q = diagonal[0] - x
    count = (q < 0).astype(int)
    for a, s in zip(diagonal[1:], squares, strict=True):
        q = a - x - s / np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues of a tridiagonal matrix, falling."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    size = max(np.abs(diagonal).max() + reach.max(), np.finfo(float).tiny)
    low = np.full(count, (diagonal - reach).min() - 2 * _EPS * size)
    high = np.full(count, (diagonal + reach).max() + 2 * _EPS * size)
    wanted, squares = n - np.arange(count), off * off
    for _ in range(1100):
        middle = (low + high) / 2
        under = _below(diagonal, squares, middle, _EPS * _EPS * size) >= wanted
        low, high = np.where(under, low, middle), np.where(under, middle, high)
        if (high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high)) + _EPS * _EPS * size).all():
            break
    return (low + high) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, tiny: float):
    """Solves (T - shift)y = b by elimination with row exchanges; pivots of zero become tiny."""
    n = len(diagonal)
    d, up, up2 = diagonal - shift, np.append(off, 0.0), np.zeros(n)
    factor, swap, low = np.zeros(n), np.zeros(n, bool), off
    for i in range(n - 1):
        if abs(low[i]) > abs(d[i]):
            swap[i] = True
            factor[i] = d[i] / low[i]
            d[i], up[i], d[i + 1], up2[i], up[i + 1] = low[i], d[i + 1], up[i] - factor[i] * d[i + 1], up[i + 1], -factor[i] * up[i + 1]
        else:
            d[i] = d[i] if abs(d[i]) > tiny else tiny
            factor[i] = low[i] / d[i]
            d[i + 1] -= factor[i] * up[i]
    d = np.where(np.abs(d) > tiny, d, tiny)

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for i in range(n - 1):
            if swap[i]:
                y[i], y[i + 1] = y[i + 1], y[i] - factor[i] * y[i + 1]
            else:
                y[i + 1] -= factor[i] * y[i]
        y[n - 1] /= d[n - 1]
        if n > 1:
            y[n - 2] = (y[n - 2] - up[n - 2] * y[n - 1]) / d[n - 2]
        for i in range(n - 3, -1, -1):
            y[i] = (y[i] - up[i] * y[i + 1] - up2[i] * y[i + 2]) / d[i]
        return y
    return solve


def _vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of a tridiagonal matrix as columns."""
    n, rng = len(diagonal), np.random.default_rng(1)
    size = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    out, first, shift = np.zeros((n, len(values))), 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * size:
            first = k
        # Equal eigenvalues are told apart by a few units in the last place, so that each has its own system.
        shift = min(value, shift - 4 * _EPS * size) if k > first else value
        solve, v = _solver(diagonal, off, shift, _EPS * _EPS * size), rng.standard_normal(n)
        for _ in range(ITERATIONS):
            v = solve(v / np.linalg.norm(v))
            v /= np.abs(v).max()
            for _ in range(2):
                v -= out[:, first:k] @ (out[:, first:k].T @ v)
        out[:, k] = v / np.linalg.norm(v)
    return out


def leading_pairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): up to ``count`` largest eigenvalues, falling, and their unit vectors as columns.

    Values that cannot be told from zero next to the largest are left out.
    """
    n = len(matrix)
    count = min(count, n)
    scale = np.abs(matrix).max(initial=0.0)
    if not count or not scale > 0:
        return np.zeros(0), np.zeros((n, 0))
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, count)
    values = values[values > 4 * n * _EPS * max(values[0], 0)]
    vectors = _vectors(diagonal, off, values)
    for v in reflectors[::-1]:
        vectors -= 2 * np.outer(v, v @ vectors)
    return values * scale, vectors
