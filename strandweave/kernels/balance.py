"""Balancing of symmetric non-negative matrices: a diagonal scaling with all row sums one."""

from __future__ import annotations

import numpy as np


def balance(a: np.ndarray, tolerance: float = 1e-8, rounds: int = 200) -> np.ndarray:
    """x > 0 with x * (a @ x) == 1, by Newton steps on that equation, damped so that x stays positive.

    Raises if the matrix has a zero row or the steps do not converge.
    """
    a = np.asarray(a, float)
    if not len(a):
        return np.zeros(0)
    if (a.sum(1) <= 0).any():
        raise ValueError("a row without contacts can't be balanced")
    x = 1 / np.sqrt(a.sum(1))
    for _ in range(20):  # a few fixed-point steps bring the start near enough
        x = np.sqrt(x / (a @ x))
    for _ in range(rounds):
        v = a @ x
        rest = 1 - x * v
        if np.abs(rest).max() < tolerance:
            return x
        step = np.linalg.solve(np.diag(v) + x[:, None] * a, rest)
        down = step < 0
        t = min(1.0, 0.9 * float((x[down] / -step[down]).min())) if down.any() else 1.0
        x = x + t * step
    raise ValueError("no convergence: the matrix may be too sparse")


def balanced(a: np.ndarray, blocks: list[tuple[int, int]], pseudo: float = 1e-5) -> np.ndarray:
    """The matrix balanced as a whole, its diagonal blocks balanced on their own; cells that were zero stay zero."""
    zero = a == 0
    b = a + pseudo
    x = balance(b)
    out = x[:, None] * b * x[None, :]
    for lo, hi in blocks:
        y = balance(b[lo:hi, lo:hi])
        out[lo:hi, lo:hi] = y[:, None] * b[lo:hi, lo:hi] * y[None, :]
    out[zero] = 0
    return out


def balance_cells(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int, pseudo: float = 1e-5, tolerance: float = 1e-8, rounds: int = 200) -> np.ndarray:
    """``balance`` of the n-by-n matrix with v at (i, j) and (j, i), i <= j, and ``pseudo`` added to all n * n cells.

    The sum of x stands for the added cells, so memory follows from n and the cells given. Each Newton step is the solution
    of (a + diag(a @ x / x)) step = rest / x, which is symmetric and positive, by conjugate gradients.
    """
    off = i != j
    oi, oj, ov = i[off], j[off], v[off]

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(i, v * x[j], n) + np.bincount(oj, ov * x[oi], n) + pseudo * x.sum()

    def solved(diagonal: np.ndarray, right: np.ndarray, goal: float) -> np.ndarray:
        out, rest = np.zeros(n), right.copy()
        z = rest / diagonal
        way, now = z.copy(), float(rest @ z)
        for _ in range(1000):
            if not now > goal:
                break
            y = times(way)
            y += diagonal * way
            t = now / float(way @ y)
            out += t * way
            rest -= t * y
            z = rest / diagonal
            now, last = float(rest @ z), now
            way *= now / last
            way += z
        return out

    if not n:
        return np.zeros(0)
    x = 1 / np.sqrt(times(np.ones(n)))
    for _ in range(20):
        x = np.sqrt(x / times(x))
    for _ in range(rounds):
        y = times(x)
        rest = 1 - x * y
        worst = float(np.abs(rest).max())
        if worst < tolerance:
            return x
        y /= x
        rest /= x
        step = solved(y, rest, 1e-4 * min(1.0, worst) * float(rest @ (rest / y)))
        down = step < 0
        x = x + (min(1.0, 0.9 * float((x[down] / -step[down]).min())) if down.any() else 1.0) * step
    raise ValueError("no convergence: the matrix may be too sparse")
