"""Iterative solvers on the driver for operators that are applied elsewhere.

Each takes ``apply``: n x k array -> n x k array, one call (one Spark job, where the operator is a traversal) for all k
columns; so methods that work on blocks need the fewest jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

Apply = Callable[[np.ndarray], np.ndarray]


@dataclass
class CgReport:
    iterations: list[int] = field(default_factory=list)
    residuals: list[float] = field(default_factory=list)


def conjugate_gradients(apply: Apply, rhs: np.ndarray, project: Apply = lambda v: v, rel_tol: float = 5e-4, max_iter: int = 10_000, report: CgReport | None = None) -> np.ndarray:
    """All columns advance together until every relative residual is within ``rel_tol``; then, or after ``max_iter`` rounds,
    the last iterate is returned.  There is no guard against breakdown."""
    b = project(np.array(rhs, float))
    x, r = np.zeros_like(b), b.copy()
    p, size = r.copy(), np.einsum("ij,ij->j", r, r)
    first, rounds = size.copy(), 0
    while rounds < max_iter:
        rounds += 1
        moved = apply(p)
        step = size / np.einsum("ij,ij->j", p, moved)
        x += p * step
        r = project(r - moved * step)
        now = np.einsum("ij,ij->j", r, r)
        if (np.sqrt(now / first) <= rel_tol).all():
            size = now
            break
        p = r + p * (now / size)
        size = now
    if report is not None:
        report.iterations += [rounds] * b.shape[1]
        report.residuals += np.sqrt(size / first).tolist()
    return project(x)


def _ordered(values: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.argsort(values)[::-1][:k]
    return values[top], vectors[:, top]


def randomized(apply: Apply, n: int, k: int, oversample: int = 40, power: int = 10, seed: int = 2026) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenpairs of a symmetric operator by block power iterations and one Rayleigh-Ritz step."""
    width = min(n, k + oversample)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))
    for _ in range(power + 1):
        q, _ = np.linalg.qr(apply(q))
    small = q.T @ apply(q)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return _ordered(values, q @ turn, k)


def lanczos(apply: Apply, n: int, k: int, basis: int | None = None, tol: float = 1e-6, restarts: int = 300, seed: int = 2026) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenpairs by Lanczos with full reorthogonalisation and thick restarts."""
    basis = min(n, basis or max(2 * k + 1, 20))
    v = np.zeros((n, basis))
    start = np.random.default_rng(seed).standard_normal(n)
    v[:, 0] = start / np.linalg.norm(start)
    have, image = 0, np.zeros((n, basis))
    for _ in range(restarts):
        for j in range(have, basis):
            w = apply(v[:, j : j + 1])[:, 0]
            image[:, j] = w
            for _twice in range(2):
                w = w - v[:, : j + 1] @ (v[:, : j + 1].T @ w)
            size = np.linalg.norm(w)
            if j + 1 < basis:
                if size < 1e-12:  # an invariant subspace: go on in a fresh direction
                    w = np.random.default_rng(seed + j + 1).standard_normal(n)
                    for _twice in range(2):
                        w = w - v[:, : j + 1] @ (v[:, : j + 1].T @ w)
                    size = np.linalg.norm(w)
                v[:, j + 1] = w / size
        small = v.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1]
        values, turn = values[order], turn[:, order]
        ritz, moved = v @ turn, image @ turn
        off = np.linalg.norm(moved[:, :k] - ritz[:, :k] * values[:k], axis=0)
        if basis == n or (off <= tol * np.maximum(np.abs(values[:k]), 1e-300)).all():
            return values[:k], ritz[:, :k]
        have = min(k + max(1, (basis - k) // 2), basis - 2)
        tail = w - ritz[:, :have] @ (ritz[:, :have].T @ w)
        v[:, :have], image[:, :have] = ritz[:, :have], moved[:, :have]
        v[:, have] = tail / np.linalg.norm(tail)
    return values[:k], ritz[:, :k]


def lobpcg(apply: Apply, n: int, k: int, tol: float = 1e-6, max_iter: int = 500, seed: int = 2026) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenpairs by locally optimal block conjugate gradients; needs n >= 5 k."""
    if n < 5 * k:
        raise ValueError(f"lobpcg needs at least {5 * k} dimensions for {k} pairs, not {n}")
    x, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, k)))
    image, last = apply(x), np.zeros((n, 0))
    for _ in range(max_iter):
        values = np.einsum("ij,ij->j", x, image)
        residual = image - x * values
        if (np.linalg.norm(residual, axis=0) <= tol * np.maximum(np.abs(values), 1e-300)).all():
            break
        space, _ = np.linalg.qr(np.hstack([x, residual, last]))
        moved = apply(space)
        small = space.T @ moved
        found, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(found)[::-1][:k]
        turn = turn[:, order]
        new = space @ turn
        last = new - x @ (x.T @ new)
        x, image = new, moved @ turn
    return _ordered(np.einsum("ij,ij->j", x, image), x, k)


def relative_residuals(apply: Apply, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.linalg.norm(apply(vectors) - vectors * values, axis=0) / np.maximum(np.abs(values), 1e-300)


def largest_angle_sine(a: np.ndarray, b: np.ndarray) -> float:
    """Sine of the largest principal angle between two spans."""
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return float(np.linalg.norm(qb - qa @ (qa.T @ qb), 2))


def passes(residuals: np.ndarray, angle: float, tol: float) -> bool:
    return bool((residuals <= max(1e-5, 100 * tol)).all() and angle <= 1e-2)


def standardised_components(vectors: np.ndarray) -> np.ndarray:
    """Columns with mean 0, sample deviation 1, and a positive entry of largest magnitude."""
    out = vectors - vectors.mean(axis=0)
    spread = out.std(axis=0, ddof=1)
    out = out / np.where(spread == 0, 1, spread)
    lead = out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])]
    return out * np.where(lead < 0, -1, 1)
