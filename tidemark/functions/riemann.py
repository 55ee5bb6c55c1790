"""Covariance matrices as points of a curved space: means, tangent vectors and minimum distance to mean."""

from __future__ import annotations

import numpy as np


def _apply(c: np.ndarray, f) -> np.ndarray:
    w, v = np.linalg.eigh(c)
    return (v * f(np.maximum(w, 1e-12))[..., None, :]) @ np.swapaxes(v, -1, -2)


def mean(covs: np.ndarray, weights: np.ndarray | None = None, rounds: int = 50, tolerance: float = 1e-9) -> np.ndarray:
    """Weighted geometric mean by fixed-point iteration in the tangent space."""
    w = np.full(len(covs), 1 / len(covs)) if weights is None else weights / weights.sum()
    m = np.einsum("n,nij->ij", w, covs)
    for _ in range(rounds):
        step = np.einsum("n,nij->ij", w, log_at(covs, m))
        m = move(m, step)
        if np.linalg.norm(step) < tolerance:
            break
    return m


def _expm(s: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh(s)
    return (v * np.exp(w)[..., None, :]) @ np.swapaxes(v, -1, -2)


def log_at(covs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithms of the matrices as seen from that point."""
    inverse = _apply(at, lambda x: 1 / np.sqrt(x))
    return _apply(inverse @ covs @ inverse, np.log)


def move(at: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The point a tangent step away."""
    root = _apply(at, np.sqrt)
    return root @ _expm(step) @ root


def tangent(covs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Upper triangles of the logarithms at that point, off-diagonal entries times sqrt 2."""
    s = log_at(covs, at)
    i, j = np.triu_indices(at.shape[0])
    return s[..., i, j] * np.where(i == j, 1, np.sqrt(2))


def distance2(covs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared affine-invariant distances."""
    inverse = _apply(at, lambda x: 1 / np.sqrt(x))
    return (np.log(np.maximum(np.linalg.eigvalsh(inverse @ covs @ inverse), 1e-12)) ** 2).sum(axis=-1)


def mdm_proba(covs: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Class probabilities: softmax of minus distance over its mean."""
    d = np.stack([distance2(covs, m) for m in means], axis=-1)
    z = -d / d.mean(axis=-1, keepdims=True)
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
