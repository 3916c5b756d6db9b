"""k-means and DBSCAN over points of shape (n, 2)."""

from __future__ import annotations

import numpy as np

SEED = 0x5EED


def kmeans(p: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Cluster number of each point; seeded spread-out starts, then Lloyd's rounds."""
    if k <= 0 or k > len(p):
        raise ValueError(f"k must be between 1 and the {len(p)} rows with a position, but is {k}")
    rng = np.random.default_rng(SEED)
    centres = [p[rng.integers(len(p))]]
    far = ((p - centres[0]) ** 2).sum(1)
    for _ in range(1, k):
        at = int(rng.choice(len(p), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(p)))
        centres.append(p[at])
        far = np.minimum(far, ((p - p[at]) ** 2).sum(1))
    c, label = np.array(centres), np.full(len(p), -1)
    for _ in range(rounds):
        new = np.concatenate([((q[:, None] - c[None]) ** 2).sum(2).argmin(1) for q in np.array_split(p, max(1, len(p) * k // 4_000_000))])
        if (new == label).all():
            break
        label = new
        n = np.bincount(label, minlength=k)
        for d in range(2):
            c[:, d] = np.where(n > 0, np.bincount(label, p[:, d], k) / np.maximum(n, 1), c[:, d])
    return label


def dbscan(p: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Cluster number of each point, -1 for noise; neighbours come from a grid of cells eps wide."""
    if not np.isfinite(eps) or eps <= 0:
        raise ValueError("eps must be a positive number")
    cell = np.floor((p - p.min(0)) / eps).astype(np.int64) if len(p) else np.empty((0, 2), np.int64)
    members: dict[tuple[int, int], list[int]] = {}
    for i, key in enumerate(map(tuple, cell.tolist())):
        members.setdefault(key, []).append(i)
    near: dict[tuple[int, int], np.ndarray] = {}

    def around(i: int) -> np.ndarray:
        x, y = key = tuple(cell[i])
        if key not in near:
            near[key] = np.array([j for a in (-1, 0, 1) for b in (-1, 0, 1) for j in members.get((x + a, y + b), ())])
        own = near[key]
        return own[((p[own] - p[i]) ** 2).sum(1) <= eps * eps]

    label, seen, number = np.full(len(p), -1), np.zeros(len(p), bool), 0
    for i in range(len(p)):
        if seen[i]:
            continue
        seen[i] = True
        own = around(i)
        if len(own) < least:
            continue
        label[i] = number
        queue = list(own)
        while queue:
            j = queue.pop()
            if label[j] < 0:
                label[j] = number
            if not seen[j]:
                seen[j] = True
                own = around(j)
                if len(own) >= least:
                    queue += own[~seen[own] | (label[own] < 0)].tolist()
        number += 1
    return label
