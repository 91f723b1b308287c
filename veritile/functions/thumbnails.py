"""Comparison of an embedded thumbnail with its image."""

from __future__ import annotations

import numpy as np

from veritile.functions.kernels import half_away

CELLS, LEAST_DEVIATION, BAR_MEAN, BAR_DEVIATION = 4, 6.0, 20.0, 8.0


def _shares(n: int, m: int) -> np.ndarray:
    """(m, n): how much of each of n cells falls into each of m equal parts, rows summing to one."""
    edges = np.arange(m + 1) * (n / m)
    k = np.arange(n)
    overlap = np.minimum(edges[1:, None], k + 1) - np.maximum(edges[:-1, None], k)
    w = np.maximum(0, overlap)
    return w / w.sum(1, keepdims=True)


def resample(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means over the exact area that each new pixel covers."""
    return _shares(plane.shape[0], height) @ plane @ _shares(plane.shape[1], width).T


def content(plane: np.ndarray) -> tuple[int, int, int, int]:
    """x, y, width, height without dark bars, of which at most a quarter is cut on each side."""

    def bars(lines: np.ndarray, most: int) -> int:
        n = 0
        while n < most and lines[n].mean() <= BAR_MEAN and lines[n].std() <= BAR_DEVIATION:
            n += 1
        return n

    h, w = plane.shape
    top = bars(plane, h // 4)
    low = bars(plane[top + 1 :][::-1], h // 4)
    inner = plane[top : h - low].T
    left = bars(inner, w // 4)
    right = bars(inner[left + 1 :][::-1], w // 4)
    return left, top, w - left - right, h - top - low


def aspect_difference(w: int, h: int, ow: int, oh: int) -> float:
    return abs(float(np.log((w / h) / (ow / oh))))


def centred(region: tuple[int, int, int, int], aspect: float) -> tuple[int, int, int, int]:
    """The largest centred part of a region with an aspect ratio."""
    x, y, w, h = region
    if w / h > aspect:
        n = max(1, int(half_away(np.float64(h * aspect))))
        return x + (w - n) // 2, y, n, h
    n = max(1, int(half_away(np.float64(w / aspect))))
    return x, y + (h - n) // 2, w, n


def correlation(a: np.ndarray, b: np.ndarray) -> float | None:
    """None if both hardly vary; 0 if one of them does."""
    if a.std() < LEAST_DEVIATION and b.std() < LEAST_DEVIATION:
        return None
    da, db = a - a.mean(), b - b.mean()
    ea, eb = (da * da).mean(), (db * db).mean()
    return float(np.clip((da * db).mean() / np.sqrt(ea * eb), -1, 1)) if min(ea, eb) > 1e-12 else 0.0


def compare(main: np.ndarray, thumb: np.ndarray) -> tuple[float, tuple[int, int, int, int] | None] | None:
    """The least correlation of the whole and of a grid of cells, and the worst cell; None if all is featureless."""
    h, w = main.shape
    g = max(1, min(CELLS, w // 4, h // 4))
    whole = correlation(main, thumb)
    cells = []
    for cy in range(g):
        for cx in range(g):
            y0, y1, x0, x1 = cy * h // g, (cy + 1) * h // g, cx * w // g, (cx + 1) * w // g
            r = correlation(main[y0:y1, x0:x1], thumb[y0:y1, x0:x1])
            if r is not None:
                cells.append((r, cy, cx, (x0, y0, x1 - x0, y1 - y0)))
    if whole is None and not cells:
        return None
    worst = min(cells, default=None)
    return min(r for r in (whole, worst and worst[0]) if r is not None), worst and worst[3]
