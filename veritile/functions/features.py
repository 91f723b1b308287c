"""Keypoints, binary descriptors and affine copies inside an image, in numpy and single precision."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

SCALE, LEVELS, RADIUS, PATTERN_RADIUS, BITS = 1.2, 5, 15, 13.0, 256
BORDER = RADIUS + 2
MAX_HAMMING, RATIO, SAME_PLACE = 64, 0.8, 4.0
MOST_PAIRS, MAX_SCALE, MAX_ANISOTROPY, MARGIN = 8, 3.0, 1.5, 8.0
#: Seeds of the sampling pattern and of the consensus search.
PATTERN_SEED, SEARCH_SEED = 0x0B5EED0FB41EF000, 0x2545F4914F6CDD1D
MOST_TRIES, CONFIDENCE = 2000, 0.995
_WORD = (1 << 64) - 1


class SplitMix:
    """The public 64-bit generator of that name."""

    def __init__(self, seed: int):
        self.state = seed

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & _WORD
        z = self.state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & _WORD
        z = (z ^ z >> 27) * 0x94D049BB133111EB & _WORD
        return z ^ z >> 31

    def below(self, n: int) -> int:
        return (self.next() >> 11) % n

    def unit(self) -> float:
        return (self.next() >> 11) / (1 << 53)


@lru_cache(maxsize=1)
def pattern() -> np.ndarray:
    """(256, 4): pairs of points x, y from a normal distribution inside a disc."""
    r = SplitMix(PATTERN_SEED)
    spread = (2 * PATTERN_RADIUS + 1) / 5

    def point() -> tuple[float, float]:
        while True:
            u, v = max(r.unit(), 1e-12), r.unit()
            d = math.sqrt(-2 * math.log(u)) * spread
            if d <= PATTERN_RADIUS:
                return d * math.cos(2 * math.pi * v), d * math.sin(2 * math.pi * v)

    return np.array([[*point(), *point()] for _ in range(BITS)])


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, with pixel centres aligned and edges repeated."""

    def axis(n: int, m: int):
        f = (np.arange(m) + 0.5) * (n / m) - 0.5
        i = np.floor(f).astype(int)
        return np.clip(i, 0, n - 1), np.clip(i + 1, 0, n - 1), (f - i).astype(np.float32)

    y0, y1, ay = axis(image.shape[0], height)
    x0, x1, ax = axis(image.shape[1], width)
    rows = image[:, x0] * (1 - ax) + image[:, x1] * ax
    return rows[y0] * (1 - ay)[:, None] + rows[y1] * ay[:, None]


def smoothed(image: np.ndarray) -> np.ndarray:
    """The 1 4 6 4 1 kernel along both axes, edges repeated."""
    (h, w), taps = image.shape, [np.float32(k / 16) for k in (1, 4, 6, 4, 1)]
    for axis in (1, 0):
        wide = np.empty((h, w + 4) if axis else (h + 4, w), image.dtype)
        at = wide if axis else wide.T
        own = image if axis else image.T
        at[:, 2:-2] = own
        at[:, :2], at[:, -2:] = own[:, :1], own[:, -1:]
        parts = [wide[:, k : k + w] if axis else wide[k : k + h] for k in range(5)]
        image = taps[0] * parts[0]
        product = np.empty_like(image)
        for tap, part in zip(taps[1:], parts[1:]):
            image += np.multiply(part, tap, out=product)
    return image


def corners(image: np.ndarray, most: int) -> list[tuple[int, int, float]]:
    """(y, x, response) of the strongest local maxima of the corner response, away from the border."""
    gx, gy = np.zeros_like(image), np.zeros_like(image)
    gx[1:-1, 1:-1] = (image[1:-1, 2:] - image[1:-1, :-2]) * np.float32(0.5)
    gy[1:-1, 1:-1] = (image[2:, 1:-1] - image[:-2, 1:-1]) * np.float32(0.5)
    xx, yy, xy = smoothed(gx * gx), smoothed(gy * gy), smoothed(gx * gy)
    r = xx * yy - xy * xy - np.float32(0.04) * (xx + yy) * (xx + yy)
    inner = r[BORDER:-BORDER, BORDER:-BORDER]
    if not inner.size:
        return []
    peak = inner > max(np.float32(1), np.float32(0.01) * r.max())
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                other = r[BORDER + dy : r.shape[0] - BORDER + dy, BORDER + dx : r.shape[1] - BORDER + dx]
                # Of equal neighbours the first in reading order stays.
                peak &= (inner > other) if (dy, dx) < (0, 0) else (inner >= other)
    y, x = np.nonzero(peak)
    v = inner[y, x]
    order = np.lexsort((x, y, -v))[:most]
    return [(int(y[k]) + BORDER, int(x[k]) + BORDER, float(v[k])) for k in order]


def _disc() -> tuple[np.ndarray, np.ndarray]:
    d = np.arange(-RADIUS, RADIUS + 1)
    dy, dx = np.meshgrid(d, d, indexing="ij")
    inside = dx * dx + dy * dy <= RADIUS * RADIUS
    return dy[inside], dx[inside]


#: Pixels around a keypoint of the coarsest level that its description looks at.
REACH = math.ceil((BORDER + 2) * SCALE ** (LEVELS - 1))


def keypoints(luma: np.ndarray, most: int = 2000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (n, 2) as x, y in base pixels, descriptors (n, 4) of 64-bit words, and corner responses, over a pyramid of levels."""
    base = luma.astype(np.float32)
    h, w = base.shape
    levels = [base] if min(h, w) >= 2 * BORDER + 1 else []
    for k in range(1, LEVELS):
        lw, lh = int(math.floor(w / SCALE**k + 0.5)), int(math.floor(h / SCALE**k + 0.5))
        if not levels or min(lw, lh) < 2 * BORDER + 1:
            break
        levels.append(resized(levels[-1], lw, lh))
    area = sum(v.size for v in levels)
    places, words, strengths = [np.zeros((0, 2))], [np.zeros((0, 4), np.uint64)], [np.zeros(0)]
    dy, dx = _disc()
    pairs = pattern()
    for image in levels:
        soft = smoothed(image)
        found = corners(soft, max(1, int(math.floor(most * image.size / area + 0.5))))
        if not found:
            continue
        y, x = (np.array([f[k] for f in found]) for k in (0, 1))
        around = soft[y[:, None] + dy, x[:, None] + dx].astype(float)
        angle = np.arctan2(around @ dy, around @ dx)
        c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
        value, flat, width = [], soft.ravel(), soft.shape[1]
        for px, py in ((pairs[:, 0], pairs[:, 1]), (pairs[:, 2], pairs[:, 3])):
            fx, fy = x[:, None] + c * px - s * py, y[:, None] + s * px + c * py
            # Corners keep away from the border, so every sample and its neighbours lie inside.
            ix, iy = fx.astype(np.int32), fy.astype(np.int32)
            ax, ay = (fx - ix).astype(np.float32), (fy - iy).astype(np.float32)
            at = iy * width + ix
            top, low = flat[at], flat[at + width]
            top += (flat[at + 1] - top) * ax
            low += (flat[at + width + 1] - low) * ax
            value.append(top + (low - top) * ay)
        bits = np.packbits(value[0] < value[1], axis=1, bitorder="little")
        words.append(bits.view(np.uint64))
        strengths.append(np.array([f[2] for f in found]))
        places.append(np.stack([(x + 0.5) * (w / image.shape[1]) - 0.5, (y + 0.5) * (h / image.shape[0]) - 0.5], 1))
    return np.concatenate(places), np.concatenate(words), np.concatenate(strengths)


def pooled_keypoints(luma: np.ndarray, plan: list, most: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Keypoints of the tiles (core, core with halo) of an image: each tile's share by area, those in its core, the strongest of all."""
    places, words, strengths = [], [], []
    for (cx, cy, cw, ch), (x, y, w, h) in plan:
        p, d, r = keypoints(luma[y : y + h, x : x + w], max(1, math.ceil(most * w * h / luma.size)))
        p = p + (x, y)
        own = (np.floor(p) >= (cx, cy)).all(1) & (np.floor(p) < (cx + cw, cy + ch)).all(1)
        places.append(p[own])
        words.append(d[own])
        strengths.append(r[own])
    p, d, r = map(np.concatenate, (places, words, strengths))
    best = np.lexsort((p[:, 0], p[:, 1], -r))[:most]
    return p[best], d[best]


def self_matches(places: np.ndarray, words: np.ndarray, apart: float, tile: int = 256) -> list[tuple[int, int]]:
    """Pairs i < j: j is nearest to i by bits, at least ``apart`` pixels off, and clearly nearer than another place."""
    out: dict[tuple[int, int], None] = {}
    far, x, y = np.uint16(1 << 15), places[:, 0], places[:, 1]
    for lo in range(0, len(places), tile):
        part = slice(lo, lo + tile)
        d = np.bitwise_count(words[part, 0, None] ^ words[:, 0]).astype(np.uint16)
        for k in range(1, words.shape[1]):
            d += np.bitwise_count(words[part, k, None] ^ words[:, k])
        d[(x[part, None] - x) ** 2 + (y[part, None] - y) ** 2 < apart * apart] = far
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = far
        j = d.argmin(1)
        for k in np.nonzero(d[np.arange(len(d)), j] <= MAX_HAMMING)[0]:
            elsewhere = (x - x[j[k]]) ** 2 + (y - y[j[k]]) ** 2 >= SAME_PLACE**2
            second = min(BITS, int(np.where(elsewhere, d[k], far).min()))
            if d[k, j[k]] < RATIO * second:
                out.setdefault(tuple(sorted((lo + int(k), int(j[k])))), None)
    return list(out)


def affine(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """(2, 3) least squares; None if the source points lie on a line."""
    c = source - source.mean(0)
    m = c.T @ c
    if len(source) < 3 or np.linalg.det(m) <= 1e-9 * max(1e-12, np.trace(m)) ** 2:
        return None
    a = np.linalg.solve(m, c.T @ (target - target.mean(0))).T
    return np.column_stack([a, target.mean(0) - a @ source.mean(0)])


def _area(p: np.ndarray) -> float:
    (ax, ay), (bx, by) = p[1] - p[0], p[2] - p[0]
    return abs(ax * by - ay * bx) / 2


def consensus(source: np.ndarray, target: np.ndarray, reach: float, least: int) -> np.ndarray | None:
    """Indices that agree on one affine map, from random triples with a fixed seed; None if too few do."""
    r, n = SplitMix(SEARCH_SEED), len(source)
    if n < max(3, least):
        return None
    agree = lambda t: ((source @ t[:, :2].T + t[:, 2] - target) ** 2).sum(1) <= reach * reach
    best, most, tries, limit = None, 0, 0, MOST_TRIES
    while tries < limit:
        tries += 1
        pick = [r.below(n) for _ in range(3)]
        if len(set(pick)) < 3 or _area(source[pick]) < 1 or _area(target[pick]) < 1 or (t := affine(source[pick], target[pick])) is None:
            continue
        ok = agree(t)
        if (count := int(ok.sum())) > most:
            best, most = ok, count
            share = (count / n) ** 3
            limit = min(MOST_TRIES, 1 if share >= 1 else max(1, math.ceil(math.log(1 - CONFIDENCE) / math.log(1 - share))))
    if best is None or most < least:
        return None
    if (t := affine(source[best], target[best])) is not None and (ok := agree(t)).sum() >= most:
        best = ok
    return np.nonzero(best)[0]


def copies(luma: np.ndarray, least: int = 12, reach: float = 3.0, most: int = 2000, apart: float = 24.0, plan: list | None = None) -> list[dict]:
    """Copied regions, turned or scaled: source and target boxes (x, y, width, height), degrees, scale and inliers.

    With a ``plan`` of tiles the keypoints come from them, and are matched over the whole image.
    """
    least = max(3, least)
    places, words = pooled_keypoints(luma, plan, max(1, most)) if plan else keypoints(luma, max(1, most))[:2]
    if len(places) < 2 * least:
        return []
    pairs = np.array(self_matches(places, words, max(1.0, apart))).reshape(-1, 2)
    out: list[dict] = []
    for _ in range(2 * MOST_PAIRS):
        if len(pairs) < least or len(out) == MOST_PAIRS:
            break
        p, q = places[pairs[:, 0]], places[pairs[:, 1]]
        # A copy may lead either way, so each match is offered in both directions.
        found = consensus(np.stack([p, q], 1).reshape(-1, 2), np.stack([q, p], 1).reshape(-1, 2), reach, least)
        if found is None:
            break
        ids = np.unique(found // 2)
        a, b = p[ids], q[ids]
        pairs = np.delete(pairs, ids, 0)
        swap = ((b - a[0]) ** 2).sum(1) + ((a - b[0]) ** 2).sum(1) < ((a - a[0]) ** 2).sum(1) + ((b - b[0]) ** 2).sum(1)
        a, b = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
        if len(ids) < least:
            continue
        boxes = [_box(x, luma.shape) for x in (a, b)]
        if (boxes[1][1], boxes[1][0]) < (boxes[0][1], boxes[0][0]):
            a, b, boxes = b, a, boxes[::-1]
        t = affine(a, b)
        if t is None:
            continue
        m = t[:, :2]
        large, small = np.linalg.svd(m, compute_uv=False)
        scale = math.sqrt(large * small)
        if np.linalg.det(m) <= 0 or not 1 / MAX_SCALE <= scale <= MAX_SCALE or large > MAX_ANISOTROPY * small:
            continue
        out.append({"source": boxes[0], "target": boxes[1], "degrees": math.degrees(math.atan2(m[1, 0] - m[0, 1], m[0, 0] + m[1, 1])), "scale": scale, "inliers": len(ids)})
    return out


def _box(points: np.ndarray, shape: tuple[int, int]) -> tuple[int, int, int, int]:
    lo = np.maximum(0, np.floor(points.min(0) - MARGIN)).astype(int)
    hi = np.minimum(shape[::-1], np.ceil(points.max(0) + MARGIN).astype(int) + 1)
    return int(lo[0]), int(lo[1]), max(1, int(hi[0] - lo[0])), max(1, int(hi[1] - lo[1]))
