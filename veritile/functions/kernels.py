"""Numpy kernels on planes and blocks, for Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# The luminance quantization table of the JPEG standard, row by row.
BASE_TABLE = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)

#: Row k is the orthonormal cosine of frequency k at 8 points.
COSINE = np.where(np.arange(8)[:, None] == 0, np.sqrt(0.125), 0.5) * np.cos((2 * np.arange(8) + 1) * np.arange(8)[:, None] * np.pi / 16)


def half_away(x: np.ndarray) -> np.ndarray:
    """Rounded, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) + 0.5), x)


def quantization(quality: int) -> list[int]:
    q = max(1, min(100, quality))
    scale = 5000 / q if q < 50 else 200 - 2 * q
    return [int(max(1, min(255, (b * scale + 50) // 100))) for b in BASE_TABLE]


def dct(blocks: np.ndarray) -> np.ndarray:
    return np.round(COSINE @ blocks @ COSINE.T, 9)


def inverse_dct(coefficients: np.ndarray) -> np.ndarray:
    return np.round(COSINE.T @ coefficients @ COSINE, 9)


def recompress_blocks(blocks: np.ndarray, quality: int) -> np.ndarray:
    """8-bit blocks (n, 8, 8) after quantization of their cosine coefficients."""
    table = np.array(quantization(quality), float).reshape(8, 8)
    kept = half_away(dct(blocks - 128.0) / table) * table
    return np.clip(half_away(inverse_dct(kept) + 128), 0, 255)


def to_blocks(plane: np.ndarray) -> np.ndarray:
    """A plane as (rows, columns, 8, 8); edges are repeated to whole blocks."""
    h, w = plane.shape
    full = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    return full.reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8).transpose(0, 2, 1, 3)


def recompress(plane: np.ndarray, quality: int) -> np.ndarray:
    b = to_blocks(plane.astype(float))
    out = recompress_blocks(b.reshape(-1, 8, 8), quality).reshape(b.shape).transpose(0, 2, 1, 3)
    return out.reshape(b.shape[0] * 8, b.shape[1] * 8)[: plane.shape[0], : plane.shape[1]]


def luminance(pixels: np.ndarray) -> np.ndarray:
    """Unrounded luma of (height, width, channels); the first channel of gray images."""
    if pixels.shape[2] < 3:
        return pixels[..., 0].astype(float)
    out = 0.299 * pixels[..., 0].astype(float)
    out += 0.587 * pixels[..., 1]
    out += 0.114 * pixels[..., 2]
    return out


def rounded_luma(pixels: np.ndarray) -> np.ndarray:
    return np.clip(half_away(np.round(luminance(pixels), 9)), 0, 255)


def grid(plane: np.ndarray, size: int) -> np.ndarray:
    """Whole blocks as (rows, columns, size, size)."""
    r, c = plane.shape[0] // size, plane.shape[1] // size
    return plane[: r * size, : c * size].reshape(r, size, c, size).transpose(0, 2, 1, 3)


def high_pass(plane: np.ndarray) -> np.ndarray:
    """Second differences along both axes; one pixel less on every side."""
    d = plane[:-2] + plane[2:]
    d -= 2 * plane[1:-1]
    out = d[:, :-2] + d[:, 2:]
    out -= 2 * d[:, 1:-1]
    return out


def prediction_errors(plane: np.ndarray) -> np.ndarray:
    return plane[1:-1, 1:-1] - 0.25 * (plane[:-2, 1:-1] + plane[2:, 1:-1] + plane[1:-1, :-2] + plane[1:-1, 2:])


@lru_cache(maxsize=256)
def _cells_in_reach(n: int, r: int) -> np.ndarray:
    """How many of n places lie within r of each."""
    k = np.arange(n)
    return np.minimum(n, k + r + 1) - np.maximum(0, k - r)


def box_means(plane: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Means over odd squares, cut off at the edges, from one table of running sums."""
    (h, w), most = plane.shape, max(sizes) // 2
    # The table goes on as zeros before and as its last line behind, so that every corner of every square is a slice.
    total = np.zeros((h + 1 + 2 * most, w + 1 + 2 * most))
    inner = total[most + 1 : most + 1 + h, most + 1 : most + 1 + w]
    np.cumsum(plane, 0, out=inner)
    np.cumsum(inner, 1, out=inner)
    total[most + 1 + h :, most + 1 : most + 1 + w] = inner[-1]
    total[:, most + 1 + w :] = total[:, most + w, None]
    out = []
    for size in sizes:
        r = size // 2
        lo, hi = most - r, most + r + 1
        rows = total[hi : hi + h] - total[lo : lo + h]
        mean = rows[:, hi : hi + w] - rows[:, lo : lo + w]
        mean /= np.outer(_cells_in_reach(h, r), _cells_in_reach(w, r))
        out.append(mean)
    return out


def box_mean(plane: np.ndarray, size: int) -> np.ndarray:
    return box_means(plane, (size,))[0]


#: What stands for no value in a plane of whole numbers.
MISSING = np.iinfo(np.int32).max


def block_middles(plane: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the two middle values of whole blocks, which are one if their number is odd; ``MISSING`` counts as none.

    Blocks are sorted, which on 32-bit numbers takes a fraction of the time that a selection takes.
    """
    b = grid(plane, size).reshape(plane.shape[0] // size, plane.shape[1] // size, -1)
    b.sort(axis=2)
    n = b.shape[2]
    low, high = b[..., (n - 1) // 2].astype(float), b[..., n // 2].astype(float)
    at = np.nonzero(b[..., -1] == MISSING)  # blocks on the image's border
    if len(at[0]):
        edge = b[at]
        n = (edge != MISSING).sum(1)
        k = np.arange(len(n))
        low[at], high[at] = edge[k, np.maximum(n - 1, 0) // 2], edge[k, n // 2]
    return low, high


def milli_luma(pixels: np.ndarray) -> np.ndarray:
    """A thousand times the unrounded luma, in whole numbers."""
    p = pixels.astype(np.int32)
    return 299 * p[..., 0] + 587 * p[..., 1] + 114 * p[..., 2] if pixels.shape[2] >= 3 else 1000 * p[..., 0]


def box_downsample(plane: np.ndarray, factor: int) -> np.ndarray:
    return plane if factor <= 1 else grid(plane, factor).mean(axis=(2, 3))


# The low-pass filter of the Daubechies wavelet with 8 taps.
LOW_PASS = np.array([0.2303778133088964, 0.7148465705529154, 0.6308807679298587, -0.0279837694168599, -0.1870348117190931, 0.0308413818355607, 0.0328830116668852, -0.0105974017850690])
HIGH_PASS = LOW_PASS[::-1] * np.array([1, -1] * 4)
LEVELS, NOISE_VARIANCE, WINDOWS = 4, 9.0, (3, 5, 7, 9)


def _part(x: np.ndarray, axis: int, start: int, stop: int | None, step: int = 1) -> np.ndarray:
    return x[start:stop:step] if axis == 0 else x[:, start:stop:step]


def _analyze(x: np.ndarray, axis: int) -> np.ndarray:
    """One step along an axis, periodic: low band, then high band."""
    half = x.shape[axis] // 2
    # Even and odd places apart, so that a tap is applied to one stretch.
    sides = []
    for odd in (0, 1):
        own = _part(x, axis, odd, None, 2)
        sides.append(np.concatenate([own, np.take(own, np.arange(4) % half, axis)], axis))
    bands, product = [], None
    for taps in (LOW_PASS, HIGH_PASS):
        band = taps[0] * _part(sides[0], axis, 0, half)
        product = np.empty_like(band)
        for k in range(1, 8):
            np.multiply(_part(sides[k % 2], axis, k // 2, k // 2 + half), taps[k], out=product)
            band += product
        bands.append(band)
    return np.concatenate(bands, axis)


def _synthesize(x: np.ndarray, axis: int) -> np.ndarray:
    half = x.shape[axis] // 2
    # Even outputs take the even taps of the pairs before them, odd outputs the odd taps.
    low, high = (np.concatenate([np.take(b, np.arange(-3, 0) % half, axis), b], axis) for b in (_part(x, axis, 0, half), _part(x, axis, half, None)))
    out = np.empty_like(x)
    for odd in (0, 1):
        total = LOW_PASS[odd] * _part(low, axis, 3, None)
        product = np.empty_like(total)
        for j in range(4):
            for taps, band in ((LOW_PASS, low), (HIGH_PASS, high))[1 if j == 0 else 0 :]:
                np.multiply(_part(band, axis, 3 - j, 3 - j + half), taps[2 * j + odd], out=product)
                total += product
        _part(out, axis, odd, None, 2)[...] = total
    return out


def wavelet(plane: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    out = plane.copy()
    for k in range(levels):
        part = out[: plane.shape[0] >> k, : plane.shape[1] >> k]
        part[:] = _analyze(_analyze(part, 1), 0)
    return out


def inverse_wavelet(coefficients: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    out = coefficients.copy()
    for k in reversed(range(levels)):
        part = out[: out.shape[0] >> k, : out.shape[1] >> k]
        part[:] = _synthesize(_synthesize(part, 0), 1)
    return out


def wiener_residual(band: np.ndarray) -> np.ndarray:
    """What a local Wiener filter takes for noise: the least of the signal variances over four windows counts."""
    squared = band * band
    signal = np.maximum(0, np.min(box_means(squared, WINDOWS), axis=0) - NOISE_VARIANCE)
    return band * NOISE_VARIANCE / (signal + NOISE_VARIANCE)


def zero_mean(plane: np.ndarray) -> np.ndarray:
    p = plane - plane.mean(axis=0, keepdims=True)
    return p - p.mean(axis=1, keepdims=True)


def noise_residual(luma: np.ndarray) -> np.ndarray:
    """The sensor noise estimate of a plane."""
    h, w = luma.shape
    n = 1 << LEVELS
    c = wavelet(np.pad(luma, ((0, -h % n), (0, -w % n)), mode="symmetric"))
    rest = np.zeros_like(c)
    for k in range(1, LEVELS + 1):
        bh, bw = c.shape[0] >> k, c.shape[1] >> k
        for y, x in ((0, bw), (bh, 0), (bh, bw)):
            rest[y : y + bh, x : x + bw] = wiener_residual(c[y : y + bh, x : x + bw])
    return zero_mean(inverse_wavelet(rest)[:h, :w])


#: Offsets (rows, columns) of a block's noise signature.
LAGS = [(dy, dx) for dy in range(3) for dx in range(-2, 3) if dy > 0 or dx > 0]


def signatures(residual: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each whole block: standard deviation (rows, columns), and correlations at the offsets, NaN without noise."""
    b = grid(residual, size)
    b = b - b.mean(axis=(2, 3), keepdims=True)
    variance = (b * b).mean(axis=(2, 3))
    measured = variance > 1e-12
    lags = np.full((*variance.shape, len(LAGS)), np.nan)
    for k, (dy, dx) in enumerate(LAGS):
        a = b[:, :, : size - dy, max(0, -dx) : size - max(0, dx)]
        c = b[:, :, dy:, max(0, dx) : size - max(0, -dx)]
        with np.errstate(divide="ignore", invalid="ignore"):
            lags[..., k] = np.where(measured, np.clip((a * c).mean(axis=(2, 3)) / variance, -1, 1), np.nan)
    return np.where(measured, np.sqrt(variance), 0.0), lags


def leave_one_out_medians(values: np.ndarray) -> np.ndarray:
    """Along the first axis: the median of the others; the values themselves if there is one.

    It is made of values at two of three places around the middle, and which ones depends only on whether the own value
    lies below, at or above the middle.  Of equal values any may be taken for the own one.
    """
    n = len(values)
    if n < 2:
        return values
    h = n // 2
    low, mid, high = np.partition(values, [max(0, h - 1), h, min(n - 1, h + 1)], axis=0)[[max(0, h - 1), h, min(n - 1, h + 1)]]
    if n % 2 == 0:
        return np.where(values <= low, mid, low)
    return np.where(values < mid, (mid + high) / 2, np.where(values == mid, (low + high) / 2, (low + mid) / 2))


def peak_to_correlation_energy(residual: np.ndarray, pattern: np.ndarray, radius: int = 5) -> tuple[float, float] | None:
    """(correlation at no shift, its signed square over the mean square elsewhere); None without energy."""
    shape = [1 << max(0, n - 1).bit_length() for n in residual.shape]
    a, b = residual - residual.mean(), pattern - pattern.mean()
    na, nb = np.sqrt((a * a).sum()), np.sqrt((b * b).sum())
    if na * na <= 1e-12 * a.size or nb * nb <= 1e-12 * b.size:
        return None
    rho = np.fft.ifft2(np.fft.fft2(a, shape) * np.conj(np.fft.fft2(b, shape))).real / (na * nb)
    far = [np.minimum(np.arange(n), n - np.arange(n)) > radius for n in shape]
    rest = rho[far[0][:, None] | far[1][None]]
    floor = float((rest * rest).mean()) if rest.size else 0.0
    peak = float(rho[0, 0])
    return (max(-1.0, min(1.0, peak)), np.copysign(peak * peak / floor, peak)) if floor > 0 else None


def power_spectrum(plane: np.ndarray, windowed: bool = True) -> np.ndarray:
    n = len(plane)
    p = plane - plane.mean()
    if windowed:
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        p = p * np.outer(w, w)
    return np.abs(np.fft.fft2(p)) ** 2


def lattice_bins(size: int, periods: tuple[int, ...] = (2, 4, 8)) -> list[tuple[int, int]]:
    """(v, u) of the lattice frequencies, one of each conjugate pair, in order."""
    bins = {(j * (size // p), i * (size // p)) for p in periods if size % p == 0 for j in range(p) for i in range(p) if i or j}
    return sorted({min(b, ((size - b[0]) % size, (size - b[1]) % size)) for b in bins})


def lattice_peaks(luma: np.ndarray) -> tuple[tuple[int, int, int], list[tuple[int, int, int, float]]] | str:
    """The square crop (x, y, size) and (u, v, period, ratio of peak to surroundings) of each lattice bin, or why not."""
    h, w = luma.shape
    if min(h, w) < 64:
        return "the image is too small for a spectrum"
    size = min(512, 1 << (min(h, w).bit_length() - 1))
    y, x = (h - size) // 2, (w - size) // 2
    crop = luma[y : y + size, x : x + size]
    rest = crop - box_mean(crop, 3)
    if (rest * rest).mean() < 1e-4:
        return "the analyzed area has no fine detail"
    power = power_spectrum(rest)
    floor = max((power.sum() - power[0, 0]) / (power.size - 1) * 1e-9, np.finfo(float).tiny)
    d = np.arange(-4, 5)
    ring = np.maximum(np.abs(d)[:, None], np.abs(d)[None]) >= 2
    peaks = []
    for v, u in lattice_bins(size):
        around = power[np.ix_((v + d) % size, (u + d) % size)]
        period = next(p for p in (2, 4, 8) if u * p % size == 0 and v * p % size == 0)
        peaks.append((u, v, period, float(min(1e6, around[3:6, 3:6].max() / max(np.median(around[ring]), floor)))))
    return (x, y, size), peaks
