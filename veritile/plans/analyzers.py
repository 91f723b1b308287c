"""The ten checks of one image.  Each takes an ``Image`` and its settings and gives a ``Finding``.

An image is the unit of work: images do not depend on each other, so a check is a function of one row that runs inside
an Arrow batch, and only its small finding leaves the task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from veritile.functions import features, kernels, thumbnails
from veritile.sources import decode, exif

Region = tuple[int, int, int, int]


class NotPossible(Exception):
    """The check can not run on this input."""


@dataclass
class Image:
    content: bytes
    format: str | None
    pixels: np.ndarray | None = None
    #: Which pixels there are (height, width); None: all.  Error levels, block copies, color filter and noise levels leave out the others.
    there: np.ndarray | None = None

    def need(self) -> np.ndarray:
        if self.pixels is None:
            raise NotPossible("it needs decoded pixels, and this image has none")
        return self.pixels


@dataclass
class Indicator:
    message: str
    weight: float
    regions: list[Region] = field(default_factory=list)


@dataclass
class Finding:
    score: float
    summary: str
    indicators: list[Indicator] = field(default_factory=list)

    def __post_init__(self):
        self.score = float(min(100.0, max(0.0, self.score)))


def clean(summary: str) -> Finding:
    return Finding(0.0, summary)


def _lacking(there: np.ndarray | None, size: int) -> np.ndarray | bool:
    """(rows, columns): which blocks lack a pixel."""
    return False if there is None else ~kernels.grid(there, size).all(axis=(2, 3))


def _never_jpeg(image: Image) -> Finding | None:
    if image.format in ("heif", "webp"):
        return clean(f"Not applicable: {image.format} has another compression history than JPEG.")
    return None


def _worst(order: np.ndarray, regions: list[Region], most: int = 5) -> list[int]:
    """The first ``most`` by rising order, then by row and column."""
    return sorted(range(len(regions)), key=lambda k: (order[k], regions[k][1], regions[k][0]))[:most]


def _area_score(flagged: float, reliable: int, most: float = 70.0) -> float:
    return min(most, flagged / reliable / 0.05 * most)


# Recompression error levels --------------------------------------------------------------------------------------------


def ela(image: Image, s: dict) -> Finding:
    if out := _never_jpeg(image):
        return out
    px = image.need()[..., :3].astype(float)
    levels = [max(1, min(100, q)) for q in s["elaQualityLevels"]] or [70, 80, 90]
    t = s["errorThreshold"]
    errors = np.stack([np.mean([np.abs(px[..., c] - kernels.recompress(px[..., c], q)) for c in range(px.shape[2])], axis=0) for q in levels])
    agree = (errors >= t).sum(0)
    weighted = errors.max(0) * agree / len(levels)
    h, w = weighted.shape
    ys, xs = np.arange(0, h, 16), np.arange(0, w, 16)
    sums = lambda a: np.add.reduceat(np.add.reduceat(a, ys, 0), xs, 1)
    n = np.outer(np.minimum(16, h - ys), np.minimum(16, w - xs))
    if image.there is not None:
        weighted, agree, n = weighted * image.there, agree * image.there, sums(image.there.astype(int))
        if not n.any():
            return clean("There are no pixels.")
    mean, level = sums(weighted) / np.maximum(n, 1), sums(agree.astype(float)) / np.maximum(n, 1)
    typical = weighted.sum() / n.sum()
    hot = (mean >= t) & (n > 0)
    share = n[hot].sum() / n.sum()
    coverage = min(60.0, share / max(s["flaggedRegionFraction"], 0.0001) * 60)
    worst = mean[hot].max() if hot.any() else mean[n > 0].max()
    score = coverage + min(40.0, worst / max(2 * t, 1) * 40)
    if not hot.any():
        return Finding(score, f"No error-level anomalies across qualities {levels} (mean {typical:.1f}).")
    regions = [(int(xs[c]), int(ys[r]), int(min(16, w - xs[c])), int(min(16, h - ys[r]))) for r, c in zip(*np.nonzero(hot))]
    out = [Indicator(f"{share * 100:.1f}% of the image, in {len(regions)} cells, has an error level of {t:.1f} or more at qualities {levels}.", coverage, regions)]
    m, a = mean[hot], level[hot]
    for k in _worst(-m, regions):
        out.append(Indicator(f"Cell at {regions[k][:2]}: flagged at {a[k]:.0f} of {len(levels)} qualities, level {m[k]:.1f}; the image's mean is {typical:.1f}.", min(40.0, m[k] / max(t, 1) * 10), [regions[k]]))
    return Finding(score, f"{len(regions)} cells have error levels unlike a single compression history.", out)


# Metadata --------------------------------------------------------------------------------------------------------------


def metadata(image: Image, s: dict) -> Finding:
    if image.format not in ("jpeg", "heif", "webp"):
        return clean(f"{image.format or 'This format'} carries no EXIF metadata.")
    e = exif.read(image.content, image.format)
    if e is None:
        if s["flagMissingExif"] and image.format != "webp":
            return Finding(20, f"There is no EXIF metadata in this {image.format} file.", [Indicator("Camera files nearly always carry EXIF metadata; it may have been stripped.", 20)])
        return clean(f"There is no EXIF metadata in this {image.format} file.")
    seconds = lambda a, b: (a - b).total_seconds() if a and b else None
    software = (e["software"] or "").lower()
    editor = next((k for k in s["suspiciousSoftwareKeywords"] if k.lower() in software), None) if e["software"] else None
    camera = e["make"] is not None or e["model"] is not None
    drift = seconds(e["modified"], e["original"])
    gps, digitized = seconds(e["gps"], e["original"]), seconds(e["digitized"], e["original"])
    fired: list[tuple[bool, str, float]] = [
        (editor is not None, f'The software "{e["software"]}" is an editor ({editor}).', 35),
        (not camera, "No camera make or model is recorded.", 10),
        (drift is not None and drift < 0, "It was modified before it was taken.", 50),
        (drift is not None and drift > s["maxTimestampDriftSeconds"], f"It was modified {(drift or 0) // 86400:.0f} days after it was taken.", 30),
        (e["original"] is None and (e["modified"] or e["digitized"]) is not None, "It has dates, but not the one it was taken at.", 8),
        (gps is not None and abs(gps) > s["maxGPSTimestampDriftSeconds"], f"The GPS clock is {abs(gps or 0) / 60:.0f} minutes off.", 25),
        (digitized is not None and abs(digitized) > s["maxDigitizedDriftSeconds"], f"It was digitized {abs(digitized or 0) / 60:.0f} minutes from when it was taken.", 20),
        (e["has_gps"] and not camera, "It has a place but no camera.", 25),
        (camera and not e["has_gps"], "It has a camera but no place.", 10),
        (e["altitude"] is not None and e["altitude_ref"] is not None and e["altitude"] < 0 and e["altitude_ref"] != 1, "Its altitude is negative, yet said to be above the sea.", 30),
        (editor is not None and None not in (e["make"], e["model"]) and drift == 0, "An editor wrote it, yet it claims to be as the camera left it.", 25),
    ]
    out = [Indicator(m, w) for yes, m, w in fired if yes]
    return Finding(sum(i.weight for i in out), f"{len(out)} metadata anomalies." if out else "The metadata is consistent.", out)


# Copies ----------------------------------------------------------------------------------------------------------------


def clone_reach(s: dict) -> tuple[int, int, int]:
    """Block size, stride, and how far a keypoint's description reaches."""
    return max(4, s["blockSize"]), max(1, s["blockStride"]), features.REACH if s["featureMatchingEnabled"] else 0


def block_candidates(luma: np.ndarray, s: dict, x0: int = 0, y0: int = 0, there: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, feature) of the whole blocks that vary enough; the part begins at (x0, y0) of the image, and the grid is the image's."""
    size, stride, _ = clone_reach(s)
    top, left = -y0 % stride, -x0 % stride
    part = luma[top:, left:]
    if part.shape[0] < size or part.shape[1] < size:
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, 16))
    views = lambda a: np.lib.stride_tricks.sliding_window_view(a, (size, size))[::stride, ::stride]
    usable = views(part).var(axis=(2, 3)) >= s["minimumBlockVariance"]
    if there is not None:
        usable &= views(there[top:, left:]).all(axis=(2, 3))
    row, col = np.nonzero(usable)
    y, x = row * stride, col * stride
    # Cell sums of all blocks come from running sums, so a block costs 25 reads whatever its size.
    total = np.pad(part.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cuts = [k * size // 4 for k in range(4)]
    ends = [*cuts[1:], size]
    feature = np.empty((len(y), 16))
    for a in range(4):
        for b in range(4):
            u0, u1, v0, v1 = y + cuts[a], y + max(cuts[a] + 1, ends[a]), x + cuts[b], x + max(cuts[b] + 1, ends[b])
            feature[:, 4 * a + b] = (total[u1, v1] - total[u0, v1] - total[u1, v0] + total[u0, v0]) / ((u1 - u0) * (v1 - v0))
    return x + x0 + left, y + y0 + top, feature


def pooled_candidates(luma: np.ndarray, s: dict, plan: list, there: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks that begin in the cores of tiles (core, core with halo), in the order of the whole image."""
    parts = []
    for (cx, cy, cw, ch), (x0, y0, w, h) in plan:
        x, y, feature = block_candidates(luma[y0 : y0 + h, x0 : x0 + w], s, x0, y0, None if there is None else there[y0 : y0 + h, x0 : x0 + w])
        own = (x >= cx) & (x < cx + cw) & (y >= cy) & (y < cy + ch)
        parts.append((x[own], y[own], feature[own]))
    x, y, feature = map(np.concatenate, zip(*parts))
    order = np.lexsort((x, y))
    return x[order], y[order], feature[order]


def block_matches(luma: np.ndarray, s: dict, plan: list | None = None, there: np.ndarray | None = None) -> tuple[int, list[tuple[tuple[int, int], tuple[int, int], float]]]:
    """How many blocks vary enough, and pairs of like blocks ((x, y), (x, y), distance) in order; any two of the image may be a pair."""
    x, y, feature = pooled_candidates(luma, s, plan, there) if plan else block_candidates(luma, s, there=there)
    t, apart = s["similarityThreshold"], s["minimumBlockDistance"]
    # Like blocks differ by at most 4t in the sum of their features: sorted by it, a block meets a short run only.
    key = feature.sum(1)
    order = np.argsort(key, kind="stable")
    until = np.searchsorted(key[order], key[order] + 4 * t, "right")
    sorted_, px_, py_ = feature[order], x[order], y[order]
    norms = (sorted_ * sorted_).sum(1)
    out = []
    for lo in range(0, len(order), 128):
        rows, hi = np.arange(lo, min(lo + 128, len(order))), int(until[min(lo + 128, len(order)) - 1])
        cols = np.arange(lo, hi)
        # The product form is a little off, so it only picks candidates; their distance is then taken exactly.
        rough = norms[rows, None] + norms[cols] - 2 * sorted_[rows] @ sorted_[cols].T <= t * t + 1e-6 * (1 + norms[rows, None])
        rough &= cols > rows[:, None]
        rough &= (px_[rows, None] - px_[cols]) ** 2 + (py_[rows, None] - py_[cols]) ** 2 >= apart * apart
        i, j = np.nonzero(rough)
        i, j = rows[i], cols[j]
        d = np.sqrt(((sorted_[i] - sorted_[j]) ** 2).sum(1))
        ok = d <= t
        out += [(min(a, b), max(a, b), float(v)) for a, b, v in zip(order[i[ok]], order[j[ok]], d[ok])]
    out.sort()
    return len(y), [((int(x[i]), int(y[i])), (int(x[j]), int(y[j])), v) for i, j, v in out]


def clone(image: Image, s: dict, plan: list | None = None) -> Finding:
    px = image.need()
    size = max(4, s["blockSize"])
    h, w = px.shape[:2]
    if h < size or w < size:
        return clean("The image is smaller than one block.")
    luma = kernels.rounded_luma(px)
    candidates, pairs = block_matches(luma, s, plan, image.there)
    copied = features.copies(luma, s["minimumMatchedKeypoints"], s["ransacReprojectionThreshold"], s["maximumKeypoints"], s["minimumBlockDistance"], plan) if s["featureMatchingEnabled"] else []
    if not pairs and not copied:
        return clean("No duplicated regions." if candidates > 1 else "There is nothing but flat areas to compare.")
    score, out = 0.0, []
    if pairs:
        ends = sorted({p for a, b, _ in pairs for p in (a, b)}, key=lambda p: (p[1], p[0]))
        covered = min(1.0, len(ends) * size * size / (w * h))
        area = min(80.0, covered / 0.02 * 80)
        score = area + min(20.0, len(pairs))
        out.append(Indicator(f"{len(pairs)} pairs of like blocks cover {covered * 100:.1f}% of the image.", area, [(*p, size, size) for p in ends]))
        for a, b, d in sorted(pairs, key=lambda p: (p[2], p[0][::-1], p[1][::-1]))[:5]:
            out.append(Indicator(f"The block at {a} is like the one at {b} (distance {d:.2f}, {math.dist(a, b):.0f} px apart).", min(20.0, max(0.0, s["similarityThreshold"] - d) * 4), [(*a, size, size), (*b, size, size)]))

    def worth(boxes: list[Region], inliers: int) -> float:
        return min(80.0, min(1.0, sum(b[2] * b[3] for b in boxes) / (w * h)) / 0.02 * 80) + min(20.0, inliers)

    if copied:
        score = max(score, worth([b for c in copied for b in (c["source"], c["target"])], sum(c["inliers"] for c in copied)))
    for c in copied:
        both = [c["source"], c["target"]]
        out.append(Indicator(f"The region {both[0]} is found again at {both[1]}, turned by {c['degrees']:.1f} degrees and scaled by {c['scale']:.2f} ({c['inliers']} matches agree).", worth(both, c["inliers"]), both))
    return Finding(score, f"{len(pairs)} like block pairs and {len(copied)} turned or scaled copies suggest copy-move editing.", out)


# Double compression ----------------------------------------------------------------------------------------------------


def periodicity(counts: np.ndarray) -> float:
    """The share of the strongest frequency in a histogram less its moving mean; empty bins do not count."""
    full = counts[counts > 0].astype(float)
    n = len(full)
    if n < 8:
        return 0.0
    rest = full - np.array([full[max(0, k - 3) : k + 4].mean() for k in range(n)])
    size = np.abs(np.fft.fft(rest))[1 : n // 2 + 1]
    return float(size.max() / size.sum()) if size.sum() > 0 else 0.0


def double_compression(image: Image, s: dict) -> Finding:
    if out := _never_jpeg(image):
        return out
    if image.format != "jpeg":
        return clean(f"{image.format or 'This format'} has no JPEG history; not applicable.")
    luma = kernels.rounded_luma(image.need())
    row, col = (max(0, min(7, s[k])) for k in ("acCoefficientRow", "acCoefficientColumn"))
    weights = np.outer(kernels.COSINE[row], kernels.COSINE[col])
    best = None
    for oy in range(0, 8, 2):
        for ox in range(0, 8, 2):
            b = kernels.grid(luma[oy:, ox:] - 128, 8)
            if b.shape[0] * b.shape[1] < 16:
                continue
            c = np.round(np.einsum("rcyx,yx->rc", b, weights), 9).ravel()
            span = max(4, min(200, math.ceil(np.abs(c).max())))
            counts = np.bincount((np.clip(kernels.half_away(c), -span, span) + span).astype(int), minlength=2 * span + 1)
            strength = periodicity(counts)
            if best is None or strength > best[0]:
                best = strength, ox, oy
    if best is None:
        return clean("The image is too small for enough blocks.")
    t = s["periodicityThreshold"]
    if best[0] < t:
        return clean(f"No periodic pattern in coefficient ({row},{col}): {best[0]:.2f}, threshold {t:.2f}.")
    score = min(1.0, (best[0] - t) / max(0.0001, 1 - t)) * 100
    h, w = luma.shape
    region = (best[1], best[2], (w - best[1]) // 8 * 8, (h - best[2]) // 8 * 8)
    return Finding(score, f"Coefficient ({row},{col}) is periodic: the image was likely compressed twice.", [Indicator(f"Strength {best[0]:.2f} on the grid at {best[1:]}, threshold {t:.2f}.", score, [region])])


# Sensor noise ----------------------------------------------------------------------------------------------------------


def _working(px: np.ndarray, s: dict) -> tuple[np.ndarray, int]:
    cap = max(64, s["maximumWorkingDimension"])
    scale = max(1, -(-max(px.shape[:2]) // cap))
    return kernels.box_downsample(kernels.luminance(px), scale), scale


def _clipped(luma: np.ndarray, size: int, low: float = 2, high: float = 253) -> np.ndarray:
    b = kernels.grid(luma, size)
    return ((b <= low) | (b >= high)).mean(axis=(2, 3))


def prnu_blocks(px: np.ndarray, s: dict) -> dict | None:
    """Rows and columns of blocks with deviation, lags, reliability and agreement with the others; None if too small."""
    size = max(16, s["blockSize"])
    luma, scale = _working(px, s)
    if (luma.shape[0] // size) * (luma.shape[1] // size) < 4:
        return None
    sd, lags = kernels.signatures(kernels.noise_residual(luma), size)
    reliable = _clipped(luma, size) <= 0.5
    at = np.nonzero(reliable.ravel())[0]
    sd, lags = sd.ravel()[at], lags.reshape(-1, lags.shape[2])[at]
    level = kernels.leave_one_out_medians(sd)
    measured = ~np.isnan(lags[:, 0])
    typical = np.full_like(lags, np.nan)
    if measured.sum() >= 2:
        typical[measured] = kernels.leave_one_out_medians(lags[measured])
    if measured.any():
        typical[np.isnan(typical[:, 0])] = np.median(lags[measured], axis=0)
    both = measured & (sd > 0) & (level > 0) & ~np.isnan(typical[:, 0])
    agree = np.zeros(len(at))
    agree[both] = np.maximum(0, 1 - np.abs(lags[both] - typical[both]).max(1)) * np.sqrt(np.minimum(sd, level)[both] / np.maximum(sd, level)[both])
    return {"size": size, "scale": scale, "shape": reliable.shape, "at": at, "sd": sd, "lags": lags, "level": level, "agree": agree}


def prnu(image: Image, s: dict, reference: dict | None = None) -> Finding:
    px = image.need()
    local, camera = _local_noise(px, s), _camera(px, s, reference)
    if camera is None:
        return local
    return Finding(max(local.score, camera.score), f"{local.summary} {camera.summary}".strip(), local.indicators + camera.indicators)


def _local_noise(px: np.ndarray, s: dict) -> Finding:
    t = min(1.0, max(0.0, s["correlationThreshold"]))
    b = prnu_blocks(px, s)
    if b is None:
        return clean("The image is too small for a sensor-noise check.")
    if len(b["at"]) < 4:
        return clean(f"Only {len(b['at'])} blocks are not clipped; sensor noise not assessed.")
    if np.median(b["sd"]) < 0.05:
        return clean(f"No measurable sensor noise (median {np.median(b['sd']):.3f}); not assessed.")
    side = b["size"] * b["scale"]
    h, w = px.shape[:2]
    off = np.nonzero(b["agree"] < t)[0]
    if not len(off):
        return clean(f"Sensor noise is consistent across {len(b['at'])} blocks.")
    places = [(int(k % b["shape"][1]) * side, int(k // b["shape"][1]) * side) for k in b["at"][off]]
    regions = [(x, y, min(side, w - x), min(side, h - y)) for x, y in places]
    agree = b["agree"][off]
    severity = np.clip((t - agree) / t, 0, 1) if t > 0 else np.zeros(len(off))
    area = _area_score(len(off), len(b["at"]))
    out = [Indicator(f"{len(off)} of {len(b['at'])} blocks of {side} px have a noise consistency below {t:.2f}.", area, sorted(regions, key=lambda r: (r[1], r[0])))]
    for k in _worst(agree, regions):
        level = b["level"][off[k]]
        ratio = f", noise {b['sd'][off[k]] / level:.2f} times the rest" if level > 0 else ""
        out.append(Indicator(f"Block at {regions[k][:2]}: consistency {agree[k]:.2f}{ratio}.", 30 * severity[k], [regions[k]]))
    return Finding(area + 30 * severity.mean(), f"{len(off)} blocks carry noise unlike the rest.", out)


def analysis_region(h: int, w: int, cap: int) -> Region:
    cap = max(64, cap)
    rw, rh = min(w, cap), min(h, cap)
    return (w - rw) // 2, (h - rh) // 2, rw, rh


class ReferenceError_(ValueError):
    pass


def reference_sums(px: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """What one image adds to numerator and denominator of a camera's pattern; sums of these merge in any order."""
    x, y, w, h = analysis_region(*px.shape[:2], cap)
    luma = kernels.luminance(px)[y : y + h, x : x + w]
    usable = (luma > 2) & (luma < 253)
    return np.where(usable, kernels.noise_residual(luma) * luma, 0.0), np.where(usable, luma * luma, 0.0)


def reference_pattern(images: list[np.ndarray], cap: int = 2048) -> dict:
    """A camera's fingerprint from two or more of its images of one size."""
    if len(images) < 2:
        raise ReferenceError_(f"a reference needs two images, there are {len(images)}")
    if len({p.shape[:2] for p in images}) > 1:
        raise ReferenceError_("reference images must have one size")
    top, low = (sum(p) for p in zip(*(reference_sums(px, cap) for px in images)))
    pattern = kernels.zero_mean(np.divide(top, low, out=np.zeros_like(top), where=low > 0))
    if (pattern * pattern).sum() <= 1e-12 * pattern.size:
        raise ReferenceError_("the reference images have no measurable noise")
    h, w = images[0].shape[:2]
    return {"height": h, "width": w, "count": len(images), "cap": cap, "pattern": pattern}


def verify(px: np.ndarray, reference: dict) -> tuple[str, float | None]:
    """match, mismatch, dimensionMismatch or noMeasurableNoise, and the peak to correlation energy."""
    h, w = px.shape[:2]
    if (h, w) != (reference["height"], reference["width"]):
        return "dimensionMismatch", None
    x, y, rw, rh = analysis_region(h, w, reference["cap"])
    luma = kernels.luminance(px)[y : y + rh, x : x + rw]
    found = kernels.peak_to_correlation_energy(kernels.noise_residual(luma), reference["pattern"] * luma)
    if found is None:
        return "noMeasurableNoise", None
    return ("match" if found[1] >= 60 else "mismatch"), float(found[1])


def _camera(px: np.ndarray, s: dict, reference: dict | None) -> Finding | None:
    if reference is None:
        return Finding(0, "", [Indicator("A reference folder is set, but no fingerprint was loaded.", 0)]) if s["referenceFolder"] else None
    outcome, pce = verify(px, reference)
    if outcome == "match":
        return Finding(0, "Sensor noise matches the reference camera.", [Indicator(f"Peak to correlation energy {pce:.1f}, at least 60.", 0)])
    if outcome == "mismatch":
        score = 60 * min(1.0, reference["count"] / 10)
        return Finding(score, "Sensor noise does not match the reference camera.", [Indicator(f"Peak to correlation energy {pce:.1f}, below 60.", score, [analysis_region(*px.shape[:2], reference["cap"])])])
    return clean("The reference check was skipped: another image size." if pce is None and outcome == "dimensionMismatch" else "The reference check found no noise to compare.")


# Color filter array ----------------------------------------------------------------------------------------------------


def cfa_blocks(px: np.ndarray, size: int, there: np.ndarray | None = None) -> np.ndarray:
    """(3, rows, columns, 4) phase energies; NaN where a block is clipped or too flat in a channel, or lacks pixels."""
    h, w = px.shape[:2]
    rows, cols = h // size, w // size
    out = np.full((3, rows, cols, 4), np.nan)
    for c in range(3):
        plane = px[..., c].astype(np.int32)
        e = np.full(plane.shape, kernels.MISSING, np.int32)
        # Four times the error is a whole number.
        e[1:-1, 1:-1] = np.abs(4 * plane[1:-1, 1:-1] - plane[:-2, 1:-1] - plane[2:, 1:-1] - plane[1:-1, :-2] - plane[1:-1, 2:])
        if there is not None:
            e[1:-1, 1:-1][~(there[1:-1, 1:-1] & there[:-2, 1:-1] & there[2:, 1:-1] & there[1:-1, :-2] & there[1:-1, 2:])] = kernels.MISSING
        whole = e[: rows * size, : cols * size]
        middles = [kernels.block_middles(whole[y::2, x::2], size // 2) for y in (0, 1) for x in (0, 1)]
        energy = np.stack([(low * low + high * high) / 32 for low, high in middles], 2)
        # A block has (size / 2) ** 2 samples of each phase, less those on the image's border; never under 16 from size 16 on.
        ok = (energy.max(2) >= 0.25) & (_clipped(plane, size) <= 0.5) & ~np.asarray(_lacking(there, size))
        out[c][ok] = energy[ok]
    return out


def cfa_strength(energy: np.ndarray, recorded: list[int]) -> np.ndarray:
    others = [k for k in range(4) if k not in recorded]
    return np.log(np.maximum(0.01, energy[..., recorded].mean(-1)) / np.maximum(0.01, energy[..., others].mean(-1)))


def cfa(image: Image, s: dict) -> Finding:
    px = image.need()
    size = max(16, s["blockSize"])
    size += size % 2
    t = s["consistencyThreshold"]
    if px.shape[2] < 3:
        return clean("A gray image has no demosaicing pattern; not applicable.")
    if (px.shape[0] // size) * (px.shape[1] // size) < 4:
        return clean("The image is too small for a color filter check.")
    energy = cfa_blocks(px, size, image.there).reshape(3, -1, 4)
    cols = px.shape[1] // size
    at = np.nonzero(~np.isnan(energy[1, :, 0]))[0]
    if len(at) < max(1, s.get("minimumBlocks", 4)):
        return clean(f"Only {len(at)} blocks have detail enough; not assessed.")
    energy = energy[:, at]
    strength, typical = np.full((3, len(at)), np.nan), np.zeros(3)
    for c in range(3):
        ok = ~np.isnan(energy[c, :, 0])
        if not ok.any():
            continue
        total = energy[c, ok].sum(1, keepdims=True)
        votes = np.divide(energy[c, ok], total, out=np.zeros_like(energy[c, ok]), where=total > 0).sum(0)
        recorded = ([0, 3] if votes[0] + votes[3] >= votes[1] + votes[2] else [1, 2]) if c == 1 else [int(votes.argmax())]
        strength[c, ok] = cfa_strength(energy[c, ok], recorded)
        typical[c] = np.median(strength[c, ok])
    if typical[1] < 0.4:
        return clean(f"No demosaicing pattern across the image (strength {typical[1]:.2f}); not assessed.")
    used = [c for c in range(3) if typical[c] >= 0.4]
    weight = np.array([1.0, 2.0, 1.0])[used, None] * ~np.isnan(strength[used])
    agree = (np.nan_to_num(strength[used]) / typical[used][:, None] * weight).sum(0) / weight.sum(0)
    off = np.nonzero(agree < t)[0]
    if not len(off):
        return clean(f"The demosaicing pattern is consistent across {len(at)} blocks (strength {typical[1]:.2f}).")
    regions = [(int(k % cols) * size, int(k // cols) * size, size, size) for k in at[off]]
    severity = np.clip((t - agree[off]) / t, 0, 1) if t > 0 else np.zeros(len(off))
    area = _area_score(len(off), len(at))
    out = [Indicator(f"{len(off)} of {len(at)} blocks of {size} px have a trace below {t:.2f} of the image's.", area, sorted(regions, key=lambda r: (r[1], r[0])))]
    for k in _worst(agree[off], regions):
        why = "it sits on the opposite lattice" if strength[1, off[k]] < -0.4 else "it is missing or weak"
        out.append(Indicator(f"Block at {regions[k][:2]}: trace {agree[off[k]]:.2f}; {why}.", 30 * severity[k], [regions[k]]))
    return Finding(area + 30 * severity.mean(), f"{len(off)} blocks lack the demosaicing pattern of the rest.", out)


# Ghosts ----------------------------------------------------------------------------------------------------------------


def ghost(curve: np.ndarray, levels: list[int]) -> int | None:
    """The lowest quality where a curve dips by 30 percent below its neighbours; the last level never counts."""
    for k in range(len(levels) - 1):
        near = curve[k + 1] if k == 0 else min(curve[k - 1], curve[k + 1])
        if curve[k] < near and curve[k] <= 0.7 * near:
            return levels[k]
    return None


def jpeg_ghost(image: Image, s: dict) -> Finding:
    from veritile.operators.dct import qualities

    if out := _never_jpeg(image):
        return out
    px = image.need()
    size = (max(16, s["blockSize"]) + 7) // 8 * 8
    t = max(1, s["disagreementThreshold"])
    levels = qualities(s["minimumQuality"], s["maximumQuality"], s["qualityStep"])
    if len(levels) < 3:
        return clean("Three qualities are needed at least.")
    luma = kernels.rounded_luma(px) if px.shape[2] > 1 else px[..., 0].astype(float)
    cols = luma.shape[1] // size
    if cols * (luma.shape[0] // size) < 4:
        return clean("The image is too small for a ghost check.")
    curves = np.stack([(kernels.grid(luma - kernels.recompress(luma, q), size) ** 2).mean(axis=(2, 3)).ravel() for q in levels], 1)
    measured = curves.max(1) >= 0.5
    if measured.sum() < 4:
        return clean(f"Only {measured.sum()} blocks are changed by recompression; not assessed.")
    found = [ghost(c, levels) if m else None for c, m in zip(curves, measured)]
    at = np.array([k for k, q in enumerate(found) if q is not None], int)
    if not len(at) or len(at) < 0.5 * measured.sum():
        return clean("No JPEG compression history was found; not applicable.")
    q = np.array([found[k] for k in at])
    values, n = np.unique(q, return_counts=True)
    most = int(values[n.argmax()])  # the lower of equals
    off = np.nonzero(np.abs(q - most) >= t)[0]
    if not len(off):
        return clean(f"All {len(at)} blocks share a ghost at quality {most}.")
    regions = [(int(k % cols) * size, int(k // cols) * size, size, size) for k in at[off]]
    severity = np.minimum(1, np.abs(q[off] - most) / (2 * t))
    area = _area_score(len(off), len(at))
    out = [Indicator(f"{len(off)} of {len(at)} blocks of {size} px have a ghost at quality {sorted(set(q[off].tolist()))}; the image has {most}.", area, sorted(regions, key=lambda r: (r[1], r[0])))]
    out += [Indicator(f"Block at {regions[k][:2]}: ghost at quality {q[off[k]]}, the image has {most}.", 30 * severity[k], [regions[k]]) for k in _worst(-severity, regions)]
    return Finding(area + 30 * severity.mean(), f"{len(off)} blocks were compressed at another quality.", out)


# Thumbnail -------------------------------------------------------------------------------------------------------------


def thumbnail(image: Image, s: dict) -> Finding:
    skip = lambda why: clean(f"{why} The thumbnail check is not applicable.")
    if image.format not in ("jpeg", "heif", "webp"):
        return skip("The format carries no thumbnail.")
    e = exif.read(image.content, image.format)
    if e is None or e["thumbnail"] is None:
        return skip("There is no EXIF thumbnail.")
    if e["thumbnail"]["jpeg"] is None:
        return skip("The thumbnail is uncompressed or out of place.")
    try:
        small = decode.decode_jpeg(e["thumbnail"]["jpeg"], gray=True)[..., 0].astype(float)
    except decode.DecodeError as why:
        return skip(f"The thumbnail can not be decoded ({why}).")
    part = thumbnails.content(small)
    if min(part[2:]) < 8:
        return skip("The thumbnail is too small.")
    try:
        if image.pixels is not None:
            main = kernels.luminance(image.pixels)
            h, w = main.shape
        else:
            w, h = decode.jpeg_size(image.content)
            eighth = w // 8 >= part[2] and h // 8 >= part[3]
            main = decode.decode_jpeg(image.content, eighth=eighth, gray=True)[..., 0].astype(float)
    except decode.DecodeError as why:
        return skip(f"The image can not be decoded ({why}).")
    t = s["similarityThreshold"]
    gap = thumbnails.aspect_difference(w, h, part[2], part[3])
    reframed = gap > 0.04
    x, y, cw, ch = thumbnails.centred(part, w / h) if reframed else part
    found = thumbnails.compare(thumbnails.resample(main, cw, ch), small[y : y + ch, x : x + cw])
    if found is None:
        return skip("Both are featureless.")
    similarity, cell = found
    score, out, said = 0.0, [], []
    if similarity < t:
        score = 60 + 30 * min(1.0, (t - similarity) / max(t, 0.01))
        regions = []
        if cell:
            fx, fy = w / max(1, cw), h / max(1, ch)
            x0, y0 = math.floor(cell[0] * fx), math.floor(cell[1] * fy)
            regions = [(x0, y0, max(0, min(w, math.ceil((cell[0] + cell[2]) * fx)) - x0), max(0, min(h, math.ceil((cell[1] + cell[3]) * fy)) - y0))]
        out.append(Indicator(f"The thumbnail's content differs (similarity {similarity:.2f}, threshold {t:.2f}).", score, regions))
        said.append("The thumbnail does not show the image.")
    if reframed:
        score = max(score, 35.0)
        out.append(Indicator(f"The thumbnail's shape {part[2]}x{part[3]} is not that of the image {w}x{h}.", 35))
        said.append("The image was cropped or reframed.")
    return Finding(score, " ".join(said), out) if said else clean(f"The thumbnail matches the image (similarity {similarity:.2f}).")


# Signs of synthesis ----------------------------------------------------------------------------------------------------


def presence(px: np.ndarray, s: dict) -> tuple[int, int, float] | str:
    """Reliable blocks, those with camera-like noise and the median level; or why it can not be told."""
    size = max(16, s["blockSize"])
    luma, scale = _working(px, s)
    if min(luma.shape) < size:
        return "the image is smaller than a block"
    sd, lags = kernels.signatures(kernels.noise_residual(luma) * scale, size)
    ok = _clipped(luma, size) <= 0.5
    if ok.sum() < 4:
        return f"only {ok.sum()} blocks are not clipped"
    with np.errstate(invalid="ignore"):
        like = (sd >= 0.6) & (np.abs(lags) <= 0.7).all(2)
    return int(ok.sum()), int((like & ok).sum()), float(np.median(sd[ok]))


def _strongest(flagged: list[tuple]) -> str:
    """The five strongest peaks, in order."""
    return ": " + ", ".join(f"({u},{v}) of period {period} by {ratio:.1f}" for u, v, period, ratio in flagged[:5]) if flagged else ""


def ai_generated(image: Image, s: dict, prnu_settings: dict) -> Finding:
    px = image.need()
    unit = lambda v, other=0.0: min(1.0, max(0.0, v)) if math.isfinite(v) else other
    t = 10 ** (2 - unit(s["spectralSensitivity"], 0.5))
    cover = unit(s["prnuAbsenceThreshold"])
    spectral, noise = kernels.lattice_peaks(kernels.luminance(px)), presence(px, prnu_settings)
    top, a = 0.0, 0.0
    if isinstance(spectral, str):
        first = Indicator(f"Spectrum not measured: {spectral}.", 0)
    else:
        (x, y, n), peaks = spectral
        best = max(peaks, key=lambda p: p[3])
        flagged = sorted((p for p in peaks if p[3] >= t), key=lambda p: -p[3])
        top = min(1.0, 0.5 + 0.5 * math.log10(best[3] / t) / math.log10(30)) if flagged else 0.0
        first = Indicator(f"{len(flagged)} lattice frequencies stand out by {t:.1f} or more{_strongest(flagged)}; the greatest of all is {best[3]:.1f} at ({best[0]},{best[1]}).", 75 * top, [(x, y, n, n)] if flagged else [])
    if isinstance(noise, str):
        second = Indicator(f"Sensor noise not assessed: {noise}.", 0)
    else:
        share = noise[1] / noise[0]
        a = unit((cover - share) / cover) if cover > 0 else 0.0
        second = Indicator(f"{noise[1]} of {noise[0]} blocks carry camera-like noise (median {noise[2]:.2f}).", 75 * a)
    chance = min(top, a) + unit(s["singleSignalWeight"]) * (max(top, a) - min(top, a))
    if isinstance(spectral, str) and isinstance(noise, str):
        summary = "Not assessed: too small, flat or clipped."
    elif chance > 0:
        summary = f"Signs of synthesis (likelihood {chance:.0%})."
    else:
        summary = "No combination of signs of synthesis."
    return Finding(75 * chance, summary, [first, second])


# Noise level -----------------------------------------------------------------------------------------------------------

K = 1.482602218505602


def noise_blocks(px: np.ndarray, size: int, there: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of noise level and mean luma; NaN where a block is clipped or lacks pixels."""
    luma = kernels.milli_luma(px)
    h = np.full(luma.shape, kernels.MISSING, np.int32)
    h[1:-1, 1:-1] = np.abs(kernels.high_pass(luma))
    if there is not None:
        h[1:-1, 1:-1][~np.lib.stride_tricks.sliding_window_view(there, (3, 3)).all(axis=(2, 3))] = kernels.MISSING
    low, high = kernels.block_middles(h, size)
    sigma = K / 6 * (low + high) / 2000
    mean = kernels.grid(luma, size).mean(axis=(2, 3)) / 1000
    bad = (_clipped(luma, size, 2500, 252_500) > 0.5) | _lacking(there, size)
    return np.where(bad, np.nan, sigma), np.where(bad, np.nan, mean)


def noise_level(image: Image, s: dict) -> Finding:
    px = image.need()
    size = max(16, s["blockSize"])
    if (px.shape[0] // size) * (px.shape[1] // size) < 4:
        return clean("The image is too small for a noise-level check; not assessed.")
    sigma, luma = noise_blocks(px, size, image.there)
    cols = sigma.shape[1]
    at = np.nonzero(~np.isnan(sigma.ravel()))[0]
    sigma, luma = sigma.ravel()[at], luma.ravel()[at]
    if len(at) < max(1, s.get("minimumBlocks", 4)):
        return clean(f"Only {len(at)} blocks are not clipped; not assessed.")
    typical = np.median(sigma)
    if typical < 0.05:
        return clean(f"No measurable noise ({typical:.2f}); not assessed.")
    logs = np.log(sigma[sigma > 0] / typical)
    spread = 3 * K * np.median(np.abs(logs - np.median(logs)))
    finite = lambda v, other: v if math.isfinite(v) else other
    low = min(min(0.99, max(0.01, finite(s["smoothThreshold"], 0.5))), math.exp(-spread))
    high = max(max(1.01, finite(s["noisyThreshold"], 2.0)), math.exp(spread))
    ratio = sigma / typical
    smooth, noisy = ratio < low, ratio > high
    off = np.nonzero(smooth | noisy)[0]
    if not len(off):
        return clean(f"The noise level is consistent across {len(at)} blocks ({typical:.2f}).")
    expected = np.sqrt(np.maximum(luma, 1) / max(np.median(luma), 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        mismatch = ratio / expected
        severity = np.where(smooth, np.clip((low - ratio) / low, 0, 1), np.clip(np.log(ratio / high) / math.log(2), 0, 1))
    explained = (ratio > 0) & np.where(smooth, expected < 1, expected > 1) & (mismatch >= 1 / 1.5) & (mismatch <= 1.5)
    weight = np.where(explained, 0.25, 1.0)[off]
    severity, total = severity[off], weight.sum()
    area = _area_score(total, len(at), 55.0)
    regions = [(int(k % cols) * size, int(k // cols) * size, size, size) for k in at[off]]
    out = []
    for mask, name in ((smooth[off], f"less than {low:.2f}"), (noisy[off], f"more than {high:.2f}")):
        if mask.any():
            own = sorted((r for r, m in zip(regions, mask) if m), key=lambda r: (r[1], r[0]))
            out.append(Indicator(f"{mask.sum()} of {len(at)} blocks of {size} px have {name} times the typical noise.", area * weight[mask].sum() / total, own))
    for k in _worst(-severity * weight, regions):
        out.append(Indicator(f"Block at {regions[k][:2]}: noise {sigma[off[k]]:.2f}, {ratio[off[k]]:.2f} times the typical{'; its brightness may explain it' if explained[off[k]] else ''}.", 25 * severity[k] * weight[k], [regions[k]]))
    return Finding(area + 25 * (severity * weight).sum() / total, f"{len(off)} blocks have a noise level unlike the rest ({smooth.sum()} too smooth, {noisy.sum()} too noisy).", out)


#: id: (section of the settings, check), in the order of a report.
ANALYZERS = {
    "ela": ("ela", ela),
    "metadata": ("metadata", metadata),
    "clone": ("cloneDetection", clone),
    "doublecompression": ("doubleCompression", double_compression),
    "prnu": ("prnu", prnu),
    "cfa": ("cfa", cfa),
    "jpegghost": ("jpegGhost", jpeg_ghost),
    "thumbnail": ("thumbnail", thumbnail),
    "aigenerated": ("aiGenerated", ai_generated),
    "noiselevel": ("noiseLevel", noise_level),
}
