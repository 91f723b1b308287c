"""Images to findings to reports, as DataFrames.

``findings`` is one narrow pass: a task reads a file, decodes it and runs the checks that are asked for; its rows are a
few hundred bytes for each image, so everything after it is small.  Large images are analyzed in tiles inside the task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritile.config import default
from veritile.functions import kernels
from veritile.functions.scalar import verdict
from veritile.operators.scoring import combined_score, top_contributors
from veritile.plans import analyzers as A
from veritile.sources import decode

REGION = "struct<x:int,y:int,width:int,height:int>"
FINDINGS = f"image_id string, format string, reason string, run_order int, analyzer_id string, score double, summary string, indicators array<struct<message:string,weight:double,regions:array<{REGION}>>>"
#: What broken files raise; an optional imaging library raises OSError.
UNREADABLE = (decode.DecodeError, ValueError, LookupError, ArithmeticError, MemoryError, OSError, struct.error)
#: Checks that run tile by tile on a large image; copies are searched among what all tiles hold; the others take it whole.
TILED, POOLED = ("ela", "doublecompression"), "clone"


def load(content: bytes, fmt: str | None) -> A.Image:
    """Decoded where there is a decoder; a JPEG file keeps its bytes only.  Raises DecodeError for what can not be read."""
    if fmt is None:
        raise decode.DecodeError("unknown format (bad magic bytes)")
    if fmt == "jpeg":
        return A.Image(content, fmt)
    run = decode.DECODERS.get(fmt)
    if run is None:
        if fmt == "webp" and content[12:16] == b"VP8X" and content[20:21] and content[20] & 2:
            raise decode.DecodeError("animated images are not read")
        run, why = decode.optional_codec(fmt)
        if run is None:
            raise decode.DecodeError(why)
    return A.Image(content, fmt, run(content))


def tiles(height: int, width: int, size: int, halo: int) -> list[tuple[A.Region, A.Region]]:
    """Core and core with halo, as (x, y, width, height); sizes are multiples of 8."""
    size = max(8, int(kernels.half_away(np.float64(size / 8))) * 8)
    halo = min(size, max(0, int(kernels.half_away(np.float64(halo / 8))) * 8))
    out = []
    for y in range(0, height, size):
        for x in range(0, width, size):
            w, h = min(size, width - x), min(size, height - y)
            x0, y0 = max(0, x - halo), max(0, y - halo)
            out.append(((x, y, w, h), (x0, y0, min(width, x + w + halo) - x0, min(height, y + h + halo) - y0)))
    return out


def tiling(image: A.Image, s: dict, forced: int | None, off: bool) -> list | None:
    if image.pixels is None or off:
        return None
    h, w = image.pixels.shape[:2]
    if forced is None and not (s["enabled"] and max(h, w) > s["tilingThreshold"]):
        return None
    plan = tiles(h, w, forced or s["tileSize"], s["tileOverlap"])
    return plan if len(plan) > 1 else None


def _by_tile(check, image: A.Image, plan: list) -> A.Finding:
    """The hottest tile's score, and of the other hot ones a twentieth each up to 20; regions are cut to the cores."""
    hot = []
    for core, (x, y, w, h) in plan:
        part = lambda a, y=y, x=x, h=h, w=w: a[y : y + h, x : x + w]
        f = check(A.Image(image.content, image.format, part(image.pixels), None if image.there is None else part(image.there)))
        if f.score > 0:
            hot.append((f, core, x, y))
    if not hot:
        return A.clean(f"No anomalies in {len(plan)} tiles.")
    hot.sort(key=lambda t: (-t[0].score, t[1][1], t[1][0]))
    out = []
    for f, (cx, cy, cw, ch), x, y in hot[:5]:
        for i in f.indicators[:3]:
            regions = []
            for rx, ry, rw, rh in i.regions:
                x0, y0, x1, y1 = max(cx, rx + x), max(cy, ry + y), min(cx + cw, rx + x + rw), min(cy + ch, ry + y + rh)
                if x1 > x0 and y1 > y0:
                    regions.append((x0, y0, x1 - x0, y1 - y0))
            out.append(A.Indicator(f"[tile at ({cx},{cy})] {i.message}", i.weight, regions))
    score = hot[0][0].score + min(20.0, 0.05 * sum(t[0].score for t in hot[1:]))
    return A.Finding(score, f"{len(hot)} of {len(plan)} tiles flagged; the strongest: {hot[0][0].summary}", out)


def analyze(image: A.Image, config: dict, only: set[str] | None = None, reference: dict | None = None, forced_tile: int | None = None, no_tiling: bool = False) -> list[tuple[str, A.Finding]]:
    """(id, finding) of the enabled checks; one that can not run says so with score 0."""
    plan = tiling(image, config["tiling"], forced_tile, no_tiling)
    out = []
    for name, (section, check) in A.ANALYZERS.items():
        s = config[section]
        if not s["enabled"] or (only is not None and name not in only):
            continue
        more = {"prnu": (reference,), "aigenerated": (config["prnu"],)}.get(name, ())
        run = lambda im, check=check, s=s, more=more: check(im, s, *more)
        try:
            if plan and name == POOLED:
                size, _, reach = A.clone_reach(s)
                halo = max(config["tiling"]["tileOverlap"], -(-size // 8) * 8, -(-reach // 8) * 8)
                h, w = image.pixels.shape[:2]
                f = A.clone(image, s, tiles(h, w, forced_tile or config["tiling"]["tileSize"], halo))
            else:
                f = _by_tile(run, image, plan) if plan and name in TILED else run(image)
        except A.NotPossible as why:
            f = A.clean(f"Could not run: {why}.")
        out.append((name, f))
    return out


def findings(images: DataFrame, config: dict | None = None, only: list[str] | None = None, reference: dict | None = None, forced_tile: int | None = None, no_tiling: bool = False) -> DataFrame:
    """A row for each image of (image_id, format, content) and check; one row with a ``reason`` for a skipped image.

    A column ``places`` names the pixels that there are, counted row by row; null: all.
    """
    config, chosen = config or default(), set(only) if only else None
    if chosen and (wrong := chosen - set(A.ANALYZERS)):
        raise ValueError(f"unknown checks: {sorted(wrong)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, fmt, content, places in zip(*(b.column(k) for k in range(4))):
                i, fmt, content = i.as_py(), fmt.as_py(), content.as_py()
                rows = []
                try:
                    image = load(content or b"", fmt)
                    if places.is_valid and image.pixels is not None:
                        image.there = np.zeros(image.pixels.shape[:2], bool)
                        image.there.reshape(-1)[places.values.to_numpy()] = True
                    for k, (name, f) in enumerate(analyze(image, config, chosen, reference, forced_tile, no_tiling)):
                        said = [{"message": x.message, "weight": float(x.weight), "regions": [dict(zip(("x", "y", "width", "height"), map(int, r))) for r in x.regions]} for x in f.indicators]
                        rows.append((i, fmt, None, k, name, f.score, f.summary, said))
                except UNREADABLE as why:  # one file never fails the job
                    rows = [(i, fmt, str(why), None, None, None, None, None)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T._parse_datatype_string(FINDINGS))
    places = F.col("places") if "places" in images.columns else F.lit(None)
    return images.select(F.col("image_id").cast("string"), "format", "content", places.cast("array<int>").alias("places")).mapInArrow(run, FINDINGS)


def reports(found: DataFrame) -> DataFrame:
    """A row for each image: score, verdict, findings in order and top contributors; or the reason it was skipped."""
    one = F.struct("run_order", "analyzer_id", "score", "summary", "indicators")
    each = found.groupBy("image_id").agg(
        F.max("reason").alias("reason"),
        F.when(F.count("analyzer_id") > 0, combined_score(F.col("score"))).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("analyzer_id").isNotNull(), one))).alias("findings"),
    )
    best = top_contributors(F.transform("findings", lambda f: F.struct(f.score.alias("score"), f.analyzer_id.alias("analyzer_id"))))
    return each.select(
        F.col("image_id").alias("path"), "score", F.when(F.col("score").isNotNull(), verdict(F.col("score"))).alias("verdict"), "findings", best.alias("contributors"), "reason",
        F.when(F.col("reason").isNull(), "analyzed").otherwise("skipped").alias("status"),
    )


def camera_reference(images: DataFrame, config: dict | None = None) -> dict:
    """The fingerprint of a camera from its images; every image must be read and have one size.

    A task adds up its images, so what is shuffled is one plane for each task and size, line by line; what comes back is
    one plane.
    """
    cap = max(64, (config or default())["prnu"]["maximumWorkingDimension"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            for fmt, content in zip(b.column(0), b.column(1)):
                px = load(content.as_py(), fmt.as_py()).need()
                top, low = A.reference_sums(px, cap)
                held = sums.setdefault(px.shape[:2], [0, 0.0, 0.0])
                held[:] = held[0] + 1, held[1] + top, held[2] + low
        for (h, w), (n, *planes) in sums.items():
            lines = [pa.array([row.tobytes() for row in m]) for m in planes]
            rows = len(planes[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), *(pa.array([k] * rows) for k in (h, w, n)), *lines], names=["y", "height", "width", "n", "top", "low"])

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0.0, 0.0]
        for b in batches:
            n += sum(b.column("n").to_pylist())
            for k, c in enumerate(("top", "low")):
                for line in b.column(c).to_pylist():
                    sums[k] = sums[k] + np.frombuffer(line, float)
        yield pa.RecordBatch.from_pydict({"y": [key[0].as_py()], "height": [key[1].as_py()], "width": [key[2].as_py()], "n": [n], "top": [sums[0].tobytes()], "low": [sums[1].tobytes()]})

    known = images.where(F.col("format").isNotNull()).select("format", "content")
    lines = known.mapInArrow(run, "y long, height long, width long, n long, top binary, low binary")
    rows = sorted(lines.groupBy("y", "height", "width").applyInArrow(total, "y long, height long, width long, n long, top binary, low binary").collect())
    if len({(r["height"], r["width"]) for r in rows}) > 1:
        raise A.ReferenceError_("reference images must have one size")
    if not rows or rows[0]["n"] < 2:
        raise A.ReferenceError_("a reference needs two images at least")
    top, low = (np.stack([np.frombuffer(r[c], float) for r in rows]) for c in ("top", "low"))
    pattern = kernels.zero_mean(np.divide(top, low, out=np.zeros_like(top), where=low > 0))
    if (pattern * pattern).sum() <= 1e-12 * pattern.size:
        raise A.ReferenceError_("the reference images have no measurable noise")
    return {"height": rows[0]["height"], "width": rows[0]["width"], "count": rows[0]["n"], "cap": cap, "pattern": pattern}
