"""Planted edits are found where they are; untouched images are left alone."""

import numpy as np
import pytest

from tests import images
from veritile import config
from veritile.functions import kernels
from veritile.plans import analyzers as A
from veritile.plans import engine

CFG = config.default()


def run(name, px=None, content=b"", fmt="ppm", **changes):
    section, check = A.ANALYZERS[name]
    more = {"prnu": (None,), "aigenerated": (CFG["prnu"],)}.get(name, ())
    return check(A.Image(content, fmt, px), CFG[section] | changes, *more)


def regions(f):
    return {r for i in f.indicators for r in i.regions}


def overlaps(rs, x, y, w, h):
    return any(rx < x + w and ry < y + h and rx + rw > x and ry + rh > y for rx, ry, rw, rh in rs)


def test_ela():
    px = np.full((64, 64, 3), 100, np.uint8)
    assert run("ela", px).score == 0
    px[16:32, 16:32] = images.noise(16)
    f = run("ela", px, errorThreshold=2.0)
    assert f.score > 20 and overlaps(regions(f), 16, 16, 16, 16) and not overlaps(regions(f), 40, 40, 20, 20)
    assert run("ela", px, fmt="webp").score == 0
    with pytest.raises(A.NotPossible):
        run("ela", None)


def test_clone():
    px = images.noise(128, 3, 42)
    assert run("clone", px).score == 0
    px[88:112, 88:112] = px[8:32, 8:32]
    f = run("clone", px)
    assert f.score > 20 and (8, 8, 16, 16) in regions(f) and (88, 88, 16, 16) in regions(f)
    assert run("clone", np.full((64, 64, 3), 9, np.uint8)).score == 0 and run("clone", images.noise(8)).score == 0


def test_block_matches_equal_all_pairs():
    luma = images.smooth(96, 7)[..., 0].astype(float)
    s = CFG["cloneDetection"] | {"similarityThreshold": 90.0}
    n, got = A.block_matches(luma, s)
    at = [(x, y) for y in range(0, 81, 8) for x in range(0, 81, 8) if luma[y : y + 16, x : x + 16].var() >= 20]
    feature = {p: kernels.grid(luma[p[1] : p[1] + 16, p[0] : p[0] + 16], 4).mean(axis=(2, 3)).ravel() for p in at}
    want = {(p, q) for k, p in enumerate(at) for q in at[k + 1 :] if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 >= 576 and np.linalg.norm(feature[p] - feature[q]) <= 90}
    assert n == len(at) and {(a, b) for a, b, _ in got} == want and want


def test_double_compression():
    host = images.smooth(512, 4)[..., 0]
    once = kernels.recompress(host, 90)[..., None].astype(np.uint8)
    twice = kernels.recompress(kernels.recompress(host, 50), 90)[..., None].astype(np.uint8)
    a, b = run("doublecompression", once, fmt="jpeg"), run("doublecompression", twice, fmt="jpeg")
    assert b.score >= a.score and run("doublecompression", once, fmt="bmp").score == 0
    assert A.periodicity(np.array([9, 1] * 20)) > 0.5 and A.periodicity(np.array([5] * 7)) == 0


def test_sensor_noise():
    px = images.scene(384)
    assert run("prnu", px).score == 0
    px[128:256, 128:256] = np.clip(images.scene(384, 0.0)[128:256, 128:256], 0, 255)
    f = run("prnu", px)
    assert f.score > 20 and overlaps(regions(f), 128, 128, 128, 128) and not overlaps(regions(f), 0, 0, 60, 60)
    assert "small" in run("prnu", images.noise(64)).summary and run("prnu", np.full((256, 256, 3), 128, np.uint8)).score == 0


def test_reference_camera():
    r = np.random.default_rng(8)
    gain = r.normal(0, 0.02, (256, 256, 1))

    def shot(seed, own=gain):
        base = images.scene(256, 0.0, channels=3).astype(float)
        return np.clip(np.round(base * (1 + own) + np.random.default_rng(seed).normal(0, 1, base.shape)), 0, 255).astype(np.uint8)

    ref = A.reference_pattern([shot(k) for k in range(6)])
    assert A.verify(shot(50), ref)[0] == "match"
    other = A.verify(shot(51, r.normal(0, 0.02, (256, 256, 1))), ref)
    assert other[0] == "mismatch" and A.verify(images.noise(64), ref)[0] == "dimensionMismatch"
    f = A.prnu(A.Image(b"", "ppm", shot(51, r.normal(0, 0.02, (256, 256, 1)))), CFG["prnu"], ref)
    assert f.score >= 60 * 0.6
    with pytest.raises(A.ReferenceError_):
        A.reference_pattern([shot(1)])
    with pytest.raises(A.ReferenceError_):
        A.reference_pattern([shot(1), images.noise(64)])


def test_color_filter():
    px = images.mosaic()
    assert run("cfa", px).score == 0 and "consistent" in run("cfa", px).summary
    px[64:128, 64:128] = images.scene(256, 3.0)[64:128, 64:128]
    f = run("cfa", px)
    assert f.score > 20 and (64, 64, 64, 64) in regions(f)
    assert run("cfa", images.noise(256, 1)).score == 0 and "not assessed" in run("cfa", images.noise(256)).summary


def test_ghost():
    f = run("jpegghost", images.composite())
    assert f.score > 20 and overlaps(regions(f), 128, 64, 64, 64) and not overlaps(regions(f), 0, 160, 200, 90)
    assert "history" in run("jpegghost", images.noise(256)).summary


def test_noise_level():
    px = images.scene(320, 4.0)
    assert run("noiselevel", px).score == 0
    px[64:128, 128:192] = images.scene(320, 0.8, 9)[64:128, 128:192]
    px[192:256, 192:256] = images.scene(320, 20.0, 10)[192:256, 192:256]
    f = run("noiselevel", px)
    assert {(128, 64, 64, 64), (192, 192, 64, 64)} == {r for i in f.indicators[:2] for r in i.regions} and 20 < f.score <= 80
    assert "not assessed" in run("noiselevel", np.full((256, 256, 3), 128, np.uint8)).summary


def test_signs_of_synthesis():
    y, x = np.mgrid[:256, :256]
    px = 128 + 30 * np.sin(x / 30) + 25 * ((x + y) % 2) + 6 * np.cos(np.pi * x / 2) * np.cos(np.pi * y / 2)
    made = np.repeat(np.clip(np.round(px), 0, 255).astype(np.uint8)[..., None], 3, 2)
    f = run("aigenerated", made)
    assert f.score > 30 and len(f.indicators) == 2
    assert run("aigenerated", images.scene(256, 4.0)).score == 0


def test_metadata():
    same = dict(make="M", model="X", original="2020:01:01 10:00:00", gps="2020:01:01 10:00:00")
    jpeg = lambda **k: run("metadata", content=b"\xff\xd8\xff\xe1" + (len(t := images.tiff(**k)) + 8).to_bytes(2, "big") + b"Exif\0\0" + t + b"\xff\xd9", fmt="jpeg")
    for end in "<>":
        assert jpeg(**same, modified="2020:01:01 10:00:00", end=end).score == 0
    assert jpeg(**same, modified="2019:12:31 10:00:00").score == 50
    assert jpeg(**same, modified="2020:06:01 10:00:00").score == 30
    assert jpeg(**same, modified="2020:01:01 10:00:00", software="Adobe Photoshop").score == 60
    assert jpeg(**same, digitized="2020:01:01 11:00:00").score == 20
    assert jpeg(**same | {"gps": "2020:01:01 11:00:00"}).score == 25
    assert jpeg(make="M", model="X").score == 10 and jpeg(modified="2020:01:01 10:00:00").score == 18
    assert jpeg(**same, altitude=-5.0, ref=0).score == 30 and jpeg(**same, altitude=-5.0, ref=1).score == 0
    assert jpeg(gps="2020:01:01 10:00:00").score == 35
    plain = b"\xff\xd8\xff\xd9"
    assert run("metadata", content=plain, fmt="jpeg").score == 0 and run("metadata", content=plain, fmt="jpeg", flagMissingExif=True).score == 20
    assert run("metadata", content=images.webp(images.tiff(make="M")), fmt="webp").score == 10
    assert run("metadata", content=images.heif(images.tiff(make="M")), fmt="heif").score == 10
    assert run("metadata", fmt="bmp").score == 0


def thumbnail_of(px, shown):
    small = np.round(kernels.box_downsample(shown[..., 0].astype(float), 4)).astype(np.uint8)[..., None]
    return images.jpeg(px, 92, images.tiff(make="M", thumbnail=images.jpeg(small, 92)))


def test_thumbnail():
    px, other = images.smooth(192, 11), images.smooth(192, 12)
    assert run("thumbnail", content=thumbnail_of(px, px), fmt="jpeg").score == 0
    f = run("thumbnail", content=thumbnail_of(px, other), fmt="jpeg")
    assert f.score > 60 and regions(f)
    assert run("thumbnail", content=thumbnail_of(px, px[:96]), fmt="jpeg").score >= 35
    assert run("thumbnail", content=images.jpeg(px), fmt="jpeg").score == 0


def test_tiles():
    plan = engine.tiles(300, 500, 128, 16)
    assert sum(c[2] * c[3] for c, _ in plan) == 300 * 500 and plan[0][1] == (0, 0, 144, 144)
    assert [engine.tiles(5000, 5000, n, 0)[0][0][2] for n in (1024, 17, 0, -5)] == [1024, 16, 8, 8]
    px = images.scene(256)
    px[40:60, 40:60] = images.noise(20)
    whole = dict(engine.analyze(A.Image(b"", "ppm", px), CFG, {"ela", "metadata", "noiselevel"}))
    tiled = dict(engine.analyze(A.Image(b"", "ppm", px), CFG, {"ela", "metadata", "noiselevel"}, forced_tile=128))
    assert tiled["metadata"] == whole["metadata"] and tiled["noiselevel"] == whole["noiselevel"]
    assert abs(tiled["ela"].score - whole["ela"].score) < 45
