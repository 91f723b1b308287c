"""Kernels against their definitions and fixed numbers."""

import numpy as np
import pytest

from tests.images import noise, smooth
from veritile.functions import features, kernels, thumbnails
from veritile.operators.dct import qualities
from veritile.plans import analyzers as A


def test_rounding_is_away_from_zero():
    assert kernels.half_away(np.array([0.5, -0.5, 2.5, -2.5, 1.4])).tolist() == [1, -1, 3, -3, 1]


def test_cosines_are_orthonormal():
    assert np.allclose(kernels.COSINE @ kernels.COSINE.T, np.eye(8))
    b = noise(8, 1)[..., 0].astype(float)
    assert np.allclose(kernels.inverse_dct(kernels.dct(b[None])), b, atol=1e-7)
    assert kernels.dct(np.full((1, 8, 8), 50.0))[0, 0, 0] == 400


def test_quantization():
    assert kernels.quantization(50) == list(kernels.BASE_TABLE)
    assert kernels.quantization(100) == [1] * 64 and max(kernels.quantization(1)) == 255
    p = noise(20, 1)[..., 0]
    assert np.abs(kernels.recompress(p, 100) - p).max() <= 2 and kernels.recompress(p, 50).shape == p.shape


def test_wavelet():
    p = np.random.default_rng(0).normal(size=(64, 48))
    c = kernels.wavelet(p)
    assert np.allclose(kernels.inverse_wavelet(c), p) and np.isclose((c * c).sum(), (p * p).sum())
    assert np.isclose((kernels.LOW_PASS**2).sum(), 1) and abs((kernels.LOW_PASS * kernels.HIGH_PASS).sum()) < 1e-12
    flat = kernels.noise_residual(np.full((50, 70), 128.0))
    assert np.abs(flat).max() < 1e-9


def test_box_mean_and_medians():
    p = np.random.default_rng(1).normal(size=(9, 11))
    want = np.array([[p[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].mean() for x in range(11)] for y in range(9)])
    assert np.allclose(kernels.box_mean(p, 5), want)
    for n in (1, 2, 5, 8):
        v = np.random.default_rng(n).normal(size=n)
        want = v if n == 1 else [np.median(np.delete(v, k)) for k in range(n)]
        assert np.allclose(kernels.leave_one_out_medians(v), want)


def test_high_pass_of_a_checkerboard():
    y, x = np.mgrid[:10, :10]
    h = kernels.high_pass(3.0 * (-1.0) ** (x + y))
    assert np.allclose(np.abs(h), 16 * 3)


def test_prediction():
    assert kernels.prediction_errors(np.array([[0, 2.0, 0], [4, 10, 6], [0, 8, 0]]))[0, 0] == 10 - 5


def test_cfa_strength():
    e = np.array([4.0, 1, 1, 4])
    assert A.cfa_strength(e, [0, 3]) == pytest.approx(np.log(4)) and A.cfa_strength(e, [1, 2]) == pytest.approx(-np.log(4))


def test_ghosts():
    q = [55, 60, 65, 70, 75, 80]
    assert qualities(0, 120, 30) == [1, 31, 61, 91, 100] and qualities(98, 100, 0) == [98, 99, 100]
    assert A.ghost(np.array([10, 8, 6, 0.5, 3, 1]), q) == 70 and A.ghost(np.array([10, 8, 6, 5, 6, 4]), q) is None


def test_lattice():
    assert len(kernels.lattice_bins(64)) == 33 and (0, 0) not in kernels.lattice_bins(64)
    assert kernels.lattice_peaks(np.zeros((63, 200))) == "the image is too small for a spectrum"
    (x, y, n), _ = kernels.lattice_peaks(noise(300, 1)[:200, :, 0].astype(float))
    assert (x, y, n) == (86, 36, 128)


def test_correlation_energy():
    r = np.random.default_rng(2).normal(size=(64, 64))
    rho, pce = kernels.peak_to_correlation_energy(r, r)
    assert rho == pytest.approx(1) and pce > 1000
    assert abs(kernels.peak_to_correlation_energy(r, np.roll(r, 20, 1))[0]) < 0.5
    assert kernels.peak_to_correlation_energy(r, np.ones((64, 64))) is None


def test_resampling():
    p = np.arange(16.0).reshape(4, 4)
    assert thumbnails.resample(p, 2, 2).ravel().tolist() == [2.5, 4.5, 10.5, 12.5]
    assert np.allclose(thumbnails.resample(np.array([[0, 3.0, 6]]), 2, 1), [[1, 5]])
    assert thumbnails.centred((0, 0, 64, 48), 16 / 9) == (0, 6, 64, 36) and thumbnails.centred((0, 0, 64, 36), 4 / 3) == (8, 0, 48, 36)


def test_bars_are_cut():
    p = np.random.default_rng(3).uniform(60, 200, (40, 60))
    p[:5], p[-4:], p[:, :3] = 0, 0, 0
    assert thumbnails.content(p) == (3, 5, 57, 31)


def test_affine_and_consensus():
    r = np.random.default_rng(4)
    a = r.uniform(0, 200, (60, 2))
    t = np.array([[0.9, -0.4, 12], [0.4, 0.9, -7]])
    b = a @ t[:, :2].T + t[:, 2]
    assert np.allclose(features.affine(a, b), t) and features.affine(np.arange(8.0).reshape(4, 2), np.zeros((4, 2))) is None
    b[40:] = r.uniform(0, 200, (20, 2))
    found = features.consensus(a, b, 3.0, 12)
    assert set(range(40)) <= set(found.tolist()) and len(found) < 46
    assert features.consensus(a, b, 3.0, 12).tolist() == found.tolist()


def test_turned_copy_is_found():
    px = smooth(320, 9)[..., 0].astype(float)
    px += np.random.default_rng(1).normal(0, 12, px.shape)
    part = px[20:130, 20:130]
    y, x = np.mgrid[:110, :110] - 55.0
    c, s = np.cos(np.radians(30)), np.sin(np.radians(30))
    sy, sx = s * x + c * y + 55, c * x - s * y + 55
    inside = (sx >= 0) & (sx < 109) & (sy >= 0) & (sy < 109) & (x * x + y * y < 50 * 50)
    target = px[180:290, 180:290]
    target[inside] = part[np.round(sy[inside]).astype(int), np.round(sx[inside]).astype(int)]
    found = features.copies(np.clip(np.round(px), 0, 255))
    assert found and abs(abs(found[0]["degrees"]) - 30) < 3 and abs(found[0]["scale"] - 1) < 0.05
    assert not features.copies(smooth(64, 2)[..., 0].astype(float))


def test_generator_of_the_pattern():
    r = features.SplitMix(0)
    assert r.next() == 0xE220A8397B1DCDAF
    p = features.pattern()
    assert p.shape == (256, 4) and (np.hypot(p[:, 0], p[:, 1]) <= 13).all()
