"""Perspective, rotation and card clean-up of drawn pages."""

import numpy as np
import pytest

from parchmint.functions import geometry, kernels
from parchmint.operators import variants

QUAD = np.array([[40, 30], [280, 60], [260, 210], [60, 190]])


@pytest.fixture
def slanted():
    y, x = np.mgrid[:240, :320]
    inside = np.ones(y.shape, dtype=bool)
    for a, b in zip(QUAD, np.roll(QUAD, -1, axis=0), strict=True):
        inside &= (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0
    return np.where(inside, 220, 20).astype(np.uint8)


@pytest.fixture
def lines():
    g = np.full((300, 400), 220, dtype=np.uint8)
    for y in range(40, 260, 20):
        g[y : y + 3, 60:340] = 30
    return g


def test_perspective(slanted):
    found = geometry.ordered(geometry.corners(geometry.largest(kernels.edges(slanted) > 0, 1, False)[0]))
    assert np.abs(found - QUAD).max() <= 2
    assert (slanted == 220).mean() < 0.5
    for flat in (geometry.sign_corrected(slanted), geometry.page_corrected(slanted)):
        assert (flat == 220).mean() > 0.95 and np.abs(np.array(flat.shape) - (161, 241)).max() <= 4
    assert [n for n, _ in variants.corrected(slanted, "natural")] == ["perspective"]
    assert {"perspective_corrected", "corrected_otsu"} <= {n for n, _ in variants.variants(slanted, "signage")}
    assert geometry.sign_corrected(np.full((9, 9), 7, np.uint8)) is None and geometry.page_corrected(slanted[:90, :90]) is None


@pytest.mark.parametrize("angle", [-40, -30, -14, -2, 0, 2, 14, 30, 40])
def test_turned_pages(lines, angle):
    turned = kernels.rotated(lines, -angle)
    assert geometry.turn(turned) == angle
    made = list(variants.corrected(turned, "document"))
    assert [n for n, _ in made] == (["auto_rotated"] if angle else [])
    assert not list(variants.corrected(turned, "signage"))


def test_card():
    rng = np.random.default_rng(1)
    wide = np.clip(rng.normal(128, 8, (30, 2000)), 0, 255).astype(np.uint8)
    name, out = next(variants.corrected(wide, "id_card"))
    assert name == "optimized" and out.shape == (15, 1000)
    small = kernels.clahe(kernels.resized(wide, 15, 1000), 2.0)
    assert (out == kernels.denoise(small, 10, 7, 10)).all()


def test_windows_have_their_size():
    g = np.full((41, 41), 100, dtype=np.uint8)
    g[20, 20] = 104
    assert np.ptp(np.argwhere(kernels.bilateral(np.where(g == 104, 255, 100).astype(np.uint8), 15, 1e4, 1e4) != 100), axis=0).tolist() == [14, 14]
    rng = np.random.default_rng(2)
    x = rng.integers(90, 110, (12, 13)).astype(np.float64)
    total, weight = np.zeros_like(x), np.zeros_like(x)
    pad = np.pad(x, 10, mode="symmetric")
    for y in range(21):
        for z in range(21):
            moved = pad[y : y + 12, z : z + 13]
            w = np.exp(-kernels.box((x - moved) ** 2, 7) / 10**2)
            total, weight = total + w * moved, weight + w
    assert (kernels.denoise(x.astype(np.uint8), 10) == kernels.levels(total / weight)).all()
    strong = dict(variants.STRATEGIES["aggressive"])["denoised"](x.astype(np.uint8))
    assert (strong == kernels.denoise(x.astype(np.uint8), 15, 9, 10)).all()
