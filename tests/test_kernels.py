import numpy as np
import pytest

from chronoframe.operators import kernels


@pytest.fixture
def ramp():
    y, x = np.mgrid[0:64, 0:64]
    return np.stack([x * 4, y * 4, (x + y) * 2], axis=2).astype(np.uint8)


def test_motion_is_not_exposure():
    rng = np.random.default_rng(0)
    a = np.cumsum(rng.integers(0, 4, (48, 72)), axis=1).astype(np.float32)
    for brighter in (0, 7, 18):
        assert kernels.motion_score(a, a + brighter) == (0.0, 0.0)
    assert kernels.motion_score(a[:8, :8], a[:8, :8]) == (0.0, 0.0)
    b = rng.integers(0, 200, (48, 72)).astype(np.float32)
    activity, confidence = kernels.motion_score(b, np.roll(b, 3, axis=1))
    assert activity > 0.05 and confidence > 0.5


def test_every_one_framer_changes_the_frame(ramp):
    for name in kernels.ONE_FRAME:
        out = kernels.one_framer(ramp, name)
        assert out.shape == ramp.shape and out.dtype == np.uint8 and (out != ramp).any(), name
    inverted = kernels.invert(ramp)
    assert (inverted[..., 0] == inverted[..., 1]).all() and (inverted[..., 1] == inverted[..., 2]).all()
    assert (kernels.one_framer(ramp, "unknown") == ramp).all()


def test_point_formulas():
    f = np.array([[[0, 100, 255]]], dtype=np.uint8)
    assert kernels.flash_white(f).ravel().tolist() == [204, 224, 255] and kernels.flash_black(f).ravel().tolist() == [0, 20, 51]
    assert kernels.soft_tint_flash(f).ravel().tolist() == [40, 140, 255]


@pytest.mark.parametrize("kind", ["time_slice", "ink_pulse", "prism_drift", "focus_pull", "relief_light", "paper_gate"])
def test_accents_only_inside_their_phase(ramp, kind):
    other = ramp[::-1].copy()
    for phase, strength in ((-0.1, 1.0), (0.0, 1.0), (1.0, 1.0), (1.1, 1.0), (0.5, 0.0)):
        assert (kernels.creative(ramp, kind, phase, 7, strength, other) == ramp).all()
    noise = np.random.default_rng(1).integers(0, 256, (72, 96, 3), dtype=np.uint8)
    assert (kernels.creative(noise, kind, 0.5, 7, 1.0, noise[::-1].copy()) != noise).mean() > 0.01


def test_neutral_transitions_and_transforms(ramp):
    assert (kernels.warp_bubble(ramp, 0.0, 1.2) == ramp).all() and (kernels.wave_warp(ramp, 0.0, 1.0, 1.0, 1.0) == ramp).all() and (kernels.slide_shake(ramp, 0.0) == ramp).all()
    assert (kernels.transform(ramp) == ramp).all()
    assert (kernels.slide_shake(ramp, 3.0)[:, 3:] == ramp[:, :-3]).all()
    assert (kernels.transform(ramp, dx=5.0)[:, 5:] == ramp[:, :-5]).all()
    for out in (kernels.warp_bubble(ramp, 0.4, 1.2), kernels.wave_warp(ramp, 20.0, 0.3, 20.0, 1.0), kernels.transform(ramp, tilt=0.2)):
        assert (out != ramp).mean() > 0.01


def test_blurs_against_windows():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (9, 13)).astype(np.int64)
    got = kernels.box_blur(a, 3, 1)
    assert all(got[y, x] == a[y, max(x - 3, 0) : x + 4].sum() // len(a[y, max(x - 3, 0) : x + 4]) for y in range(9) for x in range(13))
    f = rng.integers(0, 256, (4, 60, 3), dtype=np.uint8)
    wide = f[:, kernels.edge_mirror(np.arange(120), 60)].astype(int)
    assert all((kernels.offset_blur(f)[:, x] == wide[:, x + 15 : x + 46].sum(axis=1) // 31).all() for x in range(60))


def test_blends_cut_down():
    frames = [np.full((1, 1, 3), v, dtype=np.uint8) for v in (255, 254, 250)]
    assert kernels.blend_frames(frames[:2])[0, 0, 0] == 254 and kernels.blend_frames(frames)[0, 0, 0] == 253
    assert (kernels.dissolve(frames[0], frames[2], 0.0) == frames[0]).all()


def test_blank_frames():
    black, white = np.zeros(9, dtype=np.uint16), np.full(9, 65535, dtype=np.uint16)
    assert kernels.is_blank([black], 0, 65535) and kernels.is_blank([white], 0, 65535)
    almost = white.copy()
    almost[3] = 65534
    assert not kernels.is_blank([almost], 0, 65535) and not kernels.is_blank([black, black], 0, 65535, mid=128)


def test_ambiance_neutral_dims_lines_only():
    f = np.full((8, 8, 3), 200, dtype=np.uint8)
    out = kernels.ambiance(f, 0.0, (0, 0, 0), False, 0.0, 0.5)
    assert out[1, 0, 0] == 199 and out[0, 0, 0] == 99 and out[4, 7, 2] == 99
    echo = kernels.ambiance(f, 0.0, (0, 0, 0), False, 0.0, 0.0, [np.zeros_like(f)], 0.5)
    assert echo[1, 1, 0] == 99


def test_homography_takes_corners_to_corners():
    source, target = [(0, 0), (10, 0), (10, 10), (0, 10)], [(1, 2), (9, 1), (11, 12), (-1, 8)]
    a = kernels.homography(source, target)
    for (u, v), (x, y) in zip(source, target, strict=True):
        d = a[6] * x + a[7] * y + 1
        assert ((a[0] * x + a[1] * y + a[2]) / d, (a[3] * x + a[4] * y + a[5]) / d) == pytest.approx((u, v), abs=1e-6)
