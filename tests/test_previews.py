import numpy as np

from chronoframe.operators import kernels, previews


def test_every_effect_shows(spark):
    plain = previews.figure(96, 96)
    for effect, _ in previews.EFFECTS:
        out = previews.preview(effect, 96, 96)
        assert out.shape == plain.shape and (out != plain).mean() > 0.01, effect
    rows = previews.catalogue(spark, 32, 32).collect()
    assert [r["effect"] for r in rows] == [e for e, _ in previews.EFFECTS] and all(len(r["bitmap"]) == 54 + 32 * 96 for r in rows)


def test_gradient_ends():
    f = previews.gradient(5, 9)
    assert f[0, 0, 0] == 0 and f[4, 8, 2] == 255 and (np.diff(f[2, :, 0].astype(int)) > 0).all()


def test_finishing_is_bounded_and_repeats():
    f = previews.figure(40, 64)
    glow = previews.soft_glow(f)
    assert (glow >= f).all() and (previews.soft_glow(np.zeros_like(f)) == 0).all()
    assert (previews.grain(f, 5.0, 3) == previews.grain(f, 5.0, 3)).all() and (previews.grain(f, 5.0, 3) != previews.grain(f, 5.0, 4)).any()
    white = np.full_like(f, 255)
    assert (previews.multiplied(f, white) == f).all() and (previews.multiplied(f, np.zeros_like(f)) == 0).all()
    assert kernels.blend_frames([f, f])[0, 0, 0] == f[0, 0, 0]
