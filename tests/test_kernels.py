import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from defectlake.config import RECIPES, TYPES, Config, Recipe, recipe
from defectlake.operators import defects, raster
from defectlake.operators.contours import outer_borders, parts
from defectlake.operators.synthesis import box_of, make_sample
from defectlake.plans.planner import SPLITS, Ratios, sample_counts, seed_counts


def surface(n=64, seed=0):
    return np.random.default_rng(seed).integers(100, 200, (n, n, 3)).astype(np.uint8)


@pytest.mark.parametrize("kind", TYPES)
@pytest.mark.parametrize("severity,frequency", [(0.0, 0.1), (0.5, 1.0), (1.0, 5.0)])
def test_generators_keep_size_and_mark_something(kind, severity, frequency):
    image = surface()
    for seed in range(4):
        out, mask = defects.generator(kind)(image, np.random.default_rng(seed), severity, frequency)
        assert out.shape == image.shape and out.dtype == np.uint8 and mask.shape == image.shape[:2] and mask.any()
    again, _ = defects.generator(kind)(image, np.random.default_rng(3), severity, frequency)
    assert (again == out).all()


def test_unknown_generator_names_the_known():
    with pytest.raises(KeyError, match="scratch"):
        defects.generator("nothing")


def test_randomisers_at_zero_are_identities():
    image, rng = surface(), np.random.default_rng(0)
    mask = np.zeros((64, 64), bool)
    mask[10:20, 10:30] = True
    for f in (defects.light, defects.grain, defects.sense):
        assert f(image, rng, 0) is image
    assert defects.move(image, [mask], rng, 0)[0] is image and defects.vary(image, image, [mask], rng, 0)[0] is image


def test_variation_stays_inside_its_masks():
    clean = surface()
    changed, mask = defects.stain(clean, np.random.default_rng(1), 0.5, 1.0)
    out, masks = defects.vary(clean, changed, [mask], np.random.default_rng(2), 0.8)
    assert (out[~(mask | masks[0])] == changed[~(mask | masks[0])]).all()


def test_sensor_needs_three_channels():
    with pytest.raises(ValueError):
        defects.sense(np.zeros((8, 8), np.uint8), np.random.default_rng(0), 0.5)


def test_region_of_interest():
    image = np.zeros((120, 120, 3), np.uint8)
    yy, xx = np.ogrid[:120, :120]
    image[(yy - 60) ** 2 + (xx - 60) ** 2 < 1600] = 200
    roi = defects.region_of_interest(image)
    assert roi[60, 60] and not roi[2, 2]
    dark = defects.region_of_interest(255 - image)
    assert dark[60, 60] and not dark[2, 2]
    assert defects.region_of_interest(np.full((40, 40, 3), 128, np.uint8)).all()


def test_samples_are_reproducible_and_compound():
    config = Config(defect="mixed", defects_per_image=3)
    a, found = make_sample(surface(96), None, 77, config)
    b, _ = make_sample(surface(96), None, 77, config)
    c, _ = make_sample(surface(96), None, 78, config)
    assert (a == b).all() and (a != c).any() and len(found) == 3


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 12), st.integers(2, 12), st.integers(0, 2**32 - 1))
def test_boxes_and_borders_hold_their_masks(h, w, seed):
    mask = np.random.default_rng(seed).random((h, w)) < 0.3
    x, y, bw, bh = box_of(mask)
    inside = np.zeros_like(mask)
    inside[y : y + bh, x : x + bw] = True
    assert not (mask & ~inside).any()
    label, n = parts(mask)
    assert ((label > 0) == mask).all() and set(np.unique(label[mask])) == set(range(1, n + 1))
    for border in outer_borders(mask, 1):
        assert all(mask[int(v), int(u)] for u, v in zip(border[::2], border[1::2], strict=True))


def test_border_of_a_rectangle():
    mask = np.zeros((10, 12), bool)
    mask[2:6, 3:9] = True
    assert outer_borders(mask) == [[3, 2, 8, 2, 8, 5, 3, 5]]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 60), st.floats(0, 1), st.floats(0, 1), st.floats(0, 1), st.integers(1, 500))
def test_plans_are_exhaustive(n, a, b, c, total):
    counts = seed_counts(n, Ratios(a, b, c))
    assert sum(counts.values()) == n and all(v >= 0 for v in counts.values())
    if n:
        assert counts["train"] >= 1
        samples = sample_counts(total, counts, Ratios(a, b, c))
        assert sum(samples.values()) == total and set(samples) <= set(SPLITS)


def test_three_seeds_reach_all_splits():
    assert seed_counts(3) == {"train": 1, "val": 1, "test": 1}
    assert seed_counts(10, Ratios(0.6, 0.2, 0.2)) == {"train": 6, "val": 2, "test": 2}


def test_settings_are_checked_and_recipes_round_trip(tmp_path):
    with pytest.raises(ValueError):
        Config(severity=2)
    with pytest.raises(ValueError):
        Config(defect="hole")
    with pytest.raises(KeyError, match="metal"):
        recipe("wood")
    r = RECIPES["coating"]
    r.save(tmp_path / "r.json")
    assert Recipe.load(tmp_path / "r.json") == r
    assert r.config(severity=0.9, count=None).severity == 0.9 and r.config().defect == "pinhole"


def test_png_and_hsv_round_trip():
    image = surface(17)
    assert np.abs(raster.from_hsv(*raster.to_hsv(image)) - image).max() < 0.01
    assert raster.png(image)[:4] == b"\x89PNG"
