"""Kernels on small images whose answer is known or computed the long way."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import fingerprints as P
from tagloom.functions import pixels as K
from tagloom.operators import imaging

RAMP = np.tile(np.arange(0, 250, 10, dtype=np.uint8), (20, 1))


def photo(h=13, w=17, c=3, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c), dtype=np.uint8)


def frame(spark, images):
    rows = [(i, f"n{i}.png", a.shape[0], a.shape[1], a.shape[2], bytearray(a.tobytes())) for i, a in enumerate(images)]
    return spark.createDataFrame(rows, "asset_id long, name string, height int, width int, channels int, data binary")


def pixels(df):
    return [K.to_array(bytes(r.data), r.height, r.width, r.channels) for r in df.orderBy("asset_id").collect()]


def test_dhash_of_ramps():
    assert K.dhash(RAMP) == 0
    assert K.dhash(RAMP[:, ::-1]) == -1
    assert K.dhash(np.full((30, 30), 9, dtype=np.uint8)) == 0


def test_pack_dhash_sets_the_top_bit(spark):
    grid = [0] * 72
    grid[7 * 9 + 7] = 5
    df = spark.createDataFrame([(grid,)], "g array<int>")
    assert df.select(P.pack_dhash(F.col("g"))).first()[0] == K.signed64(1 << 63)


def test_phash_against_the_direct_sum():
    luma = K.to_luma(photo(32, 32, 3, 5))
    terms = []
    for v in range(8):
        for u in range(8):
            if u or v:
                terms.append(sum(
                    float(luma[y, x]) * math.cos((2 * x + 1) * u * math.pi / 64) * math.cos((2 * y + 1) * v * math.pi / 64)
                    for y in range(32) for x in range(32)
                ))
    middle = sorted(terms)[31]
    assert K.phash(luma) == sum(1 << i for i, t in enumerate(terms) if t > middle)


def test_histogram_of_a_flat_color():
    img = np.empty((4, 5, 3), dtype=np.uint8)
    img[:] = (10, 100, 250)  # blue, green, red
    hist = K.rgb_histogram(img)
    assert np.flatnonzero(hist).tolist() == [15, 16 + 6, 32 + 0] and hist.sum() == 3.0


def test_resize_keeps_flat_images_and_size():
    flat = np.full((9, 7, 3), 77, dtype=np.uint8)
    assert (K.resize(flat, 20, 3) == 77).all() and K.resize(flat, 20, 3).shape == (3, 20, 3)
    assert (K.blur(flat, 2.0) == 77).all()
    assert K.blur(photo(), 0) is not None and (K.blur(photo(), 0) == photo()).all()


def test_noise_against_the_step_by_step_generator():
    img, seed, strength = photo(3, 4, 4, 1), K.path_seed("/data/a.png"), 20
    out = K.noise(img, strength, seed)
    state, want = seed, img.copy()
    for y in range(3):
        for x in range(4):
            for c in (2, 1, 0):  # red, green, blue in BGRA
                u = []
                for _ in range(2):
                    state = (state * K.LCG_MULTIPLIER + K.LCG_INCREMENT) % 2**64
                    u.append((state >> 33) / 2**31)
                bell = math.sqrt(-2 * math.log(max(u[0], 1e-10))) * math.cos(2 * math.pi * u[1])
                value = float(img[y, x, c]) + bell * strength
                want[y, x, c] = min(255, max(0, math.floor(abs(value) + 0.5) * (1 if value >= 0 else -1)))
    assert (out == want).all()


def test_path_seed_wraps():
    path, acc = "/data/ünï/" + "x" * 90, 0
    for b in path.encode():
        acc = (acc * 31 + b) % 2**64
    assert K.path_seed(path) == acc and K.path_seed("") == 0


@pytest.mark.parametrize("variant", range(4))
def test_homography_maps_corners(variant):
    src, dst = K.corners(variant, 0.2), K.corners(0, 0.0)
    m = K.homography(src, dst)
    for (x, y), want in zip(src, dst):
        u, v, w = m @ [x, y, 1]
        assert (u / w, v / w) == pytest.approx(tuple(want), abs=1e-9)
    moved = {0: (0.2, 0.1), 1: (0.0, 0.0), 2: (0.1, 0.2), 3: (0.0, 0.0)}[variant]
    assert tuple(src[0]) == pytest.approx(moved)


def test_perspective_without_intensity_keeps_the_inside():
    img = photo(8, 9, 3, 3)
    out = K.perspective(img, 0.0, 2)
    assert out.shape == (8, 9, 4) and (out[:7, :8, :3] == img[:7, :8]).all() and (out[7, 8] == 0).all()


def test_flatten_alpha():
    img = np.zeros((1, 2, 4), dtype=np.uint8)
    img[0, 0], img[0, 1] = (10, 20, 30, 255), (10, 20, 30, 0)
    assert K.flatten_alpha(img, "white").tolist() == [[[10, 20, 30], [255, 255, 255]]]
    assert K.flatten_alpha(img, "black")[0, 1].tolist() == [0, 0, 0]
    assert K.flatten_alpha(img[:, :1], "white").shape == (1, 1, 4)


def test_views_undo():
    img = photo(5, 7)
    assert all((K.undo_view(i, v) == img).all() for i, v in enumerate(K.eight_views(img)))


@pytest.mark.parametrize("tile,pad,scale", [(0, 10, 1), (4, 2, 1), (5, 10, 2), (100, 1, 3)])
def test_tiles_are_put_together(spark, tile, pad, scale):
    images = [photo(13, 17, 3, 1), photo(4, 9, 1, 2)]
    out = imaging.tile_apply(frame(spark, images), lambda a: np.repeat(np.repeat(a, scale, 0), scale, 1), scale, tile, pad)
    for got, img in zip(pixels(out), images):
        assert (got == np.repeat(np.repeat(img, scale, 0), scale, 1)).all()


def test_one_bad_image_does_not_end_the_job(spark):
    rows = [(1, 2, 2, 3, bytearray(12)), (2, 2, 2, 3, bytearray(5))]
    df = spark.createDataFrame(rows, "asset_id long, height int, width int, channels int, data binary")
    out = {r.asset_id: r for r in imaging.flip_images(df, "both").collect()}
    assert out[1].error is None and out[2].error.startswith("ValueError") and out[2].height == 0


def test_fingerprint_in_one_pass(spark):
    img = photo(40, 30)
    row = imaging.fingerprint(frame(spark, [img])).first()
    assert row.dhash == K.dhash(K.to_luma(img)) and row.phash == K.phash(K.to_luma(img))
    assert row.hist == pytest.approx(K.rgb_histogram(img).tolist())
