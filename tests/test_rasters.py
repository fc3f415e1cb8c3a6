"""Detections do not depend on tiles or blocks, and equal a plain pass over the whole image."""

import math

import numpy as np
import pytest

from tidewatch.operators import rasters
from tidewatch.sources.rasters import npz_tiles, scenes_of

PIXELS = "scene_id string, row long, col long, value double, n_rows long, n_cols long"


def scene(seed=3, rows=110, cols=90):
    rng = np.random.default_rng(seed)
    image = rng.exponential(1.0, (rows, cols)).astype(np.float32)
    image[30:34, 28:37] += 300  # over the corner of four blocks of 32
    for k in range(25):  # a diagonal over several blocks
        image[60 + k, 20 + k] += 400
    image[0:2, 0:3] += 250  # in the scene's corner
    image[100, 80] += 500  # too small
    image[50:53, 70:74] += 300  # at the coast's strip
    image[10:14, 60:64] = np.nan
    land = np.zeros(image.shape, np.float32)
    land[54:60, 76:80] = 1
    return image, land


def plain(image, land, coast, guard=25, train=51, pfa=1e-6):
    """Bright blobs of a whole image, pixel by pixel: first pixel to (area, peak, clutter at the centre)."""
    h = train // 2
    wide = np.pad(image.astype(float), h, mode="symmetric")
    hot, mean = set(), {}
    shore = np.argwhere(land > 0)
    for r, c in np.argwhere(np.isfinite(image)):
        window = wide[r : r + train, c : c + train].copy()
        window[h - guard // 2 : h + guard // 2 + 1, h - guard // 2 : h + guard // 2 + 1] = np.nan
        n = np.isfinite(window).sum()
        mu = np.nansum(window) / n
        if image[r, c] > n * (pfa ** (-1 / n) - 1) * mu and (not len(shore) or np.abs(shore - (r, c)).sum(1).min() > coast):
            hot.add((r, c))
            mean[r, c] = mu
    out = {}
    while hot:
        todo, blob = [min(hot)], []
        hot.remove(todo[0])
        while todo:
            y, x = todo.pop()
            blob.append((y, x))
            for p in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if p in hot:
                    hot.remove(p)
                    todo.append(p)
        if 3 <= len(blob) <= 4000:
            v = np.array([image[p] for p in blob], float)
            y, x = (np.array(a) for a in zip(*blob, strict=True))
            cy, cx = (v * y).sum() / v.sum(), (v * x).sum() / v.sum()
            there = mean.get((int(cy), int(cx)), np.mean([mean[p] for p in blob]))
            spread = np.linalg.eigvalsh(np.cov(np.array([y, x]), bias=True))
            r, c = min(blob)
            out[int(r) * image.shape[1] + int(c)] = (len(blob), cy, cx, float(v.max()), there, 4 * math.sqrt(max(spread[1], 0)), 4 * math.sqrt(max(spread[0], 0)))
    return out


def tiles(spark, image, side, name="s"):
    rows = [(name, r, c, *t.shape, *image.shape, t.tobytes()) for r in range(0, image.shape[0], side) for c in range(0, image.shape[1], side) for t in [image[r : r + side, c : c + side]]]
    return spark.createDataFrame([(a, *map(int, b), bytearray(p)) for a, *b, p in rows], rasters.TILE)


def contacts(found):
    return {r.blob: (r.area_px, r.row, r.col, r.peak, r.clutter, r.length_px, r.width_px) for r in found.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-6, abs=1e-5)


def test_any_tiles_and_blocks_give_the_whole_images_contacts(spark):
    image, land = scene()
    wanted = plain(image, land, 5)
    assert sorted(v[0] for v in wanted.values()) == [6, 11, 25, 36]  # one pixel of twelve lies in the coast's strip
    for side, block in ((200, 512), (17, 32), (40, 23)):
        same(contacts(rasters.detect(tiles(spark, image, side), tiles(spark, land, 33), 5, block=block)), wanted)
    without = contacts(rasters.detect(tiles(spark, image, 50), block=32))
    same(without, plain(image, np.zeros_like(land), 5))
    assert sorted(v[0] for v in without.values()) == [6, 12, 25, 36]


def test_scenes_apart_repeats_missing_tiles_and_nothing(spark):
    image, _ = scene()
    quiet = np.ones((40, 40), np.float32)
    both = tiles(spark, image, 30).unionByName(tiles(spark, image, 30)).unionByName(tiles(spark, quiet, 30, "q"))
    same(contacts(rasters.detect(both, block=32)), plain(image, np.zeros(image.shape), 5))
    holed = image.copy()
    holed[60:80, 40:60] = np.nan
    part = tiles(spark, image, 20).filter("row0 <> 60 or col0 <> 40")
    same(contacts(rasters.detect(part, block=32)), plain(holed, np.zeros(image.shape), 5))
    empty = tiles(spark, image, 20).limit(0)
    assert rasters.detect(empty).count() == 0 and rasters.detect(tiles(spark, np.full((9, 9), np.nan, np.float32), 4)).count() == 0


def test_tiles_of_pixels(spark):
    rows = [("s", 0, 0, 1.0, 3, 5), ("s", 0, 0, 4.0, 3, 5), ("s", 2, 4, 2.0, 3, 5), ("s", 9, 0, 7.0, 3, 5), (None, 0, 0, 1.0, 3, 5), ("s", 1, 1, None, 3, 5)]
    got = {(t.row0, t.col0): np.frombuffer(t.pixels, np.float32).reshape(t.height, t.width) for t in rasters.tiles_of(spark.createDataFrame(rows, PIXELS), 4).collect()}
    assert got.keys() == {(0, 0), (0, 4)} and got[0, 0].shape == (3, 4) and got[0, 4].shape == (3, 1)
    assert got[0, 0][0, 0] == 4 and got[0, 4][2, 0] == 2 and np.isfinite(got[0, 0]).sum() == 1


def test_archives_to_published_contacts(spark, tmp_path):
    image, _ = scene()
    np.savez(tmp_path / "a.npz", intensity=image, scene_id="s", lat0=20.0, lon0=65.0, dlat=-0.0001, dlon=0.0001, pixel_spacing_m=10.0, acquired_at="2024-01-01T00:00:00+00:00")
    read = npz_tiles(spark, str(tmp_path), 64)
    assert [tuple(r)[:3] for r in scenes_of(read).collect()] == [("s", 20.0, 65.0)]
    found = rasters.published(rasters.detect(read, block=64), scenes_of(read)).collect()
    wanted = plain(image, np.zeros(image.shape), 5)
    assert sorted((round(r.lat, 6), round(r.lon, 6)) for r in found) == sorted((round(20 - 0.0001 * v[1], 6), round(65 + 0.0001 * v[2], 6)) for v in wanted.values())
    assert all(0.5 <= r.score < 1 and r.width_m >= 10 for r in found) and len({r.detection_id for r in found}) == len(found)
    np.savez(tmp_path / "b.npz", intensity=image)
    with pytest.raises(Exception, match="lacks"):
        npz_tiles(spark, str(tmp_path)).count()
