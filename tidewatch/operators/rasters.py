"""Bright objects in rasters that come in tiles of any cut.

A scene's tiles are dealt to square blocks of its own pixel grid; a tile sends each block what that block needs of it, the halo
included, so no result depends on how a scene was cut. A task holds one block with its halo. Blobs that cross blocks are joined
as components of pairs of touching pixels, of which only those on the blocks' borders are compared.

Tiles: scene_id, row0, col0, height, width, n_rows, n_cols (of the scene), pixels (float32, row by row; nan is no data).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import graph
from tidewatch.sources.staging import cut

TILE = "scene_id string, row0 long, col0 long, height long, width long, n_rows long, n_cols long, pixels binary"
PIECE = "scene_id string, block_row long, block_col long, layer string, row0 long, col0 long, height long, width long, n_rows long, n_cols long, pixels binary"
BRIGHT = "scene_id string, blob long, row long, col long, value double, clutter double"
#: Edges of the inner and outer window in pixels, the design rate of false alarms, and the pixels of a ship.
GUARD, TRAIN, PFA, LEAST_PX, MOST_PX = 25, 51, 1e-6, 3, 4000
#: Width of the coast's strip that holds no detections, and the score from which a contact is published.
COAST_M, PUBLISHED = 750.0, 0.5


def tiles_of(pixels: DataFrame, side: int = 256) -> DataFrame:
    """Tiles from single pixels (scene_id, row, col, value, n_rows, n_cols). A missing pixel is no data, of repeated ones the largest counts."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = (int(g[c].iloc[0]) // side * side for c in ("row", "col"))
        n_rows, n_cols = int(g["n_rows"].max()), int(g["n_cols"].max())
        tile = np.full((min(side, n_rows - r0), min(side, n_cols - c0)), np.nan, np.float32)
        np.fmax.at(tile, (g["row"].to_numpy() - r0, g["col"].to_numpy() - c0), g["value"].to_numpy(np.float32, na_value=np.nan))
        return pd.DataFrame([(g["scene_id"].iloc[0], r0, c0, *tile.shape, n_rows, n_cols, tile.tobytes())], columns=_names(TILE))

    inside = pixels.filter("scene_id is not null and row >= 0 and col >= 0 and row < n_rows and col < n_cols")
    picked = inside.select(F.col("scene_id").cast("string").alias("scene_id"), *(F.col(c).cast("long").alias(c) for c in ("row", "col", "n_rows", "n_cols")), F.col("value").cast("double").alias("value"))
    return picked.groupBy("scene_id", F.floor(F.col("row") / side), F.floor(F.col("col") / side)).applyInPandas(one, TILE)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _pieces(tiles: DataFrame, layer: str, block: int, halo: int) -> DataFrame:
    """What each block, with so many pixels around it, needs of each tile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for t in frame.itertuples():
                image = np.frombuffer(t.pixels, np.float32).reshape(t.height, t.width)
                ends = [(t.row0, t.row0 + t.height, t.n_rows), (t.col0, t.col0 + t.width, t.n_cols)]
                near = [range(max(0, (a - halo) // block), min((b - 1 + halo) // block, (n - 1) // block) + 1) for a, b, n in ends]
                for i in near[0]:
                    r0, r1 = max(t.row0, i * block - halo), min(t.row0 + t.height, (i + 1) * block + halo)
                    for j in near[1]:
                        c0, c1 = max(t.col0, j * block - halo), min(t.col0 + t.width, (j + 1) * block + halo)
                        part = image[r0 - t.row0 : r1 - t.row0, c0 - t.col0 : c1 - t.col0]
                        out.append((t.scene_id, i, j, layer, r0, c0, *part.shape, t.n_rows, t.n_cols, part.tobytes()))
            yield pd.DataFrame(out, columns=_names(PIECE))

    return tiles.select(*_names(TILE)).filter("scene_id is not null and pixels is not null and height > 0 and width > 0").mapInPandas(run, PIECE)


def _assembled(pieces: pd.DataFrame, r0: int, r1: int, c0: int, c1: int) -> np.ndarray:
    """A window of a scene from its pieces; where several give a pixel the largest counts, where none does it is nan."""
    out = np.full((r1 - r0, c1 - c0), np.nan, np.float32)
    for p in pieces.itertuples():
        a, b, c, d = max(r0, p.row0), min(r1, p.row0 + p.height), max(c0, p.col0), min(c1, p.col0 + p.width)
        if a < b and c < d:
            part = np.frombuffer(p.pixels, np.float32).reshape(p.height, p.width)[a - p.row0 : b - p.row0, c - p.col0 : d - p.col0]
            view = out[a - r0 : b - r0, c - c0 : d - c0]
            np.fmax(view, part, out=view)
    return out


def _box_sums(values: np.ndarray, edge: int, margin: int) -> np.ndarray:
    """Sums over squares around each pixel that is at least margin from the border."""
    total = np.pad(values.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    near, far = margin - edge // 2, margin + edge // 2 + 1
    rows, cols = (n - 2 * margin for n in values.shape)
    corner = lambda i, j: total[i : i + rows, j : j + cols]
    return corner(far, far) - corner(near, far) - corner(far, near) + corner(near, near)


def _steps_from(mask: np.ndarray) -> np.ndarray:
    """Steps along rows and columns from each pixel to the mask."""
    steps = np.where(mask, 0, mask.size + 1)
    for lines in (steps, steps.T):
        for k in range(1, len(lines)):
            np.minimum(lines[k], lines[k - 1] + 1, out=lines[k])
        for k in range(len(lines) - 2, -1, -1):
            np.minimum(lines[k], lines[k + 1] + 1, out=lines[k])
    return steps


def _blobs(hot: np.ndarray) -> np.ndarray:
    """For each hot pixel, in order, the number of the first pixel it touches, by sides or corners, over any others."""
    number = np.full(np.add(hot.shape, 2), -1)
    inner = number[1:-1, 1:-1]
    n = int(hot.sum())
    inner[hot] = np.arange(n)
    pairs = [(inner.ravel(), number[1 + i : number.shape[0] - 1 + i, 1 + j : number.shape[1] - 1 + j].ravel()) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))]
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    both = (a >= 0) & (b >= 0)
    a, b, label = a[both], b[both], np.arange(n)
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def bright_pixels(tiles: DataFrame, land: DataFrame | None = None, coast_px: int = 75, guard: int = GUARD, train: int = TRAIN, pfa: float = PFA, block: int = 512) -> DataFrame:
    """BRIGHT rows: pixels above a threshold of constant false-alarm rate, with the clutter's mean around them and their block's blob.

    The clutter of a pixel is the mean over the outer window without the inner one, of the pixels that hold data; scenes are
    mirrored at their edges. The threshold is n * (pfa^(-1/n) - 1) means for n such pixels. land: tiles, above 0 on land; no pixel
    within coast_px steps of land counts. A blob is named by its first pixel (row * n_cols + col). A scene without tiles, without
    pixels or all of nan gives no rows.
    """
    halo = train // 2
    pieces = _pieces(tiles, "image", block, halo)
    if land is not None:
        pieces = pieces.unionByName(_pieces(land, "land", block, coast_px))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame(columns=_names(BRIGHT)).astype({"blob": "int64", "row": "int64", "col": "int64", "value": float, "clutter": float})
        image, shore = g[g["layer"] == "image"], g[g["layer"] == "land"]
        if not len(image):
            return nothing
        n_rows, n_cols = int(image["n_rows"].max()), int(image["n_cols"].max())
        r0, c0 = (int(g[c].iloc[0]) * block for c in ("block_row", "block_col"))
        r1, c1 = min(r0 + block, n_rows), min(c0 + block, n_cols)
        if r0 >= r1 or c0 >= c1:
            return nothing
        a, b, c, d = max(0, r0 - halo), min(n_rows, r1 + halo), max(0, c0 - halo), min(n_cols, c1 + halo)
        window = _assembled(image, a, b, c, d).astype(float)
        window = np.pad(window, ((halo - (r0 - a), halo - (b - r1)), (halo - (c0 - c), halo - (d - c1))), mode="symmetric")
        core = window[halo : halo + r1 - r0, halo : halo + c1 - c0]
        known = np.isfinite(window)
        filled = np.where(known, window, 0.0)
        n = _box_sums(known.astype(float), train, halo) - _box_sums(known.astype(float), guard, halo)
        ring = _box_sums(filled, train, halo) - _box_sums(filled, guard, halo)
        enough = np.maximum(n, 1)
        mean = np.maximum(ring / enough, 1e-12)
        with np.errstate(invalid="ignore"):
            hot = (n > 0) & np.isfinite(core) & (core > enough * (pfa ** (-1 / enough) - 1) * mean)
        if len(shore):
            a, b, c, d = max(0, r0 - coast_px), min(n_rows, r1 + coast_px), max(0, c0 - coast_px), min(n_cols, c1 + coast_px)
            steps = _steps_from(_assembled(shore, a, b, c, d) > 0)
            hot &= steps[r0 - a : r1 - a, c0 - c : c1 - c] > coast_px
        rows, cols = np.nonzero(hot)
        if not len(rows):
            return nothing
        first = _blobs(hot)
        blob = (rows[first] + r0) * n_cols + cols[first] + c0
        frame = pd.DataFrame({"blob": blob, "row": rows + r0, "col": cols + c0, "value": core[rows, cols], "clutter": mean[rows, cols]})
        frame.insert(0, "scene_id", image["scene_id"].iloc[0])
        return frame

    return pieces.groupBy("scene_id", "block_row", "block_col").applyInPandas(one, BRIGHT)


def whole_blobs(pixels: DataFrame, block: int = 512) -> DataFrame:
    """BRIGHT rows whose blobs go on over the borders of blocks."""
    at = lambda r, c: (F.floor(r / block), F.floor(c / block))
    r, c = F.col("row"), F.col("col")
    border = (r % block == block - 1) | (c % block == block - 1) | (c % block == 0)
    steps = F.explode(F.array(*(F.struct((r + i).alias("row"), (c + j).alias("col")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    out = pixels.filter(border).select("scene_id", F.col("blob").alias("a"), *(x.alias(n) for x, n in zip(at(r, c), ("i", "j"), strict=True)), steps.alias("to"))
    out = out.filter((F.col("i") != at(F.col("to.row"), F.col("to.col"))[0]) | (F.col("j") != at(F.col("to.row"), F.col("to.col"))[1])).select("scene_id", "a", "to.row", "to.col")
    edge = pixels.filter((r % block == 0) | (c % block == 0) | (c % block == block - 1)).select("scene_id", "row", "col", F.col("blob").alias("b"))
    joined = graph.connected(out.join(edge, ["scene_id", "row", "col"]), "scene_id", "a", "b")
    same = joined.select("scene_id", F.col("node").alias("blob"), "label")
    return pixels.join(same, ["scene_id", "blob"], "left").withColumn("blob", F.coalesce("label", "blob")).drop("label")


def contacts(pixels: DataFrame, least: int = LEAST_PX, most: int = MOST_PX) -> DataFrame:
    """One row a blob of least to most pixels: place, area, brightness, contrast, and the ellipse of its second moments in pixels.

    The place is weighted by brightness. The clutter is that of the pixel there; if that one is not bright, the blob's mean of it.
    """
    v, r, c = F.col("value"), F.col("row"), F.col("col")
    each = pixels.groupBy("scene_id", "blob").agg(
        F.count("*").alias("area_px"), (F.sum(v * r) / F.sum(v)).alias("y"), (F.sum(v * c) / F.sum(v)).alias("x"), F.max(v).alias("peak"), F.avg(v).alias("mean"), F.avg("clutter").alias("around"),
        F.var_pop(r).alias("rr"), F.var_pop(c).alias("cc"), F.covar_pop(r, c).alias("rc"), F.min(r).alias("row_min"), F.max(r).alias("row_max"), F.min(c).alias("col_min"), F.max(c).alias("col_max"),
    ).filter(F.col("area_px").between(least, most))
    centre = pixels.select("scene_id", "blob", r.alias("_r"), c.alias("_c"), F.col("clutter").alias("there"))
    each = each.withColumns({"_r": F.floor("y"), "_c": F.floor("x")}).join(centre, ["scene_id", "blob", "_r", "_c"], "left")
    mid, half = (F.col("rr") + F.col("cc")) / 2, F.sqrt(F.pow((F.col("rr") - F.col("cc")) / 2, 2) + F.pow("rc", 2))
    clutter = F.coalesce("there", "around")
    return each.select(
        "scene_id", "blob", F.col("y").alias("row"), F.col("x").alias("col"), "area_px", "peak", "mean", clutter.alias("clutter"), (10 * F.log10(F.greatest(F.col("peak"), F.lit(1e-12)) / clutter)).alias("contrast_db"),
        (4 * F.sqrt(mid + half)).alias("length_px"), (4 * F.sqrt(F.greatest(F.lit(0.0), mid - half))).alias("width_px"), F.pmod(F.degrees(0.5 * F.atan2(2 * F.col("rc"), F.col("rr") - F.col("cc"))), F.lit(180.0)).alias("orientation_deg"),
        "row_min", "row_max", "col_min", "col_max",
    )


def published(found: DataFrame, scenes: DataFrame, least: float = PUBLISHED) -> DataFrame:
    """Contacts on the ground, with a score that grows with contrast. scenes: scene_id, lat0, lon0, dlat, dlon, spacing_m."""
    s = F.col("spacing_m")
    on = found.join(scenes.select("scene_id", "lat0", "lon0", "dlat", "dlon", "spacing_m"), "scene_id").withColumn("score", 1 - F.pow(F.lit(10.0), -F.col("contrast_db") / 10))
    return on.filter(F.col("score") >= least).select(
        F.concat(F.lit("det_"), F.substring(F.sha2(F.concat_ws("|", "scene_id", "blob"), 256), 1, 24)).alias("detection_id"), "scene_id", (F.col("lat0") + F.col("row") * F.col("dlat")).alias("lat"),
        (F.col("lon0") + F.col("col") * F.col("dlon")).alias("lon"), (F.col("length_px") * s).alias("length_m"), F.greatest(F.col("width_px") * s, s).alias("width_m"), "orientation_deg", "area_px", "contrast_db", "score",
    )


def detect(tiles: DataFrame, land: DataFrame | None = None, coast_px: int = 75, block: int = 512, least: int = LEAST_PX, most: int = MOST_PX, **options) -> DataFrame:
    """Contacts of all scenes: bright pixels of blocks, blobs over blocks, one row a blob."""
    pixels = cut(bright_pixels(tiles, land, coast_px, block=block, **options))
    return contacts(whole_blobs(pixels, block), least, most)
