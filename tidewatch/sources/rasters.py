"""Scenes of radar intensity in npz archives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCENE_TILE = "scene_id string, lat0 double, lon0 double, dlat double, dlon double, spacing_m double, acquired_at string, row0 long, col0 long, height long, width long, n_rows long, n_cols long, pixels binary"


def npz_tiles(spark: SparkSession, path: str, side: int = 512) -> DataFrame:
    """SCENE_TILE rows of the archives under a path: intensity in tiles, each with its scene's georeference.

    An archive holds intensity (two dimensions), scene_id, lat0, lon0, dlat, dlon, pixel_spacing_m and perhaps acquired_at. One
    archive is read by one task; one that lacks a field is an error that names its file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import numpy as np

        names = [c.split()[0] for c in SCENE_TILE.split(", ")]
        for frame in batches:
            for source, content in zip(frame["path"], frame["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    lacking = {"intensity", "scene_id", "lat0", "lon0", "dlat", "dlon", "pixel_spacing_m"} - set(z.files)
                    if lacking:
                        raise ValueError(f"{source} lacks {', '.join(sorted(lacking))}")
                    image = z["intensity"].astype(np.float32)
                    head = (str(z["scene_id"]), *(float(z[c]) for c in ("lat0", "lon0", "dlat", "dlon", "pixel_spacing_m")), str(z["acquired_at"]) if "acquired_at" in z else None)
                for r in range(0, image.shape[0], side):
                    rows = []
                    for c in range(0, image.shape[1], side):
                        tile = image[r : r + side, c : c + side]
                        rows.append((*head, r, c, *tile.shape, *image.shape, tile.tobytes()))
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(run, SCENE_TILE)


def scenes_of(tiles: DataFrame) -> DataFrame:
    """One row a scene: its georeference."""
    return tiles.select("scene_id", "lat0", "lon0", "dlat", "dlon", "spacing_m", "acquired_at").distinct()
