"""Height rasters in .hgt files: big-endian 16-bit samples, north row first, named after their south-west corner."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: samples a side by the file's size, and the sample that stands for none.
SIDES, VOID = {3601 * 3601 * 2: 3601, 1201 * 1201 * 2: 1201}, -32768


def corner(path: str) -> tuple[int, int]:
    m = re.search(r"([NS])(\d{2})([EW])(\d{3})\.hgt$", path, re.IGNORECASE)
    if not m:
        raise ValueError(f"no tile name: {path}")
    return int(m[2]) * (-1 if m[1] in "Ss" else 1), int(m[4]) * (-1 if m[3] in "Ww" else 1)


def parsed(path: str, content: bytes) -> pd.DataFrame:
    """A row for each line of samples; a void is null. A file of any other size is refused."""
    side = SIDES.get(len(content)) or int(round((len(content) / 2) ** 0.5))
    if side * side * 2 != len(content) or side < 2:
        raise ValueError(f"not a square of samples: {path}")
    lat, lon = corner(path)
    grid = np.frombuffer(content, ">i2").reshape(side, side)
    heights = [[None if x == VOID else int(x) for x in line] for line in grid]
    return pd.DataFrame({"cell_lat": lat, "cell_lon": lon, "row": np.arange(side), "heights": heights})


def encoded(heights: np.ndarray) -> bytes:
    """Samples as the file's bytes: halves away from zero, what isn't finite as 0."""
    x = np.where(np.isfinite(heights), heights, 0)
    return np.clip(np.sign(x) * np.floor(np.abs(x) + 0.5), -32768, 32767).astype(">i2").tobytes()


def read_hgt(spark: SparkSession, path: str) -> DataFrame:
    """(cell_lat, cell_lon, row, heights array<smallint>) of all .hgt files under a path."""
    from orogena.operators.rasters import hgt_rows

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.hgt").load(path)
    return hgt_rows(files)
