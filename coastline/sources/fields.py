"""Scalar fields on rectilinear grids, from legacy VTK text files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELD = "time double, ix int, iy int, x double, y double, f double"


def _numbers(text: str, name: str, skip: int, n: int) -> np.ndarray:
    at = text.index(name)
    return np.array(text[at:].split(maxsplit=skip + n)[skip : skip + n], float)


def parse_vtk(text: str, field: str = "F") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and the field as an array (x, y) of an ASCII rectilinear grid."""
    words = text[text.index("DIMENSIONS") :].split(maxsplit=3)
    nx, ny = int(words[1]), int(words[2])
    x, y = _numbers(text, "X_COORDINATES", 3, nx), _numbers(text, "Y_COORDINATES", 3, ny)
    body = text[text.index(f"SCALARS {field} ") :]
    values = np.array(body[body.index("LOOKUP_TABLE") :].split(maxsplit=2 + nx * ny)[2 : 2 + nx * ny], float)
    return x, y, values.reshape(ny, nx).T


def read_vtk(spark: SparkSession, path: str, field: str = "F", stamp: str = r"-(\d+)\.vtk$") -> DataFrame:
    """Every node of every file; the time is the stamp in the file's name, in milliseconds."""
    files = spark.read.text(path, wholetext=True).select((F.regexp_extract(F.col("_metadata.file_path"), stamp, 1).cast("double") / 1000).alias("time"), "value")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for time, text in zip(frame["time"], frame["value"], strict=True):
                x, y, f = parse_vtk(text, field)
                ix, iy = (a.ravel() for a in np.meshgrid(np.arange(len(x)), np.arange(len(y)), indexing="ij"))
                yield pd.DataFrame({"time": time, "ix": ix.astype("int32"), "iy": iy.astype("int32"), "x": x[ix], "y": y[iy], "f": f[ix, iy]})

    return files.mapInPandas(each, FIELD)
