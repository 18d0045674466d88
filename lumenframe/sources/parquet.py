"""Cubes as Parquet, the native interchange: pixels as rows, the cube's metadata in the schema of the spectrum column."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumenframe.cube import SpectralCube, session
from lumenframe.errors import FormatError

_KEY = "spectral_cube"


def write_parquet(cube: SpectralCube, path: str | os.PathLike, mode: str = "errorifexists") -> None:
    """Any path that Spark can write to. Files keep the frame's order and partitions."""
    fwhm = cube.fwhm()
    about = {"wavelengths": cube.wavelengths().tolist(), "height": cube.height, "width": cube.width}
    about |= {"fwhm": fwhm.tolist()} if fwhm is not None else {}
    about |= {"nodata": cube.nodata} if cube.nodata is not None else {}
    cube.frame.withMetadata("spectrum", {_KEY: about}).write.mode(mode).parquet(str(path))


def read_parquet(path: str | os.PathLike, spark: SparkSession | None = None) -> SpectralCube:
    """A cube from write_parquet. Filters on row and col reach the files' statistics."""
    frame = (spark or session()).read.parquet(str(path))
    about = frame.schema["spectrum"].metadata.get(_KEY) if "spectrum" in frame.columns else None
    if about is None:
        raise FormatError(f"{path} has no cube metadata; SpectralCube(frame, wavelengths) takes any frame of pixels")
    pixels = frame.select("row", "col", F.col("spectrum").alias("spectrum", metadata={}))
    return SpectralCube(pixels, about["wavelengths"], about.get("fwhm"), about.get("nodata"), height=about["height"], width=about["width"])
