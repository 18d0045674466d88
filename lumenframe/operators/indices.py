"""Two-band indices, as plain column expressions: no shuffle, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.cube import SpectralCube
from lumenframe.errors import InvalidInput
from lumenframe.functions.validity import invalid, nan
from lumenframe.raster import Raster


def _map(cube: SpectralCube, first: int, second: int, divide) -> Raster:
    for index in (first, second):
        if not 0 <= index < cube.bands:
            raise InvalidInput(f"band index {index} is out of range for {cube.bands} bands")
    a, b = F.get("spectrum", F.lit(first)), F.get("spectrum", F.lit(second))
    bad = invalid(a, cube.nodata) | invalid(b, cube.nodata)
    top, bottom = divide(a, b)
    # CASE evaluates the division only where the divisor is not zero, which ANSI mode would refuse.
    value: Column = F.when(bad, nan()).when(bottom == 0.0, F.lit(0.0)).otherwise(top / bottom)
    return Raster(cube.frame.select("row", "col", value.alias("value")), "value", cube.height, cube.width)


def normalized_difference(cube: SpectralCube, band_a: int, band_b: int) -> Raster:
    """(A - B) / (A + B); 0 where the sum is 0, NaN where a band is invalid."""
    return _map(cube, band_a, band_b, lambda a, b: (a - b, a + b))


def band_ratio(cube: SpectralCube, band_a: int, band_b: int) -> Raster:
    """A / B; 0 where B is 0, NaN where a band is invalid."""
    return _map(cube, band_a, band_b, lambda a, b: (a, b))


def ndvi(cube: SpectralCube, nir: int, red: int) -> Raster:
    """The normalized difference of near infrared and red."""
    return normalized_difference(cube, nir, red)
