"""Cubes over streams of pixels, for the operators that look at one pixel at a time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from lumenframe.cube import SpectralCube


def stream_cube(pixels: DataFrame, wavelengths: Iterable[float], height: int, width: int, fwhm: Iterable[float] | None = None, nodata: float | None = None) -> SpectralCube:
    """A cube whose frame is a stream of pixels (row, col, spectrum), as lines come in from a scanner.

    Indices, the spectral angle, derivatives, smoothing, continuum removal, resampling, band selection and transforms by a fit that
    was made before give streaming frames, with no state kept. Fits and statistics over all pixels need a batch frame.
    """
    return SpectralCube(pixels, wavelengths, fwhm, nodata, height=height, width=width)
