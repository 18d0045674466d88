"""Per-band normalisation: one pass for the statistics, then a map that is lazy."""

from __future__ import annotations

import numpy as np

from lumenframe.cube import SpectralCube
from lumenframe.functions.validity import invalid_mask
from lumenframe.operators.statistics import band_stats
from lumenframe.plans.kernels import map_spectra


def _scaled(cube: SpectralCube, shift: np.ndarray, scale: np.ndarray) -> SpectralCube:
    """(x - shift) / scale; 0 for a scale that is 0 or not finite, NaN for an invalid value."""
    usable = np.isfinite(scale) & (scale != 0)
    shift, scale, nodata = np.where(usable, shift, 0.0), np.where(usable, scale, 1.0), cube.nodata

    def work(x: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            return np.where(invalid_mask(x, nodata), np.nan, np.where(usable, (x - shift) / scale, 0.0))

    return cube.with_frame(map_spectra(cube.frame, work))


def normalize_minmax(cube: SpectralCube) -> SpectralCube:
    """Each band to 0 ... 1 by its least and greatest valid values; a band that does not vary becomes 0."""
    stats = band_stats(cube)
    return _scaled(cube, stats.min(), stats.max() - stats.min())


def normalize_zscore(cube: SpectralCube) -> SpectralCube:
    """Each band to mean 0 and population standard deviation 1; a band that does not vary becomes 0."""
    stats = band_stats(cube)
    return _scaled(cube, stats.mean(), stats.std())
