"""Imaging-spectroscopy analytics on Spark DataFrames."""

from lumenframe.cube import SpectralCube
from lumenframe.errors import CubeError, CubeIOError, DimensionMismatch, EmptyCube, FormatError, InvalidInput, InvalidWavelength
from lumenframe.operators import (
    BandStats,
    MnfResult,
    PcaResult,
    band_ratio,
    band_stats,
    continuum_removal,
    correlation,
    covariance,
    derivative,
    mnf,
    mnf_denoise,
    ndvi,
    normalize_minmax,
    normalize_zscore,
    normalized_difference,
    pca,
    pca_inverse,
    pca_transform,
    resample,
    sam,
    savitzky_golay,
)
from lumenframe.raster import Raster
from lumenframe.sources import read_envi, read_parquet, read_zarr, read_zarr_window, read_zarr_with_options, write_envi, write_parquet, write_zarr, zarr_cube_shape

__version__ = "0.1.0"

__all__ = [
    "BandStats",
    "CubeError",
    "CubeIOError",
    "DimensionMismatch",
    "EmptyCube",
    "FormatError",
    "InvalidInput",
    "InvalidWavelength",
    "MnfResult",
    "PcaResult",
    "Raster",
    "SpectralCube",
    "band_ratio",
    "band_stats",
    "continuum_removal",
    "correlation",
    "covariance",
    "derivative",
    "mnf",
    "mnf_denoise",
    "ndvi",
    "normalize_minmax",
    "normalize_zscore",
    "normalized_difference",
    "pca",
    "pca_inverse",
    "pca_transform",
    "read_envi",
    "read_parquet",
    "read_zarr",
    "read_zarr_window",
    "read_zarr_with_options",
    "resample",
    "sam",
    "savitzky_golay",
    "write_envi",
    "write_parquet",
    "write_zarr",
    "zarr_cube_shape",
]
