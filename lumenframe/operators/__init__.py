"""Operators over spectral cubes."""

from lumenframe.operators.angle import sam
from lumenframe.operators.decompose import MnfResult, PcaResult, mnf, mnf_denoise, pca, pca_inverse, pca_transform
from lumenframe.operators.indices import band_ratio, ndvi, normalized_difference
from lumenframe.operators.normalize import normalize_minmax, normalize_zscore
from lumenframe.operators.spectral import continuum_removal, derivative, resample, savitzky_golay
from lumenframe.operators.statistics import BandStats, band_stats, correlation, covariance

__all__ = [
    "BandStats",
    "MnfResult",
    "PcaResult",
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
    "resample",
    "sam",
    "savitzky_golay",
]
