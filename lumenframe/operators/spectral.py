"""Operators along the spectrum of each pixel: derivative, smoothing, continuum removal, resampling. None shuffles."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from lumenframe.cube import SpectralCube
from lumenframe.errors import InvalidInput, InvalidWavelength
from lumenframe.functions.validity import invalid_mask
from lumenframe.plans.kernels import Banded, map_spectra


def _first_derivative(cube: SpectralCube) -> SpectralCube:
    if cube.bands < 2:
        raise InvalidInput("a derivative needs at least 2 bands")
    wl, nodata = cube.wavelengths(), cube.nodata
    step = np.diff(wl)

    def work(x: np.ndarray) -> np.ndarray:
        y = np.where(invalid_mask(x, nodata), np.nan, x)
        with np.errstate(invalid="ignore"):
            return np.diff(y, axis=1) / step

    middle = wl[:-1] + step / 2
    return cube.with_frame(map_spectra(cube.frame, work), middle, fwhm=None, nodata=None)


def derivative(cube: SpectralCube, order: int) -> SpectralCube:
    """First or second derivative by wavelength, at the midpoints between bands. Only values next to an invalid band are NaN."""
    if order not in (1, 2):
        raise InvalidInput(f"order must be 1 or 2, not {order}")
    once = _first_derivative(cube)
    return once if order == 1 else _first_derivative(once)


def smoothing_weights(window: int, polyorder: int) -> np.ndarray:
    """Weights of a least-squares polynomial's value at the middle of the window."""
    x = np.arange(window) - window // 2
    basis = np.vander(x.astype(float), polyorder + 1, increasing=True)
    return np.linalg.pinv(basis)[0]


def savitzky_golay(cube: SpectralCube, window: int, polyorder: int) -> SpectralCube:
    """Polynomial smoothing over an odd window of bands, mirrored at the ends without repeating the end itself."""
    if window < 3 or window % 2 == 0:
        raise InvalidInput(f"window must be odd and at least 3, not {window}")
    if not 0 <= polyorder < window:
        raise InvalidInput(f"polyorder {polyorder} must be less than the window {window}")
    if window > cube.bands:
        raise InvalidInput(f"window {window} exceeds the {cube.bands} bands")
    n = cube.bands
    taps = np.abs(np.arange(n)[:, None] + np.arange(window) - window // 2)
    taps = np.where(taps >= n, 2 * (n - 1) - taps, taps)
    weights = np.broadcast_to(smoothing_weights(window, polyorder), taps.shape)
    return cube.with_frame(map_spectra(cube.frame, Banded(taps, weights, cube.nodata)))


def upper_hull(wl: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The upper convex hull of each row of y over wl, at every band.

    All pixels are swept together, band by band: a pixel's corners so far are a stack, a corner goes when it is not above the line
    from the one below it to the new point.
    """
    n, bands = y.shape
    stack = np.zeros((n, bands), np.int32)
    depth = np.zeros(n, np.int32)
    rows = np.arange(n)
    for j in range(bands):
        live = rows[depth >= 2]
        while len(live):
            top, under = stack[live, depth[live] - 1], stack[live, depth[live] - 2]
            turn = (wl[top] - wl[under]) * (y[live, j] - y[live, under]) - (y[live, top] - y[live, under]) * (wl[j] - wl[under])
            live = live[turn >= 0]
            depth[live] -= 1
            live = live[depth[live] >= 2]
        stack[rows, depth] = j
        depth += 1
    hull = np.empty_like(y)
    at = np.zeros(n, np.int32)
    for j in range(bands):
        step = (at + 1 < depth) & (stack[rows, np.minimum(at + 1, bands - 1)] <= j)
        at = at + step
        left = stack[rows, at]
        right = stack[rows, np.minimum(at + 1, depth - 1)]
        gap = wl[right] - wl[left]
        with np.errstate(invalid="ignore", divide="ignore"):
            t = np.where(gap > 0, (wl[j] - wl[left]) / np.where(gap > 0, gap, 1.0), 0.0)
            hull[:, j] = y[rows, left] + t * (y[rows, right] - y[rows, left])
        corner = left == j
        hull[corner, j] = y[corner, j]
    return hull


def continuum_removal(cube: SpectralCube) -> SpectralCube:
    """Each spectrum (negatives as 0) over its upper convex hull; 0 where the hull is 0, NaN throughout for an invalid band."""
    wl, nodata = cube.wavelengths(), cube.nodata

    def work(x: np.ndarray) -> np.ndarray:
        if not x.size:
            return x
        bad = invalid_mask(x, nodata).any(1)
        y = np.maximum(np.where(bad[:, None], 0.0, x), 0.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            hull = upper_hull(wl, y)
            out = np.where(hull == 0, 0.0, y / np.where(hull == 0, 1.0, hull))
        out[bad] = np.nan
        return out

    return cube.with_frame(map_spectra(cube.frame, work))


def _interval(wl: np.ndarray, at: float) -> int:
    return int(min(max(np.searchsorted(wl, at, "right") - 1, 0), len(wl) - 2))


def resampling_taps(wl: np.ndarray, target: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Bands and weights of each target wavelength: both methods are linear in the values."""
    n, width = len(wl), 2 if method == "linear" else 4
    taps, weights = np.zeros((len(target), width), np.int64), np.zeros((len(target), width))
    for j, at in enumerate(target):
        i = _interval(wl, at)
        h = wl[i + 1] - wl[i]
        t = (at - wl[i]) / h
        if method == "linear":
            taps[j], weights[j] = (i, i + 1), (1 - t, t)
            continue
        before, after = max(i - 1, 0), min(i + 2, n - 1)
        # Slopes at both ends, as weights of the values at before, i, i + 1, after: the mean of the slopes on either side.
        own = np.array([0.0, -1.0, 1.0, 0.0])
        left, right = own.copy(), own.copy()
        if before != i:
            left = 0.5 * (own + np.array([-1.0, 1.0, 0.0, 0.0]) * h / (wl[i] - wl[before]))
        if after != i + 1:
            right = 0.5 * (own + np.array([0.0, 0.0, -1.0, 1.0]) * h / (wl[after] - wl[i + 1]))
        value = np.array([0.0, 2 * t**3 - 3 * t**2 + 1, -2 * t**3 + 3 * t**2, 0.0])
        taps[j] = (before, i, i + 1, after)
        weights[j] = value + (t**3 - 2 * t**2 + t) * left + (t**3 - t**2) * right
    return taps, weights


def resample(cube: SpectralCube, target_wavelengths: Iterable[float], method: str = "linear") -> SpectralCube:
    """The spectra at other wavelengths within the cube's range: "linear" or "cubic" (piecewise Hermite). The same grid gives the
    cube itself; another one drops the band widths."""
    if method not in ("linear", "cubic"):
        raise InvalidInput(f"unknown method {method!r}: it must be 'linear' or 'cubic'")
    target = np.asarray(list(np.asarray(target_wavelengths, dtype=float).ravel()))
    wl = cube.wavelengths()
    if not len(target):
        raise InvalidInput("target wavelengths must not be empty")
    if np.isnan(target).any():
        raise InvalidWavelength("target wavelengths must not be NaN")
    if (np.diff(target) <= 0).any():
        raise InvalidWavelength("target wavelengths must be strictly increasing")
    if len(target) == len(wl) and (target == wl).all():
        return cube
    if cube.bands < 2:
        raise InvalidInput("resampling needs at least 2 source bands")
    if target[0] < wl[0] or target[-1] > wl[-1]:
        raise InvalidWavelength(f"target {target[0]:g} to {target[-1]:g} nm exceeds source range {wl[0]:g} to {wl[-1]:g} nm")
    taps, weights = resampling_taps(wl, target, method)
    return cube.with_frame(map_spectra(cube.frame, Banded(taps, weights, cube.nodata)), target, fwhm=None)
