"""Principal components and minimum noise fractions. Fits take one or two distributed passes; the eigenproblems, bands by bands, are
solved on the driver; transforms are lazy maps. A component's sign is such that its element of greatest size is positive."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lumenframe.cube import SpectralCube, local_pixels, session
from lumenframe.errors import DimensionMismatch, InvalidInput
from lumenframe.plans.gram import State, difference_gram, pixel_state
from lumenframe.plans.kernels import Affine, map_spectra
from lumenframe.raster import Raster

#: Eigenvalues of the noise up to this count as none.
LEAST_NOISE = 1e-12


def _signed(rows: np.ndarray) -> np.ndarray:
    at = np.abs(rows).argmax(1)
    sign = np.sign(rows[np.arange(len(rows)), at])
    return rows * np.where(sign == 0, 1.0, sign)[:, None]


def _eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the greatest, and the eigenvectors as rows."""
    try:
        values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    except np.linalg.LinAlgError as e:
        raise InvalidInput(f"eigendecomposition failed: {e}") from e
    return values[::-1], vectors[:, ::-1].T


class _Result:
    def __init__(self, components: np.ndarray, mean: np.ndarray, wavelengths: np.ndarray):
        self._components, self._mean, self._wavelengths = components, mean, wavelengths

    @property
    def n_components(self) -> int:
        return len(self._components)

    def components(self) -> np.ndarray:
        return self._components.copy()

    def mean(self) -> np.ndarray:
        return self._mean.copy()

    def wavelengths(self) -> np.ndarray:
        return self._wavelengths.copy()


class PcaResult(_Result):
    """components (a row each), explained_variance, mean, wavelengths."""

    def __init__(self, components, explained_variance, mean, wavelengths):
        super().__init__(components, mean, wavelengths)
        self._explained_variance = explained_variance

    def explained_variance(self) -> np.ndarray:
        return self._explained_variance.copy()

    def __repr__(self) -> str:
        total = self._explained_variance.sum()
        first = 100 * self._explained_variance[0] / total if total > 0 else 0.0
        return f"PcaResult(n_components={self.n_components}, first_component={first:.1f}%)"


class MnfResult(_Result):
    """components (a row each, of unit length), eigenvalues (signal to noise), mean, wavelengths."""

    def __init__(self, components, eigenvalues, mean, wavelengths):
        super().__init__(components, mean, wavelengths)
        self._eigenvalues = eigenvalues

    def eigenvalues(self) -> np.ndarray:
        return self._eigenvalues.copy()

    def __repr__(self) -> str:
        return f"MnfResult(n_components={self.n_components})"


def _wanted(cube: SpectralCube, n_components: int | None) -> int:
    n = cube.bands if n_components is None else int(n_components)
    if not 1 <= n <= cube.bands:
        raise InvalidInput(f"n_components must be from 1 to {cube.bands}, not {n}")
    return n


def _clean_state(cube: SpectralCube, what: str) -> State:
    state = pixel_state(cube.frame, cube.bands, cube.nodata)
    if state.skipped:
        raise InvalidInput(f"{what} takes no NaN or nodata values; {state.skipped} pixels have some")
    if state.n < 2:
        raise InvalidInput(f"{what} needs at least 2 pixels")
    return state


def _check_pixels(cube: SpectralCube, what: str) -> None:
    if cube.height * cube.width < 2:
        raise InvalidInput(f"{what} needs at least 2 pixels")


def pca(cube: SpectralCube, n_components: int | None = None) -> PcaResult:
    """Principal components by the sample covariance, in order of variance."""
    _check_pixels(cube, "PCA")
    n = _wanted(cube, n_components)
    state = _clean_state(cube, "PCA")
    values, vectors = _eigen(state.gram / (state.n - 1))
    return PcaResult(_signed(vectors[:n]), np.maximum(values[:n], 0), state.mean.copy(), cube.wavelengths())


def pca_transform(cube: SpectralCube, result: PcaResult) -> Raster:
    """Scores of every pixel. NaN passes through; nodata is a number like any other here."""
    if len(result._mean) != cube.bands:
        raise DimensionMismatch(f"the cube's {cube.bands} bands do not match the {len(result._mean)} that were fitted")
    work = Affine(result._components, center=result._mean)
    return Raster(map_spectra(cube.frame, work, out="scores"), "scores", cube.height, cube.width, result.n_components)


def pca_inverse(scores: Raster | np.ndarray, result: PcaResult) -> SpectralCube:
    """The cube that scores stand for."""
    if not isinstance(scores, Raster):
        scores = np.asarray(scores, dtype=float)
        if scores.ndim != 3:
            raise InvalidInput("scores must have three dimensions (components, height, width)")
        depth, height, width = scores.shape
        frame = local_pixels(session(), scores).withColumnRenamed("spectrum", "scores")
    else:
        (depth, height, width), frame = scores.shape, scores.frame
    if depth != result.n_components:
        raise DimensionMismatch(f"{depth} components do not match the {result.n_components} that were fitted")
    work = Affine(result._components.T, bias=result._mean)
    return SpectralCube(map_spectra(frame, work, column="scores"), result._wavelengths, height=height, width=width)


@dataclass(frozen=True)
class _Fit:
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray  # a row each, in the whitened space
    whiten: np.ndarray
    color: np.ndarray


def _fit_mnf(cube: SpectralCube, n_components: int | None) -> tuple[_Fit, int]:
    _check_pixels(cube, "MNF")
    if cube.width < 2:
        raise InvalidInput("MNF needs a width of at least 2, to estimate noise from neighbours")
    n = _wanted(cube, n_components)
    state = _clean_state(cube, "MNF")
    count, gram = difference_gram(cube.frame, cube.bands)
    noise_values, noise_vectors = _eigen(gram / (2 * max(count - 1, 1)))
    kept = noise_values > LEAST_NOISE
    if not kept.any():
        raise InvalidInput("the noise is zero: neighbouring pixels show no spatial variation")
    values, vectors = noise_values[kept], noise_vectors[kept]
    whiten = (vectors.T / np.sqrt(values)) @ vectors
    color = (vectors.T * np.sqrt(values)) @ vectors
    signal, axes = _eigen(whiten @ (state.gram / (state.n - 1)) @ whiten)
    return _Fit(state.mean.copy(), np.maximum(signal, 0), axes, whiten, color), n


def mnf(cube: SpectralCube, n_components: int | None = None) -> MnfResult:
    """Minimum noise fractions, with the noise estimated from differences between horizontal neighbours."""
    fit, n = _fit_mnf(cube, n_components)
    rows = fit.vectors[:n] @ fit.whiten
    length = np.linalg.norm(rows, axis=1)
    rows = np.where(length[:, None] > 1e-12, rows / np.maximum(length, 1e-300)[:, None], 0.0)
    return MnfResult(_signed(rows), fit.values[:n], fit.mean, cube.wavelengths())


def mnf_denoise(cube: SpectralCube, n_components: int) -> SpectralCube:
    """The cube rebuilt from its best n_components fractions."""
    fit, n = _fit_mnf(cube, n_components)
    top = fit.vectors[:n]
    matrix = fit.color @ top.T @ top @ fit.whiten
    return cube.with_frame(map_spectra(cube.frame, Affine(matrix, center=fit.mean, bias=fit.mean)))
