"""Arrow kernels over pixels: numpy on whole batches of spectra, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenframe.functions.validity import invalid_mask

PIXELS = "row int, col int, spectrum array<double>"
SCORES = "row int, col int, scores array<double>"
#: Values of one matrix that a kernel works on: batches of wide spectra are cut.
TILE_VALUES = 1 << 21


def spectra_of(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix, a row per pixel."""
    if not len(column):
        return np.zeros((0, 0))
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def lists_of(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel()))


def tiles(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    width = max(1, len(batch.column(column).flatten()) // batch.num_rows)
    step = max(1, TILE_VALUES // width)
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def map_spectra(frame: DataFrame, work: Callable[[np.ndarray], np.ndarray], column: str = "spectrum", out: str = "spectrum") -> DataFrame:
    """Apply a matrix function to the spectra, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in tiles(batch, column):
                done = work(spectra_of(tile.column(column)))
                yield pa.RecordBatch.from_arrays([tile.column("row"), tile.column("col"), lists_of(done)], names=["row", "col", out])

    return frame.select("row", "col", column).mapInArrow(run, f"row int, col int, {out} array<double>")


@dataclass(frozen=True)
class Affine:
    """x -> matrix @ (x - center) + bias, with pixels that hold an invalid band made NaN if masked."""

    matrix: np.ndarray
    center: np.ndarray | None = None
    bias: np.ndarray | None = None
    masked: bool = False
    nodata: float | None = None

    def then(self, other: Affine) -> Affine:
        """This and then the other as one step; the other must not mask by a nodata value, as NaN passes through."""
        shift = np.zeros(self.matrix.shape[0]) if self.bias is None else self.bias
        if other.center is not None:
            shift = shift - other.center
        bias = other.matrix @ shift + (0 if other.bias is None else other.bias)
        return Affine(other.matrix @ self.matrix, self.center, bias, self.masked or other.masked, self.nodata)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not x.size:
            return np.zeros((len(x), len(self.matrix)))
        bad = invalid_mask(x, self.nodata).any(1) if self.masked else None
        y = x if self.center is None else x - self.center
        if bad is not None and bad.any():
            y = np.where(bad[:, None], 0.0, y)
        y = y @ self.matrix.T
        if self.bias is not None:
            y = y + self.bias
        if bad is not None:
            y[bad] = np.nan
        return y


@dataclass(frozen=True)
class Banded:
    """Weighted sums of a few taps per output: out[j] = sum over k of weights[j, k] * x[taps[j, k]]. Infinities reach only the
    outputs that they are a tap of. Pixels that hold an invalid band become NaN."""

    taps: np.ndarray
    weights: np.ndarray
    nodata: float | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not x.size:
            return np.zeros((len(x), len(self.taps)))
        bad = invalid_mask(x, self.nodata).any(1)
        out = np.zeros((len(x), len(self.taps)))
        for k in range(self.taps.shape[1]):
            used = self.weights[:, k] != 0
            out[:, used] += x[:, self.taps[used, k]] * self.weights[used, k]
        out[bad] = np.nan
        return out
