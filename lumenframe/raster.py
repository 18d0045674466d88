"""Results over the pixels of a cube that are not cubes themselves: scalar maps and stacks of scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


def pixels_to_array(df: DataFrame, column: str, height: int, width: int, depth: int | None) -> np.ndarray:
    """Collect a pixel frame as (height, width) or (depth, height, width). For what fits on the driver."""
    table = df.select("row", "col", column).toArrow()
    at = table.column("row").to_numpy().astype(np.int64) * width + table.column("col").to_numpy()
    values = table.column(column).combine_chunks()
    if depth is None:
        out = np.full(height * width, np.nan)
        out[at] = values.to_numpy(zero_copy_only=False)
        return out.reshape(height, width)
    out = np.full((height * width, depth), np.nan)
    flat = values.values if hasattr(values, "values") else values
    out[at] = np.asarray(flat.to_numpy(zero_copy_only=False)).reshape(len(at), depth)
    return np.ascontiguousarray(out.T).reshape(depth, height, width)


class Raster:
    """A lazy raster: `frame` has row, col and `column`. Used as an array, it is collected once."""

    def __init__(self, frame: DataFrame, column: str, height: int, width: int, depth: int | None = None):
        self.frame, self.column, self.height, self.width, self.depth = frame, column, height, width, depth
        self._array: np.ndarray | None = None

    @property
    def shape(self) -> tuple[int, ...]:
        return (self.height, self.width) if self.depth is None else (self.depth, self.height, self.width)

    @property
    def ndim(self) -> int:
        return len(self.shape)

    def to_numpy(self) -> np.ndarray:
        if self._array is None:
            self._array = pixels_to_array(self.frame, self.column, self.height, self.width, self.depth)
        return self._array

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        out = self.to_numpy()
        return out.astype(dtype) if dtype is not None else out.copy() if copy else out

    def __getitem__(self, at):
        return self.to_numpy()[at]

    def __len__(self) -> int:
        return self.shape[0]

    def __repr__(self) -> str:
        return f"Raster(shape={self.shape})"

    def _with(self, other, do):
        return do(self.to_numpy(), np.asarray(other))

    def __eq__(self, other):
        return self._with(other, np.equal)

    def __ne__(self, other):
        return self._with(other, np.not_equal)

    def __lt__(self, other):
        return self._with(other, np.less)

    def __le__(self, other):
        return self._with(other, np.less_equal)

    def __gt__(self, other):
        return self._with(other, np.greater)

    def __ge__(self, other):
        return self._with(other, np.greater_equal)

    __hash__ = None
