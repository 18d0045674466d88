"""Spectral angle mapping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lumenframe.cube import SpectralCube
from lumenframe.errors import DimensionMismatch, InvalidInput
from lumenframe.functions.validity import invalid_mask
from lumenframe.plans.kernels import spectra_of, tiles
from lumenframe.raster import Raster


def sam(cube: SpectralCube, reference) -> Raster:
    """The angle in radians between each pixel and a reference spectrum. A pixel with an invalid band is NaN, one of all zeros pi/2."""
    ref = np.asarray(reference, dtype=float).ravel()
    if len(ref) != cube.bands:
        raise DimensionMismatch(f"reference length {len(ref)} does not match the {cube.bands} bands")
    if np.isnan(ref).any():
        raise InvalidInput("the reference spectrum contains NaN")
    length = float(np.sqrt((ref * ref).sum()))
    if length == 0:
        raise InvalidInput("the reference spectrum is all zeros")
    nodata = cube.nodata

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in tiles(batch, "spectrum"):
                x = spectra_of(tile.column("spectrum"))
                bad = invalid_mask(x, nodata).any(1)
                with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                    own = np.sqrt((x * x).sum(1))
                    cosine = np.clip(x @ ref / (own * length), -1.0, 1.0)  # keeps NaN
                    angle = np.arccos(cosine)
                angle[own == 0] = np.pi / 2
                angle[bad] = np.nan
                yield pa.RecordBatch.from_arrays([tile.column("row"), tile.column("col"), pa.array(angle)], names=["row", "col", "value"])

    frame = cube.frame.mapInArrow(run, "row int, col int, value double")
    return Raster(frame, "value", cube.height, cube.width)
