"""Which values count. A value is invalid if it is NaN or equals the cube's nodata value; infinities are valid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def invalid(value: Column, nodata: float | None) -> Column:
    bad = F.isnan(value)
    return bad if nodata is None else bad | (value == F.lit(float(nodata)))


def any_invalid(spectrum: Column, nodata: float | None) -> Column:
    return F.exists(spectrum, lambda v: invalid(v, nodata))


def invalid_mask(values: np.ndarray, nodata: float | None) -> np.ndarray:
    bad = np.isnan(values)
    return bad if nodata is None else bad | (values == nodata)


def nan() -> Column:
    return F.lit(NAN)
