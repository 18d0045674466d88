"""The spectral cube: a DataFrame of pixels (row, col, spectrum) and a little metadata on the driver."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.errors import CubeError, DimensionMismatch, EmptyCube, InvalidInput, InvalidWavelength
from lumenframe.raster import Raster, pixels_to_array

SCHEMA = "row int, col int, spectrum array<double>"
#: Pixels of one Arrow batch made from a local array.
LOCAL_BATCH = 16_384


def session() -> SparkSession:
    found = SparkSession.getActiveSession()
    return found if found is not None else SparkSession.builder.getOrCreate()


def check_metadata(bands: int, height: int, width: int, wavelengths: list[float], fwhm: list[float] | None, nodata: float | None) -> None:
    if not (bands and height and width):
        raise EmptyCube(f"a cube needs bands, rows and columns; this one is ({bands}, {height}, {width})")
    if len(wavelengths) != bands:
        raise DimensionMismatch(f"wavelengths length {len(wavelengths)} differs from the {bands} bands")
    if not all(math.isfinite(w) and w > 0 for w in wavelengths):
        raise InvalidWavelength("wavelengths must be finite and positive")
    if any(b <= a for a, b in zip(wavelengths, wavelengths[1:], strict=False)):
        raise InvalidWavelength("wavelengths must be strictly increasing")
    if fwhm is not None:
        if len(fwhm) != bands:
            raise DimensionMismatch(f"fwhm length {len(fwhm)} differs from the {bands} bands")
        if not all(math.isfinite(w) and w > 0 for w in fwhm):
            raise InvalidInput("fwhm values must be finite and positive")
    if nodata is not None and not math.isfinite(nodata):
        raise InvalidInput("nodata must be finite")


def local_pixels(spark: SparkSession, data: np.ndarray) -> DataFrame:
    """A (bands, height, width) array as a frame of pixels."""
    bands, height, width = data.shape
    flat = np.ascontiguousarray(data.reshape(bands, -1).T)
    n = height * width
    batches = []
    for i in range(0, n, LOCAL_BATCH):
        at = np.arange(i, min(n, i + LOCAL_BATCH))
        offsets = np.arange(len(at) + 1, dtype=np.int32) * bands
        spectra = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[i : i + len(at)].ravel()))
        batches.append(pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32)), spectra], names=["row", "col", "spectrum"]))
    return spark.createDataFrame(pa.Table.from_batches(batches)).to(spark.createDataFrame([], SCHEMA).schema)


class SpectralCube:
    """An immutable cube. `data` is a (bands, height, width) array, or a frame of pixels (row, col, spectrum): all of them, each once.

    The shape of a frame is taken from height and width if both are given, else measured in one pass, which also checks that all
    spectra have the cube's length. Operators return new cubes with lazy frames; nothing runs before data is asked for.
    """

    def __init__(self, data: np.ndarray | DataFrame, wavelengths: Iterable[float], fwhm: Iterable[float] | None = None, nodata: float | None = None, *, height: int | None = None, width: int | None = None):
        wl = [float(w) for w in np.asarray(wavelengths, dtype=float).ravel()]
        fw = None if fwhm is None else [float(w) for w in np.asarray(fwhm, dtype=float).ravel()]
        nodata = None if nodata is None else float(nodata)
        if isinstance(data, DataFrame):
            bands = len(wl)
            if height is None or width is None:
                size = F.size("spectrum")
                r = data.agg(F.max("row").alias("r"), F.max("col").alias("c"), F.min(size).alias("least"), F.max(size).alias("most")).first()
                height, width = (r.r if r.r is not None else -1) + 1, (r.c if r.c is not None else -1) + 1
                if r.least is not None and (r.least != r.most or r.most != bands):
                    raise DimensionMismatch(f"spectra have {r.least} to {r.most} values; wavelengths length is {bands}")
            check_metadata(bands, height, width, wl, fw, nodata)
            frame = data.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("spectrum").cast("array<double>").alias("spectrum"))
        else:
            array = np.asarray(data)
            if array.ndim != 3:
                raise InvalidInput(f"data must have three dimensions (bands, height, width), not {array.ndim}")
            bands, height, width = array.shape
            check_metadata(bands, height, width, wl, fw, nodata)
            frame = local_pixels(session(), array.astype(np.float64))
        self._frame, self._wavelengths, self._fwhm, self._nodata = frame, tuple(wl), None if fw is None else tuple(fw), nodata
        self._shape = (bands, int(height), int(width))

    def with_frame(self, frame: DataFrame, wavelengths: Iterable[float] | None = None, fwhm="same", nodata="same") -> SpectralCube:
        """A cube over other pixels of the same raster; metadata as here unless given."""
        return SpectralCube(
            frame,
            self._wavelengths if wavelengths is None else wavelengths,
            self._fwhm if isinstance(fwhm, str) else fwhm,
            self._nodata if isinstance(nodata, str) else nodata,
            height=self.height,
            width=self.width,
        )

    @property
    def frame(self) -> DataFrame:
        """The pixels: row, col, spectrum."""
        return self._frame

    @property
    def spark(self) -> SparkSession:
        return self._frame.sparkSession

    @property
    def bands(self) -> int:
        return self._shape[0]

    @property
    def height(self) -> int:
        return self._shape[1]

    @property
    def width(self) -> int:
        return self._shape[2]

    @property
    def shape(self) -> tuple[int, int, int]:
        return self._shape

    @property
    def nodata(self) -> float | None:
        return self._nodata

    def wavelengths(self) -> np.ndarray:
        return np.array(self._wavelengths)

    def fwhm(self) -> np.ndarray | None:
        return None if self._fwhm is None else np.array(self._fwhm)

    def data(self) -> np.ndarray:
        """The whole cube as an array, for what fits on the driver."""
        return pixels_to_array(self._frame, "spectrum", self.height, self.width, self.bands)

    def filled(self) -> SpectralCube:
        """The cube with every pixel of its raster, as files need it: those that the frame lacks are no-data throughout, or NaN without
        a no-data value. Only places are shuffled for this, no spectra."""
        places = self.spark.range(self.height * self.width).selectExpr(f"int(id div {self.width}) AS row", f"int(id % {self.width}) AS col")
        lacking = places.join(self._frame.select("row", "col"), ["row", "col"], "left_anti")
        empty = F.array_repeat(F.lit(math.nan if self._nodata is None else self._nodata), self.bands)
        return self.with_frame(self._frame.unionByName(lacking.withColumn("spectrum", empty)))

    def bands_frame(self) -> DataFrame:
        """band, wavelength and fwhm, a row per band."""
        rows = [(i, w, None if self._fwhm is None else self._fwhm[i]) for i, w in enumerate(self._wavelengths)]
        return self.spark.createDataFrame(rows, "band int, wavelength double, fwhm double")

    def long_frame(self) -> DataFrame:
        """row, col, band and value, a row per value."""
        return self._frame.select("row", "col", F.posexplode("spectrum").alias("band", "value"))

    def spectrum(self, row: int, col: int) -> np.ndarray:
        if not (0 <= row < self.height and 0 <= col < self.width):
            raise InvalidInput(f"pixel ({row}, {col}) is out of bounds for {self.height} rows and {self.width} columns")
        found = self._frame.where((F.col("row") == row) & (F.col("col") == col)).first()
        if found is None:
            raise CubeError(f"the frame has no pixel ({row}, {col})")
        return np.array(found.spectrum)

    def _check_band(self, index: int) -> None:
        if not 0 <= index < self.bands:
            raise InvalidInput(f"band {index} is out of bounds (out of range) for {self.bands} bands")

    def band(self, index: int) -> Raster:
        self._check_band(index)
        return Raster(self._frame.select("row", "col", F.get("spectrum", F.lit(index)).alias("value")), "value", self.height, self.width)

    def wavelength(self, index: int) -> float:
        self._check_band(index)
        return self._wavelengths[index]

    @staticmethod
    def _check_query(nm: float) -> float:
        if not math.isfinite(nm):
            raise InvalidWavelength(f"a wavelength to look up must be finite, not {nm}")
        return float(nm)

    def wavelength_index(self, nm: float) -> int:
        nm = self._check_query(nm)
        i = bisect_left(self._wavelengths, nm)
        if i == self.bands or self._wavelengths[i] != nm:
            raise InvalidWavelength(f"no band at exactly {nm:g} nm")
        return i

    def nearest_band_index(self, nm: float) -> int:
        """Of two bands that are equally near, the lower."""
        nm = self._check_query(nm)
        i = bisect_left(self._wavelengths, nm)
        if i == 0:
            return 0
        if i == self.bands:
            return self.bands - 1
        return i - 1 if nm - self._wavelengths[i - 1] <= self._wavelengths[i] - nm else i

    def band_at(self, nm: float) -> Raster:
        return self.band(self.wavelength_index(nm))

    def band_nearest(self, nm: float) -> Raster:
        return self.band(self.nearest_band_index(nm))

    def mean_spectrum_frame(self) -> DataFrame:
        """band and value: the mean of each band's valid values, NaN without any."""
        from lumenframe.operators.statistics import band_stats

        return band_stats(self).frame.select("band", F.col("mean").alias("value"))

    def mean_spectrum(self) -> np.ndarray:
        rows = self.mean_spectrum_frame().collect()
        return np.array([r.value for r in sorted(rows, key=lambda r: r.band)])

    def _subset(self, indices: list[int]) -> SpectralCube:
        first, n = indices[0], len(indices)
        if indices == list(range(first, first + n)):
            chosen = F.col("spectrum") if n == self.bands else F.slice("spectrum", first + 1, n)
        else:
            chosen = F.array(*[F.get("spectrum", F.lit(i)) for i in indices])
        pick = lambda x: None if x is None else [x[i] for i in indices]
        return self.with_frame(self._frame.withColumn("spectrum", chosen), pick(self._wavelengths), pick(self._fwhm))

    def sel_bands(self, indices: Iterable[int]) -> SpectralCube:
        indices = [int(i) for i in indices]
        if not indices:
            raise InvalidInput("band indices must be non-empty")
        for i in indices:
            if not 0 <= i < self.bands:
                raise InvalidInput(f"band index {i} is out of range for {self.bands} bands")
        if any(b <= a for a, b in zip(indices, indices[1:], strict=False)):
            raise InvalidWavelength("the wavelengths of the chosen bands must be strictly increasing")
        return self._subset(indices)

    def sel_wavelengths(self, min_nm: float, max_nm: float) -> SpectralCube:
        """Bands from min_nm to max_nm, both included."""
        if min_nm > max_nm:
            raise InvalidInput(f"min_nm {min_nm} is greater than max_nm {max_nm}")
        indices = [i for i, w in enumerate(self._wavelengths) if min_nm <= w <= max_nm]
        if not indices:
            raise InvalidWavelength(f"no bands between {min_nm} and {max_nm} nm")
        return self._subset(indices)

    def persist(self) -> SpectralCube:
        """Keep the pixels over several passes, as fits and normalisations make."""
        self._frame.persist()
        return self

    def __repr__(self) -> str:
        return f"SpectralCube(bands={self.bands}, height={self.height}, width={self.width})"
