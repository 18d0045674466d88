"""Statistics over all pixels: per band, and between bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.cube import SpectralCube
from lumenframe.functions.validity import invalid_mask, nan
from lumenframe.plans.gram import LAST, MERGED_AT_ONCE, pixel_state
from lumenframe.plans.kernels import spectra_of, tiles

_PART = "band int, n long, least double, most double, mean double, m2 double"


def _partial_stats(bands: int, nodata: float | None):
    """Per task and band: count, least, greatest, mean and centred sum of squares of the valid values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = np.zeros(bands), np.zeros(bands), np.zeros(bands)
        least, most = np.full(bands, np.inf), np.full(bands, -np.inf)
        for batch in batches:
            for tile in tiles(batch, "spectrum"):
                x = spectra_of(tile.column("spectrum"))
                ok = ~invalid_mask(x, nodata)
                k = ok.sum(0)
                some = k > 0
                with np.errstate(invalid="ignore"):
                    own = np.where(ok, x, 0.0).sum(0) / np.maximum(k, 1)
                    square = np.where(ok, x - own, 0.0)
                    square = (square * square).sum(0)
                    least = np.minimum(least, np.where(ok, x, np.inf).min(0))
                    most = np.maximum(most, np.where(ok, x, -np.inf).max(0))
                    total = n + k
                    delta = own - mean
                    m2 = np.where(some, m2 + square + delta * delta * n * k / np.maximum(total, 1), m2)
                    mean = np.where(some, mean + delta * k / np.maximum(total, 1), mean)
                n = total
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(bands, dtype=np.int32)), pa.array(n.astype(np.int64)), pa.array(least), pa.array(most), pa.array(mean), pa.array(m2)], names=["band", "n", "least", "most", "mean", "m2"]
        )

    return run


def _merged_stats(bands: int):
    """To one row per band, merged from the rows of some tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list[tuple] = [(0, np.inf, -np.inf, 0.0, 0.0)] * bands
        for batch in batches:
            for band, n, least, most, mean, m2 in zip(*(c.to_numpy() for c in batch.columns), strict=True):
                if not n:
                    continue
                k, low, high, centre, square = states[band]
                with np.errstate(invalid="ignore"):
                    total, delta = k + n, mean - centre
                    states[band] = (total, min(low, least), max(high, most), centre + delta * n / total if k else mean, square + m2 + (delta * delta * k * n / total if k else 0.0))
        columns = [np.arange(bands, dtype=np.int32), *(np.array(c) for c in zip(*states, strict=True))]
        kinds = [pa.int32(), pa.int64(), *[pa.float64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["band", "n", "least", "most", "mean", "m2"])

    return run


class BandStats:
    """Per band: min, max, mean, population standard deviation and number of valid values. `frame` is lazy; the methods collect."""

    def __init__(self, frame: DataFrame, bands: int):
        self.frame, self.bands = frame, bands
        self._rows = None

    def _column(self, name: str) -> np.ndarray:
        if self._rows is None:
            self._rows = sorted(self.frame.collect(), key=lambda r: r.band)
        return np.array([r[name] for r in self._rows])

    def min(self) -> np.ndarray:
        return self._column("min")

    def max(self) -> np.ndarray:
        return self._column("max")

    def mean(self) -> np.ndarray:
        return self._column("mean")

    def std(self) -> np.ndarray:
        return self._column("std")

    def valid_count(self) -> np.ndarray:
        return self._column("valid_count").astype(np.uint64)

    def __repr__(self) -> str:
        return f"BandStats(bands={self.bands})"


def band_stats(cube: SpectralCube) -> BandStats:
    """One pass; the shuffle carries one row per task and band, merged by levels of tasks where there are many, so that no row ever
    gathers more than LAST states. A band without valid values has NaN and a count of 0."""
    parts = cube.frame.select("spectrum").mapInArrow(_partial_stats(cube.bands, cube.nodata), _PART)
    n = parts.rdd.getNumPartitions()
    while n > LAST:
        n = -(-n // MERGED_AT_ONCE)
        parts = parts.repartition(n).mapInArrow(_merged_stats(cube.bands), _PART)
    spark = cube.spark
    every = spark.range(cube.bands).select(F.col("id").cast("int").alias("band"), F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in ("least", "most", "mean", "m2")])
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merge(a, b):
        total = a["n"] + b["n"]
        share = F.when(total > 0, b["n"] / total).otherwise(0.0)
        delta = b["mean"] - a["mean"]
        return F.struct(
            total.alias("n"), F.when(b["n"] > 0, a["mean"] + delta * share).otherwise(a["mean"]).alias("mean"), F.when(b["n"] > 0, a["m2"] + b["m2"] + delta * delta * share * a["n"]).otherwise(a["m2"]).alias("m2")
        )

    some = F.col("n") > 0
    # Bands without pixels (an empty frame) keep a row; states are put in order, so that sums do not depend on how tasks end.
    grouped = (
        parts.union(every)
        .groupBy("band")
        .agg(F.min(F.when(some, F.col("least"))).alias("least"), F.max(F.when(some, F.col("most"))).alias("most"), F.array_sort(F.collect_list(F.struct("n", "mean", "m2"))).alias("states"))
        .withColumn("s", F.aggregate("states", start, merge))
    )
    ok = F.col("s.n") > 0
    frame = grouped.select(
        "band",
        F.when(ok, F.col("least")).otherwise(nan()).alias("min"),
        F.when(ok, F.col("most")).otherwise(nan()).alias("max"),
        F.when(ok, F.col("s.mean")).otherwise(nan()).alias("mean"),
        F.when(ok & (F.col("least") == F.col("most")), F.lit(0.0)).when(ok, F.sqrt(F.col("s.m2") / F.when(ok, F.col("s.n")))).otherwise(nan()).alias("std"),
        F.col("s.n").alias("valid_count"),
    )
    return BandStats(frame, cube.bands)


def covariance(cube: SpectralCube) -> np.ndarray:
    """Population covariance between bands over the pixels without an invalid band; all NaN without such pixels."""
    state = pixel_state(cube.frame, cube.bands, cube.nodata)
    if not state.n:
        return np.full((cube.bands, cube.bands), np.nan)
    cov = state.gram / state.n
    return (cov + cov.T) / 2


def correlation(cube: SpectralCube) -> np.ndarray:
    """Correlation between bands, NaN for bands that do not vary (their least and greatest values over the counted pixels agree)."""
    cov = covariance(cube)
    return correlation_of(cov, constant_bands(cube) if np.isfinite(cov).any() else np.zeros(cube.bands, bool))


def constant_bands(cube: SpectralCube) -> np.ndarray:
    from lumenframe.functions.validity import any_invalid

    clean = cube.with_frame(cube.frame.where(~any_invalid(F.col("spectrum"), cube.nodata)))
    stats = band_stats(clean)
    return stats.min() == stats.max()


def correlation_of(cov: np.ndarray, constant: np.ndarray) -> np.ndarray:
    deviation = np.sqrt(np.maximum(np.nan_to_num(np.diag(cov)), 0))
    deviation[constant] = 0
    scale = np.outer(deviation, deviation)
    return np.where(scale == 0, np.nan, cov / np.where(scale == 0, 1.0, scale))


def matrix_frame(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """A matrix between bands as rows band_i, band_j, value."""
    i, j = np.indices(matrix.shape, dtype=np.int32)
    return spark.createDataFrame(pa.table({"band_i": i.ravel(), "band_j": j.ravel(), "value": np.asarray(matrix, float).ravel()}))
