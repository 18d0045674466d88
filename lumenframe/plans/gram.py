"""Means and covariances in one distributed pass: each task keeps a count, a mean and a centred Gram matrix; pairs of them are merged.

Centring before squaring keeps the digits that a sum of squares would lose for means far from zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.validity import invalid_mask
from lumenframe.plans.kernels import spectra_of, tiles

_STATE = "n long, skipped long, mean binary, gram binary"
#: States that are merged by one task of a level; few enough for wide spectra.
MERGED_AT_ONCE = 16
#: States that the driver merges.
LAST = 32


class State:
    def __init__(self, bands: int):
        self.n, self.skipped = 0, 0
        self.mean, self.gram = np.zeros(bands), np.zeros((bands, bands))

    def merge(self, n: int, skipped: int, mean: np.ndarray, gram: np.ndarray) -> None:
        self.skipped += skipped
        if not n:
            return
        total = self.n + n
        delta = mean - self.mean
        self.gram += gram + np.outer(delta, delta) * (self.n * n / total)
        self.mean = self.mean + delta * (n / total)
        self.n = total

    def add(self, x: np.ndarray, skipped: int = 0) -> None:
        mean = x.mean(0) if len(x) else self.mean
        y = x - mean
        self.merge(len(x), skipped, mean, y.T @ y)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([self.n]), pa.array([self.skipped]), pa.array([self.mean.tobytes()], pa.binary()), pa.array([self.gram.tobytes()], pa.binary())], names=["n", "skipped", "mean", "gram"]
        )

    def merge_batch(self, batch: pa.RecordBatch) -> None:
        bands = len(self.mean)
        for r in batch.to_pylist():
            self.merge(r["n"], r["skipped"], np.frombuffer(r["mean"]), np.frombuffer(r["gram"]).reshape(bands, bands))


def pixel_state(frame: DataFrame, bands: int, nodata: float | None) -> State:
    """Over the pixels without an invalid band; skipped counts the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = State(bands)
        for batch in batches:
            for tile in tiles(batch, "spectrum"):
                x = spectra_of(tile.column("spectrum"))
                bad = invalid_mask(x, nodata).any(1)
                with np.errstate(invalid="ignore"):
                    state.add(x[~bad], int(bad.sum()))
        yield state.batch()

    return _reduced(frame.select("spectrum").mapInArrow(run, _STATE), bands)


def difference_gram(frame: DataFrame, bands: int) -> tuple[int, np.ndarray]:
    """Number and sum of outer products of the differences between horizontal neighbours, not centred.

    Neighbours meet by a shuffle on the image row, cut into stretches so that no row of a wide scene is one group: each stretch has
    one pixel more than its own, the first of the next.
    """
    stretch = 4096
    own = frame.select("row", F.col("col"), "spectrum", F.floor(F.col("col") / stretch).cast("int").alias("part"))
    edge = own.where((F.col("col") % stretch == 0) & (F.col("col") > 0)).withColumn("part", F.col("part") - 1)
    dealt = own.union(edge).repartition("row", "part").sortWithinPartitions("row", "part", "col")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = State(bands)
        last = None
        for batch in batches:
            for tile in tiles(batch, "spectrum"):
                x = spectra_of(tile.column("spectrum"))
                at = np.stack([tile.column(c).to_numpy() for c in ("row", "part", "col")], 1).astype(np.int64)
                if last is not None:
                    x, at = np.concatenate([last[0], x]), np.concatenate([last[1], at])
                pair = (at[1:, 0] == at[:-1, 0]) & (at[1:, 1] == at[:-1, 1]) & (at[1:, 2] == at[:-1, 2] + 1)
                d = (x[1:] - x[:-1])[pair]
                state.n += len(d)
                state.gram += d.T @ d
                last = x[-1:], at[-1:]
        yield state.batch()

    done = _reduced(dealt.mapInArrow(run, _STATE), bands)
    return done.n, done.gram


def _reduced(states: DataFrame, bands: int) -> State:
    """Merge the states of all tasks, by levels of tasks until few are left, so that the driver never holds one for each partition."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = State(bands)
        for batch in batches:
            for i in range(batch.num_rows):
                state.merge_batch(batch.slice(i, 1))
        yield state.batch()

    n = states.rdd.getNumPartitions()
    while n > LAST:
        n = -(-n // MERGED_AT_ONCE)
        states = states.repartition(n).mapInArrow(merge, _STATE)
    out = State(bands)
    for r in states.toLocalIterator():
        out.merge(r.n, r.skipped, np.frombuffer(r.mean), np.frombuffer(r.gram).reshape(bands, bands))
    return out
