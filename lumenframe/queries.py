"""The registered queries over spectral cubes, and their SQL.

The `embeddings` table stands in for a scene: 25 pixels a line, 64 bands from 400 nm in steps of 10 nm. Values are rounded to six
digits on both sides, and a zero is never negative.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
from collections.abc import Callable
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import operators as op
from lumenframe.cube import SpectralCube
from lumenframe.operators.statistics import matrix_frame
from lumenframe.plans.gram import difference_gram
from lumenframe.raster import Raster
from lumenframe.sources import read_envi, read_parquet, read_zarr, read_zarr_window, read_zarr_with_options, write_envi, write_parquet, write_zarr, zarr_cube_shape

WIDTH, BANDS, NODATA = 25, 64, -9999.0
WAVELENGTHS = [400.0 + 10 * i for i in range(BANDS)]
REFERENCE = [0.1 + 0.01 * i for i in range(BANDS)]
THREE = [3, 7, 20]
ENVI_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
ZARR_TYPES = ["float64", "float32", "uint8", "uint16", "uint32", "uint64", "int16", "int32", "int64"]
TARGET = [405.0 + 7 * j for j in range(89)]


def scene(spark: SparkSession, sf_dir: str, nodata: bool = False) -> SpectralCube:
    spectrum = F.col("embedding").cast("array<double>")
    if nodata:
        spectrum = F.transform(spectrum, lambda v, i: F.when((F.col("vec_id") % 17 == 0) & (i == 3), F.lit(NODATA)).otherwise(v))
    pixels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.floor(F.col("vec_id") / WIDTH).cast("int").alias("row"), (F.col("vec_id") % WIDTH).cast("int").alias("col"), spectrum.alias("spectrum")
    )
    return SpectralCube(pixels, WAVELENGTHS, nodata=NODATA if nodata else None)


def _tidy(value: Column) -> Column:
    r = F.round(value, 6)
    return F.when(r == 0, 0.0).otherwise(r)


def _long(cube: SpectralCube) -> DataFrame:
    return cube.long_frame().select("row", "col", "band", F.coalesce(~F.isnan("value"), F.lit(False)).alias("valid"), F.when(F.isnan("value"), 0.0).otherwise(_tidy(F.col("value"))).alias("value"))


def _map(raster: Raster) -> DataFrame:
    return raster.frame.select("row", "col", (~F.isnan("value")).alias("valid"), F.when(F.isnan("value"), 0.0).otherwise(_tidy(F.col("value"))).alias("value"))


def _matrix(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    return matrix_frame(spark, matrix).select("band_i", "band_j", _tidy(F.col("value")).alias("value"))


def _stats(cube: SpectralCube) -> DataFrame:
    return op.band_stats(cube).frame.select("band", *[_tidy(F.col(c)).alias(c) for c in ("min", "max", "mean", "std")], "valid_count")


def _folder(spark: SparkSession) -> Path:
    """A folder that all executors see: in spark.checkpoint.dir if that is a mounted path, a temporary one in a local session. It
    stays until the driver ends, as a lost executor's rows are read again."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or ""
    base = shared.removeprefix("file://") if shared.startswith(("/", "file:///")) else None
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("cube files need spark.checkpoint.dir to be a path that the driver and all executors mount")
    if base is not None:
        Path(base).mkdir(parents=True, exist_ok=True)
    folder = Path(tempfile.mkdtemp(prefix="lumenframe-", dir=base))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _kept(spark: SparkSession, make: Callable[[Path], SpectralCube]) -> DataFrame:
    """The pixels of a cube that is read back from files."""
    return _long(make(_folder(spark)))


def _present(cube: SpectralCube, of: SpectralCube, top: int = 0, left: int = 0) -> SpectralCube:
    """A cube that is read back from files, with the pixels of `of` only: a file holds a whole raster, and a scene may lack some of it,
    as the end of its last line. The cube's corner lies at top and left of the scene."""
    own = of.frame.select((F.col("row") - top).alias("row"), (F.col("col") - left).alias("col"))
    return cube.with_frame(cube.frame.join(own, ["row", "col"], "left_semi"))


def _envi_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: Path) -> SpectralCube:
        cube = scene(spark, sf_dir)
        whole = cube.filled()
        for order in ("bsq", "bil", "bip"):
            write_envi(whole, folder / f"{order}.img", interleave=order)
            whole = read_envi(folder / f"{order}.hdr", spark)
        return _present(whole, cube)

    return _kept(spark, make)


def _envi_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: Path) -> SpectralCube:
        cube = scene(spark, sf_dir)
        hundred = cube.with_frame(cube.frame.withColumn("spectrum", F.transform("spectrum", lambda v: v * 100)))
        write_envi(hundred.filled(), folder / "whole.dat", "i16", "bil", force=True)
        return _present(read_envi(folder / "whole.dat", spark), cube)

    return _kept(spark, make)


def _zarr_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: Path) -> SpectralCube:
        cube = scene(spark, sf_dir)
        write_zarr(cube.filled(), folder / "s.zarr", chunk_shape=(16, 7, 10))
        return _present(read_zarr(folder / "s.zarr", spark=spark), cube)

    return _kept(spark, make)


def _parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: Path) -> SpectralCube:
        write_parquet(scene(spark, sf_dir), folder / "cube.parquet")
        return read_parquet(folder / "cube.parquet", spark)

    return _kept(spark, make)


def _zarr_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: Path) -> SpectralCube:
        cube = scene(spark, sf_dir)
        write_zarr(cube.filled(), folder / "s.zarr", compression="none", chunk_shape=(16, 7, 10))
        return _present(read_zarr_window(folder / "s.zarr", (5, 21), (2, 10), (3, 18), spark), cube, 2, 3)

    return _kept(spark, make)


def _zarr_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(folder: Path) -> SpectralCube:
        cube = scene(spark, sf_dir, True)
        write_zarr(cube.filled(), folder / "s.zarr")
        return _present(read_zarr(folder / "s.zarr", scale_factor=0.5, add_offset=1.0, spark=spark), cube)

    return _kept(spark, make)


def _codes(spark: SparkSession, sf_dir: str) -> SpectralCube:
    """Three bands as whole numbers from 0 to 255, which every data type holds."""
    cube = scene(spark, sf_dir).sel_bands(THREE)
    return cube.with_frame(cube.frame.withColumn("spectrum", F.transform("spectrum", lambda v: F.round(v * 100) + 100)))


def _array(cube: SpectralCube) -> np.ndarray:
    """The whole raster for files of other programs; places that the scene has no pixel for hold 0, which every data type has."""
    return cube.with_frame(cube.frame, nodata=0.0).filled().data()


def _envi_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of other programs: every data type in both byte orders, with a header that starts with empty lines."""
    folder, cube, out = _folder(spark), _codes(spark, sf_dir), None
    values = _array(cube)
    for code, kind in ENVI_TYPES.items():
        for order in (0, 1):
            name = folder / f"t{code}{order}"
            name.with_suffix(".img").write_bytes(values.astype((">" if order else "<") + kind).tobytes())
            name.with_suffix(".hdr").write_text(
                f"\n  ENVI\nsamples = {cube.width}\nlines = {cube.height}\nbands = {cube.bands}\ndata type = {code}\ninterleave = BSQ\nbyte order = {order}\nwavelength = {{430, 470, 600}}\n"
            )
            one = _long(_present(read_envi(name.with_suffix(".hdr"), spark), cube)).withColumn("kind", F.lit(10 * code + order))
            out = one if out is None else out.union(one)
    return out


def _foreign_zarr(folder: Path, values: np.ndarray, axes: str, kind: str) -> Path:
    """A store as other programs write it: axes in their order, names in capitals, another array of three dimensions before it."""
    store = folder / f"{axes}-{kind}.zarr"
    block = values.transpose(["bsq".index(c) for c in {"bsq": "bsq", "bil": "sbq", "bip": "sqb"}[axes]])
    arrays = {"Another": (np.zeros((2, 2, 2)), "float64"), "cube/REFLECTANCE": (block, kind), "meta/Wavelength_Centers": (np.array([430.0, 470.0, 600.0]), "float64"), "meta/FWHM": (np.array([9.0, 9.5, 10.0]), "float32")}
    for name, (data, type_) in arrays.items():
        at = store / name
        at.mkdir(parents=True)
        meta = {
            "zarr_format": 3, "node_type": "array", "shape": list(data.shape), "data_type": type_, "fill_value": 0, "codecs": [{"name": "bytes", "configuration": {"endian": "big"}}],
            "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(data.shape)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "."}}, "attributes": {},
        }
        (at / "zarr.json").write_text(json.dumps(meta))
        (at / ("c." + ".".join("0" for _ in data.shape))).write_bytes(data.astype(np.dtype(type_).newbyteorder(">")).tobytes())
    (store / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {}}))
    return store


def _zarr_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, cube, out = _folder(spark), _codes(spark, sf_dir), None
    values = _array(cube)
    for axes in ("bsq", "bil", "bip"):
        for kind in ZARR_TYPES:
            one = _long(_present(read_zarr(_foreign_zarr(folder, values, axes, kind), spark=spark), cube)).withColumn("kind", F.lit(f"{axes} {kind}"))
            out = one if out is None else out.union(one)
    return out


def _zarr_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = zarr_cube_shape(_foreign_zarr(_folder(spark), _codes(spark, sf_dir).data(), "bip", "uint16"))
    return spark.createDataFrame([tuple(int(n) for n in shape)], "d0 long, d1 long, d2 long")


def _zarr_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _codes(spark, sf_dir)
    store = _foreign_zarr(_folder(spark), _array(codes), "bil", "int16")
    cube = _present(read_zarr_with_options(store, "/cube/REFLECTANCE", "meta/Wavelength_Centers", "meta/FWHM", 100.0, 2.0, -1.0, spark), codes)
    return cube.long_frame().select("row", "col", "band", F.lit(float(cube.fwhm()[1])).alias("fwhm"), _tidy(F.col("value")).alias("value"))


def _three(spark: SparkSession, sf_dir: str) -> SpectralCube:
    return scene(spark, sf_dir).sel_bands(THREE)


def _axes(spark: SparkSession, components: np.ndarray, values: np.ndarray) -> DataFrame:
    rows = [(i, b, float(x), float(values[i])) for i, row in enumerate(components) for b, x in enumerate(row)]
    return spark.createDataFrame(rows, "component int, band int, weight double, size double").select("component", "band", _tidy(F.col("weight")).alias("weight"), _tidy(F.col("size")).alias("size"))


def _pca_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = op.pca(_three(spark, sf_dir))
    return _axes(spark, fit.components(), fit.explained_variance())


def _pca_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _three(spark, sf_dir)
    fit = op.pca(cube, 1)
    return _long(op.pca_inverse(op.pca_transform(cube, fit), fit))


def _mnf_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = op.mnf(_three(spark, sf_dir))
    return _axes(spark, fit.components(), fit.eigenvalues())


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all 64 components: how far they are from solving their eigenproblem, and from being a basis."""
    cube = scene(spark, sf_dir)
    n, gram = difference_gram(cube.frame, cube.bands)
    noise, pixels = gram / (2 * max(n - 1, 1)), cube.height * cube.width
    signal = op.covariance(cube) * pixels / (pixels - 1)
    fits = [("pca", op.pca(cube), np.eye(cube.bands)), ("mnf", op.mnf(cube), noise)]
    rows = []
    for name, fit, metric in fits:
        v, size = fit.components(), fit.explained_variance() if name == "pca" else fit.eigenvalues()
        error = np.abs(signal @ v.T - (metric @ v.T) * size).max(0) / np.abs(signal).max()
        basis = v @ metric @ v.T / np.sqrt(np.outer(np.diag(v @ metric @ v.T), np.diag(v @ metric @ v.T)))
        rows += [(name, i, round(abs(float(e)), 6), round(float(np.abs(basis[i] - np.eye(len(v))[i]).max()), 6), bool(i == 0 or size[i] <= size[i - 1])) for i, e in enumerate(error)]
    return spark.createDataFrame(rows, "method string, component int, residual double, skew double, ordered boolean")


def _pca_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = scene(spark, sf_dir)
    scores = op.pca_transform(cube, op.pca(cube))
    return scores.frame.select("row", "col", _tidy(F.aggregate("scores", F.lit(0.0), lambda s, x: s + x * x)).alias("energy"))


def _pca_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = scene(spark, sf_dir)
    fit = op.pca(cube)
    return _long(op.pca_inverse(op.pca_transform(cube, fit), fit))


def _pca_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = op.pca(scene(spark, sf_dir), 5)
    return _matrix(spark, fit.components())


def _pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = op.pca(scene(spark, sf_dir))
    return spark.createDataFrame([(round(float(fit.explained_variance().sum()), 6),)], "total_variance double")


def _mnf_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = op.mnf(scene(spark, sf_dir))
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(fit.eigenvalues())], "component int, eigenvalue double")


def _noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = scene(spark, sf_dir)
    n, gram = difference_gram(cube.frame, cube.bands)
    return _matrix(spark, gram / (2 * max(n - 1, 1)))


def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = scene(spark, sf_dir).spectrum(3, 4)
    table = pa.table({"band": np.arange(len(values), dtype=np.int32), "value": values})
    return spark.createDataFrame(table).select("band", _tidy(F.col("value")).alias("value"))


def _with(make: Callable, out: Callable, nodata: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(make(scene(spark, sf_dir, nodata)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    cubes = {
        "sel_bands": lambda c: c.sel_bands([3, 7, 20]),
        "sel_wavelengths": lambda c: c.sel_wavelengths(450, 500),
        "normalize_minmax": op.normalize_minmax,
        "normalize_zscore": op.normalize_zscore,
        "derivative_1": lambda c: op.derivative(c, 1),
        "derivative_2": lambda c: op.derivative(c, 2),
        "savitzky_golay": lambda c: op.savitzky_golay(c, 5, 2),
        "continuum_removal": op.continuum_removal,
        "resample_linear": lambda c: op.resample(c, TARGET, "linear"),
        "resample_cubic": lambda c: op.resample(c, TARGET, "cubic"),
    }
    maps = {
        "band": lambda c: c.band(10),
        "band_at": lambda c: c.band_at(470.0),
        "band_nearest": lambda c: c.band_nearest(505.0),
        "ndvi": lambda c: op.ndvi(c, 46, 25),
        "normalized_difference": lambda c: op.normalized_difference(c, 3, 8),
        "band_ratio": lambda c: op.band_ratio(c, 3, 8),
        "sam": lambda c: op.sam(c, REFERENCE),
    }
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name, make in cubes.items():
        out[name] = partial(_with, make, _long, False)
    for name in ("normalize_minmax", "derivative_1", "savitzky_golay", "continuum_removal", "resample_linear"):
        out[f"{name}_nodata"] = partial(_with, cubes[name], _long, True)
    for name, make in maps.items():
        out[name] = partial(_with, make, _map, False)
    for name in ("normalized_difference", "band_ratio", "sam"):
        out[f"{name}_nodata"] = partial(_with, maps[name], _map, True)
    mean = lambda c: c.mean_spectrum_frame().select("band", _tidy(F.col("value")).alias("value"))
    plain = lambda c: c
    out |= {
        "spectrum": _single,
        "mean_spectrum": partial(_with, plain, mean, False),
        "mean_spectrum_nodata": partial(_with, plain, mean, True),
        "band_stats": partial(_with, plain, _stats, False),
        "band_stats_nodata": partial(_with, plain, _stats, True),
        "covariance": partial(_with, plain, lambda c: _matrix(c.spark, op.covariance(c)), False),
        "covariance_nodata": partial(_with, plain, lambda c: _matrix(c.spark, op.covariance(c)), True),
        "correlation": partial(_with, plain, lambda c: _matrix(c.spark, op.correlation(c)), False),
        "noise_covariance": _noise,
        "pca_total_variance": _pca_variance,
        "pca_components": _pca_components,
        "pca_transform_energy": _pca_energy,
        "pca_roundtrip": _pca_roundtrip,
        "mnf_eigenvalues": _mnf_eigenvalues,
        "mnf_denoise_full": partial(_with, lambda c: op.mnf_denoise(c, BANDS), _long, False),
        "envi_roundtrip": _envi_roundtrip,
        "envi_integers": _envi_integers,
        "parquet_roundtrip": _parquet_roundtrip,
        "zarr_roundtrip": _zarr_roundtrip,
        "zarr_window": _zarr_window,
        "zarr_scaled": _zarr_scaled,
        "zarr_layouts": _zarr_layouts,
        "zarr_shape": _zarr_shape,
        "zarr_paths": _zarr_paths,
        "envi_types": _envi_types,
        "pca_three": _pca_three,
        "pca_truncated": _pca_truncated,
        "mnf_three": _mnf_three,
        "mnf_denoise_truncated": partial(_with, lambda c: op.mnf_denoise(c.sel_bands(THREE), 1), _long, False),
        "eigen_residuals": _residuals,
    }
    return out


def _r(x: str) -> str:
    return f"CASE WHEN round({x}, 6) = 0 THEN 0::DOUBLE ELSE round({x}, 6) END"


_CUBE = f"""cube AS (
  SELECT CAST(vec_id // {WIDTH} AS INTEGER) AS "row", CAST(vec_id % {WIDTH} AS INTEGER) AS col,
         list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings)"""
_HOLED = f"""cube AS (
  SELECT CAST(vec_id // {WIDTH} AS INTEGER) AS "row", CAST(vec_id % {WIDTH} AS INTEGER) AS col,
         list_transform(embedding, lambda x, i: CASE WHEN vec_id % 17 = 0 AND i = 4 THEN {NODATA}::DOUBLE ELSE CAST(x AS DOUBLE) END) AS s FROM embeddings)"""
_VALUES = 'vals AS (SELECT "row", col, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS band, unnest(s) AS v FROM cube)'
_HOLE = f"list_contains(s, {NODATA}::DOUBLE)"


def _sql_long(spectrum: str, nodata: bool = False, whole: bool = True) -> str:
    """Values of a list expression over each pixel's s; whole: a pixel with a hole has no valid value."""
    head = f"WITH {_HOLED if nodata else _CUBE}, done AS (SELECT \"row\", col, {_HOLE if nodata and whole else 'false'} AS hole, {spectrum} AS o FROM cube)"
    flat = 'flat AS (SELECT "row", col, hole, CAST(generate_subscripts(o, 1) - 1 AS INTEGER) AS band, unnest(o) AS v FROM done)'
    ok = "NOT hole AND v IS NOT NULL"
    return f'{head}, {flat} SELECT "row", col, band, ({ok}) AS valid, CASE WHEN {ok} THEN {_r("v")} ELSE 0::DOUBLE END AS value FROM flat'


def _sql_map(value: str, hole: str = "false", nodata: bool = False) -> str:
    head = f'WITH {_HOLED if nodata else _CUBE}, done AS (SELECT "row", col, {hole} AS hole, {value} AS v FROM cube)'
    return f'{head} SELECT "row", col, NOT hole AS valid, CASE WHEN hole THEN 0::DOUBLE ELSE {_r("v")} END AS value FROM done'


def _sql_divide(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} = 0 THEN 0::DOUBLE ELSE ({top}) / ({bottom}) END"


def _sql_normal(minmax: bool, nodata: bool) -> str:
    keep = f"v <> {NODATA}" if nodata else "true"
    shift, scale = ("min(v)", "max(v) - min(v)") if minmax else ("avg(v)", "stddev_pop(v)")
    return f"""WITH {_HOLED if nodata else _CUBE}, {_VALUES},
      stats AS (SELECT band, {shift} AS a, {scale} AS b FROM vals WHERE {keep} GROUP BY band)
      SELECT "row", col, vals.band AS band, ({keep}) AS valid, CASE WHEN {keep} THEN {_r("CASE WHEN b = 0 THEN 0::DOUBLE ELSE (v - a) / b END")} ELSE 0::DOUBLE END AS value
      FROM vals JOIN stats USING (band)"""


def _sql_continuum(nodata: bool) -> str:
    hole = _HOLE if nodata else "false"
    return f"""WITH {_HOLED if nodata else _CUBE},
      low AS (SELECT "row", col, {hole} AS hole, list_transform(s, lambda x: greatest(x, 0::DOUBLE)) AS s FROM cube),
      spans AS (SELECT l.range AS l, r.range AS r FROM range({BANDS}) l, range({BANDS}) r WHERE l.range <= r.range),
      places AS (SELECT i.range AS i, l, r FROM range({BANDS}) i, spans WHERE l <= i.range AND i.range <= r),
      hull AS (SELECT "row", col, hole, CAST(i AS INTEGER) AS band, any_value(s[i + 1]) AS v,
               max(CASE WHEN l = r THEN s[l + 1] ELSE s[l + 1] + (s[r + 1] - s[l + 1]) * (i - l) / (r - l) END) AS h
               FROM low, places GROUP BY "row", col, hole, i)
      SELECT "row", col, band, NOT hole AS valid, CASE WHEN hole THEN 0::DOUBLE ELSE {_r("CASE WHEN h = 0 THEN 0::DOUBLE ELSE v / h END")} END AS value FROM hull"""


def _sql_resample(cubic: bool, nodata: bool = False) -> str:
    targets = f"list_transform(range({len(TARGET)}), lambda j: 405::DOUBLE + 7 * j)"
    i = f"CAST(least(floor((t - 400) / 10), {BANDS - 2}) AS BIGINT)"
    f_ = f"((t - 400) / 10 - {i})"
    y = lambda k: f"s[greatest(least({i} + {k}, {BANDS - 1}), 0) + 1]"
    if not cubic:
        value = f"(1 - {f_}) * {y(0)} + {f_} * {y(1)}"
    else:
        m1 = f"CASE WHEN {i} = 0 THEN {y(1)} - {y(0)} ELSE ({y(1)} - {y(-1)}) / 2 END"
        m2 = f"CASE WHEN {i} = {BANDS - 2} THEN {y(1)} - {y(0)} ELSE ({y(2)} - {y(0)}) / 2 END"
        value = f"(2*{f_}**3 - 3*{f_}**2 + 1) * {y(0)} + ({f_}**3 - 2*{f_}**2 + {f_}) * ({m1}) + (-2*{f_}**3 + 3*{f_}**2) * {y(1)} + ({f_}**3 - {f_}**2) * ({m2})"
    return _sql_long(f"list_transform({targets}, lambda t: {value})", nodata)


def _sql_matrix(body: str, nodata: bool = False) -> str:
    clean = f"clean AS (SELECT vals.* FROM vals JOIN cube USING (\"row\", col) WHERE NOT {_HOLE})" if nodata else "clean AS (SELECT * FROM vals)"
    return f"WITH {_HOLED if nodata else _CUBE}, {_VALUES}, {clean}, {body}"


#: Means, covariances S and noise N of three bands, and a matrix M whose eigenvectors are wanted.
_MOMENTS = f"""{_CUBE},
  p AS (SELECT "row", col, s[4] AS x1, s[8] AS x2, s[21] AS x3 FROM cube),
  d AS (SELECT lead(x1) OVER w - x1 AS d1, lead(x2) OVER w - x2 AS d2, lead(x3) OVER w - x3 AS d3 FROM p WINDOW w AS (PARTITION BY "row" ORDER BY col)),
  mom AS (SELECT avg(x1) AS a1, avg(x2) AS a2, avg(x3) AS a3, covar_samp(x1, x1) AS s11, covar_samp(x1, x2) AS s12, covar_samp(x1, x3) AS s13, covar_samp(x2, x2) AS s22, covar_samp(x2, x3) AS s23, covar_samp(x3, x3) AS s33 FROM p),
  noi AS (SELECT sum(d1*d1)/k AS n11, sum(d1*d2)/k AS n12, sum(d1*d3)/k AS n13, sum(d2*d2)/k AS n22, sum(d2*d3)/k AS n23, sum(d3*d3)/k AS n33
          FROM d, (SELECT 2 * (count(d1) - 1) AS k FROM d) WHERE d1 IS NOT NULL GROUP BY k)"""
_PCA_MATRIX = "mat AS (SELECT s11 AS m11, s12 AS m12, s13 AS m13, s12 AS m21, s22 AS m22, s23 AS m23, s13 AS m31, s23 AS m32, s33 AS m33 FROM mom)"
#: N^-1 S, the inverse by cofactors.
_MNF_MATRIX = """inv AS (SELECT (n22*n33-n23*n23)/det AS i11, (n13*n23-n12*n33)/det AS i12, (n12*n23-n13*n22)/det AS i13, (n11*n33-n13*n13)/det AS i22, (n12*n13-n11*n23)/det AS i23, (n11*n22-n12*n12)/det AS i33
    FROM noi, (SELECT n11*(n22*n33-n23*n23) - n12*(n12*n33-n13*n23) + n13*(n12*n23-n13*n22) AS det FROM noi)),
  mat AS (SELECT i11*s11+i12*s12+i13*s13 AS m11, i11*s12+i12*s22+i13*s23 AS m12, i11*s13+i12*s23+i13*s33 AS m13, i12*s11+i22*s12+i23*s13 AS m21, i12*s12+i22*s22+i23*s23 AS m22, i12*s13+i22*s23+i23*s33 AS m23,
    i13*s11+i23*s12+i33*s13 AS m31, i13*s12+i23*s22+i33*s23 AS m32, i13*s13+i23*s23+i33*s33 AS m33 FROM inv, mom)"""
#: Eigenvalues by the cubic's three real roots, from the greatest; an eigenvector is the longest cross product of two rows of M - size I.
_EIGEN = """cub AS (SELECT *, m11+m22+m33 AS c2, m11*m22-m12*m21+m11*m33-m13*m31+m22*m33-m23*m32 AS c1, m11*(m22*m33-m23*m32)-m12*(m21*m33-m23*m31)+m13*(m21*m32-m22*m31) AS c0 FROM mat),
  tri AS (SELECT *, sqrt((c2*c2-3*c1)/9) AS q FROM cub),
  lam AS (SELECT tri.*, CAST(k AS INTEGER) AS component, c2/3 + 2*q*cos((acos(greatest(-1::DOUBLE, least(1::DOUBLE, (2*c2*c2*c2-9*c2*c1+27*c0)/(54*q*q*q)))) - 2*pi()*k)/3) AS size FROM tri, range(3) AS t(k)),
  cand AS (SELECT component, size, unnest([
      [m12*m23-m13*(m22-size), m13*m21-(m11-size)*m23, (m11-size)*(m22-size)-m12*m21],
      [m12*(m33-size)-m13*m32, m13*m31-(m11-size)*(m33-size), (m11-size)*m32-m12*m31],
      [(m22-size)*(m33-size)-m23*m32, m23*m31-m21*(m33-size), m21*m32-(m22-size)*m31]]) AS v FROM lam),
  best AS (SELECT component, size, max_by(v, list_dot_product(v, v)) AS v FROM cand GROUP BY component, size),
  eig AS (SELECT component, size, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)) * sign(list_max(v) + list_min(v))) AS v FROM best)"""


def _sql_axes(matrix: str) -> str:
    return f"""WITH {_MOMENTS}, {matrix}, {_EIGEN}, flat AS (SELECT component, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS band, unnest(v) AS w, size FROM eig)
      SELECT component, band, {_r("w")} AS weight, {_r("size")} AS size FROM flat"""


def _sql_one_axis(matrix: str, left: str, scale: str) -> str:
    """Pixels rebuilt from their first component: the mean, and along `left` what the component says, over `scale`."""
    dot = "((x1-a1)*v[1] + (x2-a2)*v[2] + (x3-a3)*v[3])"
    values = ", ".join(f"a{i} + {left.format(i=i)} * {dot} / ({scale})" for i in (1, 2, 3))
    return f"""WITH {_MOMENTS}, {matrix}, {_EIGEN}, done AS (SELECT "row", col, [{values}] AS o FROM p, mom, noi, eig WHERE component = 0),
      flat AS (SELECT "row", col, CAST(generate_subscripts(o, 1) - 1 AS INTEGER) AS band, unnest(o) AS v FROM done) SELECT "row", col, band, true AS valid, {_r("v")} AS value FROM flat"""


def oracle_sql() -> dict[str, str]:
    pairs = 'pairs AS (SELECT a.band AS band_i, b.band AS band_j, a.v AS x, b.v AS y FROM clean a JOIN clean b USING ("row", col))'
    stats = lambda keep: f"SELECT band, {_r('min(v)')} AS min, {_r('max(v)')} AS max, {_r('avg(v)')} AS mean, {_r('stddev_pop(v)')} AS std, count(v) AS valid_count FROM vals WHERE {keep} GROUP BY band"
    mean = lambda keep: f"SELECT band, {_r('avg(v)')} AS value FROM vals WHERE {keep} GROUP BY band"
    seen = f"v <> {NODATA}"
    first = "list_transform(range(1, 64), lambda i: (s[i + 1] - s[i]) / 10)"
    first_holed = f"list_transform(range(1, 64), lambda i: CASE WHEN s[i + 1] = {NODATA} OR s[i] = {NODATA} THEN NULL ELSE (s[i + 1] - s[i]) / 10 END)"
    second = "list_transform(range(1, 63), lambda i: ((s[i + 2] - s[i + 1]) / 10 - (s[i + 1] - s[i]) / 10) / 10)"
    tap = lambda k: f"s[CASE WHEN b + {k} < 0 THEN -(b + {k}) WHEN b + {k} > 63 THEN 126 - (b + {k}) ELSE b + {k} END + 1]"
    smooth = f"list_transform(range(64), lambda b: (-3 * {tap(-2)} + 12 * {tap(-1)} + 17 * {tap(0)} + 12 * {tap(1)} - 3 * {tap(2)}) / 35)"
    reference = "list_transform(range(64), lambda i: 0.1::DOUBLE + 0.01::DOUBLE * i)"
    norm = "sqrt(list_dot_product(s, s))"
    angle = f"CASE WHEN {norm} = 0 THEN pi() / 2 ELSE acos(greatest(-1::DOUBLE, least(1::DOUBLE, list_dot_product(s, {reference}) / ({norm} * sqrt(list_dot_product({reference}, {reference})))))) END"
    nd, ratio = _sql_divide("s[4] - s[9]", "(s[4] + s[9])"), _sql_divide("s[4]", "s[9]")
    hole_3 = f"s[4] = {NODATA}"
    same = _sql_long("s")
    codes = _sql_long("list_transform([s[4], s[8], s[21]], lambda x: round(x * 100) + 100)")
    return {
        "sel_bands": _sql_long("[s[4], s[8], s[21]]"),
        "sel_wavelengths": _sql_long("s[6:11]"),
        "normalize_minmax": _sql_normal(True, False),
        "normalize_zscore": _sql_normal(False, False),
        "derivative_1": _sql_long(first),
        "derivative_2": _sql_long(second),
        "savitzky_golay": _sql_long(smooth),
        "continuum_removal": _sql_continuum(False),
        "resample_linear": _sql_resample(False),
        "resample_cubic": _sql_resample(True),
        "normalize_minmax_nodata": _sql_normal(True, True),
        "derivative_1_nodata": _sql_long(first_holed, True, whole=False),
        "savitzky_golay_nodata": _sql_long(smooth, True),
        "continuum_removal_nodata": _sql_continuum(True),
        "resample_linear_nodata": _sql_resample(False, True),
        "band": _sql_map("s[11]"),
        "band_at": _sql_map("s[8]"),
        "band_nearest": _sql_map("s[11]"),
        "ndvi": _sql_map(_sql_divide("s[47] - s[26]", "(s[47] + s[26])")),
        "normalized_difference": _sql_map(nd),
        "band_ratio": _sql_map(ratio),
        "sam": _sql_map(angle),
        "normalized_difference_nodata": _sql_map(nd, hole_3, True),
        "band_ratio_nodata": _sql_map(ratio, hole_3, True),
        "sam_nodata": _sql_map(angle, _HOLE, True),
        "spectrum": f'WITH {_CUBE}, {_VALUES} SELECT band, {_r("v")} AS value FROM vals WHERE "row" = 3 AND col = 4',
        "mean_spectrum": f"WITH {_CUBE}, {_VALUES} {mean('true')}",
        "mean_spectrum_nodata": f"WITH {_HOLED}, {_VALUES} {mean(seen)}",
        "band_stats": f"WITH {_CUBE}, {_VALUES} {stats('true')}",
        "band_stats_nodata": f"WITH {_HOLED}, {_VALUES} {stats(seen)}",
        "covariance": _sql_matrix(f"{pairs} SELECT band_i, band_j, {_r('covar_pop(x, y)')} AS value FROM pairs GROUP BY band_i, band_j"),
        "covariance_nodata": _sql_matrix(f"{pairs} SELECT band_i, band_j, {_r('covar_pop(x, y)')} AS value FROM pairs GROUP BY band_i, band_j", True),
        "correlation": _sql_matrix(f"{pairs} SELECT band_i, band_j, {_r('covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y))')} AS value FROM pairs GROUP BY band_i, band_j"),
        "noise_covariance": _sql_matrix(
            'steps AS (SELECT "row", col, band, lead(v) OVER (PARTITION BY "row", band ORDER BY col) - v AS d FROM clean), '
            'pairs AS (SELECT a.band AS band_i, b.band AS band_j, a.d AS x, b.d AS y FROM steps a JOIN steps b USING ("row", col) WHERE a.d IS NOT NULL AND b.d IS NOT NULL) '
            f"SELECT band_i, band_j, {_r('sum(x * y) / (2 * (count(*) - 1))')} AS value FROM pairs GROUP BY band_i, band_j"
        ),
        "pca_total_variance": f"WITH {_CUBE}, {_VALUES}, each AS (SELECT var_samp(v) AS x FROM vals GROUP BY band) SELECT round(sum(x), 6) AS total_variance FROM each",
        "pca_transform_energy": f"""WITH {_CUBE}, {_VALUES}, means AS (SELECT band, avg(v) AS m FROM vals GROUP BY band)
          SELECT "row", col, {_r("sum((v - m) * (v - m))")} AS energy FROM vals JOIN means USING (band) GROUP BY "row", col""",
        "pca_roundtrip": same,
        "mnf_denoise_full": same,
        "envi_roundtrip": same,
        "envi_integers": _sql_long("list_transform(s, lambda x: round(x * 100))"),
        "parquet_roundtrip": same,
        "zarr_roundtrip": same,
        "zarr_window": f"""WITH {_CUBE}, {_VALUES} SELECT CAST("row" - 2 AS INTEGER) AS "row", CAST(col - 3 AS INTEGER) AS col, CAST(band - 5 AS INTEGER) AS band, true AS valid, {_r("v")} AS value
          FROM vals WHERE "row" BETWEEN 2 AND 9 AND col BETWEEN 3 AND 17 AND band BETWEEN 5 AND 20""",
        "zarr_layouts": f"SELECT * FROM ({codes}), (SELECT unnest([{', '.join(repr(a + ' ' + k) for a in ('bsq', 'bil', 'bip') for k in ZARR_TYPES)}]) AS kind)",
        "zarr_shape": f"SELECT count(DISTINCT vec_id // {WIDTH}) AS d0, count(DISTINCT vec_id % {WIDTH}) AS d1, 3::BIGINT AS d2 FROM embeddings",
        "zarr_paths": f'SELECT "row", col, band, 9.5::DOUBLE AS fwhm, CASE WHEN value = 100 THEN value ELSE 2 * value - 1 END AS value FROM ({codes})',
        "envi_types": f"SELECT * FROM ({codes}), (SELECT CAST(unnest([{', '.join(str(10 * c + o) for c in ENVI_TYPES for o in (0, 1))}]) AS INTEGER) AS kind)",
        "pca_three": _sql_axes(_PCA_MATRIX),
        "pca_truncated": _sql_one_axis(_PCA_MATRIX, "v[{i}]", "1"),
        "mnf_three": _sql_axes(_MNF_MATRIX),
        "mnf_denoise_truncated": _sql_one_axis(_MNF_MATRIX, "(n1{i}*v[1] + nx{i}*v[2] + n{i}3*v[3])", "v[1]*(n11*v[1]+n12*v[2]+n13*v[3]) + v[2]*(n12*v[1]+n22*v[2]+n23*v[3]) + v[3]*(n13*v[1]+n23*v[2]+n33*v[3])").replace("nx1", "n12").replace("nx2", "n22").replace("nx3", "n23"),
        "eigen_residuals": f"SELECT m AS method, CAST(i AS INTEGER) AS component, 0::DOUBLE AS residual, 0::DOUBLE AS skew, true AS ordered FROM (SELECT unnest(['pca', 'mnf']) AS m), range({BANDS}) AS t(i)",
        "zarr_scaled": _sql_long(f"list_transform(s, lambda x: CASE WHEN x = {NODATA} THEN x ELSE x * 0.5 + 1 END)", True, whole=False),
    }
