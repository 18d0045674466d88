"""Zarr version 3 stores on a file system that all executors see: JSON metadata and one file per chunk, plain or gzipped.

Reading gives each task a stripe of pixels with all their bands. Where a chunk holds more pixels than a stripe should, chunks are
decoded once each and their parts shuffled to the stripes. Writing shuffles pixels to the chunks that they belong to; a task holds one
chunk at a time. Either way no task needs more than a chunk or a stripe.
"""

from __future__ import annotations

import gzip
import json
import math
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.cube import SpectralCube, session
from lumenframe.errors import CubeIOError, FormatError, InvalidInput
from lumenframe.functions.validity import invalid_mask
from lumenframe.plans.kernels import PIXELS, lists_of, map_spectra, spectra_of

# Names under which stores are known to keep their arrays, in small letters (stores use any), and the format's data types.
DATA_NAMES = {"reflectance", "reflectance_data", "radiance", "radiance_data"}
WAVELENGTH_NAMES = {"wavelengths", "wavelength", "wavelength_centers", "center_wavelengths"}
FWHM_NAMES = {"fwhm"}
TYPES = {"float64": "f8", "float32": "f4", "uint8": "u1", "uint16": "u2", "uint32": "u4", "uint64": "u8", "int8": "i1", "int16": "i2", "int32": "i4", "int64": "i8"}

#: Values of one stripe, about.
STRIPE_VALUES = 4 << 20
#: Values that one task reads, about, where chunks are smaller.
TASK_VALUES = 16 << 20
#: Values of a chunk of one band image that is written as it is; larger images are cut into square tiles of at most that size.
CHUNK_VALUES = 8 << 20
BATCH_PIXELS = 8_192


@dataclass(frozen=True)
class ZarrArray:
    """One array of a store, by its metadata."""

    path: str  # in the store
    folder: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    fill: float
    gzipped: bool
    separator: str
    prefix: bool
    attributes: dict

    def chunk_file(self, index: tuple[int, ...]) -> str:
        parts = [*(["c"] if self.prefix else []), *map(str, index)]
        return os.path.join(self.folder, self.separator.join(parts) if parts else "0")

    def chunk(self, index: tuple[int, ...]) -> np.ndarray:
        """A whole chunk as doubles; one without a file is all fill value."""
        try:
            with open(self.chunk_file(index), "rb") as f:
                raw = f.read()
        except FileNotFoundError:
            return np.full(self.chunks, self.fill)
        except OSError as e:
            raise CubeIOError(f"cannot read a chunk of {self.path}: {e}") from e
        try:
            raw = gzip.decompress(raw) if self.gzipped else raw
            return np.frombuffer(raw, self.dtype).reshape(self.chunks).astype(np.float64)
        except (OSError, EOFError, ValueError) as e:
            raise FormatError(f"chunk {index} of {self.path} is damaged: {e}") from e


def _fill(value) -> float:
    if isinstance(value, str):
        known = {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}
        if value in known:
            return known[value]
        if value.startswith("0x"):
            raw = bytes.fromhex(value[2:])
            return float(np.frombuffer(raw[::-1], {4: "<f4", 8: "<f8"}[len(raw)])[0])
        raise FormatError(f"fill value {value!r} is not supported")
    return float(value or 0)


def _metadata(folder: Path) -> dict | None:
    try:
        return json.loads((folder / "zarr.json").read_text(encoding="utf-8"))
    except FileNotFoundError:
        return None
    except (OSError, ValueError) as e:
        raise FormatError(f"cannot read the metadata of {folder}: {e}") from e


def open_array(store: Path, path: str) -> ZarrArray:
    path = "/" + path.strip("/")
    folder = store / path.strip("/")
    meta = _metadata(folder)
    if meta is None or meta.get("node_type") != "array":
        raise FormatError(f"{store} has no array {path}")
    if meta.get("zarr_format") != 3:
        raise FormatError("only version 3 of Zarr is supported")
    kind = meta.get("data_type")
    if kind not in TYPES:
        raise FormatError(f"data type {kind!r} of {path} is not supported")
    grid, keys = meta.get("chunk_grid", {}), meta.get("chunk_key_encoding", {"name": "default"})
    if grid.get("name") != "regular" or keys.get("name") not in ("default", "v2"):
        raise FormatError(f"the chunk grid or keys of {path} are not supported")
    order, gzipped = "<", False
    for i, codec in enumerate(meta.get("codecs", [])):
        codec = {"name": codec} if isinstance(codec, str) else codec
        if codec["name"] == "bytes" and i == 0:
            order = ">" if codec.get("configuration", {}).get("endian") == "big" else "<"
        elif codec["name"] == "gzip" and i == 1:
            gzipped = True
        else:
            raise FormatError(f"codec {codec['name']!r} of {path} is not supported")
    default = keys["name"] == "default"
    return ZarrArray(
        path,
        str(folder),
        tuple(meta["shape"]),
        tuple(grid["configuration"]["chunk_shape"]),
        order + TYPES[kind],
        _fill(meta.get("fill_value")),
        gzipped,
        keys.get("configuration", {}).get("separator", "/" if default else "."),
        default,
        meta.get("attributes") or {},
    )


def _number(attributes: dict, *names: str) -> float | None:
    for name in names:
        value = attributes.get(name)
        if isinstance(value, int | float) and not isinstance(value, bool):
            return float(value)
    return None


@dataclass(frozen=True)
class Layout:
    data: ZarrArray
    wavelengths: ZarrArray
    fwhm: ZarrArray | None
    nodata: float | None
    scale: float | None
    offset: float | None


def _store(path) -> Path:
    store = Path(path)
    if not store.is_dir():
        raise CubeIOError(f"{store} is no Zarr store")
    return store.resolve()


def _arrays(store: Path) -> list[tuple[str, int]]:
    """Paths and ranks of all arrays, in order."""
    out = []
    for at, folders, files in os.walk(store):
        folders.sort()
        if "zarr.json" in files:
            meta = _metadata(Path(at))
            if meta and meta.get("node_type") == "array":
                folders.clear()
                out.append((os.path.relpath(at, store), len(meta.get("shape", []))))
    return sorted(out)


def discover(store: Path) -> Layout:
    """The cube's arrays by their names; a cube of another name if it is the first with three dimensions."""
    found = _arrays(store)
    leaf = lambda p: p.rsplit("/", 1)[-1].lower()
    cubes, lines = [p for p, rank in found if rank == 3], [p for p, rank in found if rank == 1]
    if not cubes:
        raise FormatError(f"{store} has no array of three dimensions")
    named = [p for p in cubes if leaf(p) in DATA_NAMES]
    wave = [p for p in lines if leaf(p) in WAVELENGTH_NAMES]
    if not wave:
        raise FormatError(f"{store} has no array of wavelengths")
    wide = [p for p in lines if leaf(p) in FWHM_NAMES]
    data = open_array(store, (named or cubes)[0])
    a = data.attributes
    return Layout(
        data, open_array(store, wave[0]), open_array(store, wide[0]) if wide else None, _number(a, "_FillValue", "Data_Ignore_Value"), _number(a, "scale_factor", "Scale_Factor"), _number(a, "add_offset")
    )


def _line(array: ZarrArray) -> list[float]:
    if len(array.shape) != 1:
        raise FormatError(f"{array.path} must have one dimension")
    n, step = array.shape[0], array.chunks[0]
    parts = [array.chunk((i,)) for i in range(-(-n // step))]
    return list(np.concatenate(parts)[:n]) if parts else []


def _axes(shape: tuple[int, ...], bands: int, path) -> tuple[int, int, int]:
    """Which axes are bands, rows and columns, by the number of wavelengths."""
    if len(shape) != 3:
        raise FormatError(f"the data array of {path} must have three dimensions")
    fits = [i for i in range(3) if shape[i] == bands]
    if len(fits) > 1:
        raise FormatError(f"ambiguous orientation: several axes of {shape} have the length {bands} of the wavelengths")
    if not fits:
        raise FormatError(f"no axis of {shape} has the length {bands} of the wavelengths")
    return {0: (0, 1, 2), 1: (1, 0, 2), 2: (2, 0, 1)}[fits[0]]


def _pixels(top: int, left: int, block: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A (bands, rows, columns) block as batches of pixels."""
    height, width = block.shape[1:]
    flat = block.reshape(len(block), -1).T
    for i in range(0, height * width, BATCH_PIXELS):
        part = np.ascontiguousarray(flat[i : i + BATCH_PIXELS])
        at = i + np.arange(len(part))
        yield pa.RecordBatch.from_arrays([pa.array((top + at // width).astype(np.int32)), pa.array((left + at % width).astype(np.int32)), lists_of(part)], names=["row", "col", "spectrum"])


def _scan(spark: SparkSession, array: ZarrArray, axes: tuple[int, int, int], window: tuple[slice, slice, slice]) -> DataFrame:
    """Pixels of a window, numbered from its corner. Only chunks that it touches are opened."""
    bands, rows, cols = window
    steps = [array.chunks[a] for a in axes]
    grid = [range(w.start // s, -(-w.stop // s)) for w, s in zip(window, steps, strict=True)]
    n_bands, width = bands.stop - bands.start, min(steps[2], cols.stop - cols.start)
    stripe = max(1, STRIPE_VALUES // max(1, n_bands * width))

    def cut(index: tuple[int, int, int]) -> tuple[np.ndarray, list[slice]]:
        """The part of a chunk inside the window as (bands, rows, columns), and where it lies in the window."""
        on_disk = [0, 0, 0]
        for a, i in zip(axes, index, strict=True):
            on_disk[a] = i
        chunk = array.chunk(tuple(on_disk)).transpose(axes)
        inner, outer = [], []
        for i, s, w in zip(index, steps, window, strict=True):
            low, high = max(w.start, i * s), min(w.stop, (i + 1) * s)
            inner.append(slice(low - i * s, high - i * s))
            outer.append(slice(low - w.start, high - w.start))
        return chunk[tuple(inner)], outer

    def place(number: int, axes_: tuple[range, ...]) -> tuple[int, ...]:
        """The chunk of a number, counted with the last axis fastest: no list of all chunks is ever made."""
        out = []
        for axis in reversed(axes_):
            number, at = divmod(number, len(axis))
            out.append(axis[at])
        return tuple(reversed(out))

    def numbers(count: int, values: int) -> DataFrame:
        """The numbers of chunks, dealt to tasks that read about TASK_VALUES each."""
        tasks = max(1, min(count, max(spark.sparkContext.defaultParallelism, -(-count * values // TASK_VALUES))))
        return spark.range(0, count, 1, tasks)

    if stripe >= min(steps[1], rows.stop - rows.start):

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t in batch.column("id").to_pylist():
                    out, first = None, None
                    for b in grid[0]:
                        part, at = cut((b, *place(t, (grid[1], grid[2]))))
                        if out is None:
                            out, first = np.empty((n_bands, *part.shape[1:])), at
                        out[at[0]] = part
                    if out is not None:
                        yield from _pixels(first[1].start, first[2].start, out)

        return numbers(len(grid[1]) * len(grid[2]), n_bands * steps[1] * steps[2]).mapInArrow(read, PIXELS)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column("id").to_pylist():
                part, at = cut(place(c, tuple(grid)))
                top = at[1].start
                for r in range(top // stripe, -(-at[1].stop // stripe)):
                    low, high = max(top, r * stripe), min(at[1].stop, (r + 1) * stripe)
                    piece = np.ascontiguousarray(part[:, low - top : high - top])
                    values = [[r], [at[2].start], [low], [high], [at[2].stop], [at[0].start], [piece.tobytes()]]
                    kinds = [pa.int32()] * 6 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["stripe", "left", "top", "bottom", "right", "band", "block"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = None, None
        for batch in batches:
            for r in batch.to_pylist():
                own = (r["stripe"], r["left"], r["top"])
                if own != key:
                    if out is not None:
                        yield from _pixels(key[2], key[1], out)
                    key, out = own, np.full((n_bands, r["bottom"] - r["top"], r["right"] - r["left"]), np.nan)
                piece = np.frombuffer(r["block"]).reshape(-1, *out.shape[1:])
                out[r["band"] : r["band"] + len(piece)] = piece
        if out is not None:
            yield from _pixels(key[2], key[1], out)

    pieces = numbers(math.prod(len(g) for g in grid), math.prod(steps)).mapInArrow(split, "stripe int, left int, top int, bottom int, right int, band int, block binary")
    return pieces.repartition("stripe", "left", "top").sortWithinPartitions("stripe", "left", "top", "band").mapInArrow(join, PIXELS)


def _scaled(frame: DataFrame, scale: float | None, offset: float | None, nodata: float | None) -> DataFrame:
    if scale is None and offset is None:
        return frame
    by, plus = 1.0 if scale is None else scale, 0.0 if offset is None else offset
    return map_spectra(frame, lambda x: np.where(invalid_mask(x, nodata), x, x * by + plus))


def _cube(spark: SparkSession, path, layout: Layout) -> SpectralCube:
    wavelengths = _line(layout.wavelengths)
    fwhm = None if layout.fwhm is None else _line(layout.fwhm)
    shape = layout.data.shape
    axes = _axes(shape, len(wavelengths), path)
    bands, height, width = (shape[a] for a in axes)
    frame = _scan(spark, layout.data, axes, (slice(0, bands), slice(0, height), slice(0, width)))
    return SpectralCube(_scaled(frame, layout.scale, layout.offset, layout.nodata), wavelengths, fwhm, layout.nodata, height=height, width=width)


def read_zarr(path, data_path=None, wavelength_path=None, fwhm_path=None, nodata=None, scale_factor=None, add_offset=None, spark: SparkSession | None = None) -> SpectralCube:
    """A cube over a store. Without paths the arrays are found by their names, with the scale that the store gives; what is passed
    here wins. With data_path and wavelength_path (both or neither) the store's own scale is not applied."""
    spark, store = spark or session(), _store(path)
    if (data_path is None) != (wavelength_path is None):
        raise InvalidInput("data_path and wavelength_path must be provided together")
    if data_path is not None:
        data = open_array(store, data_path)
        layout = Layout(data, open_array(store, wavelength_path), None, _number(data.attributes, "_FillValue", "Data_Ignore_Value"), None, None)
    else:
        layout = discover(store)
    changes = {"fwhm": None if fwhm_path is None else open_array(store, fwhm_path), "nodata": nodata, "scale": scale_factor, "offset": add_offset}
    return _cube(spark, path, replace(layout, **{k: v for k, v in changes.items() if v is not None}))


def read_zarr_with_options(path, data_path, wavelength_path, fwhm_path=None, nodata=None, scale_factor=None, add_offset=None, spark: SparkSession | None = None) -> SpectralCube:
    """read_zarr with the paths given."""
    return read_zarr(path, data_path, wavelength_path, fwhm_path, nodata, scale_factor, add_offset, spark)


def zarr_cube_shape(path) -> tuple[int, int, int]:
    """The shape of the store's data array as it stands on disk; reads no data."""
    return discover(_store(path)).data.shape


def read_zarr_window(path, bands: tuple[int, int], rows: tuple[int, int], cols: tuple[int, int], spark: SparkSession | None = None) -> SpectralCube:
    """Bands, rows and columns from the first to before the last, as stored: no scale is applied. The store's first axis must be
    its bands."""
    spark, store = spark or session(), _store(path)
    layout = discover(store)
    wavelengths = _line(layout.wavelengths)
    if layout.data.shape[0] != len(wavelengths):
        raise FormatError(f"a window needs the bands on the first axis of {layout.data.shape}")
    window = []
    for name, (low, high), n in zip(("bands", "rows", "cols"), (bands, rows, cols), layout.data.shape, strict=True):
        if not 0 <= low < high <= n:
            raise InvalidInput(f"{name} {low} to {high} are out of bounds for {n}")
        window.append(slice(int(low), int(high)))
    frame = _scan(spark, layout.data, (0, 1, 2), tuple(window))
    fwhm = None if layout.fwhm is None else _line(layout.fwhm)[window[0]]
    return SpectralCube(frame, wavelengths[window[0]], fwhm, layout.nodata, height=window[1].stop - window[1].start, width=window[2].stop - window[2].start)


def _array_json(shape, chunks, names, compression: str, level: int, attributes: dict) -> dict:
    codecs: list[dict] = [{"name": "bytes", "configuration": {"endian": "little"}}]
    if compression == "gzip":
        codecs.append({"name": "gzip", "configuration": {"level": level}})
    return {
        "zarr_format": 3,
        "node_type": "array",
        "shape": list(shape),
        "data_type": "float64",
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "fill_value": 0.0,
        "codecs": codecs,
        "attributes": attributes,
        "dimension_names": names,
        "storage_transformers": [],
    }


def _put(path: Path, raw: bytes) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    temp = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    temp.write_bytes(raw)
    os.replace(temp, path)


def _put_json(folder: Path, content: dict) -> None:
    _put(folder / "zarr.json", json.dumps(content, indent=2).encode())


def _chunk_writer(folder: str, shape: tuple[int, int, int], chunks: tuple[int, int, int], compression: str, level: int):
    def put(key: tuple[int, int, int], block: np.ndarray) -> None:
        raw = np.ascontiguousarray(block, "<f8").tobytes()
        _put(Path(folder, "c", *map(str, key)), gzip.compress(raw, level, mtime=0) if compression == "gzip" else raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, n = None, None, 0
        for batch in batches:
            for r in batch.to_pylist():
                own = (r["b"], r["i"], r["j"])
                if own != key:
                    if block is not None:
                        put(key, block)
                    key, block = own, np.zeros(chunks)
                at = np.frombuffer(r["at"], np.int32)
                values = np.frombuffer(r["values"]).reshape(-1, len(at))
                block.reshape(chunks[0], -1)[: len(values), at] = values
                n += values.size
        if block is not None:
            put(key, block)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return run


def _chunk_parts(shape: tuple[int, int, int], chunks: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = spectra_of(batch.column("spectrum"))
            row, col = (batch.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
            tile = (row // chunks[1]) * (-(-shape[2] // chunks[2])) + col // chunks[2]
            out: list[list] = [[], [], [], [], []]
            for t in np.unique(tile):
                own = np.flatnonzero(tile == t)
                at = ((row[own] % chunks[1]) * chunks[2] + col[own] % chunks[2]).astype(np.int32).tobytes()
                for b in range(-(-shape[0] // chunks[0])):
                    values = np.ascontiguousarray(x[own, b * chunks[0] : (b + 1) * chunks[0]].T).tobytes()
                    for column, v in zip(out, (b, int(row[own[0]] // chunks[1]), int(col[own[0]] // chunks[2]), at, values), strict=True):
                        column.append(v)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["b", "i", "j", "at", "values"])

    return run


def _default_chunks(cube: SpectralCube) -> tuple[int, int, int]:
    if cube.height * cube.width <= CHUNK_VALUES:
        return 1, cube.height, cube.width
    side = math.isqrt(CHUNK_VALUES)
    return 1, min(cube.height, side), min(cube.width, side)


def write_zarr(cube: SpectralCube, path, compression: str = "gzip", gzip_level: int = 5, chunk_shape: tuple[int, int, int] | None = None, overwrite: bool = False) -> None:
    """Write a store with /reflectance (bands, lines, samples), /sensor/wavelengths and, if there are any, /sensor/fwhm. A chunk is
    one band by default, or a square tile of one where a band's image has over CHUNK_VALUES values. An existing folder is replaced only with overwrite, a file never."""
    target = Path(path).absolute()
    if compression not in ("gzip", "none"):
        raise InvalidInput(f"unknown compression {compression!r}: it must be 'gzip' or 'none'")
    if not 0 <= gzip_level <= 9:
        raise InvalidInput(f"gzip level {gzip_level} is not from 0 to 9")
    chunks = _default_chunks(cube) if chunk_shape is None else tuple(int(c) for c in chunk_shape)
    if len(chunks) != 3 or any(not 0 < c <= n for c, n in zip(chunks, cube.shape, strict=False)):
        raise InvalidInput(f"chunk shape {chunks} must have three sizes from 1 to those of the cube, {cube.shape}")
    if target.exists() and not target.is_dir():
        raise CubeIOError(f"{target} is a file")
    if target.exists() and not overwrite:
        raise CubeIOError(f"{target} exists; overwrite=True replaces it")
    temp = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    try:
        data = temp / "reflectance"
        data.mkdir(parents=True)
        parts = cube.frame.mapInArrow(_chunk_parts(cube.shape, chunks), "b int, i int, j int, at binary, values binary")
        dealt = parts.repartition("b", "i", "j").sortWithinPartitions("b", "i", "j")
        written = dealt.mapInArrow(_chunk_writer(str(data), cube.shape, chunks, compression, gzip_level), "n long").agg(F.sum("n")).first()[0] or 0
        if written != math.prod(cube.shape):
            raise CubeIOError(f"the frame has {written} values; {math.prod(cube.shape)} are needed")
        attributes: dict = {"wavelength_units": "nanometers"}
        if cube.nodata is not None:
            attributes["_FillValue"] = cube.nodata
        _put_json(temp, {"zarr_format": 3, "node_type": "group", "attributes": {"layout": "bands, lines, samples"}})
        _put_json(data, _array_json(cube.shape, chunks, ["bands", "lines", "samples"], compression, gzip_level, attributes))
        _put_json(temp / "sensor", {"zarr_format": 3, "node_type": "group", "attributes": {}})
        for name, values in (("wavelengths", cube.wavelengths()), ("fwhm", cube.fwhm())):
            if values is not None:
                _put_json(temp / "sensor" / name, _array_json((cube.bands,), (cube.bands,), ["bands"], "none", 0, {}))
                _put(temp / "sensor" / name / "c" / "0", values.astype("<f8").tobytes())
        if target.exists():
            shutil.rmtree(target)
        os.replace(temp, target)
    except OSError as e:
        raise CubeIOError(f"cannot write {target}: {e}") from e
    finally:
        shutil.rmtree(temp, ignore_errors=True)
