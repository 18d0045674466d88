"""ENVI files: a text header beside a raw binary. Readers and writers work by position, so the file must be where all executors see it.

Reading cuts the image into blocks of lines, one per task, of which a task maps only its own bytes. Writing makes a file of the full
size beside the target, lets every task write its pixels where they belong (a task that runs twice writes the same bytes twice),
and renames data and header at the end.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumenframe.cube import SpectralCube, session
from lumenframe.errors import CubeIOError, FormatError, InvalidInput
from lumenframe.plans.kernels import PIXELS, lists_of, spectra_of

# The format's codes of data types.
TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}
NAMES = {"u8": 1, "i16": 2, "i32": 3, "f32": 4, "f64": 5, "u16": 12, "u32": 13, "i64": 14, "u64": 15}
DATA_SUFFIXES = (".dat", ".img", ".bsq", ".bil", ".bip", ".raw")
INTERLEAVES = ("bsq", "bil", "bip")

#: Values that one task reads, about, and pixels of one batch that it gives.
BLOCK_VALUES = 4 << 20
BATCH_PIXELS = 8_192


@dataclass
class EnviHeader:
    samples: int = 0
    lines: int = 0
    bands: int = 0
    interleave: str = ""
    wavelengths: list[float] | None = None
    fwhm: list[float] | None = None
    data_ignore_value: float | None = None
    data_type: int = 0
    big_endian: bool = False
    header_offset: int = 0
    seen: set[str] = field(default_factory=set)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype((">" if self.big_endian else "<") + TYPES[self.data_type])

    def strides(self) -> tuple[int, int, int]:
        """Values from one band, line and sample to the next."""
        b, n, s = self.bands, self.lines, self.samples
        return {"bsq": (n * s, s, 1), "bil": (s, b * s, 1), "bip": (1, s * b, b)}[self.interleave]


def _entries(text: str) -> Iterator[tuple[str, str]]:
    lines = iter(text.splitlines())
    for line in lines:
        line = line.strip()
        if not line or line.startswith(";") or "=" not in line:
            continue
        key, _, value = line.partition("=")
        value = value.strip()
        if value.startswith("{"):
            while "}" not in value:
                more = next(lines, None)
                if more is None:
                    raise FormatError(f"the list of {key.strip()!r} is not closed")
                if not more.strip().startswith(";"):
                    value += " " + more.strip()
            value = value[1 : value.index("}")]
        yield key.strip().lower(), value


def _number(key: str, value: str, kind=float):
    try:
        return kind(value.strip())
    except ValueError as e:
        raise FormatError(f"{key} is not a number: {value!r}") from e


def parse_header(text: str) -> EnviHeader:
    text = text.lstrip("﻿").strip()
    if not text.startswith("ENVI"):
        raise FormatError("an ENVI header starts with ENVI")
    h = EnviHeader()
    for key, value in _entries(text):
        h.seen.add(key)
        if key in ("samples", "lines", "bands"):
            n = _number(key, value, int)
            if n < 0:
                raise FormatError(f"{key} is negative")
            setattr(h, key, n)
        elif key == "data type":
            h.data_type = _number(key, value, int)
            if h.data_type not in TYPES:
                raise FormatError(f"data type {h.data_type} is not supported")
        elif key == "interleave":
            h.interleave = value.strip().lower()
            if h.interleave not in INTERLEAVES:
                raise FormatError(f"interleave {value!r} is not bsq, bil or bip")
        elif key == "byte order":
            order = _number(key, value, int)
            if order not in (0, 1):
                raise FormatError(f"byte order {order} is neither 0 nor 1")
            h.big_endian = order == 1
        elif key == "header offset":
            h.header_offset = _number(key, value, int)
            if h.header_offset < 0:
                raise FormatError("header offset is negative")
        elif key == "data ignore value":
            h.data_ignore_value = _number(key, value)
        elif key == "wavelength":
            h.wavelengths = [_number(key, v) for v in value.split(",")]
        elif key == "fwhm":
            h.fwhm = [_number(key, v) for v in value.split(",")]
    for key in ("samples", "lines", "bands", "data type", "interleave"):
        if key not in h.seen:
            raise FormatError(f"the header lacks {key!r}")
    for name, values in (("wavelength", h.wavelengths), ("fwhm", h.fwhm)):
        if values is not None and len(values) != h.bands:
            raise FormatError(f"the header has {len(values)} values of {name} for {h.bands} bands")
    return h


def resolve_pair(path: str | os.PathLike) -> tuple[Path, Path]:
    """Header and data file, from the path of either."""
    path = Path(path)
    if path.suffix.lower() == ".hdr":
        base = path.with_suffix("")
        for data in (base, *(base.with_name(base.name + s) for s in DATA_SUFFIXES)):
            if data.is_file():
                return path, data
        raise CubeIOError(f"no data file beside {path}")
    for header in (path.with_suffix(".hdr"), path.with_name(path.name + ".hdr")):
        if header.is_file():
            return header, path
    raise CubeIOError(f"no header beside {path}")


def output_pair(path: str | os.PathLike) -> tuple[Path, Path]:
    path = Path(path)
    return (path, path.with_suffix("")) if path.suffix.lower() == ".hdr" else (path.with_suffix(".hdr"), path)


def _block_reader(data: str, h: EnviHeader, lines: int):
    dtype, offset = h.dtype, h.header_offset
    shape = {"bsq": (h.bands, h.lines, h.samples), "bil": (h.lines, h.bands, h.samples), "bip": (h.lines, h.samples, h.bands)}[h.interleave]
    order = {"bsq": (1, 2, 0), "bil": (0, 2, 1), "bip": (0, 1, 2)}[h.interleave]
    samples, total, bands = h.samples, h.lines, h.bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("id").to_pylist():
                mapped = np.memmap(data, dtype, "r", offset, shape).transpose(order)
                first, last = block * lines, min(total, (block + 1) * lines)
                pixels = np.ascontiguousarray(mapped[first:last]).reshape(-1, bands)
                for i in range(0, len(pixels), BATCH_PIXELS):
                    part = pixels[i : i + BATCH_PIXELS]
                    at = first * samples + i + np.arange(len(part))
                    yield pa.RecordBatch.from_arrays([pa.array((at // samples).astype(np.int32)), pa.array((at % samples).astype(np.int32)), lists_of(part.astype(np.float64))], names=["row", "col", "spectrum"])

    return run


def read_envi(path: str | os.PathLike, spark: SparkSession | None = None) -> SpectralCube:
    """A cube over an ENVI file, from the path of its header or its data. Without wavelengths the bands are numbered from 1."""
    spark = spark or session()
    header, data = resolve_pair(path)
    try:
        h = parse_header(header.read_text(encoding="utf-8", errors="replace"))
    except OSError as e:
        raise CubeIOError(f"cannot read {header}: {e}") from e
    need, have = h.bands * h.lines * h.samples * h.dtype.itemsize, data.stat().st_size
    if h.header_offset > have:
        raise FormatError(f"the header offset {h.header_offset} exceeds the {have} bytes of {data}")
    if have - h.header_offset < need:
        raise FormatError(f"{data} has {have - h.header_offset} bytes of data; {need} are needed")
    wavelengths = h.wavelengths if h.wavelengths is not None else [float(i) for i in range(1, h.bands + 1)]
    lines = max(1, min(h.lines or 1, BLOCK_VALUES // max(1, h.samples * h.bands)))
    blocks = max(1, -(-h.lines // lines))
    frame = spark.range(0, blocks, 1, blocks).mapInArrow(_block_reader(str(data.resolve()), h, lines), PIXELS)
    return SpectralCube(frame, wavelengths, h.fwhm, h.data_ignore_value, height=h.lines, width=h.samples)


def _plain(value: float) -> str:
    return np.format_float_positional(value, trim="-")


def round_half_away(x: np.ndarray) -> np.ndarray:
    whole = np.trunc(x)
    return np.where(np.abs(x - whole) >= 0.5, whole + np.sign(x), whole)


def _limits(kind: np.dtype) -> tuple[float, float]:
    info = np.iinfo(kind)
    return float(info.min), float(info.max)


def _saturated(x: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Whole numbers as integers; the float next above the greatest 64-bit number becomes that number."""
    info = np.iinfo(kind)
    low, high = float(info.min), float(info.max)
    out = np.where((x > low) & (x < high), x, 0).astype(kind)
    out[x <= low] = info.min
    out[x >= high] = info.max
    return out


def _output_nodata(nodata: float | None, kind: np.dtype, name: str, force: bool) -> float | None:
    if nodata is None or kind.kind == "f":
        return nodata
    low, high = _limits(kind)
    if force:
        return float(round_half_away(np.array(min(max(nodata, low), high))))
    if not low <= nodata <= high:
        raise InvalidInput(f"nodata {nodata} is out of range for {name}; force=True clamps it")
    if nodata != math.floor(nodata):
        raise InvalidInput(f"nodata {nodata} is fractional and cannot be {name}; force=True rounds it")
    return nodata


def _strictly(cube: SpectralCube, kind: np.dtype, name: str) -> None:
    """Refuse values that an integer type cannot hold, before anything is written; one pass."""
    low, high = _limits(kind)
    height, width = cube.height, cube.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = spectra_of(batch.column("spectrum"))
            if not x.size:
                continue
            kinds = np.where(np.isnan(x), 1, np.where((x < low) | (x > high), 2, np.where(x != np.floor(x), 3, 0)))
            pixel, band = np.nonzero(kinds)
            if len(pixel):
                at = band * height * width + batch.column("row").to_numpy().astype(np.int64)[pixel] * width + batch.column("col").to_numpy()[pixel]
                i = at.argmin()
                yield pa.RecordBatch.from_arrays([pa.array([at[i]]), pa.array([int(kinds[pixel[i], band[i]])], pa.int32()), pa.array([float(x[pixel[i], band[i]])])], names=["at", "kind", "value"])

    first = cube.frame.mapInArrow(run, "at long, kind int, value double").agg(F.min(F.struct("at", "kind", "value")).alias("f")).first().f
    if first is not None:
        why = {1: "is NaN", 2: "is out of range", 3: "is fractional"}[first.kind]
        raise InvalidInput(f"value {first.value} at index {first['at']} {why} and cannot be {name}; force=True converts it")


def _position_writer(temp: str, h: EnviHeader, nodata: float | None):
    kind = h.dtype
    band_step, line_step, sample_step = h.strides()
    bands = h.bands

    def converted(x: np.ndarray) -> np.ndarray:
        if kind.kind == "f":
            with np.errstate(over="ignore"):
                return x.astype(kind)
        x = np.where(np.isnan(x), 0.0 if nodata is None else nodata, x)
        low, high = _limits(kind)
        return _saturated(round_half_away(np.clip(x, low, high)), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        with open(temp, "r+b") as out:
            for batch in batches:
                if not batch.num_rows:
                    continue
                y = converted(spectra_of(batch.column("spectrum")))
                row, col = (batch.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
                # Runs of pixels that are next to each other in one line.
                cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(col) != 1)) + 1
                for a, b in zip([0, *cut], [*cut, len(row)], strict=True):
                    base = row[a] * line_step + col[a] * sample_step
                    if band_step == 1:
                        out.seek(int(base) * kind.itemsize)
                        out.write(np.ascontiguousarray(y[a:b]).tobytes())
                    else:
                        for j in range(bands):
                            out.seek(int(base + j * band_step) * kind.itemsize)
                            out.write(np.ascontiguousarray(y[a:b, j]).tobytes())
                written += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([written])], names=["n"])

    return run


def _header_text(cube: SpectralCube, h: EnviHeader, nodata: float | None) -> str:
    listed = lambda values: "{\n" + ",\n".join("  " + _plain(v) for v in values) + "\n}"
    fields = {"samples": cube.width, "lines": cube.height, "bands": cube.bands, "data type": h.data_type, "interleave": h.interleave, "byte order": 0, "header offset": 0}
    if nodata is not None:
        fields["data ignore value"] = _plain(nodata)
    fields["wavelength"] = listed(cube.wavelengths())
    if cube.fwhm() is not None:
        fields["fwhm"] = listed(cube.fwhm())
    return "ENVI\n" + "".join(f"{k} = {v}\n" for k, v in fields.items())


def write_envi(cube: SpectralCube, path: str | os.PathLike, data_type: str | None = None, interleave: str | None = None, force: bool = False) -> None:
    """Write header and data. data_type: f64 (the default), f32, or u8 ... u64, i16 ... i64; integers take only values that they can
    hold, unless force rounds them (half away from zero), clamps them, and writes NaN as nodata, or 0 without one."""
    name, order = data_type or "f64", interleave or "bsq"
    if name not in NAMES:
        raise InvalidInput(f"unknown data type {name!r}")
    if order not in INTERLEAVES:
        raise InvalidInput(f"unknown interleave {order!r}")
    h = EnviHeader(cube.width, cube.height, cube.bands, order, data_type=NAMES[name])
    nodata = _output_nodata(cube.nodata, h.dtype, name, force)
    if h.dtype.kind != "f" and not force:
        _strictly(cube, h.dtype, name)
    header, data = output_pair(path)
    mark = uuid.uuid4().hex
    temp, temp_header = data.with_name(f".{data.name}.{mark}"), header.with_name(f".{header.name}.{mark}")
    try:
        with open(temp, "wb") as f:
            f.truncate(cube.bands * cube.height * cube.width * h.dtype.itemsize)
        parts = cube.frame.rdd.getNumPartitions()
        ordered = cube.frame.repartitionByRange(parts, "row", "col").sortWithinPartitions("row", "col")
        written = ordered.mapInArrow(_position_writer(str(temp.resolve()), h, nodata), "n long").agg(F.sum("n")).first()[0] or 0
        if written != cube.height * cube.width:
            raise CubeIOError(f"the frame has {written} pixels; {cube.height * cube.width} are needed")
        temp_header.write_text(_header_text(cube, h, nodata), encoding="utf-8")
        os.replace(temp, data)
        os.replace(temp_header, header)
    except OSError as e:
        raise CubeIOError(f"cannot write {data}: {e}") from e
    finally:
        for left in (temp, temp_header):
            left.unlink(missing_ok=True)
