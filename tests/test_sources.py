"""ENVI and Zarr: round trips, foreign files, windows, and what is refused."""

import gzip
import json
import time

import numpy as np
import pytest

import lumenframe as lf
from lumenframe.sources import envi, zarr
from lumenframe.sources.envi import parse_header, round_half_away

RNG = np.random.default_rng(3)


@pytest.fixture(autouse=True)
def _session(spark):
    return spark


def some_cube(shape=(3, 4, 5), **more):
    return lf.SpectralCube(RNG.normal(0, 50, shape), 450.0 + 50 * np.arange(shape[0]), **more)


HEADER = "ENVI\nsamples = 4\nlines = 3\nbands = 2\ndata type = {code}\ninterleave = {order}\nbyte order = {endian}\nheader offset = {offset}\n; a comment\nSome Key = ignored\nwavelength = {{ 500,\n 600 }}\n"


@pytest.mark.parametrize("order,axes", [("bsq", (0, 1, 2)), ("bil", (1, 0, 2)), ("bip", (1, 2, 0))])
@pytest.mark.parametrize("code,kind", [(1, "u1"), (2, "i2"), (3, "i4"), (4, "f4"), (5, "f8"), (12, "u2"), (13, "u4"), (14, "i8"), (15, "u8")])
def test_envi_reads_every_type(tmp_path, monkeypatch, order, axes, code, kind):
    monkeypatch.setattr(envi, "BLOCK_VALUES", 8)
    data = RNG.integers(0, 100, (2, 3, 4)).astype(kind)
    endian = code % 2
    raw = data.transpose(axes).astype((">" if endian else "<") + kind).tobytes()
    (tmp_path / "a.img").write_bytes(b"junk" + raw + b"more")
    (tmp_path / "a.hdr").write_text(HEADER.format(code=code, order=order, endian=endian, offset=4))
    for path in ("a.hdr", "a.img"):
        cube = lf.read_envi(str(tmp_path / path))
        np.testing.assert_array_equal(cube.data(), data)
        np.testing.assert_array_equal(cube.wavelengths(), [500, 600])


@pytest.mark.parametrize("order", ["bsq", "bil", "bip"])
@pytest.mark.parametrize("name", ["f64", "f32", "i16", "u8", "u16", "i32", "u32", "i64", "u64"])
def test_envi_round_trip(tmp_path, order, name):
    data = RNG.integers(0, 200, (3, 4, 5)).astype(float)
    cube = lf.SpectralCube(data, [450.0, 550.5, 650.0], fwhm=[10.0, 12.0, 11.0], nodata=199.0)
    lf.write_envi(cube, tmp_path / "x.dat", data_type=name, interleave=order)
    back = lf.read_envi(tmp_path / "x.hdr")
    np.testing.assert_array_equal(back.data(), data)
    np.testing.assert_array_equal(back.wavelengths(), [450, 550.5, 650])
    np.testing.assert_array_equal(back.fwhm(), [10, 12, 11])
    assert back.nodata == 199.0
    assert "450,\n  550.5" in (tmp_path / "x.hdr").read_text()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x.dat", "x.hdr"]


def test_envi_integer_rules(tmp_path):
    cube = lf.SpectralCube(np.array([[[1.2, 2.8]], [[3.5, 4.4]]]), [500.0, 600.0])
    with pytest.raises(ValueError, match="fractional"):
        lf.write_envi(cube, tmp_path / "c.bin", data_type="u8")
    assert not list(tmp_path.iterdir())
    lf.write_envi(cube, tmp_path / "c.bin", data_type="u8", force=True)
    np.testing.assert_array_equal(lf.read_envi(tmp_path / "c.bin").data(), [[[1, 3]], [[4, 4]]])
    wide = lf.SpectralCube(np.array([[[99999.0, -99999.0, 1.7, np.nan]]]), [500.0], nodata=-9999.0)
    with pytest.raises(ValueError, match="out of range"):
        lf.write_envi(wide, tmp_path / "w.bin", data_type="i16")
    lf.write_envi(wide, tmp_path / "w.bin", data_type="i16", force=True)
    np.testing.assert_array_equal(lf.read_envi(tmp_path / "w.bin").data(), [[[32767, -32768, 2, -9999]]])
    with pytest.raises(ValueError, match="NaN"):
        lf.write_envi(lf.SpectralCube(np.array([[[np.nan]]]), [500.0]), tmp_path / "n.bin", data_type="i16")
    for nodata, text in ((-1.0, "out of range"), (0.5, "fractional")):
        with pytest.raises(ValueError, match=text):
            lf.write_envi(lf.SpectralCube(np.ones((1, 1, 1)), [500.0], nodata=nodata), tmp_path / "n.bin", data_type="u8")
    big = lf.SpectralCube(np.array([[[2.0**63, -(2.0**63)]]]), [500.0])
    lf.write_envi(big, tmp_path / "b.bin", data_type="i64")
    np.testing.assert_array_equal(np.fromfile(tmp_path / "b.bin", "<i8"), [2**63 - 1, -(2**63)])
    np.testing.assert_array_equal(round_half_away(np.array([0.49999999999999994, 0.5, -0.5, 2.5, -2.5])), [0, 1, -1, 3, -3])
    for more in ({"data_type": "c64"}, {"interleave": "bsx"}):
        with pytest.raises(ValueError, match="unknown"):
            lf.write_envi(cube, tmp_path / "z.bin", **more)


@pytest.mark.parametrize(
    "change,text",
    [
        (("ENVI\n", "NVI\n"), "starts with ENVI"),
        (("samples = 4\n", ""), "lacks"),
        (("data type = 5", "data type = 6"), "not supported"),
        (("interleave = bsq", "interleave = bxx"), "interleave"),
        (("byte order = 0", "byte order = 2"), "byte order"),
        (("500,", "500, 550,"), "3 values"),
        (("600 }", "600, }"), "not a number"),
        (("600 }", "600"), "not closed"),
        (("lines = 3", "lines = three"), "not a number"),
    ],
)
def test_envi_headers_that_fail(change, text):
    good = HEADER.format(code=5, order="bsq", endian=0, offset=0)
    assert parse_header("﻿" + good).bands == 2
    with pytest.raises(ValueError, match=text):
        parse_header(good.replace(*change))


def test_envi_files_that_fail(tmp_path):
    with pytest.raises(ValueError, match="no header"):
        lf.read_envi(tmp_path / "none.img")
    (tmp_path / "a.hdr").write_text(HEADER.format(code=5, order="bsq", endian=0, offset=0))
    with pytest.raises(ValueError, match="no data file"):
        lf.read_envi(tmp_path / "a.hdr")
    (tmp_path / "a.raw").write_bytes(b"short")
    with pytest.raises(ValueError, match="needed"):
        lf.read_envi(tmp_path / "a.hdr")
    (tmp_path / "a.hdr").write_text(HEADER.format(code=5, order="bsq", endian=0, offset=99))
    with pytest.raises(ValueError, match="offset"):
        lf.read_envi(tmp_path / "a.hdr")


@pytest.mark.parametrize("chunks", [None, (2, 3, 2), (3, 4, 5), (1, 1, 1)])
@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("stripe", [1 << 22, 7])
def test_zarr_round_trip(tmp_path, monkeypatch, chunks, compression, stripe):
    monkeypatch.setattr(zarr, "STRIPE_VALUES", stripe)
    cube = some_cube(fwhm=[10.0, 11.0, 12.0], nodata=-9999.0)
    lf.write_zarr(cube, str(tmp_path / "s"), compression=compression, chunk_shape=chunks)
    back = lf.read_zarr(str(tmp_path / "s"))
    np.testing.assert_array_equal(back.data(), cube.data())
    np.testing.assert_array_equal(back.wavelengths(), cube.wavelengths())
    np.testing.assert_array_equal(back.fwhm(), cube.fwhm())
    assert back.nodata == -9999.0 and lf.zarr_cube_shape(tmp_path / "s") == (3, 4, 5)
    window = lf.read_zarr_window(tmp_path / "s", bands=(1, 3), rows=(1, 4), cols=(2, 5))
    np.testing.assert_array_equal(window.data(), cube.data()[1:3, 1:4, 2:5])
    np.testing.assert_array_equal(window.wavelengths(), cube.wavelengths()[1:3])
    np.testing.assert_array_equal(window.fwhm(), [11, 12])


def put_array(folder, data, kind="float64", chunks=None, attributes=None, codecs=None, raw=True):
    folder.mkdir(parents=True)
    meta = {
        "zarr_format": 3,
        "node_type": "array",
        "shape": list(data.shape),
        "data_type": kind,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks or data.shape)}},
        "chunk_key_encoding": {"name": "v2", "configuration": {"separator": "."}},
        "fill_value": "NaN" if kind.startswith("float") else 7,
        "codecs": codecs or [{"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip", "configuration": {"level": 1}}],
        "attributes": attributes or {},
    }
    (folder / "zarr.json").write_text(json.dumps(meta))
    if raw:
        (folder / ".".join("0" * data.ndim)).write_bytes(gzip.compress(data.astype(np.dtype(kind).newbyteorder(">")).tobytes()))


@pytest.mark.parametrize("axes", [(0, 1, 2), (1, 0, 2), (1, 2, 0)])
@pytest.mark.parametrize("kind", ["uint16", "float32", "int8", "uint64"])
def test_zarr_foreign_stores(tmp_path, axes, kind):
    data = RNG.integers(0, 100, (2, 3, 4))
    put_array(tmp_path / "g" / "Reflectance_Data", data.transpose(axes), kind, attributes={"Data_Ignore_Value": 5, "Scale_Factor": 0.5, "add_offset": 1})
    put_array(tmp_path / "m" / "Wavelength", np.array([500.0, 600.0]))
    put_array(tmp_path / "m" / "FWHM", np.array([5.0, 6.0]))
    back = lf.read_zarr(tmp_path)
    np.testing.assert_allclose(back.data(), np.where(data == 5, 5.0, data * 0.5 + 1))
    assert back.nodata == 5 and list(back.fwhm()) == [5, 6]
    plain = lf.read_zarr_with_options(tmp_path, "/g/Reflectance_Data", "/m/Wavelength")
    np.testing.assert_allclose(plain.data(), data)  # with paths given the store's own scale is left out
    assert plain.fwhm() is None
    mine = lf.read_zarr(tmp_path, scale_factor=2.0, add_offset=0.0, nodata=-1.0, fwhm_path="m/FWHM")
    np.testing.assert_allclose(mine.data(), data * 2.0)
    if axes != (0, 1, 2):
        with pytest.raises(ValueError, match="first axis"):
            lf.read_zarr_window(tmp_path, (0, 1), (0, 1), (0, 1))


def test_zarr_chunks_without_files_are_fill(tmp_path):
    put_array(tmp_path / "radiance", np.zeros((2, 3, 4)), "uint8", raw=False)
    put_array(tmp_path / "wavelengths", np.array([500.0, 600.0]))
    np.testing.assert_array_equal(lf.read_zarr(tmp_path).data(), 7)


def test_zarr_names_in_any_case(tmp_path):
    put_array(tmp_path / "aaa", np.zeros((2, 3, 4)), "uint8")
    put_array(tmp_path / "zzz" / "REFLECTANCE", np.ones((2, 3, 4)), "uint8")
    put_array(tmp_path / "WAVELENGTHS", np.array([500.0, 600.0]))
    np.testing.assert_array_equal(lf.read_zarr(tmp_path).data(), 1)


def test_zarr_of_a_million_chunks_is_planned_at_once(tmp_path):
    put_array(tmp_path / "radiance", np.zeros((1, 1000, 1000)), "uint8", raw=False, chunks=(1, 1, 1))
    put_array(tmp_path / "wavelengths", np.array([500.0]))
    lf.read_zarr(tmp_path)  # the session and its imports
    began = time.time()
    cube = lf.read_zarr(tmp_path)
    assert time.time() - began < 1 and cube.frame.rdd.getNumPartitions() < 100
    small = lf.read_zarr_window(tmp_path, (0, 1), (500, 503), (999, 1000))
    np.testing.assert_array_equal(small.data(), np.full((1, 3, 1), 7.0))


def test_zarr_writes_tiles_of_large_images(tmp_path, monkeypatch):
    data = RNG.random((2, 9, 11))
    lf.write_zarr(lf.SpectralCube(data, [500.0, 600.0]), tmp_path / "whole.zarr")
    assert zarr.open_array(tmp_path / "whole.zarr", "reflectance").chunks == (1, 9, 11)
    monkeypatch.setattr(zarr, "CHUNK_VALUES", 16)
    lf.write_zarr(lf.SpectralCube(data, [500.0, 600.0]), tmp_path / "tiles.zarr")
    assert zarr.open_array(tmp_path / "tiles.zarr", "reflectance").chunks == (1, 4, 4)
    np.testing.assert_array_equal(lf.read_zarr(tmp_path / "tiles.zarr").data(), data)


def test_envi_headers_after_empty_lines():
    text = "samples = 1\nlines = 1\nbands = 1\ndata type = 4\ninterleave = bsq\n"
    for head in ("\n\n  ENVI\n", "\ufeff\nENVI\n", "\ufeffENVI\r\n"):
        assert parse_header(head + text).samples == 1


def test_zarr_refuses(tmp_path):
    cube = some_cube()
    with pytest.raises(ValueError, match="no Zarr store"):
        lf.read_zarr(tmp_path / "none")
    lf.write_zarr(cube, tmp_path / "s", compression="none")
    with pytest.raises(ValueError, match="exists"):
        lf.write_zarr(cube, tmp_path / "s")
    lf.write_zarr(some_cube((2, 3, 4)), tmp_path / "s", overwrite=True)
    assert lf.zarr_cube_shape(tmp_path / "s") == (2, 3, 4)
    (tmp_path / "file").write_text("x")
    with pytest.raises(ValueError, match="is a file"):
        lf.write_zarr(cube, tmp_path / "file", overwrite=True)
    for more, text in (({"chunk_shape": (0, 1, 1)}, "chunk shape"), ({"chunk_shape": (4, 4, 5)}, "chunk shape"), ({"compression": "zip"}, "compression"), ({"gzip_level": 11}, "level")):
        with pytest.raises(ValueError, match=text):
            lf.write_zarr(cube, tmp_path / "t", **more)
    with pytest.raises(ValueError, match="provided together"):
        lf.read_zarr(tmp_path / "s", data_path="/reflectance")
    with pytest.raises(ValueError, match="has no array"):
        lf.read_zarr_with_options(tmp_path / "s", "/nothing", "/sensor/wavelengths")
    for bad in ((0, 3), (1, 1), (-1, 1)):
        with pytest.raises(ValueError, match="out of bounds"):
            lf.read_zarr_window(tmp_path / "s", bad, (0, 1), (0, 1))
    lf.write_zarr(some_cube((2, 2, 2)), tmp_path / "a")
    with pytest.raises(ValueError, match="ambiguous orientation"):
        lf.read_zarr(tmp_path / "a")
    assert lf.read_zarr_window(tmp_path / "a", (0, 2), (0, 1), (0, 2)).shape == (2, 1, 2)
    put_array(tmp_path / "b" / "radiance", np.zeros((2, 3, 4)), codecs=[{"name": "bytes"}, {"name": "blosc"}])
    put_array(tmp_path / "b" / "wavelength", np.array([500.0, 600.0]))
    with pytest.raises(ValueError, match="codec"):
        lf.read_zarr(tmp_path / "b")
    put_array(tmp_path / "c" / "radiance", np.zeros((2, 3, 4)))
    with pytest.raises(ValueError, match="no array of wavelengths"):
        lf.read_zarr(tmp_path / "c")


def test_parquet_round_trip(tmp_path, spark):
    for more in ({}, {"fwhm": [10.0, 11.0, 12.0], "nodata": -9999.0}):
        cube = some_cube(**more)
        lf.write_parquet(cube, tmp_path / "p", mode="overwrite")
        back = lf.read_parquet(tmp_path / "p")
        np.testing.assert_array_equal(back.data(), cube.data())
        np.testing.assert_array_equal(back.wavelengths(), cube.wavelengths())
        assert back.nodata == cube.nodata and back.shape == cube.shape
        assert (back.fwhm() is None) == (cube.fwhm() is None)
    plan = back.frame.where("row = 2")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(row,2)" in plan
    cube.frame.write.parquet(str(tmp_path / "q"))
    with pytest.raises(ValueError, match="no cube metadata"):
        lf.read_parquet(tmp_path / "q")
