"""The cube: validation, access, selection."""

import numpy as np
import pytest

import lumenframe as lf
from lumenframe.errors import DimensionMismatch, EmptyCube, InvalidInput, InvalidWavelength

WL = np.array([450.0, 550.0, 650.0])


def coded(bands=3, height=2, width=4, **more):
    b, r, c = np.meshgrid(range(bands), range(height), range(width), indexing="ij")
    return lf.SpectralCube((b * 100 + r * 10 + c).astype(float), 450.0 + 100 * np.arange(bands), **more)


@pytest.fixture(autouse=True)
def _session(spark):
    return spark


@pytest.mark.parametrize(
    "data,wl,more,error,text",
    [
        (np.zeros((0, 2, 2)), [], {}, EmptyCube, "needs"),
        (np.zeros((3, 0, 2)), WL, {}, EmptyCube, "needs"),
        (np.zeros((3, 2, 2)), [1.0, 2.0], {}, DimensionMismatch, "wavelengths length"),
        (np.zeros((3, 2, 2)), [3.0, 2.0, 1.0], {}, InvalidWavelength, "strictly increasing"),
        (np.zeros((3, 2, 2)), [1.0, 1.0, 2.0], {}, InvalidWavelength, "strictly increasing"),
        (np.zeros((3, 2, 2)), [-1.0, 1.0, 2.0], {}, InvalidWavelength, "positive"),
        (np.zeros((3, 2, 2)), [1.0, np.nan, 2.0], {}, InvalidWavelength, "finite"),
        (np.zeros((3, 2, 2)), WL, {"fwhm": [1.0]}, DimensionMismatch, "fwhm length"),
        (np.zeros((3, 2, 2)), WL, {"fwhm": [1.0, 0.0, 1.0]}, InvalidInput, "fwhm"),
        (np.zeros((3, 2, 2)), WL, {"nodata": np.inf}, InvalidInput, "nodata must be finite"),
        (np.zeros((3, 2)), WL, {}, InvalidInput, "three dimensions"),
    ],
)
def test_validation(data, wl, more, error, text):
    with pytest.raises(error, match=text):
        lf.SpectralCube(data, wl, **more)
    assert issubclass(error, ValueError)


def test_access():
    cube = coded(fwhm=[10.0, 12.0, 11.0], nodata=-9999.0)
    assert cube.shape == (3, 2, 4) and (cube.bands, cube.height, cube.width) == (3, 2, 4)
    np.testing.assert_array_equal(cube.data()[2], [[200, 201, 202, 203], [210, 211, 212, 213]])
    np.testing.assert_array_equal(cube.spectrum(1, 3), [13, 113, 213])
    np.testing.assert_array_equal(cube.band(1), cube.data()[1])
    np.testing.assert_array_equal(cube.band_at(550), cube.data()[1])
    np.testing.assert_array_equal(cube.band_nearest(601), cube.data()[2])
    assert cube.wavelength(2) == 650 and cube.wavelength_index(450) == 0
    assert [cube.nearest_band_index(x) for x in (1, 450, 500, 501, 600, 9e9)] == [0, 0, 0, 1, 1, 2]
    np.testing.assert_allclose(cube.mean_spectrum(), [6.5, 106.5, 206.5])
    assert repr(cube) == "SpectralCube(bands=3, height=2, width=4)"
    assert [tuple(r) for r in cube.bands_frame().collect()] == [(0, 450.0, 10.0), (1, 550.0, 12.0), (2, 650.0, 11.0)]
    assert isinstance(lf.__version__, str)


def test_lookups_that_fail():
    cube = coded()
    for bad in ((2, 0), (0, 4), (-1, 0)):
        with pytest.raises(ValueError, match="out of bounds"):
            cube.spectrum(*bad)
    with pytest.raises(ValueError, match="out of bounds"):
        cube.band(3)
    with pytest.raises(ValueError, match="out of bounds"):
        cube.wavelength(-1)
    with pytest.raises(ValueError, match="no band at exactly"):
        cube.band_at(551)
    for look in (cube.nearest_band_index, cube.wavelength_index, cube.band_at, cube.band_nearest):
        with pytest.raises(InvalidWavelength, match="finite"):
            look(float("nan"))


def test_selection():
    cube = coded(4, fwhm=[1.0, 2.0, 3.0, 4.0], nodata=-1.0)
    picked = cube.sel_bands([0, 2, 3])
    np.testing.assert_array_equal(picked.data(), cube.data()[[0, 2, 3]])
    np.testing.assert_array_equal(picked.fwhm(), [1, 3, 4])
    assert picked.nodata == -1.0
    ranged = cube.sel_wavelengths(550, 650)
    np.testing.assert_array_equal(ranged.wavelengths(), [550, 650])
    np.testing.assert_array_equal(ranged.data(), cube.data()[1:3])
    for bad, text in (([], "non-empty"), ([0, 4], "out of range"), ([2, 1], "strictly increasing"), ([1, 1], "strictly increasing")):
        with pytest.raises(ValueError, match=text):
            cube.sel_bands(bad)
    with pytest.raises(ValueError, match="no bands"):
        cube.sel_wavelengths(1, 2)
    with pytest.raises(ValueError, match="min_nm"):
        cube.sel_wavelengths(600, 500)
    with pytest.raises(ValueError, match="no bands"):
        cube.sel_wavelengths(float("nan"), 500)


def test_mean_skips_what_does_not_count():
    cube = lf.SpectralCube(np.array([[[1.0, -9999.0], [3.0, np.nan]]]), [500.0], nodata=-9999.0)
    np.testing.assert_allclose(cube.mean_spectrum(), [2.0])
    none = lf.SpectralCube(np.full((1, 1, 2), np.nan), [500.0])
    assert np.isnan(none.mean_spectrum()).all()


def test_cube_over_a_frame(spark):
    frame = spark.createDataFrame([(0, 0, [1.0, 2.0]), (1, 0, [3.0, 4.0])], "row int, col int, spectrum array<double>")
    cube = lf.SpectralCube(frame, [1.0, 2.0])
    assert cube.shape == (2, 2, 1)
    np.testing.assert_array_equal(cube.data(), [[[1], [3]], [[2], [4]]])
    with pytest.raises(DimensionMismatch):
        lf.SpectralCube(frame, [1.0, 2.0, 3.0])
    with pytest.raises(EmptyCube):
        lf.SpectralCube(frame.where("false"), [1.0, 2.0])


def test_streaming_pixels(spark, tmp_path):
    from lumenframe.streaming import stream_cube

    cube = coded()
    cube.frame.write.parquet(str(tmp_path / "in"))
    pixels = spark.readStream.schema(cube.frame.schema).parquet(str(tmp_path / "in"))
    live = stream_cube(pixels, cube.wavelengths(), 2, 4)
    result = lf.sam(lf.savitzky_golay(live, 3, 1), [1.0, 2.0, 3.0])
    query = result.frame.writeStream.format("memory").queryName("angles").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.row, r.col): r.value for r in spark.table("angles").collect()}
    want = np.asarray(lf.sam(lf.savitzky_golay(cube, 3, 1), [1.0, 2.0, 3.0]))
    assert all(abs(got[r, c] - want[r, c]) < 1e-12 for r in range(2) for c in range(4))
