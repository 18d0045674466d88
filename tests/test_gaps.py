"""Scenes that lack some pixels of their raster: the last line ends early, others have gaps."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import lumenframe as lf

GONE = {37, 38, 79, 120, 199}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """280 pixels in lines of 25, without those in GONE."""
    folder = tmp_path_factory.mktemp("gaps")
    ids = [i for i in range(280) if i not in GONE]
    vectors = np.random.default_rng(5).uniform(-0.5, 0.5, (len(ids), 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(list(vectors), pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())}), folder / "embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["envi_integers", "envi_roundtrip", "zarr_roundtrip", "zarr_scaled", "zarr_window", "envi_types", "zarr_layouts", "zarr_paths"])
def test_only_pixels_of_the_scene_come_back(spark, tables, name):
    frame = entry.queries()[name](spark, str(tables))
    columns = sorted(frame.columns)
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tables}/embeddings.parquet')")
        found = duck.execute(entry.oracle_sql()[name])
        at = [[d[0] for d in found.description].index(c) for c in columns]
        want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == want


@pytest.mark.parametrize("nodata", [None, -9999.0])
def test_filled(spark, tmp_path, nodata):
    data = np.arange(24.0).reshape(3, 2, 4)
    whole = lf.SpectralCube(data, [500.0, 600.0, 700.0], nodata=nodata)
    cube = whole.with_frame(whole.frame.where("row * 4 + col NOT IN (2, 7)"))
    want = data.copy()
    want[:, [0, 1], [2, 3]] = np.nan if nodata is None else nodata
    full = cube.filled()
    assert full.frame.count() == 8 and full.shape == cube.shape and full.nodata == nodata
    np.testing.assert_array_equal(full.data(), want)
    lf.write_envi(full, tmp_path / "x.img")
    np.testing.assert_array_equal(lf.read_envi(tmp_path / "x.hdr").data(), want)
    lf.write_zarr(full, tmp_path / "x.zarr")
    np.testing.assert_array_equal(lf.read_zarr(tmp_path / "x.zarr").data(), want)
    assert whole.filled().frame.count() == 8
