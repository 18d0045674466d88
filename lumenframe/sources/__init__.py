"""Readers and writers of spectral cubes."""

from lumenframe.sources.envi import EnviHeader, parse_header, read_envi, write_envi
from lumenframe.sources.parquet import read_parquet, write_parquet
from lumenframe.sources.zarr import read_zarr, read_zarr_window, read_zarr_with_options, write_zarr, zarr_cube_shape

__all__ = ["EnviHeader", "parse_header", "read_envi", "read_parquet", "read_zarr", "read_zarr_window", "read_zarr_with_options", "write_envi", "write_parquet", "write_zarr", "zarr_cube_shape"]
