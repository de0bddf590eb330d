"""Named arrays in files of NumPy's format, read slab by slab: spark.read.format("array_slabs").load(folder).

A file (.npy), or a member of an archive (.npz), is an array; a slab is a run of entries of its first axis, and one row. Partitions are runs of slabs, so a large
array is read by many tasks, each of which maps or streams only its part. Comparisons of z with a constant are pushed down: slabs outside are not read.
The folder must be one that all executors see.
"""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from glob import glob
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "file string, name string, z int, nz int, nx int, ny int, shape array<int>, values array<double>"
FIELDS = pa.schema([("file", pa.string()), ("name", pa.string()), ("z", pa.int32()), ("nz", pa.int32()), ("nx", pa.int32()), ("ny", pa.int32()), ("shape", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
#: Bytes of a partition's part of an array.
PARTITION_BYTES = 32 << 20


def local(path: str) -> str:
    return re.sub(r"^file:/*", "/", path)


@dataclass
class Part(InputPartition):
    file: str
    name: str
    lo: int
    hi: int


def _header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(f)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)


def arrays_of(path: str) -> list[tuple[str, tuple[int, ...], np.dtype]]:
    """(name, shape, type) of a file's arrays, from their headers."""
    if path.endswith(".npy"):
        with open(path, "rb") as f:
            shape, _, kind = _header(f)
        return [(os.path.basename(path)[:-4], shape, kind)]
    with zipfile.ZipFile(path) as z:
        out = []
        for member in sorted(n for n in z.namelist() if n.endswith(".npy")):
            with z.open(member) as f:
                shape, _, kind = _header(f)
            out.append((member[:-4], shape, kind))
        return out


def entries(path: str, name: str, lo: int, hi: int, step: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first entry, slab) of the array's entries from lo to hi - 1, step at a time."""
    if path.endswith(".npy"):
        a = np.load(path, mmap_mode="r", allow_pickle=False)
        for z in range(lo, hi, step):
            yield z, np.asarray(a[z : min(z + step, hi)])
        return
    with zipfile.ZipFile(path) as archive, archive.open(f"{name}.npy") as f:
        shape, by_column, kind = _header(f)
        if by_column:  # its first axis is spread over all of it
            f.seek(0)
            a = np.lib.format.read_array(f, allow_pickle=False)
            for z in range(lo, hi, step):
                yield z, a[z : min(z + step, hi)]
            return
        each = prod(shape[1:]) * kind.itemsize
        f.seek(f.tell() + lo * each)
        for z in range(lo, hi, step):
            n = min(z + step, hi) - z
            yield z, np.frombuffer(f.read(n * each), kind).reshape(n, *shape[1:])


class SlabReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.slab = local(options["path"]), int(options.get("slab", "1"))
        self.lo, self.hi = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute == ("z",) and isinstance(f.value, int):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    most = f.value + (not isinstance(f, LessThan))
                    self.hi = most if self.hi is None else min(self.hi, most)
            yield f  # slabs of several entries stay whole, so Spark compares rows again

    def partitions(self) -> list[Part]:
        files = sorted(glob(f"{self.path}/*.np[yz]")) if os.path.isdir(self.path) else sorted(glob(self.path))
        out = []
        for file in files:
            for name, shape, kind in arrays_of(file):
                n = shape[0] if shape else 1
                each = max(1, prod(shape[1:]) * kind.itemsize)
                run = max(self.slab, PARTITION_BYTES // each // self.slab * self.slab)
                # A slab's z is a multiple of slab: those from the last at or below lo on can meet the filter.
                first, last = -(-self.lo // self.slab) * self.slab, n if self.hi is None else min(n, self.hi)
                out += [Part(file, name, z, min(z + run, n if last == n else -(-last // self.slab) * self.slab, n)) for z in range(first, max(last, first), run)]
        return out or [Part("", "", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        shape = next(s for n, s, _ in arrays_of(partition.file) if n == partition.name)
        extent = (*shape[1:], 1, 1)
        nx, ny = extent[0], prod(shape[2:])
        for z, a in entries(partition.file, partition.name, partition.lo, partition.hi, self.slab):
            row = [[os.path.basename(partition.file)], [partition.name], [z], [a.shape[0] if a.ndim else 1], [nx], [ny], [list(shape)], [np.ascontiguousarray(a, np.float64).ravel()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, FIELDS, strict=True)], schema=FIELDS)


class ArraySlabs(DataSource):
    """Options: path, slab (entries of the first axis in a row; 1)."""

    @classmethod
    def name(cls) -> str:
        return "array_slabs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SlabReader:
        return SlabReader(self.options)


def slabs(spark: SparkSession, path: str, slab: int = 1):
    """The arrays under path as rows (file, name, z, nz, nx, ny, shape, values); a row holds slab entries of the first axis from z on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArraySlabs)
    return spark.read.format("array_slabs").option("slab", slab).load(path)
