"""NetCDF files as a Spark data source.

Each task reads one slab of one file and yields it as an Arrow batch of cells.
Classic files (CDF-1, CDF-2, CDF-5) are mapped with numpy. NetCDF-4 files, which
are HDF5, need the netCDF4 package on the executors. Paths must lie on a file
system that driver and executors mount alike.
"""

from __future__ import annotations

import glob
import json
import math
import os
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from itertools import product
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..axis import Axis
from ..cube import TIME, Cube
from .store import check_overlap, from_frame

SLAB_CELLS = 2_000_000

# The classic format's type codes, list tags and version bytes.
CLASSIC_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8",
                 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
CLASSIC_VERSIONS = (1, 2, 5)
# Microseconds per unit of a time coordinate.
TIME_UNITS = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000,
              "millisecond": 1_000, "microsecond": 1}
CALENDARS = ("standard", "gregorian", "proleptic_gregorian")


# -- one file ------------------------------------------------------------------

@dataclass
class Variable:
    dims: tuple[str, ...]
    attrs: Mapping[str, Any]
    data: Any  # sliced like an array; values as stored

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.data.dtype)

    @property
    def instant(self) -> bool:
        return " since " in str(self.attrs.get("units", ""))

    @property
    def packed(self) -> bool:
        return "scale_factor" in self.attrs or "add_offset" in self.attrs

    def spark_type(self) -> T.DataType:
        if self.instant:
            return T.TimestampNTZType()
        if self.packed:
            return T.DoubleType()
        kind, size = self.dtype.kind, self.dtype.itemsize
        if kind == "f":
            return T.FloatType() if size == 4 else T.DoubleType()
        return T.IntegerType() if size < 4 or (kind == "i" and size == 4) else T.LongType()

    def decoded(self, where: tuple[slice, ...]) -> np.ndarray | np.ma.MaskedArray:
        """Values of the slab: holes masked, packing undone, times as instants."""
        raw = np.asarray(self.data[where] if where else self.data[...])
        hole = np.zeros(raw.shape, bool)
        for name in ("_FillValue", "missing_value"):
            if name in self.attrs:
                hole |= np.isin(raw, np.asarray(self.attrs[name], dtype=raw.dtype))
        if raw.dtype.kind == "f":
            hole |= np.isnan(raw)
        if self.instant:
            values = instants(np.where(hole, 0, raw), self.attrs)
        elif self.packed:
            values = raw * np.float64(self.attrs.get("scale_factor", 1)) + np.float64(self.attrs.get("add_offset", 0))
        else:
            values = raw
        return np.ma.masked_array(values, hole)


def instants(values: np.ndarray, attrs: Mapping[str, Any]) -> np.ndarray:
    """Numbers counted in a unit since a moment, as microsecond instants."""
    calendar = str(attrs.get("calendar", "standard")).lower()
    if calendar not in CALENDARS:
        raise ValueError(f"calendar {calendar!r} is not supported")
    unit, since = str(attrs["units"]).split(" since ", 1)
    unit = unit.strip().lower().rstrip("s")
    if unit not in TIME_UNITS:
        raise ValueError(f"time unit {unit!r} is not supported")
    stamp = re.sub(r"\s*(UTC|Z)$", "", since.strip())
    start = datetime.fromisoformat(re.sub(r"-(\d)(?=[-\sT]|$)", r"-0\1", stamp))
    counted = values * np.int64(TIME_UNITS[unit]) if values.dtype.kind in "iu" else np.rint(
        values.astype("f8") * TIME_UNITS[unit])
    return np.datetime64(start, "us") + counted.astype("i8").astype("m8[us]")


def open_file(path: str) -> dict[str, Variable]:
    """The variables of one file, values left on disk."""
    with open(path, "rb") as f:
        magic = f.read(4)
    if magic[:3] == b"CDF" and magic[3] in CLASSIC_VERSIONS:
        return Classic(np.memmap(path, np.uint8, "r"), magic[3]).variables()
    try:
        import netCDF4
    except ImportError as absent:
        raise RuntimeError(f"{path} is not a classic NetCDF file; reading it needs the netCDF4 package") from absent
    ds = netCDF4.Dataset(path)
    ds.set_auto_maskandscale(False)
    return {n: Variable(v.dimensions, {a: v.getncattr(a) for a in v.ncattrs()}, v) for n, v in ds.variables.items()}


@dataclass
class Classic:
    """The header of a classic file, read front to back."""

    bytes: np.ndarray
    version: int
    at: int = 4

    def number(self, dtype: str) -> int:
        size = np.dtype(dtype).itemsize
        self.at += size
        return int(self.bytes[self.at - size:self.at].view(dtype)[0])

    def count(self) -> int:
        return self.number(">i8" if self.version == 5 else ">i4")

    def padded(self, size: int) -> bytes:
        found = self.bytes[self.at:self.at + size].tobytes()
        self.at += -(-size // 4) * 4
        return found

    def name(self) -> str:
        return self.padded(self.count()).decode()

    def entries(self, tag: int) -> range:
        found, n = self.number(">i4"), self.count()
        if found not in (tag, 0):
            raise ValueError(f"damaged header: list tag {found} where {tag} belongs")
        return range(n)

    def attributes(self) -> dict[str, Any]:
        out = {}
        for _ in self.entries(ATTRIBUTES):
            name, dtype, n = self.name(), CLASSIC_TYPES[self.number(">i4")], self.count()
            raw = self.padded(n * np.dtype(dtype).itemsize)
            if dtype == "S1":
                out[name] = raw.decode().rstrip("\0")
            else:
                values = np.frombuffer(raw, dtype)
                out[name] = values[0] if n == 1 else values
        return out

    def variables(self) -> dict[str, Variable]:
        records = self.count()
        lengths = [(self.name(), self.count()) for _ in self.entries(DIMENSIONS)]
        self.attributes()
        found = []
        for _ in self.entries(VARIABLES):
            name = self.name()
            dims = [lengths[self.count()] for _ in range(self.count())]
            attrs, dtype = self.attributes(), np.dtype(CLASSIC_TYPES[self.number(">i4")])
            self.count()
            begin = self.number(">i4" if self.version == 1 else ">i8")
            found.append((name, dims, attrs, dtype, begin))
        # A dimension of length 0 is the record one: its variables lie interleaved,
        # each record padded to four bytes unless there is only one such variable.
        sizes = [dtype.itemsize * math.prod(n for _, n in dims[1:])
                 for _, dims, _, dtype, _ in found if dims and dims[0][1] == 0]
        step = sizes[0] if len(sizes) == 1 else sum(-(-s // 4) * 4 for s in sizes)
        if records == -1:
            # Left open by a writer that streamed: as many records as fit.
            first = min((begin for _, dims, _, _, begin in found if dims and dims[0][1] == 0), default=0)
            records = (len(self.bytes) - first) // step if step else 0
        out = {}
        for name, dims, attrs, dtype, begin in found:
            shape = [n for _, n in dims]
            strides = [dtype.itemsize * math.prod(shape[i + 1:]) for i in range(len(shape))]
            if dims and dims[0][1] == 0:
                shape[0], strides[0] = records, step
            data = np.ndarray(shape, dtype, self.bytes, begin, strides)
            out[name] = Variable(tuple(d for d, _ in dims), attrs, data)
        return out


# -- planning ------------------------------------------------------------------

@dataclass
class Slab(InputPartition):
    path: str
    ranges: tuple[tuple[int, int], ...]

    def __init__(self, path: str, ranges: tuple[tuple[int, int], ...]) -> None:
        super().__init__((path, ranges))
        self.path, self.ranges = path, ranges


def cut(ranges: Sequence[tuple[int, int]], most: int) -> Iterator[tuple[tuple[int, int], ...]]:
    """Boxes of at most `most` cells, or one cell, that together fill the ranges;
    outer dimensions are cut first, so that a box is contiguous in the file."""
    inner = 1
    pieces: list[list[tuple[int, int]]] = []
    for low, high in reversed(ranges):
        step = max(1, most // inner)
        pieces.insert(0, [(i, min(i + step, high)) for i in range(low, high, step)])
        inner *= min(step, max(high - low, 1))
    return product(*pieces)


def inside(values: np.ma.MaskedArray, low: Any, high: Any) -> np.ndarray:
    """Where an axis lies in a closed interval, an open end being None; bounds
    take the axis's own precision, as they do in a cube's selections."""
    wanted = ~np.ma.getmaskarray(values)
    for bound, compare in ((low, np.greater_equal), (high, np.less_equal)):
        if bound is not None:
            if values.dtype.kind == "M":
                bound = np.datetime64(bound, "us")
            elif values.dtype.kind == "f":
                bound = values.dtype.type(bound)
            wanted &= compare(np.ma.getdata(values), bound)
    return wanted


@dataclass
class Reader(DataSourceReader):
    """Cells of the box spanned by `bounds`, dimension to (low, high)."""

    paths: list[str]
    names: tuple[str, ...]
    dims: tuple[str, ...]
    schema: T.StructType
    slab_cells: int
    bounds: Mapping[str, tuple[Any, Any]]

    def partitions(self) -> list[Slab]:
        return [Slab(p, box) for p in self.paths for box in cut(self._ranges(open_file(p)), self.slab_cells)]

    def _ranges(self, found: Mapping[str, Variable]) -> list[tuple[int, int]]:
        ranges = []
        for dim, size in zip(self.dims, found[self.names[0]].data.shape):
            low, high = self.bounds.get(dim, (None, None))
            where = np.arange(size)
            if (low, high) != (None, None):
                where = np.flatnonzero(inside(coordinate(found, dim, size), low, high))
            ranges.append((int(where[0]), int(where[-1]) + 1) if len(where) else (0, 0))
        return ranges

    def read(self, partition: Slab | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no slab at all: nothing lies within the bounds
            return
        found = open_file(partition.path)
        box = tuple(slice(a, b) for a, b in partition.ranges)
        shape = [b - a for a, b in partition.ranges]
        whole = found[self.names[0]].data.shape
        columns = []
        for i, dim in enumerate(self.dims):
            along = [1] * len(shape)
            along[i] = -1
            axis = coordinate(found, dim, whole[i])[box[i]].reshape(along)
            columns.append(np.ma.masked_array(np.broadcast_to(np.ma.getdata(axis), shape),
                                              np.broadcast_to(np.ma.getmaskarray(axis), shape)))
        columns += [found[n].decoded(box) for n in self.names]
        yield batch(columns, self.schema)


def coordinate(found: Mapping[str, Variable], dim: str, size: int) -> np.ma.MaskedArray:
    """Values of a dimension's coordinate variable, or positions without one."""
    if dim in found and found[dim].dims == (dim,):
        return found[dim].decoded((slice(None),))
    return np.ma.masked_array(np.arange(size, dtype="i4"))


def batch(columns: Sequence[np.ma.MaskedArray], schema: T.StructType) -> pa.RecordBatch:
    arrow = {T.TimestampNTZType: pa.timestamp("us"), T.FloatType: pa.float32(), T.DoubleType: pa.float64(),
             T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.StringType: pa.string()}
    arrays = []
    for values, wanted in zip(columns, schema.fields):
        data = np.ma.getdata(values).ravel()
        data = data.astype(data.dtype.newbyteorder("="))
        kind = arrow[type(wanted.dataType)]
        arrays.append(pa.array(data, mask=np.ma.getmaskarray(values).ravel()).cast(kind))
    return pa.RecordBatch.from_arrays(arrays, [f.name for f in schema.fields])


@dataclass
class AxisReader(DataSourceReader):
    """One coordinate of every file, with the file it is from."""

    paths: list[str]
    dim: str
    sizes_of: str
    schema: T.StructType

    def partitions(self) -> list[Slab]:
        return [Slab(p, ()) for p in self.paths]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        found = open_file(partition.path)
        like = found[self.sizes_of]
        values = coordinate(found, self.dim, like.data.shape[like.dims.index(self.dim)])
        yield batch([values, np.ma.masked_array(np.full(len(values), partition.path))], self.schema)


class NetCDFSource(DataSource):
    """Options: path (file, directory, glob, or several with commas), variables
    (comma separated; default all on the largest set of dimensions), slab_cells,
    bounds (JSON, dimension to [low, high], either of them null) and axis, to read
    one coordinate alone.

    Bounds are an option and not pushed filters: Spark 4.1 keeps what was pushed
    with the loaded source, and a later query on the same frame without the filter
    would silently get the narrowed rows.
    """

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _paths(self) -> list[str]:
        found: list[str] = []
        for part in self.options["path"].removeprefix("file:").split(","):
            part = os.path.join(part, "*.nc") if os.path.isdir(part) else part
            found += sorted(glob.glob(part))
        if not found:
            raise FileNotFoundError(f"no NetCDF file at {self.options['path']}")
        return found

    def _names(self, found: Mapping[str, Variable]) -> tuple[str, ...]:
        if asked := self.options.get("variables"):
            names = tuple(n.strip() for n in asked.split(","))
            if unknown := [n for n in names if n not in found]:
                raise KeyError(f"no variable {unknown}; there are {sorted(found)}")
        else:
            data = {n: v for n, v in found.items() if v.dims and v.dims != (n,) and v.dtype.kind in "iuf"}
            most = max((v.dims for v in data.values()), key=len, default=None)
            names = tuple(n for n, v in data.items() if v.dims == most)
        if not names or any(found[n].dims != found[names[0]].dims for n in names):
            raise ValueError(f"variables {names} do not share one set of dimensions")
        return names

    def schema(self) -> T.StructType:
        found = open_file(self._paths()[0])
        names = self._names(found)
        dims = (self.options["axis"],) if "axis" in self.options else found[names[0]].dims
        fields = [T.StructField(d, self._type(found, d), metadata=self._notes(found, d)) for d in dims]
        if "axis" in self.options:
            return T.StructType([*fields, T.StructField("file", T.StringType())])
        return T.StructType([*fields, *[T.StructField(n, found[n].spark_type()) for n in names]])

    def _type(self, found: Mapping[str, Variable], dim: str) -> T.DataType:
        own = dim in found and found[dim].dims == (dim,)
        return found[dim].spark_type() if own else T.IntegerType()

    def _notes(self, found: Mapping[str, Variable], dim: str) -> dict[str, bool]:
        """That a column is a dimension, and whether its values go down."""
        down = False
        if dim in found and found[dim].dims == (dim,) and len(found[dim].data) > 1:
            first, last = found[dim].decoded((slice(None),))[[0, -1]]
            down = bool(last < first)
        return {"dimension": True, "descending": down}

    def reader(self, schema: T.StructType) -> DataSourceReader:
        paths = self._paths()
        found = open_file(paths[0])
        names = self._names(found)
        if "axis" in self.options:
            return AxisReader(paths, self.options["axis"], names[0], schema)
        cells = int(self.options.get("slab_cells", SLAB_CELLS))
        bounds = json.loads(self.options.get("bounds", "{}"))
        return Reader(paths, names, found[names[0]].dims, schema, cells, bounds)


# -- cubes ---------------------------------------------------------------------

def open_netcdf(
    spark: SparkSession,
    path: str | Sequence[str],
    data_vars: Sequence[str] | None = None,
    rename: Mapping[str, str] | None = None,
    along: str = TIME,
    check: bool = True,
    bounds: Mapping[str, tuple[Any, Any]] | None = None,
) -> Cube:
    """One file or many, by path or glob, as one lazy cube.

    The axes come from the coordinate variables alone. Several files must each
    cover their own stretch of the `along` axis, or ValueError. Of a large file
    only the closed intervals in `bounds` are read; selections made on the cube
    later filter what was read.
    """
    spark.dataSource.register(NetCDFSource)
    names, bounds = dict(rename or {}), dict(bounds or {})
    back = {new: old for old, new in names.items()}
    options = {"path": path if isinstance(path, str) else ",".join(path)}
    if data_vars is not None:
        options["variables"] = ",".join(back.get(v, v) for v in data_vars)
    box = json.dumps({back.get(d, d): ends for d, ends in bounds.items()})
    cells = spark.read.format("netcdf").options(**options, bounds=box).load()
    dims = [f.name for f in cells.schema if f.metadata.get("dimension")]
    sources = {d: spark.read.format("netcdf").options(**options, axis=d).load() for d in dims}
    if check:
        old = back.get(along, along)
        if old in sources:
            ends = F.min(old).alias("first"), F.max(old).alias("last")
            check_overlap(sources[old].groupBy(F.col("file").alias("slab")).agg(*ends), along)
    axes = {names.get(d, d): Axis(f.select(d).withColumnRenamed(d, names.get(d, d))) for d, f in sources.items()}
    return from_frame(cells, list(axes), data_vars, names, axes).sel_range(**bounds)
