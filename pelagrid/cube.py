"""The cube: a DataFrame with one row per grid cell, and the names that give it shape.

Every method returns a new cube or a DataFrame and leaves the work to Spark.
The few that must look at an axis first (position, nearest level, label check)
run a small job on that axis alone and bring back one or two values per axis.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .axis import Axis
from .functions.values import clean
from .operators import limits, reduce, select

if TYPE_CHECKING:
    import pyarrow as pa

TIME = "time"


@dataclass(frozen=True, repr=False, eq=False)
class Cube:
    """Named variables over shared dimensions.

    frame      one row per cell: a column per dimension and per variable
    dims       dimension names, in order
    data_vars  variable names
    axes       per dimension, the coordinate values of the source, narrowed only
               by selections on that dimension. Positions count along this axis,
               so a hole in the data moves nothing.
    year       partition column equal to year(time), where the source has one
    """

    frame: DataFrame
    dims: tuple[str, ...]
    data_vars: tuple[str, ...]
    axes: Mapping[str, Axis]
    year: str | None = None

    @classmethod
    def of(
        cls,
        frame: DataFrame,
        dims: Sequence[str],
        data_vars: Sequence[str] | None = None,
        axes: Mapping[str, Axis] | None = None,
        year: str | None = None,
        descending: Sequence[str] = (),
    ) -> Cube:
        """Cube over a frame, NaN turned into NULL; axes not given are read off its columns.
        Along `descending` dimensions positions start at the largest value."""
        dims = tuple(dims)
        names = data_vars if data_vars is not None else [
            c for c in frame.columns if c not in dims and c != year
        ]
        missing = [c for c in (*dims, *names) if c not in frame.columns]
        if missing:
            raise KeyError(f"no column {missing} among {frame.columns}")
        kept = frame.select(
            *dims, *[clean(F.col(v), frame.schema[v].dataType).alias(v) for v in names], *([year] if year else []))
        given = dict(axes or {})
        known = {d: given.get(d) or Axis.of(frame.select(d), d in descending) for d in dims}
        return cls(kept, dims, tuple(names), known, year)

    def __str__(self) -> str:
        """Dimensions and variables with their types; `info` adds axis lengths."""
        dims = ", ".join(f"{d}: {self.dtype(d).simpleString()}" for d in self.dims)
        data = ", ".join(f"{v}: {self.dtype(v).simpleString()}" for v in self.data_vars)
        return f"Cube({dims}) of {data or 'nothing'}"

    __repr__ = __str__

    # -- shape ---------------------------------------------------------------

    def dtype(self, name: str) -> T.DataType:
        return self.frame.schema[name].dataType

    def axis(self, dim: str) -> DataFrame:
        """The coordinate values of one dimension, each once, in order."""
        select.require_dims(self, dim)
        return self.axes[dim].values.orderBy(self.axes[dim].order)

    def positions(self, dim: str) -> DataFrame:
        """The axis with 0-based positions, as columns `dim` and `position`."""
        return select.positions(self, dim)

    def info(self) -> DataFrame:
        """One row per dimension and variable: kind, name, dtype, and axis length."""
        rows = [
            self.axes[d].size().select(
                F.lit("dim").alias("kind"), F.lit(d).alias("name"),
                F.lit(self.dtype(d).simpleString()).alias("dtype"), F.col("n").alias("size"))
            for d in self.dims
        ]
        if self.data_vars:
            spark = self.frame.sparkSession
            rows.append(spark.createDataFrame(
                [("var", v, self.dtype(v).simpleString(), None) for v in self.data_vars],
                "kind string, name string, dtype string, size bigint"))
        out = rows[0]
        for more in rows[1:]:
            out = out.unionByName(more)
        return out

    # -- picking variables and dimensions ------------------------------------

    def pick(self, *names: str) -> Cube:
        """Only the named variables."""
        unknown = [n for n in names if n not in self.data_vars]
        if unknown:
            raise KeyError(f"no variable {unknown}; there are {list(self.data_vars)}")
        frame = self.frame.select(*self.dims, *names, *([self.year] if self.year else []))
        return replace(self, frame=frame, data_vars=names)

    def rename(self, names: Mapping[str, str]) -> Cube:
        """Rename dimensions or variables, such as lat/lon to latitude/longitude."""
        unknown = [n for n in names if n not in (*self.dims, *self.data_vars)]
        if unknown:
            raise KeyError(f"nothing named {unknown}")
        new = {c: names.get(c, c) for c in (*self.dims, *self.data_vars)}
        if len(set(new.values())) < len(new):
            raise ValueError(f"renaming {dict(names)} makes two columns of one name")
        return Cube(
            self.frame.withColumnsRenamed(dict(names)),
            tuple(new[d] for d in self.dims),
            tuple(new[v] for v in self.data_vars),
            {new[d]: self.axes[d].renamed(new[d]) if new[d] != d else self.axes[d] for d in self.dims},
            self.year,
        )

    def drop_dims(self, *dims: str, keep: Sequence[str] = ()) -> Cube:
        """Without the dimensions and the variables that depend on them. `keep`
        names the variables that do not, their value repeating along `dims`."""
        return select.drop_dims(self, dims, keep)

    def squeeze(self) -> Cube:
        """Without dimensions whose axis has a single value (runs an axis job)."""
        return select.squeeze(self)

    # -- selection -----------------------------------------------------------

    def isel(self, **where: int | slice) -> Cube:
        """By 0-based position: an int drops the dimension, a slice is half-open
        and keeps it. Positions count along what is left of each axis (runs an
        axis job)."""
        return select.isel(self, where)

    def sel(self, strict: bool = True, **where: Any) -> Cube:
        """By exact label, dropping the dimension. A label not on the axis raises
        KeyError; `strict=False` skips that check and its job."""
        return select.sel(self, where, strict)

    def sel_nearest(self, drop: bool = False, **where: float) -> Cube:
        """The axis value nearest to each number (runs an axis job)."""
        return select.sel_nearest(self, where, drop)

    def sel_range(self, **bounds: tuple[Any, Any]) -> Cube:
        """Closed interval per dimension; None leaves an end open."""
        return select.sel_range(self, bounds)

    def sel_time(self, start: str | None, end: str | None) -> Cube:
        """Closed time interval from ISO text."""
        return select.sel_range(self, {TIME: (start, end)})

    # -- reduction -----------------------------------------------------------

    def mean(self, *dims: str) -> Cube:
        """Mean of every variable along the dimensions, skipping missing cells."""
        return reduce.mean(self, dims)

    def group_mean(self, part: str) -> Cube:
        """Climatology: mean over all times that share a month or a season."""
        return reduce.group_mean(self, part)

    def extents(self, *names: str) -> DataFrame:
        """Smallest and largest value of the named columns, in one row."""
        return limits.extents(self, names)

    def robust_limits(self, var: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
        """Exact percentiles of a variable over the whole cube (runs jobs)."""
        return limits.robust_limits(self, var, low, high)

    # -- output --------------------------------------------------------------

    def table(self) -> DataFrame:
        """The cells as a table, ordered by the dimensions."""
        return self.frame.select(*self.dims, *self.data_vars).orderBy(*[self.axes[d].order for d in self.dims])

    def values(self, most: int = 1_000_000) -> pa.Table:
        """The ordered cells as an Arrow table in the driver. For small results:
        more than `most` cells raise instead of being cut."""
        found = self.table().limit(most + 1).toArrow()
        if found.num_rows > most:
            raise ValueError(f"there are over {most} cells; reduce or select before taking values")
        return found
