"""Subset requests against a catalogue of data sets.

The same keywords open a lazy cube (`open_dataset`) or store a subset
(`subset`). A data set is any Spark-readable location; the selection travels as
filters and column choice into its scan.
"""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..cube import TIME, Cube
from ..dataset import Dataset
from ..functions.timeparts import in_year_requests, year_bounds
from ..operators.select import nearest
from . import netcdf, snapshot, store
from .snapshot import WHOLE

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Product:
    """Where a data set lies and how its columns map to dimensions and variables.

    `rename` maps source columns to cube names. With `login`, the user name and
    password found by `credentials` go to the reader as options. `own_dims` names the dimensions
    of variables that have not all of them, such as a surface height beside a salinity by depth;
    the data set is then a `Dataset`, and bounds on a dimension leave variables alone that lack it.
    """

    path: str
    dims: tuple[str, ...]
    data_vars: tuple[str, ...] | None = None
    rename: Mapping[str, str] = field(default_factory=dict)
    fmt: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)
    login: bool = False
    descending: tuple[str, ...] = ()
    own_dims: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class Catalog:
    products: Mapping[str, Product]

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        """Catalogue from a JSON object of data-set id to product fields."""
        entries = json.loads(text)
        return cls({name: Product(**{**p, "dims": tuple(p["dims"])}) for name, p in entries.items()})

    def product(self, dataset_id: str) -> Product:
        if dataset_id not in self.products:
            raise KeyError(f"no data set {dataset_id!r}; there are {sorted(self.products)}")
        return self.products[dataset_id]


@dataclass(frozen=True)
class Request:
    """What to take from a data set. Bounds are closed; those left out select
    everything. Equal depth bounds select the nearest single level."""

    dataset_id: str
    variables: Sequence[str] | None = None
    minimum_longitude: float | None = None
    maximum_longitude: float | None = None
    minimum_latitude: float | None = None
    maximum_latitude: float | None = None
    minimum_depth: float | None = None
    maximum_depth: float | None = None
    start_datetime: str | None = None
    end_datetime: str | None = None

    def for_year(self, year: int) -> Request:
        start, end = year_bounds(year)
        return replace(self, start_datetime=start, end_datetime=end)

    def default_name(self) -> str:
        """Name of the stored subset when none is given: the whole request, so that
        different requests have different names."""
        parts = [self.dataset_id, *(self.variables or ())]
        for unit, low, high in (
            ("E", self.minimum_longitude, self.maximum_longitude),
            ("N", self.minimum_latitude, self.maximum_latitude),
            ("m", self.minimum_depth, self.maximum_depth),
        ):
            if low is not None or high is not None:
                parts.append(f"{'' if low is None else low}..{'' if high is None else high}{unit}")
        if self.start_datetime or self.end_datetime:
            parts.append(f"{self.start_datetime or ''}..{self.end_datetime or ''}".replace(":", ""))
        return "_".join(parts)

    @property
    def level(self) -> float | None:
        """The single depth asked for, if it is one."""
        return self.minimum_depth if self.minimum_depth == self.maximum_depth else None

    def bounds(self) -> dict[str, tuple]:
        """Closed interval per dimension; a single level is not among them."""
        ends = {
            "longitude": (self.minimum_longitude, self.maximum_longitude),
            "latitude": (self.minimum_latitude, self.maximum_latitude),
            "depth": (self.minimum_depth, self.maximum_depth) if self.level is None else (None, None),
            TIME: (self.start_datetime, self.end_datetime),
        }
        return {d: e for d, e in ends.items() if e != (None, None)}

    def apply(self, cube: Cube | Dataset) -> Cube | Dataset:
        if self.variables is not None:
            cube = cube.pick(*self.variables)
        bounds, level = self.bounds(), self.level
        if isinstance(cube, Dataset):
            bounds = {d: b for d, b in bounds.items() if d in cube.dims}
            level = level if "depth" in cube.dims else None
        cube = cube.sel_range(**bounds)
        return cube if level is None else cube.sel_nearest(depth=level)


def credentials(spark: SparkSession) -> dict[str, str]:
    """User name and password from the Spark settings or the environment, never
    from code: spark.pelagrid.user / PELAGRID_USER, and likewise `password`."""
    found = {}
    for name in ("user", "password"):
        value = spark.conf.get(f"spark.pelagrid.{name}", None) or os.environ.get(f"PELAGRID_{name.upper()}")
        if not value:
            raise PermissionError(f"set spark.pelagrid.{name} or PELAGRID_{name.upper()}")
        found[name] = value
    return found


def _open(spark: SparkSession, catalog: Catalog, wanted: Request) -> Cube | Dataset:
    p = catalog.product(wanted.dataset_id)
    if p.fmt == "netcdf":
        if p.login or p.options or p.descending:
            raise ValueError(f"{wanted.dataset_id}: login, options and descending have no meaning for NetCDF files")
        names = wanted.variables or p.data_vars
        bounds = wanted.bounds()
        if wanted.level is not None:
            axes = netcdf.open_netcdf(spark, p.path, names, p.rename, check=False)
            bounds["depth"] = (nearest(axes.axes, {"depth": wanted.level})["depth"],) * 2
        return netcdf.open_netcdf(spark, p.path, names, p.rename, bounds=bounds)
    options = {**p.options, **(credentials(spark) if p.login else {})}
    cube = store.open_cube(spark, p.path, p.dims, p.data_vars, p.rename or None, p.fmt, options, p.descending)
    return Dataset.split(cube, p.own_dims) if p.own_dims else cube


def open_dataset(spark: SparkSession, catalog: Catalog, **request) -> Cube | Dataset:
    """The requested part of a data set, lazily."""
    wanted = Request(**request)
    return wanted.apply(_open(spark, catalog, wanted))


def subset(
    spark: SparkSession,
    catalog: Catalog,
    output_directory: str,
    output_filename: str | None = None,
    force_download: bool = True,
    years: Iterable[int] | None = None,
    **request,
) -> str:
    """Store the requested part of a data set and return where it lies.

    `years` stands for one request per calendar year: they become one job over
    all years, stored by year, and replace those years of an existing subset; one for
    which nothing is found is empty afterwards. Otherwise the whole subset is
    replaced. A reader sees the old state until the new one is whole. Without `force_download`
    a whole that is stored is left as it is, and so are years that are stored for the same request;
    a year stored for another request is fetched again, so that a store by year never mixes two. A
    failure is logged and raised again.
    """
    wanted = Request(**request)
    asked = wanted.default_name()
    path = f"{output_directory.rstrip('/')}/{output_filename or asked}"
    log.info("storing %s in %s", wanted.dataset_id, path)
    try:
        missing = None if years is None else sorted(set(years))
        if not force_download:
            there = _stored(spark, path)
            missing = [y for y in missing or () if there.get(str(y)) != asked]
            if WHOLE in there or (years is not None and not missing):
                log.info("%s is already there", path)
                return path
            missing = None if years is None else missing
        if years is not None:
            if not missing:
                raise ValueError("no years given")
            if not (wanted.start_datetime or wanted.end_datetime):
                ends = year_bounds(missing[0])[0], year_bounds(missing[-1])[1]
                wanted = replace(wanted, start_datetime=ends[0], end_datetime=ends[1])
        cube = wanted.apply(_open(spark, catalog, wanted))
        if years is not None:
            cube = take_years(cube, missing)
        write = store.write_dataset if isinstance(cube, Dataset) else store.write_cube
        write(cube, path, replace_all=years is None, years=missing, request=asked)
    except Exception as failure:
        log.error("storing %s failed: %s", wanted.dataset_id, failure)
        raise
    log.info("stored %s", path)
    return path


def take_years(cube: Cube | Dataset, years: Iterable[int]) -> Cube | Dataset:
    """What one request per calendar year would bring, selected at once."""
    years = sorted(set(years))
    if not years:
        raise ValueError("no years given")
    if isinstance(cube, Dataset):
        return cube.each(lambda group: take_years(group, years), along=TIME)
    cube = cube.sel_time(year_bounds(years[0])[0], year_bounds(years[-1])[1])
    chosen = in_year_requests(F.col(TIME), years)
    listed = F.col(cube.year).isin(years) if cube.year else F.lit(True)
    return replace(cube, frame=cube.frame.where(chosen & listed), axes={**cube.axes, TIME: cube.axes[TIME].where(chosen)})


def _stored(spark: SparkSession, path: str) -> Mapping[str, str]:
    """The request for each year that is stored, or under WHOLE for all."""
    kept = snapshot.current(spark, path)
    if kept:
        return kept.requests
    # Groups of a dataset: what all of them have.
    groups = [set(m.requests.items()) for m in snapshot.stores(spark, path).values()]
    return dict(set.intersection(*groups)) if groups else {}
