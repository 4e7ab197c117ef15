"""Variables of unlike dimensions that share their axes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce as fold
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .axis import Axis
from .cube import TIME, Cube
from .operators import reduce, select


@dataclass(frozen=True, repr=False, eq=False)
class Dataset:
    """Groups of variables, a frame for each; an axis that several have is one axis.

    An operation along a dimension changes the variables that have it and leaves the others
    as they are, without reading them. A dimension that no variable has raises KeyError. Nothing
    is joined before `cube` or `spread` asks for variables of several groups together.
    """

    groups: tuple[Cube, ...]

    @classmethod
    def of(cls, cubes: Sequence[Cube]) -> Dataset:
        """The variables of the cubes together. A shared axis has the values of all of them, so
        that a position means the same for each variable."""
        names = [v for c in cubes for v in c.data_vars]
        if twice := sorted({v for v in names if names.count(v) > 1}):
            raise ValueError(f"more than one variable named {twice}")
        axes: dict[str, Axis] = {}
        for c in cubes:
            for d in c.dims:
                kinds = {o.dtype(d).simpleString() for o in cubes if d in o.dims}
                if len(kinds) > 1:
                    raise ValueError(f"{d} is {' and '.join(sorted(kinds))}")
                axes[d] = axes[d].union(c.axes[d]) if d in axes else c.axes[d]
        return cls(tuple(replace(c, axes={d: axes[d] for d in c.dims}) for c in cubes))

    @classmethod
    def split(cls, cube: Cube, own: Mapping[str, Sequence[str]]) -> Dataset:
        """The variables of one cube, those in `own` with the dimensions given there only: along
        the others their value repeats, and reading one that varies raises."""
        unknown = [v for v in own if v not in cube.data_vars]
        if unknown:
            raise KeyError(f"no variable {unknown}; there are {list(cube.data_vars)}")
        rest = [v for v in cube.data_vars if v not in own]
        groups = [cube.pick(*rest)] if rest else []
        for dims in dict.fromkeys(tuple(d) for d in own.values()):
            select.require_dims(cube, *dims)
            flat = [v for v, d in own.items() if tuple(d) == dims]
            groups.append(cube.pick(*flat).drop_dims(*[d for d in cube.dims if d not in dims], keep=flat))
        return cls(tuple(groups))

    def __str__(self) -> str:
        return f"Dataset({'; '.join(str(g) for g in self.groups)})"

    __repr__ = __str__

    # -- shape ---------------------------------------------------------------

    @property
    def dims(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(d for g in self.groups for d in g.dims))

    @property
    def data_vars(self) -> tuple[str, ...]:
        return tuple(v for g in self.groups for v in g.data_vars)

    @property
    def axes(self) -> dict[str, Axis]:
        return {d: g.axes[d] for g in reversed(self.groups) for d in g.dims}

    def axis(self, dim: str) -> DataFrame:
        return self._with(dim).axis(dim)

    def positions(self, dim: str) -> DataFrame:
        return self._with(dim).positions(dim)

    def info(self) -> DataFrame:
        """As of a cube, a dimension once; `over` has the dimensions of each variable."""
        rows = []
        for g in self.groups:
            over = F.when(F.col("kind") == "var", F.lit(", ".join(g.dims)))
            rows.append(g.info().withColumn("over", over))
        return fold(DataFrame.unionByName, rows).distinct()

    def cube(self, *names: str) -> Cube:
        """The named variables, or all, as one cube. They must have the same dimensions;
        cells of several groups are joined, with missing values where one has no cell."""
        groups = self.pick(*names).groups if names else self.groups
        first, *rest = groups
        if any(set(g.dims) != set(first.dims) for g in rest):
            raise ValueError(f"different dimensions: {[g.dims for g in groups]}")
        frame = first.frame.select(*first.dims, *first.data_vars)
        for g in rest:
            other = g.frame.select(*first.dims, *g.data_vars)
            if first.dims:
                # A missing coordinate is a coordinate: it pairs with a missing one.
                there = other.withColumnsRenamed({d: f"{d}__" for d in first.dims})
                same = [F.col(d).eqNullSafe(F.col(f"{d}__")) for d in first.dims]
                both = frame.join(there, fold(lambda a, b: a & b, same), "full")
                have = [v for v in both.columns if v not in first.dims and not v.endswith("__")]
                frame = both.select(*[F.coalesce(d, f"{d}__").alias(d) for d in first.dims], *have)
            else:
                frame = frame.join(other)  # one row each
        wanted = names or self.data_vars
        return Cube.of(frame.select(*first.dims, *wanted), first.dims, wanted, first.axes)

    def spread(self, onto: str, *names: str) -> Cube:
        """The cells of the variable `onto` with further ones, whose values repeat along the dimensions they lack."""
        base = self.pick(onto).groups[0]
        frame = base.frame
        for name in names:
            g = self.pick(name).groups[0]
            select.require_dims(base, *g.dims)
            flat = g.frame.select(*g.dims, name)
            frame = frame.join(flat, list(g.dims), "left") if g.dims else frame.join(flat)
        years = [base.year] if base.year else []
        return Cube.of(frame.select(*base.dims, onto, *names, *years), base.dims, (onto, *names), base.axes, base.year)

    # -- picking variables and dimensions ------------------------------------

    def pick(self, *names: str) -> Dataset:
        unknown = [n for n in names if n not in self.data_vars]
        if unknown:
            raise KeyError(f"no variable {unknown}; there are {list(self.data_vars)}")
        kept = [(g, [n for n in names if n in g.data_vars]) for g in self.groups]
        return Dataset(tuple(g.pick(*own) for g, own in kept if own))

    def rename(self, names: Mapping[str, str]) -> Dataset:
        unknown = [n for n in names if n not in (*self.dims, *self.data_vars)]
        if unknown:
            raise KeyError(f"nothing named {unknown}")
        new = [names.get(n, n) for n in (*self.dims, *self.data_vars)]
        if len(set(new)) < len(new):
            raise ValueError(f"renaming {dict(names)} makes two columns of one name")
        groups = [g.rename({o: n for o, n in names.items() if o in (*g.dims, *g.data_vars)}) for g in self.groups]
        axes = Dataset(tuple(groups)).axes
        return Dataset(tuple(replace(g, axes={d: axes[d] for d in g.dims}) for g in groups))

    def drop_dims(self, *dims: str) -> Dataset:
        """Without the dimensions and the variables that have them."""
        self._require(*dims)
        return Dataset(tuple(g for g in self.groups if not set(dims) & set(g.dims)))

    def squeeze(self) -> Dataset:
        """Without dimensions whose axis has a single value (runs an axis job)."""
        single = select.single(self.axes)
        return self._each(single, lambda g, dims: select.without(g, dims))

    # -- selection -----------------------------------------------------------

    def isel(self, **where: int | slice) -> Dataset:
        """By position along the shared axes, looked up once for all variables."""
        self._require(*where)
        found = select.located({d: self.axes[d] for d in where}, where)
        return self._each(where, lambda g, dims: select.placed(g, {d: where[d] for d in dims}, found))

    def sel(self, strict: bool = True, **where: Any) -> Dataset:
        self._require(*where)
        chosen = self._each(where, lambda g, dims: select.labelled(g, {d: where[d] for d in dims}))
        if strict:
            select.require_labels(chosen.axes, where)
        return chosen._each(where, lambda g, dims: select.without(g, dims))

    def sel_nearest(self, drop: bool = False, **where: float) -> Dataset:
        self._require(*where)
        values = select.nearest(self.axes, where)
        chosen = self._each(where, lambda g, dims: select.labelled(g, {d: values[d] for d in dims}))
        return chosen._each(where, lambda g, dims: select.without(g, dims)) if drop else chosen

    def sel_range(self, **bounds: tuple[Any, Any]) -> Dataset:
        self._require(*bounds)
        return self._each(bounds, lambda g, dims: g.sel_range(**{d: bounds[d] for d in dims}))

    def sel_time(self, start: str | None, end: str | None) -> Dataset:
        return self.sel_range(**{TIME: (start, end)})

    # -- reduction -----------------------------------------------------------

    def mean(self, *dims: str) -> Dataset:
        """Along the dimensions of each variable that are named, along all if none is."""
        self._require(*dims)
        return self._each(dims or self.dims, lambda g, own: reduce.mean(g, own))

    def group_mean(self, part: str) -> Dataset:
        """Climatology of the variables that have a time."""
        self._require(TIME)
        return self._each([TIME], lambda g, _: reduce.group_mean(g, part))

    # -- helpers -------------------------------------------------------------

    def each(self, change: Callable[[Cube], Cube], along: str) -> Dataset:
        """The groups that have the dimension changed, the others as they are."""
        return self._each([along], lambda g, _: change(g))

    def _each(self, dims, change: Callable[[Cube, list[str]], Cube]) -> Dataset:
        out = []
        for g in self.groups:
            own = [d for d in dims if d in g.dims]
            out.append(change(g, own) if own else g)
        # What one selection has found out about an axis holds for all that share it.
        axes = Dataset(tuple(out)).axes
        shared = {d: axes[d] for g in out for d in g.dims if all(o.axes[d].source is axes[d].source for o in out if d in o.dims)}
        return Dataset(tuple(replace(g, axes={d: shared.get(d, a) for d, a in g.axes.items()}) for g in out))

    def _require(self, *dims: str) -> None:
        unknown = [d for d in dims if d not in self.dims]
        if unknown:
            raise KeyError(f"no dimension {unknown}; there are {list(self.dims)}")

    def _with(self, dim: str) -> Cube:
        self._require(dim)
        return next(g for g in self.groups if dim in g.dims)
