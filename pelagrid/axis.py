"""The coordinate values along one dimension."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import cached, ranked, ranked_in_memory

POSITION, LENGTH = "position", "length"


class Ranks:
    """The values of a whole source axis with their positions from 0, ranked when first asked for.

    They are ranked once: an axis narrowed to an interval counts from an offset, and does not
    rank again. A kept axis has its positions stored, with their number in the
    column's metadata, so that nothing is ranked or counted at all.
    """

    def __init__(self, source: DataFrame, order: Column, kept: DataFrame | None = None, of: Ranks | None = None):
        self._source, self._order, self._kept, self._of = source, order, kept, of

    @property
    def stored(self) -> bool:
        return self._kept is not None or (self._of is not None and self._of.stored)

    @cached_property
    def _found(self) -> tuple[DataFrame, int]:
        if self._kept is not None:
            return self._kept, self._kept.schema[POSITION].metadata[LENGTH]
        name = self._source.columns[0]
        if self._of is not None:
            frame, n = self._of._found
            return frame.toDF(name, POSITION), n
        values = cached(self._source.distinct()).where(F.col(name).isNotNull())
        return ranked_in_memory(values, [self._order], POSITION)

    @property
    def frame(self) -> DataFrame:
        """Columns `name` and `position`."""
        return self._found[0]

    @property
    def length(self) -> int:
        return self._found[1]


@dataclass(frozen=True, eq=False)
class Axis:
    """Where the values of a dimension come from, and what was selected of them.

    source    one-column frame with the coordinate of every cell, or a kept axis
    selected  conditions of the selections made on this dimension so far
    ranks     positions along the whole source; cubes selected from one another share them
    known     the source positions start <= p < stop that are selected, where a selection says so

    The distinct values of the source are cached by Spark when first asked for, so that a chain of
    selections scans the coordinate column of a large cube once.

    Positions follow the values upward, or downward where the source counts so;
    that is noted in the metadata of the column, and stays with it in Parquet.
    """

    source: DataFrame
    selected: tuple[Column, ...] = ()
    ranks: Ranks | None = None
    known: tuple[int, int] | None = None

    def __post_init__(self):
        if self.ranks is None:
            object.__setattr__(self, "ranks", Ranks(self.source, self.order))

    @property
    def name(self) -> str:
        return self.source.columns[0]

    @classmethod
    def of(cls, source: DataFrame, descending: bool = False) -> Axis:
        (name,) = source.columns
        return cls(source.select(noted(name, descending)))

    @classmethod
    def stored(cls, source: DataFrame, positions: DataFrame) -> Axis:
        """A kept axis: its values, and each of them once with its position."""
        axis = cls(source)
        return replace(axis, ranks=Ranks(source, axis.order, positions))

    @property
    def descending(self) -> bool:
        return bool(self.source.schema[self.name].metadata.get("descending"))

    @property
    def order(self) -> Column:
        return F.col(self.name).desc() if self.descending else F.col(self.name).asc()

    @property
    def values(self) -> DataFrame:
        """Each value once, unordered."""
        known = self.ranks.frame.select(self.name) if self.ranks.stored else cached(self.source.distinct())
        return self._narrow(known).where(F.col(self.name).isNotNull())

    def where(self, *conditions: Column, known: tuple[int, int] | None = None) -> Axis:
        """Narrowed; `known` are the source positions that are left, if they are known."""
        return replace(self, selected=(*self.selected, *conditions), known=known)

    def derived(self, key: Column) -> Axis:
        """The axis a function of this coordinate has, such as month of time."""
        return Axis(self._narrow(self.source.distinct()).select(key))

    def renamed(self, name: str) -> Axis:
        source = self._narrow(self.source.distinct()).withColumnRenamed(self.name, name)
        axis = Axis(source)
        return axis if self.selected else replace(axis, ranks=Ranks(source, axis.order, of=self.ranks))

    def union(self, other: Axis) -> Axis:
        # Columns have no equality: the conditions must be the very same ones.
        if other.ranks is self.ranks and [*map(id, other.selected)] == [*map(id, self.selected)]:
            return self
        return Axis(self._narrow(self.source).unionByName(other._narrow(other.source)))

    def size(self) -> DataFrame:
        """Number of values, as one row `n`."""
        return self.values.agg(F.count(self.name).alias("n"))

    @property
    def settled(self) -> bool:
        """Whether the span is known without a job."""
        return self.known is not None or "span" in self.__dict__ or not self.selected

    def reach(self) -> DataFrame:
        """First and last position left, and how many, as one row."""
        at = F.col(POSITION)
        return self._narrow(self.ranks.frame).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(at).alias("n"))

    def settle(self, first: int | None, last: int | None, n: int) -> None:
        """Note what `reach` has found."""
        together = (first, last + 1) if n and last + 1 - first == n else None
        self.__dict__["span"] = together if n else (0, 0)

    @cached_property
    def span(self) -> tuple[int, int] | None:
        """The source positions start <= p < stop that are left; None if they have gaps."""
        if not self.selected:
            return 0, self.ranks.length
        if self.known is not None:
            return self.known
        self.settle(*self.reach().first())
        return self.__dict__["span"]

    @cached_property
    def length(self) -> int:
        return self.span[1] - self.span[0] if self.span else self.size().first()["n"]

    @cached_property
    def positions(self) -> DataFrame:
        """The values with their position from 0, as columns `name` and `position`."""
        if self.span is None:
            return ranked(self.values.select(self.name), [self.order], POSITION)
        start, stop = self.span
        at = F.col(POSITION)
        left = self.ranks.frame.where((at >= start) & (at < stop)) if self.selected else self.ranks.frame
        return left.withColumn(POSITION, at - start) if start else left

    def lookup(self, start: int, stop: int | None) -> tuple[DataFrame | None, tuple[int, int] | None]:
        """The values at both ends of the positions start <= p < stop that there are, at most two rows,
        and their source positions. None if there are none. With an open end only the value at
        `start` is looked up."""
        if self.span is None:
            at = F.col(POSITION)
            stop = start + 1 if stop is None else stop
            return self.positions.where((at >= start) & (at < stop)), None
        first, end = self.span
        low, high = first + start, end if stop is None else min(first + stop, end)
        if low >= high:
            return None, None
        wanted = {low} if stop is None else {low, high - 1}
        return self.ranks.frame.where(F.col(POSITION).isin(*sorted(wanted))), (low, high)

    def _narrow(self, values: DataFrame) -> DataFrame:
        for condition in self.selected:
            values = values.where(condition)
        return values


def noted(name: str, descending: bool) -> Column:
    """The column, with a note if positions count downward along it."""
    return F.col(name).alias(name, metadata={"descending": True}) if descending else F.col(name)
