"""Extremes and exact percentiles over a whole cube."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..ranks import running
from ..session import written

if TYPE_CHECKING:
    from ..cube import Cube

# percentile_approx promises ranks within 1/ACCURACY of the rows it has seen.
ACCURACY = 20_000


def extents(cube: Cube, names: Sequence[str]) -> DataFrame:
    names = names or (*cube.dims, *cube.data_vars)
    unknown = [n for n in names if n not in (*cube.dims, *cube.data_vars)]
    if unknown:
        raise KeyError(f"nothing named {unknown}")
    pairs = [e for n in names for e in (F.min(n).alias(f"{n}_min"), F.max(n).alias(f"{n}_max"))]
    return cube.frame.agg(*pairs)


def robust_limits(cube: Cube, var: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """The `low` and `high` percentiles of a variable over all cells, exact, with
    linear interpolation between ranks, as one row (vmin, vmax); NULL without a value.

    The values are written once, and counted as they are, for the cube itself may be an expensive
    aggregation. One pass brackets both percentiles with percentile_approx; a second one counts the
    rows below, between and above the brackets and, inside, the rows of each value. The values inside
    both are ranked together, by ranges; so no task holds more than a range, however many rows
    there are or share a value.
    """
    if not 0 <= low < high <= 1:
        raise ValueError(f"need 0 <= low < high <= 1, got {low}, {high}")
    if var not in cube.data_vars:
        raise KeyError(f"no variable {var!r}; there are {list(cube.data_vars)}")
    seen = Observation()
    held = cube.frame.select(F.col(var).alias("v")).where(F.col("v").isNotNull())
    values = written(held.observe(seen, F.count(F.lit(1)).alias("n"))).select(F.col("v").cast("double").alias("v"))
    n = seen.get["n"]
    found = _exact(values, [Bracket.around(q, n) for q in (low, high)]) if n else [None, None]
    return values.sparkSession.range(1).select(*[F.lit(x).cast("double").alias(c) for x, c in zip(found, ("vmin", "vmax"))])


@dataclass(frozen=True)
class Bracket:
    """A closed value interval known to hold the ranks a percentile falls between.

    below and inside count the rows under and in the interval; slack is how far
    beside the ranks, relative to the rows inside, the next interval may end.
    """

    rank: int
    fraction: float
    n: int
    below: int
    inside: int
    low: float = -math.inf
    high: float = math.inf
    slack: float = 0.0

    @classmethod
    def around(cls, q: float, n: int) -> Bracket:
        at = q * (n - 1)
        return cls(math.floor(at), at - math.floor(at), n, 0, n, slack=2.0 / ACCURACY)

    @property
    def next_rank(self) -> int:
        return min(self.rank + 1, self.n - 1)

    def holds(self, v: Column) -> Column:
        return v.between(F.lit(self.low), F.lit(self.high))

    def probes(self) -> tuple[float, float]:
        """Relative ranks a safe distance outside the wanted ones."""
        first = (self.rank - self.below) / self.inside - self.slack
        last = (self.next_rank - self.below + 1) / self.inside + self.slack
        return max(first, 0.0), min(last, 1.0)

    def at(self, rank: int, before: int) -> Column:
        """The value inside with this rank; `before` are the rows of other brackets' values below."""
        start = F.col("before") + (self.below - before)
        here = (start <= rank) & (start + F.col("c") > rank)
        return F.max(F.when(here & self.holds(F.col("v")), F.col("v")))


def _exact(values: DataFrame, brackets: list[Bracket]) -> list[float]:
    """The interpolated percentiles of the brackets."""
    open_ = brackets
    while True:
        tried = _guessed(values, open_)
        counts = _counts(values, tried)
        totals = [(r["place"], r["inside"], r["c"]) for r in counts.groupBy(
            "place", F.col("v").isNotNull().alias("inside")).agg(F.sum("c").alias("c")).collect()]
        tried = [replace(b, below=sum(c for at, _, c in totals if not at >> 2 * i & 1),
                         inside=sum(c for at, _, c in totals if at >> 2 * i & 3 == 1)) for i, b in enumerate(tried)]
        missed = {i for i, b in enumerate(tried) if not (b.below <= b.rank and b.next_rank < b.below + b.inside)}
        if not missed:
            break
        # The estimate was worse than promised: wider again.
        counts.unpersist()
        open_ = [replace(b, slack=4 * b.slack) if i in missed else b for i, b in enumerate(open_)]
    with running(counts.where(F.col("v").isNotNull()).select("v", "c"), [F.col("v")], F.col("c"), "before") as ranks:
        before = [sum(c for at, inside, c in totals if inside and not at >> 2 * i & 1) for i in range(len(tried))]
        ends = ranks.agg(*[
            b.at(rank, before[i]).alias(f"{side}{i}") for i, b in enumerate(tried)
            for side, rank in (("a", b.rank), ("b", b.next_rank))]).first()
    counts.unpersist()
    return [ends[f"a{i}"] + (ends[f"b{i}"] - ends[f"a{i}"]) * b.fraction for i, b in enumerate(tried)]


def _guessed(values: DataFrame, brackets: list[Bracket]) -> list[Bracket]:
    """Each bracket narrowed to its rank and a little more on both sides, in one pass for all."""
    guesses = values.agg(*[
        F.percentile_approx("v", F.array(*map(F.lit, b.probes())), F.lit(ACCURACY)).alias(f"g{i}")
        for i, b in enumerate(brackets)]).first()
    return [replace(b, low=guesses[f"g{i}"][0], high=guesses[f"g{i}"][1]) for i, b in enumerate(brackets)]


def _counts(values: DataFrame, brackets: list[Bracket]) -> DataFrame:
    """Rows by place and value: place has two bits a bracket, one at or above its
    low end and one above its high end; v is missing outside of all brackets."""
    v = F.col("v")
    place, inside = F.lit(0), F.lit(False)
    for i, b in enumerate(brackets):
        passed = (v >= F.lit(b.low)).cast("int") + 2 * (v > F.lit(b.high)).cast("int")
        place, inside = place + passed * 4**i, inside | b.holds(v)
    return values.groupBy(place.alias("place"), F.when(inside, v).alias("v")).agg(F.count("*").alias("c")).persist()
