"""Calendar parts of a time coordinate, as built-in column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Meteorological season labels, in calendar order from December.
SEASONS = ("DJF", "MAM", "JJA", "SON")


def month_of(time: Column) -> Column:
    """Calendar month, 1..12."""
    return F.month(time)


def season_of(time: Column) -> Column:
    """Season label of the month, NULL without a time; December counts with January
    and February whatever their year, so no season spans a year boundary."""
    return season_of_month(F.month(time))


def season_of_month(month: Column) -> Column:
    """Season label of a month number."""
    label = F.lit(None).cast("string")
    for number, season in enumerate(SEASONS):
        label = F.when(F.floor(month % 12 / 3) == number, F.lit(season)).otherwise(label)
    return label


# Group keys a climatology can be taken over.
TIME_PARTS = {"month": month_of, "season": season_of}


def instant(text: str, dtype: str = "timestamp_ntz") -> Column:
    """ISO text, with or without a time of day, as a literal instant."""
    return F.lit(text).cast(dtype)


def year_bounds(year: int) -> tuple[str, str]:
    """Closed bounds of a one-year request: both ends at midnight, so the last
    day takes part only with its 00:00 stamp."""
    return f"{year:04d}-01-01T00:00:00", f"{year:04d}-12-31T00:00:00"


def in_year_requests(time: Column, years: Iterable[int]) -> Column:
    """True where some one-year request of `years` covers the instant.

    One predicate for all years: an outer range the scan can prune on, then the
    year list, then the midnight end of each year.
    """
    wanted = sorted(set(years))
    if not wanted:
        return F.lit(False)
    outer = time.between(instant(year_bounds(wanted[0])[0]), instant(year_bounds(wanted[-1])[1]))
    last_midnight = F.make_date(F.year(time), F.lit(12), F.lit(31)).cast("timestamp_ntz")
    listed = F.lit(True) if len(wanted) == wanted[-1] - wanted[0] + 1 else F.year(time).isin(wanted)
    return outer & listed & (time <= last_midnight)
