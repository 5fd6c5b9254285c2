"""Two-way bins and multi-way recodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Season, day and month rules of the experiment.
DRY_SEASON_START = "2021-12-01"
WET_MONTHS = (10, 11, 12)
DAY_HOURS = (7, 20)
MONTH_NAMES = {
    1: "January",
    2: "February",
    10: "October",
    11: "November",
    12: "December",
}


def two_way(condition: Column, yes: str, no: str) -> Column:
    """``yes`` or ``no``; missing when the condition is unknown."""
    return F.when(condition, yes).when(~condition, no)


def season_by_date(day: Column | str, dry_start: str = DRY_SEASON_START) -> Column:
    """Wet before the cut-off date, dry from it on."""
    day = F.col(day) if isinstance(day, str) else day
    return two_way(day < F.lit(dry_start).cast("date"), "wet", "dry")


def season_by_month(ts: Column | str, wet_months: Sequence[int] = WET_MONTHS) -> Column:
    """Wet in the listed months. December is wet here and dry in ``season_by_date``."""
    return two_way(F.month(ts).isin(*wet_months), "wet", "dry")


def day_or_night(ts: Column | str, hours: tuple[int, int] = DAY_HOURS) -> Column:
    """Day from the first to the last hour given, both included."""
    return two_way(F.hour(ts).between(*hours), "day", "night")


def recode(column: Column | str, names: Mapping) -> Column:
    """Multi-way recode; values without an entry become missing."""
    column = F.col(column) if isinstance(column, str) else column
    out = None
    for value, label in names.items():
        out = F.when(column == value, label) if out is None else out.when(column == value, label)
    return out


def month_name(ts: Column | str, names: Mapping[int, str] = MONTH_NAMES) -> Column:
    return recode(F.month(ts), names)
