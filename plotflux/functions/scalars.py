"""Casts, text keys, dates and guarded arithmetic as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text formats found in the instrument files.
FLUX_DATE_FORMATS = (
    "yyyy-M-d H:mm:ss[.SSS]", "M/d/yyyy H:mm[:ss]", "M/d/yy H:mm[:ss]",
    "yyyy-M-d'T'H:mm:ss[.SSS]['Z']", "yyyy/M/d H:mm[:ss]", "yyyy.M.d H:mm[:ss]", "M-d-yyyy H:mm[:ss]",
)
LOGGER_DATE_FORMATS = ("yyyy.MM.dd HH:mm", "dd.MM.yyyy HH:mm")
CAMPAIGN_DATE_FORMATS = ("M/d/yy",)
LOCAL_ZONE = "Etc/GMT+6"  # six hours behind UTC, without daylight saving


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def try_number(column: Column | str) -> Column:
    """Text to double; decimal comma or point; anything else is missing."""
    return F.regexp_replace(F.trim(_c(column)), ",", ".").try_cast("double")


#: What a run of letters of a date format takes at least; a field of one letter or a long year may have a sign.
_FIELD_SHAPES = {
    **{letter: r"[+-]?\d+" for letter in "yMdHms"}, **{2 * letter: r"\d{2}" for letter in "yMdHms"},
    "yyyy": r"[+-]?\d{4,}", "SSS": r"\d+",
}


def date_shape(format: str) -> str | None:
    """Pattern that every text of a numeric date format fits, or None for a format with other parts."""
    out = []
    for first, more, quoted, other in re.findall(r"([A-Za-z])(\1*)|'([^']+)'|(.)", format, re.DOTALL):
        if first + more:
            out.append(_FIELD_SHAPES.get(first + more))
        elif other in ("[", "]"):
            out.append("(?:" if other == "[" else ")?")
        else:
            out.append(re.escape(quoted + other) if other not in ("'", "#", "{", "}") and (quoted + other).isascii() else None)
    if None in out or out.count("(?:") != out.count(")?"):
        return None
    return "(?i)^" + "".join(out) + "$"


def parse_timestamp(column: Column | str, formats: Sequence[str]) -> Column:
    """Wall time from text: the first format that fits, or missing when none does.

    A year of two digits lies between 1969 and 2068. A format is only tried on texts of its shape, since
    a trial that fails costs many times one that succeeds.
    """
    text = F.trim(_c(column))
    tried = []
    for f in formats:
        time = F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz")
        if "yy" in f and "yyyy" not in f:
            century_back = time - F.make_ym_interval(F.lit(100))
            time = F.when(F.year(time) > 2068, century_back).otherwise(time)
        shape = date_shape(f)
        tried.append(time if shape is None else F.when(text.rlike(shape), time))
    return F.coalesce(*tried)


def parse_date(column: Column | str, formats: Sequence[str] = CAMPAIGN_DATE_FORMATS) -> Column:
    return parse_timestamp(column, formats).cast("date")


def utc_to_local(column: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """UTC wall time to local wall time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(column))


def hour_floor(column: Column | str) -> Column:
    """Start of the hour of a wall time; independent of the session time zone."""
    c = _c(column)
    return c.cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(c))


def with_date_parts(df: DataFrame, ts: str) -> DataFrame:
    """Add day, hour, month and year of ``ts``."""
    c = F.col(ts)
    return df.withColumns(
        {"day": c.cast("date"), "hour": F.hour(c), "month": F.month(c), "year": F.year(c)}
    )


def hours_since_epoch(day: Column | str) -> Column:
    """A date as hours since 1970-01-01."""
    return (F.unix_date(_c(day)) * 24).cast("double")


def compound_key(*parts: Column | str, sep: str = "-") -> Column:
    """Parts pasted with ``sep``; missing when any part is missing."""
    columns = [_c(p) for p in parts]
    complete = F.lit(True)
    for c in columns:
        complete = complete & c.isNotNull()
    return F.when(complete, F.concat_ws(sep, *[c.cast("string") for c in columns]))


def split_part(column: Column | str, sep: str, index: int) -> Column:
    """Part ``index`` of a split text, counted from 1, or from the end when negative."""
    return F.try_element_at(F.split(_c(column), f"\\Q{sep}\\E"), F.lit(index))


def censor(column: Column | str, lower: float | None = None, upper: float | None = None) -> Column:
    """Values outside [lower, upper] become missing; the row stays."""
    c = _c(column)
    keep = c.isNotNull()
    if lower is not None:
        keep = keep & (c >= lower)
    if upper is not None:
        keep = keep & (c <= upper)
    return F.when(keep, c)


def safe_sqrt(column: Column | str) -> Column:
    c = _c(column)
    return F.when(c >= 0, F.sqrt(c))


def safe_log10(column: Column | str) -> Column:
    c = _c(column)
    return F.when(c > 0, F.log10(c))


def square(column: Column | str) -> Column:
    c = _c(column)
    return c * c


def row_mean(*columns: Column | str) -> Column:
    """Mean across columns of one row; missing when any of them is."""
    total = _c(columns[0]).cast("double")
    for c in columns[1:]:
        total = total + _c(c).cast("double")
    return total / len(columns)


def cast_columns(df: DataFrame, names: Sequence[str], to: str = "double") -> DataFrame:
    """``try_cast`` of the named columns; what does not convert becomes missing."""
    return df.withColumns({n: F.col(n).try_cast(to) for n in names})


def cast_by_type(df: DataFrame, source: Sequence[str], to: str = "double") -> DataFrame:
    """Cast every column whose current type is in ``source``, e.g. all integers to double."""
    names = [n for n, t in df.dtypes if t in source]
    return df.withColumns({n: F.col(n).cast(to) for n in names}) if names else df


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns, in order."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [n for n, t in df.dtypes if t in kinds or t.startswith("decimal")]


def level_order(column: Column | str, levels: Sequence[str]) -> Column:
    """Position of a category in an imposed order, from 1; unlisted ones are missing."""
    position = F.try_element_at(
        F.create_map(*[x for i, level in enumerate(levels) for x in (F.lit(level), F.lit(i + 1))]),
        _c(column),
    )
    return position
