"""Row filters, campaigns and constant lookups."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotflux.functions.scalars import parse_date
from plotflux.session import durable, null_safe_join

# Control samples in the laboratory files, quality cut-off of a flux fit.
CONTROL_SAMPLE_PATTERN = "CHECK|BKL|STD|Untitled"
MIN_R2 = 0.8

# Measurement days and the campaign date each belongs to.
CAMPAIGN_DAYS = {
    "10/3/21": ("2021-10-03", "2021-10-04"),
    "10/25/21": ("2021-10-24", "2021-10-25", "2021-10-26"),
    "11/05/21": ("2021-11-05", "2021-11-06"),
    "11/16/21": ("2021-11-16", "2021-11-17"),
    "12/1/21": ("2021-12-01", "2021-12-03"),
    "12/17/21": ("2021-12-17",),
    "1/04/22": ("2022-01-04",),
    "1/21/22": ("2022-01-21", "2022-01-23"),
    "2/02/22": ("2022-02-02", "2022-02-03"),
}


def quality_filter(df: DataFrame, quality: str, minimum: float = MIN_R2) -> DataFrame:
    """Rows above the cut-off; a missing quality drops the row."""
    return df.filter(F.col(quality) > minimum)


def date_window(df: DataFrame, ts: str, first: str, last: str, day: str | None = None) -> DataFrame:
    """Rows from the first to the last day, both included.

    The raw timestamp is compared with literals, so the predicate reaches the scan.
    ``day`` names a date column the table is partitioned by; other days' files are
    then not opened at all.
    """
    after = dt.date.fromisoformat(last) + dt.timedelta(days=1)
    lower = F.lit(first).cast("timestamp_ntz")
    upper = F.lit(after.isoformat()).cast("timestamp_ntz")
    if day:
        df = df.filter(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return df.filter((F.col(ts) >= lower) & (F.col(ts) < upper))


def exclude_matching(df: DataFrame, column: str, pattern: str = CONTROL_SAMPLE_PATTERN) -> DataFrame:
    """Drop rows whose text matches any of the markers (case matters)."""
    return df.filter(~F.col(column).rlike(pattern))


def campaign_lookup(
    df: DataFrame, day: str, campaigns: Mapping[str, Sequence[str]] = CAMPAIGN_DAYS,
    name: str = "campaign_day",
) -> DataFrame:
    """Add the campaign date a measurement day belongs to; other days get none.

    The table has one entry per listed day, so its size is fixed by the argument.
    """
    entries = [(d, label) for label, days in campaigns.items() for d in days]
    table = df.sparkSession.createDataFrame(entries, "_day string, _label string").select(
        F.col("_day").cast("date").alias("_day"), parse_date("_label").alias(name)
    )
    return df.join(F.broadcast(table), df[day] == table["_day"], "left").drop("_day")


def campaign_table(df: DataFrame, keys: Sequence[str], day: str, gap_days: int) -> DataFrame:
    """One row per key and measurement day with the campaign it falls in.

    A new campaign starts when more than ``gap_days`` lie between two days. Rows
    are first reduced to distinct days, so a window holds at most one row per
    calendar day however many readings a key has.
    """
    days = df.select(*keys, day).where(F.col(day).isNotNull()).distinct()
    order = Window.partitionBy(*keys).orderBy(day)
    starts = F.datediff(F.col(day), F.lag(day).over(order)) > gap_days
    numbered = days.withColumn("campaign", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(order))
    first = F.min(day).over(Window.partitionBy(*keys, "campaign"))
    return numbered.withColumn("campaign_day", first)


def label_campaigns(df: DataFrame, keys: Sequence[str], day: str, gap_days: int) -> DataFrame:
    """Add ``campaign`` and ``campaign_day`` to every row.

    The join key holds the day, so the rows of a hot key spread over its days.
    """
    return null_safe_join(df, campaign_table(df, keys, day, gap_days), [*keys, day])


def constant_lookup(df: DataFrame, key: str, values: Mapping, name: str) -> DataFrame:
    """Add a constant per key from a literal table; keys without an entry get none.

    The table is as small as the argument it is written from.
    """
    key_type = dict(df.dtypes)[key]
    table = df.sparkSession.createDataFrame(
        [(str(k), float(v)) for k, v in values.items()], "_key string, _value double"
    ).select(F.col("_key").cast(key_type).alias("_key"), F.col("_value").alias(name))
    return df.join(F.broadcast(table), df[key] == table["_key"], "left").drop("_key")


def level_table(df: DataFrame, column: str, small: int = 100_000) -> DataFrame:
    """Levels of a factor and their alphabetical place, from 1: ``level``, ``alphabetical``.

    Up to ``small`` levels (counted) are numbered by one window. Beyond, places are counted within
    ranges of levels and shifted by the ranges' sizes, so any number of levels is ordered without
    one task seeing them all. Missing is no level.
    """
    levels = df.select(F.col(column).alias("level")).where("level is not null").distinct()
    if levels.count() <= small:
        place = F.row_number().over(Window.orderBy("level"))
        return levels.select("level", place.alias("alphabetical"))
    levels = durable(levels)
    ranged = durable(levels.repartitionByRange("level").withColumn("_range", F.spark_partition_id()))
    sizes = dict(ranged.groupBy("_range").count().collect())
    before, offset = {}, 0
    for part in sorted(sizes):
        before[part] = offset
        offset += sizes[part]
    if not before:
        return ranged.select("level", F.lit(None).cast("int").alias("alphabetical"))
    shift = F.create_map(*[F.lit(v) for pair in before.items() for v in pair])
    place = F.row_number().over(Window.partitionBy("_range").orderBy("level"))
    return ranged.select("level", (place + F.element_at(shift, F.col("_range"))).cast("int").alias("alphabetical"))


def parse_report(df: DataFrame, text: str, parsed: str, by: Sequence[str] = ()) -> DataFrame:
    """What parsing left behind, per group: ``n``, ``n_missing``, ``n_unparsed``, and one ``example`` of the latter.

    A blank or missing text is missing; a text without a parsed value is unparsed. Dates that fit no format
    would otherwise vanish in the next date window without a trace.
    """
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    lost = ~blank & F.col(parsed).isNull()
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(blank).alias("n_missing"),
        F.count_if(lost).alias("n_unparsed"),
        F.min(F.when(lost, F.trim(text))).alias("example"),
    )
