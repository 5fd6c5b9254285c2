"""Group means, spreads and errors; hourly, daily and campaign roll-ups; z-scores.

All aggregates combine before the shuffle, so a group of any size costs one
small partial row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotflux.functions.scalars import hour_floor
from plotflux.session import durable, join_checked


def mean(column: str, na_rm: bool = True) -> Column:
    """Mean; with ``na_rm=False`` one missing value makes the group's mean missing."""
    value = F.avg(column)
    return value if na_rm else F.when(F.count(column) == F.count(F.lit(1)), value)


def sd(column: str, na_rm: bool = True) -> Column:
    """Sample standard deviation; missing for fewer than two values."""
    value = F.stddev_samp(column)
    return value if na_rm else F.when(F.count(column) == F.count(F.lit(1)), value)


def total(column: str) -> Column:
    """Sum that is 0 when every value is missing."""
    return F.coalesce(F.sum(column), F.lit(0.0))


def se(column: str, n: str = "rows") -> Column:
    """Standard error; ``n='rows'`` counts rows with a missing value too, ``'valid'`` does not."""
    count = F.count(F.lit(1)) if n == "rows" else F.count(column)
    return F.try_divide(F.stddev_samp(column), F.sqrt(count))


def measures(
    columns: Sequence[str] | Mapping[str, str],
    stats: Sequence[str] = ("mean", "sd"),
    na_rm: bool = True,
    se_n: str = "rows",
) -> list[Column]:
    """Aggregates named ``{stat}_{name}`` for every column and statistic."""
    names = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    make = {
        "mean": lambda c: mean(c, na_rm),
        "sd": lambda c: sd(c, na_rm),
        "se": lambda c: se(c, se_n),
        "sum": total,
        "n": F.count,
        "min": F.min,
        "max": F.max,
    }
    return [make[s](c).alias(f"{s}_{name}") for c, name in names.items() for s in stats]


def summarise(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str] | Mapping[str, str],
    stats: Sequence[str] = ("mean", "sd"),
    na_rm: bool = True,
    se_n: str = "rows",
    count: bool = False,
) -> DataFrame:
    """One row per group with the chosen statistics of every column."""
    aggregates = measures(columns, stats, na_rm, se_n)
    if count:
        aggregates.append(F.count(F.lit(1)).alias("n"))
    return df.groupBy(*by).agg(*aggregates)


def error_bars(df: DataFrame, centre: str, half: str) -> DataFrame:
    """Add the ends of error bars around a mean; ``half`` is its se or sd."""
    return df.withColumns({"lower": F.col(centre) - F.col(half), "upper": F.col(centre) + F.col(half)})


def hourly_rollup(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: Sequence[str] | Mapping[str, str],
    stats: Sequence[str] = ("mean",),
    na_rm: bool = True,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Per key and hour. ``hour_start`` is the start of the hour in wall time."""
    return (
        df.groupBy(*keys, hour_floor(ts).alias("hour_start"))
        .agg(*measures(columns, stats, na_rm), *extra)
    )


def daily_rollup(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: Sequence[str] | Mapping[str, str],
    stats: Sequence[str] = ("mean",),
    na_rm: bool = True,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Per key and calendar day."""
    return df.groupBy(*keys, F.col(ts).cast("date").alias("day")).agg(
        *measures(columns, stats, na_rm), *extra
    )


def mean_of_means(
    df: DataFrame, inner: Sequence[str], outer: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Average the ``inner`` group means within ``outer`` groups, each inner group counting once."""
    first = df.groupBy(*inner).agg(*[F.avg(c).alias(c) for c in columns])
    return first.groupBy(*outer).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def summary_sets(
    df: DataFrame, sets: Mapping[str, Sequence[str]], columns: Sequence[str]
) -> DataFrame:
    """Mean and sd of the same measures for several groupings from one scan.

    Readings are reduced once to (n, mean, m2) per combination of all grouping columns, from one scan.
    The groupings merge those cells in two steps: first the mean of every group, then the cells' squares
    around the mean of their own group. So neither means that are large against their spread nor groups that
    lie far apart cost digits. ``grouping`` names the set a row belongs to.
    """
    keys = list(dict.fromkeys(k for s in sets.values() for k in s))
    cells = durable(
        df.groupBy(*keys).agg(
            *[
                x
                for c in columns
                for x in (
                    F.count(c).alias(f"n_{c}"),
                    F.avg(c).alias(f"m_{c}"),
                    (F.var_pop(c) * F.count(c)).alias(f"q_{c}"),
                )
            ]
        )
    )
    # Every cell once per grouping, with the keys of other groupings left empty; a cell is many readings.
    named = F.explode(F.array(*[F.lit(name) for name in sets])).alias("grouping")
    member = {k: [name for name, of in sets.items() if k in of] for k in keys}
    rows = cells.select("*", named).withColumns({k: F.when(F.col("grouping").isin(member[k]), F.col(k)) for k in keys})
    group = ["grouping", *keys]
    # Around one mean for all first, then corrected by what is left: exact also for means far from zero.
    start = cells.agg(F.struct(*[F.try_divide(F.sum(F.col(f"m_{c}") * F.col(f"n_{c}")), F.sum(f"n_{c}")).alias(c) for c in columns]).alias("s"))
    start = start.select("s").scalar()
    centres = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_held"),
        *[
            (start.getField(c) + F.try_divide(F.sum((F.col(f"m_{c}") - start.getField(c)) * F.col(f"n_{c}")), F.sum(f"n_{c}"))).alias(f"c_{c}")
            for c in columns
        ],
    )
    apart = join_checked(rows, centres, group, weight="_held")
    merged = []
    for c in columns:
        n, d = F.sum(f"n_{c}"), F.col(f"m_{c}") - F.col(f"c_{c}")
        off = F.try_divide(F.sum(d * F.col(f"n_{c}")), n)
        spread = F.sum(F.col(f"q_{c}") + F.col(f"n_{c}") * d * d) - n * off * off
        merged += [
            (F.max(f"c_{c}") + off).alias(f"mean_{c}"),
            F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1))).alias(f"sd_{c}"),
        ]
    return apart.groupBy(*group).agg(*merged).select(*keys, *[m for c in columns for m in (f"mean_{c}", f"sd_{c}")], "grouping")


def zscore(df: DataFrame, columns: Sequence[str], prefix: str = "z_") -> DataFrame:
    """Standardise over the whole table; missing where the spread is zero.

    Mean and sd come from one scalar subquery, so no row leaves its partition.
    """
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
        ).alias("s")
    ).select("s").scalar()
    return df.withColumns(
        {
            f"{prefix}{c}": F.when(
                stats.getField(f"s_{c}") > 0,
                (F.col(c) - stats.getField(f"m_{c}")) / stats.getField(f"s_{c}"),
            )
            for c in columns
        }
    )


def zscore_within(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], prefix: str = "z_"
) -> DataFrame:
    """Standardise within groups; missing for a group of one or without spread.

    Group statistics are joined back instead of taken over a window, so a hot
    group is never gathered in one task.
    """
    stats = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns],
        F.count(F.lit(1)).alias("_held"),
    )
    joined = join_checked(df, stats, by, weight="_held")
    scored = joined.withColumns(
        {
            f"{prefix}{c}": F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))
            for c in columns
        }
    )
    return scored.drop(*[f"_{k}_{c}" for k in "ms" for c in columns])


def mean_via_lookup(
    rows: DataFrame, key: str, value: str, lookup: DataFrame, by: Sequence[str], and_by: Sequence[str] = ()
) -> DataFrame:
    """Mean of ``value`` per attribute of a lookup table, rows without an entry left out.

    Rows are reduced to one sum and count per key (and ``and_by``) before the join,
    so a hot key reaches it as a single row.
    """
    partial = rows.groupBy(key, *and_by).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_valid"), F.count(F.lit(1)).alias("_n")
    )
    return (
        partial.join(lookup.select(key, *by), key, "inner")
        .groupBy(*by, *and_by)
        .agg(
            F.try_divide(F.sum("_sum"), F.sum("_valid")).alias(f"mean_{value}"),
            F.sum("_n").alias("n"),
        )
    )
