"""The tables behind box plots, histograms, bars with errors, scatters and fitted lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotflux.functions.pvalues import t_quantile
from plotflux.operators.orderstats import HELD_VALUES, WINDOW_ROWS, column_quantiles, quantiles
from plotflux.operators.rollup import error_bars, summarise
from plotflux.session import join_checked

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _number(column: str):
    """The column as a double; NaN counts as missing, as it does for order statistics."""
    return F.nullif(F.col(column).cast("double"), F.lit(float("nan")))


def column_profile(df: DataFrame, columns: Sequence[str], held_values: int = HELD_VALUES) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing count, one row per column.

    All columns are worked out side by side, in a few aggregations over the rows as they lie.
    """
    also = {"min": F.min, "mean": F.avg, "max": F.max, "n_missing": lambda v: F.count_if(v.isNull())}
    found = column_quantiles(df, columns, QUARTILES, also, held_values)
    names = ("min", "q1", "median", "mean", "q3", "max", "n_missing")
    rows = [(c, *[found[c][n] for n in names]) for c in columns]
    return df.sparkSession.createDataFrame(
        rows, "column string, min double, q1 double, median double, mean double, q3 double, max double, n_missing long"
    )


def box_table(
    df: DataFrame, by: Sequence[str], value: str, reach: float = 1.5, window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Quartiles, whisker ends and number of outliers per group.

    A whisker ends at the last value within ``reach`` quartile distances, or at
    the quartile when no value lies between.
    """
    boxes = quantiles(df, value, QUARTILES, by, window_rows)
    joined = join_checked(df.select(*by, _number(value).alias(value)), boxes, by, "inner")
    v, spread = F.col(value), F.col("q3") - F.col("q1")
    inside = v.between(F.col("q1") - spread * reach, F.col("q3") + spread * reach)
    same = ["n", *QUARTILES]
    return (
        joined.where(v.isNotNull())
        .groupBy(*by)
        .agg(
            *[F.max(c).alias(c) for c in same],
            F.min(F.when(inside, v)).alias("_low"),
            F.max(F.when(inside, v)).alias("_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
        .select(
            *by,
            *same,
            F.least("_low", "q1").alias("lower_whisker"),
            F.greatest("_high", "q3").alias("upper_whisker"),
            "n_outliers",
        )
    )


def histogram_table(df: DataFrame, value: str, bins: int | None = 30) -> DataFrame:
    """Counts in bins of equal width between minimum and maximum.

    ``bins=None`` takes the square root of the number of rows, rounded up. The
    maximum belongs to the last bin; empty bins are not listed.
    """
    v = F.col(value).cast("double")
    stats = df.agg(
        F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(F.lit(1)).alias("n")).alias("s")
    ).select("s").scalar()
    lo, hi = stats.getField("lo"), stats.getField("hi")
    k = F.lit(bins) if bins else F.ceil(F.sqrt(stats.getField("n"))).cast("int")
    share = F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.0)
    width = (hi - lo) / k
    return (
        df.where(v.isNotNull())
        .groupBy(F.least(F.floor(share * k).cast("int"), k - 1).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "bin",
            (lo + F.col("bin") * width).alias("bin_start"),
            (lo + (F.col("bin") + 1) * width).alias("bin_end"),
            "n",
        )
    )


def bar_table(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Height of mean bars."""
    return summarise(df, by, {value: "value"}, ("mean",))


def error_bar_table(
    df: DataFrame, by: Sequence[str], value: str, half: str = "se", se_n: str = "rows"
) -> DataFrame:
    """Mean with error bars of one ``se`` or ``sd``."""
    made = summarise(df, by, {value: "value"}, ("mean", half), se_n=se_n, count=True)
    return error_bars(made, "mean_value", f"{half}_value")


def scatter_table(df: DataFrame, x: str, y: str, *aesthetics: str) -> DataFrame:
    """Complete (x, y) pairs with their colour and facet columns."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y, *aesthetics)


def smooth_lines(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line per group and what its confidence band needs."""
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_avgx(y, x).alias("mean_x"),
        F.regr_sxx(y, x).alias("sxx"),
        F.sqrt(
            F.greatest(
                F.try_divide(
                    F.regr_syy(y, x) - F.try_divide(F.regr_sxy(y, x) * F.regr_sxy(y, x), F.regr_sxx(y, x)),
                    F.regr_count(y, x) - 2,
                ),
                F.lit(0.0),
            )
        ).alias("sigma"),
        F.min(F.when(F.col(y).isNotNull(), F.col(x))).alias("min_x"),
        F.max(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(x))).alias("max_x"),
    )


def smooth_band(lines: DataFrame, by: Sequence[str], points: int = 80, level: float = 0.95) -> DataFrame:
    """Fitted value and confidence limits at evenly spaced x, from ``smooth_lines``."""
    x = F.col("min_x") + (F.col("max_x") - F.col("min_x")) * F.col("_i") / (points - 1)
    d = F.col("x") - F.col("mean_x")
    error = F.col("sigma") * F.sqrt(1 / F.col("n") + F.try_divide(d * d, F.col("sxx")))
    half = F.col("_t") * error
    fit = F.col("intercept") + F.col("slope") * F.col("x")
    # One quantile per line, worked out before the points are.
    lines = lines.withColumn("_t", t_quantile(F.lit(0.5 + level / 2), F.col("n").cast("double") - 2))
    return (
        lines.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", x)
        .withColumns({"fit": fit, "_half": half})
        .select(*by, "x", "fit", (F.col("fit") - F.col("_half")).alias("lower"),
                (F.col("fit") + F.col("_half")).alias("upper"))
    )
