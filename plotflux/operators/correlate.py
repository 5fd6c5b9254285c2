"""Correlation matrices and tests in long form."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotflux.functions.pvalues import t_p_value
from plotflux.functions.scalars import numeric_columns
from plotflux.operators.orderstats import WINDOW_ROWS, average_ranks
from plotflux.session import BROADCAST_CELLS, durable, hot_key_join


def _pairs(df: DataFrame, columns: Sequence[str], make) -> DataFrame:
    """One aggregation over all column pairs, turned into one row per pair."""
    entries = F.array(
        *[
            F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"), *make(a, b))
            for a, b in combinations(columns, 2)
        ]
    )
    return df.agg(entries.alias("e")).select(F.inline("e"))


def with_ranks(
    df: DataFrame, columns: Sequence[str], window_rows: int = WINDOW_ROWS, max_cells: int = BROADCAST_CELLS
) -> DataFrame:
    """Replace every column by its average-tie rank.

    The ranks of a column with few distinct values (counted) are broadcast;
    otherwise only the frequent values are, and the rest is joined by value.
    """
    ranks = durable(average_ranks(df, columns, window_rows))
    sizes = dict(ranks.groupBy("column").count().collect())
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    for c in columns:
        lookup = ranks.where(F.col("column") == c).select(
            F.col("value").alias(c), "k", F.col("rank").alias(f"_rank_{c}")
        )
        if sizes.get(c, 0) * 3 <= max_cells:
            rows = rows.join(F.broadcast(lookup.drop("k")), c, "left")
        else:
            rows = hot_key_join(rows, lookup, [c], weight="k")
    return rows.select(*[F.col(f"_rank_{c}").alias(c) for c in columns])


def spearman_matrix(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    window_rows: int = WINDOW_ROWS,
    max_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """Rank correlations over rows complete in all columns: var_x, var_y, n, r.

    Without ``columns`` all numeric columns take part.
    """
    columns = list(columns or numeric_columns(df))
    complete = df.select(*columns).dropna("any")
    ranked = with_ranks(complete, columns, window_rows, max_cells)
    return _pairs(
        ranked, columns, lambda a, b: (F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r"))
    )


def correlation_t(r: Column, n: Column) -> Column:
    return F.try_divide(r * F.sqrt(n - 2), F.sqrt(F.greatest(1 - r * r, F.lit(0.0))))


def pearson_tests(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete correlations with their t statistic: var_x, var_y, n, r, t."""
    columns = list(columns or numeric_columns(df))
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    pairs = _pairs(
        doubles, columns, lambda a, b: (F.regr_count(b, a).alias("n"), F.corr(a, b).alias("r"))
    )
    return pairs.withColumn("t", F.when(F.col("n") > 2, correlation_t(F.col("r"), F.col("n"))))


def with_significance(tests: DataFrame, levels: Sequence[float] = (0.001, 0.05)) -> DataFrame:
    """Add the two-sided p-value and a mark with one star per level it is below."""
    tested = tests.withColumn("p", t_p_value(F.col("t"), F.col("n") - 2))
    stars = F.lit(0)
    for level in levels:
        stars = stars + (F.col("p") < level).cast("int")
    return tested.withColumn("mark", F.repeat(F.lit("*"), stars))


def spearman_tests(df: DataFrame, columns: Sequence[str] | None = None, **sizes) -> DataFrame:
    """Rank correlations with the p-values that belong to them."""
    matrix = spearman_matrix(df, columns, **sizes)
    return with_significance(matrix.withColumn("t", correlation_t(F.col("r"), F.col("n"))))
