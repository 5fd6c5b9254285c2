"""Tukey outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotflux.operators.orderstats import WINDOW_ROWS, hinges
from plotflux.session import join_checked


def tukey_fences(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    reach: float = 1.5,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Hinges and the fences ``reach`` hinge spreads beyond them, per group."""
    spread = F.col("upper_hinge") - F.col("lower_hinge")
    return hinges(df, value, by, window_rows).withColumns(
        {
            "lower_fence": F.col("lower_hinge") - spread * reach,
            "upper_fence": F.col("upper_hinge") + spread * reach,
        }
    )


def outlier_rows(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    reach: float = 1.5,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """The rows beyond the fences of their group, whole, with the fences.

    Rows are identified by their own key columns; a frame has no row numbers.
    """
    fences = tukey_fences(df, value, by, reach, window_rows).select(*by, "lower_fence", "upper_fence")
    v = F.col(value)
    if by:
        joined = join_checked(df, fences, by, "inner")
    else:
        bounds = fences.select(F.struct("lower_fence", "upper_fence").alias("s")).scalar()
        joined = df.withColumns(
            {"lower_fence": bounds.getField("lower_fence"), "upper_fence": bounds.getField("upper_fence")}
        )
    return joined.where((v < F.col("lower_fence")) | (v > F.col("upper_fence")))
