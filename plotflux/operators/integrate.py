"""Area under a time curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trapezoid(
    df: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    name: str = "area",
    span: float = 720.0,
) -> DataFrame:
    """Trapezoid sum of ``y`` over ``x`` per group, missing points skipped.

    Readings at the same ``x`` are averaged first, which also combines rows
    before the shuffle. Each group is cut in stretches of ``span`` units of ``x``
    (30 days when ``x`` is in hours): areas are summed inside every stretch, then
    the gaps between stretches are added from their end points. No task holds
    more than one stretch of one group. A group with a single point has area 0.
    """
    px, py = F.col("_x"), F.col("_y")
    points = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(x).cast("double").alias("_x"))
        .agg(F.avg(y).alias("_y"))
        .withColumn("_stretch", F.floor(px / span))
    )
    inside = Window.partitionBy(*by, "_stretch").orderBy("_x")
    pieces = (
        points.withColumns({"_x2": F.lead(px).over(inside), "_y2": F.lead(py).over(inside)})
        .groupBy(*by, "_stretch")
        .agg(
            F.coalesce(F.sum((F.col("_x2") - px) * (py + F.col("_y2")) / 2), F.lit(0.0)).alias("_area"),
            F.min(F.struct("_x", "_y")).alias("_first"),
            F.max(F.struct("_x", "_y")).alias("_last"),
        )
    )
    along = Window.partitionBy(*by).orderBy("_stretch")
    following = F.lead("_first").over(along)
    gap = (following["_x"] - F.col("_last._x")) * (F.col("_last._y") + following["_y"]) / 2
    return (
        pieces.withColumn("_gap", F.coalesce(gap, F.lit(0.0)))
        .groupBy(*by)
        .agg(F.sum(F.col("_area") + F.col("_gap")).alias(name))
    )
