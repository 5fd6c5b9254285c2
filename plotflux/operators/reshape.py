"""Wide to long, long to wide, and treated-against-control contrasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value"
) -> DataFrame:
    """One row per id and column; a missing value keeps its row."""
    return df.unpivot(list(ids), list(columns), name, value)


def to_wide(
    df: DataFrame,
    ids: Sequence[str],
    key: str,
    levels: Sequence[str],
    values: Sequence[str],
    duplicates: str = "error",
) -> DataFrame:
    """One row per id with a column ``{value}_{level}`` for every value and level.

    The levels are given, so no extra job looks for them, and one aggregation
    fills all columns. ``duplicates`` says what a repeated (id, level) does:
    ``error`` stops the job, ``mean`` or ``max`` merges.
    """
    merge = {"error": F.max, "max": F.max, "mean": F.avg}[duplicates]
    aggregates = []
    for v in values:
        for level in levels:
            hit = F.col(key) == level
            picked = merge(F.when(hit, F.col(v)))
            if duplicates == "error":
                problem = F.raise_error(F.lit(f"several rows for one id at {key} = {level}"))
                picked = F.when(F.count(F.when(hit, 1)) > 1, problem).otherwise(picked)
            aggregates.append(picked.alias(f"{v}_{level}"))
    return df.groupBy(*ids).agg(*aggregates)


def wide_means(
    df: DataFrame,
    ids: Sequence[str | Column],
    key: str,
    levels: Sequence[str],
    columns: Sequence[str] | Mapping[str, str],
    na_rm: bool = True,
) -> DataFrame:
    """Group means per level side by side: ``{name}_{level}``, with one shuffle.

    Gives what grouping by (ids, key) and then ``to_wide`` gives, but every reading
    goes straight into the column of its level.
    """
    names = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    aggregates = []
    for c, name in names.items():
        for level in levels:
            hit = F.col(key) == level
            value = F.avg(F.when(hit, F.col(c)))
            if not na_rm:
                value = F.when(F.count_if(hit & F.col(c).isNull()) == 0, value)
            aggregates.append(value.alias(f"{name}_{level}"))
    return df.groupBy(*ids).agg(*aggregates)


def contrast(
    wide: DataFrame,
    columns: Sequence[str] | Mapping[str, str],
    kind: str = "difference",
    treated: str = "warming",
    control: str = "control",
) -> DataFrame:
    """Treated against control for measures already side by side.

    ``difference`` is treated - control, ``percent`` the change in percent of
    control, ``ratio`` treated / control; a zero control gives missing.
    Results are named by the mapping, by default ``d_{measure}``.
    """
    names = columns if isinstance(columns, Mapping) else {c: f"d_{c}" for c in columns}
    made = {}
    for c, name in names.items():
        w, k = F.col(f"{c}_{treated}"), F.col(f"{c}_{control}")
        made[name] = {
            "difference": w - k,
            "percent": F.try_divide(w - k, k) * 100,
            "ratio": F.try_divide(w, k),
        }[kind]
    return wide.withColumns(made)
