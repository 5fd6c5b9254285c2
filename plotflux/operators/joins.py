"""Natural, keyed and chained joins with R's rule that a missing key matches a missing key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotflux.session import full_join, null_safe_join, salted_join


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """The names a natural join would use, for the caller to check."""
    return [c for c in left.columns if c in right.columns]


def require_unique(df: DataFrame, on: Sequence[str], side: str) -> None:
    """Raise when a key occurs twice. Runs one aggregation that stops at the first find."""
    repeated = df.groupBy(*on).count().where(F.col("count") > 1).limit(1)
    if not repeated.isEmpty():
        raise ValueError(f"keys {list(on)} are not unique on the {side} side")


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    relationship: str = "many-to-many",
    salts: int = 1,
) -> DataFrame:
    """Join on named keys, null-safely.

    ``relationship`` other than many-to-many checks key uniqueness first.
    ``salts`` above 1 splits every key of the left side in that many parts for a
    left side with a hot key and a right side too large to broadcast. A full join
    finds its hot keys itself.
    """
    if relationship.endswith("to-one"):
        require_unique(right, on, "right")
    if relationship.startswith("one-to"):
        require_unique(left, on, "left")
    if salts > 1:
        return salted_join(left, right, on, how, salts)
    if how == "full":
        return full_join(left, right, on)
    return null_safe_join(left, right, on, how)


def natural_join(
    left: DataFrame,
    right: DataFrame,
    how: str = "left",
    relationship: str = "many-to-many",
    salts: int = 1,
) -> DataFrame:
    """Join on all shared column names."""
    on = shared_columns(left, right)
    if not on:
        raise ValueError("the frames share no column")
    return keyed_join(left, right, on, how, relationship, salts)


def join_chain(base: DataFrame, parts: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Fold left joins into one wide row per key of ``base``.

    Parts are aggregated to the key beforehand; when that key is the join key,
    their partitioning is reused and only the base moves.
    """
    for right, on in parts:
        base = keyed_join(base, right, on, "left")
    return base
