"""Session settings, the shared checkpoint folder, and size-checked joins."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when rows x columns was counted to be at most this.
BROADCAST_CELLS = 2_000_000


def build_session(app: str = "plotflux", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is written for.

    ANSI mode stays on, wall times are kept apart from the session zone by
    pinning it to UTC, and AQE handles partition sizes and skewed joins even
    where splitting a skewed partition costs one more exchange.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Statistics tables in the checkpoint folder go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; make one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="plotflux-checkpoint-"))
    else:
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a folder every executor can reach"
        )


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there.

    Used for small statistics tables that later steps read more than once: every
    step then sees the same numbers, also when executors are lost and tasks rerun.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", hint: bool = False
) -> DataFrame:
    """Join on named keys under R's rule that a missing key matches a missing key.

    The right side is renamed first, so frames that stem from one another can be
    joined. The result has the columns of ``left``, then those of ``right`` that are
    not keys; a full join fills the keys from either side. ``hint`` broadcasts
    ``right`` and is for sides whose size the caller has checked.
    """
    extra = [c for c in right.columns if c not in on]
    renamed = right.select(
        *[F.col(c).alias(f"_key_{c}") for c in on], *[F.col(c).alias(f"_of_{c}") for c in extra]
    )
    if hint:
        renamed = F.broadcast(renamed)
    condition = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_key_{c}"))
        condition = same if condition is None else condition & same
    joined = left.join(renamed, condition, how)
    keys = {c: F.coalesce(c, f"_key_{c}").alias(c) for c in on} if how == "full" else {}
    return joined.select(
        *[keys.get(c, F.col(c)) for c in left.columns], *[F.col(f"_of_{c}").alias(c) for c in extra]
    )


def row_salt(df: DataFrame, salts: int) -> Column:
    """Salt that spreads even identical rows, and is the same when a task reruns."""
    return F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in df.columns]), F.lit(salts))


def salted_join(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", salts: int = 32
) -> DataFrame:
    """Join a possibly hot-keyed ``rows`` to ``lookup`` with each key split in ``salts`` parts.

    ``lookup`` is repeated once per salt, so no key's rows meet in one task.
    """
    if how not in ("inner", "left"):
        raise ValueError("a salted join is 'inner' or 'left'")
    left = rows.withColumn("_salt", row_salt(rows, salts))
    every = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    right = lookup.withColumn("_salt", F.explode(every))
    return null_safe_join(left, right, [*on, "_salt"], how).drop("_salt")


def hot_key_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    weight: str | None = None,
    hot_share: float = 0.001,
    salts: int = 64,
) -> DataFrame:
    """Join rows of any key distribution to a lookup of one row per key, copying no lookup row.

    Keys above ``hot_share`` of all rows, so at most ``1 / hot_share`` of them, get their lookup rows by
    broadcast; only the others are looked up by a shuffle. Rows that the broadcast has served are
    spread by a salt that matches nothing. ``weight`` names the lookup column with the number of rows
    per key, and is left out of the result; without it the rows' keys are counted first (combined
    before the shuffle), so ``rows`` is read twice. Missing keys match missing keys.
    """
    if how not in ("inner", "left"):
        raise ValueError("a hot-key join is 'inner' or 'left'")
    extra = [c for c in lookup.columns if c not in on and c != weight]
    keys = [F.col(f"`{c}`") for c in on]
    if weight is None:
        counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_held"))
        total = rows.count()
    else:
        counted = lookup.select(*keys, F.col(f"`{weight}`").alias("_held"))
        total = lookup.agg(F.sum(F.col(f"`{weight}`")).alias("t")).scalar()
        lookup = lookup.drop(weight)
    hot_keys = durable(counted.where(F.col("_held") > total * hot_share).drop("_held"))
    if hot_keys.isEmpty():
        return null_safe_join(rows, lookup, on, how)
    hot = null_safe_join(lookup, hot_keys.withColumn("_is_hot", F.lit(True)), on, "inner", hint=True)
    names = {c: f"_hot_{c}" for c in extra}
    hot = hot.select(*keys, *[F.col(f"`{c}`").alias(n) for c, n in names.items()], "_is_hot")
    served = null_safe_join(rows, hot, on, "left", hint=True)
    salt = F.when(F.col("_is_hot"), row_salt(rows, salts) + 1).otherwise(F.lit(0).cast("long"))
    cold = lookup.withColumns({"_salt": F.lit(0).cast("long"), "_is_cold": F.lit(True)})
    joined = null_safe_join(served.withColumn("_salt", salt), cold, [*on, "_salt"], "left")
    if how == "inner":
        joined = joined.where(F.col("_is_hot") | F.col("_is_cold"))
    return joined.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        *[F.when(F.col("_is_hot"), F.col(f"`{n}`")).otherwise(F.col(f"`{c}`")).alias(c) for c, n in names.items()],
    )


def join_checked(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_cells: int = BROADCAST_CELLS,
    weight: str | None = None,
) -> DataFrame:
    """Attach a statistics table with one row per key to rows without trusting its size.

    ``lookup`` is written to the checkpoint folder and counted. Within ``max_cells`` it is broadcast,
    so the rows are not shuffled at all; beyond, only the lookup rows of hot keys are (``hot_key_join``).
    ``weight`` names the lookup column with the number of rows per key, where there is one.
    """
    lookup = durable(lookup)
    if lookup.count() * len(lookup.columns) <= max_cells:
        return null_safe_join(rows, lookup.drop(weight) if weight else lookup, on, how, hint=True)
    return hot_key_join(rows, lookup, on, how, weight)


def _hot_keys(left: DataFrame, right: DataFrame, on: Sequence[str], hot_share: float, least: int) -> tuple[DataFrame, DataFrame]:
    """Counted keys with too many rows on a side, and into how many parts each side's rows of them are to go."""
    keys = [F.col(f"`{c}`") for c in on]
    sides = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionAll(
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    counted = sides.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    bounds = {"_l": max(int(left.count() * hot_share), least), "_r": max(int(right.count() * hot_share), least)}
    hot = durable(counted.where((F.col("_l") > bounds["_l"]) | (F.col("_r") > bounds["_r"])))
    shares = [F.greatest(F.ceil(F.col(c) / max(b, 1)), F.lit(1)).cast("long").alias(f"{c}_parts") for c, b in bounds.items()]
    return hot, hot.select(*keys, *shares)


def _split_join(left: DataFrame, right: DataFrame, on: Sequence[str], parts: DataFrame, how: str) -> tuple[DataFrame, DataFrame]:
    """The join of cold keys (``how``), and the matching pairs of hot ones, dealt on a grid of their parts."""
    marked_left = null_safe_join(left, parts, on, "left", hint=True)
    marked_right = null_safe_join(right, parts, on, "left", hint=True)
    cold = null_safe_join(
        marked_left.where("_l_parts is null").drop("_l_parts", "_r_parts"),
        marked_right.where("_l_parts is null").drop("_l_parts", "_r_parts"),
        on,
        how,
    )

    def dealt(side: DataFrame, rows: DataFrame, mine: str, other: str) -> DataFrame:
        salt = F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in rows.columns]), F.col(f"{mine}_parts"))
        other_parts = F.sequence(F.lit(0).cast("long"), F.col(f"{other}_parts") - 1)
        spread = side.where("_l_parts is not null").withColumns({f"{mine}_at": salt, f"{other}_at": F.explode(other_parts)})
        return spread.drop("_l_parts", "_r_parts")

    met = null_safe_join(
        dealt(marked_left, left, "_l", "_r"), dealt(marked_right, right, "_r", "_l"), [*on, "_l_at", "_r_at"], "inner"
    )
    return cold, met.drop("_l_at", "_r_at")


def inner_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], hot_share: float = 0.01, least: int = 100_000
) -> DataFrame:
    """Inner join, missing keys matching missing keys, in which no key is bound to one task; see ``full_join``."""
    _, parts = _hot_keys(left, right, on, hot_share, least)
    if parts.isEmpty():
        return null_safe_join(left, right, on, "inner")
    cold, met = _split_join(left, right, on, parts, "inner")
    return cold.unionByName(met)


def full_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], hot_share: float = 0.01, least: int = 100_000
) -> DataFrame:
    """Full outer join, missing keys matching missing keys, in which no key is bound to one task.

    The keys of both sides are counted (combined before the shuffle). A key with more than ``hot_share``
    of a side's rows, and more than ``least``, is dealt on a grid: its left rows into ``a`` parts and its right
    rows into ``b``, each pair of parts meeting in a task of its own, so that a part never holds more rows than
    that bound. A side is copied only as often as the other one has parts. Hot keys, at most
    ``2 / hot_share`` of them, also tell which of their rows have no match. Other keys take a plain full join.
    """
    hot, parts = _hot_keys(left, right, on, hot_share, least)
    if hot.isEmpty():
        return null_safe_join(left, right, on, "full")
    cold, met = _split_join(left, right, on, parts, "full")
    # A hot key that one side lacks has no pairs at all; its rows stand alone.
    lonely = hot.where("_l = 0 or _r = 0").select(*[F.col(f"`{c}`") for c in on], F.lit(True).alias("_alone"))
    alone = [null_safe_join(side, lonely, on, "inner", hint=True).drop("_alone") for side in (left, right)]
    rest = met.unionByName(alone[0], allowMissingColumns=True).unionByName(alone[1], allowMissingColumns=True)
    return cold.unionByName(rest.select(*cold.columns))
