"""Registration of queries, and the test tables in the roles of the experiment."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotflux.functions.scalars import censor, compound_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, key: str | None = None):
    """Register a query under ``key`` or its function name; ``sql`` gives the same result."""

    def register(function):
        name = key or function.__name__
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = nudged(sql)
        return function

    return register


def nudge(digits: int) -> str:
    """A little over a thousandth of the last digit kept.

    Added on both sides before rounding, so that values exactly between two digits
    go the same way whatever the order of summation.
    """
    return f"1.3e-{digits + 3}"


def nudged(sql: str) -> str:
    """Add the nudge inside every ``round(x, digits)``."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, i, comma = 1, start + 6, None
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        digits = int(sql[comma + 1 : i - 1])
        inner = nudged(sql[start + 6 : comma])
        out.append(f"{sql[at:start]}round(({inner}) + {nudge(digits)}, {digits})")
        at = i
    return "".join(out) + sql[at:]


def f_tail(f: str, df1: str, df2: str, steps: int = 2000) -> str:
    """SQL of the upper tail of an F statistic, by Simpson's rule.

    With tan^2(a) = df1 f / df2 the distribution function is the integral of sin^(df1-1) cos^(df2-1) from 0
    to a, over half the beta function; what lies far beyond the bulk adds nothing and is left out.
    """
    top = f"least(atan(sqrt({df1} * {f} / {df2})), (sqrt({df1}) + 14) / sqrt({df2}))"
    at = f"({top} * i / {steps})"
    weight = f"(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    value = f"{weight} * power(sin{at}, {df1} - 1) * power(cos{at}, {df2} - 1)"
    area = f"list_sum([{value} FOR i IN range(0, {steps} + 1)]) * {top} / {3 * steps}"
    half_beta = f"exp(lgamma({df1} / 2.0) + lgamma({df2} / 2.0) - lgamma(({df1} + {df2}) / 2.0)) / 2"
    return f"greatest(1 - ({area}) / ({half_beta}), 0)"


def t_tail(t: str, df: str) -> str:
    """SQL of the two-sided p-value of a t statistic."""
    return f_tail(f"(({t}) * ({t}))", "1", f"({df})")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: Mapping[str, int] | int, *columns: str) -> DataFrame:
    """Round doubles so that the order of summation does not show."""
    if not isinstance(digits, Mapping):
        digits = {c: digits for c in columns}
    return df.withColumns({c: F.round(F.col(c) + F.lit(float(nudge(d))), d) for c, d in digits.items()})


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Events as readings of 150 plots: odd users are warmed, even ones their controls.

    Values above 200 count as missing, so that missing values occur.
    """
    warm = F.col("user_id") % 2 == 1
    pair = F.floor(F.col("user_id") / 2)
    return (
        table(spark, folder, "events")
        .select(
            "event_id",
            "ts",
            F.col("user_id").alias("plot"),
            pair.alias("pair"),
            (pair % 4 + 1).alias("block"),
            F.when(warm, "warming").otherwise("control").alias("treatment"),
            F.when(warm, "war").otherwise("con").alias("trt"),
            F.col("event_type").alias("channel"),
            censor("value", upper=200.0).alias("value"),
            F.get_json_object("props", "$.k").try_cast("int").alias("k"),
        )
        .withColumn("collar", compound_key("block", "pair", "trt"))
    )


READINGS = """readings AS (
  SELECT event_id, ts, user_id AS plot, user_id // 2 AS pair, (user_id // 2) % 4 + 1 AS block,
    CASE WHEN user_id % 2 = 1 THEN 'warming' ELSE 'control' END AS treatment,
    event_type AS channel, CASE WHEN value <= 200 THEN value END AS value,
    CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
    ((user_id // 2) % 4 + 1) || '-' || (user_id // 2) || '-'
      || CASE WHEN user_id % 2 = 1 THEN 'war' ELSE 'con' END AS collar
  FROM events)"""


def fluxes(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as flux observations; the flux in thousands."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("collar"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_shipdate").cast("date").alias("day"),
        (F.col("l_extendedprice") / 1000).alias("flux"),
        F.col("l_discount").alias("quality"),
        F.col("l_quantity").alias("temperature"),
        F.col("l_tax").alias("moisture"),
        F.col("l_returnflag").alias("treatment"),
        F.col("l_linestatus").alias("season"),
    )


FLUXES = """fluxes AS (
  SELECT l_suppkey AS collar, l_shipdate AS ts, CAST(l_shipdate AS DATE) AS day,
    l_extendedprice / 1000 AS flux, l_discount AS quality, l_quantity AS temperature,
    l_tax AS moisture, l_returnflag AS treatment, l_linestatus AS season
  FROM lineitem)"""
