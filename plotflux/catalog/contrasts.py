"""Reshaping and treated-against-control contrasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotflux.catalog.registry import FLUXES, READINGS, fluxes, query, readings, rounded, table
from plotflux.functions.scalars import hour_floor
from plotflux.operators.reshape import contrast, to_long, to_wide, wide_means
from plotflux.operators.rollup import daily_rollup, summarise


@query(" UNION ALL ".join(
    f"SELECT l_orderkey, l_linenumber, '{c}' AS channel, {v} AS reading FROM lineitem"
    for c, v in (("l_quantity", "l_quantity"), ("l_discount", "l_discount"),
                 ("tax", "CASE WHEN l_tax > 0.02 THEN l_tax END"))))
def unpivot_channels(spark, folder):
    items = table(spark, folder, "lineitem").withColumn("tax", F.when(F.col("l_tax") > 0.02, F.col("l_tax")))
    kept = items.drop("l_tax", "l_shipdate")
    return to_long(kept, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "tax"], "channel", "reading")


_PAIR_DAYS = """pd AS (
  SELECT block, pair, CAST(ts AS DATE) AS day, treatment, avg(value) AS v, avg(k) AS k FROM readings GROUP BY 1, 2, 3, 4),
w AS (
  SELECT block, pair, day, max(CASE WHEN treatment = 'control' THEN v END) AS vc, max(CASE WHEN treatment = 'warming' THEN v END) AS vw,
    max(CASE WHEN treatment = 'control' THEN k END) AS kc, max(CASE WHEN treatment = 'warming' THEN k END) AS kw
  FROM pd GROUP BY 1, 2, 3)"""
_SIDES = ["control", "warming"]


def _pair_days(spark, folder):
    r = readings(spark, folder).withColumn("day", F.col("ts").cast("date"))
    return wide_means(
        r, ["block", "pair", "day"], "treatment", _SIDES, {"value": "mean_value", "k": "mean_k"}
    )


@query(f"""WITH {READINGS}, {_PAIR_DAYS}
SELECT block, pair, day, round(vc, 6) AS mean_value_control, round(vw, 6) AS mean_value_warming FROM w""")
def pivot_one_key(spark, folder):
    means = daily_rollup(readings(spark, folder), ["block", "pair", "treatment"], "ts", ["value"])
    out = to_wide(means, ["block", "pair", "day"], "treatment", _SIDES, ["mean_value"])
    return rounded(out, 6, "mean_value_control", "mean_value_warming")


_FLAGS = ("A", "N", "R")
_WIDE = ("flux", "temperature", "moisture", "quality")


@query(f"""WITH {FLUXES}, m AS (
  SELECT collar, season, treatment, {", ".join(f"avg({c}) AS {c}" for c in _WIDE)} FROM fluxes GROUP BY 1, 2, 3)
SELECT collar, season, {", ".join(
    f"round(max(CASE WHEN treatment = '{t}' THEN {c} END), 6) AS mean_{c}_{t}" for c in _WIDE for t in _FLAGS)}
FROM m GROUP BY 1, 2""")
def pivot_many_values(spark, folder):
    values = [f"mean_{c}" for c in _WIDE]
    out = wide_means(
        fluxes(spark, folder), ["collar", "season"], "treatment", _FLAGS, dict(zip(_WIDE, values))
    )
    return rounded(out, 6, *[f"{v}_{t}" for v in values for t in _FLAGS])


_BLOCK_HOURS = """bh AS (
  SELECT block, date_trunc('hour', ts) AS hour_start, treatment,
    CASE WHEN count(value) = count(*) THEN avg(value) END AS v, avg(k) AS k FROM readings GROUP BY 1, 2, 3),
diff AS (
  SELECT block, hour_start,
    max(CASE WHEN treatment = 'warming' THEN v END) - max(CASE WHEN treatment = 'control' THEN v END) AS d_value,
    max(CASE WHEN treatment = 'warming' THEN k END) - max(CASE WHEN treatment = 'control' THEN k END) AS d_k
  FROM bh GROUP BY 1, 2)"""


def _block_hour_differences(spark, folder):
    wide = wide_means(
        readings(spark, folder).withColumn("hour_start", hour_floor("ts")), ["block", "hour_start"],
        "treatment", _SIDES, {"value": "mean_value", "k": "mean_k"}, na_rm=False,
    )
    return contrast(wide, {"mean_value": "d_value", "mean_k": "d_k"})


@query(f"""WITH {READINGS}, {_BLOCK_HOURS}
SELECT block, hour_start, round(d_value, 6) AS d_value, round(d_k, 6) AS d_k FROM diff""")
def diff_contrast(spark, folder):
    out = _block_hour_differences(spark, folder).select("block", "hour_start", "d_value", "d_k")
    return rounded(out, 6, "d_value", "d_k")


@query(f"""WITH {READINGS}, {_PAIR_DAYS}
SELECT block, pair, day, round((vw - vc) / nullif(vc, 0) * 100, 4) AS d_value, round((kw - kc) / nullif(kc, 0) * 100, 4) AS d_k
FROM w""")
def pct_change_contrast(spark, folder):
    made = contrast(_pair_days(spark, folder), {"mean_value": "d_value", "mean_k": "d_k"}, "percent")
    return rounded(made.select("block", "pair", "day", "d_value", "d_k"), 4, "d_value", "d_k")


@query(f"""WITH {READINGS}, {_PAIR_DAYS}
SELECT block, pair, day, round(vw / nullif(vc, 0), 6) AS d_value, round(kw / nullif(kc, 0), 6) AS d_k FROM w""")
def ratio_contrast(spark, folder):
    made = contrast(_pair_days(spark, folder), {"mean_value": "d_value", "mean_k": "d_k"}, "ratio")
    return rounded(made.select("block", "pair", "day", "d_value", "d_k"), 6, "d_value", "d_k")


@query(f"""WITH {READINGS}, {_BLOCK_HOURS}, long AS (
  SELECT CAST(hour(hour_start) AS INTEGER) AS hour, 'd_value' AS sensor, d_value AS difference FROM diff
  UNION ALL SELECT CAST(hour(hour_start) AS INTEGER), 'd_k', d_k FROM diff)
SELECT hour, sensor, round(avg(difference), 6) AS mean_difference, round(stddev_samp(difference), 6) AS sd_difference
FROM long GROUP BY 1, 2""")
def contrast_profile(spark, folder):
    differences = _block_hour_differences(spark, folder).withColumn("hour", F.hour("hour_start"))
    long = to_long(differences, ["hour"], ["d_value", "d_k"], "sensor", "difference")
    out = summarise(long, ["hour", "sensor"], ["difference"])
    return rounded(out, 6, "mean_difference", "sd_difference")
