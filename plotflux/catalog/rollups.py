"""Means, spreads, roll-ups, profiles, boxes, histograms, integrals, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotflux.catalog.registry import fluxes, FLUXES, query, READINGS, readings, rounded, t_tail, table
from plotflux.functions.bins import day_or_night, season_by_date, season_by_month
from plotflux.functions.scalars import hours_since_epoch, with_date_parts
from plotflux.operators import charts
from plotflux.operators.clean import campaign_lookup
from plotflux.operators.integrate import trapezoid
from plotflux.operators.outliers import outlier_rows, tukey_fences
from plotflux.operators.rollup import (
    daily_rollup,
    hourly_rollup,
    mean,
    mean_of_means,
    mean_via_lookup,
    measures,
    sd,
    se,
    summarise,
    summary_sets,
    total,
    zscore,
    zscore_within,
)


@query(f"""WITH {READINGS}
SELECT block, channel, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS sd_value
FROM readings GROUP BY block, channel""")
def group_mean_sd(spark, folder):
    out = summarise(readings(spark, folder), ["block", "channel"], ["value"])
    return rounded(out, 6, "mean_value", "sd_value")


@query(f"""WITH {READINGS}
SELECT collar, CAST(ts AS DATE) AS day,
  round(CASE WHEN count(value) = count(*) THEN avg(value) END, 6) AS mean_value
FROM readings GROUP BY 1, 2""")
def group_mean_strict(spark, folder):
    out = daily_rollup(readings(spark, folder), ["collar"], "ts", ["value"], na_rm=False)
    return rounded(out, 6, "mean_value")


@query(f"""WITH {READINGS}, g AS (
  SELECT block, treatment, channel, avg(value) AS m, stddev_samp(value) / sqrt(count(*)) AS e, count(*) AS n
  FROM readings GROUP BY 1, 2, 3)
SELECT block, treatment, channel, round(m, 6) AS mean_value, round(e, 6) AS se_value,
  round(m - e, 6) AS lower, round(m + e, 6) AS upper, n FROM g""")
def group_mean_se(spark, folder):
    out = charts.error_bar_table(readings(spark, folder), ["block", "treatment", "channel"], "value")
    return rounded(out, 6, "mean_value", "se_value", "lower", "upper")


@query(f"""WITH {READINGS}
SELECT treatment, channel, round(stddev_samp(value) / sqrt(count(value)), 6) AS se_value,
  count(*) AS n, count(value) AS valid
FROM readings GROUP BY 1, 2""")
def group_se_valid(spark, folder):
    out = readings(spark, folder).groupBy("treatment", "channel").agg(
        se("value", n="valid").alias("se_value"), F.count(F.lit(1)).alias("n"), F.count("value").alias("valid")
    )
    return rounded(out, 6, "se_value")


@query(f"""WITH {READINGS}, r AS (
  SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'wet' ELSE 'dry' END AS season,
    CASE WHEN hour(ts) BETWEEN 7 AND 20 THEN 'day' ELSE 'night' END AS timeofday FROM readings)
SELECT CASE grouping(season, timeofday, treatment) WHEN 3 THEN 'season' WHEN 5 THEN 'timeofday'
    WHEN 6 THEN 'treatment' WHEN 4 THEN 'timeofday x treatment' WHEN 2 THEN 'season x treatment' END AS grouping,
  season, timeofday, treatment,
  round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS sd_value,
  round(avg(k), 6) AS mean_k, round(stddev_samp(k), 6) AS sd_k
FROM r GROUP BY GROUPING SETS
  ((season), (timeofday), (treatment), (timeofday, treatment), (season, treatment))""")
def summary_grouping_sets(spark, folder):
    r = readings(spark, folder).withColumns(
        {"season": season_by_date(F.col("ts").cast("date"), "2024-01-16"), "timeofday": day_or_night("ts")}
    )
    sets = {
        "season": ["season"],
        "timeofday": ["timeofday"],
        "treatment": ["treatment"],
        "timeofday x treatment": ["timeofday", "treatment"],
        "season x treatment": ["season", "treatment"],
    }
    out = summary_sets(r, sets, ["value", "k"])
    return rounded(out, 6, "mean_value", "sd_value", "mean_k", "sd_k")


@query(f"""WITH {FLUXES}
SELECT treatment, {", ".join(
    f"round(avg({c}), 6) AS mean_{c}, round(stddev_samp({c}), 6) AS sd_{c}"
    for c in ("flux", "quality", "temperature", "moisture"))}
FROM fluxes GROUP BY treatment""")
def treatment_means(spark, folder):
    columns = ["flux", "quality", "temperature", "moisture"]
    out = summarise(fluxes(spark, folder), ["treatment"], columns)
    return rounded(out, 6, *[f"{s}_{c}" for c in columns for s in ("mean", "sd")])


@query(f"""WITH {FLUXES}
SELECT {", ".join(
    f"round(avg({c}), 6) AS mean_{c}, round(stddev_samp({c}), 6) AS sd_{c}"
    for c in ("flux", "quality", "temperature", "moisture"))},
  round(sum(flux), 3) AS total_flux,
  coalesce(sum(CASE WHEN temperature > 1000 THEN temperature END), 0.0) AS total_none
FROM fluxes""")
def overall_means(spark, folder):
    columns = ["flux", "quality", "temperature", "moisture"]
    f = fluxes(spark, folder).withColumn(
        "none", F.when(F.col("temperature") > 1000, F.col("temperature"))
    )
    out = f.agg(*measures(columns), total("flux").alias("total_flux"), total("none").alias("total_none"))
    return rounded(
        out, {**{f"{s}_{c}": 6 for c in columns for s in ("mean", "sd")}, "total_flux": 3}
    )


@query(f"""WITH {FLUXES}, inner_means AS (
  SELECT collar, treatment, day, avg(flux) AS flux, avg(temperature) AS temperature
  FROM fluxes GROUP BY 1, 2, 3)
SELECT collar, treatment, round(avg(flux), 6) AS mean_flux, round(avg(temperature), 6) AS mean_temperature
FROM inner_means GROUP BY 1, 2""", "mean_of_means")
def mean_of_means_per_collar(spark, folder):
    out = mean_of_means(
        fluxes(spark, folder), ["collar", "treatment", "day"], ["collar", "treatment"],
        ["flux", "temperature"],
    )
    return rounded(out, 6, "mean_flux", "mean_temperature")


@query(f"""WITH {READINGS}
SELECT collar, date_trunc('hour', ts) AS hour_start, CAST(min(hour(ts)) AS INTEGER) AS hour,
  CAST(min(month(ts)) AS INTEGER) AS month, CAST(min(year(ts)) AS INTEGER) AS year,
  round(avg(value), 6) AS mean_value, round(avg(k), 6) AS mean_k, round(stddev_samp(value), 6) AS sd_value
FROM readings GROUP BY 1, 2""", "hourly_rollup")
def hourly_rollup_per_collar(spark, folder):
    out = hourly_rollup(
        readings(spark, folder), ["collar"], "ts", ["value", "k"], extra=[sd("value").alias("sd_value")]
    )
    out = with_date_parts(out, "hour_start").drop("day")
    return rounded(out, 6, "mean_value", "mean_k", "sd_value")


@query(f"""WITH {READINGS}
SELECT block, treatment, CAST(ts AS DATE) AS day, round(avg(value), 6) AS mean_value,
  round(stddev_samp(value), 6) AS sd_value, round(stddev_samp(value) / sqrt(count(*)), 6) AS se_value
FROM readings GROUP BY 1, 2, 3""", "daily_rollup")
def daily_rollup_per_block(spark, folder):
    out = daily_rollup(
        readings(spark, folder), ["block", "treatment"], "ts", ["value"], ("mean", "sd", "se")
    )
    return rounded(out, 6, "mean_value", "sd_value", "se_value")


# Days of 1998 grouped in measurement campaigns, for the test tables.
CAMPAIGNS_1998 = {
    "1/5/98": ("1998-01-05", "1998-01-06"),
    "2/10/98": ("1998-02-09", "1998-02-10", "1998-02-11"),
    "03/16/98": ("1998-03-16", "1998-03-17"),
    "4/20/98": ("1998-04-20",),
    "6/1/98": ("1998-06-01", "1998-06-03"),
    "7/07/98": ("1998-07-07", "1998-07-08"),
}
CAMPAIGN_VALUES = ", ".join(
    f"(DATE '{d}', DATE '1998-{int(label.split('/')[0]):02d}-{int(label.split('/')[1]):02d}')"
    for label, days in CAMPAIGNS_1998.items()
    for d in days
)


@query(f"""WITH {FLUXES}, c(day, campaign_day) AS (VALUES {CAMPAIGN_VALUES})
SELECT campaign_day, season, collar, round(avg(flux), 6) AS mean_flux,
  round(avg(temperature), 6) AS mean_temperature, round(stddev_samp(flux) / sqrt(count(*)), 6) AS se_flux,
  count(*) AS n
FROM fluxes LEFT JOIN c USING (day) GROUP BY 1, 2, 3""")
def campaign_rollup(spark, folder):
    labelled = campaign_lookup(fluxes(spark, folder), "day", CAMPAIGNS_1998)
    out = labelled.groupBy("campaign_day", "season", "collar").agg(
        mean("flux").alias("mean_flux"), mean("temperature").alias("mean_temperature"),
        se("flux").alias("se_flux"), F.count(F.lit(1)).alias("n"),
    )
    return rounded(out, 6, "mean_flux", "mean_temperature", "se_flux")


@query("""SELECT CASE WHEN month(o_orderdate) IN (10, 11, 12) THEN 'wet' ELSE 'dry' END AS season,
  c_nationkey AS plot, c_mktsegment AS treatment, round(avg(o_totalprice), 4) AS mean_price, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
def season_plot_rollup(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("price"),
        season_by_month("o_orderdate").alias("season"),
    )
    plots = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("plot"), F.col("c_mktsegment").alias("treatment")
    )
    out = mean_via_lookup(orders, "c_custkey", "price", plots, ["plot", "treatment"], ["season"])
    return rounded(out, 4, "mean_price")


@query(f"""WITH {READINGS}
SELECT CAST(hour(ts) AS INTEGER) AS hour, channel, treatment, round(avg(value), 6) AS mean_value,
  round(stddev_samp(value), 6) AS sd_value
FROM readings GROUP BY 1, 2, 3""")
def hour_of_day_profile(spark, folder):
    r = readings(spark, folder).withColumn("hour", F.hour("ts"))
    out = summarise(r, ["hour", "channel", "treatment"], ["value"])
    return rounded(out, 6, "mean_value", "sd_value")


@query(f"""WITH {READINGS}
SELECT treatment, channel, round(avg(value), 6) AS mean_value
FROM readings WHERE hour(ts) = 13 GROUP BY 1, 2""")
def single_hour_bars(spark, folder):
    r = readings(spark, folder).where(F.hour("ts") == 13)
    return rounded(charts.bar_table(r, ["treatment", "channel"], "value"), 6, "mean_value")


_PROFILED = ("flux", "quality", "temperature", "moisture", "good")


@query(f"""WITH {FLUXES}, f AS (SELECT *, CASE WHEN quality > 0.02 THEN flux END AS good FROM fluxes)
{" UNION ALL ".join(f'''SELECT '{c}' AS "column", round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q1,
  round(quantile_cont({c}, 0.5), 6) AS median, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.75), 6) AS q3,
  round(max({c}), 6) AS max, count(*) - count({c}) AS n_missing FROM f''' for c in _PROFILED)}""")
def column_profile(spark, folder):
    f = fluxes(spark, folder).withColumn("good", F.when(F.col("quality") > 0.02, F.col("flux")))
    return rounded(charts.column_profile(f, _PROFILED), 6, "min", "q1", "median", "mean", "q3", "max")


@query(f"""WITH {READINGS}, q AS (
  SELECT channel, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
    quantile_cont(value, 0.75) AS q3 FROM readings GROUP BY channel)
SELECT channel, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(least(min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), q1), 6) AS lower_whisker,
  round(greatest(max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), q3), 6) AS upper_whisker,
  count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM readings JOIN q USING (channel) WHERE value IS NOT NULL GROUP BY channel, n, q1, median, q3""")
def box_table(spark, folder):
    out = charts.box_table(readings(spark, folder), ["channel"], "value")
    return rounded(out, 6, "q1", "median", "q3", "lower_whisker", "upper_whisker")


@query(f"""WITH {FLUXES}, s AS (SELECT min(flux) AS lo, max(flux) AS hi FROM fluxes), b AS (
  SELECT CAST(least(floor((flux - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, lo, hi FROM fluxes, s)
SELECT bin, round(lo + bin * ((hi - lo) / 30), 6) AS bin_start, round(lo + (bin + 1) * ((hi - lo) / 30), 6) AS bin_end,
  count(*) AS n
FROM b GROUP BY bin, lo, hi""")
def histogram_table(spark, folder):
    return rounded(charts.histogram_table(fluxes(spark, folder), "flux"), 6, "bin_start", "bin_end")


@query(f"""WITH {READINGS}, s AS (
  SELECT min(value) AS lo, max(value) AS hi, CAST(ceil(sqrt(count(*))) AS INTEGER) AS k FROM readings), b AS (
  SELECT CAST(least(floor((value - lo) / (hi - lo) * s.k), s.k - 1) AS INTEGER) AS bin, lo, hi, s.k AS k
  FROM readings, s WHERE value IS NOT NULL)
SELECT bin, round(lo + bin * ((hi - lo) / k), 6) AS bin_start, round(lo + (bin + 1) * ((hi - lo) / k), 6) AS bin_end,
  count(*) AS n
FROM b GROUP BY bin, lo, hi, k""")
def histogram_root_bins(spark, folder):
    out = charts.histogram_table(readings(spark, folder), "value", bins=None)
    return rounded(out, 6, "bin_start", "bin_end")


@query(f"""WITH {FLUXES}
SELECT treatment, CAST(regr_count(flux, temperature) AS BIGINT) AS n, round(regr_slope(flux, temperature), 6) AS slope,
  round(regr_intercept(flux, temperature), 6) AS intercept, round(regr_r2(flux, temperature), 6) AS r2,
  round(avg(temperature), 6) AS mean_x, round(regr_sxx(flux, temperature), 3) AS sxx,
  round(sqrt((regr_syy(flux, temperature) - regr_sxy(flux, temperature) ** 2 / regr_sxx(flux, temperature))
    / (regr_count(flux, temperature) - 2)), 6) AS sigma, min(temperature) AS min_x, max(temperature) AS max_x
FROM fluxes GROUP BY treatment""")
def smooth_lines(spark, folder):
    out = charts.smooth_lines(fluxes(spark, folder), ["treatment"], "temperature", "flux")
    return rounded(
        out, {"slope": 6, "intercept": 6, "r2": 6, "mean_x": 6, "sxx": 3, "sigma": 6}
    )


@query(f"""WITH RECURSIVE {FLUXES}, l AS (
  SELECT treatment, regr_count(flux, temperature) AS n, regr_slope(flux, temperature) AS b, regr_intercept(flux, temperature) AS a,
    avg(temperature) AS m, regr_sxx(flux, temperature) AS sxx, min(temperature) AS lo, max(temperature) AS hi,
    sqrt((regr_syy(flux, temperature) - regr_sxy(flux, temperature) ** 2 / regr_sxx(flux, temperature)) / (regr_count(flux, temperature) - 2)) AS s
  FROM fluxes GROUP BY treatment),
q AS (SELECT treatment, n - 2 AS df, 0.0::DOUBLE AS low, 20.0::DOUBLE AS high, 10.0::DOUBLE AS t, 0 AS i FROM l
  UNION ALL SELECT treatment, df, low, high, (low + high) / 2, i + 1 FROM (
    SELECT treatment, df, i, CASE WHEN {t_tail("t", "df")} > 0.05 THEN t ELSE low END AS low,
      CASE WHEN {t_tail("t", "df")} > 0.05 THEN high ELSE t END AS high FROM q WHERE i < 60)),
x AS (SELECT l.*, q.t, lo + (hi - lo) * k / 79 AS x FROM l JOIN q ON q.treatment = l.treatment AND q.i = 60, (SELECT unnest(range(0, 80)) AS k))
SELECT treatment, round(x, 6) AS x, round(a + b * x, 6) AS fit, round(a + b * x - t * s * sqrt(1.0 / n + (x - m) ** 2 / sxx), 6) AS lower,
  round(a + b * x + t * s * sqrt(1.0 / n + (x - m) ** 2 / sxx), 6) AS upper FROM x""")
def smooth_band(spark, folder):
    lines = charts.smooth_lines(fluxes(spark, folder), ["treatment"], "temperature", "flux")
    return rounded(charts.smooth_band(lines, ["treatment"]), 6, "x", "fit", "lower", "upper")


@query(f"""WITH {FLUXES}
SELECT temperature, flux, treatment, season FROM fluxes WHERE temperature IS NOT NULL AND flux IS NOT NULL""")
def scatter_table(spark, folder):
    return charts.scatter_table(fluxes(spark, folder), "temperature", "flux", "treatment", "season")


@query(f"""WITH {FLUXES}, t AS (
  SELECT avg(flux) AS mf, stddev_samp(flux) AS sf, avg(temperature) AS mt, stddev_samp(temperature) AS st FROM fluxes)
SELECT collar, day, flux, temperature, round((flux - mf) / sf, 6) AS z_flux,
  round((temperature - mt) / st, 6) AS z_temperature FROM fluxes, t""", "zscore")
def zscore_whole(spark, folder):
    f = fluxes(spark, folder).select("collar", "day", "flux", "temperature")
    return rounded(zscore(f, ["flux", "temperature"]), 6, "z_flux", "z_temperature")


@query(f"""WITH {FLUXES}, t AS (
  SELECT collar, avg(flux) AS m, stddev_samp(flux) AS s FROM fluxes GROUP BY collar)
SELECT collar, day, flux, round(CASE WHEN s > 0 THEN (flux - m) / s END, 6) AS z_flux FROM fluxes JOIN t USING (collar)""")
def zscore_groups(spark, folder):
    f = fluxes(spark, folder).select("collar", "day", "flux")
    return rounded(zscore_within(f, ["collar"], ["flux"]), 6, "z_flux")


@query(f"""WITH {READINGS}, d AS (
  SELECT collar, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS DOUBLE) * 24 AS x, avg(value) AS y
  FROM readings GROUP BY 1, 2),
l AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM d WHERE y IS NOT NULL
  WINDOW w AS (PARTITION BY collar ORDER BY x))
SELECT collar, round(coalesce(sum((x2 - x) * (y + y2) / 2), 0), 4) AS area FROM l GROUP BY collar""")
def trapezoid_auc(spark, folder):
    daily = daily_rollup(readings(spark, folder), ["collar"], "ts", ["value"]).withColumn(
        "hours", hours_since_epoch("day")
    )
    return rounded(trapezoid(daily, ["collar"], "hours", "mean_value"), 4, "area")


_HINGES = """r AS (
  SELECT {by}value, row_number() OVER (PARTITION BY {part} ORDER BY value) AS i,
    count(*) OVER (PARTITION BY {part}) AS n, floor((count(*) OVER (PARTITION BY {part}) + 3) / 2.0) / 2.0 AS d
  FROM readings WHERE value IS NOT NULL),
h AS (
  SELECT {by}max(n) AS n, (max(CASE WHEN i = floor(d) THEN value END) + max(CASE WHEN i = ceil(d) THEN value END)) / 2 AS lower_hinge,
    (max(CASE WHEN i = n + 1 - floor(d) THEN value END) + max(CASE WHEN i = n + 1 - ceil(d) THEN value END)) / 2 AS upper_hinge
  FROM r {group}),
f AS (SELECT *, lower_hinge - (upper_hinge - lower_hinge) * 1.5 AS lower_fence,
    upper_hinge + (upper_hinge - lower_hinge) * 1.5 AS upper_fence FROM h)"""
_BY_CHANNEL = _HINGES.format(by="channel, ", part="channel", group="GROUP BY channel")
_WHOLE = _HINGES.format(by="", part="1", group="")


@query(f"""WITH {READINGS}, {_BY_CHANNEL}
SELECT channel, n, round(lower_hinge, 6) AS lower_hinge, round(upper_hinge, 6) AS upper_hinge,
  round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence FROM f""")
def tukey_fences_per_channel(spark, folder):
    out = tukey_fences(readings(spark, folder), "value", ["channel"])
    return rounded(out, 6, "lower_hinge", "upper_hinge", "lower_fence", "upper_fence")


@query(f"""WITH {READINGS}, {_BY_CHANNEL}
SELECT event_id, collar, readings.channel AS channel, value, round(lower_fence, 6) AS lower_fence,
  round(upper_fence, 6) AS upper_fence
FROM readings JOIN f ON readings.channel = f.channel WHERE value < lower_fence OR value > upper_fence""")
def tukey_outliers(spark, folder):
    r = readings(spark, folder).select("event_id", "collar", "channel", "value")
    return rounded(outlier_rows(r, "value", ["channel"]), 6, "lower_fence", "upper_fence")


@query(f"""WITH {READINGS}, {_WHOLE}
SELECT event_id, collar, readings.value AS value FROM readings, f WHERE readings.value < lower_fence OR readings.value > upper_fence""")
def tukey_outliers_whole(spark, folder):
    r = readings(spark, folder).select("event_id", "collar", "value")
    return outlier_rows(r, "value").select("event_id", "collar", "value")
