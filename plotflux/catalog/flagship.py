"""The core of the flux analysis as one query."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotflux.catalog.registry import READINGS, query, readings, rounded
from plotflux.functions.bins import day_or_night, season_by_date
from plotflux.functions.scalars import hour_floor
from plotflux.operators.clean import label_campaigns
from plotflux.operators.joins import keyed_join
from plotflux.operators.rollup import hourly_rollup, mean, se


@query(f"""WITH {READINGS}, r AS (
  SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'wet' ELSE 'dry' END AS season,
    CASE WHEN hour(ts) BETWEEN 7 AND 20 THEN 'day' ELSE 'night' END AS timeofday,
    date_trunc('hour', ts) AS hour_start, CAST(ts AS DATE) AS day FROM readings),
h AS (SELECT collar, hour_start, avg(k) AS k FROM r WHERE channel <> 'purchase' GROUP BY 1, 2),
f AS (SELECT r.*, h.k AS micro FROM r LEFT JOIN h ON r.collar = h.collar AND r.hour_start = h.hour_start WHERE channel = 'purchase'),
d AS (SELECT DISTINCT collar, day FROM f),
g AS (SELECT *, CASE WHEN date_diff('day', lag(day) OVER w, day) <= 2 THEN 0 ELSE 1 END AS s FROM d WINDOW w AS (PARTITION BY collar ORDER BY day)),
c AS (SELECT *, sum(s) OVER (PARTITION BY collar ORDER BY day) AS campaign FROM g),
t AS (SELECT collar, day, min(day) OVER (PARTITION BY collar, campaign) AS campaign_day FROM c)
SELECT campaign_day, block, treatment, season, timeofday, f.collar AS collar, round(avg(value), 6) AS mean_flux,
  round(stddev_samp(value) / sqrt(count(*)), 6) AS se_flux, round(avg(micro), 6) AS mean_k, count(*) AS n
FROM f JOIN t ON f.collar = t.collar AND f.day = t.day GROUP BY 1, 2, 3, 4, 5, 6""")
def campaign_fluxes(spark, folder):
    r = readings(spark, folder).withColumns(
        {
            "season": season_by_date(F.col("ts").cast("date"), "2024-01-16"),
            "timeofday": day_or_night("ts"),
            "hour_start": hour_floor("ts"),
            "day": F.col("ts").cast("date"),
        }
    )
    hourly = hourly_rollup(r.where("channel <> 'purchase'"), ["collar"], "ts", {"k": "k"})
    observed = r.where("channel = 'purchase'")
    joined = keyed_join(observed, hourly, ["collar", "hour_start"], "left")
    labelled = label_campaigns(joined, ["collar"], "day", 2)
    out = labelled.groupBy("campaign_day", "block", "treatment", "season", "timeofday", "collar").agg(
        mean("value").alias("mean_flux"), se("value").alias("se_flux"), mean("mean_k").alias("mean_k"),
        F.count(F.lit(1)).alias("n"),
    )
    return rounded(out, 6, "mean_flux", "se_flux", "mean_k")
