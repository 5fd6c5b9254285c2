"""Joins: keyed, natural, many-to-many, inner, full, chained."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotflux.catalog.registry import FLUXES, READINGS, fluxes, query, readings, rounded, table
from plotflux.functions.bins import day_or_night
from plotflux.operators.joins import join_chain, keyed_join, natural_join
from plotflux.operators.reshape import wide_means
from plotflux.operators.rollup import daily_rollup, hourly_rollup, mean_of_means, sd, summarise


@query(f"""WITH {READINGS}, h AS (
  SELECT collar, date_trunc('hour', ts) AS hour_start, avg(value) AS m, stddev_samp(value) AS s
  FROM readings WHERE channel <> 'purchase' GROUP BY 1, 2)
SELECT event_id, readings.collar AS collar, value, round(m, 6) AS mean_value, round(s, 6) AS sd_value
FROM readings LEFT JOIN h ON readings.collar = h.collar AND date_trunc('hour', ts) = hour_start
WHERE channel = 'purchase'""")
def flux_microclimate_join(spark, folder):
    r = readings(spark, folder)
    parts = {"day": F.col("hour_start").cast("date"), "hour": F.hour("hour_start")}
    hourly = hourly_rollup(
        r.where("channel <> 'purchase'"), ["collar"], "ts", ["value"], extra=[sd("value").alias("sd_value")]
    ).withColumns(parts).withColumn("month", F.month("day")).drop("hour_start")
    observed = r.where("channel = 'purchase'").select(
        "event_id", "collar", "value", F.col("ts").cast("date").alias("day"), F.hour("ts").alias("hour"),
        F.month("ts").alias("month"),
    )
    joined = keyed_join(observed, hourly, ["collar", "day", "hour", "month"], "left")
    return rounded(
        joined.select("event_id", "collar", "value", "mean_value", "sd_value"), 6, "mean_value", "sd_value"
    )


@query("""WITH d AS (SELECT CASE WHEN doc_id % 100 = 7 THEN NULL ELSE doc_id END AS doc_id, lang, n_chars FROM documents),
l AS (SELECT nullif(doc_id, 7) AS doc_id, quality, toxic FROM labels)
SELECT d.doc_id AS doc_id, lang, n_chars, quality, toxic FROM d LEFT JOIN l ON d.doc_id IS NOT DISTINCT FROM l.doc_id""")
def natural_left_join(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.when(F.col("doc_id") % 100 != 7, F.col("doc_id")).alias("doc_id"), "lang", "n_chars"
    )
    labels = table(spark, folder, "labels").withColumn("doc_id", F.nullif("doc_id", F.lit(7)))
    return natural_join(docs, labels)


@query(f"""WITH {READINGS}, h AS (
  SELECT plot, CAST(ts AS DATE) AS day, hour(ts) AS hour, avg(k) AS mean_k
  FROM readings GROUP BY 1, 2, 3)
SELECT event_id, count(hour) AS n_hours, round(avg(mean_k), 6) AS mean_k
FROM readings LEFT JOIN h ON readings.plot = h.plot AND CAST(ts AS DATE) = h.day
GROUP BY event_id""")
def many_to_many_join(spark, folder):
    r = readings(spark, folder)
    hourly = hourly_rollup(r, ["plot"], "ts", ["k"]).select(
        "plot", F.col("hour_start").cast("date").alias("day"), F.hour("hour_start").alias("hour"), "mean_k"
    )
    observed = r.select("event_id", "plot", F.col("ts").cast("date").alias("day"))
    # At most 24 hours match a plot's day; the repeats are averaged away again.
    joined = natural_join(observed, hourly, "left", "many-to-many")
    out = joined.groupBy("event_id").agg(
        F.count("hour").alias("n_hours"), F.avg("mean_k").alias("mean_k")
    )
    return rounded(out, 6, "mean_k")


@query(f"""WITH {FLUXES}
SELECT collar, s_name AS sensor, n_name AS block, r_name AS site, round(avg(flux), 6) AS mean_flux, count(*) AS n
FROM fluxes JOIN supplier ON collar = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4""")
def registry_inner_join(spark, folder):
    registry = (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumnsRenamed(
            {"s_suppkey": "collar", "s_name": "sensor", "n_name": "block", "r_name": "site"}
        )
        .select("collar", "sensor", "block", "site")
    )
    means = summarise(fluxes(spark, folder), ["collar"], ["flux"], ("mean",), count=True)
    return rounded(means.join(registry, "collar", "inner"), 6, "mean_flux")


@query("""WITH a AS (SELECT doc_id, lang FROM documents),
b AS (SELECT doc_id + 50 AS doc_id, quality, toxic FROM labels)
SELECT doc_id, lang, quality, toxic FROM a FULL JOIN b USING (doc_id)""")
def full_outer_join(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    # Moved keys, so that both sides have rows without a partner.
    labels = table(spark, folder, "labels").withColumn("doc_id", F.col("doc_id") + 50)
    return natural_join(docs, labels, "full")


@query(f"""WITH {READINGS}, p AS (
  SELECT o_custkey, avg(o_totalprice) AS mean_price, count(*) AS n, max(o_totalprice) AS best, min(CAST(o_orderdate AS DATE)) AS first_day,
    avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS mean_urgent, count(*) FILTER (o_orderstatus = 'F') AS n_finished
  FROM orders GROUP BY 1),
d AS (SELECT plot, CAST(ts AS DATE) AS day, avg(value) AS v, avg(k) AS k FROM readings GROUP BY 1, 2),
m AS (SELECT plot, avg(v) AS mean_value, avg(k) AS mean_k FROM d GROUP BY 1),
w AS (SELECT plot, avg(CASE WHEN hour(ts) BETWEEN 7 AND 20 THEN value END) AS value_day,
    avg(CASE WHEN hour(ts) NOT BETWEEN 7 AND 20 THEN value END) AS value_night FROM readings GROUP BY 1)
SELECT c_custkey, c_mktsegment, c_nationkey, round(mean_price, 4) AS mean_price, n, best, first_day, round(mean_urgent, 4) AS mean_urgent,
  n_finished, round(mean_value, 6) AS mean_value, round(mean_k, 6) AS mean_k, round(value_day, 6) AS value_day,
  round(value_night, 6) AS value_night, n_name, r_name
FROM customer LEFT JOIN p ON c_custkey = p.o_custkey LEFT JOIN m ON c_custkey = m.plot LEFT JOIN w ON c_custkey = w.plot
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def master_table(spark, folder):
    by = ["c_custkey"]
    price = F.col("o_totalprice")
    orders = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.avg(price).alias("mean_price"),
        F.count(F.lit(1)).alias("n"),
        F.max(price).alias("best"),
        F.min(F.col("o_orderdate").cast("date")).alias("first_day"),
        F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", price)).alias("mean_urgent"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"),
    )
    r = readings(spark, folder).withColumnRenamed("plot", "c_custkey")
    means = mean_of_means(
        r.withColumn("day", F.col("ts").cast("date")), [*by, "day"], by, ["value", "k"]
    )
    day_night = wide_means(
        r.withColumn("timeofday", day_or_night("ts")), by, "timeofday", ["day", "night"], ["value"]
    )
    nations = (
        table(spark, folder, "nation")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    )
    base = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    out = join_chain(base, [(orders, by), (means, by), (day_night, by), (nations, ["c_nationkey"])])
    digits = {"mean_value": 6, "mean_k": 6, "value_day": 6, "value_night": 6}
    return rounded(out, {"mean_price": 4, "mean_urgent": 4, **digits})


@query(f"""WITH {READINGS}, d AS (
  SELECT plot, CAST(ts AS DATE) AS day, avg(value) AS m FROM readings GROUP BY 1, 2)
SELECT event_id, readings.plot AS plot, value, round(m, 6) AS mean_value
FROM readings JOIN d ON readings.plot = d.plot AND CAST(ts AS DATE) = d.day""")
def salted_join(spark, folder):
    r = readings(spark, folder)
    daily = daily_rollup(r, ["plot"], "ts", ["value"])
    rows = r.select("event_id", "plot", "value", F.col("ts").cast("date").alias("day"))
    joined = keyed_join(rows, daily, ["plot", "day"], "inner", relationship="many-to-one", salts=8)
    return rounded(joined.drop("day"), 6, "mean_value")
