"""Filters, recodes, dates, texts, casts and sources of keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotflux.catalog.registry import FLUXES, READINGS, fluxes, query, readings, rounded, table
from plotflux.catalog.rollups import CAMPAIGN_VALUES, CAMPAIGNS_1998
from plotflux.functions.bins import day_or_night, month_name, season_by_date, season_by_month
from plotflux.functions.scalars import (
    FLUX_DATE_FORMATS,
    cast_by_type,
    cast_columns,
    censor,
    compound_key,
    level_order,
    parse_timestamp,
    row_mean,
    safe_log10,
    safe_sqrt,
    split_part,
    square,
    try_number,
    utc_to_local,
)
from plotflux.operators import clean
from plotflux.operators.joins import natural_join
from plotflux.operators.rollup import summarise


@query(f"""WITH {FLUXES}
SELECT collar, day, flux, quality, treatment FROM fluxes WHERE quality > 0.08 AND treatment <> 'R'""")
def flux_quality_filter(spark, folder):
    good = clean.quality_filter(fluxes(spark, folder), "quality", 0.08)
    return good.where(F.col("treatment") != "R").select("collar", "day", "flux", "quality", "treatment")


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-10-03' AND DATE '1998-02-02'""")
def date_window(spark, folder):
    kept = clean.date_window(table(spark, folder, "orders"), "o_orderdate", "1997-10-03", "1998-02-02")
    return kept.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")


@query("""SELECT doc_id, lang, n_chars FROM documents WHERE NOT regexp_matches(text, 'CHECK|STD|Copyright|@')""")
def regex_exclude(spark, folder):
    kept = clean.exclude_matching(table(spark, folder, "documents"), "text", "CHECK|STD|Copyright|@")
    return kept.select("doc_id", "lang", "n_chars")


@query("""SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)
WHERE lang IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL""")
def dropna_any(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return natural_join(docs, table(spark, folder, "labels")).dropna("any")


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS no_negative,
  CASE WHEN c_acctbal <= 9000 THEN c_acctbal END AS no_high,
  CASE WHEN c_acctbal BETWEEN 0 AND 9000 THEN c_acctbal END AS both FROM customer""")
def censor_values(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey",
        censor("c_acctbal", lower=0).alias("no_negative"),
        censor("c_acctbal", upper=9000).alias("no_high"),
        censor("c_acctbal", 0, 9000).alias("both"),
    )


@query("""SELECT event_id, CASE WHEN hour(ts) BETWEEN 7 AND 20 THEN 'day' ELSE 'night' END AS timeofday,
  CASE WHEN CAST(ts AS DATE) < DATE '2024-01-16' THEN 'wet' ELSE 'dry' END AS by_date,
  CASE WHEN month(ts) IN (10, 11, 12) THEN 'wet' ELSE 'dry' END AS by_month,
  event_type IN ('click', 'view') AS chosen FROM events""")
def season_bins(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        day_or_night("ts").alias("timeofday"),
        season_by_date(F.col("ts").cast("date"), "2024-01-16").alias("by_date"),
        season_by_month("ts").alias("by_month"),
        F.col("event_type").isin("click", "view").alias("chosen"),
    )


@query("""SELECT CASE month(o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 10 THEN 'October'
    WHEN 11 THEN 'November' WHEN 12 THEN 'December' END AS month_name, o_orderstatus,
  round(avg(o_totalprice), 4) AS mean_o_totalprice, round(stddev_samp(o_totalprice), 4) AS sd_o_totalprice, count(*) AS n
FROM orders GROUP BY 1, 2""")
def month_recode(spark, folder):
    orders = table(spark, folder, "orders").withColumn("month_name", month_name("o_orderdate"))
    out = summarise(orders, ["month_name", "o_orderstatus"], ["o_totalprice"], count=True)
    return rounded(out, 4, "mean_o_totalprice", "sd_o_totalprice")


@query(f"""WITH c(day, campaign_day) AS (VALUES {CAMPAIGN_VALUES})
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, campaign_day
FROM orders LEFT JOIN c ON CAST(o_orderdate AS DATE) = c.day""")
def campaign_lookup(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("day")
    )
    return clean.campaign_lookup(orders, "day", CAMPAIGNS_1998)


_GAPS = """d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders),
g AS (SELECT *, CASE WHEN date_diff('day', lag(day) OVER w, day) <= 60 THEN 0 ELSE 1 END AS s
  FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY day)),
c AS (SELECT o_custkey, day, CAST(sum(s) OVER (PARTITION BY o_custkey ORDER BY day) AS BIGINT) AS campaign FROM g),
t AS (SELECT *, min(day) OVER (PARTITION BY o_custkey, campaign) AS campaign_day FROM c)"""


@query(f"WITH {_GAPS} SELECT o_custkey, day, campaign, campaign_day FROM t")
def campaign_by_gap(spark, folder):
    orders = table(spark, folder, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    return clean.campaign_table(orders, ["o_custkey"], "day", 60)


@query(f"""WITH {_GAPS}
SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderkey, campaign, campaign_day
FROM orders JOIN t USING (o_custkey) WHERE t.day = CAST(o_orderdate AS DATE)""")
def campaign_labels(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderkey"
    )
    return clean.label_campaigns(orders, ["o_custkey"], "day", 60)


_DENSITY = {"ECONOMY": 1.00, "STANDARD": 0.66, "PROMO": 0.87}


@query("""SELECT p_partkey, p_type, CASE p_type WHEN 'ECONOMY' THEN 1.00 WHEN 'STANDARD' THEN 0.66
  WHEN 'PROMO' THEN 0.87 END::DOUBLE AS density FROM part""")
def constant_lookup(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_type")
    return clean.constant_lookup(parts, "p_type", _DENSITY, "density")


_PRIORITIES = ("1-URGENT", "3-MEDIUM", "2-HIGH", "5-LOW")


@query("""SELECT DISTINCT o_orderpriority AS level,
  CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INTEGER) AS alphabetical,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '5-LOW' THEN 4 END AS imposed
FROM orders""")
def factor_levels(spark, folder):
    levels = clean.level_table(table(spark, folder, "orders"), "o_orderpriority")
    return levels.select("level", "alphabetical", level_order("level", _PRIORITIES).alias("imposed"))


@query("""SELECT l_orderkey, l_linenumber, round((CAST(l_linenumber AS DOUBLE) + l_quantity
  + CASE WHEN l_tax > 0.02 THEN l_tax END) / 3, 6) AS row_mean FROM lineitem""", "row_mean")
def row_mean_of_three(spark, folder):
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    numbers = cast_by_type(items.withColumn("grid", F.col("l_linenumber")), ["int"])
    mean = row_mean("grid", "l_quantity", F.when(F.col("l_tax") > 0.02, F.col("l_tax")))
    out = numbers.select("l_orderkey", F.col("l_linenumber").cast("int"), mean.alias("row_mean"))
    return rounded(out, 6, "row_mean")


@query("""SELECT doc_id, try_cast(source AS DOUBLE) AS source, try_cast(lang || doc_id AS DOUBLE) AS mixed,
  try_cast(replace(CAST(n_chars AS VARCHAR) || ',5', ',', '.') AS DOUBLE) AS comma FROM documents""")
def try_cast_columns(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id",
        "source",
        F.concat("lang", F.col("doc_id").cast("string")).alias("mixed"),
        try_number(F.concat(F.col("n_chars").cast("string"), F.lit(",5"))).alias("comma"),
    )
    return cast_columns(docs, ["source", "mixed"])


@query(f"""WITH {READINGS}
SELECT event_id, block || '-' || plot AS plot_key, collar,
  block || '-' || CASE WHEN value IS NOT NULL THEN plot END AS with_missing FROM readings""")
def plot_key(spark, folder):
    return readings(spark, folder).select(
        "event_id",
        compound_key("block", "plot").alias("plot_key"),
        "collar",
        compound_key("block", F.when(F.col("value").isNotNull(), F.col("plot"))).alias("with_missing"),
    )


@query("""SELECT page_id, split_part(url, '/', 3) AS host, list_extract(string_split(url, '/'), -1) AS last_part,
  nullif(split_part(split_part(url, '/', 3), '.', 2), '') AS domain FROM pages""")
def str_split_key(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id",
        split_part("url", "/", 3).alias("host"),
        split_part("url", "/", -1).alias("last_part"),
        split_part(split_part("url", "/", 3), ".", 2).alias("domain"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS ts,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS remark FROM orders""")
def date_coalesce_union(spark, folder):
    orders = table(spark, folder, "orders")
    # Dates printed as two instruments print them; every seventh is no date at all.
    odd = orders.where(F.col("o_orderkey") % 2 != 0).select(
        "o_orderkey", F.date_format("o_orderdate", "M/d/yyyy H:mm").alias("date_iv")
    )
    even = orders.where(F.col("o_orderkey") % 2 == 0).select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date_iv"),
        F.col("o_orderstatus").alias("remark"),
    )
    text = F.when(F.col("o_orderkey") % 7 == 0, "no date").otherwise(F.col("date_iv"))
    return odd.unionByName(even, allowMissingColumns=True).select(
        "o_orderkey", parse_timestamp(text, FLUX_DATE_FORMATS).alias("ts"), "remark"
    )


@query("""SELECT event_id, ts - INTERVAL 6 HOUR AS local, CAST(ts - INTERVAL 6 HOUR AS DATE) AS local_day FROM events""",
       "utc_to_local")
def local_time(spark, folder):
    local = utc_to_local("ts")
    return table(spark, folder, "events").select(
        "event_id", local.alias("local"), local.cast("date").alias("local_day")
    )


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS root,
  CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS log, round(c_acctbal * c_acctbal, 3) AS squared
FROM customer""")
def power_transforms(spark, folder):
    out = table(spark, folder, "customer").select(
        "c_custkey", safe_sqrt("c_acctbal").alias("root"), safe_log10("c_acctbal").alias("log"),
        square("c_acctbal").alias("squared"),
    )
    return rounded(out, {"root": 6, "log": 6, "squared": 3})


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6""")
def ordered_head(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(6)
