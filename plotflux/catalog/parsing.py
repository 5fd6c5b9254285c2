"""The file parsers on texts written from table rows: logger files, flux exports, laboratory runs, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotflux.catalog.registry import query, rounded, table
from plotflux.functions.scalars import FLUX_DATE_FORMATS, parse_timestamp
from plotflux.operators import clean
from plotflux.session import durable
from plotflux.sources import instruments, laboratory


def _text(column: Column) -> Column:
    return column.cast("string")


@query("""SELECT CAST(event_id AS INTEGER) AS index, CAST(user_id AS VARCHAR) AS sensor_id, date_trunc('minute', ts) AS ts_utc,
  CASE WHEN event_id % 11 <> 0 THEN value END AS subsoil_t, value * 2 AS surface_t, CAST(event_id % 3 AS INTEGER) AS timezone,
  CAST(1000 + event_id % 500 AS INTEGER) AS soilm_count, 'data_' || user_id || '_0.csv' AS filename
FROM events WHERE user_id % 7 <> 0""")
def logger_text(spark, folder):
    """Lines of logger files: two date formats, decimal commas, text that is no number, files of another name."""
    e = table(spark, folder, "events")
    stamp = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy.MM.dd HH:mm")).otherwise(F.date_format("ts", "dd.MM.yyyy HH:mm"))
    first = F.when(F.col("event_id") % 11 == 0, F.lit("n/a")).otherwise(_text(F.col("value")))
    line = F.concat_ws(
        ";", _text(F.col("event_id")), stamp, _text(F.col("event_id") % 3), F.translate(first, ".", ","), _text(F.col("value") * 2),
        F.lit(""), _text(1000 + F.col("event_id") % 500), F.lit("1"), F.lit("0"), F.lit(""),
    )
    name = F.when(F.col("user_id") % 7 == 0, F.lit("notes.csv")).otherwise(F.format_string("data_%d_0.csv", "user_id"))
    lines = e.select(line.alias("line"), F.concat(F.lit("/field/"), name).alias("path"))
    columns = ["index", "sensor_id", "ts_utc", "subsoil_t", "surface_t", "timezone", "soilm_count", "filename"]
    return instruments.logger_lines(lines).select(*columns)


_FLUX_NAMES = list(instruments.FLUX_EXPORT.columns)
#: Three layouts of flux exports: in order, backwards, and with columns that nobody asked for.
_LAYOUTS = [_FLUX_NAMES, _FLUX_NAMES[::-1], ["Extra", *_FLUX_NAMES[5:], "More", *_FLUX_NAMES[:5]]]


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS collar, CAST(l_linenumber AS INTEGER) AS obs, CAST(l_shipdate AS DATE) + INTERVAL 13 HOUR AS ts,
  l_extendedprice AS exp_flux, CASE WHEN l_linenumber <> 3 THEN l_discount END AS exp_r2, l_quantity AS chamber_t,
  'LI ' || l_suppkey AS instrument_file FROM lineitem""")
def flux_text(spark, folder):
    """Lines of one flux export per supplier, each with the header of one of three layouts; dates in two formats."""
    items = table(spark, folder, "lineitem")
    supplier = F.coalesce(_text(F.col("l_suppkey")), F.lit("null"))
    day = F.col("l_shipdate").cast("date")
    stamp = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.date_format(day, "M/d/yyyy"), F.lit(" 13:00")))
    made = {
        "Label": _text(F.col("l_suppkey")),
        "File Name": F.concat(F.lit("LI "), supplier),
        "Date_IV": stamp.otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 13:00:00"))),
        "Obs#": _text(F.col("l_linenumber")),
        "Exp_Flux": _text(F.col("l_extendedprice")),
        "Exp_R2": F.when(F.col("l_linenumber") == 3, F.lit("NA")).otherwise(_text(F.col("l_discount"))),
        "Tcham_IV": _text(F.col("l_quantity")),
    }
    layout = F.col("l_suppkey") % len(_LAYOUTS)
    path = F.concat(F.lit("/flux/LI "), supplier, F.lit("_offset.txt")).alias("path")

    def line(name_to_field):
        out = None
        for k, names in enumerate(_LAYOUTS):
            joined = F.concat_ws("\t", *[name_to_field(n) for n in names])
            out = F.when(layout == k, joined) if out is None else out.when(layout == k, joined)
        return out.alias("line")

    headers = items.select("l_suppkey").distinct().select(line(F.lit), path)
    # The fields are worked out in a projection of their own; the layouts only put them in order.
    fields = items.select("l_suppkey", *[column.alias(n) for n, column in made.items()])
    data = fields.select(line(lambda n: F.col(f"`{n}`") if n in made else F.lit("0")), path)
    # Written out like the files that they stand for.
    out = instruments.flux_lines(durable(headers.unionByName(data)))
    return out.select("collar", "obs", "ts", "exp_flux", "exp_r2", "chamber_t", "instrument_file")


@query("""SELECT 'batch ' || l_orderkey || '/' || l_linenumber AS sample, round(l_quantity, 6) AS npoc, round(l_extendedprice, 6) AS tdn,
  'run_' || l_orderkey || '.csv' AS filename FROM lineitem WHERE l_linenumber <> 5""")
def lab_text(spark, folder):
    """A laboratory file per order: nine preamble lines, columns in two orders, sample names over two quoted lines, controls."""
    items = table(spark, folder, "lineitem")
    name = F.when(F.col("l_linenumber") == 5, F.lit("CHECK")).otherwise(
        F.concat(F.lit('"batch '), _text(F.col("l_orderkey")), F.lit("\n"), _text(F.col("l_linenumber")), F.lit('"'))
    )
    npoc, tdn, note = _text(F.col("l_quantity")), _text(F.col("l_extendedprice")), F.lit('"said ""fine"", then\nleft"')
    even = F.col("l_orderkey") % 2 == 0
    record = F.when(even, F.concat_ws(",", name, npoc, note, tdn)).otherwise(F.concat_ws(",", tdn, note, npoc, name))
    # An order has at most seven lines, so a file is small.
    files = items.groupBy("l_orderkey").agg(F.concat_ws("\r\n", F.collect_list(record)).alias("body"))
    header = F.when(even, F.lit("Sample Name,Result(NPOC),Note,Result(TN)")).otherwise(F.lit("Result(TN),Note,Result(NPOC),Sample Name"))
    text = F.concat(F.lit('preamble with a 5" pipe\r\n' * laboratory.PREAMBLE_LINES), header, F.lit("\r\n"), F.col("body"), F.lit("\r\n\r\n"))
    files = files.select(text.alias("text"), F.format_string("/lab/run_%d.csv", "l_orderkey").alias("path"))
    rows = laboratory.carbon_rows(files)
    out = rows.select(
        F.translate("sample_id", "\n", "/").alias("sample"), F.col("npoc_mg_l").cast("double").alias("npoc"),
        F.col("tdn_mg_l").cast("double").alias("tdn"), "filename",
    )
    return rounded(out, 6, "npoc", "tdn")


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_linenumber = 6) AS n_missing,
  count(*) FILTER (l_linenumber IN (4, 5)) AS n_unparsed, '31/31/' || min(year(l_shipdate)) FILTER (l_linenumber IN (4, 5)) AS example
FROM lineitem GROUP BY 1""")
def unparsed_dates(spark, folder):
    """How many date texts are missing, and how many fit no format, per group."""
    items = table(spark, folder, "lineitem")
    good = F.date_format(F.col("l_shipdate").cast("date"), "yyyy-MM-dd")
    text = F.when(F.col("l_linenumber") == 6, F.lit(" ")).when(
        F.col("l_linenumber").isin(4, 5), F.concat(F.lit("31/31/"), F.year("l_shipdate"))
    ).otherwise(F.concat(good, F.lit(" 00:00:00")))
    dated = items.select("l_returnflag", text.alias("text")).withColumn("ts", parse_timestamp("text", FLUX_DATE_FORMATS))
    return clean.parse_report(dated, "text", "ts", ["l_returnflag"])
