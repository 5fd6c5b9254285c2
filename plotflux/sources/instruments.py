"""Sensor-logger and gas-flux files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotflux.functions.scalars import (
    FLUX_DATE_FORMATS,
    LOCAL_ZONE,
    LOGGER_DATE_FORMATS,
    parse_timestamp,
    split_part,
    try_number,
    utc_to_local,
)
from plotflux.sources.delimited import decoded_path, read_lines, rows_by_name
from plotflux.sources.tables import TableSpec

# File names and columns of the instruments' exports.
LOGGER_FILE_PATTERN = r"^data_[0-9A-Za-z]+_[0-9]+\.csv$"
LOGGER_COLUMNS = ("index", "datetime", "timezone", "t1", "t2", "t3", "soilm_count")
LOGGER_SCHEMA = (
    "index string, datetime string, timezone string, t1 string, t2 string, t3 string, "
    "soilm_count string, shake string, error string, surplus string"
)
LOGGER_RENAMES = {"t1": "subsoil_t", "t2": "surface_t", "t3": "air_t"}
FLUX_FILE_GLOB = "*_offset.txt"
FLUX_EXPORT = TableSpec(
    {
        "Label": ("collar", "string"),
        "File Name": ("instrument_file", "string"),
        "Date_IV": ("date_iv", "string"),
        "Obs#": ("obs", "int"),
        "Offset": ("offset", "double"),
        "Area": ("area", "double"),
        "Instrument Name": ("instrument", "string"),
        "Pre-purge": ("pre_purge", "string"),
        "Dead Band": ("dead_band", "string"),
        "Observation Length": ("observation_length", "string"),
        "Post-purge": ("post_purge", "string"),
        "Exp_Flux": ("exp_flux", "double"),
        "Exp_R2": ("exp_r2", "double"),
        "Tcham_IV": ("chamber_t", "double"),
        "Pressure_IV": ("pressure", "double"),
        "RH_IV": ("rh", "double"),
    }
)


def logger_columns(raw: DataFrame, file_pattern: str) -> DataFrame:
    """Typed readings with lineage from the text fields of logger files.

    The sensor id is the second part of the file name. Decimal comma and decimal
    point are both read. ``raw`` has the path of its file in ``path``. Works on a batch and on a stream.
    """
    named = raw.select(*LOGGER_COLUMNS, "path").withColumn("filename", split_part("path", "/", -1)).where(
        F.col("filename").rlike(file_pattern)
    )
    return named.select(
        F.col("index").try_cast("int").alias("index"),
        "datetime",
        F.col("timezone").try_cast("int").alias("timezone"),
        *[try_number(c).alias(LOGGER_RENAMES[c]) for c in ("t1", "t2", "t3")],
        try_number("soilm_count").cast("int").alias("soilm_count"),
        parse_timestamp("datetime", LOGGER_DATE_FORMATS).alias("ts_utc"),
        "path",
        "filename",
        split_part("filename", "_", 2).alias("sensor_id"),
    )


def read_logger_files(
    spark: SparkSession, folder: str, file_pattern: str = LOGGER_FILE_PATTERN
) -> DataFrame:
    """All logger files of a folder and its sub-folders: headerless, separated by semicolons.

    ``file_pattern`` alone decides which file names count, for any number of sensors.
    """
    raw = (
        spark.read.schema(LOGGER_SCHEMA)
        .options(sep=";", header=False, recursiveFileLookup=True)
        .csv(folder)
    )
    return logger_columns(raw.withColumn("path", decoded_path()), file_pattern)


def logger_lines(lines: DataFrame, file_pattern: str = LOGGER_FILE_PATTERN) -> DataFrame:
    """Readings from lines of logger files (``line``, ``path``), however they were read."""
    parsed = F.from_csv(F.col("line"), LOGGER_SCHEMA, {"sep": ";"})
    return logger_columns(lines.select(F.col("path"), parsed.alias("r")).select("r.*", "path"), file_pattern)


def locate_readings(readings: DataFrame, registry: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Readings of registered sensors with plot columns and local wall time.

    The registry has one row per sensor; Spark broadcasts it while it is small.
    """
    plots = registry.withColumn("sensor_id", F.col("sensor_id").cast("string"))
    return readings.join(plots, "sensor_id", "inner").withColumn(
        "ts", utc_to_local("ts_utc", zone)
    )


def flux_lines(lines: DataFrame) -> DataFrame:
    """Flux observations from lines of exports (``line``, ``path``): columns by name, dates in several formats."""
    rows = rows_by_name(lines, FLUX_EXPORT, "\t")
    return rows.withColumn("ts", parse_timestamp("date_iv", FLUX_DATE_FORMATS))


def read_flux_files(spark: SparkSession, folder: str) -> DataFrame:
    """All flux exports of a folder and its sub-folders: tab-separated with header, any order of columns per file."""
    return flux_lines(read_lines(spark, folder, FLUX_FILE_GLOB))


def locate_fluxes(fluxes: DataFrame, registry: DataFrame) -> DataFrame:
    """Fluxes of registered collars with their plot columns."""
    return fluxes.join(registry, "collar", "inner")
