"""Header CSV tables of the experiment, and the sinks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING_TEXT = "NA"


@dataclass(frozen=True)
class TableSpec:
    """Columns to take from a header file: raw header -> (column name, type)."""

    columns: Mapping[str, tuple[str, str]]


# Headers of the experiment's files and the names used here.
REGISTRY = TableSpec(
    {
        "Collar": ("collar", "string"),
        "Block": ("block", "int"),
        "Plot": ("plot", "int"),
        "Treatment": ("treatment", "string"),
        "sensorID": ("sensor_id", "string"),
    }
)
INORGANIC_N = TableSpec(
    {"Collar": ("collar", "string"), "N-NH4+": ("nh4", "double"), "N-NO3-": ("no3", "double")}
)
INORGANIC_N_METADATA = TableSpec(
    {
        "ID USUARIO": ("sample_id", "string"),
        "Block": ("block", "int"),
        "Plot": ("plot", "int"),
        "Treat": ("treat", "string"),
        "Collar": ("collar", "string"),
        "Extract": ("extract", "string"),
        "Treatment": ("treatment", "string"),
        "freshsoil_g": ("freshsoil_g", "double"),
        "KCL_L": ("kcl_l", "double"),
        "soilm_tin": ("soilm_tin", "double"),
        "soilm_wet_g": ("soilm_wet_g", "double"),
        "soilm_dry_tin": ("soilm_dry_tin", "double"),
    }
)
BULK_CN = TableSpec(
    {
        "ID USUARIO": ("collar", "string"),
        "C": ("perc_c", "double"),
        "N": ("perc_n", "double"),
        "C/N": ("c_n_ratio", "double"),
    }
)
BULK_CN_METADATA = TableSpec(
    {
        "ID USUARIO": ("collar", "string"),
        "Block": ("block", "int"),
        "Plot": ("plot", "int"),
        "Treat": ("treat", "string"),
        "Treatment": ("treatment", "string"),
    }
)
EXTRACT_METADATA = TableSpec(
    {
        "sample_id": ("sample_id", "string"),
        "Block": ("block", "int"),
        "Plot": ("plot", "int"),
        "TRT": ("trt", "string"),
        "Collar": ("collar", "string"),
        "Treatment": ("treatment", "string"),
        "FUM": ("fum", "string"),
        "freshsoil_g": ("freshsoil_g", "double"),
        "soilm_tin": ("soilm_tin", "double"),
        "soilm_wet_g": ("soilm_wet_g", "double"),
        "soilm_dry_tin": ("soilm_dry_tin", "double"),
        "k2so4_L": ("k2so4_l", "double"),
    }
)
VEGETATION_COVER = TableSpec(
    {
        "Collar": ("collar", "string"),
        "grid_1": ("grid_1", "int"),
        "grid_2": ("grid_2", "int"),
        "grid_3": ("grid_3", "int"),
    }
)
SOIL_PH = TableSpec(
    {
        "block": ("block", "int"),
        "unit": ("unit", "int"),
        "treat": ("treat", "string"),
        "soil pH": ("soil_ph", "double"),
    }
)
BULK_DENSITY = TableSpec(
    {"Muestra": ("core", "string"), "suelo seco (g)": ("dry_g", "double")}
)


def read_header_files(spark: SparkSession, path, sep: str = ",", **options: str) -> DataFrame:
    """Header files of one layout as text columns.

    The names come from the first file. Every other file's header is compared
    with them and a different one stops the job, since values are read by
    position. Files of varying layouts go through ``delimited.read_by_name``.
    """
    reader = spark.read.options(header=True, sep=sep, nullValue=MISSING_TEXT, **options)
    layout = reader.csv(path).schema
    return reader.schema(layout).option("enforceSchema", False).csv(path)


def choose(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """Named columns, renamed and cast; text that is no number becomes missing."""
    return raw.select(
        *[
            (F.col(f"`{header}`") if kind == "string" else F.col(f"`{header}`").try_cast(kind)).alias(name)
            for header, (name, kind) in spec.columns.items()
        ]
    )


def read_table(spark: SparkSession, path, spec: TableSpec, sep: str = ",") -> DataFrame:
    return choose(read_header_files(spark, path, sep), spec)


def read_bulk_density(spark: SparkSession, path) -> DataFrame:
    """Cores of the bulk density sheet: its first, unnamed column holds the block code.

    Blank and subtotal rows of the sheet have no such code and are dropped.
    """
    raw = spark.read.options(header=True, nullValue=MISSING_TEXT).csv(path)
    code = raw.columns[0]
    cores = raw.where(F.col(f"`{code}`").rlike("^V[0-9]+$"))
    return cores.select(
        F.col(f"`{code}`").alias("block_code"),
        *[
            F.col(f"`{h}`").try_cast(kind).alias(name)
            for h, (name, kind) in BULK_DENSITY.columns.items()
        ],
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, one file per partition; no row-number column."""
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str, mode: str = "overwrite") -> None:
    """The default hand-off between jobs; readings are usually partitioned by day."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
