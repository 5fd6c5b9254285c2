"""Laboratory files: a preamble, then a header line, columns chosen by name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotflux.functions.scalars import split_part
from plotflux.operators.clean import CONTROL_SAMPLE_PATTERN, exclude_matching
from plotflux.sources.delimited import BYTE_ORDER_MARK, decoded_path, with_fields

# Layout of the carbon analyser's files.
PREAMBLE_LINES = 9
CARBON_COLUMNS = {"Sample Name": "sample_id", "Result(NPOC)": "npoc_mg_l", "Result(TN)": "tdn_mg_l"}

#: Stands for the end of a record while quoted line breaks are kept (a control character of text files).
RECORD_END = "\x1e"


def records(text: Column) -> Column:
    """The records of a delimited text: its lines, but a line break inside quotes belongs to its record.

    Quotes open and close in turn, so breaks in every second part between quotes are inside; a doubled quote is two
    of them with nothing between. One pass over the text.
    """
    parts = F.split(text, '"', -1)
    marked = F.transform(parts, lambda part, k: F.when(k % 2 == 0, F.regexp_replace(part, "\r?\n|\r", RECORD_END)).otherwise(part))
    return F.split(F.array_join(marked, '"'), RECORD_END, -1)


def rows_by_header(files: DataFrame, columns: Mapping[str, str], preamble: int = 0, sep: str = ",") -> DataFrame:
    """Text columns from whole files (``text``, ``path``), picked by the header of each file.

    ``preamble`` lines come before the header; quotes count from the header on. A record may go over
    several lines where they are quoted. A file without one of the headers stops the job. Files may have any
    number of columns: the longest header is measured first.
    """
    body = F.regexp_replace("text", f"^{BYTE_ORDER_MARK}?(?:[^\r\n]*(?:\r\n|\n|\r)){{{preamble}}}", "")
    files = files.select(records(body).alias("records"), "path")
    header = F.get("records", F.lit(0))
    width = files.agg(F.max(F.size(F.split(header, "\\Q" + sep + "\\E")))).collect()[0][0] or 1
    files = with_fields(files.withColumn("first", header), "first", "header", width, sep)
    each = files.withColumn("record", F.explode(F.slice("records", 2, F.greatest(F.size("records"), F.lit(1)))))
    rows = with_fields(each.where(F.trim("record") != ""), "record", "fields", width, sep)

    def pick(header):
        position = F.array_position("header", header)
        problem = F.raise_error(F.concat(F.lit(f"no column '{header}' in "), F.col("path")))
        return F.when(position > 0, F.get("fields", (position - 1).cast("int"))).otherwise(problem)

    return rows.select(*[pick(h).alias(name) for h, name in columns.items()], "path").withColumn(
        "filename", split_part("path", "/", -1)
    )


def whole_files(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """One row (``text``, ``path``) per file of a folder and its sub-folders."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return files.select(F.col("value").alias("text"), decoded_path().alias("path"))


def read_by_header(
    spark: SparkSession,
    folder: str,
    columns: Mapping[str, str],
    preamble: int = 0,
    glob: str = "*.csv",
    sep: str = ",",
) -> DataFrame:
    """Text columns picked by the header of each file, whatever its column order.

    One row of the scan is one whole file, since a preamble is told from records only by counting from the
    top; this is for laboratory runs, which are small and many. Files without a preamble
    go through ``delimited.read_by_name``, which splits them.
    """
    return rows_by_header(whole_files(spark, folder, glob), columns, preamble, sep)


def carbon_rows(files: DataFrame, control_pattern: str = CONTROL_SAMPLE_PATTERN) -> DataFrame:
    """Dissolved carbon and nitrogen per sample as text from whole files (``text``, ``path``), control samples removed."""
    return exclude_matching(rows_by_header(files, CARBON_COLUMNS, PREAMBLE_LINES), "sample_id", control_pattern)


def read_carbon_files(
    spark: SparkSession, folder: str, control_pattern: str = CONTROL_SAMPLE_PATTERN
) -> DataFrame:
    """``carbon_rows`` of all laboratory files of a folder."""
    return carbon_rows(whole_files(spark, folder), control_pattern)
