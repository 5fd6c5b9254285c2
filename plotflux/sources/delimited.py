"""Header files of any mixture of layouts, columns found by name, files split as usual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotflux.session import durable, join_checked
from plotflux.sources.tables import MISSING_TEXT, TableSpec

BYTE_ORDER_MARK = "\ufeff"
#: Columns that the CSV parser makes room for.
MOST_COLUMNS = 20480


def decoded_path() -> Column:
    """Path of the file a row comes from; blanks and accents as on disk."""
    return F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))


def read_lines(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Lines (``line``, ``path``) of the files of a folder and its sub-folders; long files are split."""
    raw = spark.read.options(pathGlobFilter=glob, recursiveFileLookup=True).text(folder)
    return raw.select(F.col("value").alias("line"), decoded_path().alias("path"))


def with_fields(df: DataFrame, record: str, out: str, width: int, sep: str) -> DataFrame:
    """Add the first ``width`` fields of a delimited record as an array of texts; doubled quotes stand for one.

    The record is parsed in a projection of its own, once, and its fields are listed in the next.
    """
    schema = ", ".join(f"c{i} string" for i in range(width))
    options = {"sep": sep, "nullValue": MISSING_TEXT, "escape": '"', "maxColumns": str(max(width, MOST_COLUMNS))}
    parsed = df.withColumn("_record", F.from_csv(F.col(record), schema, options))
    return parsed.withColumn(out, F.array(*[F.col(f"_record.c{i}") for i in range(width)])).drop("_record")


def with_parts(df: DataFrame, record: str, out: str, sep: str, most: int = MOST_COLUMNS) -> DataFrame:
    """Add the fields of a record without quotes and line breaks, split at its separators, or null for any other record.

    What is empty or marked as missing is still text here.
    """
    plain = F.lit(True)
    for mark in ('"', "\n", "\r", "\0"):
        plain = plain & ~F.contains(F.col(record), F.lit(mark))
    # A mark behind one backslash is split at without a regular expression.
    at = f"\\{sep}" if len(sep) == 1 and sep.isascii() and not sep.isalnum() else f"\\Q{sep}\\E"
    split = df.withColumn("_split", F.when(plain, F.split(record, at)))
    return split.withColumn(out, F.when(F.size("_split") <= most, F.col("_split"))).drop("_split")


def rows_by_name(lines: DataFrame, spec: TableSpec, sep: str = ",") -> DataFrame:
    """Rows of header files from their lines (``line``, ``path``): the columns of ``spec``, and ``path``.

    The header of a file is the line that has all wanted names among its fields. Each file keeps its own
    order of columns; columns that are not wanted are ignored, and a header that occurs again is no row. The
    places of the wanted columns are one small row per file, which is joined to the file's lines, so
    a file may be split and may hold most of all lines. A file without such a line, or with two different ones,
    stops the job. Blank lines are left out; text that is no number becomes missing.
    """
    # Few lines hold either mark; the regular expression is for those only.
    marked = F.contains(F.col("line"), F.lit("\r")) | F.startswith(F.col("line"), F.lit(BYTE_ORDER_MARK))
    text = F.when(marked, F.regexp_replace(F.col("line"), f"^{BYTE_ORDER_MARK}|\r$", "")).otherwise(F.col("line"))
    rows = lines.select(text.alias("line"), "path").where(F.trim("line") != "")
    wanted = list(spec.columns)
    # Most lines fail on the first name.
    names = F.array(*[F.lit(name.replace('"', '""')) for name in wanted])
    # The lines are searched once; what may be a header is about one row per file.
    maybe = durable(rows.where(F.forall(names, lambda name: F.contains(F.col("line"), name))).distinct())
    # Separators inside quotes only make this bound larger than the number of fields.
    width = maybe.agg(F.max(F.size(F.split("line", "\\Q" + sep + "\\E")))).collect()[0][0] or 1
    headers = with_fields(maybe, "line", "_names", width, sep)
    # No filter here: pushed below the projections, it would parse a line once per field.
    header = F.when(F.size(F.array_intersect("_names", F.array(*map(F.lit, wanted)))) == len(wanted), F.col("line"))
    two = F.raise_error(F.concat(F.lit("two different headers in "), F.col("path")))
    places = F.array(*[F.array_position("_names", name).cast("int") - 1 for name in wanted])
    per_file = (
        headers.withColumn("_header", header)
        .groupBy("path")
        .agg(
            F.min("_header").alias("_header"), F.max("_header").alias("_other"),
            F.min(F.when(F.col("_header").isNotNull(), places)).alias("_places"),
        )
        .where("_header is not null")
        .select("path", F.when(F.col("_header") == F.col("_other"), F.col("_header")).otherwise(two).alias("_header"), "_places")
    )
    joined = join_checked(rows, per_file, ["path"])
    none = F.raise_error(F.concat(F.lit(f"no header with the columns {wanted} in "), F.col("path")))
    joined = joined.withColumn("_places", F.coalesce("_places", none.cast("array<int>")))
    # Only records with quotes need the CSV parser.
    parts = with_parts(joined.where(F.col("line") != F.coalesce("_header", F.lit(""))), "line", "_parts", sep)
    quoted = parts.withColumn("_quoted", F.when(F.col("_parts").isNull(), F.col("line")))
    fields = with_fields(quoted, "_quoted", "_fields", width, sep)
    picked = []
    for k, (name, kind) in enumerate(spec.columns.values()):
        place = F.get("_places", F.lit(k))
        part = F.get("_parts", place)
        value = F.coalesce(F.when(~part.isin("", MISSING_TEXT), part), F.get("_fields", place))
        picked.append((value if kind == "string" else value.try_cast(kind)).alias(name))
    return fields.select(*picked, "path")


def read_by_name(spark: SparkSession, folder: str, spec: TableSpec, sep: str = ",", glob: str = "*.csv") -> DataFrame:
    """The wanted columns of every header file of a folder, whatever each file's layout."""
    return rows_by_name(read_lines(spark, folder, glob), spec, sep)
