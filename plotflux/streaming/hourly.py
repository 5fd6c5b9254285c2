"""Hourly roll-up of logger files as they arrive in a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plotflux.sources.delimited import decoded_path
from plotflux.sources.instruments import LOGGER_FILE_PATTERN, LOGGER_SCHEMA, logger_columns


def stream_logger_files(
    spark: SparkSession, folder: str, file_pattern: str = LOGGER_FILE_PATTERN, files_per_batch: int = 1000
) -> DataFrame:
    """The files of a folder and its sub-folders as a stream with the columns of ``read_logger_files``."""
    raw = (
        spark.readStream.schema(LOGGER_SCHEMA)
        .options(sep=";", header=False, recursiveFileLookup=True, maxFilesPerTrigger=files_per_batch)
        .csv(folder)
    )
    return logger_columns(raw.withColumn("path", decoded_path()), file_pattern)


def hourly_partials(
    readings: DataFrame, partials: str, checkpoint: str, keys: Sequence[str], columns: Sequence[str], ts: str = "ts_utc"
) -> StreamingQuery:
    """Start writing each batch's sums per key and hour below ``partials``; nothing is ever too late.

    Loggers are read out one after the other, weeks apart, so no watermark fits them all. A batch
    writes the count, mean and squared deviations of its own readings into the folder of its
    number, and overwrites it when it runs again; ``merge_hours`` puts the batches together. Both folders
    must be shared by all executors.
    """
    hour = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz").alias("hour_start")
    parts = [
        x
        for c in columns
        for x in (
            F.count(c).alias(f"n_{c}"),
            F.avg(c).alias(f"m_{c}"),
            (F.var_pop(c) * F.count(c)).alias(f"q_{c}"),
        )
    ]

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys, hour).agg(*parts).write.mode("overwrite").parquet(f"{partials}/batch={number}")

    return readings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def merge_hours(
    spark: SparkSession, partials: str, keys: Sequence[str], columns: Sequence[str], stats: Sequence[str] = ("mean",)
) -> DataFrame:
    """The hourly table of all batches so far, equal to the batch roll-up: ``stats`` of mean, sd and n.

    An hour whose readings came in several batches has a row in each; they are merged by their counts,
    around a common centre so that large means cost no digits.
    """
    return _merged(_valid(spark.read.parquet(partials)), keys, columns, stats)


def _valid(rows: DataFrame) -> DataFrame:
    """Without the batches that a compaction has taken over: folder ``-(k + 1)`` stands for all batches up to ``k``."""
    least = rows.agg(F.min("batch").cast("long").alias("b")).scalar()
    return rows.where((least >= 0) | (F.col("batch") == least) | (F.col("batch") > -least - 1))


def compact_hours(
    spark: SparkSession, partials: str, keys: Sequence[str], columns: Sequence[str], keep: int = 1
) -> int | None:
    """Merge the folders of all batches but the last ``keep`` into one, so that reading lists few files for ever.

    Only the last batch may still be written again, so it is kept. The merged sums are written aside, then moved in
    place in one step under the number that takes over the merged batches, whose folders go at last. A
    run that breaks off in between leaves either the old folders or superseded ones; ``merge_hours`` gives the
    same result at every moment. Returns the last merged batch, or None when there was nothing to do.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(partials)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in system.listStatus(root)]
    numbers = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
    waiting = [n for n in numbers if n >= 0]
    if len(waiting) <= keep:
        return None
    upto = waiting[-keep - 1] if keep else waiting[-1]
    rows = _valid(spark.read.parquet(partials)).where(F.col("batch") <= upto)
    sums = _merged(rows, keys, columns, ("n", "mean", "sd"))
    parts = [
        x
        for c in columns
        for x in (
            F.col(f"n_{c}"),
            F.col(f"mean_{c}").alias(f"m_{c}"),
            F.when(F.col(f"n_{c}") > 1, F.col(f"sd_{c}") ** 2 * (F.col(f"n_{c}") - 1)).when(F.col(f"n_{c}") == 1, 0.0).alias(f"q_{c}"),
        )
    ]
    aside = f"{partials}/_merged-{upto}"
    sums.select(*keys, "hour_start", *parts).write.mode("overwrite").parquet(aside)
    if not system.rename(hadoop.Path(aside), hadoop.Path(f"{partials}/batch={-upto - 1}")):
        raise RuntimeError(f"could not move {aside} in place")
    for n in numbers:
        if n <= upto:
            system.delete(hadoop.Path(f"{partials}/batch={n}"), True)
    return upto


def _merged(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], stats: Sequence[str]) -> DataFrame:
    centres = rows.groupBy(*keys, "hour_start").agg(
        *[F.max(f"m_{c}").alias(f"_c_{c}") for c in columns],
        F.collect_list(F.struct(*[f"{k}_{c}" for c in columns for k in "nmq"])).alias("_parts"),
    )
    out: list[Column] = []
    for c in columns:
        n = _sum("n", c)
        shift = F.try_divide(_sum("nm", c), n)
        spread = _sum("q", c) + _sum("nmm", c) - n * shift * shift
        made = {
            "n": n.cast("long"),
            "mean": F.col(f"_c_{c}") + shift,
            "sd": F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1))),
        }
        out += [made[s].alias(f"{s}_{c}") for s in stats]
    return centres.select(*keys, "hour_start", *out)


def _sum(what: str, column: str) -> Column:
    """Sum over an hour's batches of n, q, or n times the (squared) distance of the mean from the centre."""

    def part(p: Column) -> Column:
        away = F.coalesce(p[f"m_{column}"] - F.col(f"_c_{column}"), F.lit(0.0))
        n = p[f"n_{column}"].cast("double")
        return {"n": n, "q": F.coalesce(p[f"q_{column}"], F.lit(0.0)), "nm": n * away, "nmm": n * away * away}[what]

    return F.aggregate("_parts", F.lit(0.0), lambda total, p: total + part(p))
