"""Logger readings to hourly microclimate, treatment differences and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotflux.functions.bins import day_or_night, season_by_date, season_by_month
from plotflux.functions.scalars import hour_floor
from plotflux.functions.units import gsm_quadratic, vwc_linear, vwc_quadratic
from plotflux.operators.clean import date_window
from plotflux.operators.design import crossed
from plotflux.operators.mixed import MixedFit, mixed_model
from plotflux.operators.reshape import contrast, to_long, wide_means
from plotflux.operators.rollup import hourly_rollup, sd, summarise, summary_sets

# The analysis window.
WINDOW = ("2021-10-03", "2022-02-02")
TEMPERATURES = ("subsoil_t", "surface_t", "air_t")
MOISTURES = ("vwc", "gsm")
SHORT = {"subsoil_t": "soil_t", "surface_t": "surface_t", "air_t": "air_t", "vwc": "vwc", "gsm": "gsm"}


def prepare_readings(
    readings: DataFrame,
    window: tuple[str, str] = WINDOW,
    season_rule: str = "date",
    moisture_curve: str = "quadratic",
) -> DataFrame:
    """Readings of the analysis window with moisture, time of day and season.

    ``season_rule`` is ``date`` (cut-off date) or ``month``; ``moisture_curve`` is
    ``quadratic`` (negatives missing) or ``linear`` (kept).
    """
    kept = date_window(readings, "ts", *window)
    season = season_by_date(F.col("ts").cast("date")) if season_rule == "date" else season_by_month("ts")
    curve = vwc_quadratic if moisture_curve == "quadratic" else vwc_linear
    return kept.withColumns(
        {
            "vwc": curve("soilm_count"),
            "gsm": gsm_quadratic("soilm_count"),
            "timeofday": day_or_night("ts"),
            "season": season,
        }
    )


def hourly_by_collar(readings: DataFrame) -> DataFrame:
    """Mean of every channel, and spread of moisture, per collar and hour."""
    return hourly_rollup(readings, ["collar"], "ts", SHORT, extra=[sd("vwc").alias("sd_vwc")])


def treatment_differences(readings: DataFrame) -> DataFrame:
    """Treated minus control per plot and hour.

    A missing reading makes the hour's mean missing, so a difference only stands
    for complete hours of both sides.
    """
    wide = wide_means(
        readings.withColumn("hour_start", hour_floor("ts")), ["block", "plot", "hour_start"], "treatment",
        ["control", "warming"], {c: f"mean_{name}" for c, name in SHORT.items()}, na_rm=False,
    )
    return contrast(wide, {f"mean_{name}": f"{name}_diff" for name in SHORT.values()})


def temperature_profile(differences: DataFrame) -> DataFrame:
    """Mean and sd of the temperature differences per hour of the day."""
    names = [f"{SHORT[c]}_diff" for c in TEMPERATURES]
    long = to_long(
        differences.withColumn("hour", F.hour("hour_start")), ["hour"], names, "sensor", "difference"
    )
    return summarise(long, ["hour", "sensor"], ["difference"])


def moisture_profile(differences: DataFrame) -> DataFrame:
    """Mean and sd of the moisture differences per month."""
    names = [f"{c}_diff" for c in MOISTURES]
    long = to_long(
        differences.withColumn("month", F.month("hour_start")), ["month"], names, "measure", "difference"
    )
    return summarise(long, ["month", "measure"], ["difference"])


def summary_tables(readings: DataFrame) -> DataFrame:
    """Temperature and moisture by season, time of day, treatment and their pairs."""
    return summary_sets(
        readings,
        {
            "season": ["season"],
            "timeofday": ["timeofday"],
            "treatment": ["treatment"],
            "timeofday x treatment": ["timeofday", "treatment"],
            "season x treatment": ["season", "treatment"],
        },
        ["subsoil_t", "air_t", "vwc"],
    )


def day_night_means(readings: DataFrame, keys: tuple[str, ...] = ("collar", "season")) -> DataFrame:
    """Day and night means side by side per collar, by default also per season."""
    channels = {c: SHORT[c] for c in (*TEMPERATURES, "vwc")}
    return wide_means(readings, keys, "timeofday", ["day", "night"], channels)


def microclimate_model(readings: DataFrame, channel: str, nested: bool = True) -> MixedFit:
    """Effect of treatment on one channel.

    Nested: by season and, for temperatures, time of day, collars within blocks.
    Otherwise temperatures by time of day, moisture by season, collars alone.
    """
    warm = channel in TEMPERATURES
    season, timeofday = ("treatment", "season"), ("treatment", "timeofday")
    if nested:
        products, groups = [season, timeofday] if warm else [season], ["block", "collar"]
    else:
        products, groups = [timeofday] if warm else [season], ["collar"]
    return mixed_model(
        readings, channel, crossed(*products), groups, ["treatment", "season", "timeofday"]
    )
