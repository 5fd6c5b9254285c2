"""Flux observations to campaign means, cumulative flux and its models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotflux.functions.bins import month_name, season_by_date, season_by_month
from plotflux.functions.scalars import (
    censor,
    compound_key,
    hour_floor,
    hours_since_epoch,
    safe_log10,
    safe_sqrt,
    square,
)
from plotflux.functions.units import umol_to_mg_carbon
from plotflux.operators.clean import CAMPAIGN_DAYS, campaign_lookup, quality_filter
from plotflux.operators.design import crossed
from plotflux.operators.integrate import trapezoid
from plotflux.operators.joins import keyed_join
from plotflux.operators.linear import anova_oneway, anova_strata
from plotflux.operators.mixed import MixedFit, mixed_model
from plotflux.operators.reshape import to_wide
from plotflux.operators.rollup import measures, se, summarise, zscore

# Highest plausible campaign mean, collar left out of the integral.
MAX_MEAN_FLUX = 225.0
EXCLUDED_COLLARS = ("3-13-con",)


def clean_fluxes(
    fluxes: DataFrame,
    season_rule: str = "date",
    campaigns: Mapping[str, Sequence[str]] = CAMPAIGN_DAYS,
) -> DataFrame:
    """Good fits only, negative fluxes missing, mass units, season, month and campaign."""
    day = F.col("ts").cast("date")
    season = season_by_date(day) if season_rule == "date" else season_by_month("ts")
    cleaned = quality_filter(fluxes, "exp_r2").withColumns(
        {
            "day": day,
            "hour_start": hour_floor("ts"),
            "flux_umol": censor("exp_flux", lower=0.0),
            "season": season,
            "month_name": month_name("ts"),
            "plot_id": compound_key("block", "plot"),
        }
    )
    cleaned = cleaned.withColumn("flux_mg", umol_to_mg_carbon("flux_umol"))
    return campaign_lookup(cleaned, "day", campaigns)


def with_microclimate(fluxes: DataFrame, hourly: DataFrame) -> DataFrame:
    """Every flux with the microclimate of its collar and hour.

    ``hourly`` has one row per collar and hour, so no flux is repeated.
    """
    return keyed_join(fluxes, hourly, ["collar", "hour_start"], "left")


def campaign_means(fluxes: DataFrame) -> DataFrame:
    """Campaign means per collar, with the standard error of the flux."""
    keys = ["campaign_day", "block", "plot", "treatment", "season", "collar"]
    columns = {
        "flux_mg": "flux",
        "flux_umol": "flux_umol",
        "mean_air_t": "air_t",
        "mean_soil_t": "soil_t",
        "mean_surface_t": "surface_t",
        "mean_vwc": "vwc",
        "sd_vwc": "vwc_sd",
    }
    return fluxes.groupBy(*keys).agg(
        *measures(columns, ("mean",)), se("flux_mg").alias("se_flux")
    )


def model_table(
    campaigns: DataFrame, day_night: DataFrame, max_flux: float = MAX_MEAN_FLUX, censor_first: bool = True
) -> DataFrame:
    """Campaign means with day and night microclimate, z-scores and transforms.

    Implausible means are censored before the transforms are taken; with ``censor_first=False`` the
    transforms are those of all means and only the mean itself is censored, as the analysis once did.
    """
    joined = keyed_join(campaigns, day_night, ["collar", "season"], "left")
    scored = zscore(
        joined,
        ["mean_air_t", "mean_soil_t", "mean_surface_t", "mean_vwc", "mean_vwc_sd"]
        + [f"{c}_{t}" for c in ("soil_t", "surface_t", "air_t") for t in ("day", "night")],
    )
    kept = censor("mean_flux", upper=max_flux)
    transformed = kept if censor_first else F.col("mean_flux")
    return scored.withColumns(
        {
            "mean_flux": kept,
            "sqrt_flux": safe_sqrt(transformed),
            "log_flux": safe_log10(transformed),
            "z_mean_soil_t_2": square("z_mean_soil_t"),
            "campaign_number": F.unix_date("campaign_day").cast("double"),
        }
    )


def cumulative_flux(campaigns: DataFrame, exclude: Sequence[str] = EXCLUDED_COLLARS) -> DataFrame:
    """Flux integrated over the campaigns, per collar."""
    hours = campaigns.where(~F.col("collar").isin(*exclude)).withColumn(
        "hours", hours_since_epoch("campaign_day")
    )
    return trapezoid(
        hours, ["collar", "treatment", "block", "plot"], "hours", "mean_flux", "cumulative_flux"
    )


def cumulative_anova(cumulative: DataFrame) -> DataFrame:
    return anova_oneway(cumulative, "cumulative_flux", "treatment")


def flux_models(table: DataFrame) -> dict[str, MixedFit]:
    """The flux models on campaign means, collars nested in blocks."""
    t, t2 = "z_mean_soil_t", "z_mean_soil_t_2"
    specs = {
        "campaign": ("sqrt_flux", [("campaign_number", "treatment")]),
        "season": ("sqrt_flux", [("season", "treatment")]),
        "temperature": ("log_flux", [(t,), (t2,)]),
        "temperature x treatment": ("log_flux", [(t, "treatment"), (t2, "treatment")]),
        "temperature x moisture x treatment": (
            "log_flux",
            [(t, "z_mean_vwc", "treatment"), (t2, "z_mean_vwc", "treatment")],
        ),
    }
    return {
        name: mixed_model(
            table, response, crossed(*products), ["block", "collar"], ["treatment", "season"]
        )
        for name, (response, products) in specs.items()
    }


def observation_anova(fluxes: DataFrame) -> DataFrame:
    """Treatment, month and block (numeric) between and within collars."""
    return anova_strata(
        fluxes, "flux_umol", crossed(("treatment", "month_name", "block")), "collar",
        ["treatment", "month_name"],
    )


def daily_means(fluxes: DataFrame) -> DataFrame:
    """Daily means per collar; one missing value makes the day's mean missing."""
    columns = {
        "flux_mg": "flux",
        "mean_soil_t": "soil_t",
        "mean_surface_t": "surface_t",
        "mean_air_t": "air_t",
        "mean_gsm": "gsm",
        "mean_vwc": "vwc",
    }
    keys = ["treatment", "block", "plot", "collar", "day", "season"]
    return summarise(fluxes, keys, columns, ("mean",), na_rm=False)


def daily_models(daily: DataFrame) -> dict[str, MixedFit]:
    """Daily flux against microclimate, and against treatment, season and block."""
    micro = [("mean_soil_t",), ("mean_surface_t",), ("mean_air_t",), ("mean_gsm",)]
    specs = {
        "microclimate": micro,
        "without surface": [micro[0], micro[2], micro[3]],
        "soil and moisture": [micro[0], micro[3]],
        "soil, moisture and treatment": [micro[0], micro[3], ("treatment",)],
        "treatment, season and block": [("treatment",), ("season",), ("block",)],
        "treatment x season x block": [("treatment", "season", "block")],
    }
    return {
        name: mixed_model(
            daily, "mean_flux", crossed(*products), ["collar"], ["treatment", "season", "block"]
        )
        for name, products in specs.items()
    }


def observation_model(fluxes: DataFrame) -> MixedFit:
    """Single fluxes by treatment, season and block (numeric), collars as groups."""
    return mixed_model(
        fluxes, "flux_umol", crossed(("treatment", "season", "block")), ["collar"], ["treatment", "season"]
    )


def season_means(fluxes: DataFrame) -> DataFrame:
    """Mean flux per season, plot and treatment."""
    return summarise(
        fluxes, ["season", "plot_id", "treatment"], {"flux_umol": "flux_umol", "flux_mg": "flux"}, ("mean",)
    )


def season_columns(means: DataFrame, seasons: Sequence[str] = ("dry", "wet")) -> DataFrame:
    """``season_means`` side by side: one row per plot and treatment with ``mean_flux_umol`` and ``mean_flux_mg`` of each season."""
    return to_wide(means, ["plot_id", "treatment"], "season", seasons, ["mean_flux_umol", "mean_flux_mg"])
