"""Laboratory values to one wide row per collar, with tables, models and correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotflux.functions.scalars import (
    cast_by_type,
    cast_columns,
    censor,
    compound_key,
    row_mean,
    safe_sqrt,
)
from plotflux.functions.units import (
    BULK_DENSITY_BY_BLOCK,
    biomass,
    carbon_stock,
    extraction_chemistry,
    per_cm3,
    ratio,
    stoichiometric_imbalance,
    yearly_rate,
)
from plotflux.operators.clean import constant_lookup
from plotflux.operators.correlate import pearson_tests, spearman_matrix, with_significance
from plotflux.operators.design import crossed
from plotflux.operators.joins import join_chain, natural_join
from plotflux.operators.linear import LinearFit, linear_model
from plotflux.operators.reshape import contrast, to_wide
from plotflux.operators.rollup import measures

# Limits beyond which a laboratory value is an outlier to leave out.
LIMITS = {
    "mg_c_gsoil_uf": (None, 0.3),
    "dcn": (None, 25.0),
    "mbc": (0.0, None),
    "mbcn": (0.0, 20.0),
    "mg_nh4_kgsoil": (None, 14.0),
}
CORRELATED = (
    "cumulative_flux",
    "mg_c_gsoil_uf",
    "mg_n_gsoil_uf",
    "mbc",
    "mbn",
    "dcn",
    "mbcn",
    "mg_nh4_gsoil",
    "mg_no3_gsoil",
    "perc_c",
    "perc_n",
    "c_n_ratio",
    "cover",
    "soil_ph",
)


def dissolved_pools(lab: DataFrame, metadata: DataFrame) -> DataFrame:
    """Dissolved carbon and nitrogen per g of dry soil; incomplete samples are dropped."""
    joined = natural_join(lab.select("sample_id", "npoc_mg_l", "tdn_mg_l"), metadata)
    numbers = cast_columns(joined, ["npoc_mg_l", "tdn_mg_l"])
    made = extraction_chemistry(
        numbers, {"npoc_mg_l": "mg_c", "tdn_mg_l": "mg_n"}, "k2so4_l", per_kg=False
    )
    return made.dropna("any")


def microbial_biomass(pools: DataFrame, correct_difference: bool = False) -> DataFrame:
    """Fumigated and unfumigated pools side by side, biomass and element ratios."""
    wide = to_wide(
        pools, ["collar", "block", "plot", "treatment"], "fum", ["fum", "uf"],
        ["mg_c_gsoil", "mg_n_gsoil"],
    )
    with_biomass = wide.withColumns(
        {
            "mbc": biomass("mg_c_gsoil_fum", "mg_c_gsoil_uf", correct_difference=correct_difference),
            "mbn": biomass("mg_n_gsoil_fum", "mg_n_gsoil_uf", correct_difference=correct_difference),
        }
    )
    return with_biomass.withColumns(
        {"mbcn": ratio("mbc", "mbn"), "dcn": ratio("mg_c_gsoil_uf", "mg_n_gsoil_uf")}
    )


def nitrogen_and_carbon(
    inorganic: DataFrame, metadata: DataFrame, bulk: DataFrame, bulk_metadata: DataFrame
) -> DataFrame:
    """Inorganic nitrogen per g and kg of dry soil with total carbon and nitrogen."""
    total = natural_join(bulk, bulk_metadata)
    extracts = natural_join(inorganic, metadata, "full")
    made = extraction_chemistry(extracts, {"nh4": "mg_nh4", "no3": "mg_no3"}, "kcl_l")
    return natural_join(made, total)


def vegetation_cover(cover: DataFrame) -> DataFrame:
    grids = cast_by_type(cover, ["int"])
    mean = row_mean("grid_1", "grid_2", "grid_3")
    return grids.select("collar", mean.alias("cover")).withColumn("sqrt_cover", safe_sqrt("cover"))


def soil_ph(ph: DataFrame) -> DataFrame:
    return ph.select(compound_key("block", "unit", "treat").alias("collar"), "soil_ph")


def average_rates(campaigns: DataFrame) -> DataFrame:
    """Mean of the campaign means per collar."""
    columns = {"mean_flux": "rate", "mean_air_t": "airtemp", "mean_soil_t": "soiltemp", "mean_vwc": "soilm"}
    return campaigns.groupBy("collar", "treatment").agg(*measures(columns, ("mean",)))


def master_table(
    registry: DataFrame,
    rates: DataFrame,
    cumulative: DataFrame,
    day_night: DataFrame,
    microbial: DataFrame,
    nitrogen: DataFrame,
    cover: DataFrame,
    ph: DataFrame,
    bulk_density: Mapping = BULK_DENSITY_BY_BLOCK,
    seasons: DataFrame | None = None,
) -> DataFrame:
    """One row per collar with every measure, mass-based rates and stocks.

    Block and plot come from the registry, so a collar left out of the integral
    still finds its soil values. ``seasons`` (``flux.season_columns``) adds the season means of the plot side by side.
    """
    keyed = ["collar", "treatment"]
    base = rates.join(registry.select("collar", "block", "plot"), "collar", "left")
    plot = ["collar", "block", "plot", "treatment"]
    soil = nitrogen.select(
        *plot, "mg_nh4_gsoil", "mg_no3_gsoil", "mg_nh4_kgsoil", "mg_no3_kgsoil",
        "perc_c", "perc_n", "c_n_ratio",
    )
    wide = join_chain(
        base,
        [
            (cumulative.select(*keyed, "cumulative_flux"), keyed),
            (day_night, ["collar"]),
            (microbial, plot),
            (soil, plot),
            (cover, ["collar"]),
            (ph, ["collar"]),
        ],
    )
    if seasons is not None:
        named = wide.withColumn("plot_id", compound_key("block", "plot"))
        wide = join_chain(named, [(seasons, ["plot_id", "treatment"])]).drop("plot_id")
    wide = constant_lookup(wide, "block", bulk_density, "soil_bd")
    volume = wide.withColumns(
        {
            "cumulative_cm3": per_cm3("cumulative_flux"),
            "rate_cm3": per_cm3("mean_rate"),
            "inorganic_n": F.col("mg_nh4_gsoil") + F.col("mg_no3_gsoil"),
            "stock_kg_ha": carbon_stock("perc_c", "soil_bd", "kg_ha"),
            "stock_mg_ha": carbon_stock("perc_c", "soil_bd", "Mg_ha"),
            "stock_kg_m2": carbon_stock("perc_c", "soil_bd", "kg_m2"),
            "yearly_kg_m2": yearly_rate("cumulative_flux"),
        }
    )
    mass = volume.withColumns(
        {
            "cumulative_gsoil": ratio("cumulative_cm3", "soil_bd"),
            "rate_gsoil": ratio("rate_cm3", "soil_bd"),
        }
    )
    return mass.withColumns(
        {
            "cumulative_per_mbc": ratio("cumulative_gsoil", "mbc"),
            "rate_per_mbc": ratio("rate_gsoil", "mbc"),
        }
    )


def treatment_means(master: DataFrame, columns: Sequence[str]) -> DataFrame:
    return master.groupBy("treatment").agg(*measures(columns, ("mean", "sd")))


def overall_means(master: DataFrame, columns: Sequence[str]) -> DataFrame:
    return master.agg(*measures(columns, ("mean", "sd")))


def treatment_model(
    table: DataFrame, response: str, limits: tuple[float | None, float | None] = (None, None)
) -> LinearFit:
    """Square root of a laboratory value by treatment, values beyond the limits left out."""
    lower, upper = limits
    kept = table.withColumn("_y", safe_sqrt(censor(response, lower, upper)))
    return linear_model(kept, "_y", [("treatment",)], ["treatment"])


def treatment_models(table: DataFrame, responses: Sequence[str]) -> dict[str, LinearFit]:
    return {r: treatment_model(table, r, LIMITS.get(r, (None, None))) for r in responses}


# Plot left out of the models for its dissolved carbon; measures set side by side.
EXCLUDED_PLOT = "2-17"
CONTRASTED = {
    "mean_flux": "flux",
    "mg_c_gsoil_uf": "doc",
    "mg_n_gsoil_uf": "tdn",
    "mbc": "mbc",
    "mbn": "mbn",
    "mg_nh4_gsoil": "nh4",
    "mg_no3_gsoil": "no3",
    "inorganic_n": "inorganic_n",
    "perc_c": "perc_c",
    "perc_n": "perc_n",
    "c_n_ratio": "c_n_ratio",
}


def season_table(season_means: DataFrame, microbial: DataFrame, nitrogen: DataFrame) -> DataFrame:
    """Season means of the flux with the soil values of their plot, which repeat per season."""
    chemistry = nitrogen.select(
        "collar", "mg_nh4_gsoil", "mg_no3_gsoil", "perc_c", "perc_n", "c_n_ratio"
    )
    soil = natural_join(microbial.withColumn("plot_id", compound_key("block", "plot")), chemistry)
    joined = natural_join(season_means, soil)
    return joined.withColumns(
        {
            "inorganic_n": F.col("mg_nh4_gsoil") + F.col("mg_no3_gsoil"),
            "doc_per_mbc": ratio("mg_c_gsoil_uf", "mbc"),
            "imbalance": stoichiometric_imbalance("dcn", "mbcn"),
        }
    )


def plot_contrasts(table: DataFrame, kind: str = "ratio") -> DataFrame:
    """Treated against control per plot and season, with both sides kept.

    ``kind`` is ``ratio``, ``percent`` or ``difference``; columns are ``d_{measure}``.
    """
    wide = to_wide(
        table, ["plot_id", "season", "block"], "treatment", ["control", "warming"], list(CONTRASTED)
    )
    return contrast(wide, {c: f"d_{name}" for c, name in CONTRASTED.items()}, kind)


def season_models(table: DataFrame) -> dict[str, LinearFit]:
    """Flux of a season against the pools of its plot."""
    wet, dry = (table.where(F.col("season") == s) for s in ("wet", "dry"))
    usual = F.col("plot_id") != EXCLUDED_PLOT
    t, mbc, doc = "treatment", "mbc", "mg_c_gsoil_uf"
    specs = {
        "wet: treatment x mbc": (wet, [(t, mbc)]),
        "dry: treatment x doc": (dry.where(usual), [(t, doc)]),
        "carbon pools": (table, [(mbc,), (doc,)]),
        "nitrogen pools": (table, [("perc_n",), ("inorganic_n",), ("mbn",), ("mg_n_gsoil_uf",), (t,)]),
        "wet: doc per mbc x treatment": (wet.where(usual), [("doc_per_mbc", t)]),
        "wet: mbc and doc x treatment": (wet.where(usual), [(mbc,), (doc, t)]),
        "wet: pools and quality": (wet, [(mbc,), (doc,), ("dcn",)]),
        "dry: pools and quality": (dry, [(mbc,), (doc,), ("dcn",)]),
    }
    return {
        name: linear_model(rows, "mean_flux", crossed(*products), [t])
        for name, (rows, products) in specs.items()
    }


def ratio_models(contrasts: DataFrame) -> dict[str, LinearFit]:
    """Does the response to warming depend on what the soil holds without it?"""
    carbon, nitrogen = ("perc_c_control",), ("inorganic_n_control",)
    return {
        "carbon by carbon": linear_model(contrasts, "d_perc_c", [carbon]),
        "carbon by carbon and nitrogen": linear_model(contrasts, "d_perc_c", [carbon, nitrogen]),
        "flux by carbon and nitrogen": linear_model(contrasts, "d_flux", [carbon, nitrogen]),
    }


def block_models(table: DataFrame, responses: Sequence[str]) -> dict[str, LinearFit]:
    """Soil values of the dry season by block and treatment."""
    dry = table.where(F.col("season") == "dry")
    factors = ["block", "treatment"]
    return {r: linear_model(dry, r, crossed(("block", "treatment")), factors) for r in responses}


def collar_model(master: DataFrame) -> LinearFit:
    """Cumulative flux against soil carbon by treatment."""
    return linear_model(master, "cumulative_flux", crossed(("perc_c", "treatment")), ["treatment"])


def correlations(master: DataFrame, columns: Sequence[str] = CORRELATED) -> tuple[DataFrame, DataFrame]:
    """Rank correlations over complete collars, and pairwise tests with their marks."""
    return spearman_matrix(master, columns), with_significance(pearson_tests(master, columns))
