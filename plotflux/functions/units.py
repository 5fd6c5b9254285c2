"""Calibration curves and unit conversions. Every constant is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotflux.functions.scalars import censor

# Calibration coefficients (square, linear, constant) and laboratory constants.
VWC_QUADRATIC = (0.00000000011338, 0.0002821, -0.22013)
VWC_LINEAR = (0.0002, -0.1795)
GSM_QUADRATIC = (-0.0000002, 0.001, -0.7437)
CARBON_G_PER_MOL = 12.001
SAMPLING_DEPTH_CM = 5
YEAR_FRACTION = 0.33699
EXTRACTION_EFFICIENCY = 0.45
CYLINDER_CM3 = 680.124
BULK_DENSITY_BY_BLOCK = {1: 1.00, 2: 1.00, 3: 0.66, 4: 0.87}


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def quadratic(count: Column | str, coefficients: tuple[float, float, float]) -> Column:
    c = _c(count).cast("double")
    a, b, k = coefficients
    return F.lit(a) * (c * c) + F.lit(b) * c + F.lit(k)


def vwc_quadratic(count: Column | str, coefficients=VWC_QUADRATIC) -> Column:
    """Volumetric water content; a negative reading is instrument noise, so missing."""
    return censor(quadratic(count, coefficients), lower=0.0)


def vwc_linear(count: Column | str, coefficients=VWC_LINEAR) -> Column:
    """Volumetric water content, linear curve, not censored."""
    b, k = coefficients
    return F.lit(b) * _c(count).cast("double") + F.lit(k)


def gsm_quadratic(count: Column | str, coefficients=GSM_QUADRATIC) -> Column:
    """Gravimetric water content."""
    return quadratic(count, coefficients)


def umol_to_mg_carbon(flux: Column | str, carbon: float = CARBON_G_PER_MOL) -> Column:
    """micromol per m2 and second to mg carbon per m2 and hour."""
    return _c(flux) / 1000000 * carbon * 1000 * 3600


def extraction_chemistry(
    df: DataFrame,
    concentrations: dict[str, str],
    extractant_l: str,
    per_kg: bool = True,
) -> DataFrame:
    """Concentrations (mg per litre) to mg per g, and per kg, of dry soil.

    ``concentrations`` maps a concentration column to the name its result takes,
    e.g. ``{"nh4": "mg_nh4"}`` gives ``mg_nh4_gsoil`` and ``mg_nh4_kgsoil``.
    Weighing columns carry the names used in the metadata tables.
    """
    df = (
        df.withColumn("soilm_dry_g", F.col("soilm_dry_tin") - F.col("soilm_tin"))
        .withColumn(
            "soilm_grav", F.try_divide(F.col("soilm_wet_g") - F.col("soilm_dry_g"), F.col("soilm_dry_g"))
        )
        .withColumn("drysoil_sample_g", F.try_divide(F.col("freshsoil_g"), 1 + F.col("soilm_grav")))
        .withColumn(
            "liquid_sample_l",
            (F.col("freshsoil_g") - F.col("drysoil_sample_g")) * 0.001 + F.col(extractant_l),
        )
    )
    for source, name in concentrations.items():
        df = df.withColumn(
            f"{name}_gsoil",
            F.try_divide(F.col(source) * F.col("liquid_sample_l"), F.col("drysoil_sample_g")),
        )
    if per_kg:
        df = df.withColumns({f"{n}_kgsoil": F.col(f"{n}_gsoil") * 1000 for n in concentrations.values()})
    return df


def biomass(
    fumigated: Column | str,
    unfumigated: Column | str,
    efficiency: float = EXTRACTION_EFFICIENCY,
    correct_difference: bool = False,
) -> Column:
    """Microbial pool from a fumigated and an unfumigated extract.

    By default the efficiency divides the fumigated extract only;
    ``correct_difference`` divides the difference of both.
    """
    f, u = _c(fumigated), _c(unfumigated)
    return (f - u) / efficiency if correct_difference else f / efficiency - u


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient; missing for a zero denominator."""
    return F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double"))


def stoichiometric_imbalance(dissolved_ratio: Column | str, biomass_ratio: Column | str) -> Column:
    """Element ratio of the substrate over that of the biomass living on it."""
    return ratio(dissolved_ratio, biomass_ratio)


def per_cm3(per_m2: Column | str, depth_cm: float = SAMPLING_DEPTH_CM) -> Column:
    """Per square metre to per cubic centimetre of the sampled layer."""
    return _c(per_m2) / 10000 / depth_cm


def carbon_stock(
    percent: Column | str,
    bulk_density: Column | str,
    unit: str = "kg_m2",
    depth_cm: float = SAMPLING_DEPTH_CM,
) -> Column:
    """Stock of an element in the sampled layer from its percentage."""
    scale = {"kg_ha": 100000, "Mg_ha": 100, "kg_m2": 10}[unit]
    return _c(percent) / 100 * _c(bulk_density) * depth_cm * scale


def yearly_rate(
    cumulative_mg_m2: Column | str, unit: str = "kg_m2", year_fraction: float = YEAR_FRACTION
) -> Column:
    """Cumulative flux over part of a year to a yearly rate, kg per m2 or per ha."""
    per_m2 = _c(cumulative_mg_m2) / 1000000 / year_fraction
    return per_m2 * {"kg_m2": 1, "kg_ha": 10000}[unit]


def bulk_density(dry_g: Column | str, volume_cm3: float = CYLINDER_CM3) -> Column:
    return _c(dry_g) / volume_cm3
