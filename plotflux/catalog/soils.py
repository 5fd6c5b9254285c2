"""Calibrations, unit conversions and the chemistry jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotflux.catalog.registry import FLUXES, READINGS, fluxes, query, readings, rounded, table
from plotflux.functions import units
from plotflux.operators.clean import constant_lookup
from plotflux.operators.reshape import wide_means
from plotflux.operators.rollup import summarise


@query(f"""WITH {READINGS}, c AS (SELECT event_id, CAST(k * 30 AS DOUBLE) AS c FROM readings),
m AS (SELECT event_id, CAST(0.00000000011338 AS DOUBLE) * c * c + CAST(0.0002821 AS DOUBLE) * c + CAST(-0.22013 AS DOUBLE) AS q,
  CAST(0.0002 AS DOUBLE) * c + CAST(-0.1795 AS DOUBLE) AS l,
  CAST(-0.0000002 AS DOUBLE) * c * c + CAST(0.001 AS DOUBLE) * c + CAST(-0.7437 AS DOUBLE) AS g FROM c)
SELECT event_id, round(CASE WHEN q >= 0 THEN q END, 6) AS vwc, round(l, 6) AS vwc_linear, round(g, 6) AS gsm FROM m""")
def calibration_curves(spark, folder):
    count = F.col("k") * 30
    out = readings(spark, folder).select(
        "event_id",
        units.vwc_quadratic(count).alias("vwc"),
        units.vwc_linear(count).alias("vwc_linear"),
        units.gsm_quadratic(count).alias("gsm"),
    )
    return rounded(out, 6, "vwc", "vwc_linear", "gsm")


@query(f"""WITH {FLUXES}
SELECT collar, day, round(flux / 1000000 * 12.001::DOUBLE * 1000 * 3600, 6) AS flux_mg,
  round(flux / 1000000 * 12.011::DOUBLE * 1000 * 3600, 6) AS flux_mg_exact FROM fluxes""")
def flux_units(spark, folder):
    out = fluxes(spark, folder).select(
        "collar", "day", units.umol_to_mg_carbon("flux").alias("flux_mg"),
        units.umol_to_mg_carbon("flux", 12.011).alias("flux_mg_exact"),
    )
    return rounded(out, 6, "flux_mg", "flux_mg_exact")


_SAMPLES = """s AS (
  SELECT l_orderkey, l_linenumber, l_discount * 10 AS nh4, l_tax * 10 AS no3, 5 + l_quantity / 50 AS freshsoil_g, 0.02::DOUBLE AS kcl_l,
    2.5::DOUBLE + l_tax AS tin, 10 + l_discount AS wet, 10 + l_tax + l_quantity / 100 AS dry_tin FROM lineitem),
d AS (SELECT *, dry_tin - tin AS dry FROM s), g AS (SELECT *, (wet - dry) / dry AS grav FROM d),
p AS (SELECT *, freshsoil_g / (1 + grav) AS drysoil FROM g),
q AS (SELECT *, (freshsoil_g - drysoil) * 0.001::DOUBLE + kcl_l AS liquid FROM p)"""


@query(f"""WITH {_SAMPLES}
SELECT l_orderkey, l_linenumber, round(grav, 6) AS soilm_grav, round(drysoil, 6) AS drysoil_sample_g, round(liquid, 6) AS liquid_sample_l,
  round(nh4 * liquid / drysoil, 6) AS mg_nh4_gsoil, round(no3 * liquid / drysoil * 1000, 4) AS mg_no3_kgsoil FROM q""")
def extract_chemistry(spark, folder):
    samples = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_discount") * 10).alias("nh4"),
        (F.col("l_tax") * 10).alias("no3"),
        (5 + F.col("l_quantity") / 50).alias("freshsoil_g"),
        F.lit(0.02).alias("kcl_l"),
        (2.5 + F.col("l_tax")).alias("soilm_tin"),
        (10 + F.col("l_discount")).alias("soilm_wet_g"),
        (10 + F.col("l_tax") + F.col("l_quantity") / 100).alias("soilm_dry_tin"),
    )
    made = units.extraction_chemistry(samples, {"nh4": "mg_nh4", "no3": "mg_no3"}, "kcl_l").select(
        "l_orderkey", "l_linenumber", "soilm_grav", "drysoil_sample_g", "liquid_sample_l", "mg_nh4_gsoil",
        "mg_no3_kgsoil",
    )
    digits = {"soilm_grav": 6, "drysoil_sample_g": 6, "liquid_sample_l": 6, "mg_nh4_gsoil": 6, "mg_no3_kgsoil": 4}
    return rounded(made, digits)


_POOLS = f"""WITH {FLUXES}, m AS (SELECT collar, season, avg(flux) AS c, avg(temperature) AS n FROM fluxes GROUP BY 1, 2),
w AS (SELECT collar, max(CASE WHEN season = 'F' THEN c END) AS cf, max(CASE WHEN season = 'O' THEN c END) AS cu,
  max(CASE WHEN season = 'F' THEN n END) AS nf, max(CASE WHEN season = 'O' THEN n END) AS nu FROM m GROUP BY 1),
b AS (SELECT *, cf / 0.45::DOUBLE - cu AS mbc, nf / 0.45::DOUBLE - nu AS mbn FROM w)"""


def _pools(spark, folder):
    names = {"flux": "mean_c", "temperature": "mean_n"}
    wide = wide_means(fluxes(spark, folder), ["collar"], "season", ["F", "O"], names)
    return wide.withColumns(
        {
            "mbc": units.biomass("mean_c_F", "mean_c_O"),
            "mbn": units.biomass("mean_n_F", "mean_n_O"),
            "mbc_difference": units.biomass("mean_c_F", "mean_c_O", correct_difference=True),
        }
    )


@query(f"""{_POOLS}
SELECT collar, round(mbc, 6) AS mbc, round(mbn, 6) AS mbn, round((cf - cu) / 0.45::DOUBLE, 6) AS mbc_difference FROM b""")
def biomass(spark, folder):
    out = _pools(spark, folder).select("collar", "mbc", "mbn", "mbc_difference")
    return rounded(out, 6, "mbc", "mbn", "mbc_difference")


@query(f"""{_POOLS}, r AS (SELECT *, cu / nullif(nu, 0) AS dcn, mbc / nullif(mbn, 0) AS mbcn, cu / nullif(mbc, 0) AS doc_per_mbc FROM b)
SELECT collar, round(dcn, 6) AS dcn, round(mbcn, 6) AS mbcn, round(doc_per_mbc, 6) AS doc_per_mbc,
  round(dcn / nullif(mbcn, 0), 6) AS imbalance, round(nf + nu, 6) AS inorganic_n FROM r""")
def element_ratios(spark, folder):
    pools = _pools(spark, folder).withColumns(
        {
            "dcn": units.ratio("mean_c_O", "mean_n_O"),
            "mbcn": units.ratio("mbc", "mbn"),
            "doc_per_mbc": units.ratio("mean_c_O", "mbc"),
            "inorganic_n": F.col("mean_n_F") + F.col("mean_n_O"),
        }
    )
    out = pools.withColumn("imbalance", units.stoichiometric_imbalance("dcn", "mbcn")).select(
        "collar", "dcn", "mbcn", "doc_per_mbc", "imbalance", "inorganic_n"
    )
    return rounded(out, 6, "dcn", "mbcn", "doc_per_mbc", "imbalance", "inorganic_n")


@query("""WITH p AS (SELECT p_partkey, p_size % 4 + 1 AS block, p_retailprice AS cumulative, p_size::DOUBLE AS perc_c FROM part),
d AS (SELECT *, (CASE block WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.66 WHEN 4 THEN 0.87 END)::DOUBLE AS bd FROM p)
SELECT p_partkey, bd AS soil_bd, round(cumulative / 10000 / 5, 8) AS per_cm3, round(cumulative / 10000 / 5 / bd, 8) AS per_gsoil,
  round(cumulative / 10000 / 5 / bd / nullif(perc_c, 0), 8) AS per_biomass, round(perc_c / 100 * bd * 5 * 100000, 3) AS stock_kg_ha,
  round(perc_c / 100 * bd * 5 * 100, 6) AS stock_mg_ha, round(perc_c / 100 * bd * 5 * 10, 6) AS stock_kg_m2,
  round(cumulative / 1000000 / 0.33699::DOUBLE, 8) AS yearly_kg_m2 FROM d""")
def stock_and_rate_units(spark, folder):
    parts = table(spark, folder, "part").select(
        "p_partkey",
        (F.col("p_size") % 4 + 1).alias("block"),
        F.col("p_retailprice").alias("cumulative"),
        F.col("p_size").cast("double").alias("perc_c"),
    )
    dense = constant_lookup(parts, "block", units.BULK_DENSITY_BY_BLOCK, "soil_bd")
    volume = dense.withColumn("per_cm3", units.per_cm3("cumulative"))
    mass = volume.withColumn("per_gsoil", units.ratio("per_cm3", "soil_bd"))
    out = mass.select(
        "p_partkey",
        "soil_bd",
        "per_cm3",
        "per_gsoil",
        units.ratio("per_gsoil", "perc_c").alias("per_biomass"),
        units.carbon_stock("perc_c", "soil_bd", "kg_ha").alias("stock_kg_ha"),
        units.carbon_stock("perc_c", "soil_bd", "Mg_ha").alias("stock_mg_ha"),
        units.carbon_stock("perc_c", "soil_bd", "kg_m2").alias("stock_kg_m2"),
        units.yearly_rate("cumulative").alias("yearly_kg_m2"),
    )
    return rounded(
        out,
        {"per_cm3": 8, "per_gsoil": 8, "per_biomass": 8, "stock_kg_ha": 3, "stock_mg_ha": 6,
         "stock_kg_m2": 6, "yearly_kg_m2": 8},
    )


@query("""SELECT p_brand AS block, round(avg(p_retailprice / 680.124::DOUBLE), 6) AS mean_density,
  round(stddev_samp(p_retailprice / 680.124::DOUBLE), 6) AS sd_density, count(*) AS n FROM part GROUP BY 1""")
def bulk_density(spark, folder):
    cores = table(spark, folder, "part").select(
        F.col("p_brand").alias("block"), units.bulk_density("p_retailprice").alias("density")
    )
    return rounded(summarise(cores, ["block"], ["density"], count=True), 6, "mean_density", "sd_density")
