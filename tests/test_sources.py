"""Instrument and laboratory files written in the test, and the three analyses on them."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from plotflux.plans import flux, microclimate, soil
from plotflux.sources import delimited, instruments, laboratory, tables
from plotflux.streaming.hourly import compact_hours, hourly_partials, merge_hours, stream_logger_files

BOM = "﻿"
COLLARS = [(b, p, t) for b in (1, 2) for p in (2 * b, 2 * b + 1) for t in ("con", "war")]


def sensor(i):
    return f"9420{61 + i // 100}{i % 100:02d}"


@pytest.fixture(scope="module")
def site(tmp_path_factory):
    """A folder of files as the instruments and the laboratory leave them."""
    root = tmp_path_factory.mktemp("field site é")
    rng = np.random.default_rng(6)
    registry = ["Collar,Block,Plot,Treatment,sensorID"]
    loggers, lab = root / "logger data", root / "lab"
    fluxes = root / "flux"
    for folder in (loggers, lab, fluxes):
        folder.mkdir()
    days = [dt.date(2021, 10, 3), dt.date(2021, 10, 25), dt.date(2021, 12, 17)]
    header = (
        "Label\tFile Name\tDate_IV\tObs#\tOffset\tArea\tInstrument Name\tPre-purge\tDead Band\t"
        "Observation Length\tPost-purge\tExp_Flux\tExp_R2\tTcham_IV\tPressure_IV\tRH_IV\tComments"
    )
    exports = {1: [header], 2: [header]}
    for i, (b, p, t) in enumerate(COLLARS):
        collar, warm = f"{b}-{p}-{t}", t == "war"
        registry.append(f"{collar},{b},{p},{'warming' if warm else 'control'},{sensor(i)}")
        lines = []
        for day in days:
            for hour in range(6, 30, 4):  # UTC; local time is six hours behind
                time = dt.datetime.combine(day, dt.time()) + dt.timedelta(hours=hour)
                for minute in (0, 30):
                    stamp = (time + dt.timedelta(minutes=minute)).strftime("%Y.%m.%d %H:%M")
                    values = ";".join(f"{v:.2f}".replace(".", ",") for v in (8 + warm + rng.normal(), 9.0, 10 + hour / 10))
                    lines.append(f"{len(lines)};{stamp};0;{values};{1500 + 10 * i};1;0;")
        (loggers / f"data_{sensor(i)}_0.csv").write_text("\n".join(lines) + "\n")
        for k, day in enumerate(days):
            for n in range(3):
                local = dt.datetime.combine(day, dt.time(12, 10 + n))
                which = 1 + k % 2
                text = local.strftime("%Y-%m-%d %H:%M:%S") if which == 1 else f"{local.month}/{local.day}/{local:%y} 12:{10 + n}"
                value = -0.1 if (i, k, n) == (0, 0, 0) else 1 + k + 0.1 * n + (0.5 if warm else 0)
                r2 = 0.5 if (i, k, n) == (1, 0, 0) else 0.95
                exports[which].append(
                    f"{collar}\tf{k}\t{text}\t{n}\t2\t318\tLI\t00:10\t00:20\t01:30\t00:10\t{value}\t{r2}\t11\t70\t80\tnone"
                )
    (loggers / "notes.csv").write_text("not a logger file\n")
    (loggers / "data_1_0.csv").write_text("0;2021.10.03 00:00;0;1;1;1;1;1;0;\n")
    for k, lines in exports.items():
        (fluxes / f"LI {k}_offset.txt").write_text("\r\n".join(lines) + "\r\n")
    (root / "registry.csv").write_text(BOM + "\r\n".join(registry) + "\r\n", encoding="utf-8")
    meta = ["sample_id,Block,Plot,TRT,Collar,Treatment,FUM,freshsoil_g,soilm_tin,soilm_wet_g,soilm_dry_tin,k2so4_L"]
    runs = [["Sample Name,Result(NPOC),Result(TN),Note"], ["Note,Result(TN),Sample Name,Result(NPOC)"]]
    for i, (b, p, t) in enumerate(COLLARS):
        for f in ("fum", "uf"):
            name = f"{b}-{p} {t} {f}"
            meta.append(f"{name},{b},{p},{t},{b}-{p}-{t},{'warming' if t == 'war' else 'control'},{f},5.0,2.85,10.09,10.47,0.025")
            c, n = (40 + i, 4) if f == "fum" else (20 + i, 2)
            runs[0 if f == "fum" else 1].append(f'"{name}",{c},{n},"a, b"' if f == "fum" else f"x,{n},{name},{c}")
    runs[0] += ["CHECK 1,1,1,", "STD 2,1,1,", "1-2 con lost,n.a.,2,"]
    for k, lines in enumerate(runs):
        preamble = [f"line {j},," for j in range(9)]
        (lab / f"run{k}.csv").write_text("\n".join(preamble + lines) + "\n")
    (root / "toc_metadata.csv").write_text("\n".join(meta) + "\n")
    (root / "inorganic.csv").write_text(
        "ID USUARIO,Block,Plot,treat,Collar,ID LAB,N-NH4+,N-NO3-\n"
        + "".join(f"{b}-{p}-{t}-KCl,{b},{p},{t},{b}-{p}-{t},S,1.2,1.3\n" for b, p, t in COLLARS)
    )
    (root / "inorganic_meta.csv").write_text(
        "ID USUARIO,Block,Plot,Treat,Collar,Extract,Treatment,freshsoil_g,KCL_L,soilm_tin,soilm_wet_g,soilm_dry_tin\n"
        + "".join(
            f"{b}-{p}-{t}-KCl,{b},{p},{t},{b}-{p}-{t},KCl,{'warming' if t == 'war' else 'control'},6.51,0.02,2.85,10.09,10.47\n"
            for b, p, t in COLLARS
        )
    )
    (root / "bulk.csv").write_text(
        "ID USUARIO,ID LAB,C,N,C/N\n" + "".join(f"{b}-{p}-{t},S,{5 + i},{0.5 + i / 10},{12}\n" for i, (b, p, t) in enumerate(COLLARS))
    )
    (root / "bulk_meta.csv").write_text(
        "ID USUARIO,Block,Plot,Treat,Treatment\n"
        + "".join(f"{b}-{p}-{t},{b},{p},{t},{'warming' if t == 'war' else 'control'}\n" for b, p, t in COLLARS)
    )
    (root / "cover.csv").write_text(
        BOM + "Collar,grid_1,grid_2,grid_3,,,long remark\n" + "".join(f"{b}-{p}-{t},40,50,{50 + i},note,,\n" for i, (b, p, t) in enumerate(COLLARS)),
        encoding="utf-8",
    )
    (root / "ph.csv").write_text("block,unit,treat,soil pH\n" + "".join(f"{b},{p},{t},4.{i}\n" for i, (b, p, t) in enumerate(COLLARS)))
    (root / "density.csv").write_text(
        BOM + ",Muestra,ID lata,suelo seco (g),,\nV1,V1-3,11,630.44,,\n,,,,,\nB1&2,V1 avg,1.00,0.05,,\n", encoding="utf-8"
    )
    return root


@pytest.fixture(scope="module")
def readings(spark, site):
    registry = tables.read_table(spark, str(site / "registry.csv"), tables.REGISTRY)
    return instruments.locate_readings(instruments.read_logger_files(spark, str(site / "logger data")), registry)


def test_registry_without_mark_and_carriage_return(spark, site):
    df = tables.read_table(spark, str(site / "registry.csv"), tables.REGISTRY)
    assert df.columns == ["collar", "block", "plot", "treatment", "sensor_id"] and df.count() == 8
    assert dict(df.dtypes)["block"] == "int" and df.first()["sensor_id"] == sensor(0)


def test_logger_files(spark, site):
    # Every serial number counts unless the pattern narrows it.
    assert instruments.read_logger_files(spark, str(site / "logger data")).count() == 8 * 36 + 1
    df = instruments.read_logger_files(spark, str(site / "logger data"), r"^data_942[01]6[1-6][0-9]{2}_[0-4]\.csv$")
    assert df.count() == 8 * 36 and df.where("subsoil_t is null or ts_utc is null").count() == 0
    first = df.where(F.col("index") == 0).orderBy("sensor_id").first()
    assert first["sensor_id"] == sensor(0) and first["filename"] == f"data_{sensor(0)}_0.csv"
    assert "field site é" in first["path"].replace("é", "é") and first["surface_t"] == 9.0


def test_readings_are_placed_and_shifted(readings):
    row = readings.where("index = 0 and collar = '1-2-con'").first()
    assert (row["ts_utc"], row["ts"]) == (dt.datetime(2021, 10, 3, 6), dt.datetime(2021, 10, 3, 0))


def test_flux_files_with_both_date_formats(spark, site):
    df = instruments.read_flux_files(spark, str(site / "flux"))
    assert df.count() == 72 and df.where("ts is null").count() == 0
    assert df.where("day(ts) = 25").first()["ts"].hour == 12
    assert set(r["path"].rsplit("/", 1)[1] for r in df.select("path").distinct().collect()) == {"LI 1_offset.txt", "LI 2_offset.txt"}


def test_flux_files_of_another_layout_stop_the_job(spark, tmp_path):
    (tmp_path / "a_offset.txt").write_text("Label\tExp_R2\nx\t1\n")
    (tmp_path / "b_offset.txt").write_text("Exp_R2\tLabel\n1\tx\n")
    with pytest.raises(Exception):
        tables.read_header_files(spark, str(tmp_path), "\t").collect()


def test_flux_folder_of_several_layouts(spark, tmp_path):
    """Three layouts and orders in one folder, and sub-folder, come out as one frame; surplus columns are ignored."""
    names = list(instruments.FLUX_EXPORT.columns)
    values = {n: f"v{k}" for k, n in enumerate(names)} | {"Date_IV": "2021-10-03 12:10:00", "Exp_Flux": "1.5", "Exp_R2": "0.9", "Obs#": "7", "Offset": "2", "Area": "318", "Tcham_IV": "11", "Pressure_IV": "70", "RH_IV": "80"}
    orders = [names, names[::-1], ["Extra", *names[5:], "More, of it", *names[:5]]]
    (tmp_path / "sub").mkdir()
    for k, order in enumerate(orders):
        lines = [BOM * (k == 1) + "\t".join(order)]
        for i in range(3):
            row = values | {"Label": f"{k}-{i}", "Extra": "x", "More, of it": "9"}
            lines.append("\t".join(row[n] for n in order))
        (tmp_path / ("sub" if k else ".") / f"L{k}_offset.txt").write_text("\r\n".join(lines + ["", ""]), encoding="utf-8")
    df = instruments.read_flux_files(spark, str(tmp_path))
    assert rows(df, "collar") == [(f"{k}-{i}",) for k in range(3) for i in range(3)]
    fixed = df.drop("collar", "path").distinct().collect()
    assert len(fixed) == 1 and (fixed[0]["exp_flux"], fixed[0]["obs"], fixed[0]["rh"]) == (1.5, 7, 80.0)
    assert fixed[0]["ts"] == dt.datetime(2021, 10, 3, 12, 10) and "_places" not in df.columns
    (tmp_path / "bad_offset.txt").write_text("Label\tExp_R2\nx\t1\n")
    with pytest.raises(Exception, match="no header"):
        instruments.read_flux_files(spark, str(tmp_path)).collect()


def test_lines_are_searched_once_for_headers(spark):
    """Before the rows themselves are read, every line is read a single time."""
    read = spark.sparkContext.accumulator(0)

    def counted(row):
        read.add(1)
        return row

    lines = [(f"{i},q,{i}", "x") for i in range(500)] + [("a,junk,b", "x"), ("b,a", "y"), ("1,y", "y")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(lines, 4).map(counted), "line string, path string")
    out = delimited.rows_by_name(df, tables.TableSpec({"b": ("b", "int"), "a": ("a", "string")}))
    assert read.value == len(lines)
    assert out.count() == 501 and rows(out.where("path = 'y'"), "b", "a") == [(1, "y")]


@pytest.mark.parametrize("sep", [",", "\t", ";", "|", "."])
def test_records_without_quotes_are_split(spark, sep):
    """Splitting gives the fields of the CSV parser; records with quotes, line breaks or too many fields are left to it."""
    rng = random.Random(4)
    marks = [sep, sep, sep, "a", "NA", " ", "#", "\\", "'", "\u00e9", "\ufeff", "1", '"', "\n", "\r", "\0"]
    lines = {"".join(rng.choice(marks[: rng.choice([12, 16])]) for _ in range(rng.randrange(1, 10))) for _ in range(2000)}
    lines = {line for line in lines if line.strip(" ")}
    df = spark.createDataFrame([(line,) for line in sorted(lines)], "line string")
    df = delimited.with_fields(delimited.with_parts(df, "line", "parts", sep), "line", "fields", 10, sep)
    split = 0
    for line, parts, fields in df.collect():
        assert (parts is None) == any(mark in line for mark in '"\n\r\0')
        if parts is not None:
            split += 1
            assert [None if p in ("", "NA") else p for p in parts] + [None] * (10 - len(parts)) == fields
    assert split > 500
    few = delimited.with_parts(spark.createDataFrame([(sep.join("abc"),)], "line string"), "line", "parts", sep, most=2)
    assert few.first()["parts"] is None


def test_split_files_keep_their_header(spark, tmp_path):
    """A file cut in many splits is read by the header of its first one."""
    spec = tables.TableSpec({"b": ("b", "int"), "a": ("a", "string")})
    (tmp_path / "x.csv").write_text("a,junk,b\n" + "".join(f'"n {i}, q",j,{i}\n' for i in range(20_000)))
    (tmp_path / "y.csv").write_text("b,a\n1,y\n")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = delimited.read_by_name(spark, str(tmp_path), spec)
        assert df.rdd.getNumPartitions() > 8
        got = df.agg(F.count("b"), F.sum("b"), F.count_if(F.col("a") == F.format_string("n %d, q", F.col("b")))).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert tuple(got) == (20_001, sum(range(20_000)) + 1, 20_000)


def test_records_over_several_lines(spark, tmp_path):
    """Quoted line breaks and doubled quotes stay in their record; quotes of the preamble do not count."""
    text = 'a 5" pipe\nsecond\nSample Name,Note,"Result\n(x)"\n"one\r\ntwo","say ""hi\nthere"" now",1\nplain,,2\n\n"",x,3\n'
    (tmp_path / "r.csv").write_text(text, newline="")
    got = rows(laboratory.read_by_header(spark, str(tmp_path), {"Sample Name": "s", "Note": "n", "Result\n(x)": "r"}, 2), "s", "n", "r")
    assert got == [("one\r\ntwo", 'say "hi\nthere" now', "1"), ("plain", None, "2"), (None, "x", "3")] or got == [
        ("", "x", "3"), ("one\r\ntwo", 'say "hi\nthere" now', "1"), ("plain", None, "2")]


def test_lab_files_are_read_by_header(spark, site):
    got = rows(laboratory.read_carbon_files(spark, str(site / "lab")), "sample_id", "npoc_mg_l", "tdn_mg_l")
    assert len(got) == 17 and ("1-2 con fum", "40", "4") in got and ("1-2 con uf", "20", "2") in got
    with pytest.raises(Exception, match="no column"):
        laboratory.read_by_header(spark, str(site / "lab"), {"Missing": "m"}, 9).collect()


def test_bulk_density_sheet(spark, site):
    assert rows(tables.read_bulk_density(spark, str(site / "density.csv"))) == [("V1", "V1-3", 630.44)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    tables.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).schema("k string, v double").csv(str(tmp_path / "csv"))
    assert rows(back) == rows(df)
    tables.write_parquet(df, str(tmp_path / "parquet"), "k")
    assert rows(spark.read.parquet(str(tmp_path / "parquet")), "k", "v") == rows(df)


def test_missing_text_becomes_null(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Collar,grid_1,grid_2,grid_3\nx,NA,2,bad\n")
    assert rows(tables.read_table(spark, str(tmp_path / "t.csv"), tables.VEGETATION_COVER)) == [("x", None, 2, None)]


@pytest.fixture(scope="module")
def prepared(readings):
    return microclimate.prepare_readings(readings).cache()


def test_microclimate(prepared):
    assert rows(prepared.groupBy("season").count()) == [("dry", 96), ("wet", 192)]
    hourly = microclimate.hourly_by_collar(prepared)
    assert hourly.count() == 8 * 18 and hourly.where("sd_vwc = 0").count() == 8 * 18
    differences = microclimate.treatment_differences(prepared).cache()
    assert differences.count() == 4 * 18
    assert abs(differences.agg(F.avg("soil_t_diff")).first()[0] - 1) < 0.5
    assert abs(differences.agg(F.max(F.abs("air_t_diff"))).first()[0]) < 1e-9
    assert microclimate.temperature_profile(differences).count() == 6 * 3
    assert microclimate.moisture_profile(differences).count() == 2 * 2
    assert microclimate.summary_tables(prepared).count() == 2 + 2 + 2 + 4 + 4
    fit = microclimate.microclimate_model(prepared, "subsoil_t")
    effect = {r["term"]: r["estimate"] for r in fit.coefficients().collect()}["treatment[warming]"]
    assert 0 < effect < 2
    assert microclimate.microclimate_model(prepared, "vwc", nested=False).n == 288


def test_moisture_curves_and_season_rules(readings):
    quadratic = microclimate.prepare_readings(readings)
    linear = microclimate.prepare_readings(readings, season_rule="month", moisture_curve="linear")
    assert rows(linear.groupBy("season").count()) == [("wet", 288)]
    a, b = (df.where("collar = '1-2-con'").agg(F.avg("vwc")).first()[0] for df in (quadratic, linear))
    assert abs(b - (0.0002 * 1500 - 0.1795)) < 1e-9 and a != b


@pytest.fixture(scope="module")
def campaigns(spark, site, prepared):
    registry = tables.read_table(spark, str(site / "registry.csv"), tables.REGISTRY)
    located = instruments.locate_fluxes(instruments.read_flux_files(spark, str(site / "flux")), registry)
    cleaned = flux.clean_fluxes(located)
    joined = flux.with_microclimate(cleaned, microclimate.hourly_by_collar(prepared))
    return flux.campaign_means(joined).cache()


def test_flux_analysis(prepared, campaigns):
    assert campaigns.count() == 24
    first = campaigns.where("collar = '1-2-con' and campaign_day = '2021-10-03'").first()
    # The negative flux is missing from the mean but counts in the standard error.
    factor = 12.001 * 3600 / 1000
    assert abs(first["mean_flux"] - factor * 1.15) < 1e-9
    assert abs(first["se_flux"] - factor * math.sqrt(0.005) / math.sqrt(3)) < 1e-9
    table = flux.model_table(campaigns, microclimate.day_night_means(prepared), max_flux=150.0).cache()
    assert table.where("mean_flux > 150").count() == 0 and table.where("sqrt_flux is null").count() > 0
    assert abs(table.agg(F.avg("z_mean_soil_t")).first()[0]) < 1e-9
    cumulative = flux.cumulative_flux(campaigns, exclude=["1-3-con"]).cache()
    assert cumulative.count() == 7
    got = cumulative.where("collar = '2-4-con'").first()["cumulative_flux"]
    means = [factor * (1.1 + k) for k in range(3)]
    assert abs(got - (24 * 22 * (means[0] + means[1]) / 2 + 24 * 53 * (means[1] + means[2]) / 2)) < 1e-6
    assert flux.cumulative_anova(cumulative).count() == 2


def test_flux_models(campaigns, prepared):
    table = flux.model_table(campaigns, microclimate.day_night_means(prepared)).cache()
    fits = flux.flux_models(table)
    assert len(fits) == 5 and all(f.n == 24 for f in fits.values())


def test_soil_analysis(spark, site, prepared, campaigns):
    read = lambda name, spec: tables.read_table(spark, str(site / name), spec)
    lab = laboratory.read_carbon_files(spark, str(site / "lab"))
    pools = soil.dissolved_pools(lab, read("toc_metadata.csv", tables.EXTRACT_METADATA))
    assert pools.count() == 16
    microbial = soil.microbial_biomass(pools)
    dry, wet = 10.47 - 2.85, 10.09
    sample = 5.0 / (1 + (wet - dry) / dry)
    per_g = ((5.0 - sample) * 0.001 + 0.025) / sample
    got = microbial.where("collar = '1-2-con'").first()
    assert abs(got["mbc"] - (40 * per_g / 0.45 - 20 * per_g)) < 1e-12 and abs(got["dcn"] - 10) < 1e-9
    nitrogen = soil.nitrogen_and_carbon(
        read("inorganic.csv", tables.INORGANIC_N), read("inorganic_meta.csv", tables.INORGANIC_N_METADATA),
        read("bulk.csv", tables.BULK_CN), read("bulk_meta.csv", tables.BULK_CN_METADATA),
    )
    # Published result for these weights and concentrations.
    sample = nitrogen.where("collar = '1-2-con'").first()
    for column, value in (
        ("soilm_grav", 0.324146981627296), ("drysoil_sample_g", 4.91637264618434), ("liquid_sample_l", 0.0215936273538157),
        ("mg_nh4_gsoil", 0.00527062423648657), ("mg_no3_kgsoil", 5.70984292286045),
    ):
        assert abs(sample[column] / value - 1) < 1e-12
    cover = soil.vegetation_cover(read("cover.csv", tables.VEGETATION_COVER))
    master = soil.master_table(
        read("registry.csv", tables.REGISTRY), soil.average_rates(campaigns),
        flux.cumulative_flux(campaigns, exclude=["1-3-con"]),
        microclimate.day_night_means(prepared, ("collar",)), microbial, nitrogen, cover,
        soil.soil_ph(read("ph.csv", tables.SOIL_PH)),
    ).cache()
    assert master.count() == 8 and master.where("soil_ph is null or mbc is null or perc_c is null").count() == 0
    excluded = master.where("collar = '1-3-con'").first()
    assert excluded["cumulative_flux"] is None and excluded["stock_kg_m2"] is not None
    assert soil.treatment_means(master, ["mbc", "perc_c"]).count() == 2
    assert soil.overall_means(master, ["mbc"]).first()["mean_mbc"] > 0
    assert set(soil.treatment_models(master, ["mbc", "soil_ph"])) == {"mbc", "soil_ph"}
    assert soil.collar_model(master).n == 7
    ranks, tests = soil.correlations(master, ["mbc", "perc_c", "cover", "soil_ph"])
    assert ranks.count() == tests.count() == 6 and len(soil.CORRELATED) == 14


def test_daily_and_season_models(spark, site, prepared):
    read = lambda name, spec: tables.read_table(spark, str(site / name), spec)
    registry = read("registry.csv", tables.REGISTRY)
    located = instruments.locate_fluxes(instruments.read_flux_files(spark, str(site / "flux")), registry)
    cleaned = flux.with_microclimate(flux.clean_fluxes(located), microclimate.hourly_by_collar(prepared)).cache()
    daily = flux.daily_means(cleaned).cache()
    # The day with a negative flux has no strict mean.
    assert daily.count() == 24 and daily.where("mean_flux is null").count() == 1
    fits = flux.daily_models(daily)
    assert len(fits) == 6 and all(f.n <= 23 for f in fits.values())
    assert fits["without surface"].vif().count() == 3
    assert flux.observation_model(cleaned).n == 70
    assert flux.observation_anova(cleaned).where("term = 'residuals'").count() == 2
    microbial = soil.microbial_biomass(
        soil.dissolved_pools(
            laboratory.read_carbon_files(spark, str(site / "lab")), read("toc_metadata.csv", tables.EXTRACT_METADATA)
        )
    )
    nitrogen = soil.nitrogen_and_carbon(
        read("inorganic.csv", tables.INORGANIC_N), read("inorganic_meta.csv", tables.INORGANIC_N_METADATA),
        read("bulk.csv", tables.BULK_CN), read("bulk_meta.csv", tables.BULK_CN_METADATA),
    )
    table = soil.season_table(flux.season_means(cleaned), microbial, nitrogen).cache()
    assert table.count() == 16 and table.where("perc_c is null").count() == 0
    ratios = soil.plot_contrasts(table).cache()
    assert ratios.count() == 8
    one = ratios.where("plot_id = '2-4' and season = 'dry'").first()
    assert abs(one["d_flux"] - 3.6 / 3.1) < 1e-9 and abs(one["d_perc_c"] - 10 / 9) < 1e-9
    percent = soil.plot_contrasts(table, "percent").where("plot_id = '2-4' and season = 'dry'").first()
    assert abs(percent["d_perc_c"] - 100 / 9) < 1e-9
    assert len(soil.season_models(table)) == 8 and len(soil.ratio_models(ratios)) == 3
    block = soil.block_models(table, ["perc_c", "mbc"])["perc_c"]
    assert block.names == ["(intercept)", "block[2]", "treatment[warming]", "block[2]:treatment[warming]"]


def test_hourly_stream_equals_batch(spark, tmp_path):
    """Many one-file batches, sub-folders, a sensor that comes last, hours split between files."""
    folder = tmp_path / "loggers"
    for day in range(6):
        for sensor in range(3):
            place = folder / f"visit {sensor}"
            place.mkdir(parents=True, exist_ok=True)
            lines = [
                f"{k};2023.0{sensor + 1}.1{day} {k // 4:02d}:{15 * (k % 4):02d};0;{1 + k};2,5;{1e9 + sensor + k % 7};300;0;0;"
                for k in range(day % 2, 96, 2)
            ]
            (place / f"data_9420610{sensor}_{day}.csv").write_text("\n".join(lines))
    (folder / "notes.csv").write_text("a;b")
    keys, partials = ["sensor_id"], str(tmp_path / "partials")

    def run():
        query = hourly_partials(
            stream_logger_files(spark, str(folder), files_per_batch=1), partials, str(tmp_path / "state"), keys, ["air_t"]
        )
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return merge_hours(spark, partials, keys, ["air_t"], ("mean", "n", "sd"))

    first = run().count()
    late = folder / "visit 0" / "data_94206100_99.csv"
    late.write_text("1;2023.01.10 00:10;0;1;2;1000000003;300;0;0;")
    merged = run()
    batch = (
        instruments.read_logger_files(spark, str(folder))
        .groupBy("sensor_id", F.date_trunc("hour", "ts_utc").cast("timestamp_ntz").alias("hour_start"))
        .agg(F.avg("air_t"), F.count("air_t"), F.stddev_samp("air_t"))
    )
    got, want = rows(merged), rows(batch)
    assert first == len(want) == 3 * 6 * 24
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and a[3] == b[3] and abs(a[2] - b[2]) < 1e-6
        assert (a[4] is None) == (b[4] is None) and (a[4] is None or abs(a[4] - b[4]) < 1e-6)
    # Compacted, a merged folder stands for the earlier batches; what comes later is added to it.
    before = len(list((tmp_path / "partials").glob("batch=*")))
    assert before > 3 and compact_hours(spark, partials, keys, ["air_t"]) is not None
    assert len(list((tmp_path / "partials").glob("batch=*"))) == 2
    compacted = rows(merge_hours(spark, partials, keys, ["air_t"], ("mean", "n", "sd")))
    for a, b in zip(compacted, want, strict=True):
        assert a[:2] == b[:2] and a[3] == b[3] and abs(a[2] - b[2]) < 1e-6
        assert (a[4] is None) == (b[4] is None) and (a[4] is None or abs(a[4] - b[4]) < 1e-6)
    (folder / "visit 0" / "data_94206100_98.csv").write_text("1;2023.01.10 00:20;0;1;2;1000000003;300;0;0;")
    assert sum(r["n_air_t"] for r in run().select("n_air_t").collect()) == sum(b[3] for b in want) + 1
    assert compact_hours(spark, partials, keys, ["air_t"]) is not None and compact_hours(spark, partials, keys, ["air_t"]) is None
