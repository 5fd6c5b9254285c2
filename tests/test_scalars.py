import datetime as dt
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plotflux.functions import bins, scalars, units


def one(spark, value, kind, *columns):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return tuple(df.select(*columns).first())


def test_numbers_with_either_decimal_mark(spark):
    df = spark.createDataFrame([(v,) for v in ("21.5", " 21,5 ", "x", "", None)], "x string")
    assert [r[0] for r in df.select(scalars.try_number("x")).collect()] == [21.5, 21.5, None, None, None]


def test_dates_in_two_formats(spark):
    df = spark.createDataFrame(
        [(v,) for v in ("2021-10-24 09:05:00", "10/24/21 9:05", "10/24/2021 9:05", "yesterday", None)],
        "x string",
    )
    got = [r[0] for r in df.select(scalars.parse_timestamp("x", scalars.FLUX_DATE_FORMATS)).collect()]
    assert got == [dt.datetime(2021, 10, 24, 9, 5)] * 3 + [None, None]


def test_two_digit_years(spark):
    df = spark.createDataFrame([("1/2/68",), ("1/2/69",), ("1/04/22",)], "x string")
    got = [r[0] for r in df.select(scalars.parse_date("x")).collect()]
    assert got == [dt.date(2068, 1, 2), dt.date(1969, 1, 2), dt.date(2022, 1, 4)]


def test_local_time_crosses_midnight(spark):
    got = one(
        spark, dt.datetime(2021, 10, 5, 2, 15), "timestamp_ntz", scalars.utc_to_local("x"), scalars.hour_floor("x")
    )
    assert got == (dt.datetime(2021, 10, 4, 20, 15), dt.datetime(2021, 10, 5, 2, 0))


def test_hours_since_epoch(spark):
    assert one(spark, dt.date(1970, 1, 3), "date", scalars.hours_since_epoch("x")) == (48.0,)


def test_key_with_a_missing_part_is_missing(spark):
    df = spark.createDataFrame([("3", 13), ("3", None)], "a string, b int")
    assert [r[0] for r in df.select(scalars.compound_key("a", "b", F.lit("con"))).collect()] == ["3-13-con", None]


def test_split_part(spark):
    got = one(
        spark, "data_94206101_0.csv", "string", scalars.split_part("x", "_", 2), scalars.split_part("x", "_", -1),
        scalars.split_part("x", "_", 9), scalars.split_part("x", ".", 2),
    )
    assert got == ("94206101", "0.csv", None, "csv")


def test_censor_keeps_the_row(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (226.0,), (None,)], "x double")
    both = df.select(scalars.censor("x", 0, 225))
    assert [r[0] for r in both.collect()] == [None, 0.0, None, None]


def test_transforms_outside_their_domain(spark):
    df = spark.createDataFrame([(-4.0,), (0.0,), (100.0,)], "x double")
    got = df.select(scalars.safe_sqrt("x"), scalars.safe_log10("x"), scalars.square("x")).collect()
    assert [tuple(r) for r in got] == [(None, None, 16.0), (0.0, None, 0.0), (10.0, 2.0, 10000.0)]


def test_row_mean_is_missing_with_any_part(spark):
    df = spark.createDataFrame([(46, 52, 47), (1, None, 3)], "a int, b int, c int")
    got = [r[0] for r in df.select(scalars.row_mean("a", "b", "c")).collect()]
    assert abs(got[0] - 145 / 3) < 1e-12 and got[1] is None


def test_casts(spark):
    df = spark.createDataFrame([("1.5", 2, "x")], "a string, b int, c string")
    assert scalars.cast_columns(df, ["a", "c"]).first()[:] == (1.5, 2, None)
    assert dict(scalars.cast_by_type(df, ["int"]).dtypes)["b"] == "double"
    assert scalars.numeric_columns(df) == ["b"]


def test_season_rules_disagree_in_december(spark):
    got = one(
        spark, dt.datetime(2021, 12, 5, 21, 0), "timestamp_ntz",
        bins.season_by_date(F.col("x").cast("date")), bins.season_by_month("x"), bins.day_or_night("x"),
        bins.month_name("x"),
    )
    assert got == ("dry", "wet", "night", "December")


def test_bins_of_missing_values_are_missing(spark):
    got = one(
        spark, None, "timestamp_ntz", bins.season_by_month("x"), bins.day_or_night("x"), bins.month_name("x")
    )
    assert got == (None, None, None)


def test_day_ends_with_hour_twenty(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 1, h),) for h in (6, 7, 20, 21)], "x timestamp_ntz")
    assert [r[0] for r in df.select(bins.day_or_night("x")).collect()] == ["night", "day", "day", "night"]


def test_level_order(spark):
    df = spark.createDataFrame([("warming",), ("control",), ("other",)], "x string")
    assert [r[0] for r in df.select(scalars.level_order("x", ["warming", "control"])).collect()] == [1, 2, None]


def test_calibrations(spark):
    got = one(
        spark, 1000, "int", units.vwc_quadratic("x"), units.vwc_linear("x"), units.gsm_quadratic("x"),
        units.umol_to_mg_carbon(F.lit(1.0)),
    )
    expected = (1.1338e-10 * 1e6 + 0.2821 - 0.22013, 0.2 - 0.1795, -0.2 + 1.0 - 0.7437, 43.2036)
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, expected))
    assert one(spark, 10, "int", units.vwc_quadratic("x")) == (None,)


def test_biomass_switch(spark):
    df = spark.createDataFrame([(0.9, 0.2)], "f double, u double")
    a, b = df.select(units.biomass("f", "u"), units.biomass("f", "u", correct_difference=True)).first()
    assert abs(a - 1.8) < 1e-12 and abs(b - 0.7 / 0.45) < 1e-12


def test_stocks_and_rates(spark):
    df = spark.createDataFrame([(10.0, 0.66)], "c double, bd double")
    got = df.select(
        units.carbon_stock("c", "bd", "kg_ha"), units.carbon_stock("c", "bd", "Mg_ha"), units.carbon_stock("c", "bd"),
        units.per_cm3(F.lit(50000.0)), units.yearly_rate(F.lit(336990.0)), units.ratio("c", F.lit(0.0)),
    ).first()
    expected = (33000.0, 33.0, 3.3, 1.0, 1.0)
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, expected)) and got[5] is None


def test_bulk_density_of_blocks(spark):
    # Dry masses of the cores of three blocks and their published means and spreads.
    cores = {
        "V1": (630.44, 652.64, 725.51, 699.52, 677.95),
        "V2": (395.83, 245.95, 443.05, 503.6),
        "V3": (503.47, 679.05, 587.99),
    }
    from plotflux.operators.rollup import summarise

    df = spark.createDataFrame([(b, v) for b, vs in cores.items() for v in vs], "block string, dry double")
    out = rows(summarise(df.withColumn("d", units.bulk_density("dry")), ["block"], ["d"]))
    for (_, mean, sd), (m, s) in zip(out, ((1.00, 0.0551), (0.58, 0.1617), (0.87, 0.1291))):
        assert abs(mean - m) < 0.005 and abs(sd - s) < 5e-4


@pytest.mark.parametrize(
    "text",
    ["2022-01-05 07:30:00", "2022-1-5 7:30:00.250", "2022-01-05T07:30:00Z", "2022/1/5 07:30", "2022.01.05 07:30:00", "1/5/2022 7:30", "1/5/22 7:30:00", "1-5-2022 7:30"],
)
def test_dates_of_many_exports(spark, text):
    (got,) = one(spark, text, "string", scalars.parse_timestamp("x", scalars.FLUX_DATE_FORMATS))
    assert got.replace(microsecond=0).isoformat() == "2022-01-05T07:30:00"


def test_dates_are_tried_by_their_shape_alone(spark):
    """A text meets only the formats of its shape, and comes out as if all had been tried in turn."""
    shapes = [scalars.date_shape(f) for f in scalars.FLUX_DATE_FORMATS]
    fitting = {"2022-01-05 07:30:00": [0], "1/5/2022 7:30": [1], "1/5/22 7:30:00": [2], "2022.01.05 07:30": [5], "1-5-2022 7:30": [6], "yesterday": [], "31/31/1999": []}
    for text, expected in fitting.items():
        assert [k for k, shape in enumerate(shapes) if re.search(shape, text)] == expected
    assert scalars.date_shape("d MMM yyyy") is None and scalars.date_shape("h a") is None and scalars.date_shape("yyyy''M") is None
    rng = random.Random(3)
    texts = set()
    for _ in range(3000):
        year = rng.choice(["2021"] * 6 + ["21", "68", "69", "0021", "+12021", "-2021", "221", "+2021"])
        month, day = (rng.choice([str(rng.randrange(1, 13)), f"{rng.randrange(1, 13):02d}"] * 6 + ["0", "13", "-1", "012"]) for _ in range(2))
        sep = rng.choice("-/.")
        hour = rng.choice(["9:05", "09:05", "23:59"] * 3 + ["24:00", "-0:05"]) + rng.choice(["", ":07", ":07", ":60"])
        end = rng.choice([""] * 9 + [".2", ".25", ".250", ".2501", "Z", "z", ".25Z", "\n", " x"])
        date = sep.join(rng.choice([(year, month, day), (month, day, year)]))
        texts.add(rng.choice(["", " "]) + date + rng.choice([" ", " ", " ", "T", "t", "  "]) + hour + end)
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "x string")
    formats = [f for f in scalars.FLUX_DATE_FORMATS if f != "M/d/yy H:mm[:ss]"]
    plain = F.coalesce(*[F.try_to_timestamp(F.trim("x"), F.lit(f)).cast("timestamp_ntz") for f in formats])
    got = df.select("x", scalars.parse_timestamp("x", formats).alias("got"), plain.alias("expected"))
    assert got.where("expected is not null").count() > 150
    assert got.where("not got <=> expected").count() == 0
