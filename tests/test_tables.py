"""Filters, joins, roll-ups, reshaping, integrals on a few rows."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from plotflux import session
from plotflux.operators import clean, joins, reshape, rollup
from plotflux.operators.integrate import trapezoid
from plotflux.operators.rollup import summary_sets


def day(text):
    return dt.date.fromisoformat(text)


def test_quality_filter_drops_missing(spark):
    df = spark.createDataFrame([(0.9,), (0.8,), (None,)], "r2 double")
    assert rows(clean.quality_filter(df, "r2")) == [(0.9,)]


def test_date_window_is_closed_and_pushed_down(spark, tmp_path):
    stamps = ["2021-10-02 23:59:59", "2021-10-03 00:00:00", "2022-02-02 23:59:59", "2022-02-03 00:00:00"]
    df = spark.createDataFrame([(dt.datetime.fromisoformat(s),) for s in stamps], "ts timestamp_ntz")
    path = str(tmp_path / "readings")
    df.write.parquet(path)
    kept = clean.date_window(spark.read.parquet(path), "ts", "2021-10-03", "2022-02-02")
    assert kept.count() == 2
    assert "GreaterThanOrEqual(ts" in kept._jdf.queryExecution().executedPlan().toString()


def test_date_window_opens_only_its_days(spark, tmp_path):
    from plotflux.sources.tables import write_parquet

    stamps = [dt.datetime(2021, 10, d, h) for d in (2, 3, 4) for h in (0, 23)]
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz").withColumn("day", F.col("ts").cast("date"))
    write_parquet(df, str(tmp_path / "readings"), "day")
    kept = clean.date_window(spark.read.parquet(str(tmp_path / "readings")), "ts", "2021-10-03", "2021-10-03", "day")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 2 and "PartitionFilters: [isnotnull(day" in plan


def test_control_samples_are_dropped_case_sensitively(spark):
    df = spark.createDataFrame([("CHECK 1",), ("check",), ("Untitled",), ("1-2 CON",)], "id string")
    assert rows(clean.exclude_matching(df, "id")) == [("1-2 CON",), ("check",)]


def test_campaign_lookup(spark):
    df = spark.createDataFrame([(day(d),) for d in ("2021-10-04", "2021-10-24", "2022-02-03", "2022-03-01")], "day date")
    got = dict(rows(clean.campaign_lookup(df, "day")))
    assert got == {
        day("2021-10-04"): day("2021-10-03"),
        day("2021-10-24"): day("2021-10-25"),
        day("2022-02-03"): day("2022-02-02"),
        day("2022-03-01"): None,
    }


def test_campaigns_from_gaps(spark):
    days = ["2021-10-03", "2021-10-04", "2021-10-04", "2021-10-24", "2021-10-26", "2021-11-05"]
    df = spark.createDataFrame([("a", day(d)) for d in days] + [("b", day("2021-10-04")), ("b", None)], "k string, day date")
    got = rows(clean.label_campaigns(df, ["k"], "day", 3), "k", "day", "campaign", "campaign_day")
    assert [(r[0], r[2], str(r[3])) for r in got] == [
        ("a", 1, "2021-10-03"), ("a", 1, "2021-10-03"), ("a", 1, "2021-10-03"), ("a", 2, "2021-10-24"),
        ("a", 2, "2021-10-24"), ("a", 3, "2021-11-05"), ("b", 1, "2021-10-04"), ("b", None, "None"),
    ]


def test_constant_lookup(spark):
    df = spark.createDataFrame([(1,), (3,), (9,), (None,)], "block int")
    assert rows(clean.constant_lookup(df, "block", {1: 1.0, 3: 0.66}, "bd")) == [(1, 1.0), (3, 0.66), (9, None), (None, None)]


LEFT = [(1, "a", 10.0), (1, "a", 11.0), (2, "b", 20.0), (None, "c", 30.0)]
RIGHT = [(1, "x"), (3, "y"), (None, "z")]


def sides(spark):
    return (
        spark.createDataFrame(LEFT, "k int, name string, v double"),
        spark.createDataFrame(RIGHT, "k int, extra string"),
    )


@pytest.mark.parametrize("salts", [1, 5])
def test_missing_keys_match(spark, salts):
    left, right = sides(spark)
    got = rows(joins.natural_join(left, right, salts=salts), "k", "v", "extra")
    assert got == [(1, 10.0, "x"), (1, 11.0, "x"), (2, 20.0, None), (None, 30.0, "z")]


def test_full_join_fills_keys(spark):
    left, right = sides(spark)
    got = rows(joins.natural_join(left, right, "full"), "k", "v", "extra")
    assert got == [(1, 10.0, "x"), (1, 11.0, "x"), (2, 20.0, None), (3, None, "y"), (None, 30.0, "z")]


def test_relationship_is_checked(spark):
    left, right = sides(spark)
    assert joins.shared_columns(left, right) == ["k"]
    joins.natural_join(left, right, relationship="many-to-one").count()
    with pytest.raises(ValueError):
        joins.natural_join(left, right, relationship="one-to-one")
    with pytest.raises(ValueError):
        joins.natural_join(left, right.withColumnRenamed("k", "q"))


def test_join_of_a_frame_with_its_own_summary(spark):
    left, _ = sides(spark)
    means = left.groupBy("k").agg(F.avg("v").alias("m"))
    for cells in (10**6, 0):
        got = rows(session.join_checked(left, means, ["k"], max_cells=cells), "v", "m")
        assert got == [(10.0, 10.5), (11.0, 10.5), (20.0, 20.0), (30.0, 30.0)]


def test_join_chain_keeps_unmatched(spark):
    left, right = sides(spark)
    base = left.select("k").distinct()
    out = joins.join_chain(base, [(right, ["k"]), (left.groupBy("k").count(), ["k"])])
    assert rows(out) == [(1, "x", 2), (2, None, 1), (None, "z", 1)]


@pytest.mark.parametrize("weight", ["count", None])
def test_hot_keys_are_split(spark, weight):
    values = [7.0] * 600 + [float(i) for i in range(300)] + [None] * 3
    df = spark.createDataFrame([(v,) for v in values], "x double")
    lookup = df.where("x is not null").groupBy("x").count().withColumn("y", F.col("x") * 2)
    joined = session.hot_key_join(df, lookup, ["x"], weight=weight, hot_share=0.1, salts=4)
    got = joined.agg(
        F.count(F.lit(1)), F.sum((F.col("y") == F.col("x") * 2).cast("int")), F.count_if(F.col("y").isNull())
    ).first()
    assert tuple(got) == (903, 900, 3)


GROUPED = [("a", 1.0), ("a", 2.0), ("a", None), ("b", 5.0), ("c", None)]


def test_means_spreads_and_errors(spark):
    df = spark.createDataFrame(GROUPED, "g string, x double")
    got = rows(rollup.summarise(df, ["g"], ["x"], ("mean", "sd", "se", "sum", "n"), count=True))
    sd = math.sqrt(0.5)
    assert got[0][:2] == ("a", 1.5) and got[0][4:] == (3.0, 2, 3)
    assert abs(got[0][2] - sd) < 1e-12 and abs(got[0][3] - sd / math.sqrt(3)) < 1e-12
    assert got[1] == ("b", 5.0, None, None, 5.0, 1, 1)
    assert got[2] == ("c", None, None, None, 0.0, 0, 1)
    valid = rows(rollup.summarise(df, ["g"], ["x"], ("se",), se_n="valid"))
    assert abs(valid[0][1] - sd / math.sqrt(2)) < 1e-12


def test_strict_mean(spark):
    df = spark.createDataFrame(GROUPED, "g string, x double")
    got = rows(rollup.summarise(df, ["g"], ["x"], ("mean",), na_rm=False))
    assert got == [("a", None), ("b", 5.0), ("c", None)]


def test_mean_of_means_counts_each_inner_group_once(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 1, 0.0), ("a", 1, 0.0), ("a", 2, 8.0)], "g string, i int, x double")
    assert rows(rollup.mean_of_means(df, ["g", "i"], ["g"], ["x"])) == [("a", 4.0)]


def test_summary_sets_agree_with_plain_groupings(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {"s": rng.choice(["wet", "dry"], 300), "t": rng.choice(["c", "w"], 300), "x": rng.normal(size=300) + 1000}
    )
    pdf.loc[:20, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None)))
    out = rollup.summary_sets(df, {"s": ["s"], "s x t": ["s", "t"]}, ["x"]).toPandas()
    assert len(out) == 6
    for _, r in out.iterrows():
        part = pdf[(pdf.s == r.s) & ((pdf.t == r.t) if r.grouping == "s x t" else True)].x
        assert abs(part.mean() - r.mean_x) < 1e-9 and abs(part.std() - r.sd_x) < 1e-7


def test_spreads_of_groups_far_apart(spark):
    """Every group keeps its own spread, however far another one lies."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"s": ["wet"] * 2000 + ["dry"] * 2000, "t": rng.choice(["c", "w"], 4000), "x": rng.normal(size=4000)})
    pdf.loc[2000:, "x"] += 1.7e9
    out = rollup.summary_sets(spark.createDataFrame(pdf), {"s": ["s"], "s x t": ["s", "t"]}, ["x"]).toPandas()
    assert len(out) == 6
    for _, r in out.iterrows():
        part = pdf[(pdf.s == r.s) & ((pdf.t == r.t) if r.grouping == "s x t" else True)].x
        assert abs(part.std() - r.sd_x) < 1e-6


def _sides_with_hot_keys(spark):
    left = [("hot", f"l{i}") for i in range(40)] + [(None, f"n{i}") for i in range(40)] + [(f"k{i}", "l") for i in range(30)] + [("only left", f"a{i}") for i in range(30)]
    right = [("hot", f"r{i}") for i in range(35)] + [(None, "m")] + [(f"k{i}", "r") for i in range(20, 50)] + [("only right", f"b{i}") for i in range(30)]
    return spark.createDataFrame(left, "k string, a string"), spark.createDataFrame(right, "k string, b string")


def test_full_join_with_hot_and_missing_keys(spark):
    left, right = _sides_with_hot_keys(spark)
    split = session.full_join(left, right, ["k"], hot_share=0.1, least=0)
    plain = session.null_safe_join(left, right, ["k"], "full")
    assert split.columns == plain.columns and rows(split) == rows(plain)
    assert split.count() == 40 * 35 + 40 + 40 + 10 + 30 + 30


def test_inner_join_with_hot_keys(spark):
    left, right = _sides_with_hot_keys(spark)
    split = session.inner_join(left, right, ["k"], hot_share=0.1, least=0)
    assert rows(split) == rows(session.null_safe_join(left, right, ["k"], "inner")) and split.count() == 40 * 35 + 40 + 10


def test_lookup_beyond_the_broadcast_size_copies_nothing(spark):
    """Beyond the broadcast size only the lookup rows of hot keys are broadcast."""
    keys = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 100_000).alias("g")
    df = spark.range(300_000).select(keys, F.col("id").cast("double").alias("x"))
    stats = df.groupBy("g").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("held"))
    joined = session.join_checked(df, stats, ["g"], max_cells=1000, weight="held")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    want = df.groupBy("g").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("m") * F.col("n"))).first()[0]
    assert joined.count() == 300_000 and abs(joined.agg(F.sum("m")).first()[0] / want - 1) < 1e-12


def test_zscores(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0), ("b", 5.0), ("c", 1.0)], "g string, x double")
    whole = [r for r in rollup.zscore(df, ["x"]).toPandas().z_x.dropna()]
    assert abs(np.mean(whole)) < 1e-12 and abs(np.std(whole, ddof=1) - 1) < 1e-12
    inside = rows(rollup.zscore_within(df, ["g"], ["x"]), "g", "z_x")
    assert [r[1] for r in inside if r[0] != "a"] == [None, None, None]
    assert abs(inside[0][1] + math.sqrt(0.5)) < 1e-12 or abs(inside[0][1] - math.sqrt(0.5)) < 1e-12
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert rows(rollup.zscore(flat, ["x"]), "z_x") == [(None,), (None,)]


def test_mean_via_lookup(spark):
    facts = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, None), (9, 7.0)], "k int, x double")
    lookup = spark.createDataFrame([(1, "p"), (2, "p")], "k int, p string")
    assert rows(rollup.mean_via_lookup(facts, "k", "x", lookup, ["p"])) == [("p", 2.0, 3)]


def test_unpivot_then_pivot_is_the_identity(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 3.0, 4.0)], "id int, a double, b double")
    long = reshape.to_long(df, ["id"], ["a", "b"])
    assert long.count() == 4
    back = reshape.to_wide(long, ["id"], "name", ["a", "b"], ["value"])
    assert rows(back, "id", "value_a", "value_b") == rows(df)


def test_pivot_refuses_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0)], "id int, name string, value double")
    with pytest.raises(Exception, match="several rows"):
        reshape.to_wide(df, ["id"], "name", ["a"], ["value"]).collect()
    assert rows(reshape.to_wide(df, ["id"], "name", ["a"], ["value"], "mean")) == [(1, 2.0)]


def test_contrasts(spark):
    df = spark.createDataFrame([(3.0, 2.0), (3.0, 0.0), (None, 2.0)], "x_warming double, x_control double")
    got = lambda kind: [r[0] for r in reshape.contrast(df, ["x"], kind).select("d_x").collect()]
    assert got("difference") == [1.0, 3.0, None]
    assert got("percent") == [50.0, None, None]
    assert got("ratio") == [1.5, None, None]


def test_trapezoid_skips_missing_and_crosses_stretches(spark):
    points = [("a", 0.0, 1.0), ("a", 700.0, 3.0), ("a", 800.0, None), ("a", 1500.0, 5.0), ("a", 5000.0, 5.0), ("b", 3.0, 9.0)]
    df = spark.createDataFrame(points, "k string, x double, y double")
    expected = 700 * 2.0 + 800 * 4.0 + 3500 * 5.0
    for span in (10.0, 720.0, 1e9):
        assert rows(trapezoid(df, ["k"], "x", "y", span=span)) == [("a", expected), ("b", 0.0)]


def test_trapezoid_of_a_hot_group_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x, y = np.sort(rng.uniform(0, 1e4, 3000)), rng.normal(size=3000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).withColumn("k", F.lit("hot"))
    got = trapezoid(df, ["k"], "x", "y", span=50.0).first()["area"]
    assert abs(got - np.sum(np.diff(x) * (y[1:] + y[:-1]) / 2)) < 1e-6


def test_area_of_a_constant_and_ties(spark):
    df = spark.createDataFrame([("a", 0.0, 2.0), ("a", 4.0, 1.0), ("a", 4.0, 3.0)], "k string, x double, y double")
    assert rows(trapezoid(df, ["k"], "x", "y")) == [("a", 8.0)]


def test_summary_sets_of_values_far_from_zero(spark):
    """A large common offset leaves means and spreads of all groupings exact."""
    data = [(k % 3, k % 2, 1.7e9 + (k * 37 % 101) / 25, None if k % 5 == 0 else 1e9 + k % 4) for k in range(600)]
    df = spark.createDataFrame(data, "a int, b int, x double, y double")
    sets = {"a": ["a"], "b": ["b"], "a x b": ["a", "b"]}
    for r in summary_sets(df, sets, ["x", "y"]).collect():
        mine = [d for d in data if (r["a"] is None or d[0] == r["a"]) and (r["b"] is None or d[1] == r["b"])]
        for c, at in (("x", 2), ("y", 3)):
            values = [d[at] for d in mine if d[at] is not None]
            centre = math.fsum(values) / len(values)
            sd = math.sqrt(math.fsum((v - centre) ** 2 for v in values) / (len(values) - 1))
            assert abs(r[f"mean_{c}"] - centre) < 1e-5 and abs(r[f"sd_{c}"] - sd) < 1e-6


@pytest.mark.parametrize("small", [100_000, 0])
def test_level_table(spark, small):
    words = [f"w{k * 7 % 50:02d}" for k in range(200)] + [None]
    got = {r["level"]: r["alphabetical"] for r in clean.level_table(spark.createDataFrame([(w,) for w in words], "f string"), "f", small).collect()}
    assert got == {w: k + 1 for k, w in enumerate(sorted({w for w in words if w}))}
    assert clean.level_table(spark.createDataFrame([], "f string"), "f", small).collect() == []
