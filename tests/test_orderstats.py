"""Quantiles, hinges, ranks, outliers and correlations against brute force.

``window_rows=0`` and ``max_cells=0`` force the ways taken for large data.
"""

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plotflux.operators import charts, orderstats
from plotflux.operators.correlate import pearson_tests, spearman_matrix, spearman_tests, with_significance
from plotflux.operators.orderstats import average_ranks, hinges, quantiles
from plotflux.operators.outliers import outlier_rows, tukey_fences

WAYS = [10**6, 500, 0]
PROBS = {"a": 0.1, "b": 0.25, "c": 0.5, "d": 0.75, "e": 1.0}


def skewed(n=4000, seed=2):
    """A third of the rows in one group, a third of its values the same, long tails."""
    rng = np.random.default_rng(seed)
    group = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 30, n))
    value = np.where(rng.random(n) < 0.33, 7.0, np.round(np.exp(rng.normal(size=n) * 3), 3))
    return pd.DataFrame({"g": group, "v": value})


@pytest.mark.parametrize("way", WAYS)
def test_quantiles(spark, way):
    pdf = skewed()
    got = quantiles(spark.createDataFrame(pdf), "v", PROBS, ["g"], way).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert np.allclose(got.loc[g, list(PROBS)].astype(float), np.quantile(part.v, list(PROBS.values())))


@pytest.mark.parametrize("way", WAYS)
def test_quantiles_with_extreme_values(spark, way):
    v = [1e300, -1e300, 0.0, 1.0, 2.0, float("inf"), float("-inf")] + [5.0] * 20
    df = spark.createDataFrame([(x,) for x in v] + [(None,), (float("nan"),)], "v double")
    got = quantiles(df, "v", {"b": 0.1, "c": 0.5}, (), way).first()
    assert got["n"] == 27 and abs(got["b"] - 0.6) < 1e-12 and got["c"] == 5.0


def brute_hinges(v):
    v, n = np.sort(v), len(v)
    d = ((n + 3) // 2) / 2
    low = (v[int(np.floor(d)) - 1] + v[int(np.ceil(d)) - 1]) / 2
    high = (v[n - int(np.floor(d))] + v[n - int(np.ceil(d))]) / 2
    return low, high


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 101])
def test_hinges(spark, way, n):
    v = np.random.default_rng(n).normal(size=n)
    got = hinges(spark.createDataFrame(pd.DataFrame({"v": v})), "v", window_rows=way).first()
    assert np.allclose((got["lower_hinge"], got["upper_hinge"]), brute_hinges(v))


@pytest.mark.parametrize("way", WAYS)
def test_outlier_rows(spark, way):
    pdf = skewed().assign(key=lambda d: np.arange(len(d)))
    df = spark.createDataFrame(pdf)
    found = {r["key"] for r in outlier_rows(df, "v", ["g"], window_rows=way).collect()}
    expected = set()
    for _, part in pdf.groupby("g"):
        low, high = brute_hinges(part.v.to_numpy())
        reach = 1.5 * (high - low)
        expected |= set(part.key[(part.v < low - reach) | (part.v > high + reach)])
    assert found == expected
    assert tukey_fences(df, "v", ["g"], window_rows=way).count() == pdf.g.nunique()


@pytest.mark.parametrize("way", WAYS)
def test_box_table(spark, way):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0, 100.0)] + [("b", None)], "g string, v double")
    assert rows(charts.box_table(df, ["g"], "v", window_rows=way)) == [("a", 5, 2.0, 3.0, 4.0, 1.0, 4.0, 1)]


def test_whisker_ends_at_the_quartile_without_a_value_between(spark):
    df = spark.createDataFrame([(v,) for v in (-100.0, 10.0, 10.1, 10.2)], "v double").withColumn("g", F.lit(1))
    box = charts.box_table(df, ["g"], "v").first()
    assert box["lower_whisker"] == box["q1"] < 10 and box["n_outliers"] == 1


def test_column_profile(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (None, 5)], "a double, b int")
    got = {r["column"]: tuple(r)[1:] for r in charts.column_profile(df, ["a", "b"]).collect()}
    assert got == {"a": (1.0, 1.25, 1.5, 1.5, 1.75, 2.0, 1), "b": (5.0,) * 6 + (0,)}


def test_histogram(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)] + [(None,)], "v double")
    got = rows(charts.histogram_table(df, "v", 5))
    assert [r[3] for r in got] == [2, 2, 2, 2, 3] and got[-1][2] == 10.0
    flat = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [r[3] for r in rows(charts.histogram_table(flat, "v"))] == [2]


def test_error_bars_and_smooth_band(spark):
    df = spark.createDataFrame([("a", float(x), 2.0 * x + (x % 2)) for x in range(20)], "g string, x double, y double")
    bar = charts.error_bar_table(df, ["g"], "y", "sd").first()
    assert abs(bar["upper"] - bar["lower"] - 2 * bar["sd_value"]) < 1e-12
    lines = charts.smooth_lines(df, ["g"], "x", "y")
    slope, intercept = np.polyfit(range(20), [2.0 * x + (x % 2) for x in range(20)], 1)
    line = lines.first()
    assert abs(line["slope"] - slope) < 1e-9 and abs(line["intercept"] - intercept) < 1e-9
    band = charts.smooth_band(lines, ["g"], points=5).toPandas()
    assert len(band) == 5 and (band.lower < band.fit).all() and (band.fit < band.upper).all()


@pytest.mark.parametrize("held", [10**6, 500, 0])
def test_many_columns_side_by_side(spark, held):
    """Hot values, infinities, missing values and an empty column, closed in on in one go without moving a row."""
    rng = np.random.default_rng(12)
    n = 30_000
    pdf = pd.DataFrame({
        "normal": rng.normal(size=n),
        "hot": np.where(rng.random(n) < 0.4, 3.5, rng.random(n) * 7),
        "few": rng.integers(0, 5, n).astype(float),
        "big": rng.exponential(size=n) * 1e300,
        "gaps": np.where(rng.random(n) < 0.9, np.nan, rng.normal(size=n)),
    })
    pdf.loc[:3, "normal"] = [np.inf, -np.inf, np.inf, np.nan]
    df = spark.createDataFrame(pdf).withColumn("none", F.lit(None).cast("double"))
    probs = {"p1": 0.01, "q1": 0.25, "median": 0.5, "p999": 0.999}
    got = orderstats.column_quantiles(df, df.columns, probs, held_values=held)
    for c in pdf:
        v = np.sort(pdf[c].dropna().to_numpy())
        assert got[c]["n"] == len(v)
        for name, p in probs.items():
            assert got[c][name] == pytest.approx(np.quantile(v, p), rel=1e-12)
    assert got["none"] == {"n": 0, "p1": None, "q1": None, "median": None, "p999": None}


def test_profile_moves_no_row(spark):
    """No row is repeated per column and none is shuffled but for the counts."""
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("a"), (F.col("id") % 11).alias("b"))
    out = {r["column"]: r for r in charts.column_profile(df, ["a", "b"], held_values=100).collect()}
    values = np.sort(np.arange(100_000) * 7919 % 100_003)
    assert out["a"]["q1"] == np.quantile(values, 0.25) and out["b"]["median"] == 5.0 and out["b"]["n_missing"] == 0


@pytest.mark.parametrize("window_rows,max_cells", [(10**6, 10**6), (0, 10**6), (0, 0), (10**6, 0)])
def test_spearman(spark, window_rows, max_cells):
    pdf = skewed(2500).assign(w=lambda d: d.v + d.g)
    pdf.loc[::10, "w"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("w", F.when(~F.isnan("w"), F.col("w")))
    got = spearman_matrix(df, ["g", "v", "w"], window_rows, max_cells).toPandas()
    expected = pdf.dropna().corr("spearman")
    for _, r in got.iterrows():
        assert abs(r.r - expected.loc[r.var_x, r.var_y]) < 1e-9 and r.n == len(pdf.dropna())


def test_ranks_over_several_ranges(spark):
    pdf = skewed(5000)
    df = spark.createDataFrame(pdf)
    got = average_ranks(df, ["g", "v"], window_rows=0).toPandas()
    for c in ("g", "v"):
        mine = got[got.column == c].set_index("value")["rank"]
        assert np.allclose(pdf[c].map(mine), pdf[c].rank())


def test_spearman_is_unchanged_by_monotone_transforms(spark):
    df = spark.createDataFrame(skewed(500)).withColumn("root", F.sqrt("v"))
    pairs = {(r["var_x"], r["var_y"]): r["r"] for r in spearman_matrix(df, ["g", "v", "root"]).collect()}
    assert abs(pairs["g", "v"] - pairs["g", "root"]) < 1e-12 and abs(pairs["v", "root"] - 1) < 1e-12


def test_pearson_is_pairwise_complete(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4, 5], "b": [2.0, 1, 4, 3, 6], "c": [1.0, None, 2, 2, 9]})
    df = spark.createDataFrame(pdf).withColumn("c", F.when(~F.isnan("c"), F.col("c")))
    got = {(r["var_x"], r["var_y"]): r for r in with_significance(pearson_tests(df)).collect()}
    assert got["a", "b"]["n"] == 5 and got["a", "c"]["n"] == 4
    assert abs(got["a", "c"]["r"] - pdf.a.corr(pdf.c)) < 1e-12
    assert got["a", "b"]["mark"] == "" and 0.05 < got["a", "b"]["p"] < 0.15
    assert spearman_tests(df, ["a", "b"]).first()["p"] > 0.05


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=30))
def test_both_ways_agree(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    a, b = (tuple(quantiles(df, "v", PROBS, (), way).first()) for way in (10**6, 0))
    assert a == b and np.allclose(a[1:], np.quantile(values, list(PROBS.values())))
