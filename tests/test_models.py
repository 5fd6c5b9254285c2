"""Linear and mixed models against dense linear algebra and published results."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from plotflux.functions import pvalues
from plotflux.operators.design import build_design, crossed
from plotflux.operators.linear import GroupedMoments, anova_oneway, anova_strata, grouped_moments, linear_model
from plotflux.operators.mixed import local_evaluator, mixed_model, spark_evaluator
from plotflux.operators.outliers import outlier_rows
from plotflux.plans.soil import treatment_model

# Soil samples of 34 collars, published with the experiment: percent carbon, C/N, mg ammonium per kg.
SOIL = [
    ("1-2-con", 5.81, 12.4, 5.270624), ("1-2-war", 5.63, 13.4, 4.541004),
    ("1-4-con", 4.76, 11.6, 5.319658), ("1-4-war", 11.67, 13.7, 6.884670),
    ("1-5-con", 8.72, 13.0, 4.517191), ("1-5-war", 11.09, 13.7, 9.712244),
    ("1-7-con", 6.03, 12.6, 5.942404), ("1-7-war", 4.95, 12.4, 6.850526),
    ("1-9-con", 5.07, 12.4, 4.999061), ("1-9-war", 8.27, 15.0, 5.055449),
    ("2-17-con", 10.26, 12.7, 6.426433), ("2-17-war", 8.62, 13.7, 5.877186),
    ("2-18-con", 4.00, 11.8, 4.770282), ("2-18-war", 4.85, 11.8, 8.748151),
    ("2-20-con", 4.16, 11.9, 6.814672), ("2-20-war", 4.82, 12.0, 8.820800),
    ("3-3-con", 7.91, 12.2, 5.225944), ("3-3-war", 11.26, 13.6, 14.512193),
    ("3-12-con", 12.26, 13.8, 5.500030), ("3-12-war", 10.30, 13.4, 5.657499),
    ("3-14-con", 10.73, 12.5, 5.532925), ("3-14-war", 8.36, 12.7, 5.456933),
    ("3-16-con", 14.53, 12.1, 5.636802), ("3-16-war", 11.68, 12.6, 5.928714),
    ("4-6-con", 9.79, 12.2, 4.828643), ("4-6-war", 11.91, 13.4, 9.674437),
    ("4-8-con", 13.21, 13.6, 7.533442), ("4-8-war", 12.84, 13.7, 6.941935),
    ("4-11-con", 14.67, 14.1, 6.999562), ("4-11-war", 11.18, 12.4, 18.487690),
    ("4-15-con", 13.73, 13.0, 9.708896), ("4-15-war", 8.76, 13.5, 6.742163),
    ("4-19-con", 9.84, 12.9, 5.578923), ("4-19-war", 9.41, 12.4, 7.626357),
]


@pytest.fixture(scope="module")
def soil(spark):
    rows = [(*r, "warming" if r[0].endswith("war") else "control") for r in SOIL]
    return spark.createDataFrame(
        rows, "collar string, perc_c double, c_n_ratio double, mg_nh4_kgsoil double, treatment string"
    )


@pytest.mark.parametrize(
    "response,limits,n,intercept,slope,error,t,p",
    [
        ("perc_c", (None, None), 34, 2.96073, 0.02943, 0.19233, 0.1530, 0.87936),
        ("c_n_ratio", (None, None), 34, 3.55334, 0.07012, 0.03598, 1.9487, 0.06014),
        ("mg_nh4_kgsoil", (None, 14.0), 32, 2.42083, 0.20196, 0.09833, 2.0539, 0.04879),
    ],
)
def test_published_treatment_effects(soil, response, limits, n, intercept, slope, error, t, p):
    fit = treatment_model(soil, response, limits)
    a, b = fit.coefficients().collect()
    assert fit.n == n and b["term"] == "treatment[warming]"
    got = (a["estimate"], b["estimate"], b["std_error"], b["t_value"], b["p_value"])
    assert np.allclose(got, (intercept, slope, error, t, p), atol=6e-5)


def test_published_outliers(soil):
    found = {r["collar"] for r in outlier_rows(soil, "mg_nh4_kgsoil").collect()}
    assert found == {"3-3-war", "4-11-war"}
    assert outlier_rows(soil, "perc_c").count() == 0 and outlier_rows(soil, "c_n_ratio").count() == 0


def test_tail_probabilities():
    t = [0.1193, 1.6642, -2.6951, 2.0539]
    assert np.allclose(pvalues.t_p(t, [31, 32, 31, 30]), [0.9058, 0.10583, 0.01126, 0.04879], atol=6e-6)
    assert np.allclose(pvalues.t_quant(0.975, [1, 10]), [12.706205, 2.228139])
    assert np.allclose(pvalues.f_p(4.0, 1, 10), pvalues.t_p(2.0, 10))
    for df in (9e5, 1e9, 1e13):
        assert abs(pvalues.t_p(2.0, df) - math.erfc(math.sqrt(2))) < 1e-6
        assert abs(pvalues.f_p(3.0, 4, df) - math.exp(-6) * 7) < 1e-5
    assert np.isnan(pvalues.t_p(2.0, 0)) and np.isnan(pvalues.f_p(np.nan, 1, 3))


def plots(seed=4, blocks=4, collars=9):
    rng = np.random.default_rng(seed)
    out = []
    for b in range(blocks):
        eb = rng.normal()
        for c in range(collars):
            ec, warm = rng.normal() * 0.7, c % 2
            for _ in range(rng.integers(2, 8)):
                x = rng.normal() + 5
                y = 2 + 0.5 * x + 0.8 * warm + eb + ec + rng.normal()
                month = ("jan", "feb", "mar")[rng.integers(3)]
                out.append((f"b{b}", f"{b}-{c}", "warming" if warm else "control", month, x, y))
    return pd.DataFrame(out, columns=["block", "collar", "treatment", "month", "x", "y"])


@pytest.fixture(scope="module")
def pdf():
    return plots()


@pytest.fixture(scope="module")
def frame(spark, pdf):
    return spark.createDataFrame(pdf).cache()


def dense(pdf, *names):
    warm = (pdf.treatment == "warming").to_numpy(float)
    parts = {
        "treatment[warming]": warm,
        "x": pdf.x.to_numpy(),
        "month[jan]": (pdf.month == "jan").to_numpy(float),
        "month[mar]": (pdf.month == "mar").to_numpy(float),
    }
    columns = [np.ones(len(pdf))]
    for name in names:
        value = np.ones(len(pdf))
        for part in name.split(":"):
            value = value * parts[part]
        columns.append(value)
    return np.column_stack(columns)


def test_interaction_columns_and_estimates(frame, pdf):
    fit = linear_model(frame, "y", crossed(("treatment", "month", "x")), ["treatment", "month"])
    assert fit.names == [
        "(intercept)", "treatment[warming]", "month[jan]", "month[mar]", "x",
        "treatment[warming]:month[jan]", "treatment[warming]:month[mar]", "treatment[warming]:x",
        "month[jan]:x", "month[mar]:x", "treatment[warming]:month[jan]:x", "treatment[warming]:month[mar]:x",
    ]
    x, y = dense(pdf, *fit.names[1:]), pdf.y.to_numpy()
    beta, rss, *_ = np.linalg.lstsq(x, y, rcond=None)
    covariance = rss[0] / (len(y) - x.shape[1]) * np.linalg.inv(x.T @ x)
    assert np.allclose(fit.estimate, beta) and np.allclose(fit.covariance, covariance)
    residual = y - x @ fit.estimate
    assert np.abs(x.T @ residual).max() < 1e-6
    summary = fit.summary().first()
    assert summary["n"] == len(y) and abs(summary["r2"] - (1 - rss[0] / ((y - y.mean()) ** 2).sum())) < 1e-9


def test_terms_are_ordered_by_degree():
    assert crossed(("t", "s"), ("t", "d")) == [("t",), ("s",), ("d",), ("t", "s"), ("t", "d")]


def test_dependent_column_is_left_out(spark, frame):
    doubled = frame.selectExpr("*", "2 * x as x2")
    fit = linear_model(doubled, "y", [("x",), ("x2",)])
    a, b, c = fit.coefficients().collect()
    assert c["estimate"] is None and abs(b["estimate"] - linear_model(frame, "y", [("x",)]).estimate[1]) < 1e-9


def test_missing_rows_and_empty_data(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 3.0), ("b", 1.0, 4.0), ("b", 2.0, 6.0)], "t string, x double, y double")
    assert linear_model(df, "y", [("x",)]).n == 3
    with pytest.raises(ValueError):
        linear_model(df.where("y > 100"), "y", [("x",)])


def test_vif(frame, pdf):
    fit = linear_model(frame.selectExpr("*", "x + y * 0.3 as z"), "y", [("x",), ("z",)])
    r = np.corrcoef(pdf.x, pdf.x + 0.3 * pdf.y)[0, 1]
    assert np.allclose([row["vif"] for row in fit.vif().collect()], 1 / (1 - r * r))


def test_oneway_equals_squared_t(frame):
    t = linear_model(frame, "y", [("treatment",)], ["treatment"]).coefficients().collect()[1]
    f = anova_oneway(frame, "y", "treatment").collect()[0]
    assert abs(f["f_value"] - t["t_value"] ** 2) < 1e-9 and abs(f["p_value"] - t["p_value"]) < 1e-9


def test_strata_of_a_balanced_layout(spark):
    # Two plots per treatment, two months each; sums of squares worked out by hand.
    values = {("p1", "c", "a"): 1, ("p1", "c", "b"): 3, ("p2", "c", "a"): 3, ("p2", "c", "b"): 5,
              ("p3", "w", "a"): 5, ("p3", "w", "b"): 7, ("p4", "w", "a"): 5, ("p4", "w", "b"): 11}
    df = spark.createDataFrame([(*k, float(v)) for k, v in values.items()], "p string, t string, m string, y double")
    got = {(r["stratum"], r["term"]): (r["df"], round(r["sum_sq"], 9)) for r in
           anova_strata(df, "y", crossed(("t", "m")), "p", ["t", "m"]).collect()}
    assert got == {
        ("p", "t"): (1, 32.0), ("p", "residuals"): (2, 8.0), ("within", "m"): (1, 18.0),
        ("within", "t:m"): (1, 2.0), ("within", "residuals"): (2, 4.0),
    }


def deviance(pdf, x, vc, vb, ve):
    collar = pd.get_dummies(pdf.collar).to_numpy(float)
    block = pd.get_dummies(pdf.block).to_numpy(float)
    v = ve * np.eye(len(pdf)) + vc * collar @ collar.T + vb * block @ block.T
    vi = np.linalg.inv(v)
    xvx = x.T @ vi @ x
    b = np.linalg.solve(xvx, x.T @ vi @ pdf.y)
    r = pdf.y - x @ b
    return (
        np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1] + r @ vi @ r + (len(pdf) - x.shape[1]) * np.log(2 * np.pi),
        b, np.linalg.inv(xvx),
    )


@pytest.mark.parametrize("max_cells", [10**6, 0])
def test_nested_mixed_model(frame, pdf, max_cells):
    fit = mixed_model(
        frame, "y", crossed(("treatment", "x")), ["block", "collar"], ["treatment"], max_cells=max_cells
    )
    x = dense(pdf, *fit.names[1:])
    at = (fit.variances["collar"], fit.variances["block"], fit.residual)
    value, beta, covariance = deviance(pdf, x, *at)
    assert abs(value - fit.reml) < 1e-6
    assert np.allclose(fit.estimate, beta) and np.allclose(fit.covariance, covariance, rtol=1e-6)
    for step in itertools.product((-0.01, 0, 0.01), repeat=3):
        moved = [v * math.exp(s) for v, s in zip(at, step)]
        assert deviance(pdf, x, *moved)[0] >= value - 1e-7
    summary = fit.summary().first()
    assert 0 < summary["r2_marginal"] < summary["r2_conditional"] < 1
    assert np.all(fit.df > 1) and np.all(fit.df < len(pdf))
    assert fit.vif().count() == 3 and fit.variance_components().count() == 3


def test_balanced_one_way_equals_method_of_moments(spark):
    rng = np.random.default_rng(8)
    y = rng.normal(size=(12, 5)) + rng.normal(size=(12, 1)) * 2
    df = spark.createDataFrame(
        [(str(i), float(i % 2), float(v)) for i in range(12) for v in y[i]], "g string, x double, y double"
    )
    fit = mixed_model(df, "y", [("x",)], ["g"])
    means = y.mean(axis=1)
    error = ((y - means[:, None]) ** 2).sum() / 48
    between = sum(5 * ((means[k::2] - means[k::2].mean()) ** 2).sum() for k in (0, 1)) / 10
    assert abs(fit.residual - error) < 1e-5 * error
    assert abs(fit.variances["g"] - (between - error) / 5) < 1e-4
    # A factor fixed per group is tested against the groups: 12 groups less 2 means.
    assert np.allclose(fit.df, 10, atol=1e-2)


def test_no_group_variance_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    y = 1 + 2 * x + rng.normal(size=60)
    # Take the group means out of the residuals, so that groups differ less than by chance.
    g = np.repeat(np.arange(6), 10)
    r = y - 1 - 2 * x
    y = 1 + 2 * x + r - pd.Series(r).groupby(g).transform("mean").to_numpy()
    df = spark.createDataFrame([(str(a), float(b), float(c)) for a, b, c in zip(g, x, y)], "g string, x double, y double")
    mixed, plain = mixed_model(df, "y", [("x",)], ["g"]), linear_model(df, "y", [("x",)])
    assert mixed.variances["g"] == 0
    assert np.allclose(mixed.estimate, plain.estimate) and np.allclose(mixed.covariance, plain.covariance)
    assert np.allclose(mixed.df, 58, atol=1e-2)


def test_tail_probabilities_are_continuous_in_df():
    for f, df1 in ((50.0, 1.0), (200.0, 1.0), (30.0, 4.0), (0.5, 2.0)):
        below, above = (float(pvalues.f_p(f, df1, df)) for df in (9.999999e6, 1.0000001e7))
        assert abs(above / below - 1) < 1e-6
        limit = float(pvalues.f_p(f, df1, math.inf))
        gaps = [abs(float(pvalues.f_p(f, df1, df)) / limit - 1) for df in (1e5, 1e6, 1e8, 1e10)]
        assert gaps == sorted(gaps, reverse=True) and gaps[-1] < 1e-4
    # With one numerator degree of freedom F is a squared t.
    for df in (12.0, 1e6, 1e9):
        assert abs(float(pvalues.f_p(6.25, 1.0, df)) / float(pvalues.t_p(2.5, df)) - 1) < 1e-9
    assert abs(float(pvalues.t_p(1.959963984540054, 1e12)) - 0.05) < 1e-9


@pytest.mark.parametrize("rows", [1e3, 1e10])
def test_weighted_products_keep_their_digits(spark, rows):
    """Huge groups: the constant's entry is a sum of positive parts, one per group."""
    count, ratio = 30, 100.0
    data = [(f"g{k}", rows, [float(k % 7), 2.0 * (k % 3)]) for k in range(count)]
    groups = spark.createDataFrame(data, "g string, n double, m array<double>")
    means = np.array([d[2] for d in data])
    spread = np.diag([rows * count, rows * count])
    between = rows * (means - means.mean(0)).T @ (means - means.mean(0))
    g = GroupedMoments(groups, int(rows * count), count, means.mean(0), spread + between, between, spread)
    want = count * rows / (1 + ratio * rows)
    for evaluator in (local_evaluator, spark_evaluator):
        weighted, log_det = evaluator(g, None)([ratio], [0.0])[0, 0]
        assert abs(weighted[0, 0] / want - 1) < 1e-9
        assert abs(log_det / (count * math.log1p(ratio * rows)) - 1) < 1e-12


def test_moments_inside_groups_keep_their_digits(spark):
    """Groups that lie far apart, with little spread inside: what is inside is not a difference of totals."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": np.repeat(np.arange(6), 50), "x": rng.normal(size=300), "y": rng.normal(size=300) * 1e-3})
    pdf["y"] += pdf.g * 1e7
    g = grouped_moments(build_design(spark.createDataFrame(pdf), "y", [("x",)], keep=["g"]), ["g"])
    centred = pdf[["x", "y"]] - pdf.groupby("g")[["x", "y"]].transform("mean")
    assert np.allclose(g.within, centred.T @ centred, rtol=1e-4, atol=1e-12)
    assert np.allclose(g.within + g.between, g.total, rtol=1e-9)


def test_evaluators_agree_in_nested_models_of_huge_groups(spark):
    """Both evaluators at ten thousand million rows a group, collars in blocks, against dense algebra."""
    rng = np.random.default_rng(9)
    rows, data = 1e10, []
    for block in range(3):
        for collar in range(4):
            data.append((f"b{block}", f"b{block}c{collar}", rows * (1 + collar), [float(v) for v in rng.normal(size=2)]))
    groups = spark.createDataFrame(data, "block string, collar string, n double, m array<double>")
    n, means = np.array([d[2] for d in data]), np.array([d[3] for d in data])
    mean = n @ means / n.sum()
    between = (means - mean).T @ ((means - mean) * n[:, None])
    within = np.diag([1.0, 2.0]) * n.sum()
    g = GroupedMoments(groups, int(n.sum()), 12, mean, within + between, between, within)
    lc, lb = [0.0, 0.3], [0.0, 1e-3, 2.0]
    mine, theirs = local_evaluator(g, "block")(lc, lb), spark_evaluator(g, "block")(lc, lb)
    z = np.column_stack([np.ones(12), means - mean])
    for (i, j), (weighted, log_det) in mine.items():
        # Group means have variance 1 / n + lc, and blocks lb in common.
        v = np.diag(1 / n + lc[i]) + lb[j] * np.kron(np.eye(3), np.ones((4, 4)))
        want = z.T @ np.linalg.solve(v, z)
        want[1:, 1:] += within
        scale = np.sqrt(np.outer(np.diag(want), np.diag(want)))
        assert np.abs((weighted - want) / scale).max() < 1e-6
        assert np.abs((weighted - theirs[i, j][0]) / scale).max() < 1e-8 and abs(log_det - theirs[i, j][1]) < 1e-8 * max(1, abs(log_det))


def test_factor_of_many_levels(spark):
    data = [(f"p{k:03d}", float(k) + r) for k in range(150) for r in (0.0, 1.0, 2.0)]
    fit = linear_model(spark.createDataFrame(data, "plot string, y double"), "y", [("plot",)], ["plot"])
    assert len(fit.names) == 150 and abs(fit.estimate[149] - 149) < 1e-8
