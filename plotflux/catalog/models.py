"""Correlations, linear models, analysis of variance and mixed models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plotflux.catalog import mixed_sql
from plotflux.catalog.registry import FLUXES, READINGS, f_tail, fluxes, query, readings, rounded, t_tail
from plotflux.functions.bins import day_or_night
from plotflux.operators import correlate, linear
from plotflux.operators.design import build_design, cell_table, collect_moments, crossed
from plotflux.operators.mixed import mixed_model

_VARIABLES = ("flux", "quality", "temperature", "moisture")
_PAIRS = [(a, b) for i, a in enumerate(_VARIABLES) for b in _VARIABLES[i + 1 :]]
_GAPPY = "f AS (SELECT CASE WHEN quality > 0.01 THEN flux END AS flux, quality, temperature, CASE WHEN moisture > 0 THEN moisture END AS moisture FROM fluxes)"


def _gappy(spark, folder):
    """Fluxes with missing values in two of the columns."""
    return fluxes(spark, folder).select(
        F.when(F.col("quality") > 0.01, F.col("flux")).alias("flux"), "quality", "temperature",
        F.when(F.col("moisture") > 0, F.col("moisture")).alias("moisture"),
    )


@query(f"""WITH {FLUXES}, {_GAPPY}, c AS (SELECT * FROM f WHERE flux IS NOT NULL AND moisture IS NOT NULL),
r AS (SELECT {", ".join(
    f"rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0::DOUBLE AS {v}" for v in _VARIABLES)} FROM c)
{" UNION ALL ".join(
    f"SELECT '{a}' AS var_x, '{b}' AS var_y, count(*) AS n, round(corr({a}, {b}), 8) AS r FROM r" for a, b in _PAIRS)}""")
def spearman_matrix(spark, folder):
    return rounded(correlate.spearman_matrix(_gappy(spark, folder)), 8, "r")


_TESTS = f"""WITH {FLUXES}, {_GAPPY}, p AS (
{" UNION ALL ".join(
    f"SELECT '{a}' AS var_x, '{b}' AS var_y, CAST(regr_count({b}, {a}) AS BIGINT) AS n, corr({a}, {b}) AS r FROM f" for a, b in _PAIRS)})"""


@query(f"{_TESTS} SELECT var_x, var_y, n, round(r, 8) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t FROM p")
def pearson_tests(spark, folder):
    return rounded(correlate.pearson_tests(_gappy(spark, folder)), {"r": 8, "t": 6})


@query(f"""{_TESTS}, t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM p), v AS (SELECT *, {t_tail('t', 'n - 2')} AS pv FROM t)
SELECT var_x, var_y, n, round(r, 8) AS r, round(t, 6) AS t, round(pv, 8) AS p,
  repeat('*', CAST(pv < 0.001 AS INTEGER) + CAST(pv < 0.05 AS INTEGER)) AS mark FROM v""")
def pearson_significance(spark, folder):
    tests = correlate.with_significance(correlate.pearson_tests(_gappy(spark, folder)))
    return rounded(tests, {"r": 8, "t": 6, "p": 8})


def _estimates(fit):
    return rounded(fit.coefficients(), {"estimate": 6, "std_error": 6, "t_value": 5, "p_value": 6})


#: The columns of a coefficient table from estimates ``b``, errors ``se`` and degrees of freedom ``df``.
_COEFFICIENTS = f"""term, round(b, 6) AS estimate, round(se, 6) AS std_error, CAST(df AS DOUBLE) AS df, round(b / se, 5) AS t_value,
  round({t_tail("b / se", "df")}, 6) AS p_value"""


@query(f"""WITH {FLUXES}, g AS (SELECT season, count(*) AS n, avg(flux) AS m, var_pop(flux) * count(*) AS q FROM fluxes GROUP BY 1),
w AS (SELECT max(CASE WHEN season = 'F' THEN n END) AS n0, max(CASE WHEN season = 'O' THEN n END) AS n1,
  max(CASE WHEN season = 'F' THEN m END) AS m0, max(CASE WHEN season = 'O' THEN m END) AS m1, sum(q) AS q FROM g),
s AS (SELECT *, n0 + n1 - 2 AS df, q / (n0 + n1 - 2) AS s2 FROM w),
e AS (SELECT '(intercept)' AS term, m0 AS b, sqrt(s2 / n0) AS se, df FROM s
  UNION ALL SELECT 'season[O]', m1 - m0, sqrt(s2 / n0 + s2 / n1), df FROM s)
SELECT {_COEFFICIENTS} FROM e""")
def ols_treatment(spark, folder):
    return _estimates(linear.linear_model(fluxes(spark, folder), "flux", [("season",)], ["season"]))


_TWO = f"""WITH {FLUXES}, s AS (SELECT count(*) AS n, avg(flux) AS my, avg(temperature) AS m1, avg(quality) AS m2,
  regr_sxx(flux, temperature) AS s11, regr_sxx(flux, quality) AS s22, covar_pop(temperature, quality) * count(*) AS s12,
  regr_sxy(flux, temperature) AS s1y, regr_sxy(flux, quality) AS s2y, regr_syy(flux, quality) AS syy FROM fluxes)"""


@query(f"""{_TWO}, b AS (SELECT *, s11 * s22 - s12 * s12 AS d, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
  (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s),
v AS (SELECT *, (syy - b1 * s1y - b2 * s2y) / (n - 3) AS s2 FROM b),
e AS (SELECT '(intercept)' AS term, my - b1 * m1 - b2 * m2 AS b,
    sqrt(s2 * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / d)) AS se, n FROM v
  UNION ALL SELECT 'temperature', b1, sqrt(s2 * s22 / d), n FROM v
  UNION ALL SELECT 'quality', b2, sqrt(s2 * s11 / d), n FROM v)
SELECT {_COEFFICIENTS} FROM (SELECT *, n - 3 AS df FROM e)""")
def ols_multi(spark, folder):
    return _estimates(
        linear.linear_model(fluxes(spark, folder), "flux", [("temperature",), ("quality",)])
    )


@query(f"""WITH {FLUXES}, g AS (SELECT season, count(*) AS n, regr_slope(flux, temperature) AS b, regr_intercept(flux, temperature) AS a,
  avg(temperature) AS m, regr_sxx(flux, temperature) AS sxx,
  regr_syy(flux, temperature) - regr_sxy(flux, temperature) ** 2 / regr_sxx(flux, temperature) AS rss FROM fluxes GROUP BY 1),
w AS (SELECT f.n AS n0, o.n AS n1, f.a AS a0, o.a AS a1, f.b AS b0, o.b AS b1, f.m AS m0, o.m AS m1, f.sxx AS x0, o.sxx AS x1,
  (f.rss + o.rss) / (f.n + o.n - 4) AS s2, CAST(f.n + o.n - 4 AS DOUBLE) AS df FROM g f, g o WHERE f.season = 'F' AND o.season = 'O'),
e AS (SELECT '(intercept)' AS term, a0 AS b, sqrt(s2 * (1.0 / n0 + m0 * m0 / x0)) AS se, df FROM w
  UNION ALL SELECT 'season[O]', a1 - a0, sqrt(s2 * (1.0 / n0 + m0 * m0 / x0 + 1.0 / n1 + m1 * m1 / x1)), df FROM w
  UNION ALL SELECT 'temperature', b0, sqrt(s2 / x0), df FROM w
  UNION ALL SELECT 'season[O]:temperature', b1 - b0, sqrt(s2 / x0 + s2 / x1), df FROM w)
SELECT {_COEFFICIENTS} FROM e""")
def ols_interaction(spark, folder):
    return _estimates(
        linear.linear_model(
            fluxes(spark, folder), "flux", crossed(("season", "temperature")), ["season"]
        )
    )


@query(f"""WITH {READINGS}, c AS (SELECT block, treatment, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS q
  FROM readings WHERE value IS NOT NULL GROUP BY 1, 2),
s AS (SELECT CAST(sum(n) AS BIGINT) - count(*) AS df, sum(q) / (sum(n) - count(*)) AS s2 FROM c),
w AS (SELECT k.block, k.m AS mk, k.n AS nk, h.m AS mh, h.n AS nh FROM c k JOIN c h ON k.block = h.block AND k.treatment = 'control' AND h.treatment = 'warming'),
b1 AS (SELECT * FROM w WHERE block = 1),
e AS (SELECT '(intercept)' AS term, mk AS b, 1.0 / nk AS v FROM b1
  UNION ALL SELECT 'treatment[warming]', mh - mk, 1.0 / nk + 1.0 / nh FROM b1
  UNION ALL SELECT 'block[' || w.block || ']', w.mk - b1.mk, 1.0 / w.nk + 1.0 / b1.nk FROM w, b1 WHERE w.block > 1
  UNION ALL SELECT 'block[' || w.block || ']:treatment[warming]', w.mh - w.mk - b1.mh + b1.mk,
    1.0 / w.nk + 1.0 / w.nh + 1.0 / b1.nk + 1.0 / b1.nh FROM w, b1 WHERE w.block > 1)
SELECT {_COEFFICIENTS} FROM (SELECT term, b, sqrt(v * s2) AS se, df FROM e, s)""")
def ols_block_by_treatment(spark, folder):
    r = readings(spark, folder)
    fit = linear.linear_model(r, "value", crossed(("block", "treatment")), ["block", "treatment"])
    return _estimates(fit)


@query(f"""WITH {FLUXES}, g AS (SELECT treatment, count(*) AS n, avg(flux) AS m, var_pop(flux) * count(*) AS q FROM fluxes GROUP BY 1),
c AS (SELECT avg(flux) AS c FROM fluxes),
s AS (SELECT count(*) - 1 AS d1, CAST(sum(n) AS BIGINT) - count(*) AS d2, sum(n * (m - c) ** 2) AS ss1, sum(q) AS ss2 FROM g, c)
SELECT 'treatment' AS term, d1 AS df, round(ss1, 3) AS sum_sq, round(ss1 / d1, 3) AS mean_sq, round(ss1 / d1 / (ss2 / d2), 5) AS f_value,
  round({f_tail("(ss1 / d1 / (ss2 / d2))", "d1", "d2")}, 6) AS p_value FROM s
UNION ALL SELECT 'residuals', d2, round(ss2, 3), round(ss2 / d2, 3), NULL, NULL FROM s""")
def anova_oneway(spark, folder):
    out = linear.anova_oneway(fluxes(spark, folder), "flux", "treatment")
    return rounded(out, {"sum_sq": 3, "mean_sq": 3, "f_value": 5, "p_value": 6})


@query(f"""WITH {FLUXES}, r AS (SELECT corr(temperature, quality) AS r FROM fluxes)
SELECT unnest(['temperature', 'quality']) AS term, CAST(1 AS BIGINT) AS df, round(1 / (1 - r * r), 8) AS vif,
  round(sqrt(1 / (1 - r * r)), 8) AS scaled FROM r""")
def vif_table(spark, folder):
    fit = linear.linear_model(fluxes(spark, folder), "flux", [("temperature",), ("quality",)])
    return rounded(fit.vif(), 8, "vif", "scaled")


@query(f"""WITH {FLUXES}, g AS (SELECT collar, count(*) AS n, avg(temperature) AS x, avg(flux) AS y,
    covar_pop(temperature, flux) * count(*) AS cxy, var_pop(temperature) * count(*) AS cxx, var_pop(flux) * count(*) AS cyy
  FROM fluxes GROUP BY 1), m AS (SELECT avg(temperature) AS mx, avg(flux) AS my FROM fluxes),
s AS (SELECT count(*) AS j, CAST(sum(n) AS BIGINT) AS n, sum(n * (x - mx) ** 2) AS bxx, sum(n * (x - mx) * (y - my)) AS bxy, sum(n * (y - my) ** 2) AS byy,
  sum(cxx) AS wxx, sum(cxy) AS wxy, sum(cyy) AS wyy FROM g, m),
t AS (SELECT bxy ** 2 / bxx AS b1, byy - bxy ** 2 / bxx AS b2, wxy ** 2 / wxx AS w1, wyy - wxy ** 2 / wxx AS w2, j - 2 AS db, n - j - 1 AS dw FROM s)
SELECT 'collar' AS stratum, 'temperature' AS term, CAST(1 AS BIGINT) AS df, round(b1, 3) AS sum_sq, round(b1, 3) AS mean_sq, round(b1 / (b2 / db), 5) AS f_value,
  round({f_tail("(b1 / (b2 / db))", "1", "db")}, 6) AS p_value FROM t
UNION ALL SELECT 'collar', 'residuals', db, round(b2, 3), round(b2 / db, 3), NULL, NULL FROM t
UNION ALL SELECT 'within', 'temperature', 1, round(w1, 3), round(w1, 3), round(w1 / (w2 / dw), 5), round({f_tail("(w1 / (w2 / dw))", "1", "dw")}, 6) FROM t
UNION ALL SELECT 'within', 'residuals', dw, round(w2, 3), round(w2 / dw, 3), NULL, NULL FROM t""")
def anova_strata(spark, folder):
    out = linear.anova_strata(fluxes(spark, folder), "flux", [("temperature",)], "collar")
    return rounded(out, {"sum_sq": 3, "mean_sq": 3, "f_value": 5, "p_value": 6})


def _sweep(size: int) -> str:
    """SQL that takes the columns of matrices ``m`` (``stratum``, ``a``, ``scale``) out one after the other: ``steps``."""
    taken = f"a[x + 1] - a[(x // {size}) * {size} + k + 1] * a[k * {size} + x % {size} + 1] / a[k * {size} + k + 1]"
    return f"""steps AS (SELECT stratum, 0 AS k, a, scale FROM m
  UNION ALL SELECT stratum, k + 1, CASE WHEN a[k * {size} + k + 1] > 1e-10 * scale[k + 1] THEN [{taken} FOR x IN range(0, {size * size})] ELSE a END, scale
  FROM steps WHERE k < {size - 1})"""


#: The terms of treatment x channel x block with their numbers of columns; the block is numeric.
_CROSSED_TERMS = (
    ("treatment", 1), ("channel", 4), ("block", 1), ("treatment:channel", 4), ("treatment:block", 1), ("channel:block", 4),
    ("treatment:channel:block", 4),
)
_CROSSED_LAST = sum(n for _, n in _CROSSED_TERMS)


@query(f"""WITH RECURSIVE {READINGS}, levels AS (SELECT list_sort(list_distinct(list(channel))) AS lv FROM readings WHERE value IS NOT NULL),
x AS (SELECT row_number() OVER () AS id, collar, value, CASE WHEN treatment = 'warming' THEN 1.0 ELSE 0.0 END::DOUBLE AS t, CAST(block AS DOUBLE) AS b,
    [CASE WHEN channel = lv[i] THEN 1.0 ELSE 0.0 END::DOUBLE FOR i IN range(2, 6)] AS c FROM readings, levels WHERE value IS NOT NULL),
w AS (SELECT id, collar, list_concat([t], c, [b], [v * t FOR v IN c], [t * b], [v * b FOR v IN c], [v * t * b FOR v IN c], [value]) AS v FROM x),
long AS (SELECT id, collar, unnest(v) AS v, unnest(range(0, {_CROSSED_LAST + 1})) AS i FROM w),
grand AS (SELECT i, avg(v) AS m FROM long GROUP BY i),
groups AS (SELECT collar, i, avg(v) AS m, count(*) AS n FROM long GROUP BY 1, 2),
sizes AS (SELECT count(*) AS j, CAST(sum(n) AS BIGINT) AS n FROM groups WHERE i = 0),
dev AS (SELECT id, l.i, l.v - g.m AS v FROM long l JOIN groups g ON l.collar = g.collar AND l.i = g.i),
apart AS (SELECT collar, g.i, g.n, g.m - a.m AS v FROM groups g JOIN grand a ON g.i = a.i),
cross_products AS (
  SELECT 'collar' AS stratum, p.i, q.i AS j, sum(p.n * p.v * q.v) AS s FROM apart p JOIN apart q ON p.collar = q.collar GROUP BY 2, 3
  UNION ALL SELECT 'within', p.i, q.i, sum(p.v * q.v) FROM dev p JOIN dev q ON p.id = q.id GROUP BY 2, 3),
whole AS (SELECT list(s ORDER BY i) AS scale FROM (SELECT i, sum(s) AS s FROM cross_products WHERE i = j GROUP BY i)),
m AS (SELECT stratum, list(s ORDER BY i, j) AS a, any_value(scale) AS scale FROM cross_products, whole GROUP BY stratum),
{_sweep(_CROSSED_LAST + 1)},
taken AS (SELECT s.stratum, s.k, s.a[-1] - n.a[-1] AS ss FROM steps s JOIN steps n ON n.stratum = s.stratum AND n.k = s.k + 1
  WHERE s.a[s.k * {_CROSSED_LAST + 1} + s.k + 1] > 1e-10 * s.scale[s.k + 1]),
rest AS (SELECT s.stratum, s.a[-1] AS rss, CASE WHEN s.stratum = 'collar' THEN z.j - 1 ELSE z.n - z.j END
    - (SELECT count(*) FROM taken t WHERE t.stratum = s.stratum) AS df FROM steps s, sizes z WHERE s.k = {_CROSSED_LAST}),
names AS (SELECT unnest([{", ".join(f"'{name}'" for name, n in _CROSSED_TERMS for _ in range(n))}]) AS term, unnest(range(0, {_CROSSED_LAST})) AS k),
terms AS (SELECT stratum, term, count(*) AS df, sum(ss) AS ss FROM taken JOIN names USING (k) GROUP BY 1, 2),
f AS (SELECT t.*, t.ss / t.df AS ms, CASE WHEN r.df > 0 THEN t.ss / t.df / (r.rss / r.df) END AS f, r.df AS rdf FROM terms t JOIN rest r ON r.stratum = t.stratum)
SELECT stratum, term, df, round(ss, 3) AS sum_sq, round(ms, 3) AS mean_sq, round(f, 5) AS f_value, CASE WHEN f IS NOT NULL THEN round({f_tail("f", "df", "rdf")}, 6) END AS p_value FROM f
UNION ALL SELECT stratum, 'residuals', df, round(rss, 3), round(rss / df, 3), NULL, NULL FROM rest WHERE df > 0""")
def anova_strata_crossed(spark, folder):
    r = readings(spark, folder)
    out = linear.anova_strata(
        r, "value", crossed(("treatment", "channel", "block")), "collar", ["treatment", "channel"]
    )
    return rounded(out, {"sum_sq": 3, "mean_sq": 3, "f_value": 5, "p_value": 6})


_MODEL_COLUMNS = """x AS (
  SELECT block, collar, CASE WHEN treatment = 'warming' THEN 1.0 ELSE 0.0 END::DOUBLE AS x0, CAST(k AS DOUBLE) AS x1,
    CASE WHEN treatment = 'warming' THEN k ELSE 0.0 END::DOUBLE AS x2, value AS y FROM readings WHERE value IS NOT NULL)"""


def _design(spark, folder):
    return build_design(
        readings(spark, folder), "value", crossed(("treatment", "k")),
        {"treatment": ["control", "warming"]}, keep=["block", "collar"],
    )


@query(f"""WITH {READINGS}, {_MODEL_COLUMNS}
SELECT block, collar, count(*) AS n, round(avg(x0), 6) AS mean_x0, round(avg(x1), 6) AS mean_x1, round(avg(x2), 6) AS mean_x2,
  round(avg(y), 6) AS mean_y, round(covar_pop(x1, y) * count(*), 3) AS cross_x1_y, round(var_pop(y) * count(*), 3) AS cross_y_y
FROM x GROUP BY 1, 2""")
def lmm_group_stats(spark, folder):
    # Treatment is fixed per collar, so a cell is a collar.
    out = cell_table(_design(spark, folder)).select(
        "block", "collar", "n",
        *[F.col("m")[i].alias(f"mean_{c}") for i, c in enumerate(("x0", "x1", "x2", "y"))],
        F.col("w")[1].alias("cross_x1_y"), F.col("w")[2].alias("cross_y_y"),
    )
    return rounded(
        out,
        {"mean_x0": 6, "mean_x1": 6, "mean_x2": 6, "mean_y": 6, "cross_x1_y": 3, "cross_y_y": 3},
    )


_CROSS = [(a, b) for i, a in enumerate(("x0", "x1", "x2", "y")) for b in ("x0", "x1", "x2", "y")[i:]]


@query(f"""WITH {READINGS}, {_MODEL_COLUMNS}
{" UNION ALL ".join(
    f"SELECT '{a}' AS var_x, '{b}' AS var_y, count(*) AS n, round(covar_pop({a}, {b}) * count(*), 3) AS cross_product FROM x"
    for a, b in _CROSS)}""")
def model_moments(spark, folder):
    design = _design(spark, folder)
    moments = collect_moments(cell_table(design), design)
    rows = [
        (a, b, moments.n, float(moments.cross[i, j]))
        for (a, b), (i, j) in zip(_CROSS, zip(*np.triu_indices(4)))
    ]
    out = spark.createDataFrame(rows, "var_x string, var_y string, n long, cross_product double")
    return rounded(out, 3, "cross_product")


_NESTED = "WITH RECURSIVE " + mixed_sql.fitted(f"""{READINGS},
x AS (SELECT block AS o, collar AS g, t AS v0, d AS v1, t * d AS v2, value AS v3 FROM (
  SELECT block, collar, value, CASE WHEN treatment = 'warming' THEN 1.0 ELSE 0.0 END::DOUBLE AS t,
    CASE WHEN hour(ts) BETWEEN 7 AND 20 THEN 0.0 ELSE 1.0 END::DOUBLE AS d FROM readings WHERE value IS NOT NULL))""", nested=True)
_NESTED_TERMS = ["treatment", "timeofday", "treatment:timeofday"]


def _nested_fit(spark, folder):
    r = readings(spark, folder).withColumn("timeofday", day_or_night("ts"))
    return mixed_model(
        r, "value", crossed(("treatment", "timeofday")), ["block", "collar"], ["treatment", "timeofday"]
    )


@query(f"{_NESTED} {mixed_sql.coefficients(['(intercept)', 'treatment[warming]', 'timeofday[night]', 'treatment[warming]:timeofday[night]'])}")
def lmm_nested(spark, folder):
    out = _nested_fit(spark, folder).coefficients()
    return rounded(out, {"estimate": 4, "std_error": 4, "df": 1, "t_value": 4, "p_value": 4})


@query(f"{_NESTED} {mixed_sql.components('collar', 'block')}")
def lmm_variances(spark, folder):
    return rounded(_nested_fit(spark, folder).variance_components(), 3, "variance", "sd")


@query(f"{_NESTED} {mixed_sql.summary()}")
def lmm_r2(spark, folder):
    return rounded(_nested_fit(spark, folder).summary(), {"reml": 3, "r2_marginal": 5, "r2_conditional": 5})


@query(f"{_NESTED} {mixed_sql.inflation(_NESTED_TERMS)}")
def lmm_vif(spark, folder):
    return rounded(_nested_fit(spark, folder).vif(), 4, "vif", "scaled")


_SINGLE = "WITH RECURSIVE " + mixed_sql.fitted(f"""{FLUXES},
x AS (SELECT 0 AS o, collar AS g, temperature AS v0, moisture AS v1, CASE WHEN season = 'O' THEN 1.0 ELSE 0.0 END::DOUBLE AS v2, flux AS v3 FROM fluxes)""", nested=False)


@query(f"{_SINGLE} {mixed_sql.coefficients(['(intercept)', 'temperature', 'moisture', 'season[O]'], 0)}")
def lmm_single(spark, folder):
    f = fluxes(spark, folder)
    fit = mixed_model(
        f, "flux", [("temperature",), ("moisture",), ("season",)], ["collar"], ["season"]
    )
    return rounded(fit.coefficients(), {"estimate": 4, "std_error": 4, "df": 0, "t_value": 4, "p_value": 4})
