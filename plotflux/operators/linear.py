"""Linear models, variance inflation and analysis of variance.

Each fit is one aggregation over the rows; the small normal equations are solved
on the driver and the results come back as DataFrames.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotflux.functions.pvalues import f_p, f_p_value, t_p
from plotflux.operators.design import (
    Design,
    Moments,
    Term,
    build_design,
    cell_table,
    collect_moments,
    column_means,
    cross_products,
    eliminate,
)
from plotflux.session import durable, join_checked

COEFFICIENTS = "term string, estimate double, std_error double, df double, t_value double, p_value double"
ANOVA = "stratum string, term string, df long, sum_sq double, mean_sq double, f_value double, p_value double"


def _plain(value):
    """A Python number for createDataFrame; NaN and infinities become missing."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, np.integer)):
        return int(value)
    return float(value) if np.isfinite(value) else None


def table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small result table of a model."""
    return spark.createDataFrame([tuple(_plain(v) for v in row) for row in rows], schema)


@dataclass
class LinearFit:
    """Estimates of one model; ``coefficients()`` and ``summary()`` give them as tables."""

    spark: SparkSession
    names: list[str]  # with the intercept first
    term_of: list[int]  # -1 for the intercept
    terms: list[Term]
    estimate: np.ndarray  # NaN for a column that depends on others
    covariance: np.ndarray
    n: int
    df_residual: int
    rss: float
    tss: float

    def coefficients(self) -> DataFrame:
        error = np.sqrt(np.diag(self.covariance))
        with np.errstate(all="ignore"):
            t = self.estimate / error
        p = t_p(t, np.full(len(t), float(self.df_residual)))
        rows = zip(self.names, self.estimate, error, [float(self.df_residual)] * len(t), t, p)
        return table(self.spark, rows, COEFFICIENTS)

    def summary(self) -> DataFrame:
        rank = int(np.isfinite(self.estimate).sum()) - 1
        r2 = 1 - self.rss / self.tss if self.tss > 0 else np.nan
        sigma2 = self.rss / self.df_residual if self.df_residual > 0 else np.nan
        f = (self.tss - self.rss) / rank / sigma2 if rank and sigma2 else np.nan
        adjusted = 1 - (1 - r2) * (self.n - 1) / self.df_residual if self.df_residual > 0 else np.nan
        row = (
            self.n, self.df_residual, np.sqrt(sigma2), r2, adjusted, f, rank,
            float(f_p(f, float(rank), float(self.df_residual))),
        )
        return table(
            self.spark,
            [row],
            "n long, df_residual long, sigma double, r2 double, adj_r2 double, f_value double, "
            "df_model long, p_value double",
        )

    def vif(self) -> DataFrame:
        return vif_table(self)


def solve(spark: SparkSession, design: Design, moments: Moments) -> LinearFit:
    cross, mean, n = moments.cross, moments.mean, moments.n
    p = len(cross) - 1
    kept, _ = eliminate(cross, np.diag(cross))
    estimate, covariance = np.full(p + 1, np.nan), np.full((p + 1, p + 1), np.nan)
    scale = np.sqrt(np.diag(cross)[kept])
    inverse = np.linalg.inv(cross[np.ix_(kept, kept)] / np.outer(scale, scale)) / np.outer(scale, scale)
    slope = inverse @ cross[kept, p]
    rss = max(float(cross[p, p] - slope @ cross[kept, p]), 0.0)
    df = n - len(kept) - 1
    sigma2 = rss / df if df > 0 else np.nan
    at = np.array(kept, dtype=int) + 1
    estimate[0] = mean[p] - slope @ mean[kept]
    estimate[at] = slope
    covariance[np.ix_(at, at)] = sigma2 * inverse
    covariance[0, 0] = sigma2 * (1 / n + mean[kept] @ inverse @ mean[kept])
    covariance[0, at] = covariance[at, 0] = -sigma2 * (inverse @ mean[kept])
    return LinearFit(
        spark, ["(intercept)", *design.names], [-1, *design.term_of], design.terms,
        estimate, covariance, n, df, rss, float(cross[p, p]),
    )


def linear_model(
    df: DataFrame,
    response: str,
    terms: Sequence[Term],
    factors: Mapping[str, Sequence[str] | None] | Sequence[str] = (),
) -> LinearFit:
    """Least squares with intercept, factors in treatment contrasts.

    Use ``design.crossed`` to write interactions.
    """
    design = build_design(df, response, terms, factors)
    moments = collect_moments(cell_table(design), design)
    return solve(df.sparkSession, design, moments)


def vif_table(fit) -> DataFrame:
    """Variance inflation factor of every term of a linear or mixed fit.

    For a term of several columns this is the generalised factor, with its
    power 1 / (2 df) in ``scaled``.
    """
    slots = [i for i, t in enumerate(fit.term_of) if t >= 0 and np.isfinite(fit.estimate[i])]
    v = fit.covariance[np.ix_(slots, slots)]
    r = v / np.outer(np.sqrt(np.diag(v)), np.sqrt(np.diag(v)))
    owner = np.array([fit.term_of[i] for i in slots])
    rows = []
    for i, term in enumerate(fit.terms):
        mine = owner == i
        if mine.any():
            rest = np.linalg.det(r[np.ix_(~mine, ~mine)]) if (~mine).any() else 1.0
            value = np.linalg.det(r[np.ix_(mine, mine)]) * rest / np.linalg.det(r)
            size = int(mine.sum())
            rows.append((":".join(term), size, value, value ** (1 / (2 * size))))
    return table(fit.spark, rows, "term string, df long, vif double, scaled double")


def anova_oneway(df: DataFrame, response: str, factor: str) -> DataFrame:
    """One-way analysis of variance: a row for the factor and one for the residuals."""
    groups = durable(
        df.where(F.col(response).isNotNull() & F.col(factor).isNotNull())
        .groupBy(factor)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(response).alias("m"),
            (F.var_pop(response) * F.count(F.lit(1))).alias("q"),
        )
    )
    centre = groups.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("c")).scalar()
    d = F.col("m") - F.col("_centre")
    sums = groups.withColumn("_centre", centre).agg(
        (F.count(F.lit(1)) - 1).alias("df1"),
        (F.sum("n") - F.count(F.lit(1))).alias("df2"),
        F.sum(F.col("n") * d * d).alias("ss1"),
        F.sum("q").alias("ss2"),
    )
    ms1, ms2 = F.try_divide(F.col("ss1"), F.col("df1")), F.try_divide(F.col("ss2"), F.col("df2"))
    tested = sums.withColumns({"ms1": ms1, "ms2": ms2}).withColumn("f", F.try_divide("ms1", "ms2"))
    tested = tested.withColumn("p", f_p_value(F.col("f"), F.col("df1"), F.col("df2")))
    none = F.lit(None).cast("double")
    return tested.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit(factor).alias("term"), F.col("df1").alias("df"), F.col("ss1").alias("sum_sq"),
                    F.col("ms1").alias("mean_sq"), F.col("f").alias("f_value"), F.col("p").alias("p_value"),
                ),
                F.struct(
                    F.lit("residuals").alias("term"), F.col("df2").alias("df"), F.col("ss2").alias("sum_sq"),
                    F.col("ms2").alias("mean_sq"), none.alias("f_value"), none.alias("p_value"),
                ),
            )
        )
    )


@dataclass
class GroupedMoments:
    """Moments split at a grouping: inside groups and between group means."""

    groups: DataFrame  # grouping columns, n, m; in the checkpoint folder
    n: int
    n_groups: int
    mean: np.ndarray
    total: np.ndarray
    between: np.ndarray
    within: np.ndarray


def grouped_moments(design: Design, by: Sequence[str]) -> GroupedMoments:
    """Moments per group, in total, between groups and inside them, all from the reduced rows.

    Those inside are summed from the cells around the means of their groups, not taken as a difference of
    totals, which would lose the digits of small ones.
    """
    cells = cell_table(design)
    moments = collect_moments(cells, design)
    groups = durable(
        cells.groupBy(*by).agg(F.sum("n").alias("n"), column_means(design.size).alias("m"), F.count(F.lit(1)).alias("_held"))
    )
    own = groups.select(*by, F.col("m").alias("_own"), "_held")
    inside = cross_products(join_checked(cells, own, list(by), weight="_held"), design.size, design)
    return GroupedMoments(
        groups.drop("_held"), moments.n, groups.count(), moments.mean, moments.cross,
        cross_products(groups, moments.mean), inside,
    )


def anova_strata(
    df: DataFrame,
    response: str,
    terms: Sequence[Term],
    error: str,
    factors: Mapping[str, Sequence[str] | None] | Sequence[str] = (),
) -> DataFrame:
    """Analysis of variance with an error stratum, sequential sums of squares.

    Terms are tested between the means of the ``error`` groups and inside the
    groups, each in the order given; a term without variation in a stratum is
    not listed there.
    """
    design = build_design(df, response, terms, factors, keep=[error])
    g = grouped_moments(design, [error])
    scale = np.diag(g.total)
    rows = []
    for stratum, cross, df_total in (
        (error, g.between, g.n_groups - 1),
        ("within", g.within, g.n - g.n_groups),
    ):
        kept, remaining = eliminate(cross, scale)
        df_residual = df_total - len(kept)
        mean_sq_residual = remaining[-1] / df_residual if df_residual > 0 else np.nan
        for i, term in enumerate(design.terms):
            mine = [c for c in kept if design.term_of[c] == i]
            if mine:
                ss = sum(remaining[c] - remaining[c + 1] for c in mine)
                f = ss / len(mine) / mean_sq_residual if mean_sq_residual > 0 else np.nan
                p = float(f_p(f, float(len(mine)), float(df_residual))) if np.isfinite(f) else np.nan
                rows.append((stratum, ":".join(term), len(mine), ss, ss / len(mine), f, p))
        if df_residual > 0:
            rows.append((stratum, "residuals", df_residual, remaining[-1], mean_sq_residual, None, None))
    return table(df.sparkSession, rows, ANOVA)
