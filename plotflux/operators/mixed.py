"""Random-intercept models, also nested (block / collar), fitted by REML.

The rows are read once: per innermost group the count, means and cross products
are enough. The likelihood of a pair of variance ratios is then an aggregate over
that table. A table counted to be small is taken to the driver; a large one stays
in Spark, where a whole grid of ratios is evaluated per job.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotflux.functions.pvalues import t_p
from plotflux.operators.design import Term, build_design, eliminate
from plotflux.operators.linear import COEFFICIENTS, GroupedMoments, grouped_moments, table, vif_table
from plotflux.session import BROADCAST_CELLS, durable, join_checked

# For every (inner ratio, outer ratio): weighted cross products of (1, columns, response)
# and the log determinant of the random part.
Evaluator = Callable[[Sequence[float], Sequence[float]], dict[tuple[int, int], tuple[np.ndarray, float]]]


def _within(g: GroupedMoments) -> np.ndarray:
    """Cross products of (1, columns, response) around their group means; the constant has none."""
    size = len(g.mean) + 1
    out = np.zeros((size, size))
    out[1:, 1:] = g.within
    return out


def local_evaluator(g: GroupedMoments, outer: str | None) -> Evaluator:
    """Evaluate on the driver. Only for group tables counted to be small."""
    columns = ["n", "m"] + ([outer] if outer else [])
    data = g.groups.select(*columns).toPandas()
    n = data["n"].to_numpy(dtype=float)
    z = np.column_stack([np.ones(len(n)), np.vstack(data["m"].to_numpy()) - g.mean])
    block = data[outer].astype("category").cat.codes.to_numpy() if outer else np.zeros(len(n), dtype=int)
    within = _within(g)

    def evaluate(inner_ratios, outer_ratios):
        # Sums of positive parts only: a difference of large totals would lose the digits.
        out = {}
        for i, lc in enumerate(inner_ratios):
            w = n / (1 + lc * n)
            base = np.log1p(lc * n).sum()
            m = np.bincount(block, weights=w)
            centre = np.column_stack([np.bincount(block, weights=w * z[:, k]) for k in range(z.shape[1])]) / m[:, None]
            apart = z - centre[block]
            inner = within + (apart * w[:, None]).T @ apart
            for j, lb in enumerate(outer_ratios):
                left = m / (1 + lb * m)
                out[i, j] = (inner + (centre * left[:, None]).T @ centre, base + np.log1p(lb * m).sum())
        return out

    return evaluate


def spark_evaluator(g: GroupedMoments, outer: str | None) -> Evaluator:
    """Evaluate in Spark, a whole grid of ratios at a time.

    As on the driver, only positive parts are summed: first the weighted centre of every block, then the groups
    around the centre of their own block.
    """
    size = len(g.mean) + 1
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    within = _within(g)
    groups = g.groups.selectExpr(
        f"`{outer}` as b" if outer else "0 as b",
        "cast(n as double) as n",
        "1D as z0",
        *[f"m[{i}] - {float(g.mean[i])!r}D as z{i + 1}" for i in range(size - 1)],
    )

    def grid(ratios, name):
        entries = ", ".join(f"struct({k} as {name}i, {float(r)!r}D as {name})" for k, r in enumerate(ratios))
        return f"inline(array({entries}))"

    def matrix(upper) -> np.ndarray:
        out = np.zeros((size, size))
        out[np.triu_indices(size)] = upper
        return out + np.triu(out, 1).T

    def evaluate(inner_ratios, outer_ratios):
        rows = groups.selectExpr("*", grid(inner_ratios, "lc")).selectExpr("*", "n / (1 + lc * n) as w")
        blocks = durable(
            rows.groupBy("b", "lci").agg(
                F.expr("sum(w) as m"),
                F.expr("sum(log1p(lc * n)) as d"),
                F.expr("count(*) as held"),
                *[F.expr(f"sum(w * z{i}) / sum(w) as c{i}") for i in range(size)],
            )
        )
        centres = blocks.select("b", "lci", "held", *[f"c{i}" for i in range(size)])
        apart = join_checked(rows, centres, ["b", "lci"], weight="held")
        spread = ", ".join(f"sum(w * (z{i} - c{i}) * (z{j} - c{j}))" for i, j in pairs)
        inner = {r["lci"]: matrix(r["s"]) for r in apart.groupBy("lci").agg(F.expr(f"array({spread}) as s")).collect()}
        # What the outer variance leaves of the centres.
        left = ", ".join(f"sum(g * c{i} * c{j})" for i, j in pairs)
        sums = (
            blocks.selectExpr("*", grid(outer_ratios, "lb"))
            .selectExpr("*", "m / (1 + lb * m) as g")
            .groupBy("lci", "lbi")
            .agg(F.expr("sum(d + log1p(lb * m)) as d"), F.expr(f"array({left}) as left"))
        )
        # One row per candidate.
        return {(r["lci"], r["lbi"]): (within + inner[r["lci"]] + matrix(r["left"]), r["d"]) for r in sums.collect()}

    return evaluate


def _restrict(g: GroupedMoments, keep: list[int]) -> GroupedMoments:
    """Leave out model columns that depend on earlier ones."""
    if len(keep) == len(g.mean):
        return g
    groups = g.groups.withColumn("m", F.array(*[F.col("m")[k] for k in keep]))
    at = np.ix_(keep, keep)
    return GroupedMoments(groups, g.n, g.n_groups, g.mean[keep], g.total[at], g.between[at], g.within[at])


@dataclass
class Solution:
    beta: np.ndarray
    inverse: np.ndarray
    rss: float
    log_det: float
    log_det_x: float


def _solve(weighted: np.ndarray, log_det: float) -> Solution:
    x, y = weighted[:-1, :-1], weighted[:-1, -1]
    scale = np.sqrt(np.diag(x))
    scaled = x / np.outer(scale, scale)
    inverse = np.linalg.inv(scaled) / np.outer(scale, scale)
    beta = inverse @ y
    rss = max(float(weighted[-1, -1] - beta @ y), 1e-300)
    log_det_x = np.linalg.slogdet(scaled)[1] + 2 * np.log(scale).sum()
    return Solution(beta, inverse, rss, log_det, log_det_x)


def _criterion(s: Solution, df: int) -> float:
    return df * np.log(s.rss / df) + s.log_det + s.log_det_x


def _search(evaluate: Evaluator, df: int, nested: bool, points: int = 17, rounds: int = 10):
    """Minimise over both ratios by grids that close in on the best point so far.

    Zero, no variance between groups, is a candidate in every round.
    """
    centre, width = [0.0, 0.0], [14.0, 14.0]
    best = None
    for _ in range(rounds):
        grids = []
        for c, w, used in zip(centre, width, (True, nested)):
            offsets = np.linspace(-w, w, points) if used else []
            grids.append([0.0, *np.exp(c + np.asarray(offsets))])
        found = evaluate(*grids)
        for (i, j), (weighted, log_det) in found.items():
            value = _criterion(_solve(weighted, log_det), df)
            if best is None or value < best[0]:
                best = (value, grids[0][i], grids[1][j])
        for k in (0, 1):
            ratio = best[k + 1]
            # A best ratio of zero keeps its width, so a later improvement stays in reach.
            if ratio > 0:
                centre[k] = float(np.log(ratio))
                width[k] /= points / 4
    return best


@dataclass
class MixedFit:
    """Estimates of a mixed model; the methods give them as tables."""

    spark: SparkSession
    names: list[str]
    term_of: list[int]
    terms: list[Term]
    estimate: np.ndarray
    covariance: np.ndarray
    df: np.ndarray
    residual: float
    variances: dict[str, float]
    reml: float
    n: int
    n_groups: int
    fixed_variance: float

    def coefficients(self) -> DataFrame:
        """Fixed effects with Satterthwaite degrees of freedom."""
        error = np.sqrt(np.diag(self.covariance))
        t = self.estimate / error
        return table(
            self.spark, zip(self.names, self.estimate, error, self.df, t, t_p(t, self.df)), COEFFICIENTS
        )

    def variance_components(self) -> DataFrame:
        rows = [(k, v, np.sqrt(v)) for k, v in [*self.variances.items(), ("residual", self.residual)]]
        return table(self.spark, rows, "group string, variance double, sd double")

    def summary(self) -> DataFrame:
        """Size, REML criterion, and marginal and conditional R2."""
        random = sum(self.variances.values())
        whole = self.fixed_variance + random + self.residual
        row = (
            self.n, self.n_groups, self.reml,
            self.fixed_variance / whole, (self.fixed_variance + random) / whole,
        )
        return table(
            self.spark, [row],
            "n long, n_groups long, reml double, r2_marginal double, r2_conditional double",
        )

    def vif(self) -> DataFrame:
        return vif_table(self)


def _satterthwaite(
    evaluate: Evaluator, parameters: list[float], n: int, back: np.ndarray, step: float = 1e-2
):
    """Degrees of freedom from the curvature of the criterion and of each variance.

    Derivatives are central differences in the logs of (inner, outer, residual)
    variance; a variance estimated as zero takes no part. ``back`` leads from the
    centred to the original coefficients.
    """
    p = len(back)
    vc, vb, ve = parameters
    offsets = [-2, -1, 0, 1, 2]
    inner = [vc / ve * np.exp(o * step) for o in offsets] if vc > 0 else [0.0]
    outer = [vb / ve * np.exp(o * step) for o in offsets] if vb > 0 else [0.0]
    solved = {k: _solve(*v) for k, v in evaluate(inner, outer).items()}

    def at(dc, db, de):
        s = solved[dc - de + 2 if vc > 0 else 0, db - de + 2 if vb > 0 else 0]
        v = ve * np.exp(de * step)
        return (n - p) * np.log(v) + s.log_det + s.log_det_x + s.rss / v, v * np.diag(back @ s.inverse @ back.T)

    active = [k for k, v in enumerate((vc, vb, ve)) if v > 0]
    unit = np.eye(3, dtype=int)
    hessian = np.zeros((len(active), len(active)))
    gradient = np.zeros((len(active), p))
    for a, i in enumerate(active):
        up, down = at(*unit[i]), at(*-unit[i])
        gradient[a] = (up[1] - down[1]) / (2 * step)
        hessian[a, a] = (up[0] - 2 * at(0, 0, 0)[0] + down[0]) / step**2
        for b, j in enumerate(active[:a]):
            cross = (
                at(*(unit[i] + unit[j]))[0] - at(*(unit[i] - unit[j]))[0]
                - at(*(unit[j] - unit[i]))[0] + at(*(-unit[i] - unit[j]))[0]
            ) / (4 * step**2)
            hessian[a, b] = hessian[b, a] = cross
    spread = 2 * np.linalg.pinv(hessian)
    variance = at(0, 0, 0)[1]
    return 2 * variance**2 / np.einsum("ap,ab,bp->p", gradient, spread, gradient)


def mixed_model(
    df: DataFrame,
    response: str,
    terms: Sequence[Term],
    groups: Sequence[str],
    factors: Mapping[str, Sequence[str] | None] | Sequence[str] = (),
    max_cells: int = BROADCAST_CELLS,
) -> MixedFit:
    """Fit a model with a random intercept per group by REML.

    ``groups`` is ``["collar"]`` or, nested and outermost first,
    ``["block", "collar"]``. Rows missing any variable are left out.
    """
    if len(groups) not in (1, 2):
        raise ValueError("give one group, or an outer and an inner one")
    design = build_design(df, response, terms, factors, keep=groups)
    g = grouped_moments(design, groups)
    kept, _ = eliminate(g.total, np.diag(g.total))
    g = _restrict(g, [*kept, len(design.names)])
    outer = groups[0] if len(groups) == 2 else None
    small = g.n_groups * (len(g.mean) + 3) <= max_cells
    evaluate = local_evaluator(g, outer) if small else spark_evaluator(g, outer)
    p = len(g.mean)  # intercept and columns, without the response
    best, lc, lb = _search(evaluate, g.n - p, outer is not None)
    s = _solve(*evaluate([lc], [lb])[0, 0])
    ve = s.rss / (g.n - p)
    # Back from centred columns: only the intercept and its covariances change.
    back = np.eye(p)
    back[0, 1:] = -g.mean[:-1]
    estimate = back @ s.beta
    estimate[0] += g.mean[-1]
    covariance = ve * back @ s.inverse @ back.T
    if p > 1:
        fixed_variance = float(s.beta[1:] @ g.total[:-1, :-1] @ s.beta[1:] / (g.n - 1))
    else:
        fixed_variance = 0.0
    degrees = _satterthwaite(evaluate, [lc * ve, lb * ve, ve], g.n, back)
    variances = {groups[-1]: lc * ve}
    if outer:
        variances[outer] = lb * ve
    constant = (g.n - p) * (1 + np.log(2 * np.pi))
    return MixedFit(
        df.sparkSession, ["(intercept)", *[design.names[k] for k in kept]],
        [-1, *[design.term_of[k] for k in kept]], design.terms, estimate, covariance, degrees, ve, variances, best + constant, g.n, g.n_groups, fixed_variance,
    )
