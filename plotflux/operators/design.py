"""Model terms as columns, and their moments from one pass over the rows.

Only moments, a few numbers per pair of model columns, reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotflux.session import durable

Term = tuple[str, ...]


def crossed(*products: Term) -> list[Term]:
    """Main effects and all interactions of each product, by degree, without repeats.

    ``crossed(("a", "b"), ("c",))`` is a + c + a:b read as terms of degree 1 then 2.
    """
    found: list[Term] = []
    for variables in products:
        for size in range(1, len(variables) + 1):
            for term in combinations(variables, size):
                if not any(set(term) == set(t) for t in found):
                    found.append(term)
    return sorted(found, key=len)


def factor_levels(df: DataFrame, column: str) -> list[str]:
    """Levels in alphabetical order; the first is the baseline.

    Each level is a column of the model, so the driver solves equations of their number.
    """
    return sorted(r[0] for r in df.select(column).distinct().collect())


@dataclass
class Slot:
    """A model column: a product of factor levels times a product of numeric variables."""

    name: str
    term: int
    levels: tuple[tuple[str, str], ...]  # (factor, level)
    monomial: int | None  # index into the numeric products; None stands for 1


@dataclass
class Design:
    """Model columns (without intercept) of the rows complete in all variables."""

    reduced: DataFrame  # rows reduced per group and factor levels, in the checkpoint folder
    keep: list[str]
    factors: list[str]
    n_numeric: int
    slots: list[Slot]
    terms: list[Term]

    @property
    def names(self) -> list[str]:
        return [s.name for s in self.slots]

    @property
    def term_of(self) -> list[int]:
        return [s.term for s in self.slots]

    @property
    def size(self) -> int:
        """Number of model columns and the response."""
        return len(self.slots) + 1


def build_design(
    df: DataFrame,
    response: str,
    terms: Sequence[Term],
    factors: Mapping[str, Sequence[str] | None] | Sequence[str] = (),
    keep: Sequence[str] = (),
) -> Design:
    """Columns for every term, with treatment contrasts for factors.

    The rows are read once and reduced to one entry per ``keep`` group and
    combination of factor levels, holding the moments of the numeric products and
    the response. A factor's levels may be given, first one the baseline; otherwise
    they are those found, in alphabetical order.
    """
    given = dict(factors) if isinstance(factors, Mapping) else {f: None for f in factors}
    variables = list(dict.fromkeys(v for t in terms for v in t))
    used = [v for v in variables if v in given]
    products: list[tuple[str, ...]] = []
    for term in terms:
        numeric = tuple(v for v in term if v not in given)
        if numeric and numeric not in products:
            products.append(numeric)
    reduced = durable(_reduce(df, response, variables, used, products, keep))
    levels = {v: list(given[v] or factor_levels(reduced, f"_f_{v}")) for v in used}
    slots = []
    for i, term in enumerate(terms):
        numeric = tuple(v for v in term if v not in given)
        monomial = products.index(numeric) if numeric else None
        backwards = [v for v in reversed(term) if v in levels]
        # The first factor's levels vary fastest.
        for chosen in product(*[levels[v][1:] for v in backwards]):
            level = dict(zip(backwards, chosen))
            name = ":".join(f"{v}[{level[v]}]" if v in level else v for v in term)
            slots.append(Slot(name, i, tuple(level.items()), monomial))
    return Design(reduced, list(keep), used, len(products), slots, list(terms))


def _pairs(size: int) -> list[tuple[int, int]]:
    """Upper triangle by rows."""
    return [(i, j) for i in range(size) for j in range(i, size)]


def _reduce(
    df: DataFrame,
    response: str,
    variables: Sequence[str],
    factors: Sequence[str],
    products: Sequence[tuple[str, ...]],
    keep: Sequence[str],
) -> DataFrame:
    """Count, means and centred cross products of the numeric columns per group and levels."""
    complete = df
    for v in dict.fromkeys([response, *variables, *keep]):
        complete = complete.where(F.col(v).isNotNull())
    columns = []
    for k, numeric in enumerate(products):
        value = F.col(numeric[0]).cast("double")
        for v in numeric[1:]:
            value = value * F.col(v).cast("double")
        columns.append(value.alias(f"v{k}"))
    names = [f"v{k}" for k in range(len(products))] + ["y"]
    rows = complete.select(
        *keep,
        *[F.col(f).cast("string").alias(f"_f_{f}") for f in factors],
        *columns,
        F.col(response).cast("double").alias("y"),
    )
    cross = [
        F.covar_pop(names[i], names[j]) * F.count(F.lit(1)) for i, j in _pairs(len(names))
    ]
    return rows.groupBy(*keep, *[f"_f_{f}" for f in factors]).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in names]).alias("_m"),
        F.array(*cross).alias("w"),
    )


def cell_table(design: Design) -> DataFrame:
    """The reduced rows in terms of model columns.

    Each cell has its count ``n``, the means ``m`` of all model columns and the
    response, and for its numeric products and response the centred cross products
    ``w``; ``d`` says which columns are switched on by the cell's levels.
    """
    on, means = [], []
    for slot in design.slots:
        hit = F.lit(True)
        for factor, level in slot.levels:
            hit = hit & (F.col(f"_f_{factor}") == level)
        value = F.lit(1.0) if slot.monomial is None else F.col("_m")[slot.monomial]
        on.append(hit.cast("int"))
        means.append(F.when(hit, value).otherwise(0.0))
    return design.reduced.select(
        *design.keep,
        "n",
        F.array(*means, F.col("_m")[design.n_numeric]).alias("m"),
        F.array(*on, F.lit(1)).alias("d"),
        "w",
    )


def square_matrix(upper: Sequence[float], size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = np.asarray(upper, dtype=float)
    return out + np.triu(out, 1).T


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    cross: np.ndarray  # centred cross products; the response is last


def column_means(size: int) -> Column:
    """Weighted mean of the entries' means as aggregates."""
    return F.expr(f"array({', '.join(f'sum(n * m[{i}]) / sum(n)' for i in range(size))})")


def collect_moments(cells: DataFrame, design: Design) -> Moments:
    """Merge all cells; two small jobs on the reduced rows."""
    first = cells.agg(F.sum("n").alias("n"), column_means(design.size).alias("m")).first()
    if not first["n"]:
        raise ValueError("no row is complete in all model variables")
    mean = [float(v) for v in first["m"]]
    return Moments(first["n"], np.array(mean), cross_products(cells, mean, design))


def cross_products(table: DataFrame, mean: Sequence[float] | int, design: Design | None = None) -> np.ndarray:
    """Sum of n (m - mean)(m - mean)' over the entries of ``table``.

    With a ``design`` the entries are its cells, and the cross products inside them are added. A number
    instead of the mean says how many columns there are; each entry then has its own mean in ``_own``.
    """
    size = mean if isinstance(mean, int) else len(mean)
    pairs = _pairs(size)

    def listed(values) -> str:
        return f"array({', '.join(str(v) for v in values)})"

    centre = "_own" if isinstance(mean, int) else listed(f"{float(v)!r}D" for v in mean)
    value = f"n * (m[i] - {centre}[i]) * (m[j] - {centre}[j])"
    columns = ["n", "m", "_own"] if isinstance(mean, int) else ["n", "m"]
    if design is not None:
        columns += ["d", "w"]
        r = design.n_numeric + 1
        place = {pair: k for k, pair in enumerate(_pairs(r))}
        source = [s.monomial for s in design.slots] + [r - 1]
        inside = [
            -1 if source[a] is None or source[b] is None
            else place[min(source[a], source[b]), max(source[a], source[b])]
            for a, b in pairs
        ]
        value += f" + if({listed(inside)}[at] >= 0, d[i] * d[j] * get(w, {listed(inside)}[at]), 0D)"
    sums = (
        table.selectExpr(*columns, f"posexplode({listed(i for i, _ in pairs)}) as (at, i)")
        .selectExpr("*", f"{listed(j for _, j in pairs)}[at] as j")
        .groupBy("at")
        .agg(F.expr(f"sum({value})").alias("value"))
    )
    found = {row["at"]: row["value"] for row in sums.collect()}
    return square_matrix([found[k] for k in range(len(pairs))], size)


def eliminate(cross: np.ndarray, scale: np.ndarray, tolerance: float = 1e-10):
    """Take the model columns out of a cross-product matrix one after the other.

    Returns the columns kept (one that depends on earlier ones is left out) and
    the response's remaining sum of squares before and after every column.
    """
    a = cross.copy()
    p = len(a) - 1
    kept, remaining = [], [a[p, p]]
    for i in range(p):
        if a[i, i] > tolerance * max(scale[i], 1e-300):
            kept.append(i)
            a = a - np.outer(a[:, i], a[i, :]) / a[i, i]
        remaining.append(max(a[p, p], 0.0))
    return kept, remaining
