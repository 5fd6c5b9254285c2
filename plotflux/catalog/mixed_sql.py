"""SQL of random-intercept models fitted by REML, for the mixed-model queries' counterparts.

The data come as ``x`` with the groups ``o`` (outer) and ``g`` (inner) and the model columns ``v0 .. v3``, the
response last. Group means and the cross products inside groups are aggregated once. A candidate pair of
variance ratios weighs the groups; taking the intercept and the columns out of the weighted cross products
(the sweep operator) leaves coefficients, their inverse, log determinant and residual. The ratios are searched on grids
that close in, in a recursive query; the curvature around the optimum gives Satterthwaite's degrees of freedom.
"""

from __future__ import annotations

from plotflux.catalog.registry import t_tail

_SIZE = 5  # intercept, three columns, response
_P = _SIZE - 1
_PAIRS = [(i, j) for i in range(_SIZE) for j in range(i, _SIZE)]
_POINTS, _ROUNDS, _WIDTH, _STEP = 17, 10, 14.0, 1e-2


def _a(i: int, j: int) -> str:
    return f"a{min(i, j)}{max(i, j)}"


def _weighted(candidates: str, carry: str, nested: bool) -> str:
    """Weighted cross products and log determinant per candidate (``lc``, ``lb`` and the columns of ``carry``)."""
    keys = f"{carry}, lc, lb"
    per_block = ", ".join(
        [*[f"sum(w * z{i}) AS s{i}" for i in range(_SIZE)], *[f"sum(w * z{i} * z{j}) AS p{i}{j}" for i, j in _PAIRS]]
    )
    left = "m / (1 + lb * m)" if nested else "m"
    sums = ", ".join(f"sum(p{i}{j} - s{i} * s{j} / m + {left} * (s{i} / m) * (s{j} / m)) AS x{i}{j}" for i, j in _PAIRS)
    added = ", ".join(f"x{i}{j} + w{i}{j} AS a{i}{j}" for i, j in _PAIRS)
    return f"""SELECT {keys}, d, {added} FROM within, (
    SELECT {keys}, sum(d + ln(1 + lb * {"m" if nested else "0"})) AS d, {sums} FROM (
      SELECT {keys}, o, sum(w) AS m, sum(ln(1 + lc * n)) AS d, {per_block} FROM (
        SELECT c.*, n / (1 + lc * n) AS w, o, n, z0, z1, z2, z3, z4 FROM ({candidates}) c, groups) GROUP BY {keys}, o) GROUP BY {keys})"""


def _swept(weighted: str, carry: str) -> str:
    """Take the first columns out: coefficients ``a04 ..``, minus the inverse ``a00 ..``, residual ``a44``, ``ld``."""
    out = f"SELECT *, 0.0::DOUBLE AS ld FROM ({weighted})"
    for k in range(_P):
        made = []
        for i, j in _PAIRS:
            if i == j == k:
                made.append(f"-1 / {_a(k, k)} AS {_a(i, j)}")
            elif k in (i, j):
                made.append(f"{_a(i, j)} / {_a(k, k)} AS {_a(i, j)}")
            else:
                made.append(f"{_a(i, j)} - {_a(i, k)} * {_a(k, j)} / {_a(k, k)} AS {_a(i, j)}")
        out = f"SELECT {carry}, lc, lb, d, ld + ln({_a(k, k)}) AS ld, {', '.join(made)} FROM ({out})"
    return out


def fitted(x: str, nested: bool) -> str:
    """The CTEs up to ``fit`` (one row: ``lc lb ve n j``, estimates ``b0 ..``, errors ``e0 ..``, ``df0 ..`` and more)."""
    grid = f"list_concat([0.0::DOUBLE], [exp(c1 - w1 + 2 * w1 * k / {_POINTS - 1}) FOR k IN range(0, {_POINTS})])"
    other = grid.replace("c1", "c2").replace("w1", "w2") if nested else "[0.0::DOUBLE]"
    state = "round, best, blc, blb, c1, w1, c2, w2"
    inner = f"SELECT *, unnest({grid}) AS lc FROM search WHERE round < {_ROUNDS}"
    candidates = f"SELECT *, unnest({other}) AS lb FROM ({inner})"
    crit = f"(n - {_P}) * ln(a44 / (n - {_P})) + d + ld"
    shrink = _POINTS / 4
    offsets = "[-2, -1, 0, 1, 2]"
    around = f"""SELECT oc, ob, lc0 * exp(oc * {_STEP}) AS lc, lb0 * exp(ob * {_STEP}) AS lb FROM (
      SELECT blc AS lc0, blb AS lb0 FROM search WHERE round = {_ROUNDS}), (SELECT unnest({offsets}) AS oc), (SELECT unnest({offsets}) AS ob)"""
    inverse = {(i, j): f"(-{_a(i, j)})" for i in range(_P) for j in range(_P)}
    mean = [f"mean{k}" for k in range(_P)]  # of the columns, then of the response
    intercept = " ".join(
        [inverse[0, 0], *[f"- 2 * {mean[k - 1]} * {inverse[0, k]}" for k in range(1, _P)],
         *[f"+ {mean[k - 1]} * {mean[m - 1]} * {inverse[k, m]}" for k in range(1, _P) for m in range(1, _P)]]
    )
    variances = ", ".join([f"({intercept}) AS q0", *[f"{inverse[k, k]} AS q{k}" for k in range(1, _P)]])
    # The criterion and the variances at steps of the logs of the inner, outer and residual variance.
    at = f"""SELECT dc, db, de, (n - {_P}) * ln(ve * exp(de * {_STEP})) + d + ld + a44 / (ve * exp(de * {_STEP})) AS f,
      {", ".join(f"ve * exp(de * {_STEP}) * q{k} AS q{k}" for k in range(_P))}
    FROM (SELECT unnest([-1, 0, 1]) AS dc), (SELECT unnest([-1, 0, 1]) AS db), (SELECT unnest([-1, 0, 1]) AS de), solved, best
    WHERE oc = dc - de AND ob = db - de"""
    steps = {"c": (1, 0, 0), "b": (0, 1, 0), "e": (0, 0, 1)}

    def value(column: str, shift) -> str:
        return f"max({column}) FILTER (dc = {shift[0]} AND db = {shift[1]} AND de = {shift[2]})"

    def moved(a, b=(0, 0, 0), sa=1, sb=1):
        return tuple(sa * p + sb * q for p, q in zip(a, b))

    active = {"c": "(SELECT blc > 0 FROM best)", "b": "(SELECT blb > 0 FROM best)", "e": "true"}
    curved = []
    for k, (p, u) in enumerate(steps.items()):
        second = f"({value('f', u)} - 2 * {value('f', (0, 0, 0))} + {value('f', moved(u, sa=-1))}) / {_STEP**2}"
        curved.append(f"CASE WHEN {active[p]} THEN {second} ELSE 1 END AS h{p}{p}")
        for q, v in list(steps.items())[:k]:
            mixed = (
                f"({value('f', moved(u, v))} - {value('f', moved(u, v, 1, -1))} - {value('f', moved(u, v, -1, 1))}"
                f" + {value('f', moved(u, v, -1, -1))}) / {4 * _STEP**2}"
            )
            curved.append(f"CASE WHEN {active[p]} AND {active[q]} THEN {mixed} ELSE 0 END AS h{q}{p}")
        for m in range(_P):
            slope = f"({value(f'q{m}', u)} - {value(f'q{m}', moved(u, sa=-1))}) / {2 * _STEP}"
            curved.append(f"CASE WHEN {active[p]} THEN {slope} ELSE 0 END AS g{m}{p}")
    curved += [f"{value(f'q{m}', (0, 0, 0))} AS q{m}" for m in range(_P)]
    # g' H^-1 g of a symmetric matrix of three, by cofactors.
    det = "(hcc * (hbb * hee - hbe * hbe) - hcb * (hcb * hee - hbe * hce) + hce * (hcb * hbe - hbb * hce))"
    cof = {"cc": "hbb * hee - hbe * hbe", "bb": "hcc * hee - hce * hce", "ee": "hcc * hbb - hcb * hcb",
           "cb": "hbe * hce - hcb * hee", "ce": "hcb * hbe - hbb * hce", "be": "hcb * hce - hcc * hbe"}
    spread = lambda m: "2 * (" + " + ".join(
        f"{1 if p == q else 2} * g{m}{p} * g{m}{q} * ({cof[p + q]})" for p, q in ("cc", "bb", "ee", "cb", "ce", "be")
    ) + f") / {det}"
    estimates = [f"(s.{_a(0, _P)} + t.{mean[-1]}" + "".join(f" - t.{mean[k - 1]} * s.{_a(k, _P)}" for k in range(1, _P)) + ") AS b0"]
    estimates += [f"s.{_a(k, _P)} AS b{k}" for k in range(1, _P)]
    fixed = " + ".join(f"s.{_a(i, _P)} * s.{_a(j, _P)} * t{min(i, j)}{max(i, j)}" for i in range(1, _P) for j in range(1, _P))
    inner_covariance = [f"-s.{_a(i, j)} AS k{i}{j}" for i in range(1, _P) for j in range(i, _P)]
    return f"""{x},
sizes AS (SELECT count(*) AS n, count(DISTINCT g) AS j, {", ".join(f"avg(v{k}) AS mean{k}" for k in range(_P))} FROM x),
groups AS (SELECT o, g, CAST(count(*) AS DOUBLE) AS n, 1.0::DOUBLE AS z0, {", ".join(f"avg(v{k} - mean{k}) AS z{k + 1}" for k in range(_P))} FROM x, sizes GROUP BY 1, 2),
own AS (SELECT {", ".join(f"v{k} - avg(v{k}) OVER (PARTITION BY g) AS u{k + 1}, v{k} - mean{k} AS y{k + 1}" for k in range(_P))} FROM x, sizes),
within AS (SELECT {", ".join(f"{f'sum(u{i} * u{j})' if i else '0.0::DOUBLE'} AS w{i}{j}" for i, j in _PAIRS)},
  {", ".join(f"sum(y{i} * y{j}) AS t{i}{j}" for i, j in _PAIRS if i)} FROM own),
search AS (
  SELECT 0 AS round, 1e300::DOUBLE AS best, 0.0::DOUBLE AS blc, 0.0::DOUBLE AS blb, 0.0::DOUBLE AS c1, {_WIDTH}::DOUBLE AS w1, 0.0::DOUBLE AS c2, {_WIDTH}::DOUBLE AS w2
  UNION ALL
  SELECT round + 1, best, blc, blb, CASE WHEN blc > 0 THEN ln(blc) ELSE c1 END, CASE WHEN blc > 0 THEN w1 / {shrink} ELSE w1 END,
    CASE WHEN blb > 0 THEN ln(blb) ELSE c2 END, CASE WHEN blb > 0 THEN w2 / {shrink} ELSE w2 END
  FROM (SELECT round, least(best, min(crit)) AS best, CASE WHEN min(crit) < best THEN arg_min(lc, crit) ELSE blc END AS blc,
      CASE WHEN min(crit) < best THEN arg_min(lb, crit) ELSE blb END AS blb, c1, w1, c2, w2
    FROM (SELECT {state}, lc, lb, {crit} AS crit FROM ({_swept(_weighted(candidates, state, nested), state)}), sizes)
    GROUP BY {state})),
solved AS (SELECT *, {variances} FROM ({_swept(_weighted(around, "oc, ob", nested), "oc, ob")}), sizes),
best AS (SELECT search.*, a44 / (n - {_P}) AS ve FROM search, solved WHERE round = {_ROUNDS} AND oc = 0 AND ob = 0),
curve AS (SELECT {", ".join(curved)} FROM ({at})),
fit AS (SELECT b.blc AS lc, b.blb AS lb, b.ve, b.best, t.n, t.j, {", ".join(estimates)}, ({fixed}) / (t.n - 1) AS fixed,
    {", ".join(f"sqrt(c.q{m}) AS e{m}, 2 * c.q{m} * c.q{m} / ({spread(m)}) AS df{m}" for m in range(_P))}, {", ".join(inner_covariance)}
  FROM best b, solved s, sizes t, curve c, within WHERE s.oc = 0 AND s.ob = 0)"""


def coefficients(names: list[str], df_digits: int = 1) -> str:
    """The coefficient table of ``fit``; thousands of degrees of freedom have fewer digits to compare."""
    rows = " UNION ALL ".join(f"SELECT '{name}' AS term, b{k} AS b, e{k} AS se, df{k} AS df FROM fit" for k, name in enumerate(names))
    return f"""SELECT term, round(b, 4) AS estimate, round(se, 4) AS std_error, round(df, {df_digits}) AS df, round(b / se, 4) AS t_value,
  round({t_tail("b / se", "df")}, 4) AS p_value FROM ({rows})"""


def components(inner: str, outer: str) -> str:
    rows = f"SELECT '{inner}' AS \"group\", lc * ve AS v FROM fit UNION ALL SELECT '{outer}', lb * ve FROM fit UNION ALL SELECT 'residual', ve FROM fit"
    return f'SELECT "group", round(v, 3) AS variance, round(sqrt(v), 3) AS sd FROM ({rows})'


def summary() -> str:
    whole = "(fixed + lc * ve + lb * ve + ve)"
    return f"""SELECT n, j AS n_groups, round(best + (n - {_P}) * (1 + ln(2 * pi())), 3) AS reml, round(fixed / {whole}, 5) AS r2_marginal,
  round((fixed + lc * ve + lb * ve) / {whole}, 5) AS r2_conditional FROM fit"""


def inflation(terms: list[str]) -> str:
    """Variance inflation of three terms of one column each, from the covariance of the columns."""
    r = {(i, j): f"(k{i}{j} / sqrt(k{i}{i} * k{j}{j}))" for i in range(1, _P) for j in range(i, _P)}
    det = f"(1 + 2 * {r[1, 2]} * {r[1, 3]} * {r[2, 3]} - {r[1, 2]} ** 2 - {r[1, 3]} ** 2 - {r[2, 3]} ** 2)"
    rest = {1: r[2, 3], 2: r[1, 3], 3: r[1, 2]}
    rows = " UNION ALL ".join(f"SELECT '{t}' AS term, (1 - {rest[k]} ** 2) / {det} AS vif FROM fit" for k, t in enumerate(terms, 1))
    return f"SELECT term, CAST(1 AS BIGINT) AS df, round(vif, 4) AS vif, round(sqrt(vif), 4) AS scaled FROM ({rows})"
