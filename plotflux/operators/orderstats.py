"""Exact order statistics, quantiles and ranks of columns of any size.

A rank needs an order over all values, which a plain window would gather in one
task. Whole columns, any number at a time, are closed in on by aggregations over
the rows as they lie: sketched edges around every rank, the counts between them, and
at last the few values between two edges. In groups, the values are first counted per
distinct value. When those counts are few (checked), one window per group is enough. Beyond
that, the range of values is cut in cells, ranks are located from the cell counts, and only
the cells that hold a wanted rank are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotflux.session import durable, join_checked, null_safe_join

# A group is ordered by one window when it was counted to have at most this many rows.
WINDOW_ROWS = 1_000_000
CELLS_PER_REGION = 256
SKETCH_ACCURACY = 10_000
# Values of whole columns that one aggregation may take and sort, over all columns.
HELD_VALUES = 200_000
SKETCH_MARGIN = 4.0 / SKETCH_ACCURACY

# Rank as a function of the number of values n, counted from 1.
RankFunction = Callable[[Column], Column]


def _values(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    v = F.col(value).cast("double")
    return df.select(*by, v.alias("_v")).where(v.isNotNull() & ~F.isnan(v))


def _pick(
    counted: DataFrame,
    by: Sequence[str],
    part: Sequence[str],
    order: str,
    wanted: Mapping[str, RankFunction],
) -> DataFrame:
    """Explode the wanted ranks of each group onto the counted entry that holds them.

    ``counted`` has one row per (part, order) with its count ``_k``.
    """
    window = Window.partitionBy(*part)
    upto = window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counted.withColumns(
        {"_cum": F.sum("_k").over(upto), "_n": F.sum("_k").over(window)}
    )
    at = {name: rank(F.col("_n")).cast("long") for name, rank in wanted.items()}
    before = F.col("_cum") - F.col("_k")
    holds_any = F.lit(False)
    for rank in at.values():
        holds_any = holds_any | ((rank > before) & (rank <= F.col("_cum")))
    ranks = F.array(*[F.struct(F.lit(n).alias("name"), r.alias("rank")) for n, r in at.items()])
    return (
        running.where(holds_any)
        .withColumn("_before", before)
        .withColumn("_hit", F.explode(ranks))
        .where((F.col("_hit.rank") > F.col("_before")) & (F.col("_hit.rank") <= F.col("_cum")))
        .select(
            *by, order, "_n", F.col("_hit.name").alias("_name"),
            (F.col("_hit.rank") - F.col("_before")).alias("_local"),
        )
    )


def _wide(found: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    return found.groupBy(*by).agg(
        F.max("_n").alias("n"),
        *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in names],
    )


def _by_window(values: DataFrame, by: Sequence[str], wanted: Mapping[str, RankFunction]) -> DataFrame:
    counted = values.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_k"))
    return _wide(_pick(counted, by, by, "_v", wanted), by, list(wanted))


def _with_cells(values: DataFrame, by: Sequence[str], probs: Sequence[float], cells: int) -> DataFrame:
    """Add ``_cell``, a number that never falls as the value rises.

    Edges are the minimum, sketched quantiles just below and above every wanted
    probability, and the maximum; each region between edges is cut evenly. The
    sketch only decides how even the cells are, not which value is found.
    """
    around = [min(max(p + s * SKETCH_MARGIN, 0.0), 1.0) for p in sorted(probs) for s in (-1, 1)]
    edges = F.array_sort(
        F.concat(
            F.array(F.min("_v")),
            F.percentile_approx("_v", around, SKETCH_ACCURACY),
            F.array(F.max("_v")),
        )
    ).alias("_e")
    regions = len(around) + 1
    rows = join_checked(values, values.groupBy(*by).agg(edges, F.count(F.lit(1)).alias("_held")), by, "inner", weight="_held")
    at, v = F.col("_e"), F.col("_v")
    region = F.lit(0)
    for i in range(1, regions):
        region = region + (v >= at[i]).cast("int")
    rows = rows.withColumn("_r", region)
    low, high = F.get(at, F.col("_r")), F.get(at, F.col("_r") + 1)
    share = F.when(high > low, (v - low) / (high - low) * cells).otherwise(0.0)
    inside = F.least(F.greatest(F.floor(F.nanvl(share, F.lit(0.0))), F.lit(0)), F.lit(cells - 1))
    return rows.select(*by, "_v", (F.col("_r") * cells + inside).cast("long").alias("_cell"))


def _by_cells(
    values: DataFrame,
    by: Sequence[str],
    wanted: Mapping[str, RankFunction],
    probs: Sequence[float],
    cells: int,
) -> DataFrame:
    rows = _with_cells(values, by, probs, cells)
    counted = rows.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_k"))
    targets = durable(_pick(counted, by, by, "_cell", wanted))
    hit = join_checked(rows, targets.select(*by, "_cell").distinct(), [*by, "_cell"], "inner")
    inside = hit.groupBy(*by, "_cell", "_v").agg(F.count(F.lit(1)).alias("_k"))
    part = Window.partitionBy(*by, "_cell").orderBy("_v")
    running = inside.withColumn(
        "_cum", F.sum("_k").over(part.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    inside = F.col("_local").between(F.col("_cum") - F.col("_k") + 1, F.col("_cum"))
    found = null_safe_join(running, targets, [*by, "_cell"], "inner").where(inside)
    return _wide(found, by, list(wanted))


def _finite(column: str) -> Column:
    """The column as doubles without NaN, which counts as missing."""
    return F.nullif(F.col(f"`{column}`").cast("double"), F.lit(float("nan")))


class _Search:
    """The state of one wanted rank of one column: the values it lies between, both counted.

    ``below`` values lie below ``low``; ``inside`` ones strictly between ``low`` and ``high``. An end
    that is None is open.
    """

    def __init__(self, rank: int, n: int):
        self.rank, self.low, self.high, self.below, self.inside = rank, None, None, 0, n
        self.value: float | None = None

    @property
    def local(self) -> int:
        """Place among the inside values, from 1."""
        return self.rank - self.below

    def within(self, v: Column) -> Column:
        test = v.isNotNull()
        if self.low is not None:
            test = test & (v > F.lit(self.low))
        if self.high is not None:
            test = test & (v < F.lit(self.high))
        return F.when(test, v)

    def narrow(self, edges: Sequence[tuple[float, int, int]]) -> None:
        """Close in by values in order, each with the numbers of inside values below and at it."""
        place, passed, total = self.local, 0, self.inside
        for value, less, same in edges:
            if place <= less:
                self.high, total = value, less
                break
            if place <= less + same:
                self.value = value
                return
            self.low, passed = value, less + same
        self.below, self.inside = self.below + passed, total - passed


def locate_ranks(
    df: DataFrame,
    columns: Sequence[str],
    wanted: Mapping[str, RankFunction],
    also: Mapping[str, Callable[[Column], Column]] | None = None,
    held_values: int = HELD_VALUES,
) -> dict[str, dict]:
    """The values at exact ranks of whole columns: per column ``n``, the wanted names, and the aggregates ``also``.

    Every step is one aggregation over all columns side by side; no row is moved. Edges around each rank are
    sketched among the values it may still be, then the values below and at the edges are counted, until so
    few are left between two of them (``held_values`` over all columns) that they are taken and sorted.
    A value that many rows share is found when it becomes an edge. Only the edges and counts meet the driver.
    A column without values has missing results.
    """
    value = {c: _finite(c) for c in columns}
    first = [
        F.struct(
            F.count(value[c]).alias("n"),
            *[rank(F.count(value[c])).cast("long").alias(f"rank_{name}") for name, rank in wanted.items()],
            *[make(value[c]).alias(f"also_{name}") for name, make in (also or {}).items()],
        ).alias(f"c{k}")
        for k, c in enumerate(columns)
    ]
    counts = df.agg(*first).collect()[0]
    found = {c: {"n": counts[k]["n"], **{a: counts[k][f"also_{a}"] for a in also or {}}} for k, c in enumerate(columns)}
    searches: dict[tuple[str, int], _Search] = {}
    for k, c in enumerate(columns):
        for name in wanted:
            rank = counts[k][f"rank_{name}"]
            if counts[k]["n"] and 1 <= rank <= counts[k]["n"]:
                searches.setdefault((c, rank), _Search(rank, counts[k]["n"]))
    while True:
        # Ranks that lie between the same values are searched as one.
        spans: dict[tuple, list[_Search]] = {}
        for (c, _), s in searches.items():
            if s.value is None:
                spans.setdefault((c, s.low, s.high), []).append(s)
        if not spans:
            break
        listed = list(spans.items())
        left = sum(same[0].inside for _, same in listed)
        if left <= held_values:
            taken = df.agg(*[F.array_sort(F.collect_list(same[0].within(value[key[0]]))).alias(f"v{i}") for i, (key, same) in enumerate(listed)]).collect()[0]
            for i, (_, same) in enumerate(listed):
                for s in same:
                    s.value = taken[i][s.local - 1]
            break
        asked = []
        for _, same in listed:
            around = sorted({min(max(s.local / s.inside + side * SKETCH_MARGIN, 0.0), 1.0) for s in same for side in (-1, 1)})
            asked.append(around)
        sketched = df.agg(
            *[F.percentile_approx(same[0].within(value[key[0]]), around, SKETCH_ACCURACY).alias(f"e{i}") for i, ((key, same), around) in enumerate(zip(listed, asked))]
        ).collect()[0]
        edges = [sorted(set(e)) for e in sketched]
        tests = []
        for i, ((key, same), mine) in enumerate(zip(listed, edges)):
            v = same[0].within(value[key[0]])
            for j, e in enumerate(mine):
                tests += [F.count_if(v < F.lit(e)).alias(f"b{i}_{j}"), F.count_if(v == F.lit(e)).alias(f"s{i}_{j}")]
        counted = df.agg(*tests).collect()[0]
        for i, ((_, same), mine) in enumerate(zip(listed, edges)):
            steps = [(e, counted[f"b{i}_{j}"], counted[f"s{i}_{j}"]) for j, e in enumerate(mine)]
            for s in same:
                s.narrow(steps)
    for k, c in enumerate(columns):
        for name in wanted:
            search = searches.get((c, counts[k][f"rank_{name}"]))
            found[c][name] = search.value if search else None
    return found


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Mapping[str, float],
    also: Mapping[str, Callable[[Column], Column]] | None = None,
    held_values: int = HELD_VALUES,
) -> dict[str, dict]:
    """Quantiles of whole columns with linear interpolation, per column; see ``locate_ranks``."""
    found = locate_ranks(df, columns, _neighbours(probs), also, held_values)
    for one in found.values():
        for name, p in probs.items():
            low, high = one.pop(f"_lo_{name}"), one.pop(f"_hi_{name}")
            at = (one["n"] - 1) * float(p) + 1
            one[name] = None if low is None else low + (high - low) * (at - math.floor(at))
    return found


def _neighbours(probs: Mapping[str, float]) -> dict[str, RankFunction]:
    """The ranks below and above every quantile."""
    wanted: dict[str, RankFunction] = {}
    for name, p in probs.items():
        position = lambda n, p=p: (n - 1) * F.lit(float(p)) + 1
        wanted[f"_lo_{name}"] = lambda n, at=position: F.floor(at(n))
        wanted[f"_hi_{name}"] = lambda n, at=position: F.ceil(at(n))
    return wanted


def order_statistics(
    df: DataFrame,
    value: str,
    wanted: Mapping[str, RankFunction],
    by: Sequence[str] = (),
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    window_rows: int = WINDOW_ROWS,
    cells: int = CELLS_PER_REGION,
) -> DataFrame:
    """The values at exact ranks per group, with ``n`` and one column per wanted rank.

    Missing values are left out. ``probs`` says roughly where the ranks lie.
    """
    if not by:
        one = locate_ranks(df, [value], wanted, held_values=min(window_rows, HELD_VALUES))[value]
        schema = ", ".join(["n long", *[f"`{name}` double" for name in wanted]])
        rows = [(one["n"], *[one[name] for name in wanted])] if one["n"] else []
        return df.sparkSession.createDataFrame(rows, schema)
    values = _values(df, value, by)
    sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    large = durable(sizes.where(F.col("_rows") > window_rows))
    if large.isEmpty():
        return _by_window(values, by, wanted)
    # Only the large groups, of which there cannot be many, take the longer way.
    marked = join_checked(values, large, by, "left")
    small = marked.where(F.col("_rows").isNull()).drop("_rows")
    rest = marked.where(F.col("_rows").isNotNull()).drop("_rows")
    return _by_window(small, by, wanted).unionByName(_by_cells(rest, by, wanted, probs, cells))


def quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Quantiles with linear interpolation between order statistics."""
    stats = order_statistics(df, value, _neighbours(probs), by, list(probs.values()), window_rows)
    made = []
    for name, p in probs.items():
        at = (F.col("n") - 1) * F.lit(float(p)) + 1
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        made.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return stats.select(*by, "n", *made)


def hinges(
    df: DataFrame, value: str, by: Sequence[str] = (), window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Tukey's hinges: medians of the lower and the upper half, the median in both."""
    depth = lambda n: F.floor((n + 3) / 2) / 2
    wanted = {
        "_l1": lambda n: F.floor(depth(n)),
        "_l2": lambda n: F.ceil(depth(n)),
        "_u1": lambda n: n + 1 - F.floor(depth(n)),
        "_u2": lambda n: n + 1 - F.ceil(depth(n)),
    }
    stats = order_statistics(df, value, wanted, by, (0.25, 0.75), window_rows)
    return stats.select(
        *by,
        "n",
        ((F.col("_l1") + F.col("_l2")) / 2).alias("lower_hinge"),
        ((F.col("_u1") + F.col("_u2")) / 2).alias("upper_hinge"),
    )


def average_ranks(df: DataFrame, columns: Sequence[str], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Ranks of the distinct values of several whole columns, ties sharing their mean rank.

    One row (``column``, ``value``, ``k``, ``rank``) per distinct value, ``k`` being
    its number of rows, from one scan. Beyond ``window_rows`` distinct values the
    counts are range-partitioned by column and value, each range is ordered by
    itself, and the totals of the lower ranges of the same column are added.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )
    counted = durable(
        long.where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("k"))
    )
    size = counted.count()
    small = size <= window_rows
    if small:
        ranged = counted.withColumn("_part", F.lit(0))
    else:
        parts = max(2, -(-size // max(window_rows, 1000)))
        ranged = durable(
            counted.repartitionByRange(parts, "column", "value").withColumn(
                "_part", F.spark_partition_id()
            )
        )
    upto = Window.partitionBy("column", "_part").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = ranged.withColumn("_cum", F.sum("k").over(upto))
    start = F.col("_cum") - F.col("k")
    if not small:
        # One row per column and range, so this table is as small as the number of ranges.
        lower = Window.partitionBy("column").orderBy("_part")
        offsets = (
            ranged.groupBy("column", "_part")
            .agg(F.sum("k").alias("_total"))
            .withColumn("_offset", F.sum("_total").over(lower) - F.col("_total"))
            .select("column", "_part", "_offset")
        )
        running = running.join(F.broadcast(offsets), ["column", "_part"])
        start = start + F.col("_offset")
    return running.select("column", "value", "k", (start + (F.col("k") + 1) / 2).alias("rank"))
