"""URL filters: host rules, and for other URLs the ratio of two character language models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotflux.llm.shared import ascii_lower, stored

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_START, _END = "\x02", "\x03"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct ``rule``, ``verdict``; null if none does."""
    fits = None
    for name, start, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        test = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        one = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(test, one) if fits is None else fits.when(test, one)
    return fits


def _suffixes(padded: Column, end: Column, order: int) -> Column:
    """The grams that end at a place: the character with its contexts of 0 to ``order`` characters."""
    return F.transform(F.sequence(F.lit(0), F.least(F.lit(order), end - 1)), lambda k: F.substring(padded, end - k, k + 1))


def _padded(shown: Column) -> Column:
    return F.concat(F.lit(_START), shown, F.lit(_END))


def gram_counts(urls: DataFrame, order: int) -> DataFrame:
    """Occurrences of every context of up to ``order`` characters with the next one, per label.

    ``urls``: ``shown`` and ``label`` (0 blocked, 1 allowed). The grams of equal texts are counted
    once and multiplied; counts combine before the shuffle.
    """
    same = urls.groupBy("shown", "label").agg(F.count("*").alias("times"))
    ends = F.sequence(F.lit(2), F.length("padded"))
    return (
        same.withColumn("padded", _padded(F.col("shown")))
        .select("label", "times", F.explode(F.flatten(F.transform(ends, lambda end: _suffixes(F.col("padded"), end, order)))).alias("gram"))
        .groupBy("gram")
        .agg(
            F.sum(F.when(F.col("label") == 0, F.col("times")).otherwise(0)).alias("n0"),
            F.sum(F.when(F.col("label") == 1, F.col("times")).otherwise(0)).alias("n1"),
        )
    )


class UrlModel:
    """Two variable-order Markov models over characters, smoothed by Witten and Bell's rule.

    A context's prediction is mixed with that of the context one shorter, down to an even
    spread over the alphabet; contexts that were never seen fall through to the shorter one.
    """

    def __init__(self, grams: pd.DataFrame, order: int):
        self.order = order
        self.size = max(2, sum(len(g) == 1 for g in grams["gram"]) + 1)
        self.tables: list[tuple[dict[str, float], dict[str, tuple[float, float]]]] = []
        for label in ("n0", "n1"):
            used = grams[grams[label] > 0]
            counts = dict(zip(used["gram"], used[label].astype(float)))
            totals: dict[str, list[float]] = {}
            for gram, n in counts.items():
                seen = totals.setdefault(gram[:-1], [0.0, 0.0])
                seen[0] += n
                seen[1] += 1
            self.tables.append((counts, {c: (n, t) for c, (n, t) in totals.items()}))

    def _log_likelihood(self, text: str, table: int) -> float:
        counts, totals = self.tables[table]
        whole, total = f"{_START}{text}{_END}", 0.0
        for at in range(1, len(whole)):
            p = 1.0 / self.size
            for k in range(0, min(self.order, at) + 1):
                context = whole[at - k : at]
                seen = totals.get(context)
                if seen is None:
                    break
                p = (counts.get(context + whole[at], 0.0) + seen[1] * p) / (seen[0] + seen[1])
            total += np.log(p)
        return total

    def score(self, text: str) -> float:
        """Log-likelihood difference, allowed minus blocked, per character."""
        return (self._log_likelihood(text, 1) - self._log_likelihood(text, 0)) / (len(text) + 1)


def add_scores(rows: DataFrame, counts: DataFrame, order: int, most: int) -> DataFrame:
    """``rows`` with the ``score`` of ``shown`` under the models of all ``counts``.

    Models of up to ``most`` grams go to every task; larger ones stay a table that the texts' grams are joined to.
    """
    if counts.count() <= most:
        return rows.withColumn("score", _scorer(UrlModel(counts.orderBy("gram").toPandas(), order))(F.col("shown")))
    texts = stored(rows.groupBy("shown").agg(F.count("*").alias("uses")).withColumn("text", F.monotonically_increasing_id()))
    return _spread_join(rows, stored(joined_scores(texts, counts, order)), "shown")


def joined_scores(texts: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """``shown``, ``uses``, ``score`` of distinct texts with a number ``text``: what ``UrlModel`` gives, by joins.

    The probabilities of the texts' distinct grams are worked out from the shortest to the longest; a key of
    these joins has at most as many rows as there are characters.
    """
    grams = F.transform(
        F.sequence(F.lit(2), F.length("padded")),
        lambda end: F.struct(_suffixes(F.col("padded"), end, order).alias("all")),
    )
    places = texts.withColumn("padded", _padded(F.col("shown"))).select("text", F.explode(grams).alias("at"))
    tops = places.select("text", F.element_at("at.all", -1).alias("gram"))
    wanted = places.select(F.posexplode("at.all").alias("k", "gram"), (F.size("at.all") - 1).alias("last"))
    wanted = stored(wanted.groupBy("gram").agg(F.sum((F.col("k") == F.col("last")).cast("long")).alias("uses")))
    totals = [f(label) for label in ("0", "1") for f in (lambda i: F.sum(f"n{i}").alias(f"all{i}"), lambda i: F.count_if(F.col(f"n{i}") > 0).alias(f"kinds{i}"))]
    contexts = stored(counts.groupBy(F.expr("substring(gram, 1, length(gram) - 1)").alias("context")).agg(*totals))
    even = 1.0 / max(2, counts.where(F.length("gram") == 1).count() + 1)
    shorter, levels = None, []
    for k in range(order + 1):
        level = wanted.where(F.length("gram") == k + 1).join(counts, "gram", "left")
        level = level.withColumn("context", F.substring("gram", 1, k)).join(contexts, "context", "left")
        if shorter is None:
            level = level.withColumn("q0", F.lit(even)).withColumn("q1", F.lit(even))
        else:
            level = level.withColumn("shorter", F.substring("gram", 2, k)).join(
                shorter.select(F.col("gram").alias("shorter"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), "shorter"
            )
        mixed = [
            F.expr(f"CASE WHEN all{i} > 0 THEN (coalesce(n{i}, 0) + kinds{i} * q{i}) / (all{i} + kinds{i}) ELSE q{i} END").alias(f"p{i}")
            for i in (0, 1)
        ]
        shorter = stored(level.select("gram", "uses", *mixed))
        levels.append(shorter)
    weights = levels[0]
    for level in levels[1:]:
        weights = weights.union(level)
    weights = stored(weights.where("uses > 0").select("gram", "uses", F.expr("ln(p1) - ln(p0)").alias("weight")))
    sums = _spread_join(tops, weights, "gram").groupBy("text").agg(F.sum("weight").alias("sum"))
    return texts.join(sums, "text").select("shown", "uses", (F.col("sum") / (F.length("shown") + 1)).alias("score"))


def _spread_join(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Inner join to a stored table of distinct keys and their ``uses`` (rows on the left).

    Keys with more than a thousandth of the rows, so under a thousand, are broadcast; the rest is shuffled.
    """
    total = right.agg(F.sum("uses")).first()[0] or 0
    hot, rest = right.where(F.col("uses") * share > total).drop("uses"), right.where(F.col("uses") * share <= total).drop("uses")
    others = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return left.join(F.broadcast(hot), key).union(others)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    order: int = 4,
    id_col: str = "page_id",
    url_col: str = "url",
    most: int = 300_000,
) -> DataFrame:
    """Verdict on every URL: ``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``score``.

    URLs that a rule fits get its verdict, and are what the two models learn from: character
    counts of all of them, none left out. Models of more than ``most`` grams stay in Spark (``add_scores``). The cut on the length-normalised log-likelihood difference lies where
    labelled URLs in the fold that the calibration models did not see are told apart best (equal weight to both
    sides, the middle of the best stretch). With only one side labelled, or none, unruled URLs are allowed.

    Null URLs and URLs without ``://`` have an empty host and path, and no rule; they are scored as
    an empty text. Repeated rows and null ids stay rows of their own; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    rows = rows.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    rows = rows.withColumn("_fits", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("_shown", F.concat("host", "path"))
    labelled = stored(
        rows.where("_fits is not null").select(
            F.col("_shown").alias("shown"),
            (F.col("_fits.verdict") == "allow").cast("int").alias("label"),
            (F.pmod(F.xxhash64("_shown"), F.lit(5)) == 0).alias("held"),
        )
    )
    sides = {r[0] for r in labelled.select("label").distinct().collect()}
    open_ = rows.where("_fits is null")
    if sides == {0, 1}:
        cut = calibrated_cut(labelled, order, most)
        counts = stored(gram_counts(labelled, order))
        open_ = add_scores(open_.withColumnRenamed("_shown", "shown"), counts, order, most)
        open_ = open_.withColumn("verdict", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    else:
        open_ = open_.withColumn("score", F.lit(None).cast("double")).withColumn("verdict", F.lit("allow"))
    ruled = rows.where("_fits is not null").withColumn("score", F.lit(None).cast("double")).withColumn("verdict", F.col("_fits.verdict"))
    out = [F.col("_id").alias(id_col), "host", "path", F.col("_fits.rule").alias("rule"), "verdict", "score"]
    return ruled.select(*out).union(open_.select(*out))


def _scorer(model: UrlModel):
    shared = model

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        known: dict[str, float] = {"": shared.score("")}
        out = []
        for text in texts:
            if text not in known:
                known[text] = shared.score(text)
            out.append(known[text])
        return pd.Series(out)

    return score


def calibrated_cut(labelled: DataFrame, order: int, most: int, bins: int = 4000, reach: float = 4.0) -> float:
    """Cut with the best mean of both sides' shares on the held-out fold, from a histogram of its scores."""
    fit, held = labelled.where("not held"), labelled.where("held")
    if {r[0] for r in fit.select("label").distinct().collect()} != {0, 1}:
        return 0.0
    held = add_scores(held.select("shown", "label"), stored(gram_counts(fit, order)), order, most)
    place = F.floor((F.least(F.greatest(F.col("score"), F.lit(-reach)), F.lit(reach)) + reach) * (bins / (2 * reach)))
    found = held.select(place.alias("bin"), "label").groupBy("bin", "label").agg(F.count("*").alias("n")).toPandas()
    held_out = np.zeros((2, bins + 2))
    for at, label, n in found.itertuples(index=False):
        held_out[int(label), int(at) + 1] += n
    if not held_out.sum(1).all():
        return 0.0
    below = held_out.cumsum(1) / held_out.sum(1, keepdims=True)
    gain = below[0] - below[1]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[len(best) // 2] * (2 * reach / bins) - reach)
