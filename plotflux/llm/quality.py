"""Quality by document evidence and site: hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotflux.llm.shared import counted_broadcast, give_back, small_batches, stored

FEATURES = (
    "log_words", "mean_word", "distinct", "top_word", "repeats", "line_repeats", "capitals", "marks",
    "symbols", "bars", "digits", "inner_caps", "one_letter", "plain_words", "odd",
)
_MARKS, _SYMBOLS, _BARS = (np.frombuffer(x, np.uint8) for x in (b"!?", b"$%&*#@^~<>{}[]\\=+_`", b"|"))
_UPPER = np.arange(65, 91)


def features(text: str) -> list[float]:
    """Dense signals of one whole text, in one pass over its bytes and one over its words."""
    data = text.encode("utf-8", "replace")
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, np.int64)
    n = max(len(data), 1)
    words = text.split()
    count = max(len(words), 1)
    seen = Counter(words)
    lines = [line for line in text.split("\n") if len(line) > 20]
    letters = max(int(bytes_[_UPPER].sum() + bytes_[97:123].sum() + bytes_[128:].sum() // 2), 1)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    plain = sum(k for w, k in seen.items() if w.strip(".,;:").isalpha())
    return [
        math.log1p(len(words)),
        min(len(text) / count, 40.0),
        math.log(len(seen) + 1) / math.log(count + 1),
        max(seen.values(), default=0) / count,
        repeats / count,
        1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0,
        int(bytes_[_UPPER].sum()) / letters,
        int(bytes_[_MARKS].sum()) / n,
        int(bytes_[_SYMBOLS].sum()) / n,
        int(bytes_[_BARS].sum()) / n,
        int(bytes_[48:58].sum()) / n,
        sum(k for w, k in seen.items() if not w.islower() and w[1:] != w[1:].lower()) / count,
        sum(k for w, k in seen.items() if len(w) == 1) / count,
        plain / count,
        int(bytes_[:9].sum() + bytes_[14:32].sum() + bytes_[127]) / n,
    ]


def quality_features(text: Column | str) -> Column:
    """The signals of a text column, as an array of doubles."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t or "") for t in texts])
        give_back()

    return of(text)


def bounded_sample(rows: DataFrame, key: Column, limit: int) -> DataFrame:
    """About ``limit`` rows at most, by a hash of the key: the same rows on every run."""
    n = rows.count()
    if n <= limit:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * limit / n))


class QualityModel:
    """Logistic regression on standardised signals, as coefficients for a DataFrame expression."""

    def __init__(self, weights: list[float], intercept: float, base: float):
        self.weights, self.intercept, self.base = weights, intercept, base

    def logit(self, signals: Column) -> Column:
        weights = F.array(*[F.lit(float(w)) for w in self.weights])
        terms = F.zip_with(signals, weights, lambda a, b: a * b)
        raw = F.aggregate(terms, F.lit(float(self.intercept)), lambda a, b: a + b)
        # Evidence of one text is kept within odds of a million to one.
        return F.greatest(F.least(raw, F.lit(14.0)), F.lit(-14.0))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = 20_000
) -> QualityModel:
    """Fit on at most about ``limit`` labelled rows (all of them while there are fewer).

    Rows without a label, an id or a text do not train. With one label only, or none, every
    text gets that label's (or an even) rate, smoothed.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(label_col).cast("double").alias("label")
    )
    few = stored(bounded_sample(marked, F.col("_id"), limit))
    counts = {int(r["label"]): r["n"] for r in few.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    base = (good + 1) / (good + bad + 2)
    if not good or not bad:
        return QualityModel([0.0] * len(FEATURES), math.log(base / (1 - base)), base)
    # At most ``limit`` short rows: the texts are not shuffled for them.
    train = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(few), "_id"
    )
    train = stored(train.select(quality_features("_text").alias("signals"), "label"))
    n = train.count()
    if not n:
        return QualityModel([0.0] * len(FEATURES), math.log(base / (1 - base)), base)
    model = LogisticRegression(maxIter=60, regParam=0.003, standardization=True).fit(
        train.select(array_to_vector("signals").alias("features"), "label")
    )
    return QualityModel([float(w) for w in model.coefficients.toArray()], float(model.intercept), base)


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """The documents that are kept, with their own columns, stored."""
    with small_batches(docs.sparkSession):
        judged = judge_quality(docs, fit_quality(docs, labels), keep_at=keep_at)
        return stored(judged.where("_quality.keep").select("_row.*"))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(rows: DataFrame, parent: Column) -> float:
    """Pseudo-count of a level's prior: moments of its groups' rates around their parents' rate.

    The variance between groups is what exceeds the variance of evidence within them; the
    smaller it is, the stronger groups are shrunk.
    """
    # Sum over groups of n x (variance of the group's mean).
    mean_variance = parent * (1 - parent)
    spread, mean, within = rows.agg(
        F.sum((F.col("s") / F.col("n") - parent) ** 2 * F.col("n")) / F.sum("n"),
        F.sum("s") / F.sum("n"),
        F.sum(mean_variance) / F.sum("n"),
    ).collect()[0]
    if mean is None or spread is None:
        return 10.0
    ceiling = max(mean * (1 - mean), 1e-6)
    between = max(spread - within, ceiling / 10_000)
    return float(min(max(ceiling / between - 1, 2.0), 10_000.0))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """Posterior rates by host and path from rows ``host``, ``path``, ``p``.

    One grouped aggregation over the rows, and one over its result. Returns the table (host, path, and
    the sums needed to leave a document out), the global rate, and the prior strengths of hosts and paths.
    """
    paths = stored(
        scored.groupBy("host", "path").agg(
            F.sum("p").alias("s"), F.count("*").cast("double").alias("n"), F.sum(F.col("p") * (1 - F.col("p"))).alias("v")
        )
    )
    hosts = stored(paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("v").alias("v")))
    total, rows = hosts.agg(F.sum("s"), F.sum("n")).collect()[0]
    rate = ((total or 0.0) + 1) / ((rows or 0.0) + 2)
    k_host = _strength(hosts, F.lit(rate))
    parent = hosts.select(
        F.col("host").alias("_host"), F.col("s").alias("host_s"), F.col("n").alias("host_n")
    )
    both = paths.join(parent, paths["host"].eqNullSafe(parent["_host"])).drop("_host")
    both = stored(both)
    k_path = _strength(both, F.col("host_s") / F.col("host_n"))
    return both, rate, k_host, k_path


def judge_quality(
    docs: DataFrame,
    model: QualityModel,
    host_col: str = "source",
    path_col: str = "lang",
    text_col: str = "text",
    keep_at: float = 0.5,
) -> DataFrame:
    """The rows of ``docs`` with a struct ``_quality``: ``document``, ``host``, ``path``, ``score``, ``keep``.

    The classifier's probability is the evidence of one document. Sums of it by path and host give
    Beta posteriors: a path is shrunk to its host, a host to the global rate, each by a prior strength
    estimated from how much the level's groups differ. A document's own evidence is left out of its
    site's rate; its odds are then multiplied by the site's odds over the global ones (Bayes' rule for a
    changed base rate), and it is kept at a probability of ``keep_at`` or more.

    Signals are worked out twice, once for the grouped sums and once for the decision, so no text is
    shuffled or copied; the site table is broadcast while counted small, else joined by shuffle.
    Null host or path: a site of its own. Null and empty texts: scored like any text, without words.
    Repeated rows count as often as they occur. Columns keep their names; empty table: no rows.
    """
    signals = quality_features(F.col(text_col))
    narrow = docs.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"), signals.alias("signals"))
    scored = narrow.select("host", "path", (1 / (1 + F.exp(-model.logit(F.col("signals"))))).alias("p"))
    sites, rate, k_host, k_path = site_posteriors(scored)
    lookup = counted_broadcast(
        sites.select(F.struct("host", "path", "s", "n", "host_s", "host_n").alias("_site"))
    )
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), signals.alias("_signals"))
    packed = packed.select("_row", model.logit(F.col("_signals")).alias("_logit"))
    at = packed.join(
        lookup,
        F.col("_row")[host_col].eqNullSafe(F.col("_site.host")) & F.col("_row")[path_col].eqNullSafe(F.col("_site.path")),
        "left",
    )
    p = 1 / (1 + F.exp(-F.col("_logit")))
    host_rate = (F.col("_site.host_s") - p + k_host * rate) / (F.col("_site.host_n") - 1 + k_host)
    host_rate = F.least(F.greatest(host_rate, F.lit(0.001)), F.lit(0.999))
    path_rate = (F.col("_site.s") - p + k_path * host_rate) / (F.col("_site.n") - 1 + k_path)
    path_rate = F.least(F.greatest(path_rate, F.lit(0.001)), F.lit(0.999))
    shifted = F.col("_logit") + _logit(path_rate) - math.log(rate / (1 - rate))
    score = 1 / (1 + F.exp(-shifted))
    judged = F.struct(
        p.alias("document"), host_rate.alias("host"), path_rate.alias("path"), score.alias("score"), (score >= keep_at).alias("keep")
    )
    return at.select("_row", judged.alias("_quality"))
