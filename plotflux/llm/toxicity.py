"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotflux.llm.quality import bounded_sample
from plotflux.llm.shared import give_back, stored

# A general starting lexicon; the terms of the corpus are mined from labelled rows.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers trash scum worthless pathetic disgusting clown fool fools "
    "jerk hate kill ugly shut dumm trottel idiota estupido basura imbecil imbécile débile ordure abschaum versager".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur ya du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()
)
FEATURES = (
    "insults", "mined_words", "mined_stems", "mined_weight", "strongest", "distinct_terms", "near_you", "second_person",
    "capitals", "shouting", "exclamations", "questions", "punctuation", "obfuscated", "unmasked", "stretched", "log_words",
)
_STRIP = ".,;:!?\"'()[]{}<>*-_…«»“”"
_MASKED = re.compile(r"[^\W\d_][@$!*0-9]{1,3}[^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
STEMS = (4, 5, 6)


def terms(text: str) -> set[str]:
    """Distinct words of a text, and their stems (first letters, marked by ``*``)."""
    out = set()
    for word in set(text.lower().split()):
        word = word.strip(_STRIP)
        if word:
            out.add(word)
            out.update(f"{word[:k]}*" for k in STEMS if len(word) > k)
    return out


def mine_lexicon(rows: DataFrame, limit: int = 4000, least: int = 4, ratio: float = 6.0) -> dict[str, float]:
    """Terms of ``rows`` (``text``, ``label``) that are far likelier in toxic texts, with their log-odds.

    Counted once per text; a term needs ``least`` toxic texts. At most ``limit`` terms, the best by
    significance, so the lexicon stays small whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0), batch.column(1)):
                k = int(label.as_py() > 0)
                for term in terms(text.as_py() or ""):
                    found.setdefault(term, [0, 0])[k] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found)), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())],
                names=["term", "clean", "toxic"],
            )

    sides = rows.agg(F.sum(F.when(F.col("label") > 0, 1).otherwise(0)), F.count("*")).collect()[0]
    toxic_rows, all_rows = int(sides[0] or 0), int(sides[1])
    clean_rows = all_rows - toxic_rows
    if not toxic_rows or not clean_rows:
        return {}
    counted = rows.select("text", "label").mapInArrow(count, "term string, clean long, toxic long")
    counted = counted.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= least)
    odds = F.log((F.col("toxic") + 0.2) / (toxic_rows + 0.4)) - F.log((F.col("clean") + 0.2) / (clean_rows + 0.4))
    best = counted.withColumn("odds", odds).where(F.col("odds") >= math.log(ratio))
    top = best.orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "term").limit(limit)
    return {r["term"]: float(r["odds"]) for r in top.collect()}


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """Dense features of one whole text."""
    raw = text.split()
    words = [w.strip(_STRIP) for w in text.lower().split()]
    n, chars = max(len(words), 1), max(len(text), 1)
    insults = exact = stems = near = 0
    weight = strongest = 0.0
    distinct, hits = set(), []
    get = lexicon.get
    for at, word in enumerate(words):
        best = get(word, 0.0)
        if best:
            exact += 1
        else:
            for k in STEMS:
                if (found := get(f"{word[:k]}*", 0.0)) > best and len(word) > k:
                    best = found
            stems += best > 0
        if word in INSULTS:
            insults += 1
            best = best or 1.0
        if best:
            hits.append(at)
            weight += best
            strongest = max(strongest, best)
            distinct.add(word)
    for at in hits:
        near += any(w in SECOND_PERSON for w in words[max(0, at - 4) : at + 5])
    masked = _MASKED.findall(text)
    unmasked = 0
    if masked:
        unmasked = sum(1 for w in words if w.translate(_LEET) != w and (w.translate(_LEET) in INSULTS or get(w.translate(_LEET), 0.0) > 0))
    capitals = sum(map(str.isupper, text))
    return [
        1000 * insults / n, 1000 * exact / n, 1000 * stems / n, 1000 * weight / n, strongest, float(min(len(distinct), 50)),
        1000 * near / n, 1000 * sum(w in SECOND_PERSON for w in words) / n, capitals / chars,
        sum(w.isupper() and len(w) > 2 for w in raw) / n, 1000 * text.count("!") / chars, 1000 * text.count("?") / chars,
        sum(text.count(c) for c in ".,;:-'\"") / chars, 1000 * len(masked) / n, 1000 * unmasked / n,
        1000 * len(_STRETCHED.findall(text)) / n, math.log1p(len(words)),
    ]


def toxic_features(text: Column, lexicon: dict[str, float]) -> Column:
    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t or "", lexicon) for t in texts])
        give_back()

    return of(text)


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is hashed as an empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    limit: int = 24_000,
    cut: float = 0.3,
) -> DataFrame:
    """Toxicity of every whole text: ``id_col``, ``held_out``, ``score`` (0 to 1), ``predicted``.

    Trains on at most about ``limit`` labelled rows outside the held-out quarter, split by hash:
    one half mines the lexicon, three tenths grow the trees, a fifth calibrates their scores by
    isotonic regression. So terms, trees and calibration never see the same rows. Only the text is scored.
    Null and empty texts are scored as texts without words. Rows without a label, an id or a text do
    not train; with one label only, or none, every score is that label's (or an even) smoothed rate.
    Null and repeated ids stay rows of their own; other columns are ignored. Empty table: no rows.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    marked = marked.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("label"))
    few = stored(bounded_sample(marked, F.col("_id"), limit))
    train = stored(
        docs.where(F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(few), "_id")  # at most about ``limit`` rows
        .select("text", "label", F.pmod(F.xxhash64("_id", F.lit(9)), F.lit(10)).alias("fold"))
    )
    sides = {(r["part"], r["label"]): r["n"] for r in train.groupBy(
        F.when(F.col("fold") < 5, 0).when(F.col("fold") < 8, 1).otherwise(2).alias("part"), "label").agg(F.count("*").alias("n")).collect()}
    if any(not sides.get((part, label)) for part in (1, 2) for label in (0.0, 1.0)):
        toxic = sum(n for (_, label), n in sides.items() if label == 1.0)
        score: Column = F.lit((toxic + 1) / (sum(sides.values()) + 2))
        scored = docs.select(F.col(id_col).alias("_id"), score.alias("score"))
        return _result(scored, id_col, cut)
    lexicon = mine_lexicon(train.where("fold < 5"))
    ready = stored(train.where("fold >= 5").select(toxic_features(F.col("text"), lexicon).alias("signals"), "label", "fold"))
    ready = ready.withColumn("features", array_to_vector("signals"))
    trees = GBTClassifier(maxIter=25, maxDepth=3, stepSize=0.3, maxBins=32, minInstancesPerNode=5, seed=7).fit(ready.where("fold < 8"))

    def margin(frame: DataFrame) -> DataFrame:
        return trees.transform(frame).withColumn("margin", F.element_at(vector_to_array("rawPrediction"), 2))

    calibration = margin(ready.where("fold >= 8")).select("margin", "label")
    steps = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(calibration)
    signals = docs.select(F.col(id_col).alias("_id"), toxic_features(F.col(text_col), lexicon).alias("signals"))
    scored = steps.transform(margin(signals.withColumn("features", array_to_vector("signals"))))
    return _result(scored.select("_id", "score"), id_col, cut)


def _result(scored: DataFrame, id_col: str, cut: float) -> DataFrame:
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.select(
        F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), score.alias("score"), (score >= cut).cast("int").alias("predicted")
    )
