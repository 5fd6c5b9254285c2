"""Mixing sources to target weights by capped water-filling (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotflux.llm.shared import WORD, stored

_LEVELS = 12  # bits of each level of the hash histogram
_BROADCAST_CELLS = 2_000_000  # rows x columns up to which a table of sources is broadcast


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for a missing one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), share: float = 1.0, max_epochs: float = 3.0
) -> DataFrame:
    """Target size of every source: columns ``source``, ``source_size``, ``target``.

    ``sizes`` has ``source`` (null is a source of its own, last in order) and ``size``.
    Sources in code point order weigh ``weights``, repeating. The wanted total is
    ``share`` of all sizes. Water-filling: the level of the unclamped sources is the
    wanted rest over their weights; sources whose share passes ``max_epochs`` times
    their size are clamped there and leave the rest to the others, until none is above.
    Every round is one aggregation over the sources; if all are clamped, all of them stay at
    their cap. Sources without words, and an empty table, get 0 or no row.
    """
    spark = sizes.sparkSession
    totals = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    # Ranks without a window over all sources: ranges in order, offsets from the ranges' counts.
    ranged = stored(
        totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id())
    )
    place = F.row_number().over(W.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())) - 1
    counts = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    offset, starts = 0, []
    for part in sorted(counts):
        starts += [F.lit(part), F.lit(offset)]
        offset += counts[part]
    begin = F.element_at(F.create_map(*starts), F.col("_range")) if starts else F.lit(0)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = stored(
        ranged.withColumn("weight", F.element_at(listed, ((place + begin) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .select("source", "source_size", "weight", "cap")
    )
    wanted = float(weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).collect()[0][0]) * share
    level = -1.0
    while True:
        # A source stays clamped once its share has passed its cap: the level never falls.
        clamped = F.col("cap") < F.col("weight") * F.lit(level)
        held, free = weighed.agg(
            F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0)),
        ).collect()[0]
        if free <= 0:
            level = float("inf")
            break
        risen = max(wanted - held, 0.0) / free
        if risen <= level:
            break
        level = risen
    if level == float("inf"):
        target = F.col("cap")
    else:
        target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return weighed.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    share: float = 1.0,
    max_epochs: float = 3.0,
    seed: int = 11,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Words that a weighted mix takes of every document.

    Returns ``id_col``, ``source``, ``size``, ``source_size``, ``target``, ``taken``: one row per
    input row. A source at ``q`` times its size takes every document ``floor(q)`` times
    whole; the rest is one more whole repetition of the documents with the smallest
    seeded hashes, and of the document at the edge the fraction that is still missing. The
    edge is found from two histograms of hashes, so no source is ever sorted whole; only
    the rows in one of 16 million hash bins are, and repeated rows there are counted and
    share evenly. Reruns and other partitionings take the same words.

    Null text: size 0, takes 0. Null source: a source of its own. Null and repeated ids
    are rows like any other. Columns besides the three named are ignored. Empty table: no rows.
    """
    bits = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(1 << (2 * _LEVELS)))
    rows = stored(
        docs.select(
            F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), bits.alias("_u")
        )
    )
    targets = source_targets(rows.select("source", "size"), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = stored(
        targets.withColumn("whole", whole.cast("long")).withColumn(
            "rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
        )
    )
    # Where the running size of documents in hash order passes the rest: coarse bin, hash, then document.
    coarse = _edge(
        rows.select("source", F.shiftright("_u", _LEVELS).alias("at"), "size"), plan.select("source", "rest")
    )
    inside = stored(_attach(rows, coarse, F.shiftright("_u", _LEVELS) == F.col("_at")).where("_at is not null"))
    fine = _edge(inside.select("source", F.col("_u").alias("at"), "size"), coarse.select("source", "rest"))
    tied = _attach(inside.select("source", "_u", "_id", "size"), fine, F.col("_u") == F.col("_at")).where("_at is not null")
    tied = tied.groupBy("source", "_u", "_id", "size", "_rest").agg(F.count("*").alias("n"))
    order = W.partitionBy("source").orderBy(F.col("_id").asc_nulls_last(), "size")
    before = F.coalesce(F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    missing = F.least(F.greatest(F.col("_rest") - before, F.lit(0)), F.col("size") * F.col("n"))
    edges = tied.select(
        "source", F.col("_id").alias("edge"), F.col("size").alias("edge_size"), F.floor(missing / F.col("n")).cast("long").alias("part")
    )
    # A source without an edge (its rest is all of it) takes every document once more.
    cuts = plan.join(
        fine.select(F.col("source").alias("_s"), F.col("at").alias("cut")), plan["source"].eqNullSafe(F.col("_s")), "left"
    ).select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(1 << (2 * _LEVELS))).alias("cut"))
    out = _attach(rows, stored(cuts))
    out = _attach(
        out,
        stored(edges),
        (F.col("_u") == F.col("_cut")) & F.col("_id").eqNullSafe(F.col("_edge")) & (F.col("size") == F.col("_edge_size")),
    )
    extra = F.when(F.col("_u") < F.col("_cut"), F.col("size")).otherwise(F.coalesce("_part", F.lit(0)))
    return out.select(
        F.col("_id").alias(id_col),
        "source",
        "size",
        "source_size",
        F.col("_target").alias("target"),
        (F.col("size") * F.col("_whole") + extra).cast("long").alias("taken"),
    )


def _edge(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """Per source the first bin ``at`` whose running size passes ``rest``, with the rest left at its start."""
    bins = rows.where("size > 0").groupBy("source", "at").agg(F.sum("size").alias("inside"))
    running = F.sum("inside").over(W.partitionBy("source").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    bins = bins.withColumn("upto", running)
    wanted = rest.select(F.col("source").alias("_s"), F.col("rest").alias("_wanted"))
    found = (
        bins.join(wanted, bins["source"].eqNullSafe(F.col("_s")))
        .where("upto > _wanted")
        .groupBy("source")
        .agg(F.min(F.struct("at", (F.col("_wanted") - F.col("upto") + F.col("inside")).alias("rest"))).alias("e"))
    )
    return stored(found.select("source", "e.at", "e.rest"))


def _attach(rows: DataFrame, lookup: DataFrame, condition: Column | None = None) -> DataFrame:
    """Left join a stored table of sources, its columns prefixed; broadcast while counted small.

    Beyond, it is a shuffle join that adaptive execution splits at hot sources.
    """
    renamed = lookup.select(*[F.col(c).alias(f"_{c}" if c != "source_size" else c) for c in lookup.columns])
    if lookup.count() * len(lookup.columns) <= _BROADCAST_CELLS:
        renamed = F.broadcast(renamed)
    same = F.col("source").eqNullSafe(F.col("_source"))
    joined = rows.join(renamed, same if condition is None else same & condition, "left")
    return joined.drop("_source")
