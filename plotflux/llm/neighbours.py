"""Approximate nearest neighbours by inner product: a forest of sorted hash strings per block."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Length of a hash string. Prefixes are compared up to this depth.
BITS = 32
_BUDGETS = (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5, 0.65, 0.8, 1.0)


class Forest:
    """Trees over one block of vectors: per tree the hash strings of all rows, sorted.

    A string has a bit for the side of a random plane. Inner products become angles by one more
    coordinate, which gives every row the length of the longest one; a query has 0 there.
    """

    def __init__(self, vectors: np.ndarray, trees: int = 32, seed: int = 3):
        self.vectors = vectors
        longest = max(float(np.sqrt((vectors**2).sum(1)).max(initial=0.0)), 1e-300)
        scaled = vectors / longest
        lifted = np.concatenate((scaled, np.sqrt(np.maximum(1 - (scaled**2).sum(1), 0))[:, None]), axis=1)
        planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((trees, BITS, vectors.shape[1] + 1))
        self.planes = planes
        strings = [self._strings(lifted, planes[t]) for t in range(trees)]
        self.order = [np.argsort(s, kind="stable") for s in strings]
        self.sorted = [s[o] for s, o in zip(strings, self.order)]

    @staticmethod
    def _strings(rows: np.ndarray, planes: np.ndarray) -> np.ndarray:
        return ((rows @ planes.T > 0) << np.arange(BITS - 1, -1, -1)).sum(1).astype(np.int64)

    def _descend(self, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges (depth, tree, query) of the rows that share a prefix of each depth with the query.

        Ends at the depth where no query's ranges hold ``wanted`` rows in all trees together:
        the ascent of every query stops above it.
        """
        lifted = np.concatenate((queries / np.maximum(np.sqrt((queries**2).sum(1)), 1e-300)[:, None], np.zeros((len(queries), 1))), axis=1)
        strings = [self._strings(lifted, planes) for planes in self.planes]
        low = [np.zeros((len(self.order), len(queries)), np.int64)]
        high = [np.full((len(self.order), len(queries)), len(self.vectors), np.int64)]
        for depth in range(1, BITS + 1):
            rest = (1 << (BITS - depth)) - 1
            low.append(np.stack([np.searchsorted(held, s & ~rest, "left") for held, s in zip(self.sorted, strings)]))
            high.append(np.stack([np.searchsorted(held, s | rest, "right") for held, s in zip(self.sorted, strings)]))
            if (high[-1] - low[-1]).sum(0).max(initial=0) < wanted:
                break
        return np.stack(low), np.stack(high)

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, budget: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the ids and inner products of the ``k`` nearest candidates, nearest first.

        All trees start at their longest matching prefixes and ascend together, one bit at a
        time, until they hold ``budget`` times the rows between them. Ranges are taken whole, so equal
        vectors are found together, and ties go to the smaller id.
        """
        out = []
        wanted = min(len(self.vectors), max(4 * k, math.ceil(budget * len(self.vectors))))
        for at in range(0, len(queries), 256):
            part = queries[at : at + 256]
            low, high = self._descend(part, wanted)
            held = (high - low).sum(1)
            # Where many rows are candidates anyway, one product of matrices is the cheapest way to all of theirs.
            products = part @ self.vectors.T if budget > 0.1 else None
            for q, query in enumerate(part):
                depth = int(np.flatnonzero(held[:, q] >= wanted)[-1])
                mark, marked = np.zeros(len(self.vectors), bool), 0
                while depth >= 0 and marked < wanted:
                    for order, a, b in zip(self.order, low[depth, :, q].tolist(), high[depth, :, q].tolist()):
                        mark[order[a:b]] = True
                    marked = int(np.count_nonzero(mark))
                    depth -= 1
                found = np.flatnonzero(mark & (ids != own[at + q]))
                near = products[q, found] if products is not None else self.vectors[found] @ query
                out.append(_best(self.vectors, found, near, query, ids, k))
        return out


def _best(vectors: np.ndarray, found: np.ndarray, near: np.ndarray, query: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(found) > k:
        edge = np.partition(near, len(near) - k)[len(near) - k]
        keep = near >= edge - 1e-9 * max(1.0, float(np.abs(near).max()))
        found = found[keep]
    # Row by row, so equal vectors get equal sums.
    score = (vectors[found] * query).sum(1)
    order = np.lexsort((ids[found], -score))
    listed, seen, scores = [], set(), []
    for i in order:
        if int(ids[found[i]]) not in seen:
            seen.add(int(ids[found[i]]))
            listed.append(int(ids[found[i]]))
            scores.append(float(score[i]))
            if len(listed) == k:
                break
    return np.array(listed, np.int64), np.array(scores)


def calibrated_budget(rows: np.ndarray, queries: np.ndarray, near: int, target: float, trees: int) -> float:
    """Smallest candidate share with which a bounded sample's true neighbours are found at ``target``."""
    if len(rows) < 200 or not len(queries):
        return 1.0
    forest = Forest(rows, trees)
    ids, own = np.arange(len(rows)), np.full(len(queries), -1)
    truth = [set(np.argsort(-(rows @ q), kind="stable")[:near].tolist()) for q in queries]
    for budget in _BUDGETS[:-1]:
        found = forest.search(queries, own, ids, near, budget)
        hit = sum(len(t & set(f.tolist())) for t, (f, _) in zip(truth, found))
        if hit >= target * sum(map(len, truth)):
            return budget
    return 1.0


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = 32,
    target_recall: float = 0.95,
    block_rows: int = 8192,
    chunk_queries: int = 8192,
    sample_rows: int = 8192,
) -> DataFrame:
    """Each query's ``k`` nearest rows by inner product: ``query_id``, ``rank``, the id, ``score``.

    Rows are dealt by hash into blocks of about ``block_rows`` and queries into chunks; every block
    builds its forest and serves a chunk, so a task holds one block and one chunk whatever the input.
    Then each query's best ``k`` of all blocks are taken. How far the trees ascend is fitted, once, on a
    sample of at most ``sample_rows`` rows and 200 queries against brute force at ``target_recall``.

    Vectors that are null, empty, zero, hold null or non-finite components, or have another length than
    most take no part, nor do null ids. A query never finds its own id; rows that repeat an id
    count once, by their best score. Fewer candidates than ``k``: all are returned. Ties: smaller id.
    Other columns are ignored, whatever their names. Empty table: no rows.
    """
    parts = F.col("vector")
    whole = ~F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("query"))
    good = good.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)).where(whole & F.exists(parts, lambda x: x != 0))
    spark = rows.sparkSession
    schema = f"query_id long, rank int, {id_col} long, score double"
    lengths = good.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"), F.sum(F.col("query").cast("int")).alias("queries"))
    most = lengths.orderBy(F.col("n").desc(), "length").limit(1).collect()
    if not most:
        return spark.createDataFrame([], schema)
    length, n, asked = most[0]["length"], most[0]["n"], most[0]["queries"] or 0
    good = good.where(F.size("vector") == length)
    share = min(1.0, sample_rows / n)
    draw = F.pmod(F.xxhash64("id", F.lit(21)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = good.where(draw).select("id", "vector").orderBy(F.xxhash64("id", F.lit(22)), "id").limit(sample_rows).toPandas()
    probe_share = min(1.0, 400 / max(asked, 1))
    some = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 30)) < int(probe_share * (1 << 30))
    probes = good.where("query").where(some).select("id", "vector").orderBy(F.xxhash64("id", F.lit(24)), "id").limit(200).toPandas()
    apart = ~sample["id"].isin(probes["id"])
    base = np.array(sample.loc[apart, "vector"].tolist(), float).reshape(-1, length)
    asks = np.array(probes["vector"].tolist(), float).reshape(-1, length)
    near = max(3, min(k, math.ceil(k * len(base) / n)))
    budget = calibrated_budget(base, asks, near, target_recall, trees)

    blocks = max(math.ceil(n / block_rows), min(12, math.ceil(n / 512)))
    chunks = max(1, math.ceil(asked / chunk_queries))
    dealt = good.select(
        "id",
        "vector",
        F.pmod(F.xxhash64("id", F.lit(25)), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"),
    )
    asking = good.where("query").select(
        "id",
        "vector",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(F.xxhash64("id", F.lit(26)), F.lit(chunks)).alias("chunk"),
    )

    def serve(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(held):
            return pd.DataFrame({"query_id": [], "found": [], "score": []})
        forest = Forest(np.stack(held["vector"].to_numpy()).astype(float), trees)
        own = queries["id"].to_numpy()
        results = forest.search(np.stack(queries["vector"].to_numpy()).astype(float), own, held["id"].to_numpy(), k, budget)
        return pd.DataFrame(
            {
                "query_id": np.repeat(own, [len(f) for f, _ in results]),
                "found": np.concatenate([f for f, _ in results]),
                "score": np.concatenate([s for _, s in results]),
            }
        )

    found = (
        asking.groupBy("block", "chunk").cogroup(dealt.groupBy("block", "chunk")).applyInPandas(serve, "query_id long, found long, score double")
    )
    # A repeated id, or a query row given twice, counts once.
    found = found.groupBy("query_id", "found").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "found"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias(id_col), "score"
    )
