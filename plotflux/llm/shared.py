"""Helpers shared by the text operators: stored tables, word hashes, bit maps, components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotflux.session import ensure_checkpoint_dir

#: A word is a longest run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared folder named by ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/plotflux-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and continue from there.

    Cuts the lineage like a checkpoint, in compressed columns; a lost executor costs
    nothing but its running tasks. The tables go with the run's shared folder.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read any more; results made from them must be stored themselves."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Python workers take at most ``rows`` whole texts at a time in the actions inside; the setting is the caller's again after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name, None)
    if held is None or not 0 < int(held) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, held)


def give_back() -> None:
    """Hand memory that a Python worker no longer uses back to the machine; workers live through many tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so that what a task builds beside them stays bounded."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        give_back()


def ascii_lower(column: Column) -> Column:
    """Lower-case A to Z and leave every other character alone."""
    return F.translate(column, UPPER, LOWER)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix64 finish)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BLOCK, _BASE)
_DOWN = _powers(_BLOCK, pow(_BASE, -1, 1 << 64))


def word_hashes(data: bytes, folded: bool = True) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, A-Z lower-cased when ``folded``.

    Works on whole arrays: prefix sums of byte values times powers of an odd number
    give every word's polynomial hash by a difference and an inverse power. Texts
    longer than a block are cut at white space, so memory stays bounded; a single
    word longer than a block is hashed by itself.
    """
    if folded:
        data = data.lower()
    if len(data) > _BLOCK:
        parts, at = [], 0
        while at < len(data):
            end = min(at + _BLOCK, len(data))
            if end < len(data):
                cut = max(data.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                if cut <= at:  # one word fills the block: find where it ends
                    ends = [p for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := data.find(c, end)) >= 0]
                    stop = min(ends, default=len(data))
                    parts.append(_long_word(data[at:stop]))
                    at = stop + 1
                    continue
                end = cut + 1
            parts.append(word_hashes(data[at:end], folded=False))
            at = end
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _UP[: len(raw)], dtype=np.uint64)))
    h = (total[end] - total[start]) * _DOWN[np.minimum(start, _BLOCK - 1)]
    return mix(h + (end - start).astype(np.uint64))


def _long_word(data: bytes) -> np.ndarray:
    """Hash of a text without white space, of any length, equal to what a block would give."""
    lead = data.lstrip(b" \n\t\r\x0b\x0c")
    if len(lead) <= _BLOCK:
        return word_hashes(lead, folded=False)
    value, power = 0, 1
    for at in range(0, len(lead), _BLOCK):
        raw = np.frombuffer(lead[at : at + _BLOCK], dtype=np.uint8)
        part = int((_BYTE[raw] * _UP[: len(raw)]).sum(dtype=np.uint64))
        value = (value + part * power) % (1 << 64)
        power = power * pow(_BASE, len(raw), 1 << 64) % (1 << 64)
    return mix(np.array([(value + len(lead)) % (1 << 64)], dtype=np.uint64))


_STEP = [np.uint64(int(x) | 1) for x in mix(np.arange(11, 75, dtype=np.uint64))]


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of the runs of ``size`` words; of the whole sequence when it is shorter."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    h = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        h += words[i : n - k + 1 + i] * _STEP[i]
        h ^= h >> np.uint64(29)
    return mix(h)


def bit_map(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bit map of ``2 ** bits`` bits over the long hashes in a column: a filter without false negatives.

    Folded by an aggregation, so its size is fixed whatever the number of hashes.
    """
    place = F.col(column).bitwiseAND((1 << bits) - 1)
    rows = (
        df.select(F.shiftright(place, 5).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(31).cast("int")).alias("bit"))
        .groupBy("at")
        .agg(F.bit_or("bit").alias("bit"))
    )
    out = np.zeros(1 << max(bits - 5, 0), dtype=np.uint32)
    got = rows.toPandas()
    out[got["at"].to_numpy(np.int64)] = got["bit"].to_numpy(np.uint64).astype(np.uint32)
    return out


def in_bit_map(filled: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    place = hashes.astype(np.uint64) & np.uint64((1 << bits) - 1)
    return (filled[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every id in ``edges``: columns ``id`` and ``component``.

    Alternates large and small stars: every id links its larger neighbours to the
    smallest one, then the smallest one to the rest, until nothing changes. Each
    round is a pair of aggregations that combine before the shuffle; no group is
    gathered. The edge table is stored between rounds.
    """
    links = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: larger neighbours of u go to the smallest of u and its neighbours.
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # Small star: u and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = stored(small)
        marks = [
            d.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).collect()[0]
            for d in (links, after)
        ]
        discard(links)
        links = after
        if tuple(marks[0]) == tuple(marks[1]):
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    root = links.groupBy("u").agg(F.min("v").alias("component"))
    return root.select(F.col("u").alias("id"), "component").union(
        root.select(F.col("component").alias("id"), "component").distinct()
    )


def counted_broadcast(df: DataFrame, cells: int = 2_000_000) -> DataFrame:
    """Store a statistics table; hint a broadcast when its counted size allows one."""
    kept = stored(df)
    return F.broadcast(kept) if kept.count() * max(1, len(kept.columns)) <= cells else kept


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not in the one column of ``ids``; a null id matches a null id.

    The ids are broadcast while counted small, so no text is shuffled; beyond, it is a shuffle join.
    """
    name = fresh(docs, ["gone"], "_")["gone"]
    gone = counted_broadcast(ids.toDF(name).distinct())
    return docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(name)), "left_anti")


def fresh(df: DataFrame, names: Sequence[str], prefix: str) -> dict[str, str]:
    """Column names that do not clash with any of ``df``, case-insensitively."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        new = f"{prefix}{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out[name] = new
    return out
