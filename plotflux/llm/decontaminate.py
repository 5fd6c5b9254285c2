"""Benchmark decontamination: random-walk embedding of word windows, bit-sampling, exact edit check."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotflux.llm.shared import bit_map, counted_broadcast, fresh, in_bit_map, mix, slices, small_batches, stored, word_hashes

_PROBES = 3
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Shape(NamedTuple):
    """Windows of ``width`` words every ``stride`` words, ``walks`` times ``tables`` keys of ``samples`` places each."""

    width: int
    stride: int
    walks: int
    tables: int
    samples: int


class Plan:
    """Window, walk and sampling sizes.

    An item of which no word may be edited is met by exact windows of the band of its size, ``low`` to ``2 * low - 1``
    words: windows of ``width`` words every ``stride`` words of a document, such that any copy holds a whole one.
    Longer items share short windows, ``width`` words every ``stride`` words of a document and from every
    word of the item; those of fewer than ``LONG`` words shorter ones with fewer samples. A window's walk soon falls
    out of step behind an edit, so long windows would be lost; of short ones an item has the more the longer it is, each
    with ``walks * tables`` keys, and one agreeing key is enough. Every key samples the walk's whole way, ``samples``
    places in as many equal parts of it.

    With windows of five words at every word (``Shape(5, 1, 3, 4, 4)`` for both) no copy within a tenth of its words can be
    lost, since five words in a row of it are untouched; that is the exact plan, which costs more.
    """

    #: Bands of the windows shared by items with edits, and the words from which an item is in the second one.
    SHORT_EDITED, EDITED, LONG = 98, 99, 15

    def __init__(self, max_rate: float = 0.1, short: Shape = Shape(6, 2, 3, 4, 4), long: Shape = Shape(8, 3, 3, 4, 6)):
        self.max_rate = max_rate
        self.shapes = {self.SHORT_EDITED: short, self.EDITED: long}

    def band(self, n: int) -> int:
        if not self.edits(n):
            return n.bit_length() - 1
        return self.EDITED if n >= self.LONG else self.SHORT_EDITED

    def window(self, band: int) -> tuple[int, int]:
        """Width and stride of a band's windows; of exact ones together one more than the smallest item has words."""
        if band in self.shapes:
            return self.shapes[band].width, self.shapes[band].stride
        low = 1 << band
        stride = max(1, low // 3)
        return low - stride + 1, stride

    def edits(self, n: int) -> int:
        """Edits that a copy of an item of ``n`` words may have."""
        return int(self.max_rate * n)

    def walks(self, band: int) -> int:
        return self.shapes[band].walks if band in self.shapes else 1

    def places(self, band: int, walk: int) -> list[list[int]]:
        """The sampled places of the embedding, per table; of exact windows all of them."""
        width, _ = self.window(band)
        if band not in self.shapes:
            return [list(range(2 * width))]
        shape, reach = self.shapes[band], 2 * width - 1
        seed = np.random.Generator(np.random.PCG64([band, walk, 77]))
        ends = [q * reach // shape.samples for q in range(shape.samples + 1)]
        return [[int(seed.integers(low, high)) for low, high in zip(ends, ends[1:])] for _ in range(shape.tables)]


def walk_keys(words: np.ndarray, starts: np.ndarray, band: int, plan: Plan) -> Iterator[np.ndarray]:
    """Keys of windows: the random walk's outputs at the sampled places, hashed, per table and walk.

    The walk outputs the word it stands on and moves on or stays, by a random bit drawn for the
    step and the word. Windows that differ by few edits fall back into step, so most outputs agree.
    All windows walk at once; past the window's end the walk outputs a blank.
    """
    width, _ = plan.window(band)
    padded = np.concatenate((words, np.zeros(1, np.uint64)))
    for walk in range(plan.walks(band)):
        tables = plan.places(band, walk)
        wanted: dict[int, list[int]] = {}
        for t, places in enumerate(tables):
            for place in places:
                wanted.setdefault(place, []).append(t)
        keys = [np.full(len(starts), mix(np.array([band * 1000 + walk * 100 + t], np.uint64))[0], np.uint64) for t in range(len(tables))]
        at = np.zeros(len(starts), np.int64)
        for step in range(max(wanted, default=-1) + 1):
            inside = at < width
            symbol = padded[np.where(inside, starts + at, len(words))]
            for t in wanted.get(step, ()):
                keys[t] = (keys[t] ^ symbol) * _GOLD
                keys[t] ^= keys[t] >> np.uint64(29)
            salt = mix(np.array([walk * 1_000_003 + step + 1], np.uint64))[0]
            at += (((symbol ^ salt) * _GOLD) >> np.uint64(63)).astype(np.int64)
        yield from keys


def probe(keys: np.ndarray, k: int) -> np.ndarray:
    """The k-th of the hashes under which a key is marked in the bit map."""
    return keys if k == 0 else mix(keys + np.uint64(k))


def item_keys(items: DataFrame, plan: Plan) -> DataFrame:
    """Keys of the windows from every word of every item.

    ``key``, ``item``, ``start`` (word of the item), ``words``, ``band``, ``probes``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for item, text in zip(batch.column(0), batch.column(1)):
                words = word_hashes((text.as_py() or "").encode())
                if not len(words):
                    continue
                band = plan.band(len(words))
                width, _ = plan.window(band)
                starts = np.arange(len(words) - width + 1)
                for keys in walk_keys(words, starts, band, plan):
                    probes = [list(p) for p in zip(*(probe(keys, k).astype(np.int64).tolist() for k in range(_PROBES)))]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys.astype(np.int64)),
                            pa.array([item.as_py()] * len(keys), batch.schema.field(0).type),
                            pa.array(starts, pa.int64()),
                            pa.array([len(words)] * len(keys), pa.int64()),
                            pa.array([band] * len(keys), pa.int64()),
                            pa.array(probes, pa.list_(pa.int64())),
                        ],
                        names=["key", "item", "start", "words", "band", "probes"],
                    )

    kind = items.schema["item"].dataType.simpleString()
    return items.mapInArrow(run, f"key long, item {kind}, start long, words long, band long, probes array<long>")


def may_hold_copy(item: list[int], region: list[int], edits: int) -> bool:
    """Whether enough of the item's words and pairs of neighbours occur in ``region``: an edit spoils one word and two pairs.

    Every part within the distance passes; most chance hits on common phrases do not.
    """
    words = set(region)
    if sum(w in words for w in item) < len(item) - edits:
        return False
    pairs = set(zip(region, region[1:]))
    return sum(pair in pairs for pair in zip(item, item[1:])) >= len(item) - 1 - 2 * edits


def edit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Smallest edit distance of ``item`` to any part of ``region``, with that part's start and end.

    Whole rows of the table at once: insertions along a row are a running minimum.
    """
    n = len(region)
    offsets = np.arange(n + 1)
    row, origin = np.zeros(n + 1, np.int64), offsets.copy()
    for k, word in enumerate(item):
        best = row + 1
        start = origin.copy()
        diagonal = row[:-1] + (region != word)
        better = diagonal <= best[1:]
        best[1:] = np.where(better, diagonal, best[1:])
        start[1:] = np.where(better, origin[:-1], start[1:])
        # best[j] = min over i <= j of best[i] + (j - i)
        lifted = best - offsets
        running = np.minimum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == running, offsets, 0))
        row, origin = running + offsets, start[source]
    end = int(np.argmin(row))
    return int(row[end]), int(origin[end]), end


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    plan: Plan | None = None,
) -> DataFrame:
    """Items that occur in documents within an edit distance of a tenth of their words.

    Returns ``id_col``, ``item``, ``distance`` (words inserted, deleted or replaced; A-Z lower-cased),
    ``start``, ``end`` (words of the document, end exclusive): one row per document and item, the best place.

    Short windows of the documents and the items are embedded by the random walk (edit distance becomes
    Hamming distance) and hashed at sampled places; a copy with a tenth of its words edited agrees with its item in some
    window's key with a probability of at least 0.97 at 10 words, growing with the size (measured by test for 10 to
    1,000 words). Keys that no item has are dropped where they arise, by a bit map of the items'
    keys whose size is fixed; the rest (ids and places, no text) meet the items by a shuffle join on the key.
    Documents with a hit are read again and every hit is checked by the exact distance between the item
    and the text around it. The whole text of every document is walked.

    Null, empty and blank texts hold nothing, and such items match nothing; items of up to nine words
    must match exactly. Repeated rows of one id are one document for the result; a null id is
    reported like any other. Other columns are ignored. Empty tables: no rows.
    """
    plan = plan or Plan()
    wanted = items.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    wanted = stored(wanted)
    keys = stored(item_keys(wanted, plan).distinct())
    n = keys.count()
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = wanted.schema["item"].dataType.simpleString()
    result = f"{id_col} {kind}, item {item_kind}, distance long, start long, end long"
    if not n:
        return docs.sparkSession.createDataFrame([], result)
    bits = min(27, max(12, math.ceil(math.log2(256 * n))))
    filled = bit_map(keys.select(F.explode("probes").alias("h")), "h", bits)
    bands = sorted(r["band"] for r in keys.select("band").distinct().collect())  # one per size band

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column(0).to_pylist()
            at = 0
            while at < len(ids):
                # Some hundred thousand words at a time; a longer document goes alone.
                parts, lengths, first = [], [], at
                while at < len(ids) and sum(lengths) < 200_000:
                    text = batch.column(1)[at].as_py()
                    parts.append(word_hashes(text.encode()) if text else np.empty(0, np.uint64))
                    lengths.append(len(parts[-1]))
                    at += 1
                found = _hits(parts, lengths, bands, plan, filled, bits)
                if not len(found):
                    continue
                owner, start, key = found
                begins = np.concatenate(([0], np.cumsum(lengths)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[first + int(d)] for d in owner], batch.schema.field(0).type),
                        pa.array(key.astype(np.int64)),
                        pa.array(start - begins[owner], pa.int64()),
                    ],
                    names=["id", "key", "place"],
                )

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hits = texts.mapInArrow(run, f"id {kind}, key long, place long")
    # One check per document, item and stretch of the item's length in which it starts, however many keys agree on it.
    met = hits.join(keys.select("key", "item", "words", F.col("start").alias("offset")), "key")
    stretch = F.floor((F.col("place") - F.col("offset")) / F.col("words")).cast("long")
    met = stored(met.select("id", "item", "words", (stretch * F.col("words")).alias("line")).distinct())
    # Only documents with a hit are read again, picked by a bit map of their ids, and cut to what is compared.
    owners = met.select("id").distinct()
    id_bits = min(27, max(12, math.ceil(math.log2(64 * owners.count() + 1))))
    named = bit_map(owners.select(F.xxhash64("id").alias("h")), "h", id_bits)

    @F.pandas_udf("boolean")
    def may_hold(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_bit_map(named, id_bits, hashes.to_numpy()))

    lines = met.groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("item", "words", "line")).alias("lines"))
    picked = texts.where(may_hold(F.xxhash64("id"))).join(lines, F.col("id").eqNullSafe(F.col("of")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                words = word_hashes(text.encode()).astype(np.int64) if text else np.empty(0, np.int64)
                listed = batch.column(2)[k].as_py()
                lows = [min(max(0, x["line"] - plan.edits(x["words"])), len(words)) for x in listed]
                ends = [max(0, x["line"] + 2 * x["words"] + plan.edits(x["words"])) for x in listed]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[k].as_py()] * len(listed), batch.schema.field(0).type),
                        pa.array([x["item"] for x in listed], batch.schema.field(2).type.value_type.field("item").type),
                        pa.array(lows, pa.int64()),
                        pa.array([words[low:end] for low, end in zip(lows, ends)], pa.list_(pa.int64())),
                    ],
                    names=["id", "item", "low", "region"],
                )

    regions = picked.select("id", "text", "lines").mapInArrow(cut, f"id {kind}, item {item_kind}, low long, region array<long>")
    whole = wanted.withColumnRenamed("item", "_item")
    checked = regions.join(whole, F.col("item").eqNullSafe(F.col("_item")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, np.ndarray] = {}
        for batch in slices(batches):
            ids, names, lows, regions, texts = (batch.column(k).to_pylist() for k in range(5))
            out: list[tuple] = []
            for k, text in enumerate(texts):
                item = known.get(text)
                if item is None:
                    if len(known) >= 1000:
                        known.clear()
                    item = known[text] = word_hashes((text or "").encode()).astype(np.int64)
                edits = plan.edits(len(item))
                if not may_hold_copy(item.tolist(), regions[k], edits):
                    continue
                distance, start, end = edit_distance(item, np.array(regions[k], np.int64))
                if distance <= edits:
                    out.append((ids[k], names[k], distance, lows[k] + start, lows[k] + end))
            if out:
                kinds = (batch.schema.field("id").type, batch.schema.field("item").type, pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[id_col, "item", "distance", "start", "end"]
                )

    found = checked.select("id", "item", "low", "region", "text").mapInArrow(check, result)
    best = F.min(F.struct("distance", "start", "end")).alias("best")
    return found.groupBy(id_col, "item").agg(best).select(id_col, "item", "best.distance", "best.start", "best.end")


def _hits(parts: list[np.ndarray], lengths: list[int], bands: list[int], plan: Plan, filled: np.ndarray, bits: int):
    """Windows with a key that the bit map holds: document, place in the joined words, key."""
    words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    owners, places, keys = [], [], []

    def marked(key: np.ndarray) -> np.ndarray:
        hit = np.flatnonzero(in_bit_map(filled, bits, key))
        for k in range(1, _PROBES):
            hit = hit[in_bit_map(filled, bits, probe(key[hit], k))]
        return hit

    for band in bands:
        width, stride = plan.window(band)
        counts = np.maximum((np.asarray(lengths) - width) // stride + 1, 0)
        counts[np.asarray(lengths) < width] = 0
        owner = np.repeat(np.arange(len(parts)), counts)
        if not len(owner):
            continue
        order = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = begins[owner] + order * stride
        for key in walk_keys(words, starts, band, plan):
            hit = marked(key)
            owners.append(owner[hit])
            places.append(starts[hit])
            keys.append(key[hit])
    if not owners or not sum(map(len, owners)):
        return ()
    return np.concatenate(owners), np.concatenate(places), np.concatenate(keys)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents in which no item was found, with their own columns.

    Rows with null or repeated ids are told apart by a hash of their text, so each is judged by its own.
    """
    row = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64("text").alias("hash"))
    names = fresh(docs, ["gone", "hash"], "_")
    with small_batches(docs.sparkSession):
        found = stored(find_leaks(docs.select(row.alias("row"), "text"), items, "row"))
    gone = counted_broadcast(found.select(F.col("row.id").alias(names["gone"]), F.col("row.hash").alias(names["hash"])).distinct())
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(names["gone"])) & (F.xxhash64("text") == F.col(names["hash"]))
    return docs.join(gone, same, "left_anti")
