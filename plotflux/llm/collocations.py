"""Phrase collocations by set-oriented relational mining: occurrence relations extended length by length."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotflux.llm.shared import bit_map, discard, in_bit_map, mix, slices, stored, word_hashes
from plotflux.session import hot_key_join

#: Ends of pieces; no word holds one, so a full stop can stand for all of them.
ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]+")
NO_LANG = "und"
#: Different hashes of phrases that a task remembers, and hashes that it holds before it hands on their counts.
HELD, HASHES_HELD = 1_000_000, 2_000_000
#: Hashes that different phrases may share at most.
MOST_SHARED = 10_000
#: Bits of a filter per frequent phrase, and of a filter at most (16 MB).
BITS_EACH, MOST_BITS = 16, 27

_RELATION = "lang string, words string, at array<int>, size long"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Occurrences:
    """The rows of an occurrence relation of one Arrow batch, as arrays over all their words.

    ``words`` of a row are joined by single spaces, a full stop between pieces; ``at`` are the sorted places
    in them at which the row's phrases of ``k`` words start. Rows are laid end to end with a full stop between,
    so places that differ by one belong to neighbours in one piece.
    """

    def __init__(self, batch: pa.RecordBatch, k: int):
        self.langs = batch.column(0).to_pylist()
        texts = [t or b"." for t in batch.column(1).cast(pa.binary()).to_pylist()]
        self.data = b" . ".join(texts)
        sizes = np.array([t.count(b" ") + 1 for t in texts], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(sizes) else np.zeros(0, np.int64)
        self.ends = self.begins + sizes
        self.k = k
        self.raw = np.frombuffer(self.data, np.uint8)
        self.starts = np.concatenate(([0], np.flatnonzero(self.raw == 32) + 1)) if len(self.raw) else np.zeros(0, np.int64)
        if k < 2:
            self.at = np.flatnonzero(self.raw[self.starts] != 46)
            self.owner = np.searchsorted(self.ends, self.at, side="right")
            return
        listed = batch.column(2)
        lengths = np.diff(listed.offsets.to_numpy()) if len(texts) else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(texts)), lengths)
        self.at = listed.flatten().to_numpy().astype(np.int64) + self.begins[self.owner]

    def extended(self) -> tuple[np.ndarray, np.ndarray]:
        """Merge join of the relation with itself: places, with their rows, whose next place in the piece holds a phrase too."""
        if self.k == 0:
            return self.at, self.owner
        next_to = np.flatnonzero(np.diff(self.at) == 1)
        return self.at[next_to], self.owner[next_to]

    def hashes(self, at: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the phrases of ``k`` words at places, apart per language."""
        words = word_hashes(self.data, folded=False)
        seeds = np.array([zlib.crc32(lang.encode()) for lang in self.langs], np.uint64)
        h = mix(seeds + np.uint64(k))[owner]
        for j in range(k):
            h = (h ^ words[at + j]) * _GOLD
            h ^= h >> np.uint64(29)
        return mix(h)

    def narrowed(self, at: np.ndarray, owner: np.ndarray, k: int) -> tuple[list[bytes], list[np.ndarray]]:
        """Words and places of each row with nothing left but the phrases at ``at``; gaps become a full stop."""
        n = len(self.starts)
        edge = np.bincount(at, minlength=n + 1) - np.bincount(at + k, minlength=n + 1)
        held = np.cumsum(edge[:n]) > 0
        gap = ~held & np.concatenate(([False], held[:-1]))
        kept = held | gap
        number = np.concatenate(([0], np.cumsum(kept)))
        # Bytes that stay: of held words all with the space behind them, of gaps one and the space.
        size = np.diff(np.concatenate((self.starts, [len(self.raw) + 1])))
        raw = np.append(self.raw, 32).astype(np.uint8)
        raw[self.starts[gap]] = 46
        stays = np.repeat(held, size)
        stays[self.starts[gap]] = True
        stays[(self.starts + size - 1)[gap]] = True
        short = raw[stays].tobytes()
        length = np.concatenate(([0], np.cumsum(np.where(held, size, np.where(gap, 2, 0)))))
        texts = [short[a:b].rstrip(b" ") for a, b in zip(length[self.begins].tolist(), length[np.minimum(self.ends, n)].tolist())]
        split = np.searchsorted(owner, np.arange(len(self.langs) + 1))
        first = number[self.begins]
        places = [number[at[a:b]] - f for a, b, f in zip(split[:-1], split[1:], first)]
        return texts, places

    def phrases(self, at: np.ndarray, k: int) -> list[bytes]:
        """The phrases of ``k`` words at places."""
        ends = np.concatenate((self.starts[1:] - 1, [len(self.raw)]))
        return [self.data[a:b] for a, b in zip(self.starts[at].tolist(), ends[at + k - 1].tolist())]


def _relation(langs: list, texts: list[bytes], places: list[np.ndarray], sizes) -> pa.RecordBatch:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in places]))).astype(np.int32)
    flat = np.concatenate(places) if places else np.zeros(0)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(langs, pa.string()),
            pa.array(texts, pa.binary()).cast(pa.string()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32))),
            pa.array(sizes, pa.int64()),
        ],
        names=["lang", "words", "at", "size"],
    )


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (language, text) as the occurrence relation before any length, where every word is a place."""
    for batch in slices(batches):
        texts = [b" ".join(ENDS.sub(b" . ", t.lower()).split()) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        places = []
        for text in texts:
            raw = np.frombuffer(text, np.uint8)
            starts = np.concatenate(([0], np.flatnonzero(raw == 32) + 1)) if len(raw) else np.zeros(0, np.int64)
            places.append(np.flatnonzero(raw[starts] != 46))
        yield _relation(batch.column(0).to_pylist(), texts, places, [len(p) for p in places])


def _rows_of(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Parts of a stored relation of phrases one word shorter than ``k``; for single words, of the documents."""
    return _first(batches) if k == 1 else slices(batches)


def _hash_counts(relation: DataFrame, k: int) -> DataFrame:
    """Group-count by hash: how often each hash of a phrase of ``k`` words occurs, ``h`` and ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit() -> Iterator[pa.RecordBatch]:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for at in range(0, len(h), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[part].astype(np.int64)), pa.array(n[part].astype(np.int64))], names=["h", "n"])

        for batch in _rows_of(batches, k):
            rows = Occurrences(batch, k - 1)
            at, owner = rows.extended()
            if len(at):
                held.append(rows.hashes(at, owner, k))
                if sum(map(len, held)) >= HASHES_HELD:
                    yield from emit()
        if held:
            yield from emit()

    return relation.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _extend(relation: DataFrame, k: int, frequent: DataFrame) -> DataFrame:
    """The relation of phrases of ``k`` words: merge-joined from shorter ones, semi-joined with the frequent groups.

    Groups are known by hash, of which no frequent one can be missing; the filter of
    their hashes may let rarer phrases pass, and never loses one.
    """
    bits = int(min(max(np.ceil(np.log2(max(frequent.count(), 1) * BITS_EACH)), 10), MOST_BITS))
    shared = relation.sparkSession.sparkContext.broadcast(bit_map(frequent, "h", bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows_of(batches, k):
            rows = Occurrences(batch, k - 1)
            at, owner = rows.extended()
            if len(at):
                good = in_bit_map(shared.value, bits, rows.hashes(at, owner, k))
                at, owner = at[good], owner[good]
            texts, places = rows.narrowed(at, owner, k)
            # The places of single words are all words; longer phrases need theirs.
            yield _relation(rows.langs, texts, places if k > 1 else [np.zeros(0)] * len(texts), batch.column(3))

    return relation.mapInArrow(run, _RELATION)


def _named(relation: DataFrame, k: int) -> DataFrame:
    """The phrases of a relation with their hashes: ``h``, ``lang``, ``phrase``, each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for batch in slices(batches):
            rows = Occurrences(batch, k)
            if not len(rows.at):
                continue
            h, first = np.unique(rows.hashes(rows.at, rows.owner, k), return_index=True)
            if len(seen):
                fresh = seen[np.minimum(np.searchsorted(seen, h), len(seen) - 1)] != h
                h, first = h[fresh], first[fresh]
            if len(h):
                seen = np.union1d(seen, h) if len(seen) < HELD else h
                langs = [rows.langs[o] for o in rows.owner[first].tolist()]
                names = pa.array(rows.phrases(rows.at[first], k), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(langs, pa.string()), names], names=["h", "lang", "phrase"])

    return relation.mapInArrow(run, "h long, lang string, phrase string").distinct()


def _recounted(relation: DataFrame, k: int, hashes: list[int]) -> DataFrame:
    """Counts of the phrases that share one of a few hashes, phrase by phrase."""
    wanted = np.sort(np.array(hashes, np.int64).astype(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = Occurrences(batch, k)
            at = rows.at[np.isin(rows.hashes(rows.at, rows.owner, k), wanted)] if len(rows.at) else rows.at
            owner = np.searchsorted(rows.ends, at, side="right").tolist()
            counts = Counter(zip([rows.langs[o] for o in owner], rows.phrases(at, k)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang for lang, _ in counts], pa.string()),
                    pa.array([phrase for _, phrase in counts], pa.binary()).cast(pa.string()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                names=["lang", "phrase", "n"],
            )

    return relation.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _frequent_phrases(relation: DataFrame, k: int, frequent: DataFrame, least: int) -> DataFrame:
    """``lang``, ``phrase``, ``n`` of the frequent phrases of ``k`` words, exactly.

    The count of a phrase is that of its hash. Two phrases that share a hash, which hardly ever occurs, show as two
    names for it and are counted again by themselves.
    """
    names = stored(_named(relation, k).join(frequent, "h"))
    shared = names.groupBy("h").agg(F.count("*").alias("names")).where("names > 1").select("h").limit(MOST_SHARED + 1).collect()
    if len(shared) > MOST_SHARED:
        raise RuntimeError("too many phrases share a hash")
    if not shared:
        return names.select("lang", "phrase", "n")
    twice = [r["h"] for r in shared]
    again = stored(_recounted(relation, k, twice).where(F.col("n") >= least))
    return names.where(~F.col("h").isin(twice)).select("lang", "phrase", "n").unionByName(again)


def _wide(column: Column | str) -> Column:
    return F.col(column).cast("decimal(38,0)") if isinstance(column, str) else column.cast("decimal(38,0)")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = 4,
    least: int = 30,
    top: int = 2000,
    covered: int = 80,
) -> DataFrame:
    """Phrases that occur together: ``lang, rank, phrase, a, l, r, n, score``, the best ``top`` of each language.

    Words are counted per language (null: ``und``) within pieces of the lower-cased texts. A candidate is a
    phrase of 2 to ``longest`` words with ``a >= least`` occurrences. Its score is that of its weakest cut,
    ``floor(2000000 a / (l + r))`` with the counts ``l`` and ``r`` of both parts (ties: the shorter first part).
    Candidates inside a longer candidate with at least ``covered`` percent of their count are dropped. ``n`` is
    the number of all words of the language. Ranks go by score and ``a``, descending, then the phrase's bytes.

    Set-oriented mining: the occurrence relation of every length is stored, in the order of pieces and places. For
    the next length it is merge-joined with itself by piece and adjacent place, since both phrases of ``k``
    words inside one of ``k + 1`` must be frequent; the joined phrases are grouped and counted by hash, and those in groups of
    at least ``least`` stay (semi-join). All phrases of a frequent phrase are frequent, so nothing is lost, and all counts
    are exact: phrases that share a hash are counted again. Relations hold one row per document and are read where they lie: only
    counts are shuffled, combined before. Frequent groups go to tasks as a bit map of bounded size, which
    prunes less beyond some ten million groups and changes no result.

    Null, empty and blank texts hold no words, repeated rows count each, ties are broken as stated, other columns
    are ignored, whatever their names. Empty table: no rows. Very long texts are read whole.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    relation, sizes, frequent, last = rows.where("text is not null"), None, [], None
    for k in range(1, longest + 1):
        groups = stored(_hash_counts(relation, k).where(F.col("n") >= least))
        held = stored(_extend(relation, k, groups))
        if k == 1:
            sizes = stored(held.groupBy("lang").agg(F.sum("size").alias("size")))
        else:
            discard(last)
        relation, last = held.where("words <> ''"), held
        frequent.append(_frequent_phrases(relation, k, groups, least).withColumn("k", F.lit(k)))

    known = frequent[0]
    for one in frequent[1:]:
        known = known.unionByName(one)
    known = stored(known)
    candidates = known.where("k > 1")
    scored = _weakest_cuts(candidates, known, longest)
    final = _not_covered(scored, longest, covered)
    best = final.withColumn("rank", _rank()).where(F.col("rank") <= top)
    return best.join(sizes.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("size").alias("n"), "score"
    )


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))


def _weakest_cuts(candidates: DataFrame, known: DataFrame, longest: int) -> DataFrame:
    """Candidates with ``a``, and ``l``, ``r`` and ``score`` of their lowest-scoring cut."""
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), "k", cut).select(
        "lang",
        "phrase",
        "a",
        "k",
        "cut",
        F.concat_ws(" ", F.slice(words, F.lit(1), F.col("cut"))).alias("first"),
        F.concat_ws(" ", F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("rest"),
    )
    parts = known.where(F.col("k") < longest)
    firsts = parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rests = parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    both = hot_key_join(stored(hot_key_join(cuts, firsts, ["lang", "first"])), rests, ["lang", "rest"])
    score = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    least = F.min(F.struct(score.alias("score"), "cut", "l", "r", "a", "k"))
    return both.groupBy("lang", "phrase").agg(least.alias("w")).select("lang", "phrase", "w.a", "w.k", "w.l", "w.r", "w.score")


def _not_covered(scored: DataFrame, longest: int, covered: int) -> DataFrame:
    """Without the phrases inside a longer one with ``covered`` percent of their count."""
    words = F.split("phrase", " ")
    longer = scored.where("k > 2").select("lang", "phrase", "a", "k")
    inner = (
        longer.select("lang", "a", "k", words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
        .select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
        .select(F.col("lang").alias("_lang"), F.concat_ws(" ", F.slice("w", F.col("at"), F.col("size"))).alias("_phrase"), "a")
        .groupBy("_lang", "_phrase")
        .agg(F.max("a").alias("_most"))
    )
    hidden = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase"))
    hidden = hidden & (_wide("_most") * 100 >= _wide("a") * covered)
    return scored.join(inner, hidden, "left_anti")
