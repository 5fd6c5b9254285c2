"""Periodic runs of words: squares caught online from dyadic blocks, merged into maximal runs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotflux.llm.shared import slices

#: Prefix fingerprints are polynomials modulo this prime; equal ones are compared word by word.
PRIME = (1 << 61) - 1
BASE = 0x1F3D5B79A2C4E681 % PRIME


class SquareCatcher:
    """Finds every maximal run of a growing sequence of words.

    A run with smallest period ``p`` is a longest stretch, of at least ``2 p`` words, in which words
    ``p`` apart are the same. Its first ``p`` words hold a whole aligned block of ``L`` words, ``L``
    a power of two and ``2 L - 1 <= p <= 4 L - 2``, and the same block follows ``p`` words later.

    So whenever a block of a power of two words is complete, it gets a catcher that lives until
    ``4 L - 2`` words later. An appended word meets the living catchers whose block ends in that word
    and compares the block with the sequence's suffix. Equal ones open a comparison at distance ``p``,
    which reaches back to its first equal words and is carried on by each further word until one
    differs. When it covers ``2 p`` words it is a square; further words and squares at the same
    distance only lengthen it, and where it ends it is reported as a run. Distances that are multiples
    of an open square's period, within that square, say nothing new and are not opened.

    At most three catchers of each size live at a time, and blocks are compared by fingerprints
    first, so a sequence of ``n`` words takes about ``n log n`` steps whatever its form.
    """

    def __init__(self) -> None:
        self.ids: dict = {}
        self.words: list[int] = []
        self.sums, self.powers = [0], [1]
        self.catchers: dict[int, list[tuple[int, int, int]]] = {}
        self.open: dict[int, int] = {}
        self.runs: list[tuple[int, int, int]] = []

    def append(self, words: Iterable) -> None:
        """Append words, one at a time."""
        ids, text, sums, powers, catchers, opened = self.ids, self.words, self.sums, self.powers, self.catchers, self.open
        n, total, power = len(text), self.sums[-1], self.powers[-1]
        for word in words:
            w = ids.setdefault(word, len(ids) + 1)
            text.append(w)
            total = (total * BASE + w) % PRIME
            sums.append(total)
            if opened:
                for p in [p for p in opened if text[n - p] != w]:
                    self._close(p, n)
            # Blocks of one word, at distances one and two.
            if n and text[n - 1] == w and 1 not in opened:
                opened[1] = n - 1
            if n > 1 and text[n - 2] == w and 2 not in opened and 1 not in opened:
                self._open(2, n - 2)
            living = catchers.get(w)
            if living:
                late = False
                for block in living:
                    end, size, mark = block
                    p = n - end
                    if p < 2 * size - 1:
                        continue
                    if p > 4 * size - 2:
                        late = True
                    elif text[n - 1] == text[end - 1] and p not in opened:
                        first = end - size + 1
                        if not self._within_square(p, first, n):
                            here = (total - sums[n + 1 - size] * powers[size]) % PRIME
                            if here == mark and text[n + 1 - size : n + 1] == text[first : end + 1]:
                                self._open(p, first)
                if late:
                    catchers[w] = [b for b in living if n - b[0] <= 4 * b[1] - 2]
            n += 1
            power = power * BASE % PRIME
            powers.append(power)
            if not n & 1:
                size = 2
                while not n % size and size <= n:
                    mark = (total - sums[n - size] * powers[size]) % PRIME
                    catchers.setdefault(w, []).append((n - 1, size, mark))
                    size *= 2

    def _within_square(self, p: int, first: int, n: int) -> bool:
        return any(p % q == 0 and start <= first and n + 1 - start >= 2 * q for q, start in self.open.items() if q < p)

    def _open(self, p: int, first: int) -> None:
        """Open the comparison at distance ``p`` of which the words from ``first`` on are known to agree."""
        text = self.words
        while first and text[first - 1] == text[first - 1 + p]:
            first -= 1
        self.open[p] = first

    def _close(self, p: int, end: int) -> None:
        start = self.open.pop(p)
        if end - start >= 2 * p:
            self.runs.append((start, end - start, p))

    def finish(self) -> list[tuple[int, int, int]]:
        """All runs (start, length, period) so far, by start, then period; open ones end here."""
        for p in list(self.open):
            self._close(p, len(self.words))
        return sorted(self.runs, key=lambda r: (r[0], r[2]))


def find_runs(words: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """Maximal runs (start, length, smallest period) of at least ``least`` words and ``times`` periods."""
    catcher = SquareCatcher()
    catcher.append(words)
    return [r for r in catcher.finish() if r[1] >= max(least, times * r[2])]


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds behind its first period."""
    out, at = [], 0
    for start, end in sorted((s + p, s + n) for s, n, p in runs):
        if start > at:
            out.extend(words[at:start])
        at = max(at, end)
    return out + words[at:]


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """Periodic runs of the words of every whole text: ``id_col``, ``runs``, ``collapsed``.

    Words are longest stretches without ASCII white space, numbered from 0. ``runs`` is an array of structs
    ``start``, ``length``, ``period`` (words; ``period`` the smallest one) by start, then period, of all maximal
    runs with at least ``least`` words and ``times`` periods. ``collapsed`` is the text with the words behind
    the first period of each run left out, joined by single spaces.

    One row per row: null ids, repeated ids and repeated rows stay rows of their own. Null, empty and blank
    texts have no runs and collapse to the empty text. Very long texts are read whole, in n log n steps.
    Other columns are ignored, whatever their names. Empty table: no rows. Nothing is shuffled.
    """
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, texts = [], []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                words = (data or b"").split()
                runs = find_runs(words, least, times)
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                texts.append(b" ".join(collapse(words, runs)).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, kind), pa.array(texts, pa.string())], names=["id", "runs", "collapsed"]
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {id_type}, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
