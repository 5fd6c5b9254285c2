"""SentencePiece encoding and decoding for merge-type vocabularies: an agenda of adjacent symbol pairs by score."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotflux.llm.shared import slices

#: The symbol that stands for a space inside pieces.
SPACE = "▁"
#: Remembered words of one Python worker; beyond it those of the batch at hand are kept.
MEMORY = 200_000
#: Longer words are not remembered from batch to batch, so that the memory's size stays bounded.
LONGEST = 200
#: Words up to this length are merged side by side.
SIDE_BY_SIDE = 40
_NONE = np.iinfo(np.int32).max


class PieceEncoder:
    """Encoder of one vocabulary whose merges are ordered by score.

    The vocabulary's pieces, scores, kinds and its normaliser are read from the model file; the
    merging is done here. A text starts as single characters. An agenda holds every adjacent pair
    whose join is a piece, best score first, then leftmost; the best is merged and its two new
    neighbours enter, until the agenda is empty. Symbols that are no piece become their UTF-8 bytes.

    Where no piece has a space symbol behind another character, a merge never reaches across the
    start of a word, so words are merged on their own, once for all texts of a batch, and remembered.
    Every word is compared with what the sentencepiece library makes of it when it is merged.
    """

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        kinds = (self.library.is_control, self.library.is_unknown, self.library.is_byte, self.library.is_unused)
        size = self.library.vocab_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        if any(self.library.is_unused(i) for i in range(size)):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(size) if self.library.is_byte(i)}
        self.ids = {pieces[i]: i for i in range(size) if not any(kind(i) for kind in kinds)}
        self.scores = {piece: self.library.get_score(i) for piece, i in self.ids.items()}
        self.unknown = self.library.unk_id()
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.word = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.prefixed = self.library.normalize("a").startswith(SPACE)
        self._known: dict[str, bytes] = {}
        self._wrong: set[str] = set()
        self._build_pairs()

    def _build_pairs(self) -> None:
        """Numbers of symbols, and for every pair of them that joins to a piece its place in the order of merges."""
        symbols = dict.fromkeys(self.ids) | dict.fromkeys(c for p in self.ids for c in p)
        self.symbols = {s: k for k, s in enumerate(symbols)}
        self.static = len(self.symbols)
        self.encoded = [self._symbol_ids(s) for s in self.symbols]
        # By code point the number of a character, by number the id of a symbol that is just one.
        self.of_point = np.full(0x110000, -1, np.int32)
        for symbol, k in self.symbols.items():
            if len(symbol) == 1:
                self.of_point[ord(symbol)] = k
        self.single = np.zeros(0, np.int64)
        order = {score: k for k, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        found = [
            (self.symbols[left] * self.static + self.symbols[right], order[self.scores[piece]], self.symbols[piece])
            for piece in self.ids
            for at in range(1, len(piece))
            if (left := piece[:at]) in self.symbols and (right := piece[at:]) in self.symbols
        ]
        table = np.array(sorted(found), np.int64).reshape(-1, 3)
        self.pair_codes, self.pair_ranks, self.pair_joins = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].copy()

    def _symbol_ids(self, symbol: str) -> bytes:
        """Ids of a final symbol, as little-endian integers of 32 bits."""
        known = self.ids.get(symbol)
        if known is not None:
            return np.array([known], "<i4").tobytes()
        if self.bytes:
            return np.array([self.bytes[b] for b in symbol.encode()], "<i4").tobytes()
        return np.array([self.unknown], "<i4").tobytes()

    def _number(self, char: str) -> int:
        """The number of a character; one that no piece holds gets a number when it is first seen."""
        k = self.symbols.get(char)
        if k is None:
            k = self.symbols[char] = len(self.encoded)
            self.encoded.append(self._symbol_ids(char))
        return k

    def _joins(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined symbol of pairs; no rank where they join to no piece."""
        code = left * self.static + right
        at = np.minimum(np.searchsorted(self.pair_codes, code), max(len(self.pair_codes) - 1, 0))
        if not len(self.pair_codes):
            return np.full(left.shape, _NONE, np.int32), np.zeros(left.shape, np.int64)
        good = (self.pair_codes[at] == code) & (left < self.static) & (right < self.static)
        return np.where(good, self.pair_ranks[at], _NONE).astype(np.int32), self.pair_joins[at]

    def merge_side_by_side(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length, every word with a row of its own in the agenda.

        A round merges the best pair of every row, drops it from the agenda and enters its two neighbours.
        """
        n = len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        for point in np.unique(points[self.of_point[points] < 0]).tolist():
            self.of_point[point] = self._number(chr(point))
        symbols = self.of_point[points].astype(np.int64).reshape(len(words), n)
        rank, join = self._joins(symbols[:, :-1], symbols[:, 1:])
        out: list[bytes] = [b""] * len(words)
        rows = np.arange(len(words))
        while len(rows):
            n = symbols.shape[1]
            if n > 1:
                place = rank.argmin(1)
                every = np.arange(len(rows))
                merges = rank[every, place] != _NONE
            else:
                merges = np.zeros(len(rows), bool)
            self._put_out(out, rows[~merges], symbols[~merges])
            if not merges.any():
                break
            rows, symbols, rank, join, place = rows[merges], symbols[merges], rank[merges], join[merges], place[merges]
            every = np.arange(len(rows))
            symbols[every, place] = join[every, place]
            stays = np.ones(symbols.shape, bool)
            stays[every, place + 1] = False
            symbols = symbols[stays].reshape(len(rows), n - 1)
            stays = np.ones(rank.shape, bool)
            stays[every, place] = False
            rank, join = rank[stays].reshape(len(rows), n - 2), join[stays].reshape(len(rows), n - 2)
            for side in (place - 1, place):
                has = np.flatnonzero((side >= 0) & (side < n - 2))
                at = side[has]
                rank[has, at], join[has, at] = self._joins(symbols[has, at], symbols[has, at + 1])
        return out

    def _put_out(self, out: list[bytes], rows: np.ndarray, symbols: np.ndarray) -> None:
        """Write the ids of finished rows; most symbols are one id, others become several bytes."""
        while len(self.single) < len(self.encoded):
            more = self.encoded[len(self.single) :]
            self.single = np.concatenate((self.single, [int.from_bytes(e, "little") if len(e) == 4 else -1 for e in more]))
        ids = self.single[symbols]
        plain = (ids >= 0).all(1)
        data, width = ids[plain].astype("<i4").tobytes(), 4 * symbols.shape[1]
        for k, row in enumerate(rows[plain].tolist()):
            out[row] = data[k * width : (k + 1) * width]
        for row, final in zip(rows[~plain].tolist(), symbols[~plain].tolist()):
            out[row] = b"".join([self.encoded[s] for s in final])

    def merge(self, stretch: str) -> bytes:
        """Ids of a stretch of any length, its agenda in a heap."""
        symbols: list[str] = list(stretch)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        scores = self.scores
        agenda: list[tuple[float, int, int]] = []

        def enter(left: int, right: int) -> None:
            joined = symbols[left] + symbols[right]
            score = scores.get(joined)
            if score is not None:
                heapq.heappush(agenda, (-score, left, len(joined)))

        for i in range(n - 1):
            enter(i, i + 1)
        while agenda:
            _, left, size = heapq.heappop(agenda)
            right = after[left]
            # An entry is stale when either symbol has been merged since.
            if not symbols[left] or right >= n or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            nearest = after[left] = after[right]
            if nearest < n:
                before[nearest] = left
                enter(left, nearest)
            if before[left] >= 0:
                enter(before[left], left)
        return b"".join(self._symbol_ids(symbol) for symbol in symbols if symbol)

    def _learn(self, words: set[str]) -> None:
        """Merge words and compare each with the library's ids of it."""
        by_length: dict[int, list[str]] = {}
        for word in words:
            if len(word) <= SIDE_BY_SIDE:
                by_length.setdefault(len(word), []).append(word)
            else:
                self._known[word] = self.merge(word)
        for same in by_length.values():
            self._known.update(zip(same, self.merge_side_by_side(same)))
        self._wrong.update(self._differing([w for w in words if w.strip(SPACE)]))
        # Nothing but spaces is asked for behind a letter.
        letter = self.library.encode("a")
        for word in words:
            if not word.strip(SPACE):
                theirs = self.library.encode("a" + " " * len(word))[len(letter) :]
                if np.array(theirs, "<i4").tobytes() != self._known[word]:
                    self._wrong.add(word)

    def _differing(self, words: list[str]) -> list[str]:
        """Words to which the library gives other ids than the agenda did; all of them are asked for at once."""
        # The normaliser puts one space symbol in front of a text.
        texts = [(w[1:] if self.prefixed and w[0] == SPACE else w).replace(SPACE, " ") for w in words]
        theirs = self.library.encode(texts, num_threads=1)
        mine = [self._known[w] for w in words]
        sizes = np.fromiter(map(len, theirs), np.int64, len(theirs))
        same_size = np.array_equal(sizes * 4, np.fromiter(map(len, mine), np.int64, len(mine)))
        ids = np.fromiter(chain.from_iterable(theirs), "<i4", int(sizes.sum()))
        if same_size and ids.tobytes() == b"".join(mine):
            return []
        return [w for w, a, b in zip(words, mine, theirs) if np.array(b, "<i4").tobytes() != a]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of whole texts, without begin or end ids, as little-endian integers; and whether the library agrees."""
        if not self.by_word:
            ids = [self.merge(self.library.normalize(t)) for t in texts]
            theirs = self.library.encode_as_numpy(texts, num_threads=1)
            return ids, [a == b.astype("<i4").tobytes() for a, b in zip(ids, theirs)]
        split = [self.word.findall(self.library.normalize(t)) for t in texts]
        words = set().union(*split)
        fresh = words.difference(self._known)
        if len(self._known) + len(fresh) > MEMORY:
            # The words of this batch stay; the common ones are among them.
            self._known = {w: self._known[w] for w in words.difference(fresh)}
            self._wrong &= words
        if fresh:
            self._learn(fresh)
        known = self._known
        ids = [b"".join(map(known.__getitem__, one)) for one in split]
        agree = [not self._wrong or self._wrong.isdisjoint(one) for one in split]
        for word in fresh:
            if len(word) > LONGEST:
                known.pop(word)
        return ids, agree


@lru_cache(maxsize=4)
def encoder(model: str) -> PieceEncoder:
    """One encoder for a Python worker and model file."""
    return PieceEncoder(model)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again: ``id_col``, ``ids``, ``decoded``, ``agrees``.

    ``ids`` (array of int) come from the agenda of ``PieceEncoder``; ``decoded`` is the library's
    ``decode(ids)``. In every Arrow batch the words that the worker does not remember are merged, and compared
    with the ids that the sentencepiece library gives them; ``agrees`` tells whether all words of the text
    did. Texts are compared whole where pieces may reach across words.
    The model file must lie at the path ``model`` on every worker.

    One row per row: null ids, repeated ids and repeated rows stay rows of their own. Null and empty texts
    have no ids, decode to the empty text and agree. Very long texts are encoded whole. Other columns are
    ignored, whatever their names. Empty table: no rows. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder(model)
        for batch in slices(batches):
            ids, agrees = mine.encode([t or "" for t in batch.column(1).to_pylist()])
            ends = np.cumsum([0, *[len(one) // 4 for one in ids]], dtype=np.int64)
            values = np.frombuffer(b"".join(ids), "<i4")
            # Array offsets have 32 bits; a slice of longer texts goes in several parts.
            at = 0
            while at < len(ids):
                end = max(at + 1, int(np.searchsorted(ends, ends[at] + 100_000_000, side="right")) - 1)
                part = values[ends[at] : ends[end]]
                listed = [values[ends[k] : ends[k + 1]].tolist() for k in range(at, end)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, end - at),
                        pa.ListArray.from_arrays(pa.array(ends[at : end + 1] - ends[at], pa.int32()), pa.array(part, pa.int32())),
                        pa.array(mine.library.decode(listed, num_threads=1), pa.string()),
                        pa.array(agrees[at:end], pa.bool_()),
                    ],
                    names=["id", "ids", "decoded", "agrees"],
                )
                at = end

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string, agrees boolean").withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of arrays of ids by the library: ``id_col`` and ``text``, one row per row; null and empty arrays give empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder(model)
        for batch in slices(batches):
            texts = mine.library.decode([ids or [] for ids in batch.column(1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
