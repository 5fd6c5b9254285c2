"""SentencePiece, periodic runs and collocations against the library, brute force and definitions."""

import math
import random
import re
from collections import Counter

import pytest
from cases import corpus, frame, sentence

from plotflux.llm import collocations, pieces, repeats

tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(MODEL)


def library_ids(encoder, texts):
    return [ids.astype("<i4").tobytes() for ids in encoder.library.encode_as_numpy(texts, num_threads=1)]


def test_encoding_equals_the_library(encoder):
    rng = random.Random(4)
    alphabet = "ab  ▁\n\té日本ﬁ\x00x\U0001f600.1<s>theing"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["", " ", "  ", "a ", " a", "▁", "</s>", "<0x0A>", "x" * 50_000, " " * 5000, "ab" * 300, "\n" * 300]
    ids, agrees = encoder.encode(texts)
    assert ids == library_ids(encoder, texts) and all(agrees)


def test_heap_and_side_by_side_agree(encoder):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeit nrs▁") for _ in range(12)) for _ in range(3000)]
    assert encoder.merge_side_by_side(words) == [encoder.merge(w) for w in words]


def test_a_difference_is_told(encoder):
    other = pieces.PieceEncoder(MODEL)
    other.pair_ranks = other.pair_ranks[::-1].copy()
    _, agrees = other.encode(["plain words in a row", "", "and more of them"])
    assert agrees[1] and not agrees[0]


def test_memory_starts_afresh(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 50)
    small = pieces.PieceEncoder(MODEL)
    rng = random.Random(6)
    texts = [sentence(rng, 60) for _ in range(30)]
    for text in texts:
        ids, agrees = small.encode([text, text])
        assert ids == library_ids(small, [text, text]) and agrees == [True, True] and len(small._known) <= 130


def test_piece_tables(spark, encoder):
    rows = corpus()
    got = pieces.encode_pieces(frame(spark, rows), MODEL).collect()
    assert len(got) == len(rows) and all(r["agrees"] for r in got)
    texts = [t or "" for _, t in rows]
    want = sorted(((i is None, i or 0), tuple(ids), d) for (i, _), ids, d in zip(rows, encoder.library.encode(texts), encoder.library.decode(encoder.library.encode(texts))))
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), tuple(r["ids"]), r["decoded"]) for r in got) == want
    assert pieces.encode_pieces(frame(spark, []), MODEL).collect() == []
    back = pieces.decode_pieces(pieces.encode_pieces(frame(spark, rows), MODEL), MODEL).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in back) == sorted((i is None, i or 0, t or "") for i, t in rows)


def runs_by_definition(words):
    """Every stretch with period p that cannot grow, of at least 2 p words; of equal stretches the smallest period."""
    found = []
    for p in range(1, len(words) // 2 + 1):
        at = 0
        while at + p < len(words):
            start = at
            while at + p < len(words) and words[at] == words[at + p]:
                at += 1
            if at - start >= p:
                found.append((start, at + p - start, p))
            at += 1
    return sorted(
        (r for r in found if not any(q < r[2] and s <= r[0] and s + n >= r[0] + r[1] for s, n, q in found)),
        key=lambda r: (r[0], r[2]),
    )


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_by_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(1500):
        n = rng.randrange(80)
        words = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            start, p = rng.randrange(n), rng.randrange(1, max(2, n // 2))
            for i in range(start, n):
                words[i] = words[start + (i - start) % p]
        catcher = repeats.SquareCatcher()
        half = rng.randrange(n + 1)
        catcher.append(words[:half])
        catcher.append(words[half:])
        assert catcher.finish() == runs_by_definition(words)


def test_runs_of_long_and_hard_sequences():
    assert repeats.find_runs(["x"] * 100_000) == [(0, 100_000, 1)]
    assert repeats.find_runs(list("aaaab") * 20_000) == [(0, 100_000, 5)]
    a, b = "a", "ab"
    while len(b) < 50_000:
        a, b = b, b + a
    assert len(repeats.find_runs(list(b))) > 1000  # a Fibonacci word, full of squares
    assert repeats.find_runs(list(b[:400])) == [r for r in runs_by_definition(b[:400]) if r[1] >= max(24, 3 * r[2])]


def test_run_tables(spark):
    rng = random.Random(9)
    lead, loop = sentence(rng, 30).split(), sentence(rng, 10).split()
    rows = [*corpus(), (500, " ".join(lead + loop * 3 + ["end"])), (501, " ".join(loop * 3 + loop[:9])), (502, "w " * 30), (502, "w\t" * 30)]
    got = repeats.word_runs(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    for i, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        if len(words) > 500:
            continue
        runs = [r for r in runs_by_definition(words) if r[1] >= max(24, 3 * r[2])]
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        want = ([tuple(r) for r in runs], " ".join(w for k, w in enumerate(words) if k not in gone))
        assert want in [([tuple(x) for x in r["runs"]], r["collapsed"]) for r in by_id[i]]
    assert tuple(by_id[500][0]["runs"][0]) == (30, 30, 10)
    assert repeats.word_runs(frame(spark, [])).collect() == []


def phrases_by_definition(rows, least, top):
    words, counts = Counter(), Counter()
    for _, text, _, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            listed = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(listed)
            for k in range(1, 5):
                for at in range(len(listed) - k + 1):
                    counts[lang, tuple(listed[at : at + k])] += 1
    out = []
    chosen = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    for (lang, phrase), a in chosen.items():
        cuts = [(2_000_000 * a // (counts[lang, phrase[:k]] + counts[lang, phrase[k:]]), k) for k in range(1, len(phrase))]
        score, k = min(cuts)
        longer = [
            b for (other, long), b in chosen.items()
            if other == lang and len(long) > len(phrase) and any(long[i : i + len(phrase)] == phrase for i in range(len(long)))
        ]
        if not any(100 * b >= 80 * a for b in longer):
            text = " ".join(phrase)
            out.append((lang, -score, -a, text.encode(), text, a, counts[lang, phrase[:k]], counts[lang, phrase[k:]], score))
    ranked, seen = [], Counter()
    for lang, _, _, _, text, a, left, right, score in sorted(out, key=lambda r: r[:4]):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], text, a, left, right, words[lang], score))
    return sorted(ranked)


@pytest.mark.parametrize("held", [400_000, 40])
def test_collocations_by_definition(spark, monkeypatch, held):
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "HASHES_HELD", held * 3)
    rng = random.Random(2)
    pool = "red green blue dark light sky sea Éte und of THE".split()
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(12)):
            parts.append(rng.choice(["new york city hall", "New  York\tcity", "of the", "in the end of"]) if rng.random() < 0.5 else " ".join(rng.choice(pool) for _ in range(4)))
            parts.append(rng.choice([" ", " ", ". ", "!", "\n", "\x0b", ",;"]))
        rows.append((i, "".join(parts), "s", rng.choice(["en", "en", "en", "de", None, "und"])))
    rows += [(900, None, "s", "en"), (901, "", "s", None), (902, " \t\n. ", "s", "fr"), (903, "solo", "s", "fr"), rows[0], (None, rows[1][1], None, "en")]
    got = collocations.collocations(frame(spark, rows), least=8, top=25)
    assert sorted(tuple(r) for r in got.collect()) == phrases_by_definition(rows, 8, 25)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(1, None), (2, "a b"), (2, "a b")])).collect() == []


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """A bit map too small for its groups lets too much pass and loses nothing."""
    rng = random.Random(3)
    rows = [(i, sentence(rng, 80), "s", "en") for i in range(60)]
    want = collocations.collocations(frame(spark, rows), least=3, top=50).collect()
    monkeypatch.setattr(collocations, "MOST_BITS", 6)
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows), least=3, top=50).collect())) == sorted(map(tuple, want)) and math.isfinite(len(want))
