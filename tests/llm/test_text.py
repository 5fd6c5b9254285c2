"""Word hashes, the Jaccard join and decontamination against brute force."""

import random

import numpy as np
import pytest
from cases import corpus, frame, sentence

from plotflux.llm import decontaminate, jaccard
from plotflux.llm.shared import components, word_hashes


def test_word_hashes():
    text = "One  two\tTHREE é x\none two " + "y" * 100
    h = word_hashes(text.encode())
    assert len(h) == len(text.encode().split()) and h[0] == h[4] and h[1] == h[5] and len(set(h.tolist())) == len(h) - 2
    long = "z" * (3 << 20)
    data = f"one {long} two  ".encode() + b"word " * 500_000
    h = word_hashes(data)
    assert len(h) == len(data.split()) and h[0] == word_hashes(b"one")[0] and h[3] == word_hashes(b"WORD")[0]
    assert h[1] == word_hashes(long.encode())[0]
    assert len(word_hashes(b"")) == len(word_hashes(b" \n\t ")) == 0
    rng = random.Random(4)
    pool = list({sentence(rng, 1) for _ in range(2000)})
    assert len(set(word_hashes(" ".join(pool).encode()).tolist())) == len(pool)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (7, 5), (5, 9), (9, 6)] + [(k, k + 1) for k in range(100, 160)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 10, 11, 5, 6, 7, 9)} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 5: 5, 6: 5, 7: 5, 9: 5}
    assert all(got[k] == 100 for k in range(100, 161))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_groups(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(i, len(s), least[find(k)] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def same(got, want):
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_groups(spark):
    rows = corpus()
    same(jaccard.jaccard_groups(frame(spark, rows)).collect(), brute_groups(rows))


def family(rng, size, words, edits, common=""):
    base = sentence(rng, words).split()
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(len(copy))] = sentence(rng, 1)
        out.append((common + " " + " ".join(copy)).strip())
    return out


def test_families_and_frequent_passages(spark):
    """Groups above the frequency limit, chains of near copies, and a passage most texts share."""
    rng = random.Random(6)
    passage = sentence(rng, 60)
    texts = family(rng, 60, 80, 3) + family(rng, 30, 300, 12) + family(rng, 40, 12, 1)
    texts += [passage + " " + sentence(rng, n) for n in (5, 8, 12, 20, 40, 80) for _ in range(8)]
    texts += [sentence(rng, 20) + " " + passage for _ in range(25)] + family(rng, 25, 20, 2, common=passage)
    chain = sentence(rng, 100).split()
    for k in range(20):
        texts.append(" ".join(chain))
        chain[5 * k : 5 * k + 2] = sentence(rng, 2).split()
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    same(jaccard.jaccard_groups(frame(spark, rows)).collect(), brute_groups(rows))


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 8, 11, 16, 31, 40, 64, 100, 700])
def test_pigeonhole(size):
    """Linked sets share a signature in the smaller one's band, unless both are marked short."""
    rng = np.random.default_rng(size)
    for _ in range(60):
        s = np.unique(rng.integers(1 << 62, size=size, dtype=np.uint64))
        fewer = int(rng.integers(0, max(1, size // 7) + 1))
        r = np.unique(np.concatenate((s[fewer:], rng.integers(1 << 62, size=int(rng.integers(0, max(1, size // 7) + 1)), dtype=np.uint64))))
        both = len(np.intersect1d(s, r))
        if not len(r) or 4 * both < 3 * (len(s) + len(r) - both):
            continue
        bands = {b: (role, most) for role, b, most in jaccard._bands(len(s))}
        others = {b: (role, most) for role, b, most in jaccard._bands(len(r))}
        shared, short = set(), []
        for band in bands.keys() & others.keys():
            a, _, slack_a = jaccard._in_band(s, band, bands[band][1])
            b, _, slack_b = jaccard._in_band(r, band, others[band][1])
            shared |= set(a.tolist()) & set(b.tolist())
            short.append(slack_a < 0 and slack_b < 0)
        assert shared or all(short)


def test_keep_one(spark):
    rows = corpus()
    df = frame(spark, rows)
    kept = jaccard.keep_one(df).collect()
    groups = brute_groups(rows)
    want = {i for i, _, c in groups if i is not None and i == c}
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} == want
    assert sum(r["doc_id"] is not None for r in kept) == len(want)
    assert sum(r["doc_id"] is None for r in kept) == sum(i is None for i, _ in rows)
    assert jaccard.keep_one(df).columns == df.columns
    assert jaccard.keep_one(frame(spark, [])).collect() == []
    assert jaccard.jaccard_groups(frame(spark, [(1, None), (2, "")])).count() == 2


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for k, w in enumerate(item):
        new = [k + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (w != t), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_distance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        item, text = (rng.integers(4, size=int(rng.integers(1, n))).astype(np.uint64) for n in (9, 25))
        distance, start, end = decontaminate.edit_distance(item, text)
        assert distance == plain_distance(item.tolist(), text.tolist())
        part = text[start:end].tolist()
        full = [[max(i, j) if not i or not j else 0 for j in range(len(part) + 1)] for i in range(len(item) + 1)]
        for i in range(1, len(item) + 1):
            for j in range(1, len(part) + 1):
                full[i][j] = min(full[i - 1][j] + 1, full[i][j - 1] + 1, full[i - 1][j - 1] + (int(item[i - 1]) != part[j - 1]))
        assert full[-1][-1] == distance


def test_leaks(spark):
    rng = random.Random(3)
    items = [(k, sentence(rng, n)) for k, n in enumerate([1, 2, 3, 5, 9, 14, 20, 31, 32, 59, 120, 300])] + [(90, None), (91, "  "), (None, sentence(rng, 25))]
    rows, want = corpus(seed=8), set()
    at = 1000
    for item, text in items:
        if not (text or "").strip():
            continue
        for edits in (0, 0, 1):
            w = text.upper().split() if edits == 0 else text.split()
            if edits and len(w) >= 20:
                for _ in range(len(w) // 10):
                    w[rng.randrange(len(w))] = "changed"
            elif edits:
                continue
            rows.append((at, " ".join([sentence(rng, rng.randrange(1, 50)), *w, sentence(rng, rng.randrange(1, 50))])))
            want.add((at, item, edits == 0))
            at += 1
    got = decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    pairs = {(r["doc_id"], r["item"]): r["distance"] for r in got}
    assert all(pairs.get((d, i)) == 0 for d, i, exact in want if exact)
    near = [(d, i) for d, i, exact in want if not exact]
    assert sum(p in pairs for p in near) >= 0.95 * len(near)
    lists = {d: (t or "").lower().split() for d, t in rows if d is not None}
    texts = dict(items)
    for (d, i), distance in pairs.items():
        item = texts[i].lower().split()
        if d is not None and len(lists[d]) < 1000:
            assert plain_distance(item, lists[d]) == distance <= len(item) // 10
    assert decontaminate.find_leaks(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).collect() == []
    left = decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in rows} - {d for d, _ in pairs}


def test_the_quick_test_loses_no_copy():
    rng = np.random.default_rng(3)
    for _ in range(400):
        item = rng.integers(1 << 62, size=int(rng.integers(1, 60)), dtype=np.uint64)
        words = item.tolist()
        edits = len(item) // 10
        for _ in range(edits):
            at, kind = int(rng.integers(len(words))), int(rng.integers(3))
            words[at : at + (kind != 2)] = [] if kind == 1 else [int(rng.integers(1 << 62))]
        region = np.concatenate((rng.integers(1 << 62, size=5, dtype=np.uint64), np.array(words, np.uint64), rng.integers(1 << 62, size=9, dtype=np.uint64)))
        assert decontaminate.may_hold_copy(item.tolist(), region.tolist(), edits)
        assert len(item) < 12 or not decontaminate.may_hold_copy(item.tolist(), rng.permutation(region).tolist(), edits)


@pytest.mark.parametrize("size", [10, 12, 16, 20, 32, 64, 128, 256, 512, 1000])
def test_recall_of_the_walk_alone(size):
    """Items with a tenth of the words edited meet their copies by the keys of the random walk, at every size."""
    rng = np.random.default_rng(size)
    plan = decontaminate.Plan()
    met, trials = 0, 200 if size < 100 else 40
    for _ in range(trials):
        item = rng.integers(1 << 62, size=size, dtype=np.uint64)
        band = plan.band(size)
        width, stride = plan.window(band)
        keys = [set(k.tolist()) for k in decontaminate.walk_keys(item, np.arange(size - width + 1), band, plan)]
        words = item.tolist()
        for _ in range(plan.edits(size)):
            at, kind = int(rng.integers(len(words))), int(rng.integers(3))
            words[at : at + (kind != 2)] = [] if kind == 1 else [int(rng.integers(1 << 62))]
        text = np.concatenate((rng.integers(1 << 62, size=int(rng.integers(40)), dtype=np.uint64), np.array(words, np.uint64), rng.integers(1 << 62, size=60, dtype=np.uint64)))
        starts = np.arange(0, len(text) - width + 1, stride)
        met += any(set(k.tolist()) & held for k, held in zip(decontaminate.walk_keys(text, starts, band, plan), keys))
    assert met >= 0.95 * trials


#: Windows of which every copy within a tenth of its words holds an intact one.
EXACT = decontaminate.Shape(5, 1, 3, 4, 4)


@pytest.mark.parametrize("size", [10, 32, 64, 128, 256, 512, 1000])
def test_edited_copies_of_every_size_are_found(spark, size):
    """Copies with a tenth of the words edited, at random places or evenly spread, for each item size alone."""
    rng = random.Random(size)
    items = [(k, " ".join(f"w{rng.randrange(10**9)}" for _ in range(size))) for k in range(12)]
    rows = []
    for k, text in items:
        for spread in (False, True):
            w, edits = text.split(), size // 10
            places = range(size // (edits + 1), size, max(1, size // (edits + 1)))[:edits] if spread else rng.sample(range(size), edits)
            for at in sorted(places, reverse=True):
                kind = rng.randrange(3)
                w[at : at + (kind != 2)] = [] if kind == 1 else ["edited"]
            rows.append((k * 2 + spread, " ".join([sentence(rng, rng.randrange(80)), *w, sentence(rng, 30)])))
    table = spark.createDataFrame(items, "item_id long, text string")
    exact = decontaminate.find_leaks(frame(spark, rows), table, plan=decontaminate.Plan(short=EXACT, long=EXACT)).collect()
    assert {(r["doc_id"], r["item"]) for r in exact} == {(d, d // 2) for d, _ in rows}
    got = decontaminate.find_leaks(frame(spark, rows), table).collect()
    assert {(r["doc_id"], r["item"]) for r in got} <= {(d, d // 2) for d, _ in rows} and len(got) >= 0.95 * len(rows)
    assert all(r["distance"] <= size // 10 for r in [*exact, *got])


def test_decontaminate_judges_rows_of_shared_ids_by_their_own_text(spark):
    rng = random.Random(6)
    item, clean = sentence(rng, 30), [sentence(rng, 40) for _ in range(4)]
    rows = [(None, clean[0]), (None, f"{clean[1]} {item}"), (None, None), (7, clean[2]), (7, item), (7, item), (8, clean[3]), (9, item)]
    left = decontaminate.decontaminate(frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == frame(spark, rows).columns
    want = [(None, clean[0]), (None, None), (7, clean[2]), (8, clean[3])]
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(want, key=str)
