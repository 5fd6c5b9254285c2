"""Mixing and secret scans against brute force."""

import math
import random
import re
import time

import pytest
from cases import corpus, frame
from pyspark.sql import functions as F

from plotflux.llm import mixing, secrets


def fill(sizes, weights=(1, 2, 3), cap=3.0):
    """Water-filling by definition: share out, clamp what is above, share out the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, held = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in held]
        if not free:
            return held
        level = (total - sum(held.values())) / sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * level > cap * sizes[s]]
        if not above:
            return held | {s: weight[s] * level for s in free}
        held |= {s: cap * sizes[s] for s in above}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = [(i, t, [None, "a", "B", "ä", "hot", "hot", "hot"][k % 7]) for k, (i, t) in enumerate(corpus(seed))]
    rows += [(900, "tiny", "z")]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    target = fill(sizes)
    taken, longest = {}, {}
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == sorted(words(t) for _, t, _ in rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], abs_tol=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in target.items():
        assert abs(taken.get(s, 0) - t) <= len(rows) + 1
    again = mixing.mix_sources(frame(spark, rows[::-1]).repartition(5)).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(got, key=key) == sorted(again, key=key)


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(frame(spark, [])).collect() == []
    only = mixing.mix_sources(frame(spark, [(1, None), (2, "")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in only] == [(0, 0.0, 0)] * 2


BASE = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in BASE.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


SECRETS = [
    "password: token = abcdefgh and ApiKey='zz+/9.=' é", "token=ab secret=longer1 PASSWD:abcdef", "é" * 3 + "AKIA" + "Q7" * 8,
    "AKIASHORT AKIAAKIA" + "X" * 11 + " AKIA" + "Y" * 16, "deadbeef" * 3 + " " + "0" * 23 + " " + "ab" * 40_000,
    "secret=token=abcdefg api_key : 'x' api-key=abcdefgh", "passſword=abcdefgh", "password==abcdef",
]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
RANDOM_KEY = "q7Rk2VbX9sLm4TzW8cYd1HfG"


def test_secrets(spark):
    rows = [*corpus(), *[(500 + k, t) for k, t in enumerate(SECRETS)], (700, f"the key {RANDOM_KEY} ends"), (700, f"the key {RANDOM_KEY} ends")]
    got = secrets.secret_spans(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, base_spans(t or "")) for i, t in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], [tuple(s) for s in r["base"]]) for r in got) == want
    for r in got:
        assert set(r["base"]) <= set(r["spans"])
        assert r["n_hex"] == sum(s["rank"] == 2 for s in r["base"])
    found = [r for r in got if r["doc_id"] == 700]
    assert [[tuple(s) for s in r["spans"]] for r in found] == [[(8, 3, 8 + len(RANDOM_KEY))]] * 2
    assert secrets.secret_spans(frame(spark, [])).collect() == []


def test_allow_list(spark):
    allowed = ["a1b2c3d4-a1b2-4c3d-8e9f-a1b2c3d4e5f6", "internationalisation-of-everything", "https/www/path_to-some_long-name12", "12345678901234567890123"]
    got = secrets.secret_spans(frame(spark, list(enumerate(allowed)))).collect()
    assert all(r["spans"] == [] for r in got)


def entropy(run, w=20):
    best = 0.0
    for k in range(len(run) - w + 1):
        part = run[k : k + w]
        best = max(best, -sum(part.count(c) / w * math.log2(part.count(c) / w) for c in set(part)))
    return best


def test_window_entropy(spark):
    runs = [RANDOM_KEY, "a" * 30, "abcdefghijklmnopqrstuvwxyz0123456789", "ab" * 15 + RANDOM_KEY, "short", "a" * 5000]
    got = spark.createDataFrame([(r,) for r in runs], "run string").select(secrets.window_entropy(F.col("run"), ALPHABET).alias("h")).collect()
    assert all(math.isclose(g["h"], entropy(r), abs_tol=1e-9) for g, r in zip(got, runs))


def test_long_random_runs(spark):
    """One embedded image of 100,000 characters, and a text of 3,000 secrets, take seconds, not hours."""
    rng = random.Random(7)
    image = "".join(rng.choice(ALPHABET) for _ in range(100_000))
    keys = ["".join(rng.choice(ALPHABET[:62]) for _ in range(24)) for _ in range(1500)]
    many = " ".join(f"token={k} {k[::-1]}" for k in keys)
    started = time.monotonic()
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.secret_spans(frame(spark, [(1, f"<{image}>"), (2, many)])).collect()}
    assert time.monotonic() - started < 30
    assert got[1] == [(1, 3, 100_001)]
    assert [s for s in got[2] if s[1] == 0] == base_spans(many) and sum(s[1] == 3 for s in got[2]) == sum(entropy(k) >= 3.9 and any(c.isdigit() for c in k) for k in keys)


def test_spans_clear_of_others(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(200):
        cuts = sorted(rng.sample(range(200), 2 * rng.randrange(1, 12)))
        spans = [(a, b, "x") for a, b in zip(cuts[::2], cuts[1::2])]
        others = sorted((a := rng.randrange(200), a + rng.randrange(1, 20), "") for _ in range(rng.randrange(12)))
        rows.append((spans, others))
    kind = "array<struct<start:int,end:int,hit:string>>"
    df = spark.createDataFrame(rows, f"spans {kind}, others {kind}")
    got = df.select("spans", "others", secrets.clear_of(F.col("spans"), F.col("others")).alias("free")).collect()
    for r in got:
        assert r["free"] == [s for s in r["spans"] if not any(o["start"] < s["end"] and s["start"] < o["end"] for o in r["others"])]


def test_redaction(spark):
    text = "say password=hunter22 twice: token='deadbeefdeadbeefdeadbeef00' end"
    df = frame(spark, [(1, text), (2, None), (3, "plain")])
    got = {r["doc_id"]: r for r in secrets.redact_secrets(df).collect()}
    assert got[1]["text"] == "say <secret> twice: <secret>' end" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[3]["text"] == "plain"
    assert secrets.redact_secrets(df).columns == df.columns
