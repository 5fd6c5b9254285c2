"""Quality posteriors, toxicity scores and URL models against independent definitions."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
from cases import frame, sentence
from test_learned import labelled

from plotflux.llm import quality, toxicity, url_filter


def strength(groups, parent_of):
    """Pseudo-count of a prior by moments: groups (n, sum) around their parents' rates."""
    total = sum(n for n, _ in groups.values())
    spread = sum((s / n - parent_of[key]) ** 2 * n for key, (n, s) in groups.items()) / total
    within = sum(parent_of[key] * (1 - parent_of[key]) for key in groups) / total
    mean = sum(s for _, s in groups.values()) / total
    ceiling = max(mean * (1 - mean), 1e-6)
    return min(max(ceiling / max(spread - within, ceiling / 10_000) - 1, 2.0), 10_000.0)


def test_quality_by_brute_force(spark):
    """Every score from the model's own evidence of each text, site by site, the document itself left out."""
    rows, _, labels = labelled(spark)
    rows = [(*r, f"s{(r[0] or 0) % 3}", "en")[:4] if len(r) < 4 else r for r in rows]
    rows += [(9001, None, None, None), (9002, "", None, None), (9003, "one word", "rare", "de"), rows[3]]
    docs = frame(spark, rows)
    model = quality.fit_quality(docs, labels)
    evidence = []
    for _, text, host, path in rows:
        raw = model.intercept + sum(w * x for w, x in zip(model.weights, quality.features(text or "")))
        raw = max(min(raw, 14.0), -14.0)
        evidence.append((host, path, raw, 1 / (1 + math.exp(-raw))))
    hosts, paths = {}, {}
    for host, path, _, p in evidence:
        for table, key in ((hosts, host), (paths, (host, path))):
            n, s = table.get(key, (0, 0.0))
            table[key] = (n + 1, s + p)
    rate = (sum(p for *_, p in evidence) + 1) / (len(evidence) + 2)
    k_host = strength(hosts, {h: rate for h in hosts})
    k_path = strength(paths, {(h, q): hosts[h][1] / hosts[h][0] for h, q in paths})
    want = []
    for host, path, raw, p in evidence:
        (hn, hs), (n, s) = hosts[host], paths[host, path]
        at_host = min(max((hs - p + k_host * rate) / (hn - 1 + k_host), 0.001), 0.999)
        at_path = min(max((s - p + k_path * at_host) / (n - 1 + k_path), 0.001), 0.999)
        odds = raw + math.log(at_path / (1 - at_path)) - math.log(rate / (1 - rate))
        want.append((p, at_host, at_path, 1 / (1 + math.exp(-odds))))
    got = [tuple(r["_quality"])[:4] for r in quality.judge_quality(docs, model).select("_quality").collect()]
    assert len(got) == len(rows)
    assert np.allclose(sorted(got), sorted(want), rtol=1e-9, atol=1e-12)


def test_toxicity_depends_on_the_text_alone(spark):
    """Null, empty, blank and very long texts have scores; equal texts have equal ones, whatever stands beside them."""
    rows, truth, labels = labelled(spark, 900)
    toxic = next(text for (i, text, *_), (j, _, t, _) in zip(rows[-900:], truth) if i == j and t)
    more = [(5001, None), (5002, ""), (None, None), (None, ""), (5003, toxic, "other", "de"), (5003, toxic), (None, toxic), (5004, " ".join([toxic] * 400)), (5005, "x" * 400_000), (5006, sentence(random.Random(1), 50_000))]
    got = toxicity.score_toxicity(frame(spark, [*rows, *more]), labels).collect()
    assert len(got) == len(rows) + len(more)
    scores = {}
    for r in got:
        scores.setdefault(r["doc_id"], []).append(r["score"])
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert scores[5001] == scores[5002] and len({*scores[5003]}) == 1
    nulls = sorted(scores[None])
    assert scores[5001][0] in nulls and scores[5003][0] in nulls
    assert scores[5003][0] >= 0.3 and scores[5004][0] >= 0.3 and scores[5002][0] < 0.3 and scores[5006][0] < 0.3


def probability(texts, context, char, size):
    """Witten and Bell's estimate by its definition, from the texts themselves."""
    shorter = 1 / size if not context else probability(texts, context[1:], char, size)
    followers = Counter()
    for text in texts:
        for at in range(1, len(text)):
            if at >= len(context) and text[at - len(context) : at] == context:
                followers[text[at]] += 1
    if not followers:
        return shorter
    return (followers[char] + len(followers) * shorter) / (sum(followers.values()) + len(followers))


def test_url_scores_by_definition():
    rng = random.Random(6)
    sides = [[f"{sentence(rng, 1)}.net/es/{rng.randrange(99)}" for _ in range(6)], [f"{sentence(rng, 1)}.com/a/{rng.randrange(99)}" for _ in range(8)]]
    padded = [[f"\x02{t}\x03" for t in side] for side in sides]
    counts = {}
    for label, side in enumerate(padded):
        for text in side:
            for at in range(1, len(text)):
                for k in range(min(3, at) + 1):
                    counts.setdefault(text[at - k : at + 1], [0, 0])[label] += 1
    model = url_filter.UrlModel(pd.DataFrame([(g, *n) for g, n in counts.items()], columns=["gram", "n0", "n1"]), 3)
    size = len({c for side in padded for text in side for c in text[1:]}) + 1
    for url in ("oak3.com/a/7", "elm.net/es/1", "日本.org/", ""):
        whole, total = f"\x02{url}\x03", [0.0, 0.0]
        for label in (0, 1):
            for at in range(1, len(whole)):
                total[label] += math.log(probability(padded[label], whole[max(0, at - 3) : at], whole[at], size))
        assert math.isclose(model.score(url), (total[1] - total[0]) / (len(url) + 1), rel_tol=1e-9, abs_tol=1e-12)
