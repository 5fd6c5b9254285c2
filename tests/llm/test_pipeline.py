"""Every stage of the corpus pipeline, on what its predecessor kept, against brute force."""

import math
import random

import corpus_pipeline
from cases import frame, sentence
from test_learned import labelled
from test_native import SECRETS, base_spans, fill, words
from test_text import brute_groups


def redacted(text):
    if text is None:
        return None
    out, at = "", 0
    for start, _, end in base_spans(text):
        if start >= at:
            out += text[at:start] + "<secret>"
        at = max(at, end)
    return out + text[at:]


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    rows, truth, labels = labelled(spark, 300)
    items = [(k, sentence(rng, n)) for k, n in enumerate((12, 25, 50))]
    rows += [(5000 + k, f"{sentence(rng, 30)} {text} {sentence(rng, 30)}") for k, text in items for _ in (0,)]
    rows += [(6000 + k, f"{sentence(rng, 40)} {text}") for k, text in enumerate(SECRETS) if len(text) < 200]
    folder = str(tmp_path)
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
        stage(spark, docs, folder).write.parquet(f"{folder}/out{at}")
        docs = spark.read.parquet(f"{folder}/out{at}")
        seen[name] = (before, docs.collect())
        assert docs.columns == columns or at == len(corpus_pipeline.STAGES) - 1

    before, after = seen["quality_classifier"]
    kept = {r["doc_id"] for r in after}
    good = {i for i, q, *_ in truth if q}
    assert len(good - kept) <= len(good) // 50 and len(kept & {i for i, q, *_ in truth if not q}) <= 2

    before, after = seen["jaccard_join"]
    groups = brute_groups([(i, t) for i, t, _ in before])
    want = {i for i, _, c in groups if i is not None and i == c}
    assert {r["doc_id"] for r in after if r["doc_id"] is not None} == want

    before, after = seen["benchmark_decontamination"]
    holds = {i for i, t, _ in before if any(f" {x.lower()} " in f" {' '.join((t or '').lower().split())} " for _, x in items)}
    left = {r["doc_id"] for r in after}
    assert holds and left == {i for i, _, _ in before} - holds

    before, after = seen["secret_scans"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in after), key=key) == sorted(((i, redacted(t)) for i, t, _ in before), key=key)

    before, after = seen["mixing_to_weights"]
    sizes = {}
    for _, t, s in before:
        sizes[s] = sizes.get(s, 0) + words(t)
    target, taken = fill(sizes), {}
    assert sorted(r["size"] for r in after) == sorted(words(t) for _, t, _ in before)
    for r in after:
        assert math.isclose(r["target"], target[r["source"]], abs_tol=1e-6) and r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - t) <= len(before) for s, t in target.items())
