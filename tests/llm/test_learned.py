"""Personal data, WARC files, URL filters, quality, toxicity and neighbours."""

import time
import base64
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from cases import corpus, frame, sentence
from pyspark.sql import functions as F

from plotflux.llm.shared import shared_folder
from plotflux.llm import neighbours, pii, quality, toxicity, url_filter, warc

PII = [
    "a@b@c.de x@y.z,.q%w@ex-a.mple.org@b.c", "é1.2.3.4.5 999.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255", "4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111",
    "+1 (988) 555-2485 +12 34 +1+1+1 234 567 890 1.", "+1 (826) 555-4081 190.137.223.204 du", "write to jane (at) mail (dot) com now", "@ a@ @b.c ..@..", "1 2 3 " * 500,
    "call (415) 555-2671 today", "x" * 50_000 + "@" + "y" * 50_000 + ".com", "7" * 60_000,
]


def luhn(digits):
    total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1]))
    return total % 10 == 0


def base_pii(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if "@" in text else []
    for m in re.finditer(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def test_pii(spark):
    rows = [*corpus(), *[(500 + k, t) for k, t in enumerate(PII)]]
    got = pii.personal_data(frame(spark, rows)).collect()
    key = lambda i: -1 if i is None else i
    want = sorted((key(i), base_pii(t or "") if len(t or "") < 40_000 or (i or 0) < 500 else None) for i, t in rows)
    have = sorted((key(r["doc_id"]), [tuple(s) for s in r["base"]]) for r in got)
    assert [i for i, _ in have] == [i for i, _ in want]
    assert all(w is None or h == w for (_, h), (_, w) in zip(have, want))
    spans = {r["doc_id"]: r for r in got}
    assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) for r in got)
    assert spans[509]["base"] == [(0, 0, 100_005)] and spans[510]["base"] == []
    assert pii.personal_data(frame(spark, [])).collect() == []


def test_reliabilities():
    """Labelers of known accuracy are told apart from their votes alone."""
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.4
    accuracy = (0.95, 0.9, 0.8, 0.7, 0.85)
    votes = np.stack([np.where(rng.random(len(truth)) < a, truth, ~truth) for a in accuracy], 1)
    codes = np.array([pii._code(0, [pii.YES if x else pii.NO for x in row], "abc") for row in votes])
    seen, counts = np.unique(codes, return_counts=True)
    posterior, table = pii.estimate_reliabilities(seen, counts)
    assert np.allclose(table["yes_if_true"][:5], accuracy, atol=0.04)
    p = pii.train_span_classifier(seen, counts, posterior)
    said = p[np.searchsorted(seen, codes)] >= 0.5
    assert (said == truth).mean() > 0.95


def test_warc(spark):
    pages = [(3, "http://a/", "same"), (1, "http://b/ x\r\ny", "same"), (2, None, None), (5, "u", ""), (7, "u", "é" * 200_000), (7, "u", "other"), (None, "n", "same"), (None, "n", "alone")]
    rng = random.Random(1)
    pages += [(100 + k, f"http://h/{k}", "<html>" + sentence(rng, 80)) for k in range(60)] + [(1, "again", "same")]
    df = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, first int, same string")
    got = warc.archive_pages(spark, df).collect()
    want = []
    for i, _, html in pages:
        body = (html or "").encode()
        first = min((j for j, _, h in pages if (h or "") == (html or "") and j is not None), default=None)
        revisit = first is not None and first != i
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    none = warc.archive_pages(spark, df.where("page_id in (1, 3)"), min_revisit_bytes=5).collect()
    assert all(r["record_type"] == "response" for r in none)
    assert warc.archive_pages(spark, df.where("false")).collect() == []


def test_small_archives_have_a_dictionary():
    """Every archive starts with the dictionary's frame, and its records need that dictionary."""
    for n in (1, 3, 7):
        records = [warc.record(k, "http://h/", b"tiny" * k, "response", None, "1970-01-01T00:00:00Z") for k in range(n)]
        data = warc.pack(records)
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC and list(warc.unpack(data)) == records
        body = data[8 + int.from_bytes(data[4:8], "little") :]
        with pytest.raises(Exception):
            list(warc.unpack(body))


def test_dictionary_samples_the_whole_archive():
    records = [bytes([65 + k]) * 1000 for k in range(26)] + [b"0" * 500_000 + b"1" * 500_000]
    got = warc.samples(records, 10**9, 1000)
    assert b"".join(got) == b"".join(records)
    some = warc.samples(records, 200_000, 1000)
    held = sum(map(len, some))
    assert 190_000 <= held <= 210_000 and {p[:1] for p in some} >= {b"0", b"1"} and sum(p[:1].isalpha() for p in some) in (4, 5, 6)
    assert abs(sum(p[:1] == b"0" for p in some) - sum(p[:1] == b"1" for p in some)) <= 2


def test_rotated_archives(spark):
    """Archives rotate by size; all of them are read back, however many a task wrote."""
    rng = random.Random(2)
    pages = [(k, f"http://h/{k}", sentence(rng, 400)) for k in range(120)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    folder = shared_folder(spark)
    manifest = warc.write_archives(df, folder, archive_bytes=20_000)
    assert manifest.count() > 10 and manifest.agg(F.sum("records")).first()[0] == 120
    got = warc.read_archives(manifest, folder).collect()
    assert sorted(r["page_id"] for r in got) == list(range(120))


def test_archive_layout():
    records = [warc.record(k, "http://h/", f"{k} {sentence(random.Random(k), 60)}".encode(), "response", None, "1970-01-01T00:00:00Z") for k in range(50)]
    data = warc.pack(records)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    assert list(warc.unpack(data)) == records
    assert list(warc.unpack(warc.pack(records[:1]))) == records[:1] and list(warc.unpack(warc.pack([]))) == []
    with pytest.raises(ValueError):
        list(warc.unpack(data[:-3]))


URLS = [
    "https://WWW.Example.com/en/x?q#f", "http://a.example.com/en/", "http://a.example.com/EN/", "ftp://com/", "http://com", "http://xcom/", "http://b.net/es/1", "http://b.net/fr",
    "http://b.net/fr/", None, "", "no scheme", "://", "a://b://c/d", "http://ÄB.com/é?x", "http://h.org?x/y#z", "http://h.org#/a", "http://sub.www.example.com/en/a",
]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, None
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_urls(spark):
    rng = random.Random(2)
    good = [f"http://{sentence(rng, 1)}.com/a/{rng.randrange(9999)}" for _ in range(150)]
    bad = [f"http://zz-{rng.randrange(99999)}-win.net/es/xx{rng.randrange(999)}" for _ in range(150)]
    open_ = [f"http://{sentence(rng, 1)}.org/a/{rng.randrange(999)}" for _ in range(20)] + [f"http://zz-{rng.randrange(9999)}-win.io/es/xx{rng.randrange(999)}" for _ in range(20)]
    urls = URLS + good + bad + open_ + [URLS[0]]
    df = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(urls)], "page_id long, url string, host string, rule int")
    got = {r["page_id"]: r for r in url_filter.judge_urls(df).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path, rule, verdict = judged(u)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert got[k]["verdict"] == verdict if rule else got[k]["verdict"] in ("allow", "block")
    start = len(URLS) + 300
    right = [got[start + k]["verdict"] == ("allow" if k < 20 else "block") for k in range(40)]
    assert sum(right) >= 36
    alone = url_filter.judge_urls(df.where(f"page_id < 5 or page_id = {start}")).collect()
    assert {r["verdict"] for r in alone if r["rule"] is None} <= {"allow", "block"}
    assert url_filter.judge_urls(df.where("false")).collect() == []


def test_url_models_keep_all_grams(spark):
    """Models beyond the size that goes to every task give the scores of a model of all grams."""
    rng = random.Random(4)
    urls = [f"http://{sentence(rng, 1)}.com/a/{rng.randrange(9999)}" for _ in range(60)] + [f"http://z{rng.randrange(999)}é😀.net/es/{rng.randrange(999)}" for _ in range(25)]
    urls += [f"http://{sentence(rng, 1)}.org/q/{rng.randrange(999)}" for _ in range(15)] + ["http://z1é.io/es/7", "http://日本.org/"] + ["http://hot.org/a"] * 40 + [None, ""]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    parts = [("".join(judged(u)[:2]), judged(u)[3]) for u in urls]
    counts = {}
    for shown, verdict in parts:
        padded = f"\x02{shown}\x03"
        for end in range(1, len(padded)) if verdict else ():
            for k in range(min(4, end) + 1):
                counts.setdefault(padded[end - k : end + 1], [0, 0])[verdict == "allow"] += 1
    model = url_filter.UrlModel(pd.DataFrame([(g, *n) for g, n in counts.items()], columns=["gram", "n0", "n1"]), 4)
    assert len(counts) > 500
    small, large = ({r["page_id"]: r for r in url_filter.judge_urls(df, most=m).collect()} for m in (300_000, 500))
    assert len(large) == len(small) == len(urls)
    for k, (shown, verdict) in enumerate(parts):
        assert large[k]["verdict"] == small[k]["verdict"] and large[k]["rule"] == small[k]["rule"]
        if verdict:
            assert large[k]["score"] is None
        else:
            assert abs(large[k]["score"] - model.score(shown)) < 1e-9 and abs(small[k]["score"] - model.score(shown)) < 1e-9


def labelled(spark, n=400):
    rng = random.Random(5)
    rows, labels = corpus(), []
    for k in range(n):
        text = sentence(rng, rng.randrange(20, 150))
        junk, toxic = k % 5 == 0, k % 4 == 1
        if junk:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbert", "grumbold", "idiot", "splonk"]))
            text = " ".join(words)
        rows.append((1000 + k, text, f"s{k % 4}", "en"))
        labels.append((1000 + k, int(not junk), int(toxic), "x"))
    return rows, labels, spark.createDataFrame(labels + [(None, 1, 1, "x"), (5, None, None, "x"), labels[0]], "doc_id long, quality int, toxic int, text string")


def test_quality(spark):
    rows, truth, labels = labelled(spark)
    df = frame(spark, rows)
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    wrong = sum((i in set(ids)) != bool(q) for i, q, *_ in truth)
    assert wrong <= len(truth) // 50
    assert quality.keep_good(df, labels.where("false")).count() == len(rows)
    assert quality.keep_good(df.where("false"), labels).collect() == []


def test_shrinkage(spark):
    """A sparse path goes to its host's rate, a sparse host to the global one; a large one keeps its own."""
    rows = [("big", "a", 0.9)] * 300 + [("big", "b", 0.1)] * 300 + [("big", "c", 0.1)] + [("poor", "a", 0.2)] * 400 + [("new", "a", 0.0)] + [(None, None, 0.5)] * 3
    sites, rate, k_host, k_path = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {(r["host"], r["path"]): r for r in sites.collect()}
    assert got["big", "a"]["n"] == 300 and got["big", "c"]["host_n"] == 601 and got[None, None]["n"] == 3
    host = (got["new", "a"]["host_s"] + k_host * rate) / (1 + k_host)
    assert abs(host - rate) < 0.5 * rate
    big = (got["big", "b"]["s"] + k_path * 0.5) / (300 + k_path)
    assert abs(big - 0.1) < 0.1


def test_toxicity(spark):
    rows, truth, labels = labelled(spark, 900)
    got = toxicity.score_toxicity(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    said = {r["doc_id"]: r for r in got}
    held = [(said[i]["predicted"], t) for i, _, t, _ in truth if said[i]["held_out"]]
    assert held and sum(p == t for p, t in held) >= 0.95 * len(held)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    flat = toxicity.score_toxicity(frame(spark, rows[:10]), labels.where("false")).collect()
    assert len(flat) == 10 and all(r["score"] == 0.5 for r in flat)
    assert toxicity.score_toxicity(frame(spark, []), labels).collect() == []


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    points = centres[np.arange(1500) % 30] + 0.3 * rng.standard_normal((1500, 16))
    vectors = [(k, (p / np.linalg.norm(p)).tolist()) for k, p in enumerate(points)]
    vectors += [(2000 + k, vectors[0][1]) for k in range(40)]
    odd = [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] + [1.0] * 15), (3060, [None] + [1.0] * 15), (3080, []), (3100, [1.0, 2.0]), (None, [1.0] * 16), (20, vectors[20][1])]
    df = spark.createDataFrame([(*v, "q", 1) for v in vectors + odd], "vec_id long, embedding array<double>, query string, rank int")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    base = {i: np.array(v) for i, v in vectors}
    ids = np.array(sorted(base))
    matrix = np.stack([base[i] for i in ids])
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and q not in set(mine["vec_id"])
        score = (matrix * base[q]).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        hit += len(set(ids[order]) & set(mine["vec_id"]))
        total += 20
        assert np.allclose(mine["score"], [base[v] @ base[q] for v in mine["vec_id"]])
    assert hit >= 0.9 * total and not set(got["query_id"]) - set(ids.tolist())
    ties = got[got["query_id"] == 2000].sort_values("rank")["vec_id"].tolist()
    assert ties == [0, *range(2001, 2020)]
    few = neighbours.nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).toPandas()
    assert len(few) == 4
    assert neighbours.nearest(df.where("false"), F.col("vec_id") % 20 == 0).collect() == []


def test_pipeline_names():
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "jaccard_join", "benchmark_decontamination", "secret_scans", "mixing_to_weights"]
    assert pd.Series(corpus_pipeline.STAGES).notna().all()


def test_personal_data_in_one_long_text():
    """Thousands of spans in one text take time in proportion to their number."""
    from plotflux.llm import pii

    text = " ".join(f"user{i}@mail{i}.com or user{i} (at) mail (dot) org" for i in range(16_000))
    started = time.monotonic()
    base = pii.base_spans(text)
    loose = pii.loose_spans(text, base)
    assert time.monotonic() - started < 3
    assert len(base) == len(loose) == 16_000
    assert all(b <= c for (_, _, b), (_, c, _) in zip(base, loose))


def test_dial_codes_of_three_digits():
    from plotflux.llm import pii

    for number in ("+351 912 345 678", "+420 601 123 456", "+971 50 123 4567", "+44 20 7946 0958"):
        assert pii.votes(number, 3, 0, len(number), True)[2] == pii.YES
