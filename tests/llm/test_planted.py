"""The query of periodic runs: its planted repetitions and its digests, row by row in plain Python."""

import hashlib
import os
import zlib

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F
from test_sequences import runs_by_definition

from plotflux.llm import queries

FOLDER = os.path.join(TESTDATA, "sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def planted(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query_by_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, FOLDER, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, FOLDER).collect()}
    assert set(got) == set(docs)
    seen = 0
    for doc_id, text in docs.items():
        words = planted(doc_id, text)
        if len(words) > 700:
            continue
        runs = [r for r in runs_by_definition(words) if r[1] >= max(24, 3 * r[2])]
        r = got[doc_id]
        best = None
        for start, length, period in runs:
            if best is None or length * best[2] > best[1] * period:
                best = (start, length, period)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        seen += bool(runs)
    assert seen > 5


def test_planted_rows(spark):
    rows = [(None, "a b"), (3, None), (3, ""), *[(k, " ".join(f"w{i}" for i in range(k % 40))) for k in range(300)]]
    out = queries._planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), " ".join((r["text"] or "").split())) for r in out)
    want = sorted(((i is None, i or 0), " ".join(planted(i, t) if i is not None else (t or "").split())) for i, t in rows)
    assert got == want
    assert spark.range(1).select(F.crc32(F.lit("5").cast("string"))).first()[0] == zlib.crc32(b"5")
