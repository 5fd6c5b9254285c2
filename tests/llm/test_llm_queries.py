"""Every text query runs on the smallest tables, through the entry point, with its contract's columns."""

import os

import pytest
from conftest import TESTDATA

import __spark_entry__ as entry_point

FOLDER = os.path.join(TESTDATA, os.environ.get("TEST_SF", "sf0.001"))
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

COLUMNS = {
    "op1_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op3_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op4_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5_quality": {"doc_id": "bigint", "score": "double", "keep": "boolean"},
    "op6_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op7_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op8_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_decontaminate": {"doc_id": "bigint", "item": "bigint", "distance": "bigint"},
    "op10_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op11_sentencepiece": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op12_periodic_runs": {
        "doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint",
        "runs_sha256": "string", "collapsed_sha256": "string",
    },
    "op13_collocations": {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"},
    "pipeline": {"doc_id": "bigint", "source": "string", "size": "bigint", "target": "double", "taken": "bigint"},
}


@pytest.mark.parametrize("key", sorted(COLUMNS))
def test_query(spark, key):
    df = entry_point.queries()[key](spark, FOLDER)
    assert COLUMNS[key].items() <= dict(df.dtypes).items()
    # At the smallest size no phrase of a language may be frequent enough.
    assert df.count() >= (0 if key == "op13_collocations" else 1)
