"""Every registered query of the corpus operators runs and has the columns that are asked of it."""

import pytest

from millrace.llm import queries

COLUMNS = {
    "op1_token_groups": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op2_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op3_pieces": {"doc_id": "bigint"},
    "op4_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op5_multi_index": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op6_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_secrets": {"doc_id": "bigint"},
    "op8_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op9_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op10_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op11_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op12_periodic_runs": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
    "op13_phrases": {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"},
    "pipeline": {},
}
#: Queries with one row for each document.
BY_DOCUMENT = ("op1", "op2", "op3", "op4", "op6", "op8", "op9", "op10", "op11", "op12")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    out = queries.QUERIES[name](spark, sf)
    assert COLUMNS[name].items() <= dict(out.dtypes).items()
    n = out.count()
    assert n > 0 or name == "op7_secrets"  # the smallest table holds no secret
    if name.split("_")[0] in BY_DOCUMENT:
        assert n == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_names():
    assert set(queries.QUERIES) == set(COLUMNS) and set(queries.ORACLES) <= set(queries.QUERIES)
