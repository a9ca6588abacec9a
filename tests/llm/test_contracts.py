"""The registered queries: columns of their contracts, and equality with SQL where there is an oracle, on the smallest tables."""

import os

import pytest

from tessera.llm import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op3": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op5": "doc_id n_words n_removed kept_sha256",
    "op6": "doc_id held_out score predicted",
    "op7": "doc_id n_shingles component_id",
    "op8": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9": "page_id payload_bytes payload_digest record_type refers_to",
    "op10": "doc_id text",
}
TYPES = {"score": "double", "kept": "boolean", "base_failed": "boolean", "held_out": "boolean", "contaminated": "boolean", "predicted": "int"} | dict.fromkeys(("base_sha256", "spans", "base_labels", "labels", "kept_sha256", "items_sha256", "payload_digest", "record_type", "text"), "string")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_contract(spark, name):
    got = registry.QUERIES[name](spark, SF)
    types = dict(got.dtypes)
    for c in COLUMNS[name.split("_")[0]].split():
        assert types[c] == TYPES.get(c, "bigint"), c
    rows = got.collect()
    n = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op9') else 'documents'}.parquet").count()
    assert len(rows) == n or name.startswith("op3") and len(rows) >= n
    if name in registry.ORACLES:
        import duckdb

        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(registry.ORACLES[name])
        assert sorted(want.columns) == sorted(got.columns)
        order = [want.columns.index(c) for c in got.columns]
        assert sorted(map(repr, map(tuple, rows))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_one_query_an_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in registry.QUERIES) == list(range(1, 11))
