import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    assert {r.split for r in entry.entry(spark).collect()} == {"TRAIN", "VALIDATION", "TEST"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["strip_comments", "safety_scan", "import_allowlist", "drop_imports", "proof_extract", "text_audit", "audit_summary", "word_offsets", "lexer_encode", "lexer_decode", "staged_verification"])
def test_statement_queries_over_whole_documents(spark, name):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        out = entry.queries()[f"{name}_documents"](spark, DATA)
        columns = ", ".join(f'"{x}"' for x in out.columns)
        expect = c.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name + '_documents']})").fetchall()
    assert expect and sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, expect))
