"""Registered queries on the smallest tables: SQL where there is some, brute force else."""

import pytest

from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_mix_sources", "op9_chat_format"])
def test_query_matches_sql(spark, name):
    import __spark_entry__ as E
    ok, message = compare(E.queries()[name](spark, SF), duck(SF), E.oracle_sql()[name])
    assert ok, message


def test_pipeline(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in after.select("doc_id").collect()} <= ids
        before = after
    out = P.STAGES[-1][1](spark, before, SF).collect()
    assert len(out) == before.count()
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
