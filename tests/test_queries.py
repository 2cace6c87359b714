"""A few registered queries against their SQL, where the driver's smallest tables are at hand."""

import os

import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
SOME = ["document_fingerprints", "dedup_counts", "hash_split", "family_split_pivot", "contamination_findings", "sft_rule_violations", "clean_responses", "pack_offsets", "sft_encode_mask", "rubric_scores", "checkpoint_select", "early_stopping", "topk_softmax"]


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


def test_every_query_with_sql_is_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(SOME) <= set(__spark_entry__.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    df = __spark_entry__.queries()[name](spark, FOLDER)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = [tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in found.fetchall()]
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    assert sorted(names) == sorted(df.columns) and sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_entry(spark):
    assert {r.split for r in __spark_entry__.entry(spark).collect()} == {"train", "validation"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", ["split_leakage_check", "split_streams", "family_split_pivot", "contamination_by_split"])
def test_documents_are_identified_once(spark, name):
    """What reads the identified documents several times reads them from a table."""
    assert not any("documents.parquet" in f for f in __spark_entry__.queries()[name](spark, FOLDER).inputFiles())
