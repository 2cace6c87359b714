"""Queries over documents of which some are blank or null, against their SQL: none of them is left out."""

import pytest

import __spark_entry__

TEXTS = ["", " \n", "\t", "", None, None, "some words", "some  words", "other words", "other words", "more", "another text", "x\r\ny"]
LANGS, SOURCES = ["en", "es", "de", "fr"], ["src1", "src2", "src5", "src8"]
NAMES = ["derived_document_ids", "dedup_groups", "normalize_variants", "document_fingerprints", "dedup_counts", "dedup_representatives", "removed_duplicates", "removed_duplicate_groups", "conflicting_splits", "split_leakage_check", "split_streams", "hash_split", "split_counts", "ambiguous_ids", "group_contract", "ambiguous_list", "split_explicit_override", "family_split_pivot", "family_group_split", "group_size_distribution", "split_token_counts"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("blank")
    rows = [(i, t, LANGS[i % 4], SOURCES[i // 2 % 4], len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", NAMES)
def test_blank_and_null_documents_are_in_the_result(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    df = __spark_entry__.queries()[name](spark, folder)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = [tuple(v for _, v in sorted(zip(names, r, strict=True))) for r in found.fetchall()]
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    assert sorted(names) == sorted(df.columns) and sorted(got, key=repr) == sorted(want, key=repr)
