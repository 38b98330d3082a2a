"""Queries against their SQL on the small tables, where these are at hand."""

import os

import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = ["d01_opcode_frequency", "d07_entropy_rate", "e01_zipf_ols", "d22_positional_distribution", "d26_mutual_information", "f19_cosine_n2", "e11_lm_n3", "h02_fingerprint_prediction", "d43_opt_trends", "c14_knn", "b08_importance_sample", "a02_listing_parse"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    db.sql("SET timezone = 'UTC'")
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, FOLDER).toArrow()
    expected = db.sql(__spark_entry__.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(expected.column_names) and got.num_rows == expected.num_rows
    columns = ", ".join(f'"{c}"' for c in sorted(got.column_names))
    assert not db.sql(f"SELECT {columns} FROM got EXCEPT ALL SELECT {columns} FROM expected").fetchall()


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
