from pathlib import Path

import duckdb
import pytest

from kindred.queries import ORACLE_SQL, QUERIES
from tests.oracle import agrees

SF = "/root/testdata/sf0.001"
#: Queries whose result is empty or a single group on tables this small.
MAY_BE_EMPTY = {"hamming_pairs", "kind_filter", "preserves_copy", "select_by_dir", "select_by_folder", "similar_minus_exact"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    df = QUERIES[name](spark, SF)
    agrees(df, ORACLE_SQL[name], SF)
    assert name in MAY_BE_EMPTY or df.limit(1).count()


#: Documents with texts that are empty, missing or all different, numbers below zero, and sources that look like a name of a file.
ODD = {
    "empty": "text: CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END",
    "missing": "text: CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END",
    "all_empty": "text: ''",
    "alone": "text: text || doc_id",
    "negative": "doc_id: doc_id - 100",
    "source": "source: 'mydoc7.d'",
}


@pytest.mark.parametrize("odd", sorted(ODD))
@pytest.mark.parametrize("name", ["cached_scan_rows", "scan_summary"])
def test_query_agrees_with_sql_on_odd_documents(spark, tmp_path, name, odd):
    for table in Path(SF).glob("*.parquet"):
        if table.stem != "documents":
            (tmp_path / table.name).symlink_to(table)
    column, value = ODD[odd].split(": ")
    duckdb.execute(f"COPY (SELECT * REPLACE ({value} AS {column}) FROM '{SF}/documents.parquet') TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    agrees(QUERIES[name](spark, str(tmp_path)), ORACLE_SQL[name], str(tmp_path))


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n.startswith("sort_")])
def test_sorted_queries_come_in_order(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = [(r["position"], r["group_id"]) for r in QUERIES[name](spark, SF).collect()]
    assert got == con.sql(f"SELECT position, group_id FROM ({ORACLE_SQL[name]}) ORDER BY position").fetchall()
    assert [p for p, _ in got] == list(range(1, len(got) + 1))


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
