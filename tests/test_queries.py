import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import compare, connect  # noqa: E402

from docloom.plans import oracles, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, name, queries.queries()[name], oracles.oracle_sql()[name], SF) > 0


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracles.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_zone_sizes_of_documents_with_tables(spark, tmp_path):
    items = [f"Item {i} 2 50.00 100.00" for i in range(7)]
    rows = [(1, "\n".join(["Acme Traders", "Invoice", "Description HSN Qty Rate Amount", *items, "Grand Total 700.00", "Thanks"])), (2, "a\nb\nc"), (3, "Bill To\nRavi")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_table) for r in queries.zone_sizes(spark, str(tmp_path)).collect()}
    assert got == {1: (12, 7), 2: (3, 0), 3: (2, 0)}


def test_entry_point(spark):
    import __spark_entry__

    assert set(oracles.oracle_sql()) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
