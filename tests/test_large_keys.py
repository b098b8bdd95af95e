"""Queries against their SQL on keys with more digits than those of the small tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import compare  # noqa: E402

from docloom.plans import damaged, oracles, queries  # noqa: E402

SUPPLIERS = ("supplemental_fields", "text_repairs", "record_cleaning", "unlabelled_invoices")
CUSTOMERS = ("id_card_round_trip", "field_cleaning", "damaged_texts")


@pytest.mark.parametrize("name", SUPPLIERS + CUSTOMERS)
def test_query_equals_its_sql_on_large_keys(spark, tmp_path, name):
    one, other = ("supplier", "s_suppkey") if name in SUPPLIERS else ("customer", "c_custkey")
    keys = [9_999, 10_000, 55_555, 99_999, 100_000, 345_678, 555_555, 555_556, 599_999, 600_001, 888_888, 899_998]
    spark.createDataFrame([(k,) for k in keys], f"{other} long").write.parquet(f"{tmp_path}/{one}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {one} AS SELECT * FROM read_parquet('{tmp_path}/{one}.parquet/*.parquet')")
    every = queries.queries()
    assert compare(spark, con, name, every[name], (oracles.oracle_sql() | damaged.oracle_sql())[name], str(tmp_path)) == len(keys)


def test_a_garbled_line_is_a_name_only_where_no_other_is(spark):
    from docloom.operators.idcards import extract_aadhaar

    text = "GOVERNMENT OF INDIA\n{}DOB: 01/02/1990\nMALE"
    rows = [(1, text.format("RAVI DEVA\nXKJHG BVCXZ\n")), (2, text.format("RAVI RRRRRR DEVA\n"))]
    got = {r.doc_id: r.name for r in extract_aadhaar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "RAVI DEVA", 2: "RAVI RRRRRR DEVA"}
