"""Costly expressions are evaluated once: counted in plans, since results do not tell."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import identifiers as I
from docloom.operators.amounts import amount_candidates, summary
from docloom.operators.invoice import extract_invoices, gstin_candidates, gstin_pair, read_invoices
from docloom.operators.lineitems import best_sections, is_precise_item, line_items, precise_items, section_score, section_totals, structured_items, sum_of_items
from docloom.functions.values import parse_amount
from docloom.operators.lines import index_lines, with_zones
from docloom.operators.templates import POSITIONS, extract_by_template
from docloom.plans import queries


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_number_is_read_once_however_many_places_its_check_has(spark):
    df = spark.range(1).select(F.concat(F.lit("27"), F.col("id").cast("string")).alias("x"))
    df = df.union(df)
    for read in (I.gstin_checks, I.repair_gstin, lambda c: I.gstin_check_digit(F.upper(c))):
        plan = df.select(read(F.col("x")).alias("y"))._jdf.queryExecution().analyzed().toString()
        assert plan.split("\n")[0].count("x#") == 1


def lines_of(spark, *texts):
    return with_zones(index_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))


def test_the_summary_of_amounts_reads_candidates_once(spark):
    plan = optimized(summary(amount_candidates(lines_of(spark, "Total\nTotal 400.00"))))
    assert plan.count("Generate posexplode(_a") == 1


@pytest.mark.parametrize("texts, pair", [(("GSTIN: {v}", "Bill To", "GSTIN: {b}"), ("v", "b")), (("Bill To", "GSTIN: {b}"), ("b", None)), (("GSTIN: {v}", "GSTIN: {v}"), ("v", None))])
def test_the_pair_of_numbers_comes_from_one_reading(spark, texts, pair):
    known = {"v": "02ZZZZZ0001Z1ZM", "b": "03ZZZZZ0002Z1ZI"}
    found = gstin_pair(gstin_candidates(lines_of(spark, "\n".join(texts).format(**known))))
    assert optimized(found).count("Generate posexplode") == 2  # One is of the lines.
    assert [(r.vendor_gstin, r.buyer_gstin) for r in found.collect()] == [tuple(known.get(p) for p in pair)]


def test_an_item_is_inferred_and_cleaned_once(spark):
    items = spark.range(1).select(F.col("id").alias("doc_id"), *[F.lit(v).alias(c) for c, v in (("item_no", 1), ("description", "3. blue bolt |"), ("hsn", "1234"), ("quantity", 2.0), ("unit_price", 50.0), ("amount", 100.0))])
    totals = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(100.0).alias("subtotal"), F.lit(118.0).alias("total"))
    items = items.union(items.withColumn("item_no", F.lit(2)).withColumn("hsn", F.lit(None).cast("string")))
    out = precise_items(items, totals)
    assert optimized(out).count("Range") == 3
    assert [(r.item_no, r.description, r.item_score) for r in out.collect()] == [(1, "blue bolt", 70)]
    made = items.where(is_precise_item(F.lit(None).cast("double")))._jdf.queryExecution().analyzed().toString()
    assert made.count("[;!?") == 1
    rows = lines_of(spark, "Acme\nNo | Description | HSN | Qty | Rate | Amount\n1 | blue bolt | 1234 | 2 | 50.00 | 100.00\nGrand Total")
    for read in (line_items, structured_items):
        assert optimized(read(rows)).count("AS score, i AS") + optimized(read(rows)).count("0.005") in (1, 2)


def test_the_items_of_sections_are_inferred_once(spark):
    out = best_sections(lines_of(spark, "Acme\nBank of nowhere\nblue bolt 1234 2 50.00 100.00\nred bolt 1234 2 60.00 120.00\nThanks"))
    assert optimized(out).count("FileScan") + optimized(out).count("Relation [doc_id") == 2
    assert sorted((r.item_no, r.amount) for r in out.collect()) == [(1, 100.0), (2, 120.0)]


@pytest.mark.parametrize("name", ["line_item_round_trip", "line_item_scores"])
def test_lines_of_invoices_are_not_dealt_again(spark, tiny, name):
    plan = queries.queries()[name](spark, tiny)._jdf.queryExecution().sparkPlan().toString()
    whole = queries.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 1
    assert "Exchange" not in whole.split("Generate posexplode")[0]


def test_score_and_sum_of_items_come_from_one_reading(spark):
    items = spark.createDataFrame([(1, 2.0, 3.0, "1234", 6.0), (1, None, None, None, 0.1), (1, None, None, None, -4.0), (2, None, 1.0, None, None)], "doc_id long, quantity double, unit_price double, hsn string, amount double")
    got = section_totals(items)
    want = section_score(items).join(sum_of_items(items), "doc_id", "left")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [(1, 325, 6.1), (2, 110, None)]


INVOICE = "ACME INDUSTRIES LIMITED\nInvoice No: INV0007\nDate: 05-Jan-2024\nBill To\nNEW WORLD LLP\nItem Description HSN Qty Rate Amount\nblue bolt 1234 2 50.00 100.00\nTaxable Value 100.00\nGrand Total 118.00"


def test_an_invoice_round_trip_does_not_scan_for_fields_that_it_does_not_give(spark, tiny):
    assert "pincode" not in optimized(queries.queries()["invoice_round_trip"](spark, tiny))


def test_records_without_items_are_the_same_but_for_them(spark):
    docs, as_of = spark.createDataFrame([(1, INVOICE), (2, "Total\n5")], "doc_id long, text string"), F.lit("2025-01-01").cast("date")
    part = read_invoices(docs, with_zones(index_lines(docs)), as_of, scanned=False, itemised=False)
    plan = optimized(part)
    assert "pincode" not in plan and "line_items" not in plan
    assert sorted(map(str, part.collect())) == sorted(map(str, extract_invoices(docs, as_of).select(part.columns).collect()))


def test_lines_are_scoped_once_for_all_fields_of_a_template(spark):
    place = lambda n, zone, word: (n, n - 1, zone, word)
    matched = spark.createDataFrame([(0, "t", {"invoice_number": place(2, "TOP", "invoice no"), "total": place(9, "BOTTOM", "total")})], f"doc_id long, template_id string, field_positions {POSITIONS}")
    out = extract_by_template(lines_of(spark, INVOICE), matched, F.lit("2025-01-01").cast("date"))
    assert "_worded" not in optimized(out)
    assert [(r.invoice_number, r.total, r.vendor_name) for r in out.collect()] == [("INV0007", 118.0, None)]


def test_plain_rows_and_numbers_are_read_the_short_way_with_the_same_results(spark):
    lines = index_lines(spark.createDataFrame([(1, "  Total 5\na  b\nLo   R\t\tx\n\tq\nz")], "doc_id long, text string"))
    assert "ltrim" in lines._jdf.queryExecution().analyzed().toString()
    assert [(r.text, r.x, r.w, r.col) for r in lines.orderBy("line_no").collect()] == [("Total 5", 16, 56, "FULL"), ("a b", 0, 32, "FULL"), ("Lo", 0, 24, "LEFT"), ("R x", 40, 32, "RIGHT"), ("q", 8, 24, "FULL"), ("z", 0, 24, "FULL")]
    values = spark.createDataFrame([("12.50",), ("1,234",), ("12,50",), ("9999999999999",), ("1000000000",)], "t string").select(parse_amount(F.col("t")).cast("double").alias("v"))
    assert [r.v for r in values.collect()] == [12.5, 1234.0, 12.5, None, None]
