from pyspark.sql import functions as F

from docloom.operators import lineitems as L
from docloom.operators import repair as R
from docloom.operators import templates as M


def test_labelled_amounts(spark):
    rows = [(1, 1, "Round Off 12.50"), (1, 2, "IGST 18% 1,800.00"), (1, 3, "IGST 900.00 and 950.00"), (2, 1, "IGST nil")]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, text string")
    assert [tuple(r) for r in R.labelled_amounts(lines, ("igst",)).collect()] == [(1, 1800.0)]
    assert [tuple(r) for r in R.labelled_amounts(lines, ("igst",), largest=False).collect()] == [(1, 900.0)]
    assert [tuple(r) for r in R.labelled_amounts(lines, ("round off",)).collect()] == [(1, 12.5)]


def test_choice_between_two_lists(spark):
    rows = [(1, ["a", "b"], ["x"]), (2, ["a"], ["x", "y"]), (3, None, ["x"]), (4, ["a"], None), (5, [], [])]
    df = spark.createDataFrame(rows, "id long, t array<string>, g array<string>")
    items, method = L.choose_items(F.col("t"), F.col("g"))
    got = {r.id: (r.items, r.method) for r in df.select("id", items.alias("items"), method.alias("method")).collect()}
    assert got == {1: (["a", "b"], "template"), 2: (["x", "y"], "generic"), 3: (["x"], "generic"), 4: (["a"], "template"), 5: ([], "generic")}


def test_items_are_completed(spark):
    rows = [(1, 5.0, None, 50.0), (2, None, 10.0, 50.0), (3, 7.0, 10.0, 50.0), (4, 99.0, 98.0, 50.0), (5, None, 0.0, 50.0), (6, 4.0, 13.0, 50.0), (7, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, quantity double, unit_price double, amount double")
    got = {r.doc_id: (r.quantity, r.unit_price) for r in L.complete_items(df).collect()}
    assert got == {1: (5.0, 10.0), 2: (5.0, 10.0), 3: (5.0, 10.0), 4: (None, None), 5: (None, 0.0), 6: (4.0, 12.5), 7: (None, None)}


def test_five_part_signature_masks_numbers(spark):
    rows = [("A", ["Invoice No 12", "x"]), ("A", ["Invoice No 13", "x"]), ("B", ["Invoice No 12", "x"])]
    df = spark.createDataFrame(rows, "name string, lines array<string>")
    got = [r[0] for r in df.select(M.five_part_signature(F.lit(None).cast("string"), F.col("name"), F.col("lines"), F.array(F.lit("total")), F.lit("Qty Rate"))).collect()]
    assert got[0] == got[1] != got[2]


def test_amounts_of_nothing_stay_null(spark):
    names = ["subtotal", "taxable", "tax", "total", "words_total", "kw_total", "kw_subtotal", "kw_tax", "kw_tax_least", "summary_subtotal", "summary_tax", "breakdown_tax", "cgst", "sgst", "igst"]
    df = spark.createDataFrame([(1, *[None] * len(names))], "doc_id long, " + ", ".join(f"{n} double" for n in names))
    out = R.align_taxable(R.reconcile_components(R.repair_amounts(R.hydrate_amounts(df)))).first()
    assert [out[n] for n in ("subtotal", "taxable", "tax", "total")] == [None] * 4
