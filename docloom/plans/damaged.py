"""Queries over damaged values and documents, each with the SQL that states what they should have been.

Values are made from the keys of the relational tables and then misread, mislabelled or left out; the operators put them
right, and the SQL says what the key gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import fields as C
from docloom.functions import text as T
from docloom.functions import values as V
from docloom.operators import amounts as A
from docloom.operators import invoice as N
from docloom.operators import lineitems as L
from docloom.operators import quality as Q
from docloom.operators import repair as R
from docloom.operators import supplemental as S
from docloom.operators import templates as M
from docloom.operators.lines import index_lines, plain_lines, with_zones
from docloom.plans.oracles import CARD_NAME, ITEMS, check_digit, gstin, letters, quoted
from docloom.plans.render import aadhaar_of, buyer_name, gstin_of, invoices, money, order_lines, vendor_name
from docloom.session import stored, table
from docloom.sources import ocr

AS_OF = "2025-01-01"


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def _pad(key: Column, n: int) -> Column:
    """A key in n digits; like SQL's lpad, the first n of a longer one."""
    return F.lpad(key.cast("string"), n, "0")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _choose(key: Column, values: tuple[str | None, ...]) -> Column:
    out = F.lit(values[-1])
    for k, v in enumerate(values[:-1]):
        out = F.when(key % len(values) == k, F.lit(v)).otherwise(out)
    return out


def _case(key: str, values: tuple[str | None, ...]) -> str:
    sql = ["NULL" if v is None else quoted(v) for v in values]
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(sql)) + " END"


# --- single fields -----------------------------------------------------------------------------------------------------

PLACES = ("HYDERABAD", "Mysore (29)", " kota", "SURAT", "Springfield", None)
CODES = ("06", "07", "08", "09", "24", "27", "29", "33", "36", "99")


def field_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts, places, codes and identifiers of every customer, cleaned of labels, look-alikes and noise."""
    k = F.col("c_custkey")
    code = _choose(k, CODES)
    place = _choose(k, PLACES)
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        C.phones(_text("Mob +91-9", _pad(k, 9), ", 9", _pad(k, 9), " / 12345")).alias("phones"),
        C.email(_text("Email: Sales.", k, "@Example-", k % 7, ".CO.IN |")).alias("email"),
        C.website(_text("Website: HTTP://WWW.Shop", k, ".com/x")).alias("website"),
        C.website(_text("shop", k, "@gmail.com")).alias("mail_host"),
        C.pincode(_text("Ref 123456 then Near Park Road, ", 500_000 + k % 90_000, " or 110001")).alias("pincode"),
        C.pincode(_text("Ref 012345 and ", 200_000 + k % 90_000)).alias("bare_pincode"),
        C.vehicle(_text("ts-0", k % 10, " ab ", _pad(k % 10_000, 4))).alias("vehicle"),
        C.place_of_supply(place, none, code).alias("place"),
        C.state(none, code, none).alias("state"),
        C.ifsc(_text("HOFCO", F.translate(_pad(k % 1_000_000, 6), "0", "Q"))).alias("ifsc"),
        C.identifier(_text("|PO_", k, "-A."), 30).alias("identifier"),
        C.account_number(_text("A/C No: 00", _pad(k, 10), " Branch"), none).alias("account"),
        C.account_number(none, _text("Bank of X 12345678 and 99", _pad(k, 10))).alias("longest"),
        C.is_government_gstin(_text("36", _choose(k, ("AAAGN1030Q", "ABCDE1234F")), "1Z5")).alias("government"),
        C.payment_terms(_text("Terms of payment: ", k % 90 + 1, " days")).alias("terms"),
        C.transport_details(_choose(k, ("Transporter: Speedy Roadlines", "by road", "Somebody", "Fast Cargo destination Kota"))).alias("carrier"),
        C.dispatch(_choose(k, ("Dispatched through: Blue Van", "TS09AB1234", "we will send it all by some other way", "LORRY"))).alias("dispatch"),
        C.reference(_choose(k, ("Order reference: AB/12", "call mob 12", "no digit here"))).alias("reference"),
        C.bank_name(_choose(k, ("Bank Name: State Bank of India", "Our Bank", "Bank Details: Axis Bank")), F.lit("HDFC Bank 12345678")).alias("bank"),
        C.invoice_number(_choose(k, ("#inv-0012.", "INV0ICE", "01/02/2024", "I0045")), as_of()).alias("number"),
        C.party_name(_choose(k, ("Bill To: Rama Stores (2022-2023)", "GSTIN 36", "Sita Traders, Sita Traders")), False).alias("party"),
        C.mentioned(_choose(k, (" ", None, "x"))).alias("mentioned"),
    )


FIELDS = f"""
SELECT c_custkey, '+91 9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') || ', 9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS phones,
       'sales.' || c_custkey || '@example-' || c_custkey % 7 || '.co.in' AS email, 'WWW.Shop' || c_custkey || '.com' AS website,
       CAST(NULL AS VARCHAR) AS mail_host, CAST(500000 + c_custkey % 90000 AS VARCHAR) AS pincode, CAST(200000 + c_custkey % 90000 AS VARCHAR) AS bare_pincode,
       'TS0' || c_custkey % 10 || 'AB' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS vehicle,
       coalesce({_case('c_custkey', ('Telangana', 'Karnataka', 'Rajasthan', 'Gujarat', 'Springfield', None))}, s) AS place, s AS state,
       'HDFC0' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') AS ifsc, 'PO' || c_custkey || '-A' AS identifier,
       '00' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS account, '99' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS longest,
       c_custkey % 2 = 0 AS government, (c_custkey % 90 + 1) || ' days' AS terms,
       {_case('c_custkey', ('Speedy Roadlines', 'by road', None, 'Fast Cargo'))} AS carrier, {_case('c_custkey', ('Blue Van', None, None, 'LORRY'))} AS dispatch,
       {_case('c_custkey', ('AB/12', None, None))} AS reference, {_case('c_custkey', ('State Bank of India', 'HDFC Bank', 'Axis Bank'))} AS bank,
       {_case('c_custkey', ('INV-0012', None, None, '10045'))} AS number, {_case('c_custkey', ('Rama Stores', None, 'Sita Traders'))} AS party,
       {_case('c_custkey', ('NOT_MENTIONED', 'NOT_MENTIONED', 'x'))} AS mentioned
FROM (SELECT c_custkey, {_case('c_custkey', ('Haryana', 'Delhi', 'Rajasthan', 'Uttar Pradesh', 'Gujarat', 'Maharashtra', 'Karnataka', 'Tamil Nadu', 'Telangana', None))} AS s FROM customer)
"""


# --- amounts -----------------------------------------------------------------------------------------------------------


def amount_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of every order found again: the record lacks one, or has a total below its parts, and the text tells."""
    net = F.round(F.col("o_totalprice")).cast("long") + 2_000
    tax, key = F.floor(net * 18 / 100), F.col("o_orderkey")
    total = net + tax
    words = F.when(key % 2 == 0, _text("Amount in words: Indian Rupees ", V.words_of_amount(total), " only"))
    text = F.concat_ws("\n", F.lit("Tax Rate 18 Taxable Tax"), _text("IGST ", tax, ".00"), _text("Taxable Value ", net, ".00"), _text("Grand Total ", total, ".00"), words)
    real = lambda c: c.cast("double")
    docs = table(spark, sf_dir, "orders").select(
        key.alias("doc_id"), text.alias("text"),
        F.when(key % 4 != 0, real(net)).alias("subtotal"), F.when(key % 4 == 1, real(total)).when(key % 4 == 2, real(net * 2)).alias("taxable"),
        F.when(key % 4 == 3, real(tax)).alias("tax"), F.when(key % 4 == 1, real(total)).when(key % 4 == 2, real(tax)).alias("total"),
    )
    lines = stored(with_zones(index_lines(docs)))
    found = A.amount_candidates(lines)
    df = docs.drop("text").join(R.keyword_extremes(found), "doc_id", "left").join(A.words_total(lines), "doc_id", "left").join(R.tax_breakdown(lines), "doc_id", "left")
    for part in ("cgst", "sgst", "igst"):
        df = df.withColumn(part, F.lit(None).cast("double"))
    out = R.align_taxable(R.reconcile_components(R.repair_amounts(R.hydrate_amounts(df))))
    return out.select("doc_id", *[F.round(c).cast("long").alias(c) for c in ("subtotal", "taxable", "tax", "total", "breakdown_tax", "kw_total", "kw_tax_least")])


AMOUNT_REPAIR = """
SELECT o_orderkey AS doc_id, net AS subtotal, net AS taxable, net * 18 // 100 AS tax, net + net * 18 // 100 AS total, net * 18 // 100 AS breakdown_tax,
       net + net * 18 // 100 AS kw_total, net * 18 // 100 AS kw_tax_least
FROM (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) + 2000 AS net FROM orders)
"""


# --- repairs from the text ---------------------------------------------------------------------------------------------


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a document for every supplier whose fields stand under labels all over it."""
    k = F.col("s_suppkey")
    text = F.concat_ws(
        "\n",
        vendor_name(k), F.lit("Plot 44 Industrial Estate"), _text("Email: Info", k, "@Vendor.com"), _text("Web www.vendor", k, ".com"), _text("Phone 98", _pad(k, 8)),
        _text("GSTIN: ", gstin_of(k)), _text("CIN L12345TG2001PLC", _pad(k, 6)), F.lit("Bill To"), buyer_name(k), F.lit("12 Lake Road"), F.lit("Hyderabad 500001"),
        _text("GSTIN: ", gstin_of(k + 7_000)), F.lit("Transporter Name: Speedy Roadlines"), F.lit("Dispatched Through: By Road"), F.lit("Destination: Kota"),
        F.lit("Place of Supply: Telangana"), _text("Terms of Payment: ", k % 60 + 1, " days"), _text("IRN ", F.sha2(k.cast("string"), 256)),
        _text("Ack No: 1220", _pad(k, 10)), _text("E-Way Bill 4321 ", _pad(k, 4), " 8765"), F.lit("Bank Details: State Bank of India"),
        _text("A/C No: 300", _pad(k, 9)), _text("IFSC SBIN", "0", _pad(k, 6)), F.lit("Declaration: all is true"),
    )
    return table(spark, sf_dir, "supplier").select(k.alias("doc_id"), text.alias("text"))


def text_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact, bank, transport and buyer of every supplier's document, from its text alone."""
    lines = stored(with_zones(index_lines(_papers(spark, sf_dir))))
    df = R.with_all_fields(R.sections(lines).join(R.buyer_blocks(lines), "doc_id", "left"))
    out = R.repair_buyer(R.repair_transport(R.repair_bank(R.repair_contact(df))))
    out = out.join(R.buyer_addresses(lines).withColumnRenamed("buyer_address", "block_address"), "doc_id", "left")
    out = out.join(R.joined_matches(lines, r"\b\d{6}\b", "six_digits"), "doc_id", "left")
    names = ("vendor_name", "vendor_gstin", "vendor_email", "vendor_website", "vendor_phone", "vendor_cin", "bank_name", "account_number", "ifsc_code", "transporter_name")
    return out.select("doc_id", *names, "dispatch_through", "destination", "buyer_name", "buyer_gstin", "buyer_address", "block_address", "six_digits")


PAPERS = f"""
SELECT k AS doc_id, 'VENDOR ' || {letters('k')} || ' INDUSTRIES LIMITED' AS vendor_name, {gstin('k')} AS vendor_gstin, 'info' || k || '@vendor.com' AS vendor_email,
       'www.vendor' || k || '.com' AS vendor_website, '98' || lpad(CAST(k AS VARCHAR), 8, '0') AS vendor_phone, 'L12345TG2001PLC' || lpad(CAST(k AS VARCHAR), 6, '0') AS vendor_cin,
       'State Bank of India' AS bank_name, '300' || lpad(CAST(k AS VARCHAR), 9, '0') AS account_number, 'SBIN0' || lpad(CAST(k AS VARCHAR), 6, '0') AS ifsc_code,
       'Speedy Roadlines' AS transporter_name, 'By Road' AS dispatch_through, 'Kota' AS destination, 'CLIENT ' || {letters('k', 6)} || ' RETAIL SOLUTIONS LLP' AS buyer_name,
       {gstin('(k + 7000)')} AS buyer_gstin, '12 Lake Road, Hyderabad 500001' AS buyer_address, '12 Lake Road, Hyderabad 500001' AS block_address, '500001' AS six_digits
FROM (SELECT s_suppkey AS k FROM supplier)
"""


def supplemental_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled and shaped fields of every supplier's document."""
    out = S.supplemental(with_zones(index_lines(_papers(spark, sf_dir))))
    return out.select("doc_id", "transporter_name", "dispatch_through", "destination", "place_of_supply", "payment_terms", "irn", "ack_number", "eway_bill", "vendor_cin", "bank_details")


SUPPLEMENTAL = """
SELECT k AS doc_id, 'Speedy Roadlines' AS transporter_name, 'By Road' AS dispatch_through, 'Kota' AS destination, 'Telangana' AS place_of_supply,
       (k % 60 + 1) || ' days' AS payment_terms, sha256(CAST(k AS VARCHAR)) AS irn, '1220' || lpad(CAST(k AS VARCHAR), 10, '0') AS ack_number,
       '4321 ' || lpad(CAST(k AS VARCHAR), 4, '0') || ' 8765' AS eway_bill, 'L12345TG2001PLC' || lpad(CAST(k AS VARCHAR), 6, '0') AS vendor_cin,
       'Bank Details: State Bank of India A/C No: 300' || lpad(CAST(k AS VARCHAR), 9, '0') || ' IFSC SBIN0' || lpad(CAST(k AS VARCHAR), 6, '0') AS bank_details
FROM (SELECT s_suppkey AS k FROM supplier)
"""


def record_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records of every supplier after the final cleaning of all fields: labels, swapped and inflated values put right."""
    k = F.col("s_suppkey")
    net = (k % 9_000 + 1_000).cast("double")
    df = table(spark, sf_dir, "supplier").select(
        k.alias("doc_id"), _text("#INV-", _pad(k, 5), ".").alias("invoice_number"), F.lit("05-Jan-2024").alias("invoice_date"), F.lit("31/31/2024").alias("po_date"),
        vendor_name(k).alias("vendor_name"), F.concat(F.lit("Bill To: "), buyer_name(k)).alias("buyer_name"), gstin_of(k).alias("vendor_gstin"), gstin_of(k + 7_000).alias("buyer_gstin"),
        _text("PO_", k, "/24").alias("po_number"), F.lit("Transporter: Speedy Roadlines").alias("transport_details"), _text("State Bank of India A/C No 300", _pad(k, 9)).alias("bank_details"),
        F.lit("Our Bank").alias("bank_name"), _text("+91-98", _pad(k, 8)).alias("vendor_phone"), F.lit("12 Lake Road, Hyderabad 500001 GSTIN 36").alias("buyer_address"),
        F.lit("12 Lake Road, Hyderabad 500001").alias("vendor_address"), (net * 1.18).alias("taxable"), net.alias("subtotal"), F.round(net * 0.09, 2).alias("cgst"),
        F.round(net * 0.09, 2).alias("sgst"), F.lit(-5.0).alias("tax"),
    )
    out = R.fill_missing(R.clean_fields(df, as_of()))
    names = ("invoice_number", "invoice_date", "po_date", "vendor_name", "buyer_name", "po_number", "transporter_name", "bank_name", "account_number", "vendor_phone", "vendor_pan")
    return out.select("doc_id", *names, "state_code", "buyer_address", "pincode", "currency", F.col("irn").alias("irn"), *[F.col(c).cast("double").cast("decimal(18,2)").cast("string").alias(c) for c in ("subtotal", "taxable", "tax", "total")])


RECORDS = f"""
SELECT k AS doc_id, 'INV-' || lpad(CAST(k AS VARCHAR), 5, '0') AS invoice_number, '05-Jan-2024' AS invoice_date, 'NOT_MENTIONED' AS po_date,
       'VENDOR ' || {letters('k')} || ' INDUSTRIES LIMITED' AS vendor_name, 'CLIENT ' || {letters('k', 6)} || ' RETAIL SOLUTIONS LLP' AS buyer_name, 'PO' || k || '/24' AS po_number,
       'Speedy Roadlines' AS transporter_name, 'State Bank of India' AS bank_name, '300' || lpad(CAST(k AS VARCHAR), 9, '0') AS account_number,
       '+91 98' || lpad(CAST(k AS VARCHAR), 8, '0') AS vendor_phone, substr({gstin('k')}, 3, 10) AS vendor_pan, substr({gstin('(k + 7000)')}, 1, 2) AS state_code,
       'NOT_MENTIONED' AS buyer_address, '500001' AS pincode, 'INR' AS currency, 'NOT_MENTIONED' AS irn, net || '.00' AS subtotal, net || '.00' AS taxable,
       CAST(CAST(2 * (net * 9) / 100.0 AS DECIMAL(18, 2)) AS VARCHAR) AS tax, CAST(CAST(net + 2 * (net * 9) / 100.0 AS DECIMAL(18, 2)) AS VARCHAR) AS total
FROM (SELECT s_suppkey AS k, s_suppkey % 9000 + 1000 AS net FROM supplier)
"""


# --- items -------------------------------------------------------------------------------------------------------------


def item_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose quantity or rate was misread or lost, completed from what is left, scored and freed of noise."""
    items = order_lines(spark, sf_dir)
    number = F.col("l_linenumber")
    amount, rate, quantity = F.col("cents") / 100, F.col("price") / 100, F.col("quantity").cast("double")
    df = items.select(
        F.col("o_orderkey").alias("doc_id"), number.cast("int").alias("item_no"), F.concat(F.lit("3. "), F.col("name"), F.lit(" |")).alias("description"), "hsn",
        F.when(number % 4 == 0, quantity).when(number % 4 == 1, amount * 2).when(number % 4 == 2, quantity + 7).alias("quantity"),
        F.when(number % 4 == 0, F.lit(None)).otherwise(rate).alias("unit_price"), amount.alias("amount"),
    )
    df = stored(df)  # Read three times below.
    noise = df.where("item_no = 1").select("doc_id", F.lit(99).alias("item_no"), F.lit("Total tax amount").alias("description"), "hsn", "quantity", "unit_price", "amount")
    totals = df.groupBy("doc_id").agg(F.sum("amount").alias("subtotal")).withColumn("total", F.col("subtotal") * 2)
    out = L.precise_items(L.complete_items(df.unionByName(noise)), totals)
    return out.select("doc_id", "item_no", "description", F.round("quantity").cast("long").alias("quantity"), F.round(F.col("unit_price") * 100).cast("long").alias("price_cents"), "item_score")


ITEM_REPAIR = f"""
WITH {ITEMS}
SELECT k AS doc_id, CAST(ln AS INTEGER) AS item_no, name AS description, q AS quantity, price AS price_cents,
       CAST(30 + CASE WHEN len(string_split(name, ' ')) >= 3 THEN 20 ELSE 0 END + 15 + 15 + 10 - CASE WHEN contains(lower(name), 'code') THEN 20 ELSE 0 END AS INTEGER) AS item_score
FROM items
"""


def structured_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item tables whose cells stand between bars, from the rows of every order, by their cells and by the fallback."""
    row = F.concat_ws(" | ", "l_linenumber", "name", "hsn", F.col("quantity").cast("string"), money(F.col("price")), money(F.col("cents")))
    items = order_lines(spark, sf_dir).groupBy("o_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("t")))), lambda x: x["t"]), "\n").alias("rows"))
    text = F.concat_ws("\n", F.lit("Acme Traders"), F.lit("No | Description | HSN | Qty | Rate | Amount"), F.col("rows"), F.lit("Taxable Value"), F.lit("Grand Total"))
    lines = stored(with_zones(index_lines(items.select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))))
    found = L.structured_items(lines).join(L.has_taxable_column(lines), "doc_id")
    cents = lambda c, n: F.round(F.col(c) * 100).cast("long").alias(n)
    return found.select("doc_id", "item_no", "description", "hsn", F.round("quantity").cast("long").alias("quantity"), cents("unit_price", "price_cents"), cents("amount", "amount_cents"), "has_taxable")


STRUCTURED = f"""
WITH {ITEMS}
SELECT k AS doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY ln) AS INTEGER) AS item_no, name AS description, hsn, q AS quantity, price AS price_cents,
       q * price AS amount_cents, false AS has_taxable
FROM items
"""


def fallback_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of every order's rows in a text without a table header."""
    row = F.concat_ws(" ", "name", "hsn", F.col("quantity").cast("string"), money(F.col("price")), money(F.col("cents")))
    items = order_lines(spark, sf_dir).groupBy("o_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("t")))), lambda x: x["t"]), "\n").alias("rows"))
    text = F.concat_ws("\n", F.lit("Acme Traders"), F.lit("Bank of nowhere"), F.col("rows"), F.lit("Grand Total"), F.lit("Thank you"))
    lines = stored(with_zones(index_lines(items.select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))))
    found = L.best_sections(lines)
    return found.select("doc_id", "item_no", "description", F.col("quantity").cast("long").alias("quantity"), F.round(F.col("amount") * 100).cast("long").alias("amount_cents"))


FALLBACK = f"""
WITH {ITEMS}
SELECT k AS doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY ln) AS INTEGER) AS item_no, name AS description, q AS quantity, q * price AS amount_cents
FROM items
"""


# --- templates ---------------------------------------------------------------------------------------------------------


def template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every invoice read by the places that the template of its own layout gives, learnt from the invoices themselves."""
    docs = stored(invoices(spark, sf_dir))
    lines = stored(with_zones(index_lines(docs)))
    signed = stored(M.signatures(lines))
    # Read for the records and for their places: tables, so that each is made once and no plan holds them all.
    labelled, numbers, amounts = (stored(c) for c in (N.header_candidates(lines, as_of()), N.gstin_candidates(lines), A.amount_candidates(lines)))
    read = N.read_invoices(docs, lines, as_of(), scanned=False, itemised=False, found=(labelled, numbers, amounts))
    records = stored(M.quality(read).select("doc_id", "confidence", "vendor_name", "vendor_gstin", "invoice_number", "total", "quality_score"))
    where = labelled.groupBy("doc_id", "field").agg(F.min(F.struct((-F.col("score")).alias("s"), "line_no"))["line_no"].alias("line_no"))
    sides = numbers.select("doc_id", F.when(F.col("buyer_distance") < 18, "buyer_gstin").otherwise("vendor_gstin").alias("field"), "line_no")
    sums = amounts.where("usable")
    kinds = [sums.where(c).select("doc_id", F.lit(f).alias("field"), "line_no") for c, f in (("on_subtotal", "subtotal"), ("on_tax and not on_subtotal and not on_total", "tax"), ("starts_total or on_total and not on_subtotal", "total"))]
    for part in (sides, *kinds):
        where = where.unionByName(part.groupBy("doc_id", "field").agg(F.min("line_no").alias("line_no")))
    fields = stored(M.template_fields(lines, where))
    store = stored(M.learn(spark.createDataFrame([], M.TEMPLATE_SCHEMA), records.join(signed, "doc_id").join(fields, "doc_id")))
    matched = M.lookup(signed, store).where("template_id is not null").join(store.select("template_id", "field_positions"), "template_id")
    out = M.extract_by_template(lines, stored(matched), as_of())
    family = M.family_matches(store, records.select("doc_id", "vendor_gstin").join(fields, "doc_id"))
    out = out.join(family.select("doc_id", F.lit(True).alias("family")), "doc_id", "left")
    cents = lambda c: F.round(F.col(c) * 100).cast("long").alias(f"{c}_cents")
    return out.select("doc_id", "invoice_number", "vendor_name", "vendor_gstin", "buyer_gstin", cents("subtotal"), cents("total"), F.coalesce("family", F.lit(False)).alias("family"))


TEMPLATE_FIELDS = f"""
WITH {ITEMS}
SELECT k AS doc_id, 'INV' || lpad(CAST(k AS VARCHAR), 7, '0') AS invoice_number, 'VENDOR ' || {letters('s')} || ' INDUSTRIES LIMITED' AS vendor_name,
       {gstin('s')} AS vendor_gstin, {gstin('(c + 5000)')} AS buyer_gstin, sub AS subtotal_cents, sub + 2 * half AS total_cents, true AS family
FROM inv
"""


# --- invoices without labels -------------------------------------------------------------------------------------------


def unlabelled_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number by frequency, vendor by its tax number's place and buyer by its block, where the usual labels are missing."""
    k = F.col("s_suppkey")
    text = F.concat_ws(
        "\n",
        F.lit("Original"), vendor_name(k), F.lit("Plot 44 Industrial Estate"), _text("GSTIN ", gstin_of(k)), _text("Doc AB", _pad(k, 5)), F.lit("Dated 05-Jan-2024"),
        _text("Ref AB", _pad(k, 5), " and XY77"), F.lit("Billed To"), buyer_name(k), F.lit("12 Lake Road, Hyderabad 500001"), _text("GSTIN ", gstin_of(k + 7_000)),
    )
    lines = stored(with_zones(index_lines(table(spark, sf_dir, "supplier").select(k.alias("doc_id"), text.alias("text")))))
    pair = N.gstin_pair(N.gstin_candidates(lines))
    found = N.frequent_number_candidates(lines).unionByName(N.near_gstin_candidates(lines, pair)).unionByName(N.buyer_block_names(lines))
    return pair.join(N.ranked_fields(found, ("invoice_number", "vendor_name", "buyer_name")), "doc_id")


UNLABELLED = f"""
SELECT k AS doc_id, {gstin('k')} AS vendor_gstin, {gstin('(k + 7000)')} AS buyer_gstin, 'AB' || lpad(CAST(k AS VARCHAR), 5, '0') AS invoice_number,
       'VENDOR ' || {letters('k')} || ' INDUSTRIES LIMITED' AS vendor_name, 'CLIENT ' || {letters('k', 6)} || ' RETAIL SOLUTIONS LLP' AS buyer_name
FROM (SELECT s_suppkey AS k FROM supplier)
"""


def record_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure records of four kinds are: whole, without a total, with parties that coincide, with amounts that disagree;
    and which reading of two wins."""
    k = F.col("s_suppkey")
    real = lambda v: F.lit(v).cast("double")
    method = _choose(k, ("zone-keyword", "zone-keyword", "regex", "priority"))
    df = table(spark, sf_dir, "supplier").select(
        k.alias("doc_id"), F.lit("INV-001").alias("invoice_number"), F.lit("05-Jan-2024").alias("invoice_date"), vendor_name(k).alias("vendor_name"), gstin_of(k).alias("vendor_gstin"),
        F.when(k % 4 == 2, vendor_name(k)).otherwise(buyer_name(k)).alias("buyer_name"), F.when(k % 4 == 2, gstin_of(k)).otherwise(gstin_of(k + 7_000)).alias("buyer_gstin"),
        F.lit("12 Lake Road, Hyderabad 500001").alias("buyer_address"), F.lit(None).cast("string").alias("vendor_address"), real(1000).alias("subtotal"),
        F.when(k % 4 == 3, real(500)).otherwise(real(180)).alias("tax"), F.when(k % 4 != 1, real(1180)).alias("total"), F.lit(None).cast("array<string>").alias("line_items"),
        *[(method if f != "line_items" else F.lit(None).cast("string")).alias(f"{f}_method") for f, _ in N.METHOD_WEIGHTS],
        F.lit("X1").alias("g_invoice_number"), F.lit("05-01-2024").alias("g_invoice_date"), real(9000).alias("g_total"), F.lit(None).cast("string").alias("g_vendor_name"),
        buyer_name(k).alias("g_buyer_name"), gstin_of(k).alias("g_vendor_gstin"), gstin_of(k + 7_000).alias("g_buyer_gstin"),
    )
    sure = N.method_confidence(df, as_of()).select("*", F.round(N.quality_cap(as_of()), 2).alias("cap"), F.round(N.conflict_penalty(as_of()), 2).alias("penalty"))
    better = R.prefer_core(R.prefer_identity(sure), as_of())
    scrubbed = S.scrub_identity(sure.select("doc_id", "vendor_gstin", "buyer_gstin", "vendor_name", "buyer_name")).select("doc_id", F.col("buyer_name").isNull().alias("buyer_scrubbed"))
    out = better.join(scrubbed, "doc_id")
    return out.select("doc_id", "confidence", "cap", "penalty", "buyer_gstin", "invoice_number", "invoice_date", F.col("total").cast("long").alias("total"), "buyer_scrubbed", R.is_valid_total(F.col("total"), F.lit(1180.0)).alias("valid_total"))


#: Weights of all methods but the items' add up to 0.92; a whole record has 0.38 points of format and agreement more.
CONFIDENCE = f"""
SELECT k AS doc_id, CAST(CASE k % 4 WHEN 0 THEN least(0.94 * 0.92 + 0.48, 1.0) WHEN 1 THEN 0.60 WHEN 2 THEN round(0.66 * 0.92 + 0.48 - 0.20, 4) ELSE 0.74 END AS DOUBLE) AS confidence,
       CAST(CASE k % 4 WHEN 1 THEN 0.60 WHEN 3 THEN 0.74 ELSE 1.0 END AS DOUBLE) AS cap, CAST(CASE k % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.16 WHEN 2 THEN 0.20 ELSE 0.16 END AS DOUBLE) AS penalty,
       {gstin('(k + 7000)')} AS buyer_gstin, 'INV-001' AS invoice_number, '05-01-2024' AS invoice_date, CASE WHEN k % 4 = 1 THEN 9000 ELSE 1180 END AS total,
       k % 4 = 2 AS buyer_scrubbed, k % 4 <> 1 AS valid_total
FROM (SELECT s_suppkey AS k FROM supplier)
"""


# --- text and validation -----------------------------------------------------------------------------------------------


def damaged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of cards, invoices and certificates with misread letters, broken labels and torn words, put right."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("RAVI "), F.translate(F.translate(F.lpad(k.cast("string"), 6, "0"), "0123456789", "BCDFGHJKLM"), "BCDFGHJ", "AEIOURN"), F.lit(" DEVA"))
    card = F.concat_ws("\n", F.lit("60VT OF INDIA"), F.lower(name), F.lit("D0B: O1/O2/199O"), F.lit("   "), _text("  ", F.translate(aadhaar_of(k), "0158", "OISB")))
    invoice = _text("Invoice–No:  ", k, "\t\tAmount 1,  234.00\n\n\n-----\nTotal")
    medical = _text("I ceftify   that M r s Ravi ", k, " is in medicai care")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", T.clean_id_text(card).alias("card"), T.restore_labels(F.lit("FATHER'5 G0VT")).alias("labels"), T.join_spaced_letters(F.lit("M r s Rao")).alias("joined"),
        T.correct_words(T.clean_medical_text(medical)).alias("medical"), T.truncate_at(_text("Acme ", k, " Dated today"), ("dated", "gstin")).alias("cut"),
        T.collapse_repeats(_text("A ", k, ", B, a-", k, ", b")).alias("once"), T.redact(_text("call Z Q ", k), F.array(F.lit("ZQ"))).alias("masked"),
        T.is_numeric_token(_text("1O", _pad(k, 3))).alias("numeric"), F.size(T.fragments(_text("left ", k, " | right"), (("dated",),))).alias("n_fragments"),
        F.regexp_count(T.clean_invoice_text(invoice), F.lit("1,234")).alias("joined_amounts"),
    )


DAMAGED = f"""
SELECT k AS c_custkey, 'GOVT OF INDIA' || chr(10) || {CARD_NAME} || chr(10) || 'DOB: 01/02/1990' || chr(10) || number AS card, 'FATHER''S GOVT' AS labels, 'Mrs Rao' AS joined,
       'I certify that Mrs Ravi ' || k || ' is in medical care' AS medical, 'Acme ' || k AS cut, 'A ' || k || ', B' AS once, 'call  ###  ' || k AS masked, true AS numeric,
       3 AS n_fragments, 1 AS joined_amounts
FROM (SELECT c_custkey AS k, number FROM {check_digit('customer', 'c_custkey')})
"""


def validation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many faults each field of every customer's record has, one kind of fault for each remainder of the key."""
    k = F.col("c_custkey")
    good = aadhaar_of(k)
    wrong = F.concat(F.substring(good, 1, 11), ((F.substring(good, 12, 1).cast("int") + 1) % 10).cast("string"))
    number = F.when(k % 4 == 0, good).when(k % 4 == 1, wrong).when(k % 4 == 2, F.lit("12"))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("int")
    sizes = {
        "aadhaar": Q.aadhaar_errors(number), "pan": Q.pan_errors(_choose(k, ("ABCPZ1234Q", "AB", None))), "licence": Q.licence_errors(_choose(k, ("TS0920150001234", "TS", None))),
        "dob": Q.birth_date_errors(_choose(k, ("01/02/1990", "99/99/1990", None))), "date": Q.optional_date_errors(_choose(k, ("01/02/1990", "x", None)), "Valid from"), "name": Q.name_errors(_choose(k, ("Ravi", "R", None)), "Name"),
    }
    every = Q.all_errors(*sizes.values())
    return table(spark, sf_dir, "customer").select("c_custkey", *[count(v).alias(n) for n, v in sizes.items()], count(every).alias("together"))


VALIDATION = """
SELECT *, aadhaar + pan + licence + dob + date + name AS together
FROM (SELECT c_custkey, CAST((c_custkey % 4 <> 0) AS INTEGER) AS aadhaar, CAST((c_custkey % 3 <> 0) AS INTEGER) AS pan, CAST((c_custkey % 3 <> 0) AS INTEGER) AS licence,
             CAST((c_custkey % 3 <> 0) AS INTEGER) AS dob, CAST((c_custkey % 3 = 1) AS INTEGER) AS date, CAST((c_custkey % 3 <> 0) AS INTEGER) AS name FROM customer)
"""


def reading_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each telling word stands in every document, and how many of its lines are garbage."""
    c = F.lower("text")
    words = {w: ocr.keyword_count(c, w).alias(f"n_{w.replace(' ', '_')}") for w in ("invoice", "amount", "rate", "dated", "quantity")}
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", *words.values(), ocr.garbage_lines(F.col("text")).alias("garbage"), ocr.pattern_count(F.col("text"), "[0-9]{2,}").cast("int").alias("numbers"))


READING = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS lo FROM documents)
SELECT doc_id, """ + ", ".join(f"CAST((length(lo) - length(replace(lo, '{w}', ''))) // {len(w)} AS INTEGER) AS n_{w}" for w in ("invoice", "amount", "rate", "dated", "quantity")) + r""",
       CAST(len([x for x in [trim(y) for y in string_split(t, chr(10))] if x <> '' AND length(regexp_replace(x, '[^\p{L}\p{Nd}]', '', 'g')) < greatest(3, length(x) // 3)]) AS INTEGER) AS garbage,
       CAST(len(regexp_extract_all(t, '[0-9]{2,}')) AS INTEGER) AS numbers
FROM t
"""


def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the other keyword families and rules of lines, how many lines of a document they fit."""
    from docloom.functions import predicates as P

    lines = plain_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    form = P.folded(F.col("text"))
    lines = lines.withColumn("folded", form)
    fits = lambda c, n: F.count(F.when(c, 1)).alias(n)
    held = lambda words: P.holds_any(F.col("folded"), words)
    t = F.col("text")
    return lines.groupBy("doc_id").agg(
        fits(held(P.LOGISTICS + P.BUYER_STOP), "logistics"), fits(held(P.HEADER_NOISE), "noise"), fits(held(P.NON_ITEM), "non_item"), fits(P.is_tax_line(t), "tax"),
        fits(held(P.AMOUNT_IGNORE + P.BANK), "ignored"), fits(P.is_table_header(t), "headers"), fits(P.is_address_like(t), "addresses"),
    )


def _line_predicates_sql() -> str:
    from docloom.functions import predicates as P
    from docloom.plans.oracles import LINES, contains_any

    table_words = [k for k in P.TABLE_HEADER if k not in P.TABLE_HEADER_WEAK]
    hits = lambda words: " + ".join(f"CAST(contains(lo, {quoted(k)}) AS INTEGER)" for k in words)
    family = lambda words: contains_any(words)[len("count(*) FILTER ("):-1]
    tax = f"(NOT contains(lo, 'taxable') AND ({family(P.TAX)} OR (contains(lo, '%') AND ({family(('igst', 'cgst', 'sgst', 'gst'))}))))"
    address = rf"(regexp_matches(lo, '\b[0-9]{{5,6}}\b') OR contains(lo, '@') OR contains(lo, 'www.') OR contains(lo, 'http') OR ah >= 2 OR (ah = 1 AND (contains(lo, ',') OR regexp_matches(lo, '[0-9]'))))"
    return rf"""
WITH {LINES}, c AS (
  SELECT doc_id, lower(t) AS lo, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS co,
         translate(regexp_replace(regexp_replace(lower(t), '\b[0-9][0-9.,]*\b', ' ', 'g'), '[^a-z0-9]', '', 'g'), '{P.KEYWORD_LOOKALIKES[0]}', '{P.KEYWORD_LOOKALIKES[1]}') AS fo
  FROM l), d AS (SELECT *, {hits(table_words)} AS th, {hits(P.ADDRESS)} AS ah FROM c)
SELECT doc_id, {contains_any(P.LOGISTICS + P.BUYER_STOP)} AS logistics, {contains_any(P.HEADER_NOISE)} AS noise, {contains_any(P.NON_ITEM)} AS non_item,
       count(*) FILTER ({tax}) AS tax, {contains_any(P.AMOUNT_IGNORE + P.BANK)} AS ignored, count(*) FILTER (th >= 2) AS headers, count(*) FILTER ({address}) AS addresses
FROM d GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        field_cleaning, amount_repair, text_repairs, supplemental_fields, record_cleaning, item_repair, structured_rows, fallback_items, template_extraction,
        unlabelled_invoices, record_confidence, damaged_texts, validation_messages, reading_quality, line_predicates,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "field_cleaning": FIELDS, "amount_repair": AMOUNT_REPAIR, "text_repairs": PAPERS, "supplemental_fields": SUPPLEMENTAL, "record_cleaning": RECORDS,
        "item_repair": ITEM_REPAIR, "structured_rows": STRUCTURED, "fallback_items": FALLBACK, "template_extraction": TEMPLATE_FIELDS,
        "unlabelled_invoices": UNLABELLED, "record_confidence": CONFIDENCE, "damaged_texts": DAMAGED, "validation_messages": VALIDATION,
        "reading_quality": READING, "line_predicates": _line_predicates_sql(),
    }
