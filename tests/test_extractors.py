import pytest
from pyspark.sql import functions as F

from docloom.functions.identifiers import gstin_check_digit, verhoeff_digit
from docloom.operators.amounts import amount_candidates, reconstruct, summary
from docloom.operators.classify import classify
from docloom.operators.idcards import extract_id_cards
from docloom.operators.invoice import extract_invoices
from docloom.operators.lineitems import line_items
from docloom.operators.lines import combined_text, index_lines, page_roles, take_while_open, with_zones
from docloom.operators.medical import extract_certificates
from docloom.operators.merge import merge_passes

def as_of():
    return F.lit("2027-01-01").cast("date")


@pytest.fixture(scope="module")
def make(spark):
    """Numbers that check, made here."""

    def one(function, body):
        return body + spark.range(1).select(function(F.lit(body))).first()[0]

    return {"gstin": lambda b: one(gstin_check_digit, b), "aadhaar": lambda b: one(verhoeff_digit, b)}


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def invoice(make, number="INVX1023", date="05-Apr-2026", qty=5, rate=3000):
    total = qty * rate
    return f"""FIRST MADE INDUSTRIES PRIVATE LIMITED
Plot 44 Industrial Estate
GSTIN: {make["gstin"]("29ZZZZZ0001Z1Z")}
Tax Invoice
Invoice No: {number}
Date: {date}

Ship To
SECOND MADE SOLUTIONS LLP
21 Market Street
GSTIN: {make["gstin"]("27ZZZZZ0002Z1Z")}

Item Description Qty Rate Amount
Steel Cabinet {qty} {rate} {total}
Taxable Value {total}
CGST 9% {total * 9 // 100}
SGST 9% {total * 9 // 100}
Grand Total {total * 118 // 100}
Amount Payable {total * 118 // 100}
Bank Details: Some Bank A/C 123456789012
"""


def test_invoice_of_one_column(spark, make):
    r = extract_invoices(docs(spark, invoice(make)), as_of()).first()
    assert (r.invoice_number, r.invoice_date, r.vendor_name, r.buyer_name) == ("INVX1023", "05-Apr-2026", "FIRST MADE INDUSTRIES PRIVATE LIMITED", "SECOND MADE SOLUTIONS LLP")
    assert (r.vendor_gstin[:2], r.buyer_gstin[:2]) == ("29", "27")
    assert (r.subtotal, r.tax, r.total) == (15000, 2700, 17700)
    assert [(i.description, i.quantity, i.unit_price, i.amount) for i in r.line_items] == [("Steel Cabinet", 5, 3000, 15000)]
    assert r.status == "SUCCESS" and r.confidence > 0.75


def test_only_total_labelled_and_nothing_at_all(spark):
    text = "SOME INDUSTRIES LIMITED\nInvoice No: A-77\nDated 01-Feb-2026\nSome goods 11800\nBase 10000\nIGST 18% 1800\nGrand Total 11800"
    rows = {r.doc_id: r for r in extract_invoices(docs(spark, text, "", None), as_of()).collect()}
    assert (rows[0].subtotal, rows[0].tax, rows[0].total) == (10000, 1800, 11800)
    assert rows[1].status == rows[2].status == "FAILED" and rows[1].total is None


def test_subtotal_from_total_less_tax(spark):
    lines = with_zones(index_lines(docs(spark, "x\nValue 19,680.00\nIGST 4,320.00\nGrand Total 24,000.00", "x\nTaxable Value 20,000.00\nIGST 4,000.00\nGrand Total 24,000.00")))
    out = {r.doc_id: (r.subtotal, r.tax, r.total) for r in summary(amount_candidates(lines)).collect()}
    assert out == {0: (19680.0, 4320.0, 24000.0), 1: (20000.0, 4000.0, 24000.0)}
    totals = spark.createDataFrame([(0, 24000.0), (1, 24000.0)], "doc_id long, total double")
    assert {r.doc_id: (r.subtotal, r.tax) for r in reconstruct(amount_candidates(lines), totals).collect()} in ({1: (20000.0, 4000.0)}, {}, {0: (19680.0, 4320.0)}, {0: (19680.0, 4320.0), 1: (20000.0, 4000.0)})


def test_items_over_several_lines(spark, make):
    text = invoice(make).replace("Steel Cabinet 5 3000 15000", "Steel Cabinet 9403 5 2000.00 10000.00\nwith two doors\nWood Table 9404 2 2500.00 5000.00")
    items = line_items(with_zones(index_lines(docs(spark, text)))).orderBy("item_no").collect()
    assert [(i.description, i.hsn, i.quantity, i.unit_price, i.amount) for i in items] == [
        ("Steel Cabinet with two doors", "9403", 5, 2000, 10000), ("Wood Table", "9404", 2, 2500, 5000),
    ]


def test_columns_pages_and_zones(spark):
    text = "left one     right one\nfull line\n\n\fsecond page"
    rows = index_lines(docs(spark, text, None)).orderBy("line_no").collect()
    assert [(r.line_no, r.page_no, r.text, r.x, r.y, r.col) for r in rows] == [
        (1, 1, "left one", 0, 0, "LEFT"), (2, 1, "right one", 104, 0, "RIGHT"), (3, 1, "full line", 0, 22, "FULL"), (4, 2, "second page", 0, 10_000, "FULL"),
    ]
    zoned = with_zones(index_lines(docs(spark, "\n".join(f"line {i}" for i in range(1, 101))))).collect()
    assert sum(r.in_top for r in zoned) == 25 and sum(r.in_bottom for r in zoned) == 30
    assert {r.zone for r in zoned} == {"TOP", "MIDDLE", "BOTTOM"} and sum(r.in_middle for r in zoned) == 45
    opened = take_while_open(index_lines(docs(spark, "a\nstart\nb\nc\nstop\nd")), F.col("text") == "start", F.col("text") == "stop", "open")
    assert [r.text for r in opened.where("open").orderBy("line_no").collect()] == ["b", "c"]


def test_pages_and_passes(spark):
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, " "), (2, 1, "x")], "doc_id long, page_no int, text string")
    assert {r.doc_id: r.text for r in combined_text(pages).collect()} == {1: "a\fb", 2: "x"}
    assert sorted((r.doc_id, r.page_no, r.role) for r in page_roles(pages).collect()) == [(1, 1, "first"), (1, 2, "middle"), (1, 3, "last"), (2, 1, "only")]
    passes = spark.createDataFrame([(1, 1, 1, "NAME ' X1\nSOME LINE HERE"), (1, 1, 2, "NAME X1\nOTHER LINE HERE")], "doc_id long, page_no int, pass_no int, text string")
    assert merge_passes(passes).first().text == "NAME X1\nSOME LINE HERE\nOTHER LINE HERE"


def test_classifier_ties_and_unknown(spark):
    rows = classify(docs(spark, "VID PAN COV", "PAN COV", "nothing", None)).orderBy("doc_id").collect()
    assert [r.document_type for r in rows] == ["AADHAAR", "PAN", "UNKNOWN", "UNKNOWN"]


def test_id_cards(spark, make):
    number = make["aadhaar"]("23456789012")
    shown = f"{number[:4]} {number[4:8]} {number[8:]}"
    texts = (
        f"GOVERNMENT OF INDIA\nASHA RANI DEVA\nDOB: 01/02/1990\nFEMALE\n{number[:4]} {number[4:8]} {number[8:]}\nVID: 9123 4567 8901 2345\nADDRESS: S/O SOMEBODY\n12-3 TEST ROAD\n500001",
        "INCOME TAX DEPARTMENT\nGOVT OF INDIA\nMOHAN LALA DEVA\nARUN LALA DEVA\n03/04/1985\nPERMANENT ACCOUNT NUMBER\nABCPZ\n1234Q",
        "DRIVING LICENCE\nDL NO TS00920150001234\nNAME: ASHA RANI DEVA\nDOB: 05/06/1980\nVALID FROM: 01/02/2015\nSIGNATURE AUTHORITY",
        "SOMETHING ELSE",
    )
    r = extract_id_cards(docs(spark, *texts)).orderBy("doc_id").collect()
    assert (r[0].document_type, r[0].aadhaar_number, r[0].dob, r[0].gender, r[0].name, r[0].confidence) == ("AADHAAR", shown, "01/02/1990", "FEMALE", "ASHA RANI DEVA", "HIGH")
    assert r[0].address == "S/O SOMEBODY, 12-3 TEST ROAD, 500001" and r[0].validation_errors is None
    assert (r[1].document_type, r[1].pan_number, r[1].name, r[1].father_name, r[1].dob) == ("PAN", "ABCPZ1234Q", "MOHAN LALA DEVA", "ARUN LALA DEVA", "03/04/1985")
    assert (r[2].document_type, r[2].dl_number, r[2].name, r[2].valid_from, r[2].valid_to) == ("DRIVING_LICENSE", "TS00920150001234", "ASHA RANI DEVA", "01/02/2015", None)
    assert r[3].document_type == "UNKNOWN" and len(r[3].validation_errors) == 3 and r[3].confidence == "LOW"


def test_names_are_refined(spark):
    from docloom.operators.idcards import refine_name

    words = F.array(*[F.lit(w) for w in ("KUMAR", "MOHAN", "MOHAM")])
    got = spark.createDataFrame([("KUNAR MOHAN X",), (None,)], "n string").select(refine_name(F.col("n"), words)).collect()
    assert [r[0] for r in got] == ["KUMAR MOHAN X", None]


def pages(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts, 1)], "doc_id long, page_no int, text string")


def fields(df):
    r = df.first()
    return (r.organization_name, r.applicant_name, r.from_date, r.to_date, r.total_absent_days)


def test_certificates(spark):
    first = "CITY CARE HOSPITAL\nMedical Leave Certificate\nThis is to certify that Mr. Arun Deva is suffering from fever.\nHe is advised rest from 01/04/2026 to 05/04/2026."
    assert fields(extract_certificates(pages(spark, first, "Period of absence 5 days\nDoctor Signature"))) == ("CITY CARE HOSPITAL", "Arun Deva", "01-04-2026", "05-04-2026", "5")
    fit = "STATE DISPENSARY\nMEDICAL CERTIFICATE OF FITNESS TO RETURN TO DUTY\nShri/Smt/Kum A.DEVA (1628101) of Some Complex\nfit to resume duties from 31-Jan-2026"
    leave = "STATE DISPENSARY\nRECOMMENDED FOR LEAVE OR COMMUNICATION OF LEAVE\nShri/Smt/Kum A.DEVA (1628101) of Some Complex\nis suffering\nabsence from duty of 1\ndays with effect from 30-Jan-2026 to 30-Jan-2026 is necessary"
    assert fields(extract_certificates(pages(spark, fit, leave))) == ("STATE DISPENSARY", "A.DEVA", "30-01-2026", "30-01-2026", "1")
    assert fields(extract_certificates(pages(spark, "Recruitment\nCircular\nmandatory courses by 31.03.2026", None))) == (None,) * 5
    assert fields(extract_certificates(pages(spark, "Medical Certificate\nGOVERNMENT OF INDIA\nThis is to certify that @@##\nfrom 45/78/9999 to 99/99/9999\nperiod of absence XX days"))) == (None,) * 5


def test_supplemental_fields(spark):
    from docloom.operators.supplemental import merge_supplemental, scrub_identity, supplemental

    text = "\n".join([
        "SOME INDUSTRIES LIMITED", "Plot 7, Test Road 500001", "Dispatched through: Fast Roadlines Destination: Someplace", "Payment Terms", "30 days credit",
        "PO Date: 01-Feb-2026", "State Name: Telangana State Code: 36", "CGST 9% 1,350.00", "SGST 9% 1,350.00", "Round off 0.40",
        "Bank Details: First Bank", "A/C No 123456789012", "IFSC ABCD0123456", "Declaration", "CIN U12345TG2001ABC123456",
    ])
    r = supplemental(with_zones(index_lines(docs(spark, text)))).first()
    assert (r.dispatch_through, r.destination, r.payment_terms, r.po_date) == ("Fast Roadlines", "Someplace", "30 days credit", "01-Feb-2026")
    assert (r.state, r.state_code, r.cgst, r.sgst, r.igst, r.round_off) == ("Telangana", "36", 1350.0, 1350.0, None, 0.4)
    assert r.bank_details == "Bank Details: First Bank A/C No 123456789012 IFSC ABCD0123456"
    assert (r.vendor_cin, r.vendor_address) == ("U12345TG2001ABC123456", "Plot 7, Test Road 500001")
    record = spark.createDataFrame([(0, "short", None, "V", "v!", None, None)], "doc_id long, payment_terms string, state string, vendor_name string, buyer_name string, vendor_gstin string, buyer_gstin string")
    m = scrub_identity(merge_supplemental(record, supplemental(with_zones(index_lines(docs(spark, text)))))).first()
    assert (m.payment_terms, m.state, m.buyer_name) == ("30 days credit", "Telangana", None)
