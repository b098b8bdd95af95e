"""Repair of extracted invoices: amounts, contacts, bank, transport and buyer, and the final cleaning of every field.

A record is one row for each document. What a repair needs of the lines is one aggregate for each document, which is
joined once; the rules themselves are staged expressions over the record, in a fixed order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fields as C
from docloom.functions import identifiers as I
from docloom.functions import predicates as P
from docloom.functions import values as V
from docloom.functions.text import comparison_key, normalize_line
from docloom.operators.amounts import enforce_consistency

# --- Fixed values: where the buyer's block begins, what ends it, and what is passed over. ---
BUYER_START = r"(?i)bill(?:ed)? to|^buyer\b|details of (?:buyer|purchaser|recipient)|details of receiver \(billed to\)"
BUYER_END = r"(?i)description|hsn|qty|taxable|invoice amt|grand total|buyer'?s order|terms of delivery|dispatch doc"
BUYER_SKIP = r"(?i)bank|account|ifsc|transporter|bill of lading|lr-rr|delivery note date"
HEADER_END = r"(?i)bill(?:ed)? to|buyer|ship(?:ped)? to|consignee|description"
TAX_HEADER = r"(?i)tax rate|taxable.*tax|tax.*taxable|[ics]gstamt"
CIN = r"(?i)\b[LU]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}\b"
# --- End of fixed values. ---

MOST_BLOCK = 6


# --- amounts -----------------------------------------------------------------------------------------------------------


def tax_breakdown(lines: DataFrame) -> DataFrame:
    """(doc_id, breakdown_tax): below the first header of a tax table, the least amount of the first of two lines that has one."""
    seq = Window.partitionBy("doc_id").orderBy("line_no")
    amounts = F.transform(F.filter(V.amounts(F.col("text")), lambda a: ~a["percent"]), lambda a: a["value"].cast("double"))
    least = F.array_min(amounts)
    df = lines.select("doc_id", "line_no", F.col("text").rlike(TAX_HEADER).alias("head"), least.alias("least"))
    df = df.withColumns({"one": F.lead("least", 1).over(seq), "two": F.lead("least", 2).over(seq)}).where("head")
    found = df.where("one is not null or two is not null").groupBy("doc_id").agg(F.min(F.struct("line_no", F.coalesce("one", "two").alias("v")))["v"].alias("breakdown_tax"))
    return found


def keyword_extremes(candidates: DataFrame) -> DataFrame:
    """(doc_id, kw_total, kw_subtotal, kw_tax, kw_tax_least, summary_subtotal, summary_tax) of amount candidates.

    The largest usable amounts on lines of each keyword family, the smallest on tax lines; of the bottom zone the first
    subtotal line's largest amount, and the sum of each tax line's largest.
    """
    usable = candidates.where("usable")
    line = usable.groupBy("doc_id", "line_no").agg(
        F.max("value").alias("most"), F.min("value").alias("least"), *[F.bool_or(c).alias(c) for c in ("on_total", "on_subtotal", "on_tax", "in_bottom")]
    )
    most = lambda c: F.max(F.when(F.col(c), F.col("most")))
    return line.groupBy("doc_id").agg(
        most("on_total").alias("kw_total"),
        most("on_subtotal").alias("kw_subtotal"),
        most("on_tax").alias("kw_tax"),
        F.min(F.when(F.col("on_tax"), F.col("least"))).alias("kw_tax_least"),
        F.min(F.when(F.col("on_subtotal") & F.col("in_bottom"), F.struct("line_no", "most")))["most"].alias("summary_subtotal"),
        F.sum(F.when(F.col("on_tax") & F.col("in_bottom") & ~F.col("on_total"), F.col("most"))).alias("summary_tax"),
    )


def _exceeded(total: Column, *others: Column) -> Column:
    """Whether a total is missing, or no larger than one of the others."""
    return total.isNull() | reduce(lambda a, b: a | b, [F.coalesce(total <= o, F.lit(False)) for o in others])


def hydrate_amounts(df: DataFrame) -> DataFrame:
    """df (subtotal, taxable, tax, total, words_total and the columns of keyword_extremes) with missing amounts filled.

    Subtotal, taxable value and tax from the bottom summary, then from the keyword lines; a total that is missing, no
    larger than its parts or below 85 % of the keyword total gives way to that; an amount in words wins over a total that
    it is not roughly equal to; last, a total is the sum of its parts.
    """
    col = F.col
    df = df.withColumns({"subtotal": F.coalesce("subtotal", "summary_subtotal"), "taxable": F.coalesce("taxable", "summary_subtotal"), "tax": F.coalesce("tax", "summary_tax", "kw_tax")})
    weak = (col("subtotal").isNull() | F.coalesce(col("subtotal") >= col("total"), F.lit(False))) & col("kw_subtotal").isNotNull()
    df = df.withColumns({"subtotal": F.when(weak, col("kw_subtotal")).otherwise(col("subtotal")), "taxable": F.when(weak, F.coalesce("taxable", "kw_subtotal")).otherwise(col("taxable"))})
    low = lambda than: _exceeded(col("total"), col("tax"), col("subtotal")) | F.coalesce(col("total") < than * 0.85, F.lit(False))
    df = df.withColumn("total", F.when(col("kw_total").isNotNull() & low(col("kw_total")), col("kw_total")).otherwise(col("total")))
    said = col("words_total").isNotNull() & (low(col("words_total")) | ~P.roughly_equal(col("total"), col("words_total")))
    df = df.withColumn("total", F.when(said, col("words_total")).otherwise(col("total")))
    return df.withColumn("total", F.when(_exceeded(col("total"), col("tax"), col("subtotal")), F.coalesce(F.round(col("subtotal") + col("tax"), 2), "total")).otherwise(col("total")))


def repair_amounts(df: DataFrame) -> DataFrame:
    """df with amounts replaced where the text as a whole says better (columns of keyword_extremes, breakdown_tax, words_total).

    A total gives way to the larger of words and keyword lines if it is missing, below V.LEAST_AMOUNT, no larger than its
    parts, or exceeded by 15 %; a tax that is missing, too small or not below the total to the smallest on tax lines, else
    the breakdown's; a subtotal that is missing or not below the total to the largest on subtotal lines, else to total
    less tax. A tax still missing is total less subtotal.
    """
    col, no = F.col, F.lit(False)
    best = F.greatest("words_total", "kw_total")
    worse = col("total").isNull() | (col("total") < V.LEAST_AMOUNT) | _exceeded(col("total"), col("tax"), col("subtotal")) | (best > col("total") * 1.15)
    df = df.withColumn("total", F.when(best.isNotNull() & F.coalesce(worse, no), best).otherwise(col("total")))
    tax = F.coalesce("kw_tax_least", "breakdown_tax", "kw_tax")
    bad = (col("tax").isNull() | (col("tax") < V.LEAST_AMOUNT) | F.coalesce(col("tax") >= col("total"), no)) & tax.isNotNull() & ~F.coalesce(tax >= col("total"), no)
    df = df.withColumn("tax", F.when(bad, tax).otherwise(col("tax")))
    bad = (col("subtotal").isNull() | F.coalesce(col("subtotal") >= col("total"), no)) & col("kw_subtotal").isNotNull() & ~F.coalesce(col("kw_subtotal") >= col("total"), no)
    df = df.withColumns({"subtotal": F.when(bad, col("kw_subtotal")).otherwise(col("subtotal")), "taxable": F.when(bad, F.coalesce("taxable", "kw_subtotal")).otherwise(col("taxable"))})
    left = F.round(col("total") - col("tax"), 2)
    over = F.coalesce((col("subtotal") >= col("total")) & (left > 0), no)
    lone = F.coalesce(col("subtotal").isNull() & (left > 0), no)
    df = df.withColumns({"taxable": F.when(over, left).when(lone, F.coalesce("taxable", left)).otherwise(col("taxable")), "subtotal": F.when(over | lone, left).otherwise(col("subtotal"))})
    return df.withColumn("tax", F.coalesce("tax", F.when(col("total") > col("subtotal"), F.round(col("total") - col("subtotal"), 2))))


def reconcile_components(df: DataFrame) -> DataFrame:
    """df with tax from cgst, sgst and igst if missing, subtotal and taxable from each other, and the total made to agree."""
    parts = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in ("cgst", "sgst", "igst")])
    df = df.withColumn("tax", F.coalesce("tax", F.when(parts > 0, F.round(parts, 2))))
    df = df.withColumns({"subtotal": F.coalesce("subtotal", "taxable"), "taxable": F.coalesce("taxable", "subtotal")})
    df = df.withColumn("subtotal", F.when(F.abs(F.col("subtotal") - F.col("taxable")) <= 1.0, F.col("taxable")).otherwise(F.col("subtotal")))
    whole = F.round(F.col("subtotal") + F.col("tax"), 2)
    wrong = _exceeded(F.col("total"), F.col("tax"), F.col("subtotal")) | ~P.roughly_equal(F.col("total"), whole)
    return df.withColumn("total", F.when(whole.isNotNull() & wrong, whole).otherwise(F.col("total")))


def align_taxable(df: DataFrame) -> DataFrame:
    """df with taxable set to the subtotal where it is missing, mirrors a larger total, or is over 1.05 times the subtotal."""
    mirrors = P.roughly_equal(F.col("taxable"), F.col("total")) & F.coalesce(F.col("subtotal") < F.col("total"), F.lit(False))
    off = F.col("taxable").isNull() | mirrors | (F.col("taxable") > F.col("subtotal") * 1.05)
    return df.withColumn("taxable", F.when(F.col("subtotal").isNotNull() & off, F.col("subtotal")).otherwise(F.col("taxable")))


def labelled_amounts(lines: DataFrame, labels: tuple[str, ...], largest: bool = True) -> DataFrame:
    """(doc_id, amount): of the amounts that stand after one of the labels on its line the largest, or the smallest, in
    magnitude; on lines with a percent sign only those above V.LEAST_AMOUNT count."""
    at = F.regexp_extract(F.lower("text"), rf"(?:{'|'.join(labels)})(.*)$", 1)
    values = F.transform(V.numeric_tokens(at), lambda t: V.parse_amount(t).cast("double"))
    fine = F.filter(values, lambda v: v.isNotNull() & (~F.col("text").contains("%") | (F.abs(v) > V.LEAST_AMOUNT)))
    df = lines.where(F.lower("text").rlike("|".join(labels))).select("doc_id", F.explode(fine).alias("v"))
    pick = F.max if largest else F.min
    return df.groupBy("doc_id").agg(pick(F.struct(F.abs("v").alias("m"), "v"))["v"].alias("amount"))


def is_valid_total(total: Column, largest_bottom: Column) -> Column:
    """Above V.LEAST_AMOUNT and exactly the largest amount of the bottom zone; false where either is missing."""
    return F.coalesce((total > V.LEAST_AMOUNT) & (total == largest_bottom), F.lit(False))


# --- text of the record's sections -------------------------------------------------------------------------------------


def sections(lines: DataFrame) -> DataFrame:
    """(doc_id, header, all_lines): the lines before the first buyer or item section, and all lines, as arrays in order."""
    doc = Window.partitionBy("doc_id")
    first = F.min(F.when(F.col("text").rlike(HEADER_END), F.col("line_no"))).over(doc)
    df = lines.withColumn("_end", first)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s["text"])
    line = F.struct("line_no", "text")
    before = F.col("_end").isNull() | (F.col("line_no") < F.col("_end"))
    return df.groupBy("doc_id").agg(ordered(F.when(before, line)).alias("header"), ordered(line).alias("all_lines"))


def buyer_blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, buyer_block): the lines of the first buyer's section as an array, MOST_BLOCK at most.

    From a buyer header on: what stands behind it on its line, then the following lines of its column, up to an item, tax
    or order line, or the one that holds the tax number. Lines of bank or carrier are passed over.
    """
    doc, seq = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("line_no")
    start = F.min(F.when(F.col("text").rlike(BUYER_START), F.struct("line_no", "col"))).over(doc)
    df = lines.withColumn("_s", start).where("line_no >= _s.line_no")
    here = F.col("line_no") == F.col("_s.line_no")
    inline = F.regexp_extract("text", rf"(?:{BUYER_START})\s*\)?\s*[:=-]*\s*(.+)$", 1)
    inline = F.regexp_replace(inline, r"^\(?(?:bill to)?\)?\s*[:=-]*\s*", "")
    df = df.withColumn("_t", normalize_line(F.when(here, inline).otherwise(F.col("text"))))
    same = here | (F.col("col") == F.col("_s.col")) | (F.col("col") == "FULL") | (F.col("_s.col") == "FULL")
    df = df.where(same & (F.col("_t") != "") & ~F.col("_t").rlike(BUYER_SKIP))
    tax_no = F.col("_t").rlike(r"(?i)gstin|\buin\b")
    df = df.withColumns({"_stop": F.sum((F.col("_t").rlike(BUYER_END) & ~here).cast("int")).over(seq), "_past": F.sum(tax_no.cast("int")).over(seq) - tax_no.cast("int"), "_k": F.row_number().over(seq)})
    df = df.where((F.col("_stop") == 0) & (F.col("_past") == 0) & (F.col("_k") <= MOST_BLOCK))
    return df.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_t"))), lambda s: s["_t"]).alias("buyer_block"))


def first_gstin(texts: Column) -> Column:
    """The first valid or repairable number in an array of lines: tokens of 15 characters, line by line."""
    tokens = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(F.upper(t), F.lit(r"\b[A-Z0-9]{15}\b"), F.lit(0))))
    return F.get(F.array_compact(F.transform(tokens, C.gstin)), 0)


def repair_contact(df: DataFrame) -> DataFrame:
    """df (with header) with vendor name, GSTIN, mail, website, phone and CIN taken from the header where missing or invalid."""
    text = F.array_join("header", "\n")
    name = F.get(F.filter(F.transform("header", lambda t: C.party_name(t, True)), lambda t: t.isNotNull() & P.has_business_signal(t)), 0)
    each = lambda use: F.get(F.array_compact(F.transform("header", use)), 0)
    cin = F.nullif(F.upper(F.regexp_extract(text, CIN, 0)), F.lit(""))
    return df.withColumns(
        {
            "vendor_name": F.when(C.is_party_name(F.col("vendor_name"), True), F.col("vendor_name")).otherwise(F.coalesce(name, "vendor_name")),
            "vendor_gstin": F.when(I.is_gstin(F.col("vendor_gstin")), F.col("vendor_gstin")).otherwise(F.coalesce(first_gstin(F.col("header")), "vendor_gstin")),
            # Each is the first line's that gives one.
            "vendor_email": F.coalesce("vendor_email", each(C.email)),
            "vendor_website": F.coalesce("vendor_website", each(lambda t: C.website(F.regexp_replace(t, C.EMAIL, " ")))),
            "vendor_phone": F.coalesce("vendor_phone", each(lambda t: F.when(~t.rlike("(?i)gst|a/c|account"), C.phones(t)))),
            "vendor_cin": F.coalesce("vendor_cin", cin),
        }
    )


def repair_bank(df: DataFrame) -> DataFrame:
    """df (with all_lines) with bank name, account number and IFSC from the first lines that give them, where missing or weak.

    A weak account number has fewer than 10 digits or more than 18; a longer one replaces it.
    """
    each = lambda use: F.get(F.array_compact(F.transform("all_lines", use)), 0)
    none = F.lit(None).cast("string")
    label = lambda t: t.rlike(r"(?i)a/c|account")
    account = each(lambda t: F.when(label(t), C.account_number(t, none)))
    code = each(lambda t: F.get(F.array_compact(F.transform(F.regexp_extract_all(F.upper(t), F.lit(r"\b[A-Z0-9]{11}\b"), F.lit(0)), lambda x: F.when(F.lower(t).rlike("ifs|bank"), C.ifsc(x)))), 0))
    own = F.regexp_replace("account_number", r"\D", "")
    weak = F.col("account_number").isNull() | ~F.length(own).between(10, 18) | (F.length(account) > F.length(own))
    return df.withColumns(
        {
            "bank_name": F.coalesce(C.bank_name(F.col("bank_name"), none), each(lambda t: F.when(t.rlike("(?i)bank"), C.bank_name(t, none))), "bank_name"),
            "account_number": F.when(weak, F.coalesce(account, "account_number")).otherwise(F.col("account_number")),
            "ifsc_code": F.coalesce("ifsc_code", code),
        }
    )


def repair_transport(df: DataFrame) -> DataFrame:
    """df (with all_lines) with transporter, transport, mode and destination from labelled lines where they are null."""

    def labelled(pattern: str, use) -> Column:  # noqa: ANN001
        value = lambda t: F.nullif(normalize_line(F.regexp_extract(t, rf"(?i)\b(?:{pattern})\b\s*[:=-]?\s*(.+)$", 1)), F.lit(""))
        return F.get(F.array_compact(F.transform("all_lines", lambda t: use(value(t)))), 0)

    none = F.lit(None).cast("string")
    carrier = labelled(r"transporter\s*(?:name|nm\.?)", lambda v: C.transporter_name(v, none, none))
    return df.withColumns(
        {
            "transporter_name": F.coalesce("transporter_name", carrier),
            "transport_details": F.coalesce("transport_details", labelled(r"transport(?:er)?", C.transport_details), carrier),
            "dispatch_through": F.coalesce("dispatch_through", labelled(r"dispatch(?:ed)?\s+through|transportation\s+mode|mode", C.dispatch)),
            "destination": F.coalesce("destination", labelled("destination|station", C.location)),
        }
    )


def repair_buyer(df: DataFrame) -> DataFrame:
    """df (with buyer_block) with the buyer's address, GSTIN and name from the block.

    An address is replaced if it is missing, unclean or over 8 characters shorter; a number or name if it is not valid.
    """
    block = F.coalesce("buyer_block", F.array().cast("array<string>"))
    df = df.withColumns({"_name": F.get(F.array_compact(F.transform(block, lambda t: C.party_name(t, False))), 0), "_own": C.is_party_name(F.col("buyer_name"), False)})
    name = F.when(F.col("_own"), F.col("buyer_name")).otherwise(F.coalesce("_name", "buyer_name"))
    df = df.withColumn("buyer_name", name).withColumn("_key", F.coalesce(comparison_key(F.col("buyer_name")), F.lit("")))
    rest = F.filter(block, lambda t: ~t.rlike(r"(?i)gstin|\buin\b") & (comparison_key(t) != F.col("_key")))
    df = df.withColumns({"_address": C.address(F.array_join(rest, ", ")), "_old": C.address(F.col("buyer_address"))})
    replace = F.col("_address").isNotNull() & (F.col("_old").isNull() | (F.length("_address") > F.length("buyer_address") + 8))
    out = df.withColumns(
        {
            "buyer_address": F.when(replace, F.col("_address")).otherwise(F.col("buyer_address")),
            "buyer_gstin": F.when(I.is_gstin(F.col("buyer_gstin")), F.col("buyer_gstin")).otherwise(F.coalesce(first_gstin(block), "buyer_gstin")),
        }
    )
    return out.drop("_name", "_own", "_key", "_address", "_old")


def buyer_addresses(lines: DataFrame) -> DataFrame:
    """(doc_id, buyer_address) from the buyer's block alone."""
    empty = F.lit(None).cast("string")
    df = buyer_blocks(lines).withColumns({"buyer_address": empty, "buyer_gstin": empty, "buyer_name": empty})
    return repair_buyer(df).where("buyer_address is not null").select("doc_id", "buyer_address")


def joined_matches(lines: DataFrame, pattern: str, name: str) -> DataFrame:
    """(doc_id, name): all different matches of a pattern in a document's lines, in order, joined by commas."""
    found = lines.select("doc_id", "line_no", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "pos", "m"))), lambda s: s["m"])
    return found.groupBy("doc_id").agg(F.array_join(F.array_distinct(ordered), ", ").alias(name))


# --- the whole record --------------------------------------------------------------------------------------------------

TEXT_FIELDS = (
    "invoice_number", "invoice_date", "vendor_name", "vendor_gstin", "buyer_name", "buyer_gstin", "po_number", "po_date", "order_reference",
    "delivery_note", "dispatch_through", "transporter_name", "transport_details", "vehicle_number", "destination", "place_of_supply", "payment_terms",
    "bank_details", "bank_name", "account_number", "ifsc_code", "branch", "irn", "ack_number", "eway_bill", "vendor_phone", "vendor_email",
    "vendor_website", "vendor_address", "buyer_address", "vendor_pan", "vendor_cin", "msme_number", "state", "state_code", "pincode",
)
AMOUNT_FIELDS = ("subtotal", "taxable", "cgst", "sgst", "igst", "tax", "round_off", "total")


def with_all_fields(df: DataFrame) -> DataFrame:
    """df with every field of TEXT_FIELDS (string) and AMOUNT_FIELDS (double) that it has not as null."""
    missing = {f: F.lit(None).cast("string") for f in TEXT_FIELDS} | {f: F.lit(None).cast("double") for f in AMOUNT_FIELDS}
    return df.withColumns({f: v for f, v in missing.items() if f not in df.columns})


def clean_fields(df: DataFrame, as_of: Column) -> DataFrame:
    """df with every field cleaned, in an order in which later fields read earlier ones as they are then."""
    col = F.col
    df = with_all_fields(df)
    for stage in (
        {
            "invoice_number": C.invoice_number(col("invoice_number"), as_of),
            "invoice_date": F.when(V.is_invoice_date(col("invoice_date"), as_of), col("invoice_date")),
            "po_date": F.when(V.is_invoice_date(col("po_date"), as_of), col("po_date")),
            "vendor_name": C.party_name(col("vendor_name"), True),
            "buyer_name": C.party_name(col("buyer_name"), False),
            "vendor_gstin": C.gstin(col("vendor_gstin")),
            "buyer_gstin": C.gstin(col("buyer_gstin")),
            "po_number": C.identifier(col("po_number"), 30),
            "order_reference": C.reference(col("order_reference")),
            "delivery_note": C.reference(col("delivery_note"), True),
            "dispatch_through": C.dispatch(col("dispatch_through")),
            "payment_terms": C.payment_terms(col("payment_terms")),
            "vehicle_number": C.vehicle(col("vehicle_number")),
            "bank_details": C.bank_details(col("bank_details")),
            "branch": C.location(col("branch")),
            "destination": C.location(col("destination")),
            **{f: C.identifier(col(f), 100) for f in ("irn", "ack_number", "eway_bill")},
            "vendor_cin": C.identifier(col("vendor_cin"), 30),
            "msme_number": C.soft_text(col("msme_number"), 40),
            "vendor_phone": C.phones(col("vendor_phone")),
        },
        {
            "transporter_name": C.transporter_name(col("transporter_name"), col("dispatch_through"), col("transport_details")),
            "transport_details": C.transport_details(col("transport_details")),
            "account_number": C.account_number(col("account_number"), col("bank_details")),
            "ifsc_code": F.coalesce(C.ifsc(col("ifsc_code")), C.ifsc(F.regexp_extract(F.upper("bank_details"), r"\b[A-Z]{4}[0O][A-Z0-9]{6}\b", 0))),
            "vendor_email": C.email(F.coalesce("vendor_email", "vendor_address", "bank_name")),
            "vendor_website": C.website(F.when(F.lower("vendor_website").contains("www."), col("vendor_website")).when(F.lower("vendor_address").contains("www."), col("vendor_address")).otherwise(col("vendor_website"))),
            "bank_name": C.bank_name(col("bank_name"), col("bank_details")),
            "vendor_pan": I.pan_of_gstin(comparison_key(col("vendor_pan")), col("vendor_gstin")),
            "state_code": I.state_of_gstin(col("state_code"), col("buyer_gstin")),
        },
        {
            "state": C.state(col("state"), col("state_code"), col("place_of_supply")),
            "vendor_address": C.address(col("vendor_address")),
            "buyer_address": C.address(col("buyer_address")),
            "account_number": F.when(
                ~F.coalesce(F.contains(F.regexp_replace("vendor_phone", r"\D", ""), col("account_number")), F.lit(False))
                & ~(col("bank_name").isNull() & col("bank_details").isNull() & col("ifsc_code").isNull()),
                col("account_number"),
            ),
        },
        {
            "place_of_supply": C.place_of_supply(col("place_of_supply"), col("state"), col("state_code")),
            "buyer_address": F.when(~F.coalesce(comparison_key(col("buyer_address")) == comparison_key(col("vendor_address")), F.lit(False)), col("buyer_address")),
        },
        {
            "buyer_name": F.coalesce("buyer_name", F.get(F.array_compact(F.transform(F.split("buyer_address", ","), lambda t: C.party_name(t, False))), 0)),
            "pincode": C.pincode(F.coalesce("pincode", "buyer_address", "vendor_address")),
        },
        {f: F.when(col(f) > 0, col(f)) if f != "round_off" else col(f) for f in AMOUNT_FIELDS},
    ):
        df = df.withColumns(stage)
    return align_taxable(reconcile_components(enforce_consistency(df)))


def prefer_identity(df: DataFrame) -> DataFrame:
    """df with vendor and buyer taken from the generic reading (g_ columns) where that is better.

    A name if the own is not valid, or the generic one scores over 10 more; a number if the own is not valid, or is the
    other party's too while the generic ones differ.
    """
    col = F.col
    own = lambda side: comparison_key(col(f"{side}_gstin"))
    twins = F.coalesce(own("vendor") == own("buyer"), F.lit(False)) & ~F.coalesce(own("g_vendor") == own("g_buyer"), F.lit(False))
    out = {}
    for side in ("vendor", "buyer"):
        name, generic = col(f"{side}_name"), col(f"g_{side}_name")
        score = lambda n: F.when(P.has_business_signal(n), 30).otherwise(0) + F.when(P.is_uppercase_line(n), 20).otherwise(0) + F.least(F.length(n), F.lit(40)) / 4
        vendor = side == "vendor"
        better = C.is_party_name(generic, vendor) & (~C.is_party_name(name, vendor) | F.coalesce(score(generic) > score(name) + 10, F.lit(False)))
        out[f"{side}_name"] = F.when(better, generic).otherwise(name)
        number, other = col(f"{side}_gstin"), col(f"g_{side}_gstin")
        out[f"{side}_gstin"] = F.when(I.is_gstin(other) & (~I.is_gstin(number) | twins), other).otherwise(number)
    return df.withColumns(out)


def prefer_core(df: DataFrame, as_of: Column) -> DataFrame:
    """df with number, date and total of the generic reading (g_ columns) where the own are missing, invalid or worse.

    A number if it scores over 8 more; a date if its length is nearer to ten characters; a total if it is larger and the
    own is below ten times V.LEAST_AMOUNT.
    """
    col = F.col
    score = lambda n: F.when(n.rlike(r"^[A-Z]\d{3,8}$"), 120).when(n.rlike(r"^[A-Z]{2,10}\d{2,8}/\d{1,8}[A-Z]?$"), 115).when(n.rlike(r"^\d{3,5}$"), 100).when(n.rlike(r"^[A-Z]{1,4}[-/]?\d{2,8}[A-Z]?$"), 95).when(n.rlike(r"^\d{6,12}$"), 55).otherwise(0)
    number, g_number, date, g_date = col("invoice_number"), col("g_invoice_number"), col("invoice_date"), col("g_invoice_date")
    better = I.is_invoice_number(g_number) & (~I.is_invoice_number(number) | (score(g_number) > score(number) + 8))
    nearer = V.is_invoice_date(g_date, as_of) & (~V.is_invoice_date(date, as_of) | F.coalesce(F.abs(F.length(g_date) - 10) < F.abs(F.length(date) - 10), F.lit(False)))
    larger = col("g_total").isNotNull() & (col("total").isNull() | ((col("g_total") > col("total")) & (col("total") < 10 * V.LEAST_AMOUNT)))
    return df.withColumns(
        {
            "invoice_number": F.when(better, g_number).otherwise(number),
            "invoice_date": F.when(nearer, g_date).otherwise(date),
            "total": F.when(larger, col("g_total")).otherwise(col("total")),
        }
    )


def fill_missing(df: DataFrame) -> DataFrame:
    """df for a sink: fields without a value say so in one fixed word, the currency is INR, items are an array.

    Amounts become text in plain notation. Inside the engine missing values stay null.
    """
    df = with_all_fields(df)
    out = {f: C.mentioned(F.col(f)) for f in TEXT_FIELDS} | {f: C.mentioned(V.format_amount(F.col(f))) for f in AMOUNT_FIELDS}
    currency = F.col("currency") if "currency" in df.columns else F.lit(None).cast("string")
    out["currency"] = F.coalesce(F.nullif(F.trim(currency), F.lit("")), F.lit("INR"))
    if "line_items" in df.columns:
        out["line_items"] = F.coalesce("line_items", F.from_json(F.lit("[]"), df.schema["line_items"].dataType))
    return df.withColumns(out)
