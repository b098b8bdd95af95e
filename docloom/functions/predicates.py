"""Predicates over one line of text, as boolean Columns that are never null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import as_text, normalize_line

# --- Fixed values: words by which lines of an invoice are told apart. ---
BUSINESS = (
    "ltd", "limited", "pvt", "private", "llp", "corporation", "industries", "enterprises", "solutions", "engineering",
    "chemicals", "electronics", "systems", "products", "company", "agency", "traders", "brothers", "associates",
    "logistics", "services", "co",
)
GOVERNMENT = (
    "department", "directorate", "ministry", "government", "govt", "atomic energy", "stores officer", "purchase unit",
    "regional stores unit", "fuel complex", "plant site",
)
HEADER_NOISE = (
    "invoice", "tax invoice", "e-invoice", "voucher", "statement", "receipt", "challan", "delivery note", "dispatch doc",
    "reference no", "mode/terms", "original for", "duplicate for", "triplicate for", "recipient", "supplier", "copy",
    "ack no", "ack date", "irn",
)
HEADER_METADATA = (
    "invoice no", "invoice number", "invoice #", "e-way", "dated", "delivery note", "mode/terms", "mode / terms",
    "reference no", "buyer's order", "purchase order", "purchase order no", "purchase order date", "customer po date",
    "dispatch doc", "delivery note date", "dispatched through", "destination", "bill of lading", "lr-rr",
    "motor vehicle", "terms of delivery", "transportation mode", "vehicle no",
)
BUYER_STOP = (
    "dispatched through", "destination", "delivery note", "bill of lading", "lr-rr", "motor vehicle",
    "terms of delivery", "mode/terms", "reference no", "buyer's order", "purchase order", "dispatch doc", "state name",
    "code :", "place of supply", "date of receiver", "delivery note date", "vehicle no", "transportation mode",
)
BUYER_SECTION = (
    "buyer", "bill to", "billed to", "consignee", "ship to", "shipped to", "details of recipient",
    "details of consignee", "details of receiver", "details of buyer", "details of purchaser",
)
LOGISTICS = (
    "dispatch", "delivery note", "mode/terms", "bill of lading", "lr-rr", "motor vehicle", "transporter", "transport",
    "destination", "buyer's order", "reference no", "e-way",
)
ADDRESS = (
    "plot", "road", "rd", "near", "mob", "email", "state name", "code", "india", "via", "branch", "ifsc", "complex",
    "street", "lane", "gali", "po ", "po,", "post", "district", "pin code", "telangana", "rajasthan", "gujarat",
    "hyderabad",
)
NON_ITEM = (
    "total", "grand total", "amount payable", "taxable value", "tax amount", "igst", "cgst", "sgst", "bank", "ifsc",
    "declaration", "jurisdiction", "authorised", "pan", "subject", "invoice", "terms of delivery", "mode/terms",
    "branch", "company", "output-", "seal nos", "remarks", "gross", "tare", "nett", "credit period",
    "whether the tax", "invoice amt", "inv value",
)
ITEM_STOP = (
    "subtotal", "sub total", "tax", "taxable value", "grand total", "amount payable", "invoice value", "net amount",
    "bank details", "declaration", "total tax amount", "amount chargeable", "tax amount (in words)", "seal nos",
    "remarks", "whether the tax", "invoice amt", "inv value",
)
TABLE_HEADER = (
    "description", "item", "particular", "goods", "goods/services", "qty", "quantity", "rate", "amount", "hsn", "sac",
    "uom", "unit", "discount", "taxable", "value", "code",
)
TABLE_HEADER_WEAK = ("unit", "value", "code")
ORDER_HEADER = (
    "buyer's order", "buyers order", "buyer order", "purchase order", "order no", "supplier's ref", "supplier ref",
    "dispatch doc", "delivery note",
)
COPY_MARKS = ("original for", "duplicate for", "triplicate for", "supplier")
TOTAL = (
    "grand total", "invoice value", "total invoice value", "amount payable", "net amount", "amount due",
    "total amount after tax", "value (figure)", "total after tax", "invoice amt", "inv value", "inv value (in fig)",
    "invoice amount", r"\btotal\b",  # The last is no pattern: it is searched for as it is written.
)
TAX = (
    "igst", "cgst", "sgst", "tax amount", "total tax amount", "gst output", "add : igst", "add : cgst", "add : sgst",
    "integrated tax", "gst amount",
)
SUBTOTAL = (
    "taxable value", "subtotal", "sub total", "taxable amount", "amount chargeable", "total amount before tax",
    "amount before tax", "total to be taxed", "taxable total", "taxable amt", "sale amt",
)
AMOUNT_IGNORE = ("qty", "quantity", "hsn", "sac", "rate")
BANK = ("bank", "account", "a/c", "ifsc", "branch", "upi", "utr", "swift", "beneficiary")
TOTAL_LINE = (
    "grand total", "invoice value", "total invoice value", "amount payable", "total amount", "total amount after tax",
    "total to be taxed", "net amount", "subtotal", "taxable value", "value (figure)", "total after tax",
    "invoice amt", "inv value", "invoice amount",
)
FOOTER = ("grand total", "invoice value", "amount payable", "net amount", "taxable value", "total tax amount")
KEYWORD_LOOKALIKES = ("01256789", "oizsgtsq")
GST_RATES = (0.05, 0.12, 0.18, 0.28)
# --- End of fixed values. ---


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def folded(c: Column) -> Column:
    """Lower-cased ASCII letters and digits, digits read as the letters they resemble; numbers by themselves are left out,
    so that 1657 is no tax."""
    words = F.regexp_replace(F.lower(as_text(c)), r"\b[0-9][0-9.,]*\b", " ")
    return F.translate(F.regexp_replace(words, "[^a-z0-9]", ""), *KEYWORD_LOOKALIKES)


def _bare(keywords: tuple[str, ...]) -> list[str]:
    table = str.maketrans(*KEYWORD_LOOKALIKES)
    found = dict.fromkeys("".join(x for x in k.lower() if x.isascii() and x.isalnum()).translate(table) for k in keywords)
    return [b for b in found if b]


def contains_any(c: Column, keywords: tuple[str, ...]) -> Column:
    """Whether text holds a keyword as it is, or without punctuation, or with digits read as the letters they resemble.

    Keywords have no digits, so a text that holds one in either of the first two ways holds it in the third as well: one
    search of the folded text decides. The keyword lists are literals of the plan.
    """
    return folded(c).rlike("|".join(_bare(keywords)))


def holds_any(form: Column, keywords: tuple[str, ...]) -> Column:
    """contains_any for a column that holds the folded text already: plain searches, which are quicker than a pattern."""
    return any_of([form.contains(b) for b in _bare(keywords)])


def keyword_hits(c: Column, keywords: tuple[str, ...]) -> Column:
    """How many of the keywords the lower-cased text holds."""
    lower = F.lower(as_text(c))
    return reduce(lambda a, b: a + b, [lower.contains(k).cast("int") for k in keywords])


def is_address_like(c: Column) -> Column:
    """A long number, a mail or web address, two address words, or one with a comma or digit."""
    lower, hits = F.lower(as_text(c)), keyword_hits(c, ADDRESS)
    web = lower.contains("@") | lower.contains("www.") | lower.contains("http")
    return lower.rlike(r"\b\d{5,6}\b") | web | (hits >= 2) | ((hits == 1) & (lower.contains(",") | lower.rlike(r"\d")))


def is_logistics_like(c: Column) -> Column:
    return contains_any(c, BUYER_STOP + LOGISTICS)


def is_government_like(c: Column) -> Column:
    return contains_any(c, GOVERNMENT)


def has_business_signal(c: Column) -> Column:
    return contains_any(c, BUSINESS)


def is_header_noise(c: Column) -> Column:
    return contains_any(c, HEADER_NOISE)


def is_non_item_line(c: Column) -> Column:
    return contains_any(c, NON_ITEM)


def is_item_stop_line(c: Column) -> Column:
    return contains_any(c, ITEM_STOP)


def is_uppercase_line(c: Column) -> Column:
    """A line of capitals that says something: six letters or more, three fifths of them capitals, no address or noise."""
    line = normalize_line(c)
    letters, capitals = F.length(F.regexp_replace(line, r"\P{L}", "")), F.length(F.regexp_replace(line, r"\P{Lu}", ""))
    shape = (F.length(line) >= 5) & line.rlike("[A-Za-z]") & (letters >= 6) & (capitals >= F.greatest(F.lit(4), F.floor(letters * 3 / 5)))
    return shape & ~is_address_like(line) & ~is_logistics_like(line) & ~is_header_noise(line)


def header_words(lower: Column) -> Column:
    """The telling words that head a table's columns, as bits, of lower-cased text."""
    strong = [k for k in TABLE_HEADER if k not in TABLE_HEADER_WEAK]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(lower.contains(k), 1 << i).otherwise(0) for i, k in enumerate(strong)])


def is_table_header(c: Column) -> Column:
    """Two words that head a table's columns, two of them among the telling ones."""
    return F.bit_count(header_words(F.lower(as_text(c)))) >= 2


def is_buyer_header(c: Column) -> Column:
    """A line that opens the buyer's section, and neither marks a copy nor names an order.

    Looks at the line and at its parts between bars; a part after an order's label does not count.
    """
    line = F.lower(normalize_line(c))
    copy = any_of([line.contains(k) for k in COPY_MARKS])
    parts = F.concat(F.array(line), F.transform(F.split(line, r"\|+"), normalize_line))
    opens = lambda p: (contains_any(p, BUYER_SECTION) | p.rlike(r"^(invoice )?to[,:.]?$")) & ~any_of([p.contains(k) for k in ORDER_HEADER])
    return ~copy & F.exists(parts, opens)


def is_tax_line(c: Column) -> Column:
    lower = F.lower(as_text(c))
    rate = lower.contains("%") & contains_any(lower, ("igst", "cgst", "sgst", "gst"))
    return ~lower.contains("taxable") & (contains_any(lower, TAX) | rate)


def is_ignored_amount_line(c: Column) -> Column:
    return contains_any(c, AMOUNT_IGNORE + BANK)


def roughly_equal(a: Column, b: Column) -> Column:
    """Whether amounts differ by at most 1, or 2 % of the larger; false for null."""
    near = F.abs(a - b) <= F.greatest(F.lit(1.0), F.greatest(F.abs(a), F.abs(b)) * 0.02)
    return F.coalesce(near, F.lit(False))


def amounts_agree(subtotal: Column, tax: Column, total: Column) -> Column:
    return roughly_equal(subtotal + tax, total)


def is_tax_rate(tax: Column, subtotal: Column) -> Column:
    """Whether tax is some usual rate of the subtotal, give or take 2.5 points."""
    ratio = F.when(subtotal > 0, tax / subtotal)
    return F.coalesce(any_of([F.abs(ratio - r) <= 0.025 for r in GST_RATES]), F.lit(False))
