"""Further invoice fields, each a row of a table of labels and shapes evaluated in one pass over the lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import identifiers as I
from docloom.functions import predicates as P
from docloom.functions import values as V
from docloom.functions.text import normalize_line
from docloom.operators.rank import best

# --- Fixed values: labels that open a value, words that end one, and shapes of identifiers. ---
KNOWN_LABELS = (
    "place of supply", "transporter name", "dispatched through", "dispatch through", "terms of payment", "payment terms",
    "delivery note", "vehicle number", "vehicle no", "purchase order", "po date", "order reference", "other references",
    "invoice no", "invoice date", "bank details", "bank name", "account number", "account no", "ifsc", "branch",
    "round off", "grand total", "amount payable", "invoice value", "mode/terms", "transportation mode",
    "terms of delivery", "phone", "email", "website", "taxable value", "cgst", "sgst", "igst", "irn", "ack no",
    "e-way bill", "eway bill", "msme", "udyam", "gstin", "state name", "state code", "pin code", "destination",
    "customer po", "bill to", "billed to", "buyer", "ship to", "shipped to", "consignee", "description", "hsn",
)
PAYMENT_WORDS = "day|credit|advance|immediate|net|due|payment|against delivery|cod"
BANK_START = r"(?i)bank\s*(?:details|name)|a/c\s*(?:no|holder)|account\s*(?:no|number)"
BANK_STOP = r"(?i)declaration|authori[sz]ed|signatory|jurisdiction|grand total|terms"
# --- End of fixed values. ---


@dataclass(frozen=True)
class Spec:
    """A field by its labels (value beside or below) and the shape that a value must have."""

    field: str
    labels: tuple[str, ...]
    shape: str = r"(?i)[a-z0-9]"
    take: str | None = None


LABELLED = (
    Spec("po_date", ("purchase order dated", "po date", "order date"), r"\d", V.INVOICE_DATES[4] + "|" + V.INVOICE_DATES[0] + "|" + V.INVOICE_DATES[1]),
    Spec("order_reference", ("order reference", "other references", "other reference")),
    Spec("delivery_note", ("delivery note",)),
    Spec("dispatch_through", ("dispatched through", "dispatch through"), "[A-Za-z]{2}"),
    Spec("transporter_name", ("transporter name", "transporter nm"), "[A-Za-z]{2}"),
    Spec("transport_details", ("transportation mode", "mode of transport"), "[A-Za-z]{2}"),
    Spec("destination", ("destination",), "[A-Za-z]{2}"),
    Spec("place_of_supply", ("place of supply",), "[A-Za-z]{2}"),
    Spec("payment_terms", ("terms of payment", "payment terms", "credit period"), f"(?i){PAYMENT_WORDS}"),
    Spec("bank_name", ("bank name",), "[A-Za-z]{3}"),
    Spec("branch", ("branch",), "[A-Za-z]{3}"),
    Spec("state", ("state name",), "[A-Za-z]{3}", "[A-Za-z][A-Za-z &]+"),
    Spec("state_code", ("state code",), r"\d", r"\d{1,2}"),
)

#: Shapes that identify a value wherever it stands: the pattern's first group, and words that make it surer.
SHAPED = (
    ("irn", r"(?i)\b([0-9a-f]{64})\b", "irn"),
    ("ack_number", r"(?<!\d)(\d{12,18})(?!\d)", "ack"),
    ("eway_bill", r"(?<!\d)(\d{4} ?\d{4} ?\d{4})(?!\d)", "e-?way"),
    ("vendor_cin", r"\b([LU]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6})\b", "cin"),
    ("msme_number", r"\b(UDYAM-[A-Z]{2}-\d{2}-\d{7})\b", "msme|udyam"),
    ("vendor_website", r"(?i)\b((?:https?://)?www\.[a-z0-9.-]+\.[a-z]{2,})", "web"),
)
NEEDS_LABEL = ("ack_number", "eway_bill")


def labelled_candidates(lines: DataFrame) -> DataFrame:
    """(doc_id, field, value, score, line_no): what stands after a label on its line (90), or on one of the next two
    lines (60, 52) if nothing does. A value ends where another known label begins."""
    seq = Window.partitionBy("doc_id").orderBy("line_no")
    text = F.col("text")
    df = lines.withColumns({"_1": F.coalesce(F.lead("text", 1).over(seq), F.lit("")), "_2": F.coalesce(F.lead("text", 2).over(seq), F.lit(""))})

    def value_of(spec: Spec) -> Column:
        names = "|".join(spec.labels)
        others = "|".join(k for k in KNOWN_LABELS if not any(k in x or x in k for x in spec.labels))
        label = rf"(?i)(?:{names})\s*(?:no|number|name)?\.?\s*[:=#>|-]*\s*"
        cut = lambda c: normalize_line(F.regexp_replace(c, rf"(?i)\s*(?:{others}).*$", ""))
        fit = lambda c: F.when((c != "") & c.rlike(spec.shape), F.nullif(F.regexp_extract(c, f"({spec.take})", 1), F.lit("")) if spec.take else c)
        same = fit(cut(F.regexp_extract(text, rf"{label}(.*)$", 1)))
        bound = lambda c: F.lower(c).rlike(others)
        one = F.when(~bound(F.col("_1")), fit(cut(F.col("_1"))))
        two = F.when(~bound(F.col("_1")) & ~bound(F.col("_2")), fit(cut(F.col("_2"))))
        found = F.coalesce(same, one, two)
        score = F.when(same.isNotNull(), 90).when(one.isNotNull(), 60).otherwise(52)
        return F.when(F.lower(text).rlike(names), F.struct(F.lit(spec.field).alias("field"), found.alias("value"), score.alias("score")))

    each = F.array_compact(F.array(*[value_of(s) for s in LABELLED]))
    return df.select("doc_id", "line_no", F.explode(each).alias("c")).where("c.value is not null").select("doc_id", "c.field", "c.value", "c.score", "line_no")


def shaped_candidates(lines: DataFrame) -> DataFrame:
    """(doc_id, field, value, score, line_no) for identifiers known by their shape: 60, and 30 more beside a label."""
    text, lower = F.col("text"), F.lower("text")

    def value_of(field: str, pattern: str, label: str) -> Column:
        value = F.regexp_extract(text, pattern, 1)
        on = (value != "") & (lower.rlike(label) if field in NEEDS_LABEL else F.lit(True))
        return F.when(on, F.struct(F.lit(field).alias("field"), value.alias("value"), (F.lit(60) + F.when(lower.rlike(label), 30).otherwise(0)).alias("score")))

    each = F.array_compact(F.array(*[value_of(*s) for s in SHAPED]))
    return lines.select("doc_id", "line_no", F.explode(each).alias("c")).select("doc_id", "c.field", "c.value", "c.score", "line_no")


def bank_details(lines: DataFrame, most: int = 8) -> DataFrame:
    """(doc_id, bank_details): the best run of up to `most` lines from the start of a bank section to its end; runs with
    an IFSC code (25) and a long number (15) are better."""
    seq = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(0, most - 1)
    df = lines.withColumn("_run", F.collect_list("text").over(seq)).where(F.col("text").rlike(BANK_START))
    stops = F.transform("_run", lambda t: t.rlike(BANK_STOP))
    end = F.coalesce(F.nullif(F.array_position(stops, True), F.lit(0).cast("long")), F.lit(most + 1).cast("long"))
    joined = normalize_line(F.array_join(F.slice("_run", F.lit(1), F.greatest(F.lit(1), (end - 1).cast("int"))), " "))
    df = df.withColumn("bank_details", joined)
    score = F.when(joined.rlike(r"\b[A-Z]{4}0[A-Z0-9]{6}\b"), 25).otherwise(0) + F.when(joined.rlike(r"\b\d{8,18}\b"), 15).otherwise(0)
    return best(df.withColumn("_s", score), ["doc_id"], [-F.col("_s"), F.col("line_no")], ["bank_details"])


def tax_components(lines: DataFrame) -> DataFrame:
    """(doc_id, cgst, sgst, igst, round_off): the last written-out amount of each component's best line."""
    rows = lines.withColumn("_a", F.transform(F.filter(V.amounts(F.col("text")), lambda a: ~a["percent"]), lambda a: a["value"].cast("double")))
    lower = F.lower("text")
    last = F.element_at("_a", -1)
    agg = [F.max(F.when(lower.contains(k) & ~lower.contains("taxable") & (F.size("_a") > 0), last)).alias(k) for k in ("cgst", "sgst", "igst")]
    tokens = F.transform(V.numeric_tokens(F.col("text")), lambda t: V.parse_amount(t).cast("double"))
    off = F.when(lower.rlike(r"round(?:ed|ing)?\s*off"), F.element_at(tokens, -1))
    return rows.groupBy("doc_id").agg(*agg, F.max(off).alias("round_off"))


def vendor_address(lines: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, vendor_address): up to `most` address-like lines before the buyer's section, ending with a pincode."""
    doc = Window.partitionBy("doc_id")
    seq = doc.orderBy("line_no")
    df = lines.withColumn("_buyer", F.min(F.when(F.col("is_buyer_header"), F.col("line_no"))).over(doc))
    df = df.where(F.col("in_top") & (F.col("_buyer").isNull() | (F.col("line_no") < F.col("_buyer"))) & P.is_address_like(F.col("text")) & ~F.col("text").rlike("(?i)gstin|@|www"))
    pin = F.col("text").rlike(r"(?<!\d)\d{6}(?!\d)").cast("int")
    df = df.withColumns({"_n": F.row_number().over(seq), "_pin": F.sum(pin).over(seq) - pin}).where((F.col("_n") <= most) & (F.col("_pin") == 0))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return df.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), ", ").alias("vendor_address"))


def supplemental(lines: DataFrame) -> DataFrame:
    """One row for each document that has any of the fields of LABELLED and SHAPED, bank details, taxes or an address."""
    fields = [s.field for s in LABELLED] + [s[0] for s in SHAPED]
    top = best(labelled_candidates(lines).unionByName(shaped_candidates(lines)), ["doc_id", "field"], [-F.col("score"), F.col("line_no")], ["value"])
    out = top.groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    for part in (bank_details(lines), tax_components(lines), vendor_address(lines)):
        out = out.join(part, "doc_id", "full")
    return out


def merge_supplemental(record: DataFrame, extra: DataFrame, longer: tuple[str, ...] = ("payment_terms", "transport_details", "bank_details")) -> DataFrame:
    """record with the fields of extra: its own value first where it has one; of `longer` fields the longer value."""
    mine = set(record.columns)
    x = extra.select("doc_id", *[F.col(c).alias(f"x_{c}") for c in extra.columns if c != "doc_id"])
    out = record.join(x, "doc_id", "left")
    for c in extra.columns:
        if c == "doc_id":
            continue
        theirs = F.col(f"x_{c}")
        if c not in mine:
            value = theirs
        elif c in longer:
            value = F.when(F.length(theirs) > F.coalesce(F.length(F.col(c)), F.lit(0)), theirs).otherwise(F.col(c))
        else:
            value = F.coalesce(F.col(c), theirs)
        out = out.withColumn(c, value).drop(f"x_{c}")
    return out


def scrub_identity(df: DataFrame) -> DataFrame:
    """vendor and buyer made to differ: invalid GSTINs are null, and a buyer's number or name equal to the vendor's is dropped."""
    for c in ("vendor_gstin", "buyer_gstin"):
        df = df.withColumn(c, F.when(I.is_gstin(F.col(c)), F.col(c)))
    same = F.col("vendor_gstin").eqNullSafe(F.col("buyer_gstin"))
    df = df.withColumn("buyer_gstin", F.when(~same, F.col("buyer_gstin")))
    key = lambda c: F.upper(F.regexp_replace(F.col(c), "[^A-Za-z0-9]", ""))
    return df.withColumn("buyer_name", F.when(~F.coalesce(key("vendor_name") == key("buyer_name"), F.lit(False)), F.col("buyer_name")))
