"""Cleaning of single fields: Column to Column, null where a value cannot be what its field asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import identifiers as I
from docloom.functions import predicates as P
from docloom.functions.text import as_text, collapse_repeats, comparison_key, normalize_line
from docloom.functions.values import bound, format_amount, invoice_date_candidates, is_invoice_date, parse_amount

# --- Fixed values: labels, shapes, places and names that fields are told by. ---
PHONE = r"(?<!\d)(?:\+?91[-\s]?)?(?:[6-9]\d{9}|\d{3,5}[-\s]?\d{6,8})(?!\d)"
EMAIL = r"(?i)[\w.%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
WEBSITE = r"(?i)(?:https?://|www\.)?[A-Z0-9.-]+\.(?:com|in|org|net|co\.in|biz|info)"
MAIL_HOSTS = ("gmail.com", "rediffmail.com", "yahoo.com", "hotmail.com", "outlook.com")
VEHICLE = r"^[A-Z]{2}\d{1,2}[A-Z]{1,3}\d{3,4}$"
ADDRESS_WORDS = ("pin", "code", "post", "dist", "state", ",", "road", "near")
NOISE = (
    r"destination|dispatch(?:ed)?(?: through)?|delivery note(?: date)?|bill of lading|lr[- /]?rr|motor vehicle(?: no)?|vehicle no|"
    r"bank details|bank name|account(?: no| number)?|ifsc|invoice no|invoice date|invoice value"
)
LABELS_ALONE = r"(?i)^(?:ship(?:ped)? to|bill(?:ed)? to|consignee|buyer|destination|dispatch|transporter?)$"
NUMBER_LABELS = r"^(?:INVOICE.*|VOUCHER.*|DATE.*|FOR|ORIGINAL.*|DUPLICATE.*|RECEIVER.*|SUPPLY.*|STORE.*|MATERIAL.*|ENTERPRISE.*|STATE.*|STATION.*|TOTAL.*|AMOUNT.*)$"
IDENTIFIER_LABELS = "INVOICE|DATE|TOTAL|AMOUNT|GSTIN|BUYER|VENDOR|TRANSPORT|VEHICLE|BANK"
TRANSPORT = ("transport", "transporter", "logistics", "roadline", "roadlines", "roadway", "roadways", "courier", "cargo", "express", "travels")
MODES = ("by road", "road", "canter", "truck", "lorry", "air", "sea", "rail")
TERMS = "day|credit|advance|immediate|net|due"
GOVERNMENT_PANS = ("AAAGN1030Q", "AAAGD0290L", "AAAGE0014G", "AAAGB0282M")
BANK_PREFIXES = {"HOFC": "HDFC", "HOBI": "HDFC", "SBII": "SBIN", "BKIO": "BKID"}
CITY_STATES = {
    "Telangana": ("hyderabad", "secunderabad", "warangal"),
    "Rajasthan": ("kota", "jaipur", "udaipur", "jodhpur", "rawatbhata", "rawatbhatta"),
    "Gujarat": ("ahmedabad", "surat", "vadodara", "rajkot", "gandhinagar"),
    "Maharashtra": ("mumbai", "pune", "nagpur", "nashik", "thane"),
    "Karnataka": ("bangalore", "bengaluru", "mysore", "mysuru"),
    "Tamil Nadu": ("chennai", "coimbatore", "madurai"),
    "Delhi": ("delhi", "new delhi"),
    "West Bengal": ("kolkata", "howrah"),
    "Uttar Pradesh": ("lucknow", "kanpur", "agra", "varanasi"),
    "Madhya Pradesh": ("bhopal", "indore"),
    "Chandigarh": ("chandigarh",),
    "Bihar": ("patna",),
    "Odisha": ("bhubaneswar",),
    "Assam": ("guwahati",),
    "Kerala": ("thiruvananthapuram", "kochi", "cochin"),
    "Andhra Pradesh": ("visakhapatnam", "vizag", "vijayawada"),
}
STATE_NAMES = {
    "06": "Haryana", "07": "Delhi", "08": "Rajasthan", "09": "Uttar Pradesh", "24": "Gujarat", "27": "Maharashtra",
    "29": "Karnataka", "33": "Tamil Nadu", "36": "Telangana",
}
LOCATION_NOISE = r"\b(?:speed post|past|output|figure|amount|taxable|bank)\b"
NOT_MENTIONED = "NOT_MENTIONED"
# --- End of fixed values. ---


def _or_null(value: Column, ok: Column) -> Column:
    return F.when(ok, value)


def soft_text(c: Column, most: int) -> Column:
    """A line of 2 to `most` characters, bars and underscores read as blanks; null if longer, or a mere label."""
    return bound(normalize_line(F.translate(c, "|_", "  ")), lambda t: _or_null(t, c.isNotNull() & F.length(t).between(2, most) & ~t.rlike(LABELS_ALONE)))


def is_business_text(c: Column, least: int, most: int) -> Column:
    """Whether a line has `least` to `most` characters, a letter or digit, and no signs but those of addresses."""
    line = normalize_line(c)
    return F.coalesce(F.length(line).between(least, most) & line.rlike(r"^[\p{L}\p{Nd}\s/\-.,:&()]*$") & line.rlike("[A-Za-z0-9]"), F.lit(False))


def without_noise(c: Column) -> Column:
    """A value up to the first label of another field."""
    return F.trim(F.regexp_replace(c, rf"(?i)\b(?:{NOISE})\b.*$", ""))


def _lookalike(c: Column) -> Column:
    return F.translate(c, "01578", "OISTB")


def invoice_number(c: Column, as_of: Column) -> Column:
    """One token of 1 to 20 characters, read as an invoice number; null if it is a date or a label read badly."""
    token = F.upper(F.regexp_replace(F.regexp_replace(c, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""), r"\s+", ""))
    read = F.upper(F.regexp_replace(I.repair_invoice_number(c), r"\s+", ""))
    value = F.when(token.rlike(r"^\d{1,12}$"), token).otherwise(read)
    return bound(value, lambda v: _or_null(v, I.is_invoice_number(v) & v.rlike("^[A-Z0-9/-]+$") & ~is_invoice_date(v, as_of) & ~_lookalike(v).rlike(NUMBER_LABELS)))


def identifier(c: Column, most: int, mixed: bool = False) -> Column:
    """A business identifier of 3 to `most` capitals, digits, points, dashes and slashes; with `mixed`, letters and digits."""
    value = F.upper(F.regexp_replace(F.regexp_replace(F.translate(c, "|_", "  "), r"\s+", ""), "^[^A-Za-z0-9]+|[^A-Za-z0-9]$", ""))

    def fine(v: Column) -> Column:
        ok = F.length(v).between(3, most) & v.rlike("^[A-Z0-9./-]+$") & (v.rlike(r"\d") | (F.length(v) > 5))
        if mixed:
            ok = ok & v.rlike(r"\d") & v.rlike("[A-Z]")
        return _or_null(v, ok & ~_lookalike(v).rlike(IDENTIFIER_LABELS))

    return bound(value, fine)


def gstin(c: Column) -> Column:
    """A valid number, repaired if its last two characters look misread or it is not valid as it is; else null."""

    def cleaned(key: Column) -> Column:
        doubtful = F.substring(key, 15, 1).rlike("[OQDILR]") | (F.substring(key, 14, 1) != "Z")
        fixed = bound(I.repair_gstin(key), lambda f: F.coalesce(F.when(I.is_gstin(f), f), F.when(I.is_gstin(key), key)))
        return F.when(F.length(key) == 15, F.when(I.is_gstin(key) & ~doubtful, key).otherwise(fixed))

    return bound(comparison_key(c), cleaned)


def is_government_gstin(c: Column) -> Column:
    """Whether the number holds one of the fixed PANs of government bodies."""
    return F.coalesce((F.length(c) >= 15) & F.substring(c, 3, 10).isin(*GOVERNMENT_PANS), F.lit(False))


def phones(c: Column) -> Column:
    """The different phone numbers of a value of up to 80 characters, 10 to 12 digits each, joined by commas."""
    found = F.regexp_extract_all(soft_text(c, 80), F.lit(PHONE), F.lit(0))

    def shown(digits: Column, raw: Column) -> Column:
        n = F.length(digits)
        local = (n == 10) | ((n == 11) & digits.startswith("0"))
        text = F.when((n == 12) & digits.startswith("91"), F.concat(F.lit("+91 "), F.substring(digits, 3, 10))).when(local, digits).otherwise(normalize_line(raw))
        return F.when(n.between(10, 12), text)

    each = F.transform(found, lambda raw: bound(F.regexp_replace(raw, r"\D", ""), lambda digits: shown(digits, raw)))
    return F.nullif(F.array_join(F.array_distinct(F.array_compact(each)), ", "), F.lit(""))


def email(c: Column) -> Column:
    """The first mail address, in lower case."""
    text = F.regexp_replace(soft_text(c, 200), r"(?i)\bemail[-: ]*", " ")
    return F.nullif(F.lower(F.regexp_extract(text, EMAIL, 0)), F.lit(""))


def website(c: Column) -> Column:
    """The first web address, from a `www.` on if there is one; none of the public mail hosts."""

    def found(text: Column) -> Column:
        had = F.instr(F.lower(text), "www.") > 0
        part = F.when(had, F.regexp_extract(text, r"(?i)www\..*$", 0)).otherwise(text)
        return bound(F.regexp_extract(part, WEBSITE, 0), lambda site: fine(site, had))

    def fine(site: Column, had: Column) -> Column:
        shown = F.when(had & ~F.lower(site).startswith("www."), F.concat(F.lit("www."), site)).otherwise(site)
        return _or_null(shown, (site != "") & ~P.any_of([F.lower(site).contains(h) for h in MAIL_HOSTS]))

    return bound(F.regexp_replace(soft_text(c, 200), r"(?i)\bwebsite[-: ]*", " "), found)


def pincode(c: Column) -> Column:
    """The first six-digit number from 100000 to 899999 with an address word in the 40 characters before it, else the first."""
    pieces = F.split(c, r"\b(?=\d{6}\b)")

    def candidate(piece: Column, i: Column) -> Column:
        ahead = F.lower(F.right(F.array_join(F.slice(pieces, F.lit(1), i), ""), F.lit(40)))
        near = P.any_of([ahead.contains(w) for w in ADDRESS_WORDS])
        return F.struct((~near).alias("far"), F.regexp_extract(piece, r"^\d{6}\b", 0).alias("code"))

    found = F.filter(F.transform(pieces, candidate), lambda x: x["code"].between("100000", "899999"))
    return bound(found, lambda codes: F.coalesce(F.get(F.filter(codes, lambda x: ~x["far"]), 0), F.get(codes, 0))["code"])


def vehicle(c: Column) -> Column:
    return bound(comparison_key(c), lambda v: _or_null(v, v.rlike(VEHICLE)))


def ifsc(c: Column) -> Column:
    """Eleven characters: a prefix of letters, misread ones and misread banks put right, a zero and six more."""
    key = comparison_key(c)
    prefix = F.translate(F.substring(key, 1, 4), "015826", "OISBZG")
    known = F.create_map(*[F.lit(x) for pair in BANK_PREFIXES.items() for x in pair])
    fixed = F.concat(F.coalesce(F.try_element_at(known, prefix), prefix), F.translate(F.substring(key, 5, 7), "OQD", "000"))
    return _or_null(fixed, (F.length(key) == 11) & fixed.rlike("^[A-Z]{4}0[A-Z0-9]{6}$"))


def account_number(c: Column, details: Column) -> Column:
    """8 to 18 digits: labelled in the value, the value's own, labelled in the bank details, or the longest there."""
    label = r"(?i)(?:a/c(?:\s*no)?|account(?:\s*(?:no|number))?)\s*[:=-]?\s*([0-9\- ]{8,24})"

    def longest(text: Column, pattern: str, group: int) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.regexp_replace(x, r"\D", ""))
        fine = F.filter(found, lambda x: F.length(x).between(8, 18))
        return F.array_max(F.transform(fine, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("at"), x.alias("v"))))["v"]

    own = F.regexp_replace(soft_text(c, 30), r"\D", "")
    own = _or_null(own, F.length(own).between(8, 18))
    return F.coalesce(longest(c, label, 1), own, longest(details, label, 1), longest(c, r"\b\d{12,18}\b", 0), longest(details, r"\b\d{8,18}\b", 0))


def city_state(c: Column) -> Column:
    """The state of a well-known city, else null."""
    pairs = [F.lit(x) for state, cities in CITY_STATES.items() for city in cities for x in (city, state)]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(c)))


def state_name(code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in STATE_NAMES.items() for x in pair]), code)


def state_case(c: Column) -> Column:
    """A name in capitals with only its words' first letters left large; other names trimmed."""
    text = F.trim(c)
    words = F.array_join(F.transform(F.split(text, "-"), lambda w: F.initcap(w)), "-")
    return F.when(text == F.upper(text), words).otherwise(text)


def location(c: Column) -> Column:
    """A place: letters and few signs, without codes and labels behind it, of four words at most unless well known."""
    text = soft_text(c, 80)
    for pattern in (r"^[>.,\-\s]+", r"^[A-Z]\s+(?=[A-Z][a-z])", r"\s*\(\d{1,2}\)\s*$", r"(?i),?\s*state\s*$", r"(?i)\s*place\s+of\s+supply.*$", r"(?i)\s*state\s*code.*$", r"[,.;:-]+$"):
        text = F.regexp_replace(text, pattern, "")

    def fine(t: Column) -> Column:
        lower = F.lower(t)
        words = F.size(F.array_remove(F.split(F.regexp_replace(lower, "[^a-z ]", " "), r"\s+"), ""))
        noise = lower.contains("invoice") | lower.contains("gstin") | lower.rlike(LOCATION_NOISE)
        return _or_null(t, t.rlike("^[A-Za-z][A-Za-z .,&()/:-]{1,60}$") & ~noise & (city_state(t).isNotNull() | words.between(1, 4)))

    return bound(F.trim(text), fine)


def place_of_supply(c: Column, state: Column, code: Column) -> Column:
    """The place, as its state if it is a known city; else the state, else the name of the state code."""
    place = bound(location(c), lambda t: F.coalesce(city_state(state_case(t)), state_case(t)))
    return F.coalesce(place, state_case(location(state)), state_case(state_name(code)))


def state(c: Column, code: Column, place: Column) -> Column:
    """The state; else the place of supply; else the name of the state code."""
    return F.coalesce(state_case(location(c)), state_case(location(place)), state_case(state_name(code)))


def transport_details(c: Column) -> Column:
    """A carrier or a way of transport, of 3 to 60 characters."""
    text = without_noise(_or_null(normalize_line(c), is_business_text(c, 3, 60)))
    text = F.regexp_replace(text, r"(?i)^(?:dispatch(?:ed)?\s+through|transport(?:er)?(?:\s+name)?|nm\.?)\s*[:=-]\s*", "")

    def fine(t: Column) -> Column:
        lower = F.lower(t)
        dated = lower.rlike(r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b")
        return _or_null(t, (P.contains_any(t, TRANSPORT) | lower.isin(*MODES)) & t.rlike("[A-Za-z]") & ~dated & ~lower.contains("phone"))

    return bound(F.trim(text), fine)


def transporter_name(c: Column, dispatch: Column, details: Column) -> Column:
    """The first of three values that names a carrier."""
    named = lambda v: bound(transport_details(v), lambda t: _or_null(t, F.lower(t).rlike("transport|logistics|roadline|roadway|courier|cargo|travels")))
    return F.coalesce(named(c), named(dispatch), named(details))


def dispatch(c: Column) -> Column:
    """How goods are sent: a carrier, a way, or three words at most that are no vehicle."""
    text = F.regexp_replace(without_noise(F.regexp_replace(soft_text(c, 100), r"(?i)^dispatch(?:ed)? through\s*[:=-]?\s*", "")), r"(?i)^destin\w*\s*[:=-]?\s*", "")

    def fine(t: Column) -> Column:
        lower = F.lower(t)
        short = F.size(F.split(t, r"\s+")) <= 3
        carrier = P.contains_any(t, TRANSPORT) | lower.isin(*MODES)
        odd = lower.contains("@") | lower.contains("phone") | lower.contains("terms of payment") | lower.rlike(r"\bwithin\s+\d+\s+days\b")
        return _or_null(t, (t != "") & (carrier | short) & ~odd & ~comparison_key(t).rlike(VEHICLE))

    return bound(F.trim(text), fine)


def reference(c: Column, delivery_note: bool = False) -> Column:
    """An order's reference or a delivery note's, of 3 characters or more; an order's has a digit, slash or dash."""
    text = F.regexp_replace(soft_text(c, 100), r"(?i)^(?:order reference|other references?|reference code|reference|delivery note)\s*[:=-]?\s*", "")

    def fine(t: Column) -> Column:
        odd = F.lower(t).rlike("@|mob|phone|mode/|gst|dispatch|invoice") | (F.size(invoice_date_candidates(t)) > 0)
        return _or_null(t, (F.length(t) >= 3) & ~odd & (F.lit(delivery_note) | t.rlike("[0-9/-]")))

    return bound(F.trim(without_noise(text)), fine)


def payment_terms(c: Column) -> Column:
    text = without_noise(_or_null(normalize_line(c), is_business_text(c, 3, 40)))
    text = F.trim(F.regexp_replace(text, r"(?i)^(?:mode/terms of payment|terms of payment|payment terms)\s*[:=-]?\s*", ""))
    return _or_null(text, F.lower(text).rlike(TERMS) | text.rlike(r"\d"))


def bank_details(c: Column) -> Column:
    """A line of 8 to 100 characters that names a bank or account and holds a number of either."""
    text = F.regexp_replace(normalize_line(c), r"(?i)\b(?:grand total|amount payable|taxable value|email|tel\.?|phone)\b.*$", "")
    ok = F.lower(text).rlike("bank|account|a/c|ifsc") & (text.rlike(r"\d{8,18}") | text.rlike(r"\b[A-Z]{4}0[A-Z0-9]{6}\b"))
    return _or_null(F.trim(text), is_business_text(c, 8, 100) & ok)


def bank_name(c: Column, details: Column) -> Column:
    """The name before and with the word Bank, in the value or else in the bank details."""
    known = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?i)\bHO(?:FC|BI)\b", "HDFC"), r"(?i)\bSBII\b", "SBIN")
    shape = r"\b([A-Z][A-Za-z.&]+(?:\s+[A-Z][A-Za-z.&]+){0,4}\s+Bank(?:\s+of\s+[A-Z][A-Za-z.&]+){0,2})\b"
    label = r"(?i)^(?:bank details|bank name)\s*[:=-]*\s*"
    named = lambda t: F.nullif(F.regexp_extract(F.regexp_replace(known(soft_text(t, 120)), label, ""), shape, 1), F.lit(""))
    weak = F.lower(c).rlike("^(?:our|s) bank$|bank details$|bank tame|compan(?:y's|ys) bank|details of")
    return F.coalesce(F.when(~F.coalesce(weak, F.lit(False)), named(c)), named(details), named(c))


def address(c: Column) -> Column:
    """An address of 10 to 240 characters: without web, tax and order numbers, ended by its pincode, no part twice."""
    text = soft_text(c, 240)
    for pattern in (
        r"(?i)^\(?\s*(?:ship(?:ped)? to|bill(?:ed)? to|buyer)\s*\)?\s*[,:-]*\s*", r"(?i)\b(?:www\.|https?://)\S+", r"(?i)\bemail[-: ]*\S+",
        rf"(?i)\b(?:{NOISE}|gstin(?:/uin)?|purchase order|buyer'?s order|transporter|vehicle)\b.*$", r"\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]\b",
        r"(?i)\bPAN\s*[-:=]?\s*[A-Z]{5}\d{4}[A-Z]\b", r"(?i),?\s*State\s*(?:Code)?\s*[-:=]?\s*\d{1,2}\b",
    ):
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(F.regexp_replace(text, r"(\b\d{6}\b).*$", "$1"), r"\s*,(?:\s*,)+", ",")
    text = F.trim(F.regexp_replace(text, r"^[,\s]+|[,\s]+$", ""))
    return bound(normalize_line(bound(text, collapse_repeats)), lambda t: _or_null(t, c.isNotNull() & (F.length(t) >= 10) & (P.is_address_like(t) | P.is_government_like(t))))


def is_party_name(c: Column, vendor: bool) -> Column:
    """Whether a value can be a party's name: two words of letters, more letters than digits, no label and no section.

    A vendor's has no bank, carrier or office in it; a buyer's none of the words that end the buyer's section.
    """
    name = normalize_line(c)
    words = F.size(F.filter(F.split(name, " "), lambda w: w.rlike(r"^[\p{L}.&'(),-]{2,}$")))
    letters, digits = F.length(F.regexp_replace(name, r"\P{L}", "")), F.length(F.regexp_replace(name, r"\D", ""))
    fine = is_business_text(c, 3, 100) & (words >= 2) & (digits < letters) & ~P.is_header_noise(name) & ~name.rlike(r"(?i)gstin|\bdated?\b|@|www\.|invoice no")
    other = P.contains_any(name, P.BANK) | P.contains_any(name, P.LOGISTICS) if vendor else P.contains_any(name, P.BUYER_STOP)
    return F.coalesce(fine & ~other, F.lit(False))


def party_name(c: Column, vendor: bool) -> Column:
    """A party's name without section labels, year ranges and repeated parts; null if nothing of it can be one."""
    text = normalize_line(c)
    for pattern in (
        r"(?i)^\(?\s*(?:if other than consignee|ship(?:ped)? to|bill(?:ed)? to|consignee|buyer|details of (?:buyer|purchaser|receiver|recipient|consignee))(?:\s*\([^)]*\))?\s*\)?\s*[,:-]*\s*",
        r"(?i)^(?:party name|party|name|address|customer code)\s*[:=,-]+\s*", r"^[^A-Za-z0-9]+", r"\s*\(\d{4}[-/]\d{2,4}\)\s*$", r"[\s,]+$",
    ):
        text = F.regexp_replace(text, pattern, "")
    return bound(bound(text, collapse_repeats), lambda t: _or_null(t, is_party_name(t, vendor)))


def positive_amount(c: Column) -> Column:
    """An amount above zero in plain notation."""
    return bound(parse_amount(c), lambda v: F.when(v > 0, format_amount(v)))


def mentioned(c: Column) -> Column:
    """The value, or the word that stands for a missing one."""
    text = as_text(c)
    return F.when(F.trim(text) == "", NOT_MENTIONED).otherwise(text)
