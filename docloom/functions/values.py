"""Amounts, dates and numbers in words, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.predicates import BANK, contains_any
from docloom.functions.text import as_text, digit_lookalikes, normalize_line

# --- Fixed values: patterns, formats and number words. ---
AMOUNT = r"(?i)(?<![A-Za-z0-9])(₹|RS\.?|INR)?\s*(\d{1,3}(?:,\s*\d{2,3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)(?![A-Za-z0-9])"
LEAST_AMOUNT = 100.0
MOST_AMOUNT = 999_999_999.0
ID_DATE = r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.]((?:19|20)\d{2})\b"
ID_DATE_FUZZY = r"\b[0-9OQDILSZBG]{1,2}[/\-.][0-9OQDILSZBG]{1,2}[/\-.][0-9OQDILSZBG]{4}\b"
INVOICE_DATES = (
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b\d{1,2}-\d{1,2}-\d{2,4}\b", r"\b\d{1,2}\.\d{1,2}\.\d{2,4}\b",
    r"\b\d{1,2}\.[A-Za-z]{3,9}\.\d{2,4}\b", r"\b\d{1,2}-[A-Za-z]{3,9}-\d{2,4}\b", r"\b\d{4}-\d{1,2}-\d{1,2}\b",
)
MEDICAL_DATE = r"(?i)\b(?:\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{1,2}[./-][A-Za-z]{3,9}[./-]\d{2,4}|\d{1,2}\s+[A-Za-z]{3,9},?\s+\d{2,4})\b"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
UNITS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
    "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
)
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
SCALES = {"thousand": 1_000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000, "crore": 10_000_000, "crores": 10_000_000}
# --- End of fixed values. ---


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often it is used: the variable of a one-element transform."""
    return F.transform(F.array(value), use)[0]


# --- amounts -----------------------------------------------------------------------------------------------------------


def amount_text(c: Column) -> Column:
    """A line with blanks after thousands commas and the currency word taken out."""
    text = F.regexp_replace(as_text(c), r"(?<=\d),\s+(?=\d)", ",")
    return F.replace(F.replace(text, F.lit("Rs."), F.lit("")), F.lit("Rs"), F.lit(""))


def numeric_tokens(c: Column) -> Column:
    """The numbers of a line as they are written, in order."""
    return F.regexp_extract_all(amount_text(c), F.lit(AMOUNT), F.lit(2))


def parse_amount(token: Column) -> Column:
    """The number as decimal(18,4). Null if it has over 12 characters or exceeds MOST_AMOUNT.

    Without a point, a comma before exactly two last digits is the decimal sign; other commas group digits.
    """
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(token, r"(?i)rs\.?|₹|INR| ", ""), r",\.(?=\d)", "."))

    def value(t: Column) -> Column:
        last = F.substring_index(t, ",", -1)
        whole = F.replace(F.substring(t, F.lit(1), F.length(t) - F.length(last) - 1), F.lit(","), F.lit(""))
        decimal = t.contains(",") & ~t.contains(".") & (F.length(last) == 2)
        return F.when(decimal, F.concat(whole, F.lit("."), last)).otherwise(F.replace(t, F.lit(","), F.lit("")))

    # Most tokens are plain numbers already.
    plain = F.when(token.rlike(r"^\d++(?:\.\d++)?$"), token).otherwise(bound(cleaned, value))
    number = bound(plain, lambda p: F.when((p != "") & (F.length(p) <= 12), p.try_cast("decimal(18,4)")))
    return bound(number, lambda v: F.when(v <= MOST_AMOUNT, v))


def format_amount(value: Column) -> Column:
    """Plain notation without trailing zeros."""
    text = value.cast("decimal(18,4)").cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def amounts(c: Column, banking: Column | None = None) -> Column:
    """The amounts of a line: an array of (token, value, percent, currency), of LEAST_AMOUNT or more.

    Lines about bank details have none; banking says which, if that is known already. percent: a % follows; currency: written with a comma or a point.
    """
    text = F.regexp_replace(as_text(c), r"(?<=\d),\s+(?=\d)", ",")
    # The token with what follows it up to a percent sign, found by the same pattern.
    found = F.regexp_extract_all(amount_text(c), F.lit(AMOUNT + r"(\s*%)?"), F.lit(0))

    tokens = F.transform(found, lambda raw: F.struct(F.regexp_extract(raw, AMOUNT + r"(\s*%)?", 2).alias("token"), raw.endswith("%").alias("percent")))

    def one(t: Column) -> Column:
        token = t["token"]
        return F.struct(token.alias("token"), parse_amount(token).alias("value"), t["percent"].alias("percent"), (token.contains(",") | token.contains(".")).alias("currency"))

    kept = F.filter(F.transform(tokens, one), lambda a: a["value"] >= LEAST_AMOUNT)
    return F.when(~(contains_any(text, BANK) if banking is None else banking), kept).otherwise(F.filter(kept, lambda a: F.lit(False)))


def amount_in_words(c: Column) -> Column:
    """The number that an amount in words says, in whole units; null if it says none.

    Indian scales. What stands before `indian rupees` does not count, nor what follows the word for a hundredth.
    """
    text = F.replace(F.lower(as_text(c)), F.lit("fourty"), F.lit("forty"))
    text = normalize_line(F.regexp_replace(text, r"[^a-z\s]", " "))
    text = F.when(text.contains("indian rupees"), F.regexp_replace(text, r"^.*?indian rupees", "")).otherwise(text)
    text = normalize_line(F.regexp_replace(text, "rupees|rupee|rs", " "))
    words = F.split(text, " ")
    stop = F.transform(words, lambda w: w.startswith("pais"))
    at = F.coalesce(F.nullif(F.array_position(stop, True), F.lit(0).cast("long")), F.lit(10_000_000).cast("long"))
    words = F.slice(words, F.lit(1), F.greatest((F.least(at, F.size(words).cast("long") + 1) - 1).cast("int"), F.lit(0)))
    number = F.create_map(*[F.lit(x) for pair in [*zip(UNITS, range(20), strict=True), *zip(TENS, range(20, 100, 10), strict=True)] for x in pair])
    scale = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])
    state = lambda total, current, seen: F.struct(total.cast("long").alias("total"), current.cast("long").alias("current"), seen.alias("seen"))

    def step(acc: Column, w: Column) -> Column:
        n, s = F.try_element_at(number, w), F.try_element_at(scale, w)
        return (
            F.when(n.isNotNull(), state(acc["total"], acc["current"] + n, F.lit(True)))
            .when(w == "hundred", state(acc["total"], F.when(acc["current"] == 0, 100).otherwise(acc["current"] * 100), F.lit(True)))
            .when(s.isNotNull(), state(acc["total"] + acc["current"] * s, F.lit(0), F.lit(True)))
            .otherwise(state(acc["total"], acc["current"], acc["seen"]))
        )

    zero = state(F.lit(0), F.lit(0), F.lit(False))
    return F.aggregate(words, zero, step, lambda a: F.when(a["seen"], a["total"] + a["current"]))


def words_of_amount(value: Column) -> Column:
    """A whole number below a hundred crores in words: what amount_in_words reads back."""
    value = value.cast("long")
    units, tens = F.array(*[F.lit(x) for x in UNITS]), F.array(*[F.lit(x) for x in TENS])

    def below_hundred(n: Column) -> Column:
        return F.when(n < 20, F.get(units, n.cast("int"))).otherwise(
            F.concat_ws(" ", F.get(tens, (F.floor(n / 10) - 2).cast("int")), F.when(n % 10 > 0, F.get(units, (n % 10).cast("int"))))
        )

    parts = []
    for divisor, modulus, name in ((10_000_000, 100, "crore"), (100_000, 100, "lakh"), (1_000, 100, "thousand"), (100, 10, "hundred")):
        n = F.floor(value / divisor) % modulus
        parts.append(F.when(n > 0, F.concat_ws(" ", below_hundred(n), F.lit(name))))
    rest = value % 100
    parts.append(F.when((rest > 0) | (value == 0), below_hundred(rest)))
    return F.concat_ws(" ", *parts)


# --- dates -------------------------------------------------------------------------------------------------------------


def normalize_id_date(c: Column) -> Column:
    """dd/MM/yyyy of the first day-first date, look-alike letters read as digits; else the text itself, trimmed."""

    def made(text: Column) -> Column:
        part = lambda k: F.regexp_extract(text, ID_DATE, k)
        day = F.concat_ws("/", F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"), part(3))
        return F.when(text.rlike(ID_DATE), day).otherwise(F.trim(text))

    return bound(digit_lookalikes(c), made)


def id_dates(c: Column) -> Column:
    """All dates of a text as dd/MM/yyyy, clearly written ones first, each once."""
    text = F.upper(as_text(c))
    found = F.concat(F.regexp_extract_all(text, F.lit(ID_DATE), F.lit(0)), F.regexp_extract_all(text, F.lit(ID_DATE_FUZZY), F.lit(0)))
    return F.array_distinct(F.transform(found, normalize_id_date))


def is_id_date(c: Column) -> Column:
    """A date in one of five forms; days past the end of a month count up to the 31st, as lenient calendars take them."""
    day_first = c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$") | c.rlike(r"^\d{2}-\d{2}-\d{4}$") | c.rlike(r"^\d{2}\.\d{2}\.\d{4}$")
    parts = F.split(c, r"[/\-.]")
    d, m = F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int")
    last = F.get(parts, 2).try_cast("int")
    first = day_first & d.between(1, 31) & m.between(1, 12)
    iso = c.rlike(r"^\d{4}-\d{2}-\d{2}$") & last.between(1, 31) & m.between(1, 12)
    return F.coalesce(first | iso, F.lit(False))


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null if there is no such day."""
    y = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).when(F.length(year) == 4, year)
    return F.when(y.isNotNull() & month.isNotNull(), F.concat_ws("-", y, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date"))


def _month(name: Column, full: bool) -> Column:
    """The number of a month's English name, of three letters or, if full, whole."""
    names = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    number = {m: f"{k:02d}" for k, m in enumerate(MONTHS, 1)} | ({m: f"{k:02d}" for k, m in enumerate(names, 1)} if full else {})
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in number.items() for x in pair]), F.lower(name))


def invoice_date_candidates(c: Column) -> Column:
    """Texts shaped like dates, by kind and then by place, repeats included."""
    return F.flatten(F.array(*[F.regexp_extract_all(as_text(c), F.lit(p), F.lit(0)) for p in INVOICE_DATES]))


def parse_invoice_date(c: Column) -> Column:
    """The day that a text names, day first or ISO, strictly; else null. Two-digit years only after points or month names."""
    slash, dash, point = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{1,2})-(\d{1,2})-(\d{4})$", r"^(\d{1,2})\.(\d{1,2})\.(\d{2}|\d{4})$"
    named, named_point, iso = r"^(\d{1,2})-([A-Za-z]{3})-(\d{2}|\d{4})$", r"^(\d{1,2})\.([A-Za-z]{3})\.(\d{4})$", r"^(\d{4})-(\d{2})-(\d{2})$"

    def day(t: Column) -> Column:
        part = lambda p, k: F.regexp_extract(t, p, k)
        out = F.lit(None).cast("date")
        for p in (slash, dash, point):
            out = F.when(t.rlike(p), _date(part(p, 3), part(p, 2), part(p, 1))).otherwise(out)
        for p in (named, named_point):
            out = F.when(t.rlike(p), _date(part(p, 3), _month(part(p, 2), False), part(p, 1))).otherwise(out)
        return F.when(t.rlike(iso), _date(part(iso, 1), part(iso, 2), part(iso, 3))).otherwise(out)

    return bound(c, day)


def is_invoice_date(c: Column, as_of: Column) -> Column:
    """A day of 2000 or later, and no later than three months after as_of."""
    day = parse_invoice_date(c)
    return F.coalesce((F.year(day) >= 2000) & (day <= F.add_months(as_of, 3)), F.lit(False))


def repair_future_date(c: Column, as_of: Column) -> Column:
    """The day of a text; one that lies too far ahead is taken back by ten, twenty or thirty years."""
    day, latest = parse_invoice_date(c), F.add_months(as_of, 3)
    out = day
    for years in (30, 20, 10):
        back = F.add_months(day, -12 * years)
        out = F.when((day > latest) & (back <= latest) & (F.year(back) >= 2000), back).otherwise(out)
    return out


def parse_medical_date(c: Column) -> Column:
    """The day that a certificate's date names: digits or English months, look-alikes repaired; else null."""
    numeric, named = r"^(\d{1,2})([./-])(\d{1,2})\2(\d{2}|\d{4})$", r"^(\d{1,2})[- ]([A-Za-z]{3,9})[- ](\d{2}|\d{4})$"

    def digits(t: Column) -> Column:
        return F.when(t.rlike(r"[./-]") & ~t.rlike(r"(?i)\b[A-Z]{3,}\b"), F.translate(t, "OoQDIl|", "0000111")).otherwise(t)

    def day(t: Column) -> Column:
        part = lambda p, k: F.regexp_extract(t, p, k)
        by_name = _date(part(named, 3), _month(part(named, 2), True), part(named, 1))
        return F.when(t.rlike(numeric), _date(part(numeric, 4), part(numeric, 3), part(numeric, 1))).when(t.rlike(named), by_name)

    return bound(bound(normalize_line(F.replace(c, F.lit(","), F.lit(" "))), digits), day)


def medical_dates(c: Column) -> Column:
    """All days that a text names, in order."""
    found = F.regexp_extract_all(as_text(c), F.lit(MEDICAL_DATE), F.lit(0))
    return F.filter(F.transform(found, parse_medical_date), lambda d: d.isNotNull())


def first_medical_date(c: Column) -> Column:
    return F.get(medical_dates(c), 0)


def days_inclusive(start: Column, end: Column) -> Column:
    """How many days from start to end, both counted; null if reversed."""
    return F.when(end >= start, F.datediff(end, start) + 1)


def day_count_word(c: Column) -> Column:
    """one to thirty-one as a number; else null."""
    word = F.lower(F.trim(c))
    names = [*UNITS[1:], "twenty", *[f"twenty-{u}" for u in UNITS[1:10]], "thirty", "thirty-one"]
    return reduce(lambda acc, p: F.when(word == p[1], p[0]).otherwise(acc), enumerate(names, 1), F.lit(None).cast("int"))
