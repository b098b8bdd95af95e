"""Fields of medical leave certificates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import values as V
from docloom.functions.predicates import any_of, keyword_hits
from docloom.functions.text import as_text, normalize_line
from docloom.operators.classify import ORGANIZATIONS, select_pages
from docloom.operators.lines import plain_lines
from docloom.operators.rank import best
from docloom.session import stored

# --- Fixed values: phrases, titles and patterns of certificates. ---
NOT_ORGANIZATION = (
    "government of india", "department of atomic energy", "medical certificate", "fitness certificate", "certificate",
    "doctor", "registration", "report no", "signature", "circular", "recruitment", "mandatory courses",
    "attention is invited", "consumption of mandatory courses",
)
NOT_ORGANIZATION_START = (
    "this is to certify", "i, dr", "period of absence", "absence from duty", "from ", "mandatory courses",
    "attention is invited", "she / he",
)
ORGANIZATION_NOISE = ("doctor", "signature", "reg", "circular", "recruitment")
RANGE_WORDS = ("absence", "rest", "from", "to", "duty", "leave")
DOCTOR_NOISE = ("dr", "doctor", "signature", "registration", "stamp", "medical officer")
TITLE = "(?:mr|ms|mrs|shri|smt|kum|patient|pt)"
AFTER_NAME = r"(?=\s*(?:\(\d{4,}\)|is\b|aged\b|of\b|$))"
NAMED = rf"(?i){TITLE}(?:\s*/\s*{TITLE})*\.?\s+([A-Za-z][A-Za-z0-9 .()/'-]{{1,80}}?)"
RANGE = r"(?i)from\s+(.{1,30}?)\s+to\s+(.{1,30}?)(?=\s|$)"
DAYS = r"(?i)days?\s*[:.]*\s*(\d{1,3})\s*(?:days?)?\b"
DAYS_BEFORE = r"(?i)\b(\d{1,3})\s*days?\b"
DAYS_WORD = r"(?i)days?\s*[:.]*\s*([A-Za-z-]+)\b"
# --- End of fixed values. ---


def _holds(lower: Column, words: tuple[str, ...]) -> Column:
    return any_of([lower.contains(w) for w in words])


def repair_handwriting(c: Column) -> Column:
    """Letters beside digits or date signs read as digits, unless they belong to a word, such as a month; a 7 or T between digits as a slash where a date results."""
    text = as_text(c)
    for letter, digit in (("I", "1"), ("l", "1"), ("O", "0"), ("o", "0")):
        text = F.regexp_replace(text, rf"(?<=[\d./-]){letter}(?![A-Za-z])|(?<![A-Za-z]){letter}(?=[\d./-])", digit)
    return F.regexp_replace(text, r"(\d{1,2})[7T](\d{1,2})[7T](\d{2,4})", "$1/$2/$3")


def organization(c: Column) -> Column:
    """A line as the name of an organisation, or null."""
    text = F.regexp_replace(normalize_line(c), r"(?i)\b(?:for|fitness)\b.*$", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"\(\d{4,}\)", ""), r"(?i)\bhospita\b", "HOSPITAL"))
    start = "|".join(NOT_ORGANIZATION_START)
    inside = "|".join(NOT_ORGANIZATION)

    def name(t: Column) -> Column:
        bad = F.lower(t).rlike(f"^(?:{start})|{inside}") | V.first_medical_date(t).isNotNull()
        return F.when(~bad & (F.length(F.regexp_replace(t, r"\P{L}", "")) >= 4), t)

    return V.bound(text, name)


def applicant(c: Column) -> Column:
    """A text as a person's name, without titles, staff numbers and what follows the name; or null."""
    name = F.regexp_replace(normalize_line(c), r"\(\d{4,}\)", " ")
    name = F.regexp_replace(name, r"(?i)\b(?:of|aged|is\s+suffering)\b.*$", "")
    name = normalize_line(F.regexp_replace(name, "[^A-Za-z .'-]", " "))
    name = F.trim(F.regexp_replace(name, rf"(?i)^(?:{TITLE}\.?\s*/?\s+)+", ""))

    def fine(n: Column) -> Column:
        letters = F.length(F.regexp_replace(n, r"\P{L}", ""))
        return F.when(n.rlike("^[A-Za-z .'-]{3,80}$") & (letters >= 3) & ~F.lower(n).rlike("government|department|doctor"), n)

    return V.bound(name, fine)


def _organization_rows(lines: DataFrame, source: int) -> DataFrame:
    df = lines.withColumn("value", organization(F.col("text"))).where("value is not null")
    lower, i = F.lower("value"), F.col("line_no") - 1
    letters, capitals = F.length(F.regexp_replace("value", r"\P{L}", "")), F.length(F.regexp_replace("value", r"\P{Lu}", ""))
    score = F.when((letters >= 6) & (capitals >= F.ceil(letters * 0.75)), 80).otherwise(0) + 30 * keyword_hits(lower, ORGANIZATIONS)
    score = score + F.when(lower.contains("hospital"), 45).otherwise(0) + F.when(lower.contains("nuclear fuel complex"), 55).otherwise(0)
    score = score + F.when(i <= 2, 20).otherwise(0) + F.greatest(F.lit(0), 18 - 2 * i) + F.least(F.lit(35), F.length("value"))
    score = score - F.when(lower.contains("medical officer"), 80).otherwise(0) - F.when(_holds(lower, ORGANIZATION_NOISE), 80).otherwise(0)
    return df.select("doc_id", F.lit("organization_name").alias("field"), "value", score.alias("score"), "line_no", F.lit(source).alias("source"))


def _applicant_rows(lines: DataFrame, source: int) -> DataFrame:
    text = F.col("text")
    ahead = F.greatest(F.lit(0), F.lit(16) - F.col("line_no"))
    label = F.regexp_extract(text, r"(?i)\b(?:name|applicant)\s*[:.]+\s*(.{0,80})$", 1)
    specs = (
        (label, text.rlike(r"(?i)\b(?:name|applicant)\s*[:.]"), 150),
        (F.regexp_extract(text, NAMED + r"(?=\s*(?:\(\d{4,}\))?\s+of\b)", 1), text.rlike(NAMED + r"(?=\s*(?:\(\d{4,}\))?\s+of\b)"), 130),
        (F.regexp_extract(text, NAMED + AFTER_NAME, 1), text.rlike(NAMED + AFTER_NAME), 120),
    )
    each = F.array(*[F.struct(applicant(F.when(on, value)).alias("value"), (ahead + base).alias("score")) for value, on, base in specs])
    df = lines.select("doc_id", "line_no", F.explode(each).alias("c")).where("c.value is not null")
    return df.select("doc_id", F.lit("applicant_name").alias("field"), "c.value", "c.score", "line_no", F.lit(source).alias("source"))


def _range_rows(docs: DataFrame, lines: DataFrame, source: int) -> DataFrame:
    """(doc_id, from_date, to_date, score, line_no, source): ranges on a line, then of the joined text, then two dates in order."""
    lines = lines.withColumn("text", V.bound(F.col("text"), repair_handwriting))
    text = F.col("text")
    lower = F.lower(text)
    start, end = F.regexp_extract(text, RANGE, 1), F.regexp_extract(text, RANGE, 2)
    score = 100 + 12 * keyword_hits(lower, RANGE_WORDS) + F.when(lower.contains("with effect from"), 20).otherwise(0)
    score = score + F.when(lower.contains("advised rest"), 25).otherwise(0) - F.when(_holds(lower, DOCTOR_NOISE), 40).otherwise(0)
    score = score + F.greatest(F.lit(0), F.lit(19) - F.col("line_no"))
    on_line = lines.select("doc_id", V.first_medical_date(start).alias("from_date"), V.first_medical_date(end).alias("to_date"), score.alias("score"), "line_no")
    joined = repair_handwriting(F.replace(as_text(F.col("text")), F.lit("\n"), F.lit(" ")))
    dates = V.medical_dates(joined)
    hint = F.lower(joined).rlike(r"\b(?:absence|rest|from|to|leave)\b")
    whole = docs.select(
        "doc_id",
        F.coalesce(V.first_medical_date(F.regexp_extract(joined, RANGE, 1)), F.when(hint, F.get(dates, 0))).alias("from_date"),
        F.coalesce(V.first_medical_date(F.regexp_extract(joined, RANGE, 2)), F.when(hint, F.get(dates, 1))).alias("to_date"),
        F.lit(1).alias("score"),
        F.lit(0).alias("line_no"),
    )
    return on_line.unionByName(whole).where("from_date <= to_date").withColumn("source", F.lit(source))


def _day_rows(lines: DataFrame, source: int) -> DataFrame:
    text = F.col("text")
    said = F.coalesce(
        F.nullif(F.regexp_extract(text, DAYS, 1), F.lit("")).try_cast("int"),
        F.nullif(F.regexp_extract(text, DAYS_BEFORE, 1), F.lit("")).try_cast("int"),
        V.day_count_word(F.regexp_extract(text, DAYS_WORD, 1)),
    )
    lower = F.lower(text)
    score = 90 + F.when(_holds(lower, ("absence", "rest")), 25).otherwise(0) + F.when(lower.contains("days"), 10).otherwise(0)
    score = score + F.when(lower.contains("with effect from"), 12).otherwise(0) - F.when(_holds(lower, DOCTOR_NOISE), 25).otherwise(0)
    return lines.select("doc_id", said.alias("days"), score.alias("score"), "line_no", F.lit(source).alias("source")).where("days between 1 and 365")


def extract_certificates(pages: DataFrame) -> DataFrame:
    """(doc_id, organization_name, applicant_name, from_date, to_date, total_absent_days) of pages (doc_id, page_no, text).

    The leave page is read first, then all relevant pages; the organisation first from the first relevant page. Dates
    are dd-MM-yyyy. Days that miss the range by more than one give way to the range's count. Documents without a
    relevant page have nulls; null texts count as blank pages.
    """
    chosen = stored(select_pages(pages))
    part = lambda c: chosen.select("doc_id", F.col(c).alias("text"))
    primary, header, both = part("primary_text"), part("header_text"), part("combined_text")
    lines = {k: plain_lines(d) for k, d in (("primary", primary), ("header", header), ("both", both))}
    names = _organization_rows(lines["header"], 0).unionByName(_organization_rows(lines["primary"], 1)).unionByName(_organization_rows(lines["both"], 2))
    names = names.unionByName(_applicant_rows(lines["primary"], 0)).unionByName(_applicant_rows(lines["both"], 1))
    order = [F.col("source"), -F.col("score"), F.col("line_no")]
    top = best(names, ["doc_id", "field"], order, ["value"])
    fields = top.groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("organization_name", "applicant_name")])
    ranges = _range_rows(primary, lines["primary"], 0).unionByName(_range_rows(both, lines["both"], 1))
    dates = best(ranges, ["doc_id"], order, ["from_date", "to_date"])
    days = _day_rows(lines["primary"], 0).unionByName(_day_rows(lines["both"], 1)).join(dates, "doc_id", "left")
    count = V.days_inclusive(F.col("from_date"), F.col("to_date"))
    bonus = F.when(count.isNull(), 0).when(F.col("days") == count, 40).when(F.abs(F.col("days") - count) <= 1, 15).otherwise(-45)
    said = best(days.withColumn("score", F.col("score") + bonus), ["doc_id"], order, ["days"])
    out = chosen.select("doc_id").join(fields, "doc_id", "left").join(dates, "doc_id", "left").join(said, "doc_id", "left")
    total = F.when(count.isNotNull() & (F.col("days").isNull() | (F.abs(F.col("days") - count) > 1)), count).otherwise(F.col("days"))
    return out.select(
        "doc_id", "organization_name", "applicant_name", F.date_format("from_date", "dd-MM-yyyy").alias("from_date"),
        F.date_format("to_date", "dd-MM-yyyy").alias("to_date"), total.cast("string").alias("total_absent_days"),
    )
