"""Text cleaning and normalisation as Column expressions. A null text counts as empty unless said otherwise."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- Fixed values: characters that optical recognition confuses, and the labels it breaks. ---
DIGIT_LOOKALIKES = ("OQDILZSBG", "000112586")
LETTER_LOOKALIKES = ("012568", "OIZSGB")
BROKEN_LABELS = (
    ("D08", "DOB"), ("D0B", "DOB"), ("DATE 0F BIRTH", "DATE OF BIRTH"), ("YOUR AADHAAR N0", "YOUR AADHAAR NO"),
    ("Y0UR AADHAAR N0", "YOUR AADHAAR NO"), ("ENRO1MENT", "ENROLMENT"), ("ENR01MENT", "ENROLMENT"), ("V1D", "VID"),
    ("FATHER'5", "FATHER'S"), ("60VT", "GOVT"), ("G0VT", "GOVT"),
)
QUALITY_LABELS = ("AADHAAR", "DOB", "VID", "NAME", "FATHER", "ACCOUNT", "GOVT")
MEDICAL_WORDS = (
    ("ceftify", "certify"), ("certigy", "certify"), ("recmmended", "recommended"), ("reccomended", "recommended"),
    ("medicai", "medical"), ("absence", "absence"), ("fitness", "fitness"), ("fiitness", "fitness"),
    ("required", "required"), ("from", "from"), ("fromm", "from"),
)
DATE_REPAIRS = (
    (r"(\d)O(\d)", "$10$2"), (r"O(\d{2})(/)|(\d{2})O", "0$2$3"), (r"(\d{2})(2O2)([0-9])", "$1202$3"),
    (r"(/)([0-9])(O)([0-9])", "$1$203$4"),
)
# --- End of fixed values. ---


def as_text(c: Column) -> Column:
    """The column, or the empty string for null."""
    return F.coalesce(c.cast("string"), F.lit(""))


def normalize_line(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(as_text(c), r"\s+", " "))


def comparison_key(c: Column) -> Column:
    """Letters and digits of ASCII only, in upper case: texts with one key differ in layout alone."""
    return F.upper(F.regexp_replace(as_text(c), "[^A-Za-z0-9]", ""))


def strip_edges(c: Column) -> Column:
    """Without the leading and trailing characters that are no ASCII letter or digit."""
    return F.regexp_replace(as_text(c), "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")


def digit_lookalikes(c: Column) -> Column:
    """Upper case, with letters that look like digits read as digits. Null stays null."""
    return F.translate(F.upper(c), *DIGIT_LOOKALIKES)


def letter_lookalikes(c: Column) -> Column:
    """Upper case, with digits that look like letters read as letters. Null stays null."""
    return F.translate(F.upper(c), *LETTER_LOOKALIKES)


def restore_labels(c: Column) -> Column:
    """Known labels whose letters were read as digits are put right."""
    return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), BROKEN_LABELS, c)


def is_numeric_token(token: Column) -> Column:
    """Whether an upper-case token is a number read badly: a date shape, or all but one character digit-like."""
    compact = F.regexp_replace(token, "[^A-Z0-9]", "")
    others = F.length(F.regexp_replace(compact, "[0-9OQDILZSBG]", ""))
    date = token.rlike(r"^[0-9OQDILSZBG]{1,2}[/\-.][0-9OQDILSZBG]{1,2}[/\-.][0-9OQDILSZBG]{4}$")
    return (F.length(compact) >= 4) & ~compact.rlike("^[A-Z]{2,}[A-Z0-9]*$") & (date | (others <= 1))


def _repair_line(line: Column) -> Column:
    tokens = F.filter(F.split(restore_labels(line), r"\s+"), lambda t: t != "")
    fixed = F.transform(tokens, lambda t: F.when(is_numeric_token(t), F.translate(t, *DIGIT_LOOKALIKES)).otherwise(t))
    return restore_labels(F.array_join(fixed, " "))


def clean_id_text(c: Column) -> Column:
    """Recognised text of an identity card: upper case, control and odd characters out, numbers repaired, no empty lines."""
    text = F.regexp_replace(F.upper(as_text(c)), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    lines = F.transform(F.split(text, "\n"), _repair_line)
    tidy = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[^A-Z0-9\s/\-.:,()#@&'\"\[\]]", " "), r"[ \t]+", " ")))
    return F.array_join(F.filter(tidy, lambda x: x != ""), "\n")


def line_quality(line: Column) -> Column:
    """How likely a cleaned line is worth keeping: its length, plus what it seems to hold, minus signs of noise."""
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != "")
    short = F.size(F.filter(words, lambda w: F.length(w) < 3))
    label = reduce(lambda a, b: a | b, [F.contains(line, F.lit(x)) for x in QUALITY_LABELS])
    points = (
        (line.rlike(r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"), 35),
        (line.rlike(r"\d{2}/\d{2}/\d{4}"), 25),
        (line.rlike(r"\b[2-9]\d{3}\s\d{4}\s\d{4}\b"), 20),
        (label, 12),
        (line.rlike(r"^[A-Z]{3,}(?:\s[A-Z]{3,}){1,4}$"), 16),
        ((F.size(words) >= 4) & (short >= F.size(words) - 1), -30),
    )
    total = F.length(line) - 4 * (F.length(line) - F.length(F.replace(line, F.lit("?")))) - 2 * (F.length(line) - F.length(F.replace(line, F.lit("'")))) - 10 * short
    for condition, value in points:
        total = total + F.when(condition, value).otherwise(0)
    return total


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition; Spark has no such function."""
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def clean_invoice_text(c: Column, compose: bool = False) -> Column:
    """Recognised text of an invoice: plain dashes and quotes, wide gaps as ` | `, spaced labels, no empty lines.

    With `compose` texts first go through nfkc, the one step that needs Python; ASCII texts do not need it.
    """
    text = nfkc(as_text(c)) if compose else as_text(c)
    text = F.translate(text, "–—−‘’“” •", "---''\"\"  ")
    text = F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", "")
    for pattern, put in (
        (r"\t+", "    "), (" {3,}", " | "), (r"\n{3,}", "\n\n"), (r"([\-=~_])\1{2,}", "$1"), (r"\s*([:#])\s*", " $1 "),
        (r"(?<=\d),\s+(?=\d)", ","), (" +", " "),
    ):
        text = F.regexp_replace(text, pattern, put)
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def join_spaced_letters(c: Column) -> Column:
    """Single letters set apart by white space, three and then two at a time, become a word."""
    text = F.regexp_replace(c, r"\b([a-zA-Z])\s+([a-zA-Z])\s+([a-zA-Z])\b", "$1$2$3")
    return F.regexp_replace(text, r"\b([a-zA-Z])\s+([a-zA-Z])\b(?![a-zA-Z])", "$1$2")


def clean_medical_text(c: Column) -> Column:
    """Recognised text of a certificate: single white space, plain characters only, trimmed lines, joined letters."""
    text = F.regexp_replace(F.trim(as_text(c)), r"\s{2,}", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[^a-zA-Z0-9\s.,()/\-:;@\n]", "")
    lines = F.filter(F.transform(F.split(text, "\n"), strip_edges), lambda x: x != "")
    return F.trim(join_spaced_letters(F.array_join(lines, "\n")))


def correct_words(c: Column, words: tuple[tuple[str, str], ...] = MEDICAL_WORDS) -> Column:
    """Whole words replaced whatever their case."""
    return reduce(lambda acc, pair: F.regexp_replace(acc, rf"(?i)\b{pair[0]}\b", pair[1]), words, as_text(c))


def repair_characters(c: Column, run: int = 6) -> Column:
    """Letters beside digits read as digits, from left to right; white space becomes single blanks.

    O counts beside a digit, `/`, `-` or `.`; I, l, S and B beside a digit. What has been repaired counts as a digit for
    the letter after it, so runs are followed, for up to `run` letters. Repaired letters are marked by private
    characters first: a letter that stands before another letter must not see that one's repair.
    """
    text = normalize_line(c)
    rules = (("O", "[0-9/.-]", "\ue000"), ("[Il]", "[0-9]", "\ue001"), ("S", "[0-9]", "\ue005"), ("B", "[0-9]", "\ue008"))
    for letter, beside, mark in rules:
        text = F.regexp_replace(text, f"(?<={beside}){letter}|{letter}(?={beside})", mark)
    for _ in range(run):
        for letter, _, mark in rules:
            text = F.regexp_replace(text, f"(?<=[\ue000\ue001\ue005\ue008]){letter}", mark)
    return F.translate(text, "\ue000\ue001\ue005\ue008", "0158")


def repair_date_text(c: Column) -> Column:
    """Letters O inside dates read as zeros, by four fixed rules."""
    return reduce(lambda acc, rule: F.regexp_replace(acc, rule[0], rule[1]), DATE_REPAIRS, as_text(c))


def correct_medical_text(c: Column) -> Column:
    """Characters, then dates, then words of a recognised certificate."""
    return correct_words(repair_date_text(repair_characters(c)))


def earliest(text: Column, keywords: tuple[str, ...]) -> Column:
    """Where (from 1) the first of some lower-case keywords stands in text beyond its first character; else null."""
    places = F.array(*[F.instr(F.lower(text), k) for k in keywords])
    return F.array_min(F.filter(places, lambda p: p > 1))


def truncate_at(c: Column, keywords: tuple[str, ...]) -> Column:
    """The normalised line up to its earliest keyword, if that is not at its start."""
    line = normalize_line(c)
    at = earliest(line, keywords)
    return F.when(at.isNull(), line).otherwise(F.trim(F.substring(line, F.lit(1), at - 1)))


def fragments(c: Column, before: tuple[tuple[str, ...], ...]) -> Column:
    """The line, its parts between bars, and those parts cut before the earliest keyword of each list.

    Different ones only, shortest first; of one length in the order found.
    """
    line = normalize_line(c)
    parts = F.transform(F.split(line, r"\|+"), normalize_line)

    def pieces(p: Column) -> Column:
        out = [p]
        for keywords in before:
            at = F.coalesce(earliest(p, keywords), F.lit(0))
            out += [
                F.when(at > 0, F.trim(F.substring(p, F.lit(1), at - 1))).otherwise(""),
                F.when(at > 0, F.trim(F.substring(p, at, F.length(p)))).otherwise(""),
            ]
        return F.array(*out)

    found = F.array_distinct(F.filter(F.concat(F.array(line), F.flatten(F.transform(parts, pieces))), lambda x: x != ""))
    ranked = F.array_sort(F.transform(found, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x"))))
    return F.transform(ranked, lambda s: s["x"])


def collapse_repeats(c: Column) -> Column:
    """Comma parts that repeat an earlier one are dropped; then a text that is one half said twice is halved."""
    once = lambda value, use: F.transform(F.array(value), use)[0]

    def distinct(keyed: Column) -> Column:
        keys = F.transform(keyed, lambda s: s["k"])
        first = F.filter(keyed, lambda s, i: F.array_position(keys, s["k"]) == i + 1)
        return F.array_join(F.transform(first, lambda s: s["p"]), ", ")

    def halved(words: Column) -> Column:
        half = (F.size(words) / 2).cast("int")
        twice = (F.size(words) > 1) & (F.size(words) % 2 == 0) & (F.slice(words, F.lit(1), half) == F.slice(words, half + 1, half))
        return F.array_join(F.when(twice, F.slice(words, F.lit(1), half)).otherwise(words), " ")

    parts = F.transform(F.split(as_text(c), ","), lambda x: F.trim(x))
    keyed = F.filter(F.transform(parts, lambda p: F.struct(comparison_key(p).alias("k"), p.alias("p"))), lambda s: s["k"] != "")
    return once(F.split(once(keyed, distinct), " "), halved)


def spaced_pattern(token: Column) -> Column:
    """A pattern for the token with any white space between its characters."""
    return F.array_join(F.transform(F.filter(F.split(token, ""), lambda x: x != ""), lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))), r"\s*")


def redact(c: Column, tokens: Column, mark: str = " ### ") -> Column:
    """The text with every one of an array of tokens, however spaced, replaced by a mark."""
    return F.aggregate(
        F.filter(tokens, lambda t: t.isNotNull() & (t != "")), as_text(c), lambda text, t: F.regexp_replace(text, F.concat(F.lit("(?i)"), spaced_pattern(t)), F.lit(mark))
    )
